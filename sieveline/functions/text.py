"""Text and value normalisation as column expressions (TX, ID1). All are null-safe and stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, letters and digits of all scripts: Java's own classes are ASCII.
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
LETTER = r"\p{L}\p{N}_"
#: Patterns of links, bare domains (those of topics and templates, and those of cleaned posts), cashtags and mentions.
URL = rf"https?://[^{SPACE}]+"
TOPIC_ENDINGS = "com|net|org|io|co|ai|gov|edu|biz|info|me|ca|uk|de|fr|jp|cn|ly|gg"
POST_ENDINGS = "com|app|gov|net|org|io|in|co"
TOPIC_DOMAIN = rf"(?<![{LETTER}])(?:[a-z0-9-]+\.)+(?:{TOPIC_ENDINGS})(?![{LETTER}])(?:/[^{SPACE}]*)?"
DOMAIN = rf"(?<![{LETTER}])[{LETTER}][{LETTER}.-]*\.(?:{POST_ENDINGS})(?![{LETTER}])(?:/[^{SPACE}]*)?"
CASHTAG = r"\$[A-Za-z][A-Za-z0-9.\-]*"
MENTION = r"@[A-Za-z0-9_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _without(text: Column, *patterns: str) -> Column:
    return reduce(lambda t, p: F.regexp_replace(t, p, " "), patterns, text)


def present(c: Column | str) -> Column:
    """Null for blank text."""
    return F.nullif(F.trim(col(c)), F.lit(""))


def first_present(*columns: Column | str) -> Column:
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in columns])


def symbol_key(c: Column | str) -> Column:
    return F.replace(F.upper(F.trim(col(c))), F.lit("-"), F.lit("."))


def training_text(c: Column | str) -> Column:
    """Lower case without links, cashtags, mentions, marker words and anything but letters."""
    return F.trim(_without(F.lower(F.trim(col(c))), URL, CASHTAG, MENTION, r"\bbullish\b", r"\bbearish\b", r"[^a-z\s]", r"\s+"))


def topic_text(c: Column | str) -> Column:
    return F.trim(_without(F.lower(col(c)), URL, TOPIC_DOMAIN, CASHTAG, MENTION, r"[^a-z\s]", r"\s+"))


def template_text(c: Column | str) -> Column:
    return F.trim(_without(F.lower(col(c)), URL, TOPIC_DOMAIN, CASHTAG, MENTION, r"\d+", r"[^a-z\s]", r"\s+"))


def informative_text(c: Column | str, stop_words: list[str]) -> Column:
    """Tokens of three letters or more that aren't stop words."""
    tokens = F.regexp_extract_all(col(c), F.lit("[a-z]{3,}"), F.lit(0))
    stops = F.array(*[F.lit(w) for w in stop_words]).cast("array<string>")
    return F.array_join(F.filter(tokens, lambda t: ~F.array_contains(stops, t)), " ")


#: Advertising phrases.
ADVERTS = ("instant stock alerts on whatsapp", "try free")


def clean_post(c: Column | str) -> Column:
    return F.trim(_without(col(c), "(?iu)" + DOMAIN, *["(?iu)" + a for a in ADVERTS], f"[{SPACE}]+"))


def clean_label(c: Column | str) -> Column:
    """Without leading words that hold other than ASCII characters, and without leading signs; blank is Unknown."""
    t = F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))
    t = F.regexp_replace(t, r"^(?:\S*[^\x00-\x7F]\S*\s+)+", "")
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, r"^[^A-Za-z0-9]+", ""), r"\s+", " "), F.lit(" -_/"))
    return F.when(t == "", F.lit("Unknown")).otherwise(t)


def market_cap(c: Column | str) -> Column:
    """Number and K/M/B/T right after it; commas are ignored."""
    t = F.upper(F.replace(F.coalesce(col(c).cast("string"), F.lit("")), F.lit(","), F.lit("")))
    number = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*([KMBT]?)", 1).try_cast("double")
    unit = F.regexp_extract(t, r"([0-9]+(?:\.[0-9]+)?)\s*([KMBT]?)", 2)
    factor = F.when(unit == "K", F.lit(1e3)).when(unit == "M", F.lit(1e6)).when(unit == "B", F.lit(1e9)).when(unit == "T", F.lit(1e12)).otherwise(F.lit(1.0))
    return number * factor


def ratio(c: Column | str) -> Column:
    """Number with decimal comma or point and optional percent sign; otherwise null."""
    t = F.replace(F.replace(F.trim(col(c).cast("string")), F.lit("%"), F.lit("")), F.lit(","), F.lit("."))
    return F.trim(t).try_cast("double")


def esg_number(c: Column | str) -> Column:
    return F.round(F.trim(F.replace(col(c).cast("string"), F.lit(","), F.lit("."))).try_cast("double"), 4)


def snippet(c: Column | str, width: int = 180) -> Column:
    t = F.trim(F.regexp_replace(col(c), r"\s+", " "))
    return F.when(F.length(t) > width, F.concat(F.rtrim(F.substring(t, 1, width - 1)), F.lit("…"))).otherwise(t)


def header_key(name: str, keep_underscore: bool = False) -> str:
    """Column header in lower case without signs (driver side)."""
    return "".join(ch for ch in name.lower().replace("﻿", "") if ch.isascii() and ch.isalnum() or keep_underscore and ch == "_")


def json_array(c: Column | str, element: str) -> Column:
    """Array from JSON text; what isn't one is empty."""
    return F.coalesce(F.from_json(col(c), f"array<{element}>"), F.array().cast(f"array<{element}>"))


def json_object_text(c: Column | str) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(col(c), r"(?s)\{.*\}", 0), F.lit(""))


def printable(c: Column | str) -> Column:
    """Without control characters (line feeds and tabs stay) and back-ticks."""
    return F.regexp_replace(col(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F`]", " ")


def title_phrase(c: Column | str, words: int = 4) -> Column:
    return F.initcap(F.array_join(F.slice(F.split(F.trim(col(c)), r"\s+"), 1, words), " "))


def safe_number(c: Column | str, digits: int = 4) -> Column:
    n = col(c).try_cast("double")
    return F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.lit(None).cast("double")).otherwise(F.round(n, digits))


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def prompt(posts: Column | str, head: str, limit: int = 20, width: int = 200) -> Column:
    """A head, then the first posts, each cut to a width and dashed."""
    cut = F.transform(F.slice(col(posts), 1, limit), lambda p: F.concat(F.lit("- "), F.substring(p, 1, width)))
    return F.concat(F.lit(head), F.lit("\n"), F.array_join(cut, "\n"))


def text_shape(c: Column | str, *arrays: str) -> dict[str, Column]:
    """Length, whether it is blank, and sizes of array columns; null counts as empty."""
    t = F.coalesce(col(c), F.lit(""))
    sizes = {f"n_{a}": F.coalesce(F.size(a), F.lit(0)) for a in arrays}
    return {"text_length": F.length(t), "is_text_empty": F.trim(t) == "", **sizes}


def human_number(c: Column | str, digits: int = 2) -> Column:
    """A number with M, B or T from a million on; n/d for null."""
    n = col(c).cast("double")
    shown = lambda by, unit, k=2: F.format_string(f"%.{k}f{unit}", n / by)
    return F.when(n.isNull(), "n/d").when(F.abs(n) >= 1e12, shown(1e12, " T")).when(F.abs(n) >= 1e9, shown(1e9, " B")).when(F.abs(n) >= 1e6, shown(1e6, " M")).otherwise(shown(1.0, "", digits))


def human_percent(c: Column | str) -> Column:
    n = col(c).cast("double")
    return F.when(n.isNull(), "n/d").otherwise(F.format_string("%.2f%%", n * 100))


def prompt_header(c: Column | str) -> dict[str, Column]:
    """symbol, category, industry and post_count from the head of an assembled prompt; null where it has none."""
    line = r"Company:\s*(\S+)\s*\|\s*Category:\s*([\s\S]*?)\s*\|\s*Industry:\s*([\s\S]*?)\s*\n"
    found = col(c).rlike(line)
    part = lambda k: F.when(found, F.regexp_extract(col(c), line, k))
    total = F.regexp_extract(col(c), r"Total posts collected:\s*(\d+)", 1).try_cast("long")
    return {"symbol": part(1), "category": part(2), "industry": part(3), "post_count": F.when(found, total)}
