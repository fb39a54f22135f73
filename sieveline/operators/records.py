"""Pairing, enriching, cataloguing and laying out of records (ID10-12, FL9-10, CL8, CL11-12, AG11, AG18, AG21, JN3-5, JN8, JN11-13, EV6, PF7, PF9, PF16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import cosine
from ..functions.text import col
from .statistics import top_k

#: Suffixes of the universe and those of the market data source.
PROVIDER_SUFFIXES = {".NSE": ".NS", ".TSX": ".TO", ".AX": ".AX"}
#: Instrument classes in their order, and those that portfolios leave out.
UNIVERSES = ("common_equity", "reit", "fund_etf_trust", "ambiguous", "crypto_coin")
HIDDEN_UNIVERSES = ("fund_etf_trust", "crypto_coin")


def suffix_candidates(symbol: Column | str) -> Column:
    """The mapped spelling first, then the symbol, then its base; the symbol alone without a known suffix."""
    s = col(symbol)
    out = F.array(s)
    for raw, mapped in PROVIDER_SUFFIXES.items():
        base = F.substring(s, F.lit(1), F.length(s) - len(raw))
        out = F.when(F.endswith(s, F.lit(raw)), F.array_distinct(F.array(F.concat(base, F.lit(mapped)), s, base))).otherwise(out)
    return out


def preferred_links(rows: DataFrame, key: str, href: str, listing: Column, order: str = "_ord") -> DataFrame:
    """key, href: one link for each key, a listing one if there is any, the first of its kind."""
    return rows.groupBy(key).agg(F.max_by(href, F.struct(listing, -F.col(order))).alias(href))


def unique_slugs(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds ``slug``: the name in lower case with dashes; later ones of the same slug get -2, -3 and so on."""
    plain = F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit("item"))
    numbered = top_k(rows.withColumn("slug", plain), ["slug"], (1 << 31) - 1, *[F.col(c) for c in order])
    return numbered.withColumn("slug", F.when(F.col("rn") > 1, F.concat_ws("-", "slug", "rn")).otherwise(F.col("slug"))).drop("rn")


def match_indices(rows: DataFrame, symbols: DataFrame, key: str, candidates: str, indices: list[str], symbol: str) -> DataFrame:
    """key, matched, index_no: the first candidate found in the first index (column of ``symbols``) that has any."""
    entries = F.array(*[F.struct(F.lit(i).alias("index_no"), F.col(c).alias("entry")) for i, c in enumerate(indices)])
    known = symbols.select(F.col(symbol).alias("sym"), F.inline(entries)).where("entry is not null")
    spread = rows.select(F.col(key).alias("__k"), F.posexplode(candidates).alias("pos", "cand"))
    place = F.struct("index_no", "pos", "sym")
    hits = spread.join(known, F.col("cand") == F.col("entry")).groupBy("__k").agg(F.min(place).alias("first"))
    out = rows.select(F.col(key)).join(hits, F.col(key) == F.col("__k"), "left")
    return out.select(key, F.col("first.sym").alias("matched"), F.col("first.index_no").alias("index_no"))


def merge_universe(left: DataFrame, right: DataFrame, key: str, category: str, order: list[Column], prefixes: tuple[str, str] = ("cmc_", "st_"), top: int = 250) -> DataFrame:
    """The first ``top`` left rows of each category that have a right row, all columns under their source's prefix."""
    best = top_k(left, [category], top, *order).drop("rn")
    one, two = (df.select(key, *[F.col(c).alias(p + c) for c in df.columns if c != key]) for df, p in zip((best, right), prefixes, strict=True))
    return one.join(two, key)


def enriched_posts(posts: DataFrame, companies: DataFrame) -> DataFrame:
    """Posts with company_name (the symbol if unknown), category and industry (Unknown if there is none)."""
    known = companies.select(F.col("symbol").alias("__s"), "company_name", "category", "industry")
    joined = posts.join(known, F.col("symbol") == F.col("__s"), "left").drop("__s")
    filled = {"company_name": F.coalesce("company_name", "symbol"), **{c: F.coalesce(c, F.lit("Unknown")) for c in ("category", "industry")}}
    return joined.withColumns(filled)


def rater_pairs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, a, b: what two raters gave, for keys that both rated without error (column ``error``)."""
    sound = lambda df, name: df.where(~F.coalesce("error", F.lit(False))).select(key, F.col(value).alias(name))
    return sound(a, "a").join(sound(b, "b"), key)


def with_catalog(axes: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Axes whose ``columns`` are those of the catalog where it has them."""
    listed = catalog.select(F.col("axis_id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = axes.join(listed, F.col("axis_id") == F.col("__id"), "left")
    return joined.select(*[F.coalesce(f"__{c}", c).alias(c) if c in columns else c for c in axes.columns])


def synchronised(catalog: DataFrame, preferences: DataFrame) -> DataFrame:
    """axis_id, mode, importance of every catalog axis; neutral and 0.5 where nothing is preferred."""
    out = catalog.select("axis_id").join(preferences, "axis_id", "left")
    return out.select("axis_id", F.coalesce("mode", F.lit("neutral")).alias("mode"), F.coalesce("importance", F.lit(0.5)).alias("importance"))


def paired_replies(messages: DataFrame, key: str, order: str) -> DataFrame:
    """key, prompt, reply: replies with the message that their parent id names; the last reply of a key."""
    asked = messages.select(F.col("id").alias("__id"), F.col("text").alias("prompt"), F.col(key))
    replies = messages.where("parent_id is not null").select("parent_id", F.col("text").alias("reply"), F.col(order).alias("__ord"))
    joined = replies.join(asked, F.col("parent_id") == F.col("__id"))
    last = joined.groupBy(key).agg(F.max_by(F.struct("prompt", "reply"), "__ord").alias("m"))
    return last.select(key, "m.prompt", "m.reply")


def usable_posts(posts: DataFrame, least_chars: int, least_posts: int, keep: int, *order: Column) -> DataFrame:
    """symbol, n_usable, posts (the first ``keep`` usable ones) of symbols with enough posts that are long enough."""
    usable = posts.where(F.length(F.trim("text")) >= least_chars)
    counted = usable.groupBy("symbol").agg(F.count("*").alias("n_usable")).where(F.col("n_usable") >= least_posts)
    first = top_k(usable, ["symbol"], keep, *order).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("rn", "text"))).alias("p"))
    return counted.join(first, "symbol").select("symbol", "n_usable", F.col("p.text").alias("posts"))


def instrument_counts(companies: DataFrame) -> DataFrame:
    """pos, id, companies_count of every class that is shown, in order; REITs count as equity."""
    shown = [u for u in UNIVERSES if u not in ("reit", *HIDDEN_UNIVERSES)]
    frame = companies.sparkSession.createDataFrame(list(enumerate(shown)), "pos int, id string")
    kind = F.coalesce(F.when(F.col("instrument_universe") == "reit", "common_equity").otherwise(F.col("instrument_universe")), F.lit("ambiguous"))
    counted = companies.groupBy(kind.alias("id")).agg(F.count("*").alias("n"))
    return frame.join(counted, "id", "left").select("pos", "id", F.coalesce("n", F.lit(0)).alias("companies_count"))


def metric_availability(df: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """One row: for each group whether any of its columns has a value in any row."""
    some = lambda columns: reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    return df.agg(*[F.coalesce(F.bool_or(some(columns)), F.lit(False)).alias(name) for name, columns in groups.items()])


def warnings(modes: dict[str, str], available: dict[str, bool], universes: tuple[str, ...]) -> list[str]:
    """Names of what a request asks for and the data lack, and of doubtful universes (driver side)."""
    return [f"no_{name}_metrics" for name, mode in modes.items() if mode != "neutral" and not available.get(name)] + ["ambiguous_universe"] * ("ambiguous" in universes)


def concept_topics(topics: DataFrame, concepts: DataFrame) -> DataFrame:
    """topic_id, axiological_score, noise_score, is_axiological; ``concepts``: one row with the vectors axiological and noise; topic -1 is noise."""
    joined = topics.crossJoin(F.broadcast(concepts))  # one row
    outlier = F.col("topic_id") == -1
    a, n = cosine("vector", "axiological"), cosine("vector", "noise")
    return joined.select("topic_id", F.when(outlier, 0.0).otherwise(F.round(a, 4)).alias("axiological_score"), F.when(outlier, 1.0).otherwise(F.round(n, 4)).alias("noise_score"), (~outlier & (a > n)).alias("is_axiological"))


def searched(df: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term, in any case, in any of the columns (strings or arrays of strings); all rows for a blank term."""
    term = term.strip().lower()
    return df if not term else df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(term)))


def shown_axes(axes: DataFrame, n: int = 18) -> DataFrame:
    """The n axes of the greatest corpus weight."""
    return axes.orderBy(F.col("corpus_weight").desc(), F.col("axis_id")).limit(n)


def annotation_sheet(profiles: DataFrame) -> DataFrame:
    """symbol, profile_null, frames: one row for each frame, and one for each profile without any; blank answers."""
    blank = {c: F.lit("") for c in ("frame_confirmed", "evidence_correct", "notes")}
    frames = profiles.where("not profile_null").select("symbol", "profile_null", F.inline("frames")).withColumnsRenamed({"label": "frame_label", "sentiment": "frame_sentiment"})
    nulls = profiles.where("profile_null").select("symbol", "profile_null", F.lit("(profile_null)").alias("frame_label"), F.lit("").alias("frame_sentiment"))
    return frames.unionByName(nulls).withColumns(blank)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name, n of each table."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def company_axes(nested: Column | str, wide: Column | str) -> Column:
    """The nested axes of a company, or else those of its wide columns; axes without label are left out."""
    axes = F.when(F.size(F.coalesce(col(nested), F.array())) > 0, col(nested)).otherwise(col(wide))
    return F.filter(axes, lambda a: F.trim(F.coalesce(a["axis_label"], F.lit(""))) != "")


def ordered_families(families: Column | str) -> Column:
    """By relevance, exposure and confidence, all descending; missing ones are 0, families without id are left out."""
    named = F.filter(col(families), lambda f: F.trim(F.coalesce(f["family_id"], F.lit(""))) != "")
    keyed = F.transform(named, lambda f, i: F.struct(*[F.coalesce(f[c], F.lit(0.0)).alias(c) for c in ("relevance", "exposure", "confidence")], (-i).alias("at"), f.alias("f")))
    return F.transform(F.sort_array(keyed, asc=False), lambda k: k["f"])


def explanations(components: dict[str, str], weights: dict[str, float]) -> Column:
    """Array of title, value and points (value times weight times 100, two digits), most points first; equal points in the order of the components."""
    parts = [F.struct((-F.round(F.col(c) * weights[c] * 100, 2)).alias("less"), F.lit(i).alias("at"), F.lit(title).alias("title"), F.col(c).alias("value")) for i, (c, title) in enumerate(components.items())]
    return F.transform(F.array_sort(F.array(*parts)), lambda p: F.struct((-p["less"]).alias("points"), p["title"].alias("title"), p["value"].alias("value")))
