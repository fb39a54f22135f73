"""Rule classifiers, filters and small score formulas as column expressions (FL, CL, FU)."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import clamp, col

# Marker stems, sentiment terms, category keywords and instrument patterns.
SEED_STEMS = tuple(
    "management board ceo cfo coo insider insiders accountability transparency corrupt dilut restructur activist proxy shareholder workers employees employee labor community harm exploit rights fair trust union strike layoff emissions carbon footprint renewable clean waste pollut sustainab climate fossil scam fraud mislead predatory ethics ethical responsible integrity misconduct manipulat lawsuit investigation settlement regulatory compliance fine sec probe litigation claims impact society social governance esg".split()
)
POSITIVE_TERMS = ("profit", "growth", "strong", "up", "beat", "bull", "good", "great", "win", "winner")
NEGATIVE_TERMS = ("loss", "fraud", "weak", "down", "miss", "bad", "scam", "dilution", "dump", "bankrupt")
LOW_NORM = ("oil", "gas", "mining", "gambling", "alcohol", "tobacco", "coal", "uranium", "weapons", "defense", "casino", "betting")
HIGH_NORM = ("software", "education", "medical", "diagnostics", "internet", "water", "recycling", "renewable", "health", "biotech")
FUND_WORDS = r"(?i)\b(etf|etn|fund|funds|ucits|index fund|exchange traded fund|mutual fund|closed[- ]end|unit trust)\b"
FUND_FAMILIES = r"(?i)\b(ishares|vaneck|wisdomtree|proshares|direxion|invesco|spdr|first trust|listed funds trust|grayscale|global x|vistashares|rex )"
REIT_INDUSTRY = r"(?i)real estate investment trust"
REIT_CATEGORY = r"(?i)\breits?\b"
REIT_NAME = r"(?i)\b(reit|realty|properties|property trust|mortgage|commercial real estate|real estate)\b"
SPAC_NAME = r"(?i)\b(acquisition corp|acquisition corporation|acquisition holdings|spac)\b"
ORDINAL = ("none", "marginal", "present", "dominant")


def words(values: tuple[str, ...] | list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def seed_matches(text: Column | str, stems: tuple[str, ...] | list[str] = SEED_STEMS) -> Column:
    """Sorted stems that a token of the text starts with, in one pass: the longest stem at a token, and those that begin it."""
    stems, none = sorted(stems, key=lambda s: (-len(s), s)), F.array().cast("array<string>")
    pattern = rf"(?:^|\s)({'|'.join(map(re.escape, stems))})"
    found = F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(col(text)), F.lit(pattern), F.lit(1)), none))
    within = {s: [t for t in stems if t != s and s.startswith(t)] for s in stems}
    more = [F.when(F.array_contains(found, s), words(t)).otherwise(none) for s, t in within.items() if t]
    return F.array_sort(F.array_distinct(F.concat(found, *more)) if more else found)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 when either is null or of length 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    a, b = col(a), col(b)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, dot(a, b) / norm), F.lit(0.0))


def boilerplate(text: Column | str, template: Column | str, frequency: Column | str, threshold: int, phrases: tuple[str, ...], hints: tuple[str, ...]) -> Column:
    """A listed phrase; or four hint words among at most 18 distinct ones; or a frequent template of five words or more."""
    low = F.lower(col(text))
    phrase = reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in phrases], F.lit(False))
    tokens = F.array_distinct(F.regexp_extract_all(col(template), F.lit("[a-z]{2,}"), F.lit(0)))
    hinted = (F.size(F.array_intersect(tokens, words(hints))) >= 4) & (F.size(tokens) <= 18)
    frequent = (col(frequency) >= threshold) & (F.size(F.filter(F.split(col(template), r"\s+"), lambda w: w != "")) >= 5)
    return phrase | hinted | frequent


def instrument_class(name: Column | str, industry: Column | str, category: Column | str, symbol_href: Column | str | None = None, company_href: Column | str | None = None) -> Column:
    """Ordered rules; the first that holds decides."""
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(col(c) if c is not None else F.lit(""), F.lit("")), r"\s+", " "))
    name, industry, category = clean(name), clean(industry), clean(category)
    href = F.lower(F.concat(clean(symbol_href), F.lit(" "), clean(company_href)))
    fund = name.rlike(FUND_WORDS) | name.rlike(FUND_FAMILIES)
    fund_industry = F.contains(F.lower(industry), F.lit("investment trusts or mutual funds"))
    reit_category, reit_name = category.rlike(REIT_CATEGORY), name.rlike(REIT_NAME)
    return (
        F.when(F.contains(href, F.lit("/coins/")), "crypto_coin")
        .when(industry.rlike(REIT_INDUSTRY) | (reit_category & reit_name), "reit")
        .when(fund_industry & ~fund, "ambiguous")
        .when(fund, "fund_etf_trust")
        .when(reit_category | name.rlike(SPAC_NAME), "ambiguous")
        .when((industry == "") | (industry == "-") | (F.lower(industry) == "unknown"), "ambiguous")
        .otherwise("common_equity")
    )


def explicit_label(text: Column | str, positive: str = "bullish", negative: str = "bearish") -> Column:
    low = F.lower(col(text))
    pos, neg = low.rlike(rf"\b{positive}\b"), low.rlike(rf"\b{negative}\b")
    return F.when(pos & ~neg, "positive").when(neg & ~pos, "negative")


def category_prior(category: Column | str, low: tuple[str, ...] = LOW_NORM, high: tuple[str, ...] = HIGH_NORM) -> Column:
    text = F.lower(F.coalesce(col(category), F.lit("")))
    hit = lambda terms: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms])
    return clamp(F.lit(0.5) - F.when(hit(low), 0.2).otherwise(0.0) + F.when(hit(high), 0.2).otherwise(0.0))


def lexicon_score(text: Column | str, positive: tuple[str, ...] = POSITIVE_TERMS, negative: tuple[str, ...] = NEGATIVE_TERMS) -> dict[str, Column]:
    """sentiment_score, sentiment_label, sentiment_confidence of normalised text."""
    tokens = F.regexp_extract_all(col(text), F.lit("[a-z]{2,}"), F.lit(0))
    count = lambda terms: F.size(F.filter(tokens, lambda t: F.array_contains(words(terms), t))).cast("double")
    pos, neg = count(positive), count(negative)
    confidence = F.least(F.lit(1.0), 0.20 + 0.18 * (pos + neg))
    score = (pos - neg) / (pos + neg + 1) * confidence
    return {"sentiment_score": F.round(score, 4), "sentiment_label": polarity(score), "sentiment_confidence": F.round(confidence, 4)}


def polarity(score: Column, cut: float = 0.20) -> Column:
    return F.when(score > cut, "positive").when(score < -cut, "negative").otherwise("neutral")


def explicit_override(label: Column | str, score: Column | str, confidence: Column | str, explicit: Column | str) -> dict[str, Column]:
    """A marker word decides where the score is neutral."""
    label, explicit = col(label), col(explicit)
    use = (label == "neutral") & explicit.isNotNull()
    return {
        "sentiment_score": F.when(use, F.when(explicit == "positive", 0.75).otherwise(-0.75)).otherwise(col(score)),
        "sentiment_confidence": F.when(use, F.greatest(col(confidence), F.lit(0.75))).otherwise(col(confidence)),
        "sentiment_label": F.when(use, explicit).otherwise(label),
    }


def within(value: Column | str, low: float | None = None, high: float | None = None, include_missing: bool = True) -> Column:
    """Bounds of a dimension filter; missing values pass or not by the switch, also where there is no bound."""
    v, ok = col(value), F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.lit(True) if low is None and high is None and include_missing else F.when(v.isNull(), F.lit(include_missing)).otherwise(ok)


def low_signal(coverage: Column | str, profiled: Column | str) -> Column:
    return F.coalesce(col(profiled) & (col(coverage) < 0.05), F.lit(False))


def method_agreement(active: list[Column], model_ok: Column | str) -> Column:
    """Active methods over all: three filters, and the model where it gave a profile."""
    count = reduce(lambda a, b: a + b, [F.coalesce(a, F.lit(False)).cast("int") for a in active])
    return F.round(count / (3 + F.coalesce(col(model_ok), F.lit(False)).cast("int")), 4)


def profile_confidence(coverage: Column | str, posts: Column | str, methods: Column | str) -> Column:
    coverage, posts = col(coverage), col(posts)
    raw = coverage * F.least(F.log10(F.greatest(posts, F.lit(1))) / 2, F.lit(1.0)) * (0.4 + 0.6 * col(methods) / 3)
    return F.when((posts == 0) | (coverage == 0), 0.0).otherwise(F.round(F.least(raw, F.lit(1.0)), 4))


def merge_frames(frames: Column | str) -> Column:
    """Frames without blank labels, the first of each label (in lower case, trimmed)."""
    frames = F.filter(col(frames), lambda f: F.trim(F.coalesce(f["label"], F.lit(""))) != "")
    keys = F.transform(frames, lambda f: F.lower(F.trim(f["label"])))
    return F.filter(frames, lambda f, i: F.array_position(keys, F.lower(F.trim(f["label"]))) == i + 1)


def sentiment_value(label: Column | str) -> Column:
    low = F.lower(F.trim(col(label)))
    return F.when(low == "positive", 1.0).when(low == "negative", -1.0).otherwise(0.0)


def valid_coverage(label: Column | str) -> Column:
    return F.when(col(label).isin(*ORDINAL), col(label)).otherwise("none")


def valid_frames(frames: Column | str) -> Column:
    return F.transform(col(frames), lambda f: f.withField("sentiment", F.when(f["sentiment"].isin("positive", "negative", "neutral", "mixed"), f["sentiment"]).otherwise("neutral")))


def ordinal(label: Column | str) -> Column:
    return (F.array_position(words(ORDINAL), col(label)) - 1).cast("int")


def category_group(url: Column | str, slug: Column | str, name: Column | str, geographic: tuple[str, ...], meta: tuple[str, ...]) -> Column:
    """geographic, index_or_meta or thematic by markers in url, slug or name."""
    text = F.lower(F.concat_ws(" ", col(url), col(slug), col(name)))
    hit = lambda terms: reduce(lambda a, b: a | b, [F.contains(text, F.lit(t)) for t in terms], F.lit(False))
    return F.when(hit(geographic), "geographic").when(hit(meta), "index_or_meta").otherwise("thematic")


def passthrough(posts: DataFrame) -> DataFrame:
    """The filter that every post passes, with full coverage."""
    return posts.withColumns({"passed": F.lit(True), "filter_score": F.lit(1.0)})
