"""Keys, first-row picks, candidate matching, upserts (ID, SC3, JN3-JN8, SK6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rules import instrument_class
from ..functions.text import clean_label, symbol_key
from ..sources.files import exists, json_lines


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def last_by(df: DataFrame, keys: list[str], order: str = "_ord") -> DataFrame:
    return first_by(df, keys, F.col(order).desc())


def distinct_universe(rows: DataFrame) -> DataFrame:
    """For each symbol the row with the smallest category rank; a missing rank is last, ties keep file order."""
    keyed = rows.withColumn("symbol", symbol_key("symbol")).where("symbol != ''")
    return first_by(keyed, ["symbol"], F.coalesce(F.nullif("rank", F.lit(0)), F.lit(999999)), F.col("_ord"))


def first_values(rows: DataFrame, key: str, columns: list[str], order: str = "_ord", empty: tuple[str, ...] = ("", "-")) -> DataFrame:
    """For each key the first value of each column that isn't empty."""
    some = lambda c: F.when(~F.trim(c).isin(*empty), F.col(c))
    return rows.groupBy(key).agg(*[F.min_by(some(c), F.when(some(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def latest_values(rows: DataFrame, key: str, columns: list[str], order: str = "_ord") -> DataFrame:
    """For each key the last value of each column that isn't empty."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.groupBy(key).agg(*[F.max_by(some(c), F.when(some(c).isNotNull(), F.col(order))).alias(c) for c in columns])


def _late(c: str, order: str) -> Column:
    some = F.nullif(F.trim(c), F.lit(""))
    return F.max_by(some, F.when(some.isNotNull(), F.col(order)))


def _early(c: str, order: str) -> Column:
    some = F.nullif(F.trim(c), F.lit(""))
    return F.min_by(some, F.when(some.isNotNull(), F.col(order)))


def _longest(order: str) -> Column:
    return F.max_by("text", F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col(order)))


def _all_media(order: str) -> Column:
    """Media of all versions, in order, distinct by type and source where they are records."""
    return F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, "media"))), lambda x: x["media"])))


def upsert_messages(rows: DataFrame, key: list[str] | str = "id", order: str = "_ord") -> DataFrame:
    """Versions of a message become one: the latest url and username, the first datetime, the longest text, all media.

    A column ``embeds`` (records with an id, text, datetime, url, username and media, or some of these) is merged by the records' id:
    the longest text, the first datetime, url and username, all media, in order of first appearance; records without id are left out.
    """
    keys = [key] if isinstance(key, str) else key
    out = [_late(c, order).alias(c) for c in ("url", "username") if c in rows.columns]
    if "datetime" in rows.columns:
        out.append(_early("datetime", order).alias("datetime"))
    out.append(_longest(order).alias("text"))
    if "media" in rows.columns:
        out.append(_all_media(order).alias("media"))
    merged = rows.groupBy(*keys).agg(*out, F.count("*").alias("versions"), F.min(order).alias("first_seen"), F.max(order).alias("last_seen"))
    if "embeds" not in rows.columns:
        return merged
    inner = rows.select(*keys, F.col(order).alias("__o"), F.posexplode("embeds").alias("__p", "__e")).where("coalesce(__e.id, '') != ''")
    inner = inner.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__e.*", F.struct("__o", "__p").alias("__at"))
    names = [c for c in inner.columns if not c.startswith("__") and c != "id"]
    ways = {"text": _longest_at, "media": lambda: _all_media("__at")}
    one = inner.groupBy(*[f"__k{i}" for i in range(len(keys))], "id").agg(*[(ways[c]() if c in ways else _early(c, "__at")).alias(c) for c in names], F.min("__at").alias("__at"))
    # messages have few embeds each
    lists = one.groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", F.struct("id", *names).alias("e")))), lambda x: x["e"]).alias("embeds"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return merged.join(lists, same, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def _longest_at() -> Column:
    return F.max_by("text", F.struct(F.length(F.coalesce("text", F.lit(""))), -F.col("__at.__o"), -F.col("__at.__p")))


def first_messages(rows: DataFrame, key: str = "id", order: str = "_ord") -> DataFrame:
    """The first version of each message, as it is."""
    return first_by(rows, [key], F.col(order))


#: Exchange suffixes and their other names.
EXCHANGES = {
    "NS": ["NSE"], "BO": ["BSE"], "TO": ["TSX"], "V": ["TSXV"], "L": ["LSE", "LON"], "LN": ["LSE", "LON"], "AS": ["AMS", "AEX"], "SW": ["SIX"], "HK": ["HKEX"],
    "SI": ["SGX"], "AX": ["ASX"], "T": ["TSE", "TYO"], "SS": ["SSE"], "SZ": ["SZSE"], "KS": ["KRX"], "KQ": ["KOSDAQ"], "TW": ["TWSE"],
}


def ticker_candidates(symbol: Column | str, aliases: dict[str, list[str]] | None = None) -> Column:
    """Ordered distinct spellings of a listing symbol; parts are cut at points and strokes.

    First the symbol as it is, with points, with dashes. With two parts, base and exchange (also by its other names, and two letters
    with an E) joined by point and dash, then the base. With more, the parts between stay with the base, by points or dashes.
    """
    raw = F.upper(F.trim(F.col(symbol) if isinstance(symbol, str) else symbol))
    pointed = F.replace(raw, F.lit("/"), F.lit("."))
    parts = F.filter(F.split(pointed, r"\."), lambda x: x != "")
    base, ex, n = F.get(parts, 0), F.get(parts, F.size(parts) - 1), F.size(parts)
    none = F.array().cast("array<string>")
    known = F.create_map(*[x for k, v in (EXCHANGES if aliases is None else aliases).items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    names = F.array_distinct(F.concat(F.array(ex), F.coalesce(F.try_element_at(known, ex), none), F.when(ex.rlike("^[A-Z]{2}$"), F.array(F.concat(ex, F.lit("E")))).otherwise(none)))
    front = F.when(n > 2, F.slice(parts, 1, n - 1)).otherwise(none)
    dotted, dashed = F.array_join(front, "."), F.array_join(front, "-")
    two = F.concat(F.flatten(F.transform(names, lambda x: F.array(F.concat(base, F.lit("."), x), F.concat(base, F.lit("-"), x)))), F.array(base))
    forms = lambda x: F.array(F.concat(dotted, F.lit("-"), x), F.concat(dashed, F.lit("-"), x), F.concat(dotted, F.lit("."), x))
    safe = F.regexp_replace(F.regexp_replace(raw, r"[^A-Z0-9.\-]", "-"), "-+", "-")
    more = F.concat(F.flatten(F.transform(names, forms)), F.array(dotted, dashed, base, safe))
    made = F.concat(F.array(raw, pointed, F.replace(pointed, F.lit("."), F.lit("-"))), F.when(n == 2, two).when(n > 2, more).otherwise(none))
    return F.when(raw == "", none).otherwise(F.array_distinct(made))


def match_candidates(rows: DataFrame, symbols: DataFrame, key: str, candidates: str, symbol: str = "symbol") -> DataFrame:
    """key, matched (first candidate that is a symbol), hits, status: matched, ambiguous (several symbols hit) or unmatched."""
    spread = rows.select(F.col(key).alias("k"), F.posexplode_outer(candidates).alias("pos", "cand"))
    known = symbols.select(F.col(symbol).alias("sym")).distinct()
    hit = spread.join(known, F.col("cand") == F.col("sym"), "left").groupBy("k").agg(F.min_by("sym", F.when(F.col("sym").isNotNull(), F.col("pos"))).alias("matched"), F.count_distinct("sym").alias("hits"))
    status = F.when(F.col("hits") == 0, "unmatched").when(F.col("hits") > 1, "ambiguous").otherwise("matched")
    return hit.select(F.col("k").alias(key), "matched", "hits", status.alias("status"))


def match_statistics(matches: DataFrame) -> DataFrame:
    n = F.count("*")
    return matches.agg(n.alias("n_unique"), F.count("matched").alias("n_matched"), (n - F.count("matched")).alias("n_unmatched"), F.count_if(F.col("hits") > 1).alias("n_ambiguous"), F.round(F.count("matched") / n, 4).alias("match_rate"))


def merge_raw(base: DataFrame, raw: DataFrame, metrics: list[str], replace: bool = False, order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """Base rows updated by raw ones (the last of a symbol wins; a null keeps the old value unless ``replace``), and the unmatched raw rows."""
    keyed = raw.withColumn("symbol", symbol_key("symbol")).where("symbol != ''")
    if replace:
        new = last_by(keyed, ["symbol"], order).select("symbol", *[F.col(m).alias(f"__{m}") for m in metrics], F.lit(True).alias("__hit"))
    else:
        new = keyed.groupBy("symbol").agg(*[F.max_by(m, F.when(F.col(m).isNotNull(), F.col(order))).alias(f"__{m}") for m in metrics], F.lit(True).alias("__hit"))
    value = lambda m: F.when(F.col("__hit"), F.col(f"__{m}")).otherwise(F.col(m)) if replace else F.coalesce(f"__{m}", m)
    keep = [c for c in base.columns if c not in metrics]
    updated = base.join(new, "symbol", "left").select(*keep, *[value(m).alias(m) for m in metrics])
    return updated, keyed.join(base.select("symbol"), "symbol", "left_anti")


def to_do(rows: DataFrame, done: DataFrame, key: str, ok: Column | None = None) -> DataFrame:
    """Rows whose key isn't done yet; ``ok`` says which of the done rows count."""
    done = done if ok is None else done.where(ok)
    return rows.join(done.select(key).distinct(), key, "left_anti")


def company_records(spark: SparkSession, master: str, listing: str, schema: str, posts: DataFrame) -> DataFrame:
    """The companies of the master file; without one, those of the category listing (of the least rank each) with posts counted and
    instruments classified. ``posts``: symbol, posts_count."""
    if exists(spark, master):
        return spark.read.json(master)
    rows = distinct_universe(json_lines(spark, listing, schema))
    rows = rows.withColumns({"company_name": F.coalesce(F.nullif("company_name", F.lit("")), "symbol"), "category": clean_label("category")})
    rows = rows.withColumn("instrument_universe", instrument_class("company_name", "industry", "category"))
    return rows.join(posts, "symbol", "left").withColumn("posts_count", F.coalesce("posts_count", F.lit(0)))
