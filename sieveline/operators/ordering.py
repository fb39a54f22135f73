"""Positions and ranks over many tasks: rows are dealt by range and counted, and the ranges' totals are summed up before them.

A window over one key is one task, however long the key's rows are. Here the rows of a key may lie in many ranges: a row's position is its
place in its range and the sum of the key's rows in earlier ranges. The table of ranges has at most one row for each key and one
more for each range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

BROADCAST_ROWS = 200_000


def _ranged(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows sorted within ranges over ``keys`` and ``order``, with their range (``__range``) and an ascending number (``__at``)."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order)
    return cut(out.withColumn("__range", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()))


def _joined(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what their range and keys have; null keys are keys."""
    named = ranges.select("__range", *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[c for c in ranges.columns if c not in ("__range", *keys)])
    same = [F.col("__range") == F.col("__r"), *[F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]]
    named = named.withColumnRenamed("__range", "__r")
    if ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    return rows.join(named, reduce(lambda a, b: a & b, same)).drop("__r", *[f"__k{i}" for i in range(len(keys))])


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "position") -> DataFrame:
    """Adds each row's place (from 0) among the rows of its keys. ``order`` must tell the rows of a key apart."""
    rows = _ranged(df, keys, order)
    ranges = rows.groupBy("__range", *keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(ranges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    out = _joined(rows, ranges, keys).withColumn(name, F.col("__at") - F.col("__first") + F.col("__before"))
    return out.drop("__range", "__at", "__first", "__before")


def ranked_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, n, start, total: each distinct value of the keys, how many rows have it, how many have a smaller one, and how
    many values there are. Nulls don't count. A value that many rows have is one row before anything is dealt by order."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    rows = _ranged(counted, keys, [value])
    ranges = rows.groupBy("__range", *keys).agg(F.sum("n").alias("__n"))
    every = Window.partitionBy(*keys)
    before = every.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut(ranges.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("total", F.sum("__n").over(every)).drop("__n"))
    inside = Window.partitionBy("__range", *keys).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(rows, ranges, keys).withColumn("start", F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.col("__before"))
    return out.select(*keys, value, "n", "start", "total")


def quantiles(ranked: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys and one column for each share: the value at place (total - 1) * share, between two neighbours in proportion."""
    columns: list[Column] = []
    for name, q in shares.items():
        place = (F.col("total") - 1) * F.lit(q)
        at = lambda p: F.max(F.when((F.col("start") <= p) & (p < F.col("start") + F.col("n")), F.col(value)))
        low, high = at(F.floor(place)), at(F.ceil(place))
        columns.append((low + (high - low) * F.max(place - F.floor(place))).alias(name))
    return ranked.groupBy(*keys).agg(*columns)


def mid_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Adds the mid-rank percentile (0-100) of a value within its keys; 50 where all are equal, null for a null value."""
    ranked = ranked_values(df, keys, value)
    share = F.when(F.col("n") == F.col("total"), F.lit(50.0)).otherwise((F.col("start") + 0.5 * F.col("n")) / F.col("total") * 100)
    told = ranked.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(value).alias("__v"), share.alias(name))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col(value) == F.col("__v"))
    return df.join(told, same, "left").drop("__v", *[f"__k{i}" for i in range(len(keys))])
