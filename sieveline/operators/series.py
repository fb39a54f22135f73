"""Price series by symbol and order column (WN8-WN14). Recurrences are scans of affine maps over chunks; the rest are windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordering
from .lineage import cut


def moving_average(df: DataFrame, n: int, name: str, order: list[str], value: str = "c", key: str = "symbol") -> DataFrame:
    """Null until the window is full."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(name, F.when(F.row_number().over(w) >= n, F.avg(value).over(w.rowsBetween(1 - n, 0))))


CHUNK = 256


def _carried(ends: DataFrame, chunks: int, steps: dict[str, float]) -> DataFrame:
    """Each chunk's value before its first bar, for every recurrence y = step * y + input: the chunks' affine maps are composed in rounds
    of doubling distance until all chunks before are in, or their factor is 0 in double precision.

    ``ends``: key, chunk and for each name the value at the chunk's end that its own bars give.
    """
    names = list(steps)
    maps = ends.select("key", "chunk", *names, *[F.lit(steps[n] ** CHUNK).alias(f"{n}_by") for n in names])
    reach = max(math.ceil(745 / (-CHUNK * math.log(s))) for s in steps.values())
    distance = 1
    while distance < min(chunks, reach):
        before = maps.select("key", (F.col("chunk") + distance).alias("chunk"), *[F.col(c).alias(f"p_{c}") for n in names for c in (n, f"{n}_by")])
        joined = maps.join(before, ["key", "chunk"], "left")
        value = lambda n: F.col(n) + F.coalesce(F.col(f"{n}_by") * F.col(f"p_{n}"), F.lit(0.0))
        by = lambda n: F.when(F.col(f"p_{n}").isNull(), F.col(f"{n}_by")).otherwise(F.col(f"{n}_by") * F.col(f"p_{n}_by"))
        maps = cut(joined.select("key", "chunk", *[value(n).alias(n) for n in names], *[by(n).alias(f"{n}_by") for n in names]))
        distance *= 2
    return maps.select("key", (F.col("chunk") + 1).alias("chunk"), *[F.col(n).alias(f"{n}_in") for n in names])


def linear_scan(rows: DataFrame, inputs: dict[str, tuple[Column, float]], chunks: int) -> DataFrame:
    """Adds y_i = step * y_(i-1) + input_i (y before the first bar is 0) for each name, over (key, chunk, at).

    Within a chunk the sum is a running one of inputs divided by powers of the step; before it, the chunk gets what all earlier chunks
    come to, from one row for each of them. So one key's series may lie in any number of tasks.
    """
    w = Window.partitionBy("key", "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    own = rows.select("*", *[(F.sum(u * F.pow(F.lit(s), -F.col("at"))).over(w) * F.pow(F.lit(s), F.col("at"))).alias(n) for n, (u, s) in inputs.items()])
    ends = own.groupBy("key", "chunk").agg(*[F.max_by(n, "at").alias(n) for n in inputs])
    before = _carried(cut(ends), chunks, {n: s for n, (_, s) in inputs.items()})
    whole = lambda n, s: (F.col(n) + F.coalesce(F.col(f"{n}_in"), F.lit(0.0)) * F.pow(F.lit(s), F.col("at") + 1)).alias(n)
    return own.join(before, ["key", "chunk"], "left").select(*rows.columns, *[whole(n, s) for n, (_, s) in inputs.items()])


def indicators(df: DataFrame, order: list[str], value: str = "c", key: str = "symbol") -> DataFrame:
    """key, order columns, ema12, ema26, macd, macd_signal, macd_hist, rsi14; MACD is null before bar 26, RSI for the first 14 bars, and
    100 where there was no loss.

    Exponential means start with the first value, Wilder's means of gains and losses with the plain mean of the first 14. Both
    are linear recurrences, computed as a scan over chunks of bars. ``order`` tells a key's bars apart; bars without a value are left out.
    """
    n, alphas = 14, {"ema12": 2 / 13, "ema26": 2 / 27}
    bars = ordering.positions(df.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), *[F.col(o).alias(f"o_{o}") for o in order], F.col(value).cast("double").alias("v")), ["key"], [f"o_{o}" for o in order], "bar")
    bars = cut(bars.withColumn("chunk", F.floor(F.col("bar") / CHUNK)).withColumn("at", F.col("bar") % CHUNK))
    last = bars.groupBy("key", (F.col("chunk") + 1).alias("chunk")).agg(F.max_by("v", "at").alias("last"))
    chunks = (bars.agg(F.max("chunk")).first()[0] or 0) + 1
    within = Window.partitionBy("key", "chunk").orderBy("at")
    moves = bars.join(last, ["key", "chunk"], "left").withColumn("move", F.col("v") - F.coalesce(F.lag("v").over(within), "last")).drop("last")
    start = F.col("bar") == 0
    # One of the first n gains weighs 1 / n at bar n, however long before that it was.
    early = lambda x: F.when(start, 0.0).when(F.col("bar") <= n, x / n * F.pow(F.lit((n - 1) / n), F.col("bar") - n)).otherwise(x / n)
    inputs = {name: (F.when(start, F.col("v")).otherwise(F.col("v") * a), 1 - a) for name, a in alphas.items()}
    inputs |= {"gain": (early(F.greatest("move", F.lit(0.0))), (n - 1) / n), "loss": (early(F.greatest(-F.col("move"), F.lit(0.0))), (n - 1) / n)}
    made = linear_scan(moves, inputs, chunks).withColumn("macd", F.col("ema12") - F.col("ema26"))
    made = linear_scan(cut(made), {"macd_signal": (F.when(start, F.col("macd")).otherwise(F.col("macd") * 0.2), 0.8)}, chunks)
    rsi = F.when(F.col("bar") >= n, F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss"))))
    late = lambda c: F.when(F.col("bar") >= 25, c)
    return made.select(F.col("key").alias(key), *[F.col(f"o_{o}").alias(o) for o in order], "ema12", "ema26", late(F.col("macd")).alias("macd"), late(F.col("macd_signal")).alias("macd_signal"), late(F.col("macd") - F.col("macd_signal")).alias("macd_hist"), rsi.alias("rsi14"))


def technicals(df: DataFrame, order: list[str], value: str = "c", key: str = "symbol") -> DataFrame:
    """key, momentum_30d, momentum_90d, volatility_30d, drawdown_90d from each symbol's last bars."""
    w = Window.partitionBy(key).orderBy(*order)
    back = Window.partitionBy(key).orderBy(*[F.col(o).desc() for o in order])
    lag = lambda n: F.lag(value, n).over(w)
    rows = df.select(key, *order, value).withColumn("b30", lag(30)).withColumn("b90", lag(90)).withColumn("prev", lag(1)).withColumn("late", F.row_number().over(back))
    rows = rows.withColumn("ret", F.when(F.col("prev") != 0, F.col(value) / F.col("prev") - 1))
    rows = rows.withColumn("nth", F.when(F.col("ret").isNotNull(), F.count("ret").over(back)))
    rows = rows.withColumn("peak", F.max(F.when(F.col("late") <= 90, F.col(value))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    change = lambda b: F.max(F.when((F.col("late") == 1) & (F.col(b) != 0), F.col(value) / F.col(b) - 1))
    fall = F.max(F.when((F.col("late") <= 90) & (F.col("peak") > 0), 1 - F.col(value) / F.col("peak")))
    spread = F.when(F.count(F.when(F.col("nth") <= 30, 1)) >= 30, F.stddev_pop(F.when(F.col("nth") <= 30, F.col("ret"))))
    return rows.groupBy(key).agg(F.round(change("b30"), 6).alias("momentum_30d"), F.round(change("b90"), 6).alias("momentum_90d"), F.round(spread, 6).alias("volatility_30d"), F.round(fall, 6).alias("drawdown_90d"))
