"""Bounds, scores over available metrics, mid-rank percentiles, samples, rater agreement (WN1-WN7, WN15-WN18, EV, AG13)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp
from . import ordering
from .lineage import cut

# Metric weights; True marks metrics where less is better.
PROFITABILITY = {"roe": 0.30, "roa": 0.20, "net_margin": 0.20, "operating_margin": 0.15, "revenue_growth": 0.15}
TECHNICAL = {"momentum_30d": 0.25, "momentum_90d": 0.35, "volatility_30d": 0.20, "drawdown_90d": 0.20}
INVERSE = frozenset(("volatility_30d", "drawdown_90d"))


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def metric_bounds(df: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: the 10th and 90th percentile of each metric, least and greatest where they are equal, null where those are.

    The metrics' distinct values are counted and dealt by range, so no task holds all values of a metric.
    """
    long = df.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
    ranked = cut(ordering.ranked_values(long, ["metric"], "value"))
    ends = ordering.quantiles(ranked, ["metric"], "value", {"p10": 0.1, "p90": 0.9}).join(ranked.groupBy("metric").agg(F.min("value").alias("min"), F.max("value").alias("max")), "metric")
    same, flat = F.col("p10") == F.col("p90"), F.col("min") == F.col("max")
    value = lambda end, plain: F.when(same & flat, F.lit(None)).when(same, F.col(plain)).otherwise(F.col(end))
    ends = ends.select("metric", value("p10", "min").alias("low"), value("p90", "max").alias("high"))  # a row for each metric
    return ends.agg(*[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{m}_{e}") for m in metrics for e in ("low", "high")])


def score_metrics(df: DataFrame, weights: dict[str, float], inverse: frozenset[str] = frozenset(), prefix: str = "metric") -> DataFrame:
    """Adds <prefix>_score (0-100, over the metrics there are), _completeness and _metric_count. The bounds are one row, so broadcast."""
    both = df.crossJoin(F.broadcast(metric_bounds(df, list(weights))))
    norm = {}
    for m in weights:
        n = clamp((F.col(m) - F.col(f"{m}_low")) / (F.col(f"{m}_high") - F.col(f"{m}_low")))
        norm[m] = F.when(F.col(m).isNull() | F.col(f"{m}_low").isNull(), F.lit(None).cast("double")).otherwise(1 - n if m in inverse else n)
    have = add([F.when(norm[m].isNotNull(), w).otherwise(0.0) for m, w in weights.items()])
    got = add([F.coalesce(norm[m] * w, F.lit(0.0)) for m, w in weights.items()])
    count = add([norm[m].isNotNull().cast("int") for m in weights])
    return both.select(*df.columns, F.round(F.when(have > 0, 100 * got / have), 4).alias(f"{prefix}_score"), F.round(have, 4).alias(f"{prefix}_completeness"), count.alias(f"{prefix}_metric_count"))


def shrunk_axis_scores(df: DataFrame) -> DataFrame:
    """symbol, axis_id, raw, exposure, posts: adds percentile, confidence and the score shrunk towards 50."""
    confidence = F.least(F.lit(1.0), F.log1p("posts") / F.log1p(F.lit(15.0))) * F.least(F.lit(1.0), 0.2 + 0.8 * F.least(F.lit(1.0), 3.5 * F.col("exposure")))
    df = ordering.mid_ranks(df, ["axis_id"], "raw", "percentile").withColumn("confidence", confidence)
    return df.withColumn("axis_score", F.round(50 + F.col("confidence") * (F.col("percentile") - 50), 2)).withColumn("confidence", F.round("confidence", 4))


def shrunk_family_scores(df: DataFrame) -> DataFrame:
    """symbol, family_id, raw, exposure, dims, posts: the same for families."""
    evidence = F.col("dims") + F.least("posts", F.lit(24))
    confidence = F.least(F.lit(1.0), F.log1p(evidence) / F.log1p(F.lit(28.0))) * F.least(F.lit(1.0), 0.2 + 0.8 * F.least(F.lit(1.0), 1.8 * F.col("exposure")))
    df = ordering.mid_ranks(df, ["family_id"], "raw", "percentile").withColumn("confidence", confidence)
    return df.withColumn("family_score", F.round(50 + F.col("confidence") * (F.col("percentile") - 50), 2)).withColumn("confidence", F.round("confidence", 4))


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int) -> DataFrame:
    """Round robin over the strata in a random order fixed by the seed: first one of each, then a second, and so on."""
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key))
    return df.withColumn("turn", F.row_number().over(w)).orderBy("turn", stratum).limit(n)


def threshold_table(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """threshold, passed, rate: one pass over the data for all thresholds."""
    counted = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(value) >= t).alias(f"c{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("passed"), F.round(F.col(f"c{i}") / F.col("n"), 4).alias("rate")) for i, t in enumerate(thresholds)])
    return counted.select(F.inline(rows))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))


def agreement(df: DataFrame, a: str, b: str, levels: int = 4) -> DataFrame:
    """One row: n, exact, within_one and Cohen's kappa (plain, linear, quadratic) of two ordinal ratings."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("i"), F.col(b).alias("j")).agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("all"))
    rows, cols = cells.groupBy("i").agg(F.sum("n").alias("ri")), cells.groupBy("j").agg(F.sum("n").alias("cj"))
    # at most levels x levels cells: the expected table is bounded by the number of levels
    expected = F.broadcast(rows).join(F.broadcast(cols), F.lit(True))
    full = expected.join(cells, ["i", "j"], "left").crossJoin(F.broadcast(total)).withColumn("n", F.coalesce("n", F.lit(0)))
    d = F.abs(F.col("i") - F.col("j"))
    kinds = {"kappa": (d > 0).cast("double"), "kappa_linear": d / (levels - 1), "kappa_quadratic": (d / (levels - 1)) ** 2}
    aggs = [F.sum("n").alias("n"), F.round(F.sum(F.when(d == 0, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("exact"), F.round(F.sum(F.when(d <= 1, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("within_one")]
    for name, w in kinds.items():
        observed, chance = F.sum(w * F.col("n")), F.sum(w * F.col("ri") * F.col("cj") / F.col("all"))
        aggs.append(F.round(F.when(chance > 0, 1 - observed / chance), 4).alias(name))
    return full.agg(*aggs)


def confusion(df: DataFrame, a: str, b: str, levels: int) -> DataFrame:
    """Dense matrix: i, and a column c<j> for each level."""
    w = df.groupBy(F.col(a).alias("i")).agg(*[F.count_if(F.col(b) == j).alias(f"c{j}") for j in range(levels)])
    frame = df.sparkSession.range(levels).select(F.col("id").cast("int").alias("i"))
    return frame.join(w, "i", "left").select("i", *[F.coalesce(f"c{j}", F.lit(0)).cast("long").alias(f"c{j}") for j in range(levels)])


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def distribution(df: DataFrame, column: str, labels: list) -> DataFrame:
    """label, n: every label, in the given order, with 0 for those that don't occur."""
    frame = df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], f"pos int, label {dict(df.dtypes)[column]}")
    counted = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    return frame.join(counted, "label", "left").select("pos", "label", F.coalesce("n", F.lit(0)).alias("n"))


def annotation_scores(df: DataFrame) -> DataFrame:
    """One row of shares over the answers that aren't blank: precision, evidence_accuracy, null_correctness."""
    share = lambda c, yes="1": F.round(F.avg(F.when(F.trim(c) != "", (F.trim(c) == yes).cast("double"))), 4)
    return df.agg(share("frame_correct").alias("precision"), share("evidence_correct").alias("evidence_accuracy"), share("null_correct").alias("null_correctness"))
