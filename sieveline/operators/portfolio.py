"""Company master, selection scores, diversified pick, capped weights, summary and benchmark comparison (JN1, JN2, JN10, PF)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import within
from ..functions.text import clamp

COMPONENTS = ("base_quality", "esg_alignment", "category_match", "profitability_alignment", "technical_alignment", "market_cap_alignment")
DEFAULT_WEIGHTS = dict(zip(COMPONENTS, (0.25, 0.20, 0.15, 0.20, 0.10, 0.10), strict=True))
BENCHMARK_WEIGHTS = dict(zip(COMPONENTS, (0.20, 0.45, 0.15, 0.10, 0.05, 0.05), strict=True))


@dataclass(frozen=True)
class AxisPreference:
    axis_id: int
    mode: str = "neutral"
    importance: float = 0.5


@dataclass(frozen=True)
class Profile:
    """A request: filters, modes, weights and limits."""

    categories: tuple[str, ...] = ()
    universes: tuple[str, ...] = ("common_equity",)
    excluded_universes: tuple[str, ...] = ()
    custom_esg_mode: str = "neutral"
    profitability_mode: str = "prefer_high"
    technical_mode: str = "prefer_high"
    market_cap_mode: str = "neutral"
    weighting_mode: str = "equal"
    axis_preferences: tuple[AxisPreference, ...] = ()
    max_holding_weight: float = 0.25
    max_per_category: int = 2
    min_categories: int = 3
    strict_category_limit: bool = False
    weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_WEIGHTS))
    min_posts: int = 4
    size: int = 10
    bounds: dict[str, tuple[float | None, float | None, bool]] = field(default_factory=dict)
    perception_min: float | None = None


def normal_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: v / total for k, v in weights.items()} if total > 0 else normal_weights(DEFAULT_WEIGHTS)


def master(universe: DataFrame, features: dict[str, DataFrame], defaults: dict[str, object]) -> DataFrame:
    """Universe left joined with each feature table on symbol; defaults fill what is missing. Spark broadcasts the tables it knows to be small."""
    for df in features.values():
        universe = universe.join(df, "symbol", "left")
    return universe.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in universe.columns})


def axis_columns(df: DataFrame, axes: str, n: int = 3, prefix: str = "custom_esg_axis") -> DataFrame:
    """First n elements of a nested array as wide columns."""
    parts = ("axis_label", "axis_score", "axis_exposure", "axis_confidence")
    return df.withColumns({f"{prefix}_{i + 1}_{p.removeprefix('axis_')}": F.get(axes, F.lit(i))[p] for i in range(n) for p in parts})


def candidates(df: DataFrame, profile: Profile) -> DataFrame:
    """Filters in order: category, excluded and allowed universes, posts, bounds."""
    if profile.categories:
        df = df.where(F.col("category").isin(*profile.categories))
    if profile.excluded_universes:
        df = df.where(~F.col("instrument_universe").isin(*profile.excluded_universes))
    allowed = {*profile.universes} | ({"reit"} if "common_equity" in profile.universes else set())
    df = df.where(F.col("instrument_universe").isin(*sorted(allowed))) if allowed else df.limit(0)
    df = df.where(F.col("posts_count") >= profile.min_posts)
    for column, (low, high, missing) in profile.bounds.items():
        df = df.where(within(column, low, high, missing))
    return df


def aligned(value: Column, mode: str, high: str = "prefer_high", low: str = "prefer_low") -> Column:
    """1 - x, x or 0.5 by mode; a missing value gives 0.5 when neutral and else 0."""
    if mode not in (high, low):
        return F.lit(0.5)
    return F.when(value.isNull(), 0.0).otherwise(value if mode == high else 1 - value)


def base_quality() -> Column:
    rank = 1 / F.sqrt(F.coalesce(F.nullif("rank_in_category", F.lit(0)), F.lit(999)))
    cap = F.when(F.col("market_cap_numeric") > 0, F.least(F.log10("market_cap_numeric") / 12, F.lit(1.0))).otherwise(0.0)
    return F.round(0.45 * rank + 0.35 * F.least(F.coalesce("posts_count", F.lit(0)) / 40, F.lit(1.0)) + 0.20 * cap, 4)


def axis_alignment(axes: DataFrame, preferences: tuple[AxisPreference, ...], catalog: DataFrame | None = None) -> DataFrame:
    """symbol, axis_component, match_count, perception from symbol, axis_id, score, exposure, confidence (and axis_id, average_sentiment)."""
    spark = axes.sparkSession
    prefs = F.broadcast(spark.createDataFrame([(p.axis_id, p.mode, p.importance) for p in preferences], "axis_id int, mode string, importance double"))
    x = axes.join(prefs, "axis_id")  # preferences come with the request: a few rows
    x = x.join(catalog.select("axis_id", "average_sentiment"), "axis_id", "left") if catalog is not None else x.withColumn("average_sentiment", F.lit(0.0))
    live = (F.col("mode") != "neutral") & (F.col("importance") > 0) & F.col("score").isNotNull()
    norm = clamp(F.col("score") / 100)
    good = F.when(F.col("mode") == "prefer_low", 1 - norm).otherwise(norm)
    exposure, confidence = clamp(F.coalesce("exposure", F.lit(0.0))), clamp(F.coalesce("confidence", F.lit(0.0)))
    w = F.when(live, F.col("importance") * (0.25 + 0.75 * confidence) * (0.20 + 0.80 * exposure))
    factor = (0.5 + 0.5 * clamp(F.coalesce("average_sentiment", F.lit(0.0)), -1.0, 1.0)) * clamp(F.col("importance")) * 2
    seen = F.when(F.col("importance") > 0, factor)
    return x.groupBy("symbol").agg((F.sum(good * w) / F.sum(w)).alias("axis_component"), F.count_if(live).alias("match_count"), F.round(clamp(F.sum(exposure * seen) / F.sum(seen)), 4).alias("perception"))


def scored(df: DataFrame, profile: Profile, axes: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """Adds the six components (rounded), perception_score and selection_score."""
    norm = lambda c: F.when(F.col(c).isNotNull(), clamp(F.col(c) / 100))
    base = aligned(norm("custom_esg_proxy_score"), profile.custom_esg_mode)
    active = [p for p in profile.axis_preferences if p.mode != "neutral" and p.importance > 0]
    if axes is not None and profile.axis_preferences:
        df = df.join(axis_alignment(axes, profile.axis_preferences, catalog), "symbol", "left")
        strength = sum(p.importance for p in active) / max(len(active), 1)
        blend = F.least(F.lit(0.8), 0.2 + 0.6 * min(1.0, strength) * F.col("match_count") / max(len(active), 1))
        esg = F.when(F.col("axis_component").isNull(), base).otherwise((1 - blend) * base + blend * F.col("axis_component"))
        perception = F.coalesce("perception", F.lit(0.5))
    else:
        esg, perception = base, F.lit(0.5)
    match = F.lit(1.0) if not profile.categories else F.col("category").isin(*profile.categories).cast("double")
    cap = F.when(F.col("market_cap_numeric").isNotNull(), clamp(F.log10(F.greatest("market_cap_numeric", F.lit(1.0))) / 12))
    parts = {
        "base_quality": base_quality(), "esg_alignment": F.round(esg, 4), "category_match": match,
        "profitability_alignment": aligned(norm("profitability_score"), profile.profitability_mode), "technical_alignment": aligned(norm("technical_score"), profile.technical_mode),
        "market_cap_alignment": aligned(cap, profile.market_cap_mode, "prefer_large", "prefer_small"),
    }
    weights = normal_weights(profile.weights)
    df = df.withColumns(parts).withColumn("perception_score", perception)
    total = None
    for k in COMPONENTS:
        total = F.col(k) * weights[k] if total is None else total + F.col(k) * weights[k]
    df = df.withColumn("selection_score", F.round(total, 4))
    return df.where(F.col("perception_score") >= profile.perception_min) if profile.perception_min is not None else df


def pick(df: DataFrame, profile: Profile) -> DataFrame:
    """The greedy diversified pick in closed form: seeds of the best categories, then under the cap, then the rest unless strict.

    Only rows that can be picked reach the last sort: a category's first ``size`` rows, found by window within category.
    """
    own = Window.partitionBy("category").orderBy(F.col("selection_score").desc(), "symbol")
    df = df.withColumn("cr", F.row_number().over(own)).where(F.col("cr") <= profile.size)
    seeds = min(profile.min_categories, profile.size)
    first = df.where("cr = 1").orderBy(F.col("selection_score").desc(), "symbol").limit(seeds).select(F.col("symbol").alias("seed"))
    df = df.join(F.broadcast(first), F.col("symbol") == F.col("seed"), "left") if seeds > 1 else df.withColumn("seed", F.lit(None).cast("string"))
    under = F.lit(True) if profile.max_per_category == 0 else F.col("cr") <= profile.max_per_category
    df = df.withColumn("phase", F.when(F.col("seed").isNotNull(), 0).when(under, 1).otherwise(2)).drop("seed")
    df = df.where("phase < 2") if profile.strict_category_limit else df
    taken = df.orderBy("phase", F.col("selection_score").desc(), "symbol").limit(profile.size)
    return taken.withColumn("position", F.row_number().over(Window.orderBy("phase", F.col("selection_score").desc(), "symbol")))


def weighted(df: DataFrame, profile: Profile) -> DataFrame:
    """Adds ``weight`` to the holdings (at most ``size`` rows): equal, or by score under a cap, the remainder to the first."""
    every = Window.partitionBy()
    n = F.count("*").over(every)
    if profile.weighting_mode != "score_weighted":
        return df.withColumn("weight", F.round(1 / n, 4))
    m = profile.max_holding_weight
    down = Window.orderBy(F.col("s").desc(), "position")
    df = df.withColumn("s", F.greatest("selection_score", F.lit(0.0001))).withColumn("k", F.row_number().over(down) - 1)
    rest = F.sum("s").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    df = df.withColumn("fits", ((1 - F.col("k") * m) * F.col("s") / rest <= m + 1e-9).cast("int")).withColumn("rest", rest)
    df = df.withColumn("capped", F.min(F.when(F.col("fits") == 1, F.col("k"))).over(every))
    tail = F.max(F.when(F.col("k") == F.col("capped"), F.col("rest"))).over(every)
    share = F.when(n * m < 1, 1 / n).when(F.col("k") < F.col("capped"), F.lit(m)).otherwise((1 - F.col("capped") * m) * F.col("s") / tail)
    df = df.withColumn("weight", F.round(share, 4))
    left = F.round(1 - F.sum("weight").over(every), 4)
    return df.withColumn("weight", F.round(F.col("weight") + F.when(F.col("position") == 1, left).otherwise(0.0), 4)).drop("s", "k", "fits", "rest", "capped")


def preview(df: DataFrame, profile: Profile, axes: DataFrame | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """Holdings for a profile: filter, score, pick, weigh."""
    return weighted(pick(scored(candidates(df, profile), profile, axes, catalog), profile), profile)


def benchmark_profile(profile: Profile) -> Profile:
    return replace(profile, custom_esg_mode="prefer_high", axis_preferences=(), weights=dict(BENCHMARK_WEIGHTS))


def allocations(holdings: DataFrame) -> DataFrame:
    return holdings.groupBy("category").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("holdings"), F.round(F.avg("selection_score"), 4).alias("mean_score"))


def summary(holdings: DataFrame) -> DataFrame:
    """One row: count, weight, concentration, weighted means over what isn't missing."""
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("weight")) / F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))), 4).alias(f"avg_{c}")
    return holdings.agg(F.count("*").alias("holdings"), F.round(F.sum("weight"), 4).alias("total_weight"), F.round(F.sum(F.col("weight") ** 2), 4).alias("hhi"), F.max("weight").alias("max_weight"), F.count_distinct("category").alias("categories"), mean("selection_score"), mean("custom_esg_proxy_score"), mean("profitability_score"), mean("technical_score"))


def comparison(base: DataFrame, other: DataFrame) -> DataFrame:
    """One row: overlap of holdings, its ratio over the base, differences of the weighted means."""
    shared = base.select("symbol").intersect(other.select("symbol")).agg(F.count("*").alias("overlap"))
    a = summary(base).select(F.col("holdings").alias("n"), *[F.col(c).alias(f"a_{c}") for c in ("hhi", "avg_custom_esg_proxy_score", "avg_profitability_score")])
    b = summary(other).select(*[F.col(c).alias(f"b_{c}") for c in ("hhi", "avg_custom_esg_proxy_score", "avg_profitability_score")])
    delta = lambda c: F.round(F.col(f"a_{c}") - F.col(f"b_{c}"), 4).alias(f"delta_{c}")
    one = shared.crossJoin(a).crossJoin(b)  # three tables of one row
    return one.select("overlap", F.round(F.col("overlap") / F.col("n"), 4).alias("overlap_ratio"), delta("hhi"), delta("avg_custom_esg_proxy_score"), delta("avg_profitability_score"))


def worklist(df: DataFrame, missing: str | None, min_posts: int = 30, limit: int = 100) -> DataFrame:
    """Companies that need data: enough posts, metric missing, most posts first; limit 0 is none."""
    df = df.where(F.col("posts_count") >= min_posts)
    df = df.where(F.col(missing).isNull()) if missing else df
    df = df.orderBy(F.col("posts_count").desc(), F.col("rank_in_category").asc_nulls_last(), "symbol")
    return df.limit(limit) if limit else df
