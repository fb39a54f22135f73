"""Whole previews for many profiles in one pass (PF17): holdings, warnings, summary, allocations and the benchmark's, one row a profile.

Profiles are rows of a small table beside the companies; each gives two requests, its own and its benchmark's. Companies are scanned
once for all requests (and once more, narrowly, for which metrics there are at all). What passes a request's filters is scored and kept
as a narrow row; from there on a request's candidates are cut to the first ``size`` of each category by a limited rank, before anything
is sorted for the request. The greedy pick and the capped weights are the closed forms of ``portfolio``, within requests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clamp
from . import portfolio
from .lineage import cut
from .portfolio import COMPONENTS, Profile

#: The metrics that summaries average, and those whose absence a request with a mode for them is warned of.
AVERAGED = ("custom_esg_proxy_score", "profitability_score", "technical_score", "posts_count")
ASKED = {"custom_esg": "custom_esg_proxy_score", "profitability": "profitability_score", "technical": "technical_score"}

_REQUEST = (
    "profile string, kind string, categories array<string>, universes array<string>, excluded array<string>, custom_esg_mode string, profitability_mode string, technical_mode string, market_cap_mode string, weighting_mode string, "
    "axes array<struct<axis_id int, mode string, importance double, sentiment double>>, weights array<double>, bounds array<struct<metric string, low double, high double, missing boolean>>, "
    "max_holding_weight double, max_per_category int, min_categories int, strict boolean, min_posts int, size int, perception_min double"
)
_KEY = ["profile", "kind"]


def requests(spark: SparkSession, profiles: dict[str, Profile], sentiments: dict[int, float] | None = None) -> DataFrame:
    """Two rows for each profile: ``base`` and ``benchmark``. ``sentiments``: average sentiment by axis, of the catalog."""
    rows = []
    for name, base in profiles.items():
        for kind, p in (("base", base), ("benchmark", portfolio.benchmark_profile(base))):
            weights = portfolio.normal_weights(p.weights)
            axes = [(a.axis_id, a.mode, float(a.importance), float((sentiments or {}).get(a.axis_id) or 0.0)) for a in p.axis_preferences]
            bounds = [(m, None if low is None else float(low), None if high is None else float(high), missing) for m, (low, high, missing) in p.bounds.items()]
            universes = sorted({*p.universes} | ({"reit"} if "common_equity" in p.universes else set()))
            rows.append((name, kind, list(p.categories), universes, list(p.excluded_universes), p.custom_esg_mode, p.profitability_mode, p.technical_mode, p.market_cap_mode, p.weighting_mode, axes, [weights[c] for c in COMPONENTS], bounds, p.max_holding_weight, p.max_per_category, p.min_categories, p.strict_category_limit, p.min_posts, p.size, p.perception_min))
    return spark.createDataFrame(rows, _REQUEST)


def _passes(metrics: list[str]) -> Column:
    """The filters of a request on a company: categories, universes, posts, bounds."""
    none = lambda c: F.size(c) == 0

    def bounded(m: str) -> Column:
        """A missing value passes by the switch; bounds that aren't set hold."""
        v = F.col(m).cast("double")
        own = F.filter("bounds", lambda b: b["metric"] == m)
        return F.forall(own, lambda b: F.when(v.isNull(), b["missing"]).otherwise((b["low"].isNull() | (v >= b["low"])) & (b["high"].isNull() | (v <= b["high"]))))

    inside = reduce(lambda a, m: a & bounded(m), metrics, F.lit(True))
    return (none("categories") | F.array_contains("categories", F.col("category"))) & ~F.array_contains("excluded", F.col("instrument_universe")) & F.array_contains("universes", F.col("instrument_universe")) & (F.col("posts_count") >= F.col("min_posts")) & inside


def _aligned(value: Column, mode: str, high: str, low: str) -> Column:
    """As in ``portfolio.aligned``, by a mode in a column."""
    return F.when(~F.col(mode).isin(high, low), 0.5).when(value.isNull(), 0.0).when(F.col(mode) == high, value).otherwise(1 - value)


def _axis_parts(own: Column) -> dict[str, Column]:
    """axis_component, live, perception of a company's axes (axis_id, score, exposure, confidence) and a request's preferences."""
    pairs = F.filter(F.transform("axes", lambda p: F.struct(p.alias("p"), F.get(F.filter(own, lambda a: a["axis_id"] == p["axis_id"]), F.lit(0)).alias("a"))), lambda x: x["a"].isNotNull())
    exposure = lambda x: clamp(F.coalesce(x["a"]["exposure"], F.lit(0.0)))
    live = lambda x: (x["p"]["mode"] != "neutral") & (x["p"]["importance"] > 0) & x["a"]["score"].isNotNull()
    weight = lambda x: x["p"]["importance"] * (0.25 + 0.75 * clamp(F.coalesce(x["a"]["confidence"], F.lit(0.0)))) * (0.20 + 0.80 * exposure(x))
    norm = lambda x: clamp(x["a"]["score"] / 100)
    good = lambda x: F.when(x["p"]["mode"] == "prefer_low", 1 - norm(x)).otherwise(norm(x))
    factor = lambda x: (0.5 + 0.5 * clamp(x["p"]["sentiment"], -1.0, 1.0)) * clamp(x["p"]["importance"]) * 2
    total = lambda xs, f: F.aggregate(F.transform(xs, f), F.lit(0.0), lambda s, v: s + v)
    alive, seen = F.filter(pairs, live), F.filter(pairs, lambda x: x["p"]["importance"] > 0)
    ratio = lambda xs, top, bottom: F.when(total(xs, bottom) > 0, total(xs, top) / total(xs, bottom))
    return {
        "axis_component": ratio(alive, lambda x: good(x) * weight(x), weight), "live": F.size(alive),
        "perception": F.round(clamp(ratio(seen, lambda x: exposure(x) * factor(x), factor)), 4),
    }


def _narrow(companies: DataFrame, metrics: list[str], axes: str | None) -> DataFrame:
    """The columns that requests look at; further ones may have any name."""
    named = dict.fromkeys(["symbol", "category", "instrument_universe", "market_cap_numeric", "rank_in_category", *AVERAGED, *metrics])
    return companies.select(*named, *([F.col(axes).alias("own_axes")] if axes else []))


def _scored(rows: DataFrame) -> DataFrame:
    """The narrow rows of what passes: request, symbol, category, the averaged metrics, perception_score, selection_score."""
    norm = lambda c: F.when(F.col(c).isNotNull(), clamp(F.col(c) / 100))
    base = _aligned(norm("custom_esg_proxy_score"), "custom_esg_mode", "prefer_high", "prefer_low")
    rows = rows.withColumns(_axis_parts(F.col("own_axes")) if "own_axes" in rows.columns else {"axis_component": F.lit(None).cast("double"), "live": F.lit(0), "perception": F.lit(None).cast("double")})
    active = F.filter("axes", lambda p: (p["mode"] != "neutral") & (p["importance"] > 0))
    strength = F.aggregate(active, F.lit(0.0), lambda s, p: s + p["importance"]) / F.greatest(F.size(active), F.lit(1))
    blend = F.least(F.lit(0.8), 0.2 + 0.6 * F.least(F.lit(1.0), strength) * F.col("live") / F.greatest(F.size(active), F.lit(1)))
    esg = F.when(F.col("axis_component").isNull(), base).otherwise((1 - blend) * base + blend * F.col("axis_component"))
    cap = F.when(F.col("market_cap_numeric").isNotNull(), clamp(F.log10(F.greatest("market_cap_numeric", F.lit(1.0))) / 12))
    parts = [
        portfolio.base_quality(), F.round(esg, 4), F.lit(1.0),  # the category matches: it is a filter
        _aligned(norm("profitability_score"), "profitability_mode", "prefer_high", "prefer_low"), _aligned(norm("technical_score"), "technical_mode", "prefer_high", "prefer_low"),
        _aligned(cap, "market_cap_mode", "prefer_large", "prefer_small"),
    ]
    score = reduce(lambda a, b: a + b, [p * F.col("weights")[i] for i, p in enumerate(parts)])
    out = rows.withColumn("perception_score", F.coalesce("perception", F.lit(0.5))).withColumn("selection_score", F.round(score, 4))
    out = out.where(F.col("perception_min").isNull() | (F.col("perception_score") >= F.col("perception_min")))
    return out.select(*_KEY, "symbol", "category", *AVERAGED, "perception_score", "selection_score")


def _picked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The pick of each request with ``position``; see ``portfolio.pick``."""
    best = [F.col("selection_score").desc(), F.col("symbol")]
    own, every = Window.partitionBy(*_KEY, "category").orderBy(*best), Window.partitionBy(*_KEY)
    limit = asked.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    rows = rows.withColumn("cr", F.row_number().over(own)).where(F.col("cr") <= limit).join(F.broadcast(asked.select(*_KEY, "size", "min_categories", "max_per_category", "strict", "weighting_mode", "max_holding_weight")), _KEY)
    rows = rows.where(F.col("cr") <= F.col("size"))
    seeds = F.least("min_categories", "size")
    first = F.row_number().over(Window.partitionBy(*_KEY, F.col("cr") == 1).orderBy(*best))
    rows = rows.withColumn("seed", (F.col("cr") == 1) & (seeds > 1) & (first <= seeds))
    under = (F.col("max_per_category") == 0) | (F.col("cr") <= F.col("max_per_category"))
    rows = rows.withColumn("phase", F.when(F.col("seed"), 0).when(under, 1).otherwise(2)).where(~F.col("strict") | (F.col("phase") < 2))
    rows = rows.withColumn("position", F.row_number().over(every.orderBy("phase", *best)))
    return rows.where(F.col("position") <= F.col("size")).drop("cr", "seed", "size", "min_categories", "max_per_category", "strict")


def _weighted(rows: DataFrame) -> DataFrame:
    """Adds ``weight`` to the holdings of each request; see ``portfolio.weighted``."""
    every = Window.partitionBy(*_KEY)
    down = every.orderBy(F.col("s").desc(), "position")
    n, m, s, k = F.count("*").over(every), F.col("max_holding_weight"), F.col("s"), F.col("k")
    rows = rows.withColumn("s", F.greatest("selection_score", F.lit(0.0001))).withColumn("k", F.row_number().over(down) - 1)
    rows = rows.withColumn("rest", F.sum("s").over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("n", n)
    rows = rows.withColumn("capped", F.min(F.when((1 - k * m) * s / F.col("rest") <= m + 1e-9, k)).over(every))
    tail = F.max(F.when(k == F.col("capped"), F.col("rest"))).over(every)
    share = F.when(F.col("n") * m < 1, 1 / F.col("n")).when(k < F.col("capped"), m).otherwise((1 - F.col("capped") * m) * s / tail)
    rows = rows.withColumn("share", F.round(share, 4))
    left = F.round(1 - F.sum("share").over(every), 4)
    by_score = F.round(F.col("share") + F.when(F.col("position") == 1, left).otherwise(0.0), 4)
    weight = F.when(F.col("weighting_mode") == "score_weighted", by_score).otherwise(F.round(1 / F.col("n"), 4))
    return rows.withColumn("weight", weight).drop("s", "k", "rest", "capped", "share", "n")


def _told(holdings: DataFrame) -> DataFrame:
    """One row a request: its holdings in order, allocations by falling weight, and the summary with the top category."""
    mean = lambda c: F.round(F.sum(F.col(c) * F.col("weight")) / F.sum(F.when(F.col(c).isNotNull(), F.col("weight"))), 4).alias(f"avg_{c}")
    shown = F.transform(F.array_sort(F.collect_list(F.struct("position", "symbol", "category", "selection_score", "perception_score", "weight"))), lambda h: h.dropFields("position"))
    one = holdings.groupBy(*_KEY).agg(shown.alias("holdings"), F.count("*").alias("n"), F.count_distinct("category").alias("categories"), F.round(F.sum(F.col("weight") ** 2), 4).alias("hhi"), F.max("weight").alias("max_weight"), *[mean(c) for c in AVERAGED])
    by = holdings.groupBy(*_KEY, "category").agg(F.round(F.sum("weight"), 4).alias("weight"), F.count("*").alias("holdings"), F.round(F.avg("selection_score"), 4).alias("mean_score"), F.min("position").alias("first"))
    lists = by.groupBy(*_KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("less"), "first", F.struct("category", "weight", "holdings", "mean_score").alias("a")))), lambda x: x["a"]).alias("allocations"))
    one = one.join(lists, _KEY).withColumn("top_category", F.col("allocations")[0]["category"])
    return one.select(*_KEY, "holdings", "allocations", F.struct("n", "categories", "hhi", "max_weight", "top_category", *[f"avg_{c}" for c in AVERAGED]).alias("summary"))


def previews(companies: DataFrame, profiles: dict[str, Profile], axes: str | None = None, sentiments: dict[int, float] | None = None) -> DataFrame:
    """profile, matched (candidates left), warnings, holdings, allocations, summary, benchmark (the same of it), comparison.

    ``axes`` names a column of the companies with their axes (axis_id, score, exposure, confidence). Warnings are names:
    no_custom_esg_metrics, no_profitability_metrics, no_technical_metrics, ambiguous_universe, no_universe, few_categories (fewer than asked
    for among the candidates), fewer_holdings (strict limit), limit_relaxed. A profile without candidates has no holdings and
    null averages.
    """
    spark = companies.sparkSession
    asked = cut(requests(spark, profiles, sentiments))
    metrics = sorted({m for p in profiles.values() for m in p.bounds})
    there = companies.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)).alias(name) for name, c in ASKED.items()])
    # two rows for each profile, so the companies meet a small table
    passed = _narrow(companies, metrics, axes).join(F.broadcast(asked), _passes(metrics))
    rows = cut(_scored(passed))
    cells = rows.groupBy(*_KEY, "category").agg(F.count("*").alias("n")).groupBy(*_KEY).agg(F.sum("n").alias("matched"), F.count("*").alias("kinds"))
    holdings = cut(_weighted(_picked(rows, asked)))
    told = _told(holdings)
    over = holdings.groupBy(*_KEY).agg(F.count("*").alias("held"), F.coalesce(F.bool_or(F.col("phase") == 2), F.lit(False)).alias("relaxed"))
    one = asked.join(told, _KEY, "left").join(cells, _KEY, "left").join(over, _KEY, "left").crossJoin(F.broadcast(there))  # one row
    few = F.least("min_categories", "size") > F.coalesce("kinds", F.lit(0))
    short = F.coalesce("held", F.lit(0)) < F.col("size")
    marks = [F.when((F.col(f"{name}_mode") != "neutral") & ~F.col(name), f"no_{name}_metrics") for name in ASKED]
    marks += [F.when(F.array_contains("universes", "ambiguous"), "ambiguous_universe"), F.when(F.size("universes") == 0, "no_universe"), F.when(few, "few_categories"), F.when(short & F.col("strict"), "fewer_holdings"), F.when(~F.col("strict") & (F.col("relaxed") | short), "limit_relaxed")]
    one = one.select(*_KEY, F.coalesce("matched", F.lit(0)).alias("matched"), F.array_compact(F.array(*marks)).alias("warnings"), "holdings", "allocations", "summary")
    base = one.where("kind = 'base'").drop("kind")
    other = one.where("kind = 'benchmark'").select("profile", F.struct("holdings", "allocations", "summary").alias("benchmark"))
    both = base.join(other, "profile")
    symbols = lambda h: F.coalesce(h["symbol"], F.array().cast("array<string>"))
    overlap = F.size(F.array_intersect(symbols(F.col("holdings")), symbols(F.col("benchmark.holdings"))))
    delta = lambda c: F.round(F.col(f"summary.{c}") - F.col(f"benchmark.summary.{c}"), 4).alias(f"delta_{c}")
    compared = F.struct(overlap.alias("overlap"), F.round(F.coalesce(overlap / F.nullif(F.col("summary.n"), F.lit(0)), F.lit(0.0)), 4).alias("overlap_ratio"), delta("hhi"), *[delta(f"avg_{c}") for c in AVERAGED], (F.col("summary.categories") - F.col("benchmark.summary.categories")).alias("delta_categories"))
    return both.withColumn("comparison", compared)
