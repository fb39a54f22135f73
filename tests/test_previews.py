"""Whole previews of many profiles equal the single-profile operators, request by request."""

import dataclasses
import random

import pytest
from pyspark.sql import functions as F

from sieveline.operators import portfolio, previews

P, A = portfolio.Profile, portfolio.AxisPreference
PROFILES = {
    "plain": P(),
    "capped": P(custom_esg_mode="prefer_high", market_cap_mode="prefer_large", weighting_mode="score_weighted", max_holding_weight=0.105, min_posts=10),
    "strict": P(categories=("c1", "c2"), size=9, max_per_category=2, strict_category_limit=True, technical_mode="prefer_low"),
    "small": P(size=4, min_categories=1, max_per_category=0, weighting_mode="score_weighted", max_holding_weight=0.5, profitability_mode="neutral"),
    "bounded": P(bounds={"profitability_score": (40, None, False), "technical_score": (None, 80, True)}, min_posts=0, size=6),
    "missing out": P(bounds={"technical_score": (None, None, False)}, universes=("common_equity", "ambiguous")),
    "axes": P(axis_preferences=(A(1, "prefer_high", 0.8), A(2, "prefer_low", 0.4), A(3, "neutral", 0.5), A(9, "prefer_high", 1.0)), custom_esg_mode="prefer_high", perception_min=0.2),
    "nowhere": P(universes=()),
    "many categories": P(min_categories=12, size=20),
    "weights": P(weights=dict(zip(portfolio.COMPONENTS, (0, 0, 0, 1, 1, 0))), market_cap_mode="prefer_small"),
}
SENTIMENTS = {1: 0.5, 2: -0.8, 3: None}


@pytest.fixture(scope="module")
def companies(spark):
    rng = random.Random(9)
    maybe = lambda x: x if rng.random() > 0.2 else None
    rows = []
    for i in range(220):
        axes = [(k, maybe(rng.uniform(-5, 110)), maybe(rng.uniform(0, 1.2)), maybe(rng.random())) for k in range(1, 4) if rng.random() > 0.3]
        universe = rng.choice(["common_equity"] * 5 + ["reit", "ambiguous", "fund"])
        rows.append((f"S{i:03}", f"c{rng.choice('1112345678')}", universe, rng.randint(0, 60), maybe(10 ** rng.uniform(5, 12)), maybe(rng.randint(1, 50)), maybe(rng.uniform(0, 100)), maybe(rng.uniform(0, 100)), maybe(rng.uniform(0, 100)), axes))
    return spark.createDataFrame(rows, "symbol string, category string, instrument_universe string, posts_count int, market_cap_numeric double, rank_in_category int, custom_esg_proxy_score double, profitability_score double, technical_score double, axes array<struct<axis_id int, score double, exposure double, confidence double>>")


def single(companies, p):
    """Holdings by the operators for one profile."""
    axes = companies.select("symbol", F.inline("axes"))
    catalog = companies.sparkSession.createDataFrame([(k, float(v or 0)) for k, v in SENTIMENTS.items()], "axis_id int, average_sentiment double")
    return portfolio.preview(companies.drop("axes"), p, axes, catalog)


def test_previews_equal_single_ones(companies):
    got = {r["profile"]: r for r in previews.previews(companies, PROFILES, "axes", SENTIMENTS).collect()}
    assert got.keys() == PROFILES.keys()
    for name, p in PROFILES.items():
        r = got[name]
        for q, made in ((p, r), (portfolio.benchmark_profile(p), r["benchmark"])):
            want = single(companies, q).orderBy("position").collect()
            assert [(h["symbol"], h["category"], h["selection_score"], h["weight"]) for h in made["holdings"] or []] == [(h["symbol"], h["category"], h["selection_score"], h["weight"]) for h in want], name
            if not want:
                continue
            rows = companies.sparkSession.createDataFrame([h.asDict() for h in want], single(companies, q).schema)
            s = portfolio.summary(rows).first()
            assert [made["summary"][c] for c in ("n", "categories", "hhi", "max_weight", "avg_custom_esg_proxy_score", "avg_profitability_score", "avg_technical_score")] == [s[c] for c in ("holdings", "categories", "hhi", "max_weight", "avg_custom_esg_proxy_score", "avg_profitability_score", "avg_technical_score")]
            by = {a["category"]: (a["weight"], a["holdings"], a["mean_score"]) for a in portfolio.allocations(rows).collect()}
            assert {a["category"]: (a["weight"], a["holdings"], a["mean_score"]) for a in made["allocations"]} == by
            assert made["summary"]["top_category"] == made["allocations"][0]["category"] and by[made["summary"]["top_category"]][0] == max(v[0] for v in by.values())
        left = portfolio.scored(portfolio.candidates(companies, p), p, companies.select("symbol", F.inline("axes")), companies.sparkSession.createDataFrame([(k, float(v or 0)) for k, v in SENTIMENTS.items()], "axis_id int, average_sentiment double"))
        assert r["matched"] == left.count()
        own, other = {h["symbol"] for h in r["holdings"] or []}, {h["symbol"] for h in r["benchmark"]["holdings"] or []}
        assert r["comparison"]["overlap"] == len(own & other) and abs(r["comparison"]["overlap_ratio"] - (len(own & other) / len(own) if own else 0)) < 1e-4


def test_warnings(companies):
    bare = companies.withColumn("technical_score", F.lit(None).cast("double"))
    told = {r["profile"]: set(r["warnings"]) for r in previews.previews(bare, PROFILES, "axes", SENTIMENTS).collect()}
    assert told["plain"] == {"no_technical_metrics"} and "ambiguous_universe" in told["missing out"] and "no_universe" in told["nowhere"]
    assert "fewer_holdings" in told["strict"] and "few_categories" in told["many categories"] and "limit_relaxed" in told["many categories"]
    whole = {r["profile"]: r["warnings"] for r in previews.previews(companies, {"plain": P()}).collect()}
    assert whole == {"plain": []}


def test_previews_of_no_companies(companies):
    r = previews.previews(companies.limit(0), {"plain": P(), "other": dataclasses.replace(P(), size=3)}).collect()
    assert len(r) == 2 and all(x["matched"] == 0 and x["holdings"] is None and x["comparison"]["overlap"] == 0 for x in r)


def test_companies_are_scanned_once_for_all_requests(companies, tmp_path):
    companies.write.parquet(str(tmp_path / "c"))
    spark = companies.sparkSession
    asked = previews.requests(spark, PROFILES)
    plan = previews._scored(previews._narrow(spark.read.parquet(str(tmp_path / "c")), [], "axes").join(F.broadcast(asked), previews._passes([])))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan
