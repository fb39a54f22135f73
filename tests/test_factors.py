"""Topics by factorisation, positions, ranks and scans against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sieveline.operators import factors, ordering, series, statistics
from sieveline.plans import catalog


def plain_factors(rows, k, size, rounds, start):
    v = np.zeros((len(rows), size))
    for i, (_, terms, values) in enumerate(rows):
        v[i, terms] = values
    scale = np.sqrt(v.sum() / (len(rows) * size) / k)
    w, h = start(scale), factors._start(np.arange(size), k, scale).T
    losses = []
    for r in range(rounds):
        w = w * (v @ h.T) / (w @ h @ h.T + factors.LEAST)
        losses.append(((v - w @ h) ** 2).sum())
        if r < rounds - 1:
            h = h * (w.T @ v) / (w.T @ w @ h + factors.LEAST)
    return w, h, losses


@pytest.fixture(scope="module")
def fixture_rows():
    rng = random.Random(4)
    rows = []
    for i in range(130):
        topic = i % 3
        terms = sorted({rng.randrange(topic * 10, topic * 10 + 12) for _ in range(rng.randint(1, 9))})
        rows.append((i, terms, [rng.uniform(0.1, 1) for _ in terms]))
    return rows + [(7, [1, 2], [0.5, 0.5]), (900, list(range(32)), [0.1] * 32)]


def test_factors_equal_plain_updates(spark, fixture_rows, monkeypatch):
    monkeypatch.setattr(factors, "BLOCK_ROWS", 20)
    df = spark.createDataFrame(fixture_rows, "key long, terms array<int>, values array<double>")
    made = factors.factorise(df, 3, 32, rounds=25, tolerance=0)
    ids = {(r["key"], tuple(r["terms"])): r["id"] for r in df.withColumn("id", F.xxhash64("key", "terms")).collect()}
    own = np.array([ids[k, tuple(t)] for k, t, _ in fixture_rows], np.int64).view(np.uint64)
    w, h, losses = plain_factors(fixture_rows, 3, 32, 25, lambda s: factors._start(own, 3, s))
    assert np.allclose(made.losses, losses) and all(a > b for a, b in zip(losses, losses[1:]))
    assert np.allclose(made.terms, h)
    got = sorted((r["key"], tuple(np.round(r["weights"], 9))) for r in made.weights.collect())
    assert np.allclose([g[1] for g in got], [x[1] for x in sorted((r[0], tuple(np.round(x, 9))) for r, x in zip(fixture_rows, w))], atol=1e-7)
    shares = [r["shares"] for r in factors.topic_shares(made).collect()]
    assert len(shares) == len(fixture_rows) and np.allclose(np.sum(shares, 1), 1)
    # each planted topic has its own factor
    best = {r["key"]: r["dominant_topic_id"] for r in factors.top_topics(factors.topic_shares(made)).collect()}
    groups = [[best[i] for i in range(t, 130, 3)] for t in range(3)]
    assert len({max(set(g), key=g.count) for g in groups}) == 3


def test_factors_stop_by_their_error(spark, fixture_rows):
    df = spark.createDataFrame(fixture_rows, "key long, terms array<int>, values array<double>")
    made = factors.factorise(df, 3, 32, rounds=200, tolerance=1e-2)
    assert 2 < len(made.losses) < 60 and made.losses[-2] - made.losses[-1] < 1e-2 * made.losses[0] <= made.losses[-3] - made.losses[-2] + 1e9


@pytest.mark.parametrize("size, pairs", [(6, True), (40, True), (1000, True), (12, False)])
def test_terms_equal_plain_counts_and_shuffle_few_pairs(spark, monkeypatch, size, pairs):
    """Rows that share a key count together; rare words' pairs aren't told to anyone."""
    from collections import Counter
    from math import log

    monkeypatch.setattr(factors, "TOKENS", 37)
    rng = random.Random(size)
    rows = [(i // 2 if i < 20 else None if i < 23 else i, [f"w{min(rng.randrange(1, 30), rng.randrange(1, 60))}" for _ in range(rng.randrange(25))]) for i in range(120)] + [(500, []), (501, None), (502, [f"x{i}" for i in range(300)])]
    df = spark.createDataFrame(rows, "key long, w array<string>").repartition(3)
    own = {}
    for k, w in rows:
        own.setdefault(k, Counter()).update([*(w or []), *(f"{a} {b}" for a, b in zip(w or [], (w or [])[1:]) if pairs)])
    dfs, total = Counter(t for c in own.values() for t in c), sum(own.values(), Counter())
    kept = sorted(sorted((t for t in total if 3 <= dfs[t] <= 0.5 * len(rows)), key=lambda t: (-total[t], t))[:size])
    vocabulary = factors.fit_vocabulary(df, "key", F.col("w"), 3, 0.5, size, pairs)
    got = {r["term"]: (r["place"], r["df"]) for r in vocabulary.collect()}
    assert got == {t: (i, dfs[t]) for i, t in enumerate(kept)}
    want = {}
    for k, c in own.items():
        v = {t: (1 + log(c[t])) * (log((1 + len(rows)) / (1 + dfs[t])) + 1) for t in kept if c[t]}
        if v:
            want[k] = [(kept.index(t), x / sum(y * y for y in v.values()) ** 0.5) for t, x in v.items()]
    made = factors.weighted_terms(df, "key", F.col("w"), vocabulary, pairs).collect()
    assert sorted(map(str, want)) == sorted(str(r["key"]) for r in made)
    for r in made:
        assert r["terms"] == [t for t, _ in want[r["key"]]] and np.allclose(r["values"], [x for _, x in want[r["key"]]])
    rows_of = factors._parted(df, "key", F.col("w"))[0]
    some = spark.sparkContext.broadcast(pa.array(["w1", "w2"]))
    assert {r["term"] for r in factors._totals(rows_of, some).collect()} <= {"w1 w1", "w1 w2", "w2 w1", "w2 w2"}


def test_top_topics_ties_and_nothing(spark):
    rows = [(1, [0.5, 0.5, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [0.05, 0.9, 0.05])]
    got = {r["key"]: r for r in factors.top_topics(spark.createDataFrame(rows, "key long, shares array<double>")).collect()}
    assert [(t["topic_id"], t["weight"]) for t in got[1]["top_topics"]] == [(0, 0.5), (1, 0.5)] and got[2]["top_topics"] == []
    assert [(t["topic_id"], t["weight"]) for t in got[3]["top_topics"]] == [(1, 0.9)] and got[3]["dominant_topic_id"] == 1


def test_topic_queries(spark, sf_dir):
    rows = catalog.queries()["ml5_topics"](spark, sf_dir).collect()
    assert len(rows) > 900 and len({r["doc_id"] for r in rows}) == len(rows)
    assert all(t["weight"] >= 0.08 and 0 <= t["topic_id"] < 12 for r in rows for t in r["top_topics"])
    assert len({r["dominant_topic_id"] for r in rows}) > 6


def test_positions_and_mid_ranks_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.randint(0, 40) / 2, i) for i in range(4000)] + [(None, 1.5, -1), (None, None, -2), ("k1", None, -3)]
    df = spark.createDataFrame(rows, "key string, v double, i long").repartition(5)
    got = {(r["key"], r["i"]): r["p"] for r in ordering.positions(df, ["key"], ["v", "i"], "p").collect()}
    plain, ranks = {}, {}
    for k in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        plain |= {(k, r[2]): n for n, r in enumerate(own)}
        values = [r[1] for r in own if r[1] is not None]
        for r in own:
            less, same = sum(x < r[1] for x in values) if r[1] is not None else 0, values.count(r[1])
            ranks[k, r[2]] = None if r[1] is None else 50.0 if len(set(values)) == 1 else (less + same / 2) / len(values) * 100
    assert got == plain
    mid = {(r["key"], r["i"]): r["m"] for r in ordering.mid_ranks(df, ["key"], "v", "m").collect()}
    assert mid.keys() == ranks.keys() and all(mid[k] == ranks[k] or abs(mid[k] - ranks[k]) < 1e-9 for k in ranks)
    ranked = ordering.ranked_values(df, ["key"], "v")
    quart = {r["key"]: (r["a"], r["b"]) for r in ordering.quantiles(ranked, ["key"], "v", {"a": 0.1, "b": 0.77}).collect()}
    for k in quart:
        values = [r[1] for r in rows if r[0] == k and r[1] is not None]
        assert np.allclose(quart[k], np.quantile(values, [0.1, 0.77]))


def test_bounds_of_no_rows(spark):
    empty = statistics.metric_bounds(spark.createDataFrame([], "a double, b double"), ["a", "b"]).collect()
    assert len(empty) == 1 and set(empty[0]) == {None}


def test_long_series_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", 16)
    rng = random.Random(8)
    made = {"A": 700, "B": 33, "C": 16, "D": 1}
    rows = [(s, t, 50 + rng.gauss(0, 5)) for s, n in made.items() for t in range(n)] + [("E", t, 9.0 - t / 100) for t in range(40)] + [("B", 99, None)]
    got = {(r["symbol"], r["t"]): r for r in series.indicators(spark.createDataFrame(rows, "symbol string, t int, c double").repartition(4), ["t"]).collect()}
    assert len(got) == len(rows) - 1
    for s in [*made, "E"]:
        v = [c for k, _, c in rows if k == s and c is not None]
        e12 = e26 = signal = gain = loss = None
        for i, c in enumerate(v):
            e12, e26 = (c, c) if i == 0 else (e12 * 11 / 13 + c * 2 / 13, e26 * 25 / 27 + c * 2 / 27)
            signal = 0.0 if i == 0 else signal * 0.8 + (e12 - e26) * 0.2
            up, down = (max(v[i] - v[i - 1], 0), max(v[i - 1] - v[i], 0)) if i else (0, 0)
            gain, loss = (sum(max(v[j] - v[j - 1], 0) for j in range(1, i + 1)) / 14, sum(max(v[j - 1] - v[j], 0) for j in range(1, i + 1)) / 14) if i <= 14 else ((gain * 13 + up) / 14, (loss * 13 + down) / 14)
            want = (e12, e26, *((e12 - e26, signal, e12 - e26 - signal) if i >= 25 else (None,) * 3), None if i < 14 else 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss))
            r = got[s, i]
            have = [r[n] for n in ("ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi14")]
            assert all(a is None and b is None or abs(a - b) < 1e-8 for a, b in zip(have, want)), (s, i, have, want)
