"""Operators 11 to 13 against plain versions, on the test tables and on odd rows."""

import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieveline.llm import itemsets, lexical, queries, vectors
from sieveline.llm.tools import table

LINES = "sale_id long, item_id long, items string"


def plain_itemsets(rows, least=5, share=20_000, confidence=60):
    baskets = defaultdict(set)
    for s, i, *_ in rows:
        if s is not None and i is not None:
            baskets[s].add(i)
    total, support = len(baskets), {}
    enough = lambda n: n >= least and n * share >= total
    level = {frozenset([i]): {s for s, b in baskets.items() if i in b} for i in set().union(*baskets.values())} if baskets else {}
    level = {k: t for k, t in level.items() if enough(len(t))}
    single = dict(level)
    while level:
        support |= {k: len(t) for k, t in level.items()}
        level = {k | one: both for k, t in level.items() for one, u in single.items() if max(k) < max(one) and enough(len(both := t & u))}
    out = set()
    for k, n in support.items():
        if any(support.get(k | one) == n for one in single if not one <= k):
            continue
        found = [(c, support[k - {c}], support[frozenset([c])]) for c in sorted(k) if len(k) > 1]
        found = [r for r in found if 100 * n >= confidence * r[1] and n * total > r[1] * r[2]]
        best = min(found, key=lambda r: (r[1], r[0]))[0] if found else None
        out.add((",".join(map(str, sorted(k))), len(k), n, len(found), best, hashlib.sha256(";".join(f"{c}:{a}:{s}" for c, a, s in found).encode()).hexdigest()))
    return out


def rows_of(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("name", ["op11_itemsets", "op13_ranked_search"])
def test_queries_equal_their_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


def test_itemsets_equal_a_plain_search(spark, monkeypatch):
    """With long baskets set aside (one, several, as many as the minimum), items in all baskets, repeats and nulls."""
    rng = random.Random(5)
    monkeypatch.setattr(itemsets, "LIGHT", 4)
    for heavy, everywhere in ((1, False), (4, True), (9, False)):
        rows = [(s, i) for s in range(60) for i in rng.sample(range(12), rng.randint(1, 4))]
        rows += [(100 + h, i) for h in range(heavy) for i in range(0, 14) if rng.random() < 0.8]
        rows += [(s, i + 2) for s, i in rows[:30]] + rows[:10] + [(None, 1), (3, None), (None, None), (-5, -7)]
        if everywhere:
            rows += [(s, 40) for s in {s for s, _ in rows if s is not None}]
        df = spark.createDataFrame([(s, i, "clash") for s, i in rows], LINES)
        assert rows_of(itemsets.itemset_report(df, "sale_id", "item_id")) == plain_itemsets(rows)


def test_itemsets_of_deep_chains(spark):
    """All baskets alike, and one item after the other going: sets of up to eight items."""
    rows = [(s, i) for s in range(45) for i in range(min(8, 1 + s // 5))] + [(200, 0)]
    df = spark.createDataFrame([(*r, None) for r in rows], LINES)
    assert rows_of(itemsets.itemset_report(df, "sale_id", "item_id")) == plain_itemsets(rows)
    alike = [(s, i) for s in range(6) for i in range(5)]
    assert rows_of(itemsets.itemset_report(spark.createDataFrame([(*r, None) for r in alike], LINES), "sale_id", "item_id")) == plain_itemsets(alike)


def test_itemsets_of_nothing(spark):
    assert itemsets.itemset_report(spark.createDataFrame([], LINES), "sale_id", "item_id").count() == 0
    assert itemsets.itemset_report(spark.createDataFrame([(1, 2, None), (None, 2, None)], LINES), "sale_id", "item_id").count() == 0


def plain_neighbours(rows, k, every):
    own = {}
    for key, v in rows:
        if key is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            own.setdefault(key, []).append([float(np.float32(x)) for x in v])
    lengths = Counter(len(v) for vs in own.values() for v in vs)
    size = max(lengths, key=lambda n: (lengths[n], n)) if lengths else 0
    own = {key: min(v for v in vs if len(v) == size) for key, vs in own.items() if any(len(v) == size for v in vs)}
    out = {}
    for q, v in own.items():
        if q % every == 0:
            far = sorted((math.sqrt(sum((b - a) ** 2 for a, b in zip(v, w, strict=True))), key) for key, w in own.items() if key != q)
            out[q] = far[:k]
    return out


def found_of(df):
    got = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return dict(got)


def test_neighbours_recall_on_the_tables(spark, sf_dir):
    for folder in (sf_dir, sf_dir.replace("sf0.01", "sf0.1")):
        t = table(spark, folder, "embeddings")
        expected = plain_neighbours([(r[0], r[1]) for r in t.select("vec_id", "embedding").collect()], 10, 100)
        got = found_of(queries.op12_neighbours(spark, folder))
        assert got.keys() == expected.keys() and all(len(got[q]) == len(e) == 10 for q, e in expected.items())
        hits = sum(len({v for _, v in got[q]} & {v for _, v in e}) for q, e in expected.items())
        assert hits >= 0.9 * 10 * len(expected)


def test_neighbours_of_odd_rows_are_exact(spark, monkeypatch):
    """Hot vectors, ties, nulls, broken components, other lengths, repeated keys, lists in several blocks, a query that finds too few."""
    monkeypatch.setattr(vectors, "LIST_VECTORS", 16)
    monkeypatch.setattr(vectors, "BLOCK", 7)
    monkeypatch.setattr(vectors, "PRUNE", 100.0)  # all lists are read
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)]) for i in range(300)]
    rows += [(1000 + i, [1.0, 2.0, 1.0, 0.0]) for i in range(120)] + [(2000, [50.0, 50.0, 50.0, 50.0]), (2001, [51.0, 50.0, 50.0, 50.0])]
    rows += [(3000, None), (3001, [0.0] * 4), (3010, [1.0, None, 0.0, 0.0]), (3020, [float("nan")] * 4), (3030, [float("inf"), 0.0, 0.0, 0.0]), (3040, [1.0, 2.0]), (None, [1.0] * 4), (4, [9.0] * 4), rows[5], (-10, [1.0, 1.0, 1.0, -0.0])]
    df = spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<float>, list string, query int")
    got, expected = found_of(vectors.search(df, 10, 10)), plain_neighbours(rows, 10, 10)
    assert got.keys() == expected.keys()
    assert all([s for s, _ in got[q]] == [s for s, _ in e] for q, e in expected.items())
    assert got == expected


def test_neighbours_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert vectors.search(spark.createDataFrame([], schema)).count() == 0
    assert vectors.search(spark.createDataFrame([(100, [1.0])], schema)).count() == 0
    rows = [(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (200, [1.0, 0.0])]
    assert found_of(vectors.search(spark.createDataFrame(rows, schema))) == plain_neighbours(rows, 10, 100)


def test_walk_finds_the_nearest_centroids():
    points = np.random.Generator(np.random.PCG64(1)).normal(size=(4000, 16))
    graph = vectors.fit(points, 200)
    assert len(graph.centroids) == 200
    sizes = [len(x) for x in vectors._leaves(np.unique(points, axis=0), 200)]
    assert max(sizes) - min(sizes) <= 2
    ids, far = vectors.walk(graph, points[:300], 32)
    true = np.sqrt(((points[:300, None] - graph.centroids) ** 2).sum(2))
    assert np.allclose(np.take_along_axis(true, ids, 1), far)
    near = np.argsort(true, 1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(b)) / 8 for a, b in zip(ids, near, strict=True)]) > 0.95


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_ranking(docs, items, k=10):
    told = [(d, Counter(terms_of(t))) for d, t in docs]
    n, total = sum(bool(c) for _, c in told), sum(sum(c.values()) for _, c in told)
    df = Counter(t for _, c in told for t in c)
    out = {}
    for item in {i for i, _ in items if i is not None}:
        wanted = {t for i, x in items if i == item for t in terms_of(x)}
        scored = []
        for d, c in told:
            m = 10 + (90 * sum(c.values()) * n) // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)
            if score > 0 and d is not None:
                scored.append((-score, d))
        out |= {(item, r + 1): (d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])}
    return out


def ranking_of(df):
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in df.collect()}


def test_ranking_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 2000)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 25)
    rng = random.Random(3)
    words = ["alpha", "Beta", "GAMMA", "délta", "Ünit", "42", "x", "ÀB", "日本", "a_b", "mu", "nu", "xi", "pi", "rho"]
    text = lambda n: " ".join(rng.choice(words[: rng.randint(1, 15)]) for _ in range(n))
    docs = [(i * 7 - 50, text(rng.randint(1, 60))) for i in range(150)] + [(5, None), (6, ""), (8, "--- !!"), (None, "alpha beta"), (None, None), (13, text(50_000))]
    docs += [(900 + i, "alpha beta pi") for i in range(30)] + docs[:5]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(1, "pi rho"), (30, None), (31, ""), (32, "nowhere"), (None, "alpha"), (-3, "42 日本 délta")]
    made = lexical.search(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, term int").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert ranking_of(made) == plain_ranking(docs, items)


def test_ranking_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    assert lexical.search(docs, items).count() == lexical.search(some, items).count() == lexical.search(docs, some.toDF("item_id", "text")).count() == 0


@given(st.lists(st.integers(0, 2**63 - 1)))
@settings(max_examples=60, deadline=None)
def test_packed_numbers_come_back(values):
    assert lexical.unpacked(lexical.packed(np.array(values, np.int64))).tolist() == values


@given(st.lists(st.dictionaries(st.integers(0, 30), st.integers(1, 6), min_size=1), max_size=7), st.integers(1, 4))
@settings(max_examples=200, deadline=None)
def test_heap_merge_equals_sums(lists, k):
    made = [(sorted(x), [x[d] for d in sorted(x)], max(x.values())) for x in lists]
    tops = [sorted(x.values())[-k] if len(x) >= k else 0 for x in lists]
    sums = Counter()
    for x in lists:
        sums.update(x)
    expected = sorted(((s, -d) for d, s in sums.items()), reverse=True)[:k]
    assert sorted(lexical.best_of_shard(made, k, lexical._floor(made, tops)), reverse=True) == expected


def test_wide_beams_measure_all_centroids_at_once():
    points = np.random.Generator(np.random.PCG64(2)).normal(size=(12_000, 8))
    graph = vectors.fit(points, 1500)
    began = time.process_time()
    ids, far = vectors.walk(graph, points[:512], 750)
    assert time.process_time() - began < 10  # by the graph: over 20 s
    true = np.sqrt(((points[:512, None] - graph.centroids) ** 2).sum(2))
    assert np.allclose(np.sort(true, 1)[:, :750], far) and np.allclose(np.take_along_axis(true, ids, 1), far)


def test_a_query_is_sent_once_for_each_range(monkeypatch):
    points = np.random.Generator(np.random.PCG64(3)).normal(size=(3000, 8))
    graph = vectors.fit(points, 300)
    batch = pa.record_batch({"query": pa.array(range(700)), "vector": pa.array(points[:700].tolist(), pa.list_(pa.float64()))})
    for how in ((100.0, 8, 75), ()):
        rows = [r for b in vectors._listed([batch], graph, *how) for r in b.to_pylist()]
        assert [r["query"] for r in rows] == list(range(700))
        for r in rows:
            assert 0 < len({x["range"] for x in r["ranges"]}) == len(r["ranges"]) <= vectors.RANGES
            read = [at for x in r["ranges"] for at in x["lists"]]
            near = np.argsort(((points[r["query"]] - graph.centroids) ** 2).sum(1), kind="stable")[: how[2] if how else 300]
            assert sorted(read) == sorted(near.tolist())


def test_nearest_of_a_range_equals_plain(monkeypatch):
    """Rows in several lists, ties, lists of fewer than k, numbers that a product rounds off or can't hold, pairs compared in many parts."""
    rng = random.Random(4)
    for cells, pairs, shift, scale in ((1 << 17, 1 << 21, 0.0, 1.0), (40, 60, 0.0, 1.0), (40, 60, 1e7, 1.0), (64, 200, 0.0, 1e-170), (64, 200, 0.0, 1e160)):
        monkeypatch.setattr(vectors, "CELLS", cells)
        monkeypatch.setattr(vectors, "PAIRS", pairs)
        made = lambda n, m: [([shift + scale * rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)], rng.sample(range(9), rng.randint(1, m))) for _ in range(n)]  # noqa: B023, E731
        rows, asked = made(150, 4), made(40, 9)
        columns = lambda made, name, keys: {name: pa.array(keys), "vector": pa.array([v for v, _ in made]), "lists": pa.array([x for _, x in made], pa.list_(pa.int32()))}
        keys = rng.sample(range(1000), 150)
        table_of = pa.table(columns(rows, "first", keys) | {"ids": pa.array([[k] for k in keys], pa.list_(pa.int64()))})
        got = defaultdict(list)
        for r in vectors._nearest(table_of, pa.table(columns(asked, "query", list(range(40)))), 3, 7).to_pylist():
            got[r["query"]].append((r["score"], *r["ids"]))
        for i, (v, lists) in enumerate(asked):
            far = sorted((math.sqrt(sum((b - a) * (b - a) for a, b in zip(v, w, strict=True))), k) for k, (w, own) in zip(keys, rows, strict=True) if set(own) & set(lists))
            assert got[i] == far[:7]
