"""Density clusters against a plain version that splits the whole graph level by level."""

import collections
import random

import numpy as np
import pytest

from sieveline.operators import density


def plain_clusters(points, least):
    """Mutual reachability of all points; clusters by removing edges above one distance after the other, from the greatest one down."""
    x = np.array(points, float)
    far = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = np.sort(far, 1)[:, least - 1]
    reach = np.maximum(far, np.maximum(core[:, None], core))
    n = len(x)

    def parts(members, below):
        left, out = set(members), []
        while left:
            todo, seen = [left.pop()], []
            while todo:
                v = todo.pop()
                seen.append(v)
                near = [u for u in left if reach[v, u] < below]
                left.difference_update(near)
                todo += near
            out.append(sorted(seen))
        return out

    def grow(members, born):
        """mass and chosen clusters of the cluster that begins as ``members``."""
        mass, now = 0.0, members
        while True:
            inside = reach[np.ix_(now, now)]
            levels = np.unique(inside[np.triu_indices(len(now), 1)])
            # the greatest distance at which the cluster still hangs together
            cut = next(w for w in levels[::-1] if len(parts(now, w)) > 1)
            split = parts(now, cut)
            large = [p for p in split if len(p) >= least]
            lam = 1 / cut
            if len(large) == 1:
                mass += (lam - born) * (len(now) - len(large[0]))
                now = large[0]
                continue
            mass += (lam - born) * len(now)
            if not large:
                return mass, [members]
            made = [grow(p, lam) for p in large]
            return max(((mass, [members]), (sum(m for m, _ in made), sum((c for _, c in made), []))), key=lambda t: (t[0], len(t[1]) == 1))

    now, labels = list(range(n)), [-1] * n
    while True:
        inside = reach[np.ix_(now, now)]
        cut = next(w for w in np.unique(inside[np.triu_indices(len(now), 1)])[::-1] if len(parts(now, w)) > 1)
        large = [p for p in parts(now, cut) if len(p) >= least]
        if len(large) != 1:
            break
        now = large[0]
    for i, c in enumerate(c for p in large for c in grow(p, 1 / cut)[1]):
        for v in c:
            labels[v] = i
    return labels


def same_partition(a, b):
    both = collections.defaultdict(set)
    for x, y in zip(a, b):
        both[x].add(y)
    return all(len(v) == 1 for v in both.values()) and len({next(iter(v)) for v in both.values()}) == len(both) and both.get(-1, {-1}) == {-1}


def blobs(n, seed):
    rng = random.Random(seed)
    centres = [(0, 0, 0), (6, 0, 0), (0, 7, 0), (6.5, 1.8, 0)]
    return [[c + rng.gauss(0, 0.35 + 0.2 * (i % 4)) for c in centres[i % 4]] if i % 9 else [rng.uniform(-4, 11) for _ in range(3)] for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_a_plain_version(spark, seed):
    points = blobs(160, seed)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "doc_id long, vector array<double>").repartition(3)
    got = {r["doc_id"]: r["topic_id"] for r in density.density_clusters(df).collect()}
    plain = plain_clusters(points, 8)
    assert len(set(plain)) > 3 and same_partition([got[i] for i in range(len(points))], plain)


def test_micro_clusters_find_the_same_groups(spark):
    """With a fifth as many micro-clusters as rows, rows of one blob share a label and blobs differ."""
    rng = random.Random(5)
    points = [[c + rng.gauss(0, 0.3) for c in ((0, 0), (8, 0), (0, 9))[i % 3]] for i in range(1500)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(points)], "doc_id long, vector array<float>")
    got = {r["doc_id"]: r["topic_id"] for r in density.density_clusters(df, least=40, most=300).collect()}
    assert len(got) == 1500
    best = [collections.Counter(got[i] for i in range(t, 1500, 3)).most_common(1)[0] for t in range(3)]
    assert len({b[0] for b in best}) == 3 and -1 not in {b[0] for b in best} and all(b[1] > 400 for b in best)


def test_clusters_of_copies_and_of_few_rows(spark):
    schema = "doc_id long, vector array<double>"
    assert density.density_clusters(spark.createDataFrame([], schema)).count() == 0
    assert [r["topic_id"] for r in density.density_clusters(spark.createDataFrame([(1, [0.0]), (2, None)], schema)).collect()] == [-1]
    rows = [(i, [float(i % 2) * 9, 0.0]) for i in range(40)] + [(100, [4.0, 60.0])]
    got = {r["doc_id"]: r["topic_id"] for r in density.density_clusters(spark.createDataFrame(rows, schema)).collect()}
    assert got[100] == -1 and got[0] != got[1] and {got[i] for i in range(0, 40, 2)} == {got[0]} and -1 not in (got[0], got[1])


def test_spanning_tree_is_minimal():
    rng = np.random.Generator(np.random.PCG64(3))
    w = rng.random((40, 40))
    w = w + w.T
    tree = density.spanning_tree(w)
    of = list(range(40))
    total = 0.0
    for a, b in sorted(((a, b) for a in range(40) for b in range(a)), key=lambda e: w[e]):
        if of[a] != of[b]:
            total += w[a, b]
            of = [of[b] if x == of[a] else x for x in of]
    assert len(tree) == 39 and abs(tree[:, 2].sum() - total) < 1e-9
