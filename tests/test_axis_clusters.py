"""The sweep over numbers of clusters against a plain k-means and plain silhouettes, and labels."""

import random

import numpy as np
from pyspark.sql import functions as F

from sieveline.operators import axis_clusters


def plain_sweep(x, low, high):
    _, at = np.unique(x, axis=0, return_index=True)
    seeds = x[np.sort(at)]
    far = lambda a, c: ((a[:, None] - c) ** 2).sum(2)
    chosen = [int(np.argmax((seeds**2).sum(1)))]
    while len(chosen) < high:
        chosen.append(int(np.argmax(far(seeds, seeds[chosen]).min(1))))
    out = {}
    for k in range(low, high + 1):
        c = seeds[chosen[:k]].copy()
        for _ in range(50):
            own = far(x, c).argmin(1)
            new = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(k)])
            if np.allclose(new, c, atol=1e-12):
                break
            c = new
        own, d = far(x, c).argmin(1), far(x, x)
        s = []
        for i in range(len(x)):
            mine = [j for j in range(len(x)) if own[j] == own[i] and j != i]
            a = d[i, mine].mean() if mine else 0
            b = min(d[i, own == g].mean() for g in set(own) if g != own[i])
            s.append((b - a) / max(a, b) if mine and max(a, b) > 0 else 0)
        out[k] = float(np.mean(s)), own
    return out


def test_sweep_equals_a_plain_one(spark):
    rng = random.Random(11)
    rows = [(i, sorted(rng.sample(range((i % 4) * 6, (i % 4) * 6 + 8), 3)), [rng.uniform(0.2, 1) for _ in range(3)]) for i in range(90)]
    x = np.zeros((90, 30))
    for i, t, v in rows:
        x[i, t] = v
    df = spark.createDataFrame(rows, "key long, terms array<int>, values array<double>").repartition(3)
    made, plain = axis_clusters.sweep(df, 30, 3, 7), plain_sweep(x, 3, 7)
    assert made.scores.keys() == plain.keys() and all(abs(made.scores[k] - plain[k][0]) < 1e-9 for k in plain)
    assert made.best == max(plain, key=lambda k: plain[k][0])
    for k, (_, own) in plain.items():
        assert (((x[:, None] - made.centres[k]) ** 2).sum(2).argmin(1) == own).all()


def test_clusters_have_their_terms_as_labels(spark):
    themes = [["coal", "gas", "oil"], ["bank", "loan", "rate"], ["gene", "drug", "cell"]]
    rng = random.Random(2)
    rows = [(i, rng.choices(themes[i % 3], k=6)) for i in range(60)] + [(100, []), (101, None)]
    df = spark.createDataFrame(rows, "axis_id long, w array<string>")
    got = {r["axis_id"]: (r["cluster_id"], r["cluster_label"]) for r in axis_clusters.cluster_axes(df, F.coalesce("w", F.array().cast("array<string>")), 3, 5).collect()}
    assert len(got) == 62
    for t, words in enumerate(themes):
        assert all(set(got[i][1].split(" / ")) <= set(words) for i in range(t, 60, 3))
    few = axis_clusters.cluster_axes(df.limit(4), F.col("w")).collect()
    assert {(r["cluster_id"], r["cluster_label"]) for r in few} == {(0, "general")}
    alike = spark.createDataFrame([(i, ["same"]) for i in range(9)], "axis_id long, w array<string>")
    assert {r["cluster_label"] for r in axis_clusters.cluster_axes(alike, F.col("w")).collect()} == {"same"}
    assert axis_clusters.cluster_axes(df.limit(0), F.col("w")).count() == 0


def test_query_gives_every_axis_a_cluster(spark, sf_dir):
    from sieveline.plans import catalog

    rows = catalog.queries()["ml8_axis_clusters"](spark, sf_dir).collect()
    assert len(rows) == len({r["axis_id"] for r in rows}) == 2000 and 6 <= len({r["cluster_id"] for r in rows}) <= 12
