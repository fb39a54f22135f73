"""Clusters of axes with labels (ML8): k-means for every number of clusters at once, the number chosen by silhouette.

Each round is one pass over the vectors for all numbers of clusters together: a task assigns its rows and adds up, for each cluster, its rows,
their sum and their squares. Those sums are all that leaves the tasks (one row a cluster), and the silhouettes follow from them in one last
pass: with squared distances the mean distance of a row to a cluster needs nothing but the cluster's sums.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import factors
from .lineage import cut

TERMS = 200
SEEDS = 512
ROUNDS = 50


class Sweep(NamedTuple):
    best: int  # number of clusters
    centres: dict[int, np.ndarray]
    scores: dict[int, float]  # silhouette by number of clusters


def _dense(b: pa.RecordBatch, size: int) -> np.ndarray:
    """Rows of (terms, values) as a matrix."""
    out = np.zeros((b.num_rows, size))
    lengths = np.diff(b.column("terms").offsets.to_numpy())
    out[np.repeat(np.arange(b.num_rows), lengths), b.column("terms").flatten().to_numpy()] = b.column("values").flatten().to_numpy()
    return out


def _far(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1), 0)


def _first_centres(rows: DataFrame, size: int, k: int) -> np.ndarray:
    """k starting points, each the farthest from those before among up to about SEEDS rows picked by hash (ties by key); the first is the longest."""
    n = rows.count()
    share = 1 << 40
    some = rows.where(F.pmod(F.xxhash64("key"), F.lit(share)) < int(min(1.0, SEEDS / max(n, 1)) * share)).orderBy("key").toArrow()
    x = np.concatenate([_dense(b, size) for b in some.to_batches()]) if some.num_rows else np.zeros((0, size))
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    at = [int(np.argmax((x**2).sum(1)))] if len(x) else []
    while 0 < len(at) < min(k, len(x)):
        at.append(int(np.argmax(_far(x, x[at]).min(1))))
    return x[at]


def _pass(rows: DataFrame, size: int, centres: dict[int, np.ndarray], stats: dict[int, tuple] | None = None) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]:
    """For each number of clusters: rows, sums and squares of its clusters, and with ``stats`` (those of a last pass) the sum of silhouettes."""
    shared = rows.sparkSession.sparkContext.broadcast((centres, stats))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, stats = shared.value
        made = {k: [np.zeros(len(c)), np.zeros((len(c), size)), np.zeros(len(c)), 0.0] for k, c in centres.items()}
        for b in batches:
            x = _dense(b, size)
            squares = (x**2).sum(1)
            for k, c in centres.items():
                own = _far(x, c).argmin(1)
                np.add.at(made[k][0], own, 1)
                np.add.at(made[k][1], own, x)
                np.add.at(made[k][2], own, squares)
                if stats is not None:
                    made[k][3] += _silhouettes(x, squares, own, *stats[k]).sum()
        keys = [(k, c) for k in made for c in range(len(centres[k]))]
        columns = [pa.array([k for k, _ in keys], pa.int32()), pa.array([c for _, c in keys], pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([np.concatenate([[made[k][0][c], made[k][2][c], made[k][3] if c == 0 else 0.0], made[k][1][c]]).tolist() for k, c in keys], pa.list_(pa.float64()))], ["k", "c", "part"])

    parts = rows.select("terms", "values").mapInArrow(run, "k int, c int, part array<double>")
    summed = parts.groupBy("k", "c").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(size + 3)]).alias("part")).collect()  # one row a cluster
    out = {}
    for k, c in centres.items():
        by = np.zeros((len(c), size + 3))
        for r in summed:
            if r["k"] == k:
                by[r["c"]] = r["part"]
        out[k] = by[:, 0], by[:, 3:], by[:, 1], float(by[:, 2].sum())
    return out


def _silhouettes(x: np.ndarray, squares: np.ndarray, own: np.ndarray, n: np.ndarray, sums: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Silhouette of each row by squared distances: 0 in a cluster of one row."""
    safe = np.maximum(n, 1)
    mean = squares[:, None] - 2 * x @ (sums / safe[:, None]).T + total / safe
    at = np.arange(len(x))
    inside = mean[at, own] * n[own] / np.maximum(n[own] - 1, 1)  # a row isn't counted with itself
    mean[at, own] = np.inf
    mean[:, n == 0] = np.inf
    other = mean.min(1) if len(n) > 1 else np.full(len(x), np.inf)
    top = np.maximum(inside, other)
    good = (n[own] > 1) & np.isfinite(other) & (top > 0)
    return np.where(good, (other - inside) / np.where(good, top, 1), 0.0)


def sweep(rows: DataFrame, size: int, low: int, high: int) -> Sweep:
    """Centres for every number of clusters from ``low`` to ``high`` and the best of them (the smaller one of equals) for (key, terms, values)."""
    first = _first_centres(rows, size, high)
    centres = {k: first[:k] for k in range(low, high + 1) if k <= len(first)} or {len(first): first}
    for _ in range(ROUNDS):
        made = _pass(rows, size, centres)
        new = {k: np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[k]) for k, (n, sums, _, _) in made.items()}
        still = all(np.allclose(new[k], centres[k], atol=1e-12) for k in centres)
        centres = new
        if still:
            break
    stats = {k: v[:3] for k, v in _pass(rows, size, centres).items()}
    last = _pass(rows, size, centres, stats)
    scores = {k: v[3] / max(v[0].sum(), 1) for k, v in last.items()}
    return Sweep(min(scores, key=lambda k: (-round(scores[k], 12), k)), centres, scores)


def cluster_axes(axes: DataFrame, tokens: Column, low: int = 6, high: int = 12) -> DataFrame:
    """axis_id, cluster_id, cluster_label from the words of axes: label terms are the three of most weight in the cluster's centre.

    Under ``low`` axes are one cluster, "general". An axis without a known word is at the origin and joins the nearest centre.
    """
    n = axes.count()
    if n < low:
        return axes.select("axis_id", F.lit(0).alias("cluster_id"), F.lit("general").alias("cluster_label"))
    vocabulary = factors.fit_vocabulary(axes, "axis_id", tokens, 1, 1.0, TERMS, pairs=False)
    size = vocabulary.count()
    known = factors.weighted_terms(axes, "axis_id", tokens, vocabulary, pairs=False, sublinear=False)
    none = lambda t: F.array().cast(f"array<{t}>")
    rows = cut(axes.select(F.col("axis_id").alias("key")).join(known, "key", "left").select("key", F.coalesce("terms", none("int")).alias("terms"), F.coalesce("values", none("double")).alias("values")))
    made = sweep(rows, size, low, min(high, n - 1))
    centres = made.centres[made.best]
    shared = axes.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = _far(_dense(b, size), shared.value).argmin(1) if len(shared.value) else np.zeros(b.num_rows, int)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(near, pa.int32())], ["axis_id", "cluster_id"])

    kind = dict(rows.dtypes)["key"]
    words = {r["place"]: r["term"] for r in vocabulary.select("place", "term").collect()}  # TERMS rows at most
    labels = [(i, " / ".join(words[int(p)] for p in np.lexsort((np.arange(size), -c))[:3])) for i, c in enumerate(centres)] or [(0, "general")]
    named = axes.sparkSession.createDataFrame(labels, "cluster_id int, cluster_label string")
    return rows.mapInArrow(assign, f"axis_id {kind}, cluster_id int").join(F.broadcast(named), "cluster_id").select("axis_id", "cluster_id", "cluster_label")
