"""Density clusters of vectors (ML7): a hierarchy of mutual reachability over micro-clusters, outliers -1.

All rows are assigned to the nearest of at most ``MICRO`` seeds, vectors of the table itself picked by a hash of their id; a seed with its rows
is a micro-cluster, of which Spark gathers size, centre and spread over all rows. The hierarchy is built on those, so on a table of
a bounded size: core distances with sizes as weights, a minimum spanning tree of mutual reachability, the tree condensed to
clusters of at least ``least`` rows, and the clusters of most excess of mass. With no more distinct vectors than ``MICRO`` every
vector is its own micro-cluster and the result is that of all vectors; beyond that, rows nearer to each other than to other seeds
share one label. Rows far from dense micro-clusters are outliers with them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

MICRO = 3000


def core_distances(far: np.ndarray, sizes: np.ndarray, spread: np.ndarray, neighbours: int, dims: int) -> np.ndarray:
    """Distance within which a micro-cluster's centre has so many rows, itself included; within the micro-cluster, by its spread."""
    order = np.argsort(far, 1, kind="stable")
    counted = np.cumsum(sizes[order], 1)
    at = (counted >= min(neighbours, int(sizes.sum()))).argmax(1)
    outside = np.take_along_axis(far, order, 1)[np.arange(len(far)), at]
    inside = spread * (np.minimum(neighbours, sizes) / sizes) ** (1 / max(dims, 1))
    return np.where(at == 0, inside, outside)


def spanning_tree(weights: np.ndarray) -> np.ndarray:
    """Edges (a, b, weight) of a minimum spanning tree of a dense matrix, by ascending weight."""
    n = len(weights)
    best, of, left = weights[0].copy(), np.zeros(n, np.int64), np.ones(n, bool)
    left[0] = False
    edges = np.zeros((max(n - 1, 0), 3))
    for i in range(n - 1):
        b = int(np.argmin(np.where(left, best, np.inf)))
        edges[i], left[b] = (of[b], b, best[b]), False
        nearer = left & (weights[b] < best)
        best[nearer], of[nearer] = weights[b][nearer], b
    return edges[np.argsort(edges[:, 2], kind="stable")]


def condensed_labels(edges: np.ndarray, sizes: np.ndarray, cores: np.ndarray, least: int) -> np.ndarray:
    """A cluster for each vertex, or -1: of the tree of splits into two parts of ``least`` rows or more, the clusters of most excess of
    mass (the sum over their rows of the levels, 1 / distance, that they stay in), none of them the whole table."""
    n = len(sizes)
    rows, level = np.concatenate([sizes, np.zeros(n - 1, np.int64)]), np.concatenate([1 / np.maximum(cores, 1e-12), np.zeros(n - 1)])
    sides, parent = np.zeros((2 * n - 1, 2), np.int64), np.arange(2 * n - 1)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    for made, (a, b, w) in enumerate(edges, n):
        x, y = root(int(a)), root(int(b))
        parent[x] = parent[y] = made
        sides[made], rows[made], level[made] = (x, y), rows[x] + rows[y], 1 / max(w, 1e-12)
    above, born, mass = [-1], [0.0], [0.0]  # by cluster; the first one is the whole table
    inside = np.zeros(n, np.int64)  # each vertex's last cluster
    todo = [(2 * n - 2, 0, False)]
    while todo:
        node, c, gone = todo.pop()
        parts = [] if node < n else sides[node].tolist()
        large = [p for p in parts if rows[p] >= least]
        if node < n:
            inside[node] = c
        if not gone and len(large) != 1:  # the cluster ends here
            mass[c] += max(level[node] - born[c], 0.0) * rows[node]
        for p in parts:
            if gone or p not in large:
                if not gone and len(large) == 1:
                    mass[c] += (level[node] - born[c]) * rows[p]
                todo.append((p, c, True))
            elif len(large) == 2:
                above.append(c)
                born.append(level[node])
                mass.append(0.0)
                todo.append((p, len(above) - 1, False))
            else:
                todo.append((p, c, False))
    below, chosen = np.zeros(len(above)), np.zeros(len(above), bool)
    for c in range(len(above) - 1, 0, -1):
        chosen[c] = mass[c] >= below[c]
        below[above[c]] += max(mass[c], below[c])
    label = np.full(len(above), -1)
    for c in range(1, len(above)):  # a cluster within a chosen one is part of it
        label[c] = label[above[c]] if label[above[c]] >= 0 else c if chosen[c] else -1
    names = {c: i for i, c in enumerate(np.unique(label[label >= 0]))}
    return np.array([names.get(label[c], -1) for c in inside])


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def micro_clusters(vectors: DataFrame, key: str, vector: str, most: int = MICRO) -> tuple[DataFrame, np.ndarray]:
    """(key, micro, distance) of every row, and the seeds: at most ``most`` distinct vectors, all of them if there are no more."""
    spark = vectors.sparkSession
    distinct = cut(vectors.select(F.col(vector).alias("v")).distinct().withColumn("h", F.xxhash64("v")))
    n = distinct.count()
    share = 1 << 40
    drawn = distinct if n <= most else distinct.where(F.pmod("h", F.lit(share)) < int(0.95 * most / n * share))
    found = drawn.limit(2 * most).select("v", "h").toArrow().sort_by("h")  # about 0.95 of ``most``, which is far from twice as many
    seeds = _matrix(found["v"].combine_chunks()) if found.num_rows else np.zeros((0, 0))
    shared = spark.sparkContext.broadcast(seeds)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                far = _far(_matrix(part.column(1)), shared.value)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(near), pa.array(far[np.arange(len(far)), near])], ["key", "micro", "distance"])

    kind = vectors.schema[key].dataType.simpleString()
    return cut(vectors.select(key, F.col(vector).cast("array<double>")).mapInArrow(assign, f"key {kind}, micro long, distance double")), seeds


def density_clusters(vectors: DataFrame, key: str = "doc_id", vector: str = "vector", least: int = 8, neighbours: int | None = None, most: int = MICRO) -> DataFrame:
    """key, topic_id (-1 for outliers) of rows with a vector; vectors have one length and finite components. ``neighbours`` (``least`` by
    default) sets core distances. Clusters are numbered from 0. Fewer rows than ``least`` are outliers."""
    vectors = vectors.where(F.col(vector).isNotNull())
    rows, seeds = micro_clusters(vectors, key, vector, most)
    told = rows.groupBy("micro").agg(F.count("*").alias("n"), F.avg("distance").alias("spread")).orderBy("micro").collect()  # ``most`` rows
    if sum(r["n"] for r in told) < 2:
        return rows.select(F.col("key").alias(key), F.lit(-1).alias("topic_id"))
    sizes, spread = np.array([r["n"] for r in told], np.int64), np.array([r["spread"] for r in told])
    far = _far(own := seeds[[r["micro"] for r in told]], own)
    np.fill_diagonal(far, 0)
    cores = core_distances(far, sizes, spread, neighbours or least, seeds.shape[1])
    reach = np.maximum(far, np.maximum(cores[:, None], cores[None]))
    labels = condensed_labels(spanning_tree(reach), sizes, cores, least).tolist() if len(told) > 1 else [-1]
    names = vectors.sparkSession.createDataFrame([(r["micro"], int(x)) for r, x in zip(told, labels, strict=True)], "micro long, topic_id int")
    return rows.join(F.broadcast(names), "micro").select(F.col("key").alias(key), "topic_id")
