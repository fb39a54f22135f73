"""Nearest neighbours over balanced posting lists.

Centroids come from a sample of at most about ``SAMPLE`` vectors (by a hash of vec_id), cut in two again and again at the median between two
means, so that all leaves hold the same number. Every vector is then put into the list of its nearest centroid and, near a boundary,
of up to ``COPIES`` centroids that are at most ``BOUNDARY`` times as far. Centroids are found by a beam walk over a graph in memory that links
each of them to its nearest ones; a beam that would hold a quarter of them or more meets nearly all, so there all are measured at once, without
the walk. A query reads the lists whose centroids are at most ``PRUNE`` times as far as its nearest one: at least
``LEAST_LISTS``, at most ``MOST_LISTS`` or a quarter of all lists, whichever is more. (Where vectors lie alike in all directions nearly all
distances are about equal and the ratio prunes nothing; a number of lists that doesn't grow with them would lose recall then.) In a list a matrix product finds
what can be among the k nearest, with its rounding allowed for; distances of these are exact, in double precision, one dimension after the other.

Size. Centroids are at most ``MOST_CENTROIDS``, which bounds what is broadcast and what the driver holds. Lists that follow one another lie near
each other; at most ``RANGES`` ranges of them are what is dealt to tasks, so a query is sent once for each range, not for each list, and k rows come back
from there. A range of more than ``BLOCK`` vectors (or of ``BLOCK_VALUES`` components), or that is read by as many queries, is dealt in blocks (parts),
so no task holds a whole range. Equal vectors are one entry with
their k + 1 least vec_ids, taken before the shuffle by a partial limit, and equal queries are one query, so a vector that a third of all
rows share is searched once. A query that finds less than k neighbours reads all lists.

Rows. Vectors that are null, zero, or hold null or non-finite components, rows without vec_id, and vectors of another length than
the commonest one (the longest of those equally common) take no part. Of rows that repeat a vec_id the least vector counts (compared
as an array). Ties go to the smaller vec_id. Further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tools import cut, small

SAMPLE = 65_536
LIST_VECTORS = 128
MOST_CENTROIDS = 8192
COPIES = 4
BOUNDARY = 1.15
PRUNE = 1.35
LEAST_LISTS = 8
MOST_LISTS = 64
MOST_SHARE = 4
LINKS = 24
RANGES = 64
BLOCK = 32_768
BLOCK_VALUES = 1 << 21
CELLS = 1 << 17
PAIRS = 1 << 21


class Graph(NamedTuple):
    centroids: np.ndarray
    links: np.ndarray
    entries: np.ndarray


def _leaves(points: np.ndarray, lists: int) -> list[np.ndarray]:
    """Parts of ``points`` (indices) of about equal size: halves on either side of the median between two means."""
    made, todo = [], [(np.arange(len(points)), lists)]
    while todo:
        at, n = todo.pop()
        if n <= 1 or len(at) < 2:
            made.append(at)
            continue
        own = points[at]
        axis = own[np.argmax(((own - own.mean(0)) ** 2).sum(1))]
        other = own[np.argmax(((own - axis) ** 2).sum(1))]
        share = n // 2 * len(at) // n
        for _ in range(6):
            side = np.argsort(own @ (other - axis), kind="stable")
            axis, other = own[side[:share]].mean(0), own[side[share:]].mean(0)
        todo += [(at[side[:share]], n // 2), (at[side[share:]], n - n // 2)]
    return [m for m in made if len(m)]


def fit(sample: np.ndarray, lists: int) -> Graph:
    """Centroids of balanced leaves and the graph of their nearest ones, which is also linked along the order of the leaves."""
    points = np.unique(sample, axis=0)
    centroids = np.array([points[m].mean(0) for m in _leaves(points, lists)]) if len(points) else np.zeros((0, sample.shape[1]))
    n = len(centroids)
    near = min(LINKS, max(n - 1, 1))
    links = np.zeros((n, near + 2), np.int64)
    norms = (centroids**2).sum(1)
    for a in range(0, n, 512):
        d = norms[a : a + 512, None] - 2 * centroids[a : a + 512] @ centroids.T + norms
        d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
        links[a : a + 512, :near] = np.argsort(d, 1, kind="stable")[:, :near]
    links[:, near], links[:, near + 1] = (np.arange(n) + 1) % max(n, 1), (np.arange(n) - 1) % max(n, 1)
    for k in range(1, near + 2):  # a link that is there already leads back to the centroid itself
        twice = (links[:, :k] == links[:, k, None]).any(1)
        links[twice, k] = np.flatnonzero(twice)
    return Graph(centroids, links, np.unique(np.linspace(0, max(n - 1, 0), min(n, 32)).astype(np.int64)))


def walk(graph: Graph, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` nearest centroids of each query, as found by walking the graph best first, and their distances, nearest first."""
    n, m = len(graph.centroids), len(queries)
    width = min(width, n)
    norms, own = (graph.centroids**2).sum(1), (queries**2).sum(1)
    if 4 * width >= n:
        d = own[:, None] - 2 * queries @ graph.centroids.T + norms
        ids = np.argsort(d, 1, kind="stable")[:, :width]
        return ids, np.sqrt(np.maximum(np.take_along_axis(d, ids, 1), 0))
    seen = np.zeros((m, n), bool)
    ids, far = np.zeros((m, width), np.int64), np.full((m, width), np.inf)
    opened = np.ones((m, width), bool)

    def meet(rows: np.ndarray, new: np.ndarray) -> None:
        d = own[rows, None] - 2 * np.matmul(graph.centroids.take(new, 0), queries[rows, :, None])[:, :, 0] + norms[new]
        d[seen[rows[:, None], new]] = np.inf
        seen[rows[:, None], new] = True
        all_ids, all_far = np.concatenate([ids[rows], new], 1), np.concatenate([far[rows], d], 1)
        all_opened = np.concatenate([opened[rows], ~np.isfinite(d)], 1)
        best = np.argsort(all_far, 1, kind="stable")[:, :width]
        ids[rows], far[rows], opened[rows] = (np.take_along_axis(x, best, 1) for x in (all_ids, all_far, all_opened))

    if m and n:
        meet(np.arange(m), np.repeat(graph.entries[None], m, 0))
    while True:
        rows = np.flatnonzero((~opened).any(1))
        if not len(rows):
            return ids, np.sqrt(np.maximum(far, 0))
        at = np.argmin(np.where(opened[rows], np.inf, far[rows]), 1)
        opened[rows, at] = True
        meet(rows, graph.links[ids[rows, at]])


def _chosen(graph: Graph, vectors: np.ndarray, ratio: float, least: int, most: int) -> np.ndarray:
    """(row, list) of each vector's lists: those of the nearest centroids, at most ``ratio`` times as far as the nearest one."""
    ids, far = walk(graph, vectors, max(2 * most, 16))
    at = np.arange(far.shape[1])
    keep = np.isfinite(far) & ((far <= ratio * far[:, :1]) | (at < least)) & (at < most)
    return np.stack([np.nonzero(keep)[0], ids[keep]], 1)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _listed(batches: Iterable[pa.RecordBatch], graph: Graph, *how: float) -> Iterator[pa.RecordBatch]:
    """Rows with their lists by range; all lists where ``how`` isn't given."""
    n = len(graph.centroids)
    per = -(-n // RANGES)
    for b in small(batches):
        m = b.num_rows if n else 0
        if how and m:
            read = _chosen(graph, _matrix(b.column("vector"), graph.centroids.shape[1]), *how)
        else:
            read = np.stack([np.repeat(np.arange(m), n), np.tile(np.arange(n), m)], 1)
        row, at = read[np.lexsort((read[:, 1], read[:, 0]))].T
        place = at // max(per, 1)
        starts = np.flatnonzero(np.diff(row, prepend=-1) | np.diff(place, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(at, pa.int32()))
        ranges = pa.StructArray.from_arrays([pa.array(place[starts], pa.int32()), lists], ["range", "lists"])
        yield b.append_column("ranges", pa.ListArray.from_arrays(pa.array(np.searchsorted(row[starts], np.arange(b.num_rows + 1)), pa.int32()), ranges))


def _by_list(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(list, row), ordered by list."""
    lists = rows["lists"].combine_chunks()
    at, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(at, kind="stable")
    return at[order], row[order]


def _bounds(asked: np.ndarray, far: np.ndarray, n: int, place: int) -> np.ndarray:
    """For each of n queries what the ``place``-th least of its squared distances isn't above; infinite where there are fewer."""
    keys = np.sort((asked.astype(np.uint64) << np.uint64(32)) | np.maximum(far, 0).astype(np.float32).view(np.uint32))
    starts = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    enough = np.flatnonzero(np.diff(starts) >= place)
    least = keys[starts[enough] + place - 1].astype(np.uint32).view(np.float32).astype(np.float64)
    out = np.full(n, np.inf)
    out[enough] = np.where(np.isnan(least), np.inf, least * (1 + 2**-20) + 1e-37)  # as the keys are rounded to single precision
    return out


def _nearest(rows: pa.Table, queries: pa.Table, size: int, k: int) -> pa.Table:
    """The k nearest rows of each query in the lists that it reads in one block of a range."""
    v, q = _matrix(rows["vector"].combine_chunks(), size), _matrix(queries["vector"].combine_chunks(), size)
    first, ids = rows["first"].to_numpy(), rows["ids"].combine_chunks()
    lists, member = _by_list(rows)
    read, reader = _by_list(queries)
    copies = np.bincount(member, minlength=1).max()
    norms, own = (v**2).sum(1), (q**2).sum(1)
    slack = 64 * (size + 8) * np.finfo(np.float64).eps * (own + norms.max(initial=0)) + np.finfo(np.float64).tiny  # rounding of a product
    bound = np.full(len(q), np.inf)
    none = np.zeros(0, np.int64)

    def best(pairs: list[np.ndarray], far: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs (query times len(v) plus row) and their rough squared distances each query's k nearest, nearest first, and exact distances."""
        pair, rough = np.concatenate([none, *pairs]), np.concatenate([np.zeros(0), *far])
        for again in (copies, 1):  # first a row may count once for each of its lists
            asked = pair // max(len(v), 1)
            bound[:] = np.minimum(bound, _bounds(asked, rough, len(q), (k - 1) * again + 1) + slack)
            near = ~(rough > bound[asked])
            pair, at = np.unique(pair[near], return_index=True)
            rough = rough[near][at]
        asked, row = np.divmod(pair, max(len(v), 1))
        d = np.zeros(len(pair))
        for dim in range(size):
            d += (q[asked, dim] - v[row, dim]) ** 2
        d = np.sqrt(d)
        order = np.lexsort((first[row], d, asked))
        asked = asked[order]
        order = order[np.arange(len(order)) - np.searchsorted(asked, asked) < k]
        return pair[order], d[order]

    pairs, far, held = [], [], 0
    for at in np.intersect1d(lists, read):
        own_rows = member[slice(*np.searchsorted(lists, [at, at + 1]))]
        readers = reader[slice(*np.searchsorted(read, [at, at + 1]))]
        theirs, their_norms = -2 * v[own_rows].T, norms[own_rows]
        for a in range(0, len(readers), chunk := max(1, CELLS // len(own_rows))):
            asked = readers[a : a + chunk]
            d = q[asked] @ theirs
            d += their_norms  # less the query's own norm
            new = np.flatnonzero(np.isinf(bound[asked])) if len(own_rows) >= k else none
            if len(new):
                kth = np.partition(d[new], k - 1, 1)[:, k - 1] + own[asked[new]]
                bound[asked[new]] = np.where(np.isnan(kth), np.inf, kth + slack[asked[new]])
            near = np.flatnonzero(~(d > (bound - own)[asked, None]))
            i, j = np.divmod(near, len(own_rows))
            pairs.append(asked[i] * len(v) + own_rows[j])
            far.append(d.ravel()[near] + own[asked[i]])
            held += len(near)
            if held > PAIRS:
                pair, exact = best(pairs, far)
                pairs, far, held = [pair], [exact**2], 0
    pair, exact = best(pairs, far)
    asked, row = np.divmod(pair, max(len(v), 1))
    return pa.table({"query": queries["query"].combine_chunks().take(pa.array(asked)), "ids": ids.take(pa.array(row)), "score": pa.array(exact)})


def usable(vectors: DataFrame, key: str, vector: str) -> tuple[DataFrame, int, int]:
    """(vec_id, vector) of the rows that take part, the length of their vectors and how many they are."""
    v = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector")).where("vec_id IS NOT NULL")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = v.where(F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    size, n = v.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("n")).first() or (0, 0)
    v = v.where(F.size("vector") == size)
    again = v.groupBy("vec_id").count().where("count > 1").select("vec_id")
    if again.isEmpty():
        return v, size, n
    again = cut(again)
    v = cut(v.join(again, "vec_id", "left_anti").union(v.join(again, "vec_id").groupBy("vec_id").agg(F.min("vector").alias("vector"))))
    return v, size, v.count()


def _hits(entries: DataFrame, queries: DataFrame, size: int, k: int) -> DataFrame:
    """query, vec_id, score: candidates of each query, its k nearest among them. Both sides have ``ranges``."""
    rows, asked = (x.withColumn("r", F.explode("ranges")).select("*", "r.range", "r.lists").drop("ranges", "r") for x in (entries, queries))
    most = max(1, min(BLOCK, BLOCK_VALUES // max(size, 1)))
    share = lambda n: F.ceil(F.col(n) / most)
    many = rows.groupBy("range").agg(F.count("*").alias("n")).join(asked.groupBy("range").agg(F.count("*").alias("m")), "range")
    many = F.broadcast(many.select("range", share("n").alias("blocks"), share("m").alias("parts")))  # at most RANGES rows
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = rows.join(many, "range").withColumn("block", F.pmod(F.xxhash64("first"), "blocks")).withColumn("part", each("parts"))
    asked = asked.join(many, "range").withColumn("part", F.pmod(F.xxhash64("query"), "parts")).withColumn("block", each("blocks"))
    by = ["range", "block", "part"]
    near = rows.select(*by, "first", "ids", "vector", "lists").groupBy(*by).cogroup(asked.select(*by, "query", "vector", "lists").groupBy(*by))
    found = near.applyInArrow(lambda r, q: _nearest(r, q, size, k), "query long, ids array<long>, score double")
    found = found.select("query", F.explode("ids").alias("vec_id"), "score")
    w = Window.partitionBy("query").orderBy("score", "vec_id")  # a vector found in several ranges takes one place
    return found.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= k).distinct()


def search(vectors: DataFrame, k: int = 10, every: int = 100, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row whose key is divisible by ``every``."""
    sc = vectors.sparkSession.sparkContext
    v, size, n = usable(vectors, key, vector)
    modulus = 1 << 40
    drawn = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(modulus)) < int(min(1, SAMPLE / max(n, 1)) * modulus)).select("vector").toArrow()
    sample = _matrix(drawn["vector"].combine_chunks(), size) if size else np.zeros((0, 0))
    graph = sc.broadcast(fit(sample, int(min(MOST_CENTROIDS, max(1, n // LIST_VECTORS), max(1, len(sample) // 8)))))

    def listed(df: DataFrame, schema: str, *how: float) -> DataFrame:
        return df.mapInArrow(lambda batches: _listed(batches, graph.value, *how), f"{schema}, ranges array<struct<range: int, lists: array<int>>>")

    kind = v.schema["vector"].dataType.simpleString()
    same = Window.partitionBy("hash", "vector").orderBy("vec_id")  # sorted by the hash, which costs less
    least = v.withColumn("hash", F.xxhash64("vector")).withColumn("place", F.row_number().over(same)).where(F.col("place") <= k + 1)
    entries = least.withColumn("ids", F.collect_list("vec_id").over(same.rowsBetween(0, k))).where("place = 1").select(F.col("vec_id").alias("first"), "ids", "vector")
    entries = cut(listed(entries, f"first long, ids array<long>, vector {kind}", BOUNDARY, 1, COPIES))
    asking = cut(v.where(F.col("vec_id") % every == 0))
    distinct = asking.groupBy("vector").agg(F.min("vec_id").alias("query")).select("query", "vector")
    distinct = cut(distinct.repartition(min(RANGES, 1 + n // (RANGES * every))))  # few bytes, but work for more than one task
    asked = f"query long, vector {kind}"
    most = max(MOST_LISTS, len(graph.value.centroids) // MOST_SHARE)
    found = cut(_hits(entries, cut(listed(distinct, asked, PRUNE, LEAST_LISTS, most)), size, k + 1))
    enough = found.groupBy("query").count().where(F.col("count") >= min(k + 1, n))
    short = distinct.join(enough, "query", "left_anti")
    if not short.isEmpty():
        found = found.join(enough, "query", "left_semi").unionByName(_hits(entries, listed(short, asked), size, k + 1))
    near = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))  # k + 1 at most
    whose = asking.join(distinct, "vector").select(F.col("vec_id").alias("query_id"), "query").join(near, "query")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = whose.select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
