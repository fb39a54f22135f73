"""Near-duplicate documents by SetSketch (operator 5).

A document's set is its distinct shingles of five words. Documents with equal sets form a class; one sketch a class. A
sketch has REGISTERS registers, each an exponentially spaced truncated minimum (register = 1 - log_b of the least
exponential hash, floored), mergeable by the maximum. Bands of registers are hashed and joined in Spark:

1. Of the classes that share a band value, the one with the most copies is the hub, and every other is compared with it:
   the joint likelihood of the registers estimates the Jaccard likeness, and pairs that may reach the threshold are
   verified on the full sets.
2. Links found so far give components. Where the classes of a band value lie in one component, no further link changes
   anything. Where they don't, they are compared with each other exactly, all against all in blocks of bounded size (one
   task has two blocks); a block pair returns the links of a spanning forest, never all pairs.

So within band values no link is lost to caps. Rows between stages grow with classes in the first step, and in the second with the square
of the classes of an open band value, in blocks: each class goes once to every block, with its set. A pair at the threshold shares no
band with probability (1 - t**ROWS)**BANDS, 8e-7 at 0.85.

Nulls: a null text counts as empty; empty texts, and texts without words, link with nothing. Rows with a null doc_id have no
component and are kept. Rows that repeat a doc_id are each reported and may lie in different components, as their texts say; a
component is named by its smallest doc_id. Texts of any length are read whole. Other signatures (``Scheme``) are banded, estimated and verified alike. Only doc_id and text are read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import encoded, minima, mix, multipliers, shingle_sets
from .tools import cut, small

BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
BASE = 1.001
RATE = 20.0
TOP_REGISTER = (1 << 16) - 2
_MULT, _ADD = multipliers(REGISTERS, 505), multipliers(REGISTERS, 506)
#: Pairs whose estimate is lower than the threshold by this much (over five standard errors) aren't verified.
MARGIN = 0.25
#: Bytes of shingle hashes of a block in the exact stage.
BLOCK_BYTES = 4 << 20


def sketch(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers (uint16) of a set of 64-bit hashes."""
    low = minima(elements, _MULT, _ADD)
    spread = -np.log1p(-(low + 0.5) / 4294967296.0) / RATE
    return np.clip(np.floor(1 - np.log(spread) / np.log(BASE)) + 4096, 0, TOP_REGISTER + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum likelihood Jaccard likeness of sets of known sizes, from the counts of larger, smaller and equal registers; row by row."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    more, less = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    same = np.clip(1 - more - less, 1e-12, 1)
    likely = above * np.log(more) + below * np.log(less) + equal * np.log(same)
    return np.take_along_axis(j, likely.argmax(axis=1)[:, None], axis=1)[:, 0]


def _sketch_likeness(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    sa, sb = (np.frombuffer(b"".join(x), np.uint16).reshape(-1, REGISTERS) for x in (a, b))
    return joint_estimate(sa, sb, n_a, n_b)


@dataclass(frozen=True)
class Scheme:
    """A signature: its bytes from a set of hashes, how it is banded, and the likeness two of them (with set sizes) suggest."""

    sign: Callable[[np.ndarray], bytes]
    likeness: Callable[[list[bytes], list[bytes], np.ndarray, np.ndarray], np.ndarray]
    bands: int
    band_bytes: int


def _sketch_bytes(elements: np.ndarray) -> bytes:
    return sketch(elements).tobytes()


SETSKETCH = Scheme(_sketch_bytes, _sketch_likeness, BANDS, 2 * ROWS)


_SIGNED = "doc_id long, row long, n_shingles long, k1 long, k2 long, sketch binary"


def signed(docs: DataFrame, scheme: Scheme = SETSKETCH) -> DataFrame:
    """doc_id, row, n_shingles, k1 and k2 (128-bit key of the set), sketch of every document; key and sketch null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            sizes, k1, k2, sketches = [], [], [], []
            for s in shingle_sets(encoded(b.column(2))):
                sizes.append(len(s))
                one, two = _key(s) if len(s) else (None, None)
                k1.append(one)
                k2.append(two)
                sketches.append(scheme.sign(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sketches, pa.binary())], [c.split()[0] for c in _SIGNED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text").mapInArrow(run, _SIGNED)


def _key(elements: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set of hashes, as two signed numbers."""
    return tuple(int(mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in (elements, elements ^ np.uint64(0x5851F42D4C957F2D)))


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, elements (sorted 64-bit shingle hashes) of the classes in ``wanted`` (node, rep, k1, k2), from a text with doc_id rep.

    Rows may share a doc_id and differ in text: a row stands for the class whose key its own set has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            nodes, elements = [], []
            for node, k1, k2, s in zip(*(b.column(i).to_pylist() for i in range(3)), shingle_sets(encoded(b.column(3))), strict=True):
                if len(s) and _key(s) == (k1, k2):
                    nodes.append(node)
                    elements.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(elements, pa.binary())], ["node", "elements"])

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), "text").join(wanted, F.col("d") == F.col("rep")).select("node", "k1", "k2", "text")
    # rows that repeat doc_id and text have one set
    return texts.mapInArrow(run, "node long, elements binary").dropDuplicates(["node"])


def _pairs_exact(a: list[bytes], b: list[bytes], percent: int) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        both = np.concatenate([x, y])
        both.sort(kind="stable")
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        out[i] = 100 * common >= percent * (len(both) - common)
    return out


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows a, b of ``pairs`` whose full sets reach ``percent``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            good = pa.array(_pairs_exact(b.column(2).to_pylist(), b.column(3).to_pylist(), percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])

    one, two = sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("node").alias("b"), F.col("elements").alias("eb"))
    return pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "ea", "eb").mapInArrow(run, "a long, b long")


def estimated(pairs: DataFrame, threshold: float, scheme: Scheme = SETSKETCH) -> DataFrame:
    """The rows (a, b, sketches sa and sb, sizes na and nb) whose estimate may stand for a likeness of ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            if not b.num_rows:
                continue
            na, nb = (b.column(i).to_numpy().astype(float) for i in (4, 5))
            good = pa.array(scheme.likeness(b.column(2).to_pylist(), b.column(3).to_pylist(), na, nb) >= threshold - MARGIN)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(good), b.column(1).filter(good)], ["a", "b"])

    size = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold)
    return pairs.where(size).select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) of the undirected links a, b. Alternating large and small stars.

    Links are never gathered in one place; each round writes them anew and only their count and a checksum reach the driver.
    """
    edges = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    last = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("c"), "m"))
        large = both.join(least, F.col("u") == F.col("c")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large)
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m"))
        small = large.join(least, F.col("u") == F.col("c")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = cut(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == last:
            break
        last = tuple(state)
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")


def _block_links(x: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest over the classes of one block, or between those of two; exact."""
    nodes, blocks = x["node"].tolist(), x["block"].tolist()
    sets = [np.frombuffer(e, np.uint64) for e in x["elements"]]
    parent = {}

    def root(i: int) -> int:
        while parent.get(i, i) != i:
            parent[i] = parent.get(parent[i], parent[i])
            i = parent[i]
        return i

    first = {}
    for i, c in enumerate(x["component"].tolist()):
        parent[i] = first.setdefault(c, i)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    two, out = x["left"].iloc[0] != x["right"].iloc[0], []
    for i, own in enumerate(sets):
        if two and blocks[i] != x["left"].iloc[0]:
            continue
        low, high = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = high - low
        at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        common = np.bincount(owner[at], minlength=len(sets))
        for k in np.flatnonzero(100 * common >= percent * (sizes[i] + sizes - common)).tolist():
            if k != i and (not two and k > i or two and blocks[k] != blocks[i]):
                p, q = root(i), root(k)
                if p != q:
                    parent[p] = q
                    out.append((nodes[i], nodes[k]))
    return out


def exact_links(members: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """a, b: links between classes that share a band value but no component yet. ``members``: band, node, size, all; ``found``: node, component."""
    inside = members.where("all > 2").join(found.select(F.col("node").alias("n"), "component"), F.col("node") == F.col("n"), "left").select("band", "node", "size", F.coalesce("component", "node").alias("component"))
    inside = cut(inside)
    open_bands = inside.groupBy("band").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.sum(F.col("size") * 8).alias("bytes"), F.count("*").alias("n")).where("c1 != c2")
    parts = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.ceil(F.col("n") / 256))
    open_bands = cut(open_bands.select(F.col("band").alias("o"), parts.cast("int").alias("parts")))
    here = inside.join(open_bands, F.col("band") == F.col("o")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int"))
    # a block meets each block, itself included, once
    every = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct(F.least(k, "block").alias("left"), F.greatest(k, "block").alias("right")))
    dealt = here.select("band", "node", "component", "block", F.inline(every))
    rows = dealt.join(sets.withColumnRenamed("node", "r"), F.col("node") == F.col("r")).select("band", "left", "right", "block", "node", "component", "elements")

    def links(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_block_links(x.sort_values("node", ignore_index=True), percent), columns=["a", "b"], dtype="int64")

    return rows.groupBy("band", "left", "right").applyInPandas(links, "a long, b long")


def near_classes(docs: DataFrame, percent: int = 85, scheme: Scheme = SETSKETCH) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row (hash of the text) of every document; documents link at a likeness of ``percent`` or more."""
    threshold = percent / 100
    every = cut(signed(docs, scheme))
    some = every.where("doc_id is not null and k1 is not null")
    classes = some.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("size"), F.first("sketch").alias("sketch"))
    # a number of its own for each class, as rows that share a doc_id may differ in text; written once, so fixed
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    width = scheme.band_bytes
    bands = F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", 1 + i * width, width)) for i in range(scheme.bands)])
    keyed = classes.select("node", "copies", "size", F.explode(bands).alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("all"), F.max(F.struct("copies", (-F.col("node")).alias("minus"))).alias("hub")).where(F.col("all") > 1)
    shared = cut(shared.select(F.col("band").alias("s"), "all", (-F.col("hub.minus")).alias("hub")))
    members = cut(keyed.join(shared, F.col("band") == F.col("s")).select("band", "node", "size", "all", "hub"))
    met = cut(members.select(F.col("node").alias("m")).distinct())
    own = classes.select("node", "rep", "k1", "k2", F.col("size").alias("n"), "sketch")
    sets = cut(full_sets(docs, met.join(own, F.col("m") == F.col("node")).select("node", "rep", "k1", "k2")))
    spokes = cut(members.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct())
    one = own.select(F.col("node").alias("x"), F.col("sketch").alias("sa"), F.col("n").alias("na"))
    two = own.select(F.col("node").alias("y"), F.col("sketch").alias("sb"), F.col("n").alias("nb"))
    likely = estimated(spokes.join(one, F.col("a") == F.col("x")).join(two, F.col("b") == F.col("y")), threshold, scheme)
    links = cut(verified(cut(likely), sets, percent))
    found = cut(components(links))
    more = cut(exact_links(members, sets, found, percent))
    if not more.isEmpty():
        star = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = cut(components(star.unionByName(more)))
    # a component is named by the smallest doc_id of its classes, its own root among them
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    linked = found.join(classes.select(F.col("node").alias("c"), "rep"), F.col("node") == F.col("c"))
    names = linked.groupBy("component").agg(F.min("rep").alias("component_id")).withColumnRenamed("component", "named")
    linked = found.join(names, F.col("component") == F.col("named")).select(F.col("node").alias("l"), "component_id")
    reps = classes.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "rep", "node").join(linked, F.col("node") == F.col("l"), "left")
    reps = reps.select("c1", "c2", F.coalesce("component_id", "rep").alias("component"))
    joined = every.join(cut(reps), (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2")), "left")
    component = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component")), F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "row")
