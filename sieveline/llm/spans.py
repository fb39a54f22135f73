"""Removal of repeated runs of text units: lines (operator 7) and sentences (operator 6), in DataFrame functions only; and of passages of words.

A text is cut into units; every run of ``run`` consecutive non-blank units is hashed (128 bits, units trimmed), runs that occur
more than once anywhere are found by one aggregation, and every unit covered by an occurrence that isn't the first one (least
doc_id, then text hash, then position) is removed. Covered positions of overlapping runs merge as a set.

Nulls: a null text has no units and stays null; a null doc_id orders before all others. Rows that repeat doc_id and text are one
document and keep or lose the same units. Blank units are never counted, hashed or removed by themselves. Texts with fewer non-blank
units than a run stay whole. Very long texts are one row of arrays, spans one row each. Further columns are handed through under
their own names; internal columns start with two underscores and a dedicated prefix. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import _powers, document_word_hashes, encoded, mix, run_hashes
from .tools import cut, small


@dataclass(frozen=True)
class Units:
    """How a text is cut: a pattern to split at, and what joins the units again; a run needs that many units and words."""

    pattern: str
    joiner: str
    run: int
    least_words: int = 1

    def split(self, text: Column) -> Column:
        return F.split(text, self.pattern, -1)


#: Lines, three in a run.
LINES = Units(r"\n", "\n", 3)
#: Sentences and their parts end at . ! ? , ; : before white space, or at a line's end, and keep that white space; three in a run,
#: of at least 15 words together: shorter runs repeat by chance.
SENTENCES = Units(r"(?<=[.!?,;:][ \t\r\n])|(?<=\n)", "", 3, 15)

_BLANKS = " \t\n\r\f\x0b"


def _bare(unit: Column) -> Column:
    return F.btrim(unit, F.lit(_BLANKS))


def runs(docs: DataFrame, units: Units) -> DataFrame:
    """__s_id, __s_text, at, h1, h2: every run, by the rank of its first unit among the non-blank ones."""
    bare = F.filter(F.transform(units.split(F.col("text")), _bare), lambda u: u != "")
    rows = docs.select(F.col("doc_id").alias("__s_id"), F.xxhash64("text").alias("__s_text"), bare.alias("u")).where(F.size("u") >= units.run)
    if units.least_words > 1:
        rows = rows.withColumn("w", F.transform("u", lambda u: F.size(F.split(u, f"[{_BLANKS}]+"))))

    def hashed(first: Column) -> Column:
        parts = [F.get("u", first + k) for k in range(units.run)]
        struct = F.struct(first.alias("at"), F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(units.run), *reversed(parts)).alias("h2"))
        return struct if units.least_words <= 1 else F.when(sum((F.get("w", first + k) for k in range(units.run)), F.lit(0)) >= units.least_words, struct)

    spans = F.transform(F.sequence(F.lit(0), F.size("u") - units.run), hashed)
    return rows.select("__s_id", "__s_text", F.inline(spans if units.least_words <= 1 else F.array_compact(spans)))


def covered(docs: DataFrame, units: Units) -> DataFrame:
    """__s_id, __s_text, __s_gone: ranks of the units to remove, for documents that have any."""
    every = cut(runs(docs, units))
    place = F.struct("__s_id", "__s_text", "at")
    # a run that occurs only in rows that repeat doc_id and text is found too, but all its places are the first
    found = every.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    found = cut(found.select(F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first"))
    later = every.join(found, (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))).where(~place.eqNullSafe(F.col("first")))
    hit = F.transform(F.sequence(F.lit(0), F.lit(units.run - 1)), lambda k: F.col("at") + k)
    return later.select("__s_id", "__s_text", F.explode(hit).alias("at")).groupBy("__s_id", "__s_text").agg(F.collect_set("at").alias("__s_gone"))


def without_repeats(docs: DataFrame, units: Units, total: str = "n_units", removed: str = "n_removed") -> DataFrame:
    """``docs`` with ``text`` less its repeated units, and the numbers of non-blank units before and of those removed."""
    gone = covered(docs, units).withColumnRenamed("__s_id", "__g_id").withColumnRenamed("__s_text", "__g_text")
    same = F.col("doc_id").eqNullSafe(F.col("__g_id")) & (F.col("__s_text") == F.col("__g_text"))
    # texts are cut after the join, so that only they are shuffled
    joined = docs.withColumn("__s_text", F.xxhash64("text")).join(gone, same, "left").withColumn("__s_units", units.split(F.col("text")))
    filled = F.filter(F.transform("__s_units", lambda u, i: F.when(_bare(u) != "", i)), lambda i: i.isNotNull())
    joined = joined.withColumn("__s_at", filled)
    # positions left, by one hash set, in order
    kept = F.array_except(F.sequence(F.lit(0), F.size("__s_units") - 1), F.transform("__s_gone", lambda r: F.get("__s_at", r)))
    left = F.array_join(F.transform(kept, lambda i: F.get("__s_units", i)), units.joiner)
    text = F.when(F.col("__s_gone").isNull(), F.col("text")).otherwise(left)
    counts = {total: F.coalesce(F.size("__s_at"), F.lit(0)).cast("long"), removed: F.coalesce(F.size("__s_gone"), F.lit(0)).cast("long")}
    keep = [F.col(c) for c in docs.columns if c not in ("text", *counts)]
    return joined.select(*keep, text.alias("text"), *[v.alias(k) for k, v in counts.items()])


#: Repeated passages of at least so many words go. Windows of ANCHOR words are compared first, one at least of any WINDOW words.
WINDOW = 51
ANCHOR = 26
SLICE = 1 << 14
_ANCHORS = "id long, row long, code array<long>, h array<long>, c array<long>"
_PLACES = "id long, row long, code array<long>, h array<long>"


def _hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the word hashes from each start to its end, end exclusive."""
    up, down = _powers.upto(len(words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up, dtype=np.uint64)])
    return mix((sums[ends] - sums[starts]) * down[starts]).view(np.int64)


def _windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` word hashes, by its first word."""
    starts = np.arange(max(0, len(words) - size + 1))
    return _hashes(words, starts, starts + size) if len(starts) else np.empty(0, np.int64)


def _anchors(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each window of ANCHOR words that is the least (the leftmost of equal ones) of some WINDOW words: a code of the first of these and
    their number (they follow one another), first * 256 + number; the anchor's hash; a hash of all the words that they cover."""
    h = _windows(words, ANCHOR)
    width = WINDOW - ANCHOR + 1
    if len(h) < width:
        return (np.empty(0, np.int64),) * 3
    near = np.lib.stride_tricks.sliding_window_view(h, width)
    # in slices, as numpy copies the windows it looks at
    least = np.concatenate([near[k : k + SLICE].argmin(axis=1) + np.arange(k, min(k + SLICE, len(near))) for k in range(0, len(near), SLICE)])
    anchor, at, n = np.unique(least, return_index=True, return_counts=True)
    return at << 8 | n, h[anchor], _hashes(words, at, at + n - 1 + WINDOW)


def _lists(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """First windows and numbers of windows of each row of a list of codes; none where it is null."""
    codes = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    for end, before in zip(ends, np.concatenate([np.zeros(1, np.int64), ends]), strict=False):
        yield codes[before:end] >> 8, codes[before:end] & 255


def _flat(df: DataFrame, *names: str) -> DataFrame:
    """One row for each element of the lists named, which are as long as each other. Lists are what is written: rows have overhead."""
    return df.select("id", "row", F.inline(F.arrays_zip(*names)))


def without_passages(docs: DataFrame, total: str = "n_words", removed: str = "n_removed") -> DataFrame:
    """``docs`` with ``text`` less every word that lies in WINDOW words which an earlier place has, and numbers of words before and removed.

    Passages may begin and end anywhere, sentences don't matter. Words are runs of bytes outside ASCII white space; white space
    around a removed passage stays once. Any two equal windows share an anchor at the same offset, and each window has one anchor, so
    places of anchors stand for the windows around them. Places with the same anchor and the same words around it are alike: all but the
    first of them lose all their windows. Only firsts that share their anchor with other words around it are compared window by
    window. Rows that repeat doc_id and text are one document.
    """
    spark = docs.sparkSession
    named = docs.withColumns({"__p_id": F.col("doc_id").cast("long"), "__p_row": F.xxhash64("text")})
    texts = named.where("text is not null").select("__p_id", "__p_row", "text")

    def lists(ids: pa.Array, rows: pa.Array, found: list[tuple[np.ndarray, ...]], names: tuple[str, ...]) -> pa.RecordBatch:
        ends = pa.array(np.cumsum([0] + [len(f[0]) for f in found]), pa.int32())
        parts = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([f[k] for f in found] or [np.empty(0, np.int64)]), pa.int64())) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([ids, rows, *parts], ["id", "row", *names])

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            yield lists(b.column(0), b.column(1), [_anchors(w) for w in document_word_hashes(encoded(b.column(2)))], ("code", "h", "c"))

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = []
            for w, (at, n) in zip(document_word_hashes(encoded(b.column(2))), _lists(b.column(3)), strict=True):
                h = _windows(w, WINDOW)
                own = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
                found.append((own << 8 | 1, h[own]))
            yield lists(b.column(0), b.column(1), found, ("code", "h"))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            names = b.schema.names
            made, counts = [], []
            for t, (at, n) in zip(encoded(b.column(names.index("text"))), _lists(b.column(names.index("__p_gone"))), strict=True):
                starts, ends, _ = run_hashes(np.frombuffer(t, np.uint8))
                cover = np.zeros(len(starts) + 1, np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + n - 1 + WINDOW, -1)
                lost = np.flatnonzero(np.cumsum(cover)[:-1])
                keep = np.ones(len(t), bool)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(lost) > 1) + 1, [len(lost)]]) if len(lost) else np.zeros(1, int)
                for x, y in zip(edges[:-1], edges[1:], strict=True):
                    a, z = lost[x], lost[y - 1]
                    keep[starts[a] : starts[z + 1] if z + 1 < len(starts) else len(t)] = False
                made.append(np.frombuffer(t, np.uint8)[keep].tobytes().decode() if len(lost) else t.decode())
                counts.append((len(starts), len(lost)))
            text = pa.array([None if n else m for n, m in zip(b.column(names.index("text")).is_null().to_pylist(), made, strict=True)], pa.string())
            kept = [b.column(i) if n != "text" else text for i, n in enumerate(names) if n != "__p_gone"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1))], [*(n for n in names if n != "__p_gone"), total, removed])

    each = _flat(cut(texts.mapInArrow(anchored, _ANCHORS)), "code", "h", "c")
    place = F.struct("id", "row", "code")
    anchors = each.groupBy(F.col("h").alias("same")).agg((F.min("c") != F.max("c")).alias("mixed"), F.count("*").alias("many")).where("many > 1").select("same", "mixed")
    # what was counted is written before it is joined, so that both sides are plain exchanges, which AQE can split
    some = cut(each.join(cut(anchors), F.col("h") == F.col("same")).drop("same"))
    alike = some.groupBy(F.col("h").alias("h1"), F.col("c").alias("c1")).agg(F.min(place).alias("first"), F.first("mixed").alias("mixed"), F.count("*").alias("many"))
    alike = cut(alike.where("many > 1 or mixed"))
    copies = some.join(alike.where("many > 1").drop("mixed"), (F.col("h") == F.col("h1")) & (F.col("c") == F.col("c1"))).where(~place.eqNullSafe(F.col("first")))
    owner = [F.col("id").alias("__g_id"), F.col("row").alias("__g_row")]
    pair = F.col("__p_id").eqNullSafe(F.col("__g_id")) & (F.col("__p_row") == F.col("__g_row"))
    # sets, so that rows that repeat a document don't add up; their windows count as one place, as do their anchors
    spread = alike.where("mixed").select("first.*").groupBy(*owner).agg(F.collect_set("code").alias("marks"))
    mixed = texts.join(spread, pair).select("__p_id", "__p_row", "text", "marks")
    every = _flat(cut(mixed.mapInArrow(windowed, _PLACES)), "code", "h")
    repeated = cut(every.groupBy(F.col("h").alias("same")).agg(F.min(place).alias("first"), F.count("*").alias("many")).where("many > 1").drop("many"))
    later = every.join(repeated, F.col("h") == F.col("same")).where(~place.eqNullSafe(F.col("first")))
    gone = copies.select("id", "row", "code").unionByName(later.select("id", "row", "code")).groupBy(*owner).agg(F.collect_set("code").alias("__p_gone"))
    joined = named.join(gone, pair, "left").select(*docs.columns, "__p_gone")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(left, f"{schema}, `{total}` long, `{removed}` long")
