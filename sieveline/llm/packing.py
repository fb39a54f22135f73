"""Packing token sequences by minimum bin slack (operator 8).

Documents are cut into full windows and a rest. The plan for the rests needs only how many there are of each length,
a table of at most ``capacity`` rows whatever the corpus: the longest rest left opens a window, a bitset subset-sum over
the lengths left (each with its count) finds what fills it closest to capacity, the counts are backtracked, and the
pattern is used as often as its lengths last. Windows that no subset fills completely are closed by cutting: the rests
left over are laid end to end and cut at the windows' ends; the last, partial window is cut into powers of two, which
need no padding.

Rows then find their place by arithmetic from their rank among the rests of their length. Ranks come from windows over
(length, salt), as many salts as shuffle partitions, so one very common length is not ranked in one task; the driver sees one
count for each length.

Null texts count as empty: such a document is its end token alone. Rows with equal or null doc_id are packed each by
itself; ties among equal lengths fall by doc_id, then by position in the table. Other columns are ignored, and an empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import vocabulary
from .bpe_batch import SLICE, BatchEncoder
from .tools import cut, small

CAPACITY = 4096
END = 2
#: Cut documents up to this many are broadcast; beyond it they are joined.
BROADCAST_ROWS = 20_000


def fill(target: int, lengths: list[int], counts: dict[int, int]) -> list[tuple[int, int]]:
    """(length, times) of the multiset whose sum is the largest up to ``target``; ``lengths`` descend."""
    mask, reach, seen = (1 << (target + 1)) - 1, 1, []
    for length in lengths:
        if length > target:
            continue
        before, left, step = reach, min(counts[length], target // length), 1
        while left > 0:
            take = min(step, left)
            reach |= (reach << (take * length)) & mask
            left -= take
            step *= 2
        if reach != before:
            seen.append((length, before))
            if reach >> target & 1:
                break
    at, out = reach.bit_length() - 1, []
    for length, before in reversed(seen):
        times = 0
        while not before >> at & 1:
            at -= length
            times += 1
        if times:
            out.append((length, times))
    return out


@dataclass
class Plan:
    """Where the pieces of each length go, by their rank among the pieces of that length.

    ``runs[length]``: (first rank, pieces in each window, first window, offset there) in order of rank. Ranks from
    ``stream[length][0]`` on lie in the stream of leftovers, from position ``stream[length][1]``.
    """

    capacity: int
    runs: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)
    stream: dict[int, tuple[int, int]] = field(default_factory=dict)
    windows: int = 0
    leftover: int = 0

    def tail(self) -> list[int]:
        """Ends, in the stream, of the sequences that its last, partial window is cut into."""
        rest, at, out = self.leftover % self.capacity, self.leftover - self.leftover % self.capacity, []
        for bit in reversed(range(self.capacity.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                out.append(at)
        return out


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The plan for so many pieces of each length (1 to capacity)."""
    plan, left = Plan(capacity), {k: n for k, n in histogram.items() if n}
    used: dict[int, int] = dict.fromkeys(left, 0)
    lengths, open_ones = sorted(left, reverse=True), []
    for longest in list(lengths):
        while left[longest]:
            left[longest] -= 1
            others = [x for x in lengths if left[x] and x <= longest]
            chosen = {longest: 1}
            for length, times in fill(capacity - longest, others, left):
                chosen[length] = chosen.get(length, 0) + times
            left[longest] += 1
            if sum(k * n for k, n in chosen.items()) < capacity:
                open_ones.append(longest)  # no subset closes a window that it opens; it may not help a shorter one either
                plan.stream[longest] = used[longest], 0
                break
            repeats, at = min(left[k] // n for k, n in chosen.items()), 0
            for k, n in chosen.items():
                plan.runs.setdefault(k, []).append((used[k], n, plan.windows, at))
                used[k] += n * repeats
                left[k] -= n * repeats
                at += k * n
            plan.windows += repeats
        lengths.remove(longest)
    for k in open_ones:
        plan.stream[k] = used[k], plan.leftover
        plan.leftover += left[k] * k
    return plan


def place(plan: Plan, length: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """window and offset of pieces of one length by rank; window -1: offset is a position in the stream of leftovers."""
    window, offset = np.full(len(rank), -1, np.int64), np.zeros(len(rank), np.int64)
    start, base = plan.stream.get(length, (np.iinfo(np.int64).max, 0))
    late = rank >= start
    offset[late] = base + (rank[late] - start) * length
    if (runs := plan.runs.get(length)) and not late.all():
        first = np.array([r[0] for r in runs], np.int64)
        which = np.searchsorted(first, rank, side="right") - 1
        per, head, at = (np.array([r[i] for r in runs], np.int64)[which] for i in (1, 2, 3))
        turn = rank - first[which]
        window[~late] = (head + turn // per)[~late]
        offset[~late] = (at + turn % per * length)[~late]
    return window, offset, late


def stream_cuts(plan: Plan, position: int, length: int) -> list[tuple[int, int, int, int]]:
    """(start in the piece, length, sequence, offset) of the parts of a leftover piece."""
    ends, out, at, stop = plan.tail(), [], position, position + length
    whole = plan.leftover - plan.leftover % plan.capacity
    while at < stop:
        if at < whole:
            k, begin = at // plan.capacity, at - at % plan.capacity
            end = begin + plan.capacity
        else:
            i = next(i for i, e in enumerate(ends) if e > at)
            k, begin, end = whole // plan.capacity + i, ends[i - 1] if i else whole, ends[i]
        n = min(end, stop) - at
        out.append((at - position, n, plan.windows + k, at - begin))
        at += n
    return out


_PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Full windows and rest of every document: doc_id, row, start, length, ids_crc32, doc_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, close, width = BatchEncoder(vocabulary(tokenizer)), end.to_bytes(4, "little"), 4 * capacity
        for b in small(batches, 1 << 16, SLICE):
            rows = []
            for doc, row, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), encoder.encode(b.column(2).to_pylist()), strict=True):
                data = ids + close
                for at in range(0, len(data), width):
                    piece = data[at : at + width]
                    rows.append((doc, row, at // 4, len(piece) // 4, zlib.crc32(piece), len(data) // 4))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[x.split()[0] for x in _PIECES.split(", ")])

    row = F.xxhash64("doc_id", "text")
    return docs.select(F.col("doc_id").cast("long"), row.alias("row"), "text").mapInArrow(run, _PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: every token of every document in one piece."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    salts = max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = cut(pieces(docs, tokenizer, capacity, end).withColumn("salt", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(salts))))
    counts = cut(made.groupBy("length", "salt").agg(F.count("*").alias("n")))
    # at most one row for each length, whatever the corpus
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_windows(histogram, capacity)
    shared = spark.sparkContext.broadcast(plan)
    # a piece's rank among those of its length: pieces with lesser salts, then those before it with its own salt
    lesser = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select(F.col("length").alias("b_length"), F.col("salt").alias("b_salt"), F.coalesce(lesser, F.lit(0)).alias("before"))
    spec = Window.partitionBy("length", "salt").orderBy("doc_id", "row", "start")
    own = made.withColumn("own", F.row_number().over(spec).cast("long") - 1)
    ranked = own.join(before, (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt"))).withColumn("rank", F.col("own") + F.col("before"))

    out_schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, row long, position long"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for b in batches:
            length, rank = (b.column(b.schema.names.index(k)).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            window, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for one in np.unique(length):
                at = length == one
                window[at], offset[at], _ = place(plan, int(one), rank[at])
            position = pa.array(offset, mask=window >= 0)
            whole, whole_at = window.copy(), offset.copy()
            for i in np.flatnonzero(window < 0):
                parts = stream_cuts(plan, int(offset[i]), int(length[i]))
                if len(parts) == 1:  # a leftover that no window's end cuts
                    whole[i], whole_at[i] = parts[0][2], parts[0][3]
            cols = {k: b.column(b.schema.names.index(k)) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "row")}
            cols |= {"sequence_id": pa.array(whole), "offset": pa.array(whole_at), "position": position}
            yield pa.RecordBatch.from_arrays([cols[k.split()[0]] for k in out_schema.split(", ")], names=[k.split()[0] for k in out_schema.split(", ")])

    placed = ranked.mapInArrow(assign, out_schema)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if not plan.leftover:
        return placed.select(columns)
    placed = cut(placed)
    broken = placed.where("sequence_id < 0")
    few = broken.count() <= BROADCAST_ROWS
    keys = broken.select("doc_id", "row", "start", "length", "doc_tokens", "position")
    keys = F.broadcast(keys) if few else keys
    text = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    keyed = text.join(keys, text["doc_id"].eqNullSafe(keys["doc_id"]) & (text["row"] == keys["row"])).select(text["doc_id"], "text", "start", "length", "doc_tokens", "position")
    # repeated rows meet each of their pieces as often as there are repeats; each position is one piece
    keyed = keyed.dropDuplicates(["position"])

    def recut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        encoder, close = BatchEncoder(vocabulary(tokenizer)), end.to_bytes(4, "little")
        for b in small(batches):
            rows = []
            for doc, text, start, length, total, position in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = encoder.encode([text])[0] + close
                for at, n, sequence, offset in stream_cuts(plan, position, length):
                    rows.append((doc, start + at, n, zlib.crc32(data[4 * (start + at) : 4 * (start + at + n)]), total, sequence, offset))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*rows, strict=True)) or [()] * 7)], names=columns)

    parts = keyed.mapInArrow(recut, ", ".join(f"{c} long" for c in columns))
    return placed.where("sequence_id >= 0").select(columns).unionByName(parts)


def sequences(packed: DataFrame, ids: DataFrame, end: int = END) -> DataFrame:
    """sequence_id, tokens: the packed sequences themselves, from ``pack`` and doc_id, ids (array) of the documents."""
    whole = ids.select("doc_id", F.concat("ids", F.array(F.lit(end))).alias("ids"))
    piece = packed.join(whole, "doc_id").select("sequence_id", F.struct("offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("t")).alias("p"))
    return piece.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["t"])).alias("tokens"))
