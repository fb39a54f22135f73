"""Ranked lexical search: document-at-a-time over compressed postings per shard.

A task turns its documents into shards of about ``SHARD_BYTES`` of text. A shard is one row: its doc_ids, ascending, and for each
term of the searched items a list of places in them with the term's occurrences, as differences in seven-bit groups. Shards
are checkpointed; the sizes N and L and each term's df are summed from them by Spark. Then each shard is searched where it lies: for
an item the cursors of its lists stand in a heap by document, the least document is scored in one go from all of its lists, and a
bounded heap keyed by score and doc_id keeps the best. Lists that together can't lift a document over the worst of the heap
(nor over what one list alone gives to ``k`` documents) leave the heap of cursors and are only looked up; a document that can't get
there any more is left early. That is exact. At most k rows for each item and shard go to the global merge, a rank over items whose
partial limit runs before its shuffle. No text is shuffled.

Items. Their distinct terms go to all tasks, so items are searched in blocks (by the hash of item_id) of about ``BLOCK_TERMS``
terms, each with one pass over the documents. Terms are told apart by 64-bit hashes of their bytes.

Rows. A null text has no terms; an item without terms, or whose terms stand nowhere, has no results; of items that repeat an
item_id the terms are one set, and items without item_id take no part. Rows that repeat a doc_id are documents each (equal
scores of theirs have adjacent ranks); a document without doc_id counts in N, L and df but is never returned. Texts are read whole,
in slices; further columns are not read. Empty tables give no rows. Scores are 64-bit integers.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hashing import document_word_hashes, encoded
from .tools import cut, small

SHARD_BYTES = 32 << 20
BLOCK_TERMS = 1 << 19

#: Bytes that end a term: ASCII other than digits and letters.
ENDS = np.ones(256, dtype=bool)
ENDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

SHARD = "n_docs long, n_terms long, terms array<long>, dfs array<long>, ends array<long>, docs binary, sizes binary, postings binary"


def term_hashes(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of each text's terms, in order, with repeats."""
    return document_word_hashes([t.lower() for t in texts], ENDS)


def packed(values: np.ndarray) -> bytes:
    """Non-negative numbers in groups of seven bits, low groups first, a high bit where more follow."""
    v = values.astype(np.uint64)
    groups = np.maximum(1, sum((v >= np.uint64(1) << np.uint64(7 * k)).astype(np.int64) for k in range(10)))
    ends = np.cumsum(groups)
    out = np.empty(int(ends[-1]) if len(v) else 0, np.uint8)
    for k in range(int(groups.max(initial=0))):
        has = groups > k
        out[(ends - groups)[has] + k] = (v[has] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | np.where(groups[has] > k + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, starts).astype(np.int64) if len(ends) else np.empty(0, np.int64)


def _shard(found: list[tuple[int, int, np.ndarray, np.ndarray]], n_docs: int, n_terms: int, vocabulary: np.ndarray) -> dict:
    """One shard's row. ``found``: doc_id, terms in the document, places in the vocabulary, occurrences."""
    found.sort(key=lambda d: d[0])
    ids = np.array([d[0] for d in found], np.int64)
    lengths = np.array([len(d[2]) for d in found], np.int64)
    terms = np.concatenate([d[2] for d in found]) if found else np.empty(0, np.int64)
    counts = np.concatenate([d[3] for d in found]) if found else np.empty(0, np.int64)
    docs = np.repeat(np.arange(len(found)), lengths)
    order = np.argsort(terms, kind="stable")  # within a term by document
    terms, counts, docs = terms[order], counts[order], docs[order]
    starts = np.flatnonzero(np.diff(terms, prepend=-1))
    steps = np.diff(docs, prepend=0)
    steps[starts] = docs[starts]
    bounds = [*starts.tolist(), len(terms)] if len(terms) else []
    pieces = [packed(np.stack([steps[a:b], counts[a:b]], 1).ravel()) for a, b in pairwise(bounds)]
    first = int(ids[0]) if len(ids) else 0
    gaps = np.diff(ids, prepend=first)
    return {"n_docs": n_docs, "n_terms": n_terms, "terms": vocabulary[terms[starts]].view(np.int64).tolist(), "dfs": np.diff(bounds).tolist(), "ends": np.cumsum([len(p) for p in pieces], dtype=np.int64).tolist(), "docs": first.to_bytes(8, "little", signed=True) + packed(gaps), "sizes": packed(np.array([d[1] for d in found], np.int64)), "postings": b"".join(pieces)}


def shards(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """The index of the documents for a sorted vocabulary of term hashes. Documents without doc_id have shards of their own, without
    doc_ids, that only count."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(vocabulary)
    schema = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), *((c, pa.list_(pa.int64())) for c in ("terms", "dfs", "ends")), *((c, pa.binary()) for c in ("docs", "sizes", "postings"))])

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        made: dict[bool, tuple[list, list[int]]] = {named: ([], [0, 0, 0]) for named in (True, False)}

        def shard(named: bool) -> pa.RecordBatch:
            found, (n_docs, n_terms, _) = made[named]
            row = _shard(found, n_docs, n_terms, known)
            made[named] = ([], [0, 0, 0])
            return pa.RecordBatch.from_pylist([row if named else row | {"docs": None}], schema)

        for batch in small(batches):
            texts = encoded(batch.column(1))
            for doc_id, text, hashes in zip(batch.column(0).to_pylist(), texts, term_hashes(texts), strict=True):
                named = doc_id is not None
                found, sums = made[named]
                sums[0], sums[1], sums[2] = sums[0] + bool(len(hashes)), sums[1] + len(hashes), sums[2] + len(text)
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                places, counts = np.unique(at[known[at] == hashes], return_counts=True) if len(known) else (at[:0], at[:0])
                if len(places):
                    found.append((doc_id if named else 0, len(hashes), places, counts))
                if sums[2] >= SHARD_BYTES:
                    yield shard(named)
        for named in (True, False):
            if made[named][1][0]:
                yield shard(named)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(build, SHARD)


def best_of_shard(lists: list[tuple[list[int], list[int], int]], k: int, floor: int) -> list[tuple[int, int]]:
    """The k best (score, minus the document's place) above ``floor`` from lists of places, gains and the greatest gain."""
    lists = sorted(lists, key=lambda x: x[2])
    reach = [0]  # what the first j lists can give together
    for _, _, top in lists:
        reach.append(reach[-1] + top)
    at = [0] * len(lists)
    best: list[tuple[int, int]] = []
    first = bisect_left(reach, floor + 1) - 1  # of the lists that stay in the heap of cursors
    cursors = [(lists[j][0][0], j) for j in range(first, len(lists))]
    heapq.heapify(cursors)
    while cursors:
        doc, score = cursors[0][0], 0
        while cursors and cursors[0][0] == doc:
            j = cursors[0][1]
            docs, gains, _ = lists[j]
            score += gains[at[j]]
            at[j] += 1
            if at[j] < len(docs):
                heapq.heapreplace(cursors, (docs[at[j]], j))
            else:
                heapq.heappop(cursors)
        for j in range(first - 1, -1, -1):
            if score + reach[j + 1] <= floor:
                break
            docs, gains, _ = lists[j]
            at[j] = here = bisect_left(docs, doc, at[j])
            if here < len(docs) and docs[here] == doc:
                score += gains[here]
        if score > floor:  # an equal score of a later document loses
            (heapq.heappush if len(best) < k else heapq.heapreplace)(best, (score, -doc))
            if len(best) == k and best[0][0] > floor:
                floor = best[0][0]
                now = bisect_left(reach, floor + 1) - 1
                if now > first:
                    first, cursors = now, [c for c in cursors if c[1] >= now]
                    heapq.heapify(cursors)
    return best


def _floor(lists: list[tuple[list[int], list[int], int]], tops: list[int]) -> int:
    """A score that k documents exceed: one less than the k-th best gain of any one list."""
    return max([0, *(t - 1 for t in tops)])


def _search(rows: Iterable[pa.RecordBatch], items: list[tuple[int, np.ndarray]], weights: dict[int, int], n: int, length: int, k: int) -> Iterator[tuple[int, int, int]]:
    for batch in rows:
        for row in batch.to_pylist():
            if row["docs"] is None:
                continue
            ids = int.from_bytes(row["docs"][:8], "little", signed=True) + np.cumsum(unpacked(row["docs"][8:]))
            norms = 8 * (10 + (90 * n * unpacked(row["sizes"])) // length)
            lists: dict[int, tuple[list[int], list[int], int]] = {}
            tops: dict[int, int] = {}
            for term, a, b in zip(row["terms"], [0, *row["ends"]], row["ends"], strict=False):
                both = unpacked(row["postings"][a:b]).reshape(-1, 2)
                docs, tf = np.cumsum(both[:, 0]), both[:, 1]
                gains = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + norms[docs]))
                if len(gains) and gains.max() > 0:
                    lists[term] = docs.tolist(), gains.tolist(), int(gains.max())
                    tops[term] = int(np.partition(gains, -k)[-k]) if len(gains) >= k else 0
            for item, terms in items:
                own = [t for t in terms if t in lists]
                mine = [lists[t] for t in own]
                for score, doc in best_of_shard(mine, k, _floor(mine, [tops[t] for t in own])):
                    yield item, int(ids[-doc]), score


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents; equal scores by ascending doc_id."""
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext

    def told(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for item, hashes in zip(batch.column(0).to_pylist(), term_hashes(encoded(batch.column(1))), strict=True):
                one = np.unique(hashes).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(one), pa.int64()), pa.array(one)], ["item_id", "term"])

    named = items.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    terms = cut(named.mapInArrow(told, "item_id long, term long").distinct())
    blocks = max(1, -(-terms.count() // BLOCK_TERMS))
    found = None
    for block in range(blocks):
        own = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toPandas()
        vocabulary = np.unique(own["term"].to_numpy(np.int64).view(np.uint64))
        index = cut(shards(docs, vocabulary))
        n, length = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        dfs = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t")).groupBy("t.terms").agg(F.sum("t.dfs").alias("df")).collect()  # at most the block's terms
        weights = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for t, df in dfs}
        shared = sc.broadcast(([(int(i), g.to_numpy().tolist()) for i, g in own.groupby("item_id")["term"]], weights))

        def ranked(batches: Iterable[pa.RecordBatch], shared=shared, n=n, length=length) -> Iterator[pa.RecordBatch]:
            made = list(_search(batches, *shared.value, n, length, k))
            for at in range(0, len(made), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made[at : at + 10_000], strict=True)], ["item_id", "doc_id", "score"])

        part = index.mapInArrow(ranked, "item_id long, doc_id long, score long")
        found = part if found is None else found.union(part)
    w = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
