"""MinHash document fingerprints (operator 10).

A fingerprint holds, for each of several universal hash permutations, the least image of the text's shingles of five
words (ASCII letters lower-cased; shorter texts are one shingle). Equal texts have equal fingerprints, and the share of
equal positions estimates the Jaccard likeness of two texts. An empty text (also null, or without words) has a
fingerprint of its own kind: 1 like another empty one, 0 like any other.

Near documents (``near_documents``) share a band of their signatures, found by a join in Spark, and are verified by the Jaccard
likeness of their full shingle sets.

Neighbours in ascending doc_id are found without a global sort into one task: rows are dealt by ranges of doc_id, and the
first row of each range is also sent to the range before. Rows without doc_id follow after all others; equal doc_ids are
ordered by text. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import near
from .hashing import document_word_hashes, encoded, minima, multipliers, shingles
from .tools import small

PERMUTATIONS = 64
#: A pair as alike as 0.8 shares none of 21 bands of three minima with probability 3e-7.
BANDS, ROWS = 21, 3
_MULT = multipliers(PERMUTATIONS, 1010)
_ADD = multipliers(PERMUTATIONS, 2020)
NOTHING = 0xFFFFFFFF


def signature(words: np.ndarray) -> np.ndarray:
    """PERMUTATIONS unsigned 32-bit minima of a text's word hashes."""
    return minima(shingles(words), _MULT, _ADD)


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of minima for each UTF-8 text."""
    out = np.empty((len(texts), PERMUTATIONS), np.uint32)
    for i, words in enumerate(document_word_hashes([t.lower() for t in texts])):
        out[i] = signature(words)
    return out


def as_hex(signs: np.ndarray) -> list[str]:
    return [s.astype(">u4").tobytes().hex() for s in signs]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal positions, row by row."""
    return (a == b).mean(axis=1)


def fingerprint(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, fingerprint (hexadecimal) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            signs = signatures(encoded(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(as_hex(signs), pa.string())], ["key", "fingerprint"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text)).mapInArrow(run, "key long, fingerprint string").withColumnRenamed("key", key)


def _minima_bytes(elements: np.ndarray) -> bytes:
    return minima(elements, _MULT, _ADD).tobytes()


def _minima_likeness(a: list[bytes], b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    sa, sb = (np.frombuffer(b"".join(x), np.uint32).reshape(-1, PERMUTATIONS) for x in (a, b))
    return likeness(sa, sb)


MINHASH = near.Scheme(_minima_bytes, _minima_likeness, BANDS, 4 * ROWS)


def near_documents(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, row of every document: signature bands joined, Jaccard of full sets verified.

    Empty texts link with nothing here; rows without doc_id have no component.
    """
    return near.near_classes(docs, percent, MINHASH)


def _ranges(ids: DataFrame, parts: int) -> tuple[list[int], int]:
    """First doc_ids of up to ``parts`` ranges with about as many rows each, and a power of two: of the ranges for rows without doc_id."""
    cuts = F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)
    c, n, named = ids.agg(cuts, F.count("*"), F.count("doc_id")).first()
    return sorted(set(c or [])) if parts > 1 else [], (max(1, (n - named) * parts // max(n, 1)) - 1).bit_length()


def _place(bounds: list[int], bits: int) -> Column:
    """A row's range: how many bounds its doc_id reaches, by halving steps; rows without doc_id follow by their text's hash, on its ``bits`` upper bits."""
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    known = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<long>")
    reached = lambda at, step: F.when(F.col("doc_id") >= F.get(known, at + step - 1), at + step).otherwise(at)
    named = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), reached) if steps else F.lit(0)
    free = F.shiftright("order", 64 - bits).cast("int") + (1 << bits >> 1) if bits else F.lit(0)
    return F.when(F.col("doc_id").isNull(), free + len(bounds) + 1).otherwise(named)


def _next_texts(docs: DataFrame) -> DataFrame:
    """Rows dealt by ranges of doc_id, each range followed by the first row of the next (and the last by the first of all)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bounds, bits = _ranges(docs.select("doc_id"), parts)
    ranges = len(bounds) + 1 + (1 << bits)
    ordered = docs.withColumn("order", F.xxhash64("text"))
    ordered = ordered.withColumn("at", _place(bounds, bits))
    least = F.min(F.struct(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "order")).alias("least")
    firsts = sorted(tuple(r) for r in ordered.groupBy("at").agg(least).select("at", "least.doc_id", "least.order").collect())  # one row for each range
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    known = spark.createDataFrame([(*f, b) for f, b in zip(firsts, before, strict=True)], "of int, first long, first_order long, copy_to int")
    rows = ordered.join(F.broadcast(known), F.col("at") == F.col("of"))
    opens = (F.coalesce("doc_id", F.lit(0)) == F.col("first")) & (F.col("order") == F.col("first_order"))
    ways = F.array(F.struct("at", F.lit(False).alias("copy")), F.when(opens, F.struct(F.col("copy_to").alias("at"), F.lit(True).alias("copy"))))
    rows = rows.select("doc_id", "text", "order", F.explode(F.array_compact(ways)).alias("way")).select("doc_id", "text", "order", "way.at", "way.copy")
    dealt = rows.repartitionById(ranges, F.col("at")).sortWithinPartitions("copy", F.col("doc_id").asc_nulls_last(), "order")
    return dealt.select("doc_id", "text", "copy")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, with the likeness of the first to the second and to the next document's."""
    rows = _next_texts(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the row that waits for the next one: doc_id, text, signature
        done = False
        for b in small(batches):
            ids, texts, copies = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            if done:
                continue
            if True in copies:  # the first copy closes the range; equal rows may have sent more
                n = copies.index(True) + 1
                ids, texts, done = ids[:n], texts[:n], True
            signs = signatures([t.encode() for t in texts])
            rows = ([held] if held else []) + list(zip(ids, texts, signs, strict=True))
            held = rows[-1]
            if len(rows) < 2:
                continue
            now, after = rows[:-1], rows[1:]
            new = [edited(a[1], c[1]) for a, c in zip(now, after, strict=True)]
            own, theirs = np.array([a[2] for a in now]), np.array([c[2] for c in after])
            made = signatures([t.encode() for t in new])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a[0] for a in now], pa.int64()),
                    pa.array([len(a[1]) for a in now], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
                    pa.array(as_hex(own), pa.string()),
                    pa.array(as_hex(made), pa.string()),
                    pa.array(likeness(own, made)),
                    pa.array(likeness(own, theirs)),
                ],
                names=[c.split()[0] for c in _RESULT.split(", ")],
            )

    return rows.mapInArrow(run, _RESULT)


__all__ = ["edited", "fingerprint", "fingerprint_edits", "likeness", "near_documents", "signature", "signatures"]
