"""A training corpus from raw documents: quality rules, line dedup, near-dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns the columns of documents, the last one
the packed pieces. A stage's result is meant to be written and read again before the next; ``run`` checkpoints it.

In all stages a null text counts as empty and is handed through as null, a null doc_id is a document like any other (nothing is
its near copy), texts are read whole whatever their length, repeated rows get the same decision, further columns are handed
through under any name, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import near, packing, pii, quality, spans
from sieveline.llm.queries import TOKENIZER
from sieveline.llm.tools import cut, table

#: No stage but line dedup can be put in SQL: perplexities, sketches, contexts and bins are tested against plain versions.
ORACLE_SQL = None


def _less(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and text hash (``row``) are in ``rejected``."""
    out = rejected.select(F.col("doc_id").alias("__r_id"), F.col("row").alias("__r_row"))
    same = F.col("doc_id").eqNullSafe(F.col("__r_id")) & (F.col("__row") == F.col("__r_row"))
    return docs.withColumn("__row", F.xxhash64("text")).join(out, same, "left_anti")


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars made to fit the text."""
    size: Column = F.length("text").cast("long").alias("n_chars")
    return docs.select(*[size if c == "n_chars" else F.col(c) for c in columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: empty and null texts among them (under 50 words). Rows are judged one by one, so
    repeated rows stay or go together, and there are no ties to break."""
    return _less(docs, quality.judge(docs).where(~F.col("kept"))).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated windows of three lines go, and documents that have no line left by it. The first place stays (least doc_id, then hash
    of the text, then position); rows that repeat doc_id and text are one document and lose the same lines. Empty, null and blank
    texts have no lines to lose and stay."""
    made = spans.without_repeats(docs, spans.LINES, "__lines", "__removed")
    return _counted(made.where((F.col("__removed") == 0) | (F.col("__removed") < F.col("__lines"))), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that with the smallest doc_id. Of rows that repeat doc_id and text one stays,
    that with the least values in its other columns, compared as text. Empty texts and rows without doc_id are no near copies of anything."""
    left = _less(docs, near.near_classes(docs, 85).where(~F.col("kept")))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    first = F.min_by(F.struct(*docs.columns), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in others])).alias("first")
    return left.groupBy("doc_id", "__row").agg(first).select("first.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data and secrets are replaced by their kind in brackets; spans that overlap become one, named by the first
    (the alphabetically first kind of those that start together). Null texts stay null."""
    return _counted(pii.masked(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 4096 tokens. Empty and null texts are their end token alone; rows that repeat a doc_id are packed
    each; equal lengths are taken by doc_id, then by hash of the text, then by position."""
    return packing.pack(docs, TOKENIZER, 4096, 2)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("personal data", personal_data), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
