"""Streaming upsert of message batches (ST). The rules of the batch upsert are one aggregation of mergeable states (first, longest, latest),
which Structured Streaming keeps by message id: a micro-batch reads and writes the states of its own messages only. What they come to is
appended to a committed table under the batch's number, so a batch that is run again adds nothing; the order of versions is
the file order column of the data, not arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.identity import upsert_messages
from ..sources import commits

SCHEMA = "id string, url string, username string, datetime string, text string, _ord long"


def message_stream(spark: SparkSession, path: str, schema: str = SCHEMA, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)


MERGED = "id string, url string, username string, datetime string, text string, versions long, first_seen long, last_seen long, batch long"


def upsert_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Runs until all present files are read: each batch appends the merged form of the messages that it changed."""

    def store(batch: DataFrame, number: int) -> None:
        commits.append(batch.sparkSession, target, lambda _: batch.withColumn("batch", F.lit(number)), f"{checkpoint}#{number}")

    made = upsert_messages(stream).writeStream.outputMode("update").foreachBatch(store)
    query = made.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _newest(rows: DataFrame) -> DataFrame:
    """Each message as its last batch left it."""
    last = rows.groupBy("id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "id"]), "batch").alias("m"))
    return last.select("id", "m.*").select(rows.columns)


def current(spark: SparkSession, target: str) -> DataFrame:
    """The merged messages so far."""
    return _newest(commits.read(spark, target, MERGED)).drop("batch")


def compact(spark: SparkSession, target: str) -> bool:
    """Puts one part with the merged messages in place of those committed so far; False if another compaction came first."""
    _, parts = commits.manifest(spark, target)
    return len(parts) < 2 or commits.replace(_newest(commits.read(spark, target, MERGED, parts)), target, parts)


def resume_pages(pages: DataFrame) -> DataFrame:
    """category, next_page after the greatest one seen."""
    return pages.groupBy("category").agg((F.max("page") + 1).alias("next_page"))


def open_symbols(symbols: DataFrame, journal: DataFrame) -> DataFrame:
    """Symbols neither done nor failed."""
    return symbols.join(journal.where(F.col("status").isin("done", "failed")).select("symbol").distinct(), "symbol", "left_anti")


def seen_times(messages: DataFrame) -> DataFrame:
    return messages.groupBy("id").agg(F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("updated_at"))


def last_extract(extracts: DataFrame, patience: int = 5) -> DataFrame:
    """One row, stop_at: the extract (``step``) after which ``patience`` extracts in a row, it included, brought no new ``id``; null if none did."""
    first = extracts.groupBy("id").agg(F.min("step").alias("step")).groupBy("step").agg(F.count("*").alias("new"))
    # one row for each extract
    steps = extracts.select("step").distinct().join(first, "step", "left")
    w = Window.orderBy("step").rowsBetween(1 - patience, 0)
    quiet = steps.select("step", F.count_if(F.col("new").isNull()).over(w).alias("quiet"))
    return quiet.agg(F.min(F.when(F.col("quiet") >= patience, F.col("step"))).alias("stop_at"))
