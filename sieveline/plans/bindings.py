"""The engine's concepts over the driver's tables: companies from part, posts from documents, prices from events, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Terms that do occur in the invented prose of the test tables.
POSITIVE = ("the", "that", "with", "les", "der")
NEGATIVE = ("from", "were", "des", "und", "los")
STEMS = ("that", "with", "from", "inst", "eaux", "keit")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.col("p_retailprice").desc(), "p_partkey")
    p = read(spark, sf_dir, "part")
    return p.select(F.concat(F.lit("P"), "p_partkey").alias("symbol"), F.col("p_name").alias("company_name"), F.col("p_brand").alias("category"), F.col("p_type").alias("industry"), (F.col("p_retailprice") * 1e6).alias("market_cap_numeric"), F.row_number().over(w).cast("long").alias("rank_in_category"))


def company_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, posts_count and three scores from the order lines of a part."""
    by = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("posts_count"), F.round(F.avg("l_discount") * 1000, 2).alias("custom_esg_proxy_score"), F.round(F.avg("l_tax") * 1000, 2).alias("profitability_score"), F.round(F.avg("l_quantity") * 2, 2).alias("t"))
    return by.select(F.concat(F.lit("P"), "l_partkey").alias("symbol"), "posts_count", "custom_esg_proxy_score", "profitability_score", F.when(F.col("posts_count") >= 25, F.col("t")).alias("technical_score"))


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("symbol"), F.col("doc_id").cast("string").alias("message_id"), F.concat(F.lit("u"), F.col("doc_id") % 37).alias("username"), "text", "doc_id")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("c"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """category (part type), ticker (supplier)."""
    part, lines = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    return lines.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("category"), F.concat(F.lit("S"), "l_suppkey").alias("ticker")).distinct()


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (customer) with five metrics, null without orders."""
    c, o, line = (read(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    by = o.join(line, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(F.round(F.avg("l_discount"), 6).alias("roe"), F.round(F.avg("l_tax"), 6).alias("roa"), F.round(F.avg("l_quantity"), 6).alias("net_margin"), F.round(F.avg("l_extendedprice"), 4).alias("operating_margin"), F.round(F.avg("o_totalprice"), 4).alias("revenue_growth"))
    return c.join(by, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), F.col("c_mktsegment").alias("category"), "roe", "roa", "net_margin", "operating_margin", "revenue_growth")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").alias("topic_id"))


def topic_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, symbol, topic_id, weight, sentiment_score: four topics a document by arithmetic on its id."""
    d = read(spark, sf_dir, "documents")
    t = d.select("doc_id", F.col("source").alias("symbol"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    return t.select("doc_id", "symbol", ((F.col("doc_id") * 7 + F.col("k") * 5) % 12).cast("int").alias("topic_id"), (((F.col("doc_id") + F.col("k") * 3) % 10) / 23).alias("weight"), ((F.col("doc_id") % 9 - 4) / 4).alias("sentiment_score"))


def axis_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, axis_id, raw, exposure, posts: parts by line number, from order lines."""
    line = read(spark, sf_dir, "lineitem")
    return line.groupBy(F.concat(F.lit("P"), "l_partkey").alias("symbol"), F.col("l_linenumber").cast("int").alias("axis_id")).agg(F.round(F.avg("l_discount"), 6).alias("raw"), F.round(F.avg("l_tax") * 5, 6).alias("exposure"), F.count("*").alias("posts"))
