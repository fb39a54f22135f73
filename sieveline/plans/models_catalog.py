"""Queries of topics, clusters and models; registered beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import axis_clusters, density, factors, models, sentiment
from ..operators.lineage import cut
from . import bindings as b
from .registry import query

STOPS = ["the", "that", "with"]


_TFIDF = """WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: NOT w IN ('the', 'that', 'with')) AS w FROM documents),
g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
c AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY ALL),
v AS (SELECT term, count(*) AS df, sum(n) AS total FROM c GROUP BY term HAVING count(*) >= 20 AND count(*) <= 0.22 * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 2000),
x AS (SELECT doc_id, term, (1 + ln(n)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS value FROM c JOIN v USING (term))
SELECT doc_id, term, round(value / sqrt(sum(value * value) OVER (PARTITION BY doc_id)), 6) AS value FROM x"""


def _told(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """The documents' informative words, found once, and the tokens in them."""
    docs = b.read(spark, d, "documents").select("doc_id", text.informative_text(F.lower("text"), STOPS).alias("told"))
    return cut(docs), F.when(F.col("told") == "", F.array().cast("array<string>")).otherwise(F.split("told", " "))


@query(_TFIDF)
def ml5_weighted_terms(spark: SparkSession, d: str) -> DataFrame:
    docs, tokens = _told(spark, d)
    vocabulary = factors.fit_vocabulary(docs, "doc_id", tokens, 20, 0.22, 2000)
    rows = factors.weighted_terms(docs, "doc_id", tokens, vocabulary)
    each = rows.select("key", F.inline(F.arrays_zip("terms", "values")))
    return each.join(F.broadcast(vocabulary), F.col("terms") == F.col("place")).select(F.col("key").alias("doc_id"), "term", F.round("values", 6).alias("value"))


def _topics(spark: SparkSession, d: str) -> tuple[factors.Factors, DataFrame]:
    """Factors of the documents' terms: 12 topics, terms in at least 20 documents, the 2,000 most frequent ones, up to 40 rounds."""
    docs, tokens = _told(spark, d)
    vocabulary = factors.fit_vocabulary(docs, "doc_id", tokens, 20, 0.22, 2000)
    return factors.factorise(factors.weighted_terms(docs, "doc_id", tokens, vocabulary), 12, 2000, rounds=40), vocabulary


@query()
def ml5_topics(spark: SparkSession, d: str) -> DataFrame:
    made, _ = _topics(spark, d)
    return factors.top_topics(factors.topic_shares(made)).withColumnRenamed("key", "doc_id")


@query()
def ml5_topic_terms(spark: SparkSession, d: str) -> DataFrame:
    return factors.topic_terms(*_topics(spark, d))


@query()
def ml7_topic_assignment(spark: SparkSession, d: str) -> DataFrame:
    return density.density_clusters(b.vectors(spark, d), "doc_id", "vector")


def _marked_posts(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, label, tokens: the marker words are two that the invented prose has; tokens are without them."""
    posts = b.read(spark, d, "documents").select("doc_id", "text")
    return sentiment.marked(posts, "doc_id", "text", "les", "der")


@query()
def ml4_sentiment_model(spark: SparkSession, d: str) -> DataFrame:
    posts = _marked_posts(spark, d)
    return sentiment.scored(posts, sentiment.train(posts)).withColumnRenamed("key", "doc_id")


@query()
def ml3_holdout_quality(spark: SparkSession, d: str) -> DataFrame:
    posts = _marked_posts(spark, d)
    known = posts.where(F.col("label").isNotNull())
    return sentiment.holdout_quality(sentiment.scored(known, sentiment.train(posts)))


@query()
def ml8_axis_clusters(spark: SparkSession, d: str) -> DataFrame:
    parts = b.read(spark, d, "part").select(F.col("p_partkey").alias("axis_id"), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), r"[^a-z]+").alias("w"))
    return axis_clusters.cluster_axes(parts, F.filter("w", lambda w: F.length(w) > 1))


def _model_answer(prompt: str) -> str:
    """Stands for a language model: JSON in a sentence, or nothing of use."""
    return f'Sure: {{"coverage": {len(prompt) % 4}}} as asked' if "STEEL" in prompt else "no idea"


@query("SELECT p_partkey::VARCHAR AS symbol, CASE WHEN contains(p_type, 'STEEL') THEN concat('{\"coverage\": ', length(p_type) % 4, '}') END AS profile, NOT contains(p_type, 'STEEL') AS error FROM part")
def ml10_model_profiles(spark: SparkSession, d: str) -> DataFrame:
    prompts = b.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"), F.col("p_type").alias("prompt"))
    return models.profile_companies(prompts, _model_answer, 1)
