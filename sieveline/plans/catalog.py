"""Every query of the engine by name, with SQL for the same rows where SQL can express it."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import discourse, identity, portfolio, previews, series, statistics
from ..sources import files
from . import bindings as b
from . import sqltext
from .registry import oracle_sql, queries, query

__all__ = ["oracle_sql", "queries"]

def _terms(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


PROFILE = portfolio.Profile(custom_esg_mode="prefer_high", market_cap_mode="prefer_large", weighting_mode="score_weighted", max_holding_weight=0.105, size=10, min_posts=20)

COMPANIES = """companies AS (SELECT concat('P', p_partkey) AS symbol, p_name AS company_name, p_brand AS category, p_type AS industry, p_retailprice * 1e6 AS market_cap_numeric,
  row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rank_in_category FROM part),
features AS (SELECT concat('P', l_partkey) AS symbol, count(*) AS posts_count, round(avg(l_discount) * 1000, 2) AS custom_esg_proxy_score, round(avg(l_tax) * 1000, 2) AS profitability_score,
  CASE WHEN count(*) >= 25 THEN round(avg(l_quantity) * 2, 2) END AS technical_score FROM lineitem GROUP BY l_partkey),
master AS (SELECT c.*, coalesce(posts_count, 0) AS posts_count, custom_esg_proxy_score, profitability_score, technical_score FROM companies c LEFT JOIN features f USING (symbol))"""
POSTS = """posts AS (SELECT source AS symbol, cast(doc_id AS VARCHAR) AS message_id, concat('u', doc_id % 37) AS username, text, doc_id FROM documents)"""
_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(text)), 'https?://\S+', ' ', 'g'), '\$[A-Za-z][A-Za-z0-9.\-]*', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '\bbullish\b', ' ', 'g'), '\bbearish\b', ' ', 'g'), '[^a-z\s]', ' ', 'g'), '\s+', ' ', 'g'))"
TOKENS = f"tokens AS (SELECT *, regexp_extract_all({_CLEAN}, '[a-z]{{2,}}') AS tok FROM posts), hits AS (SELECT *, len(list_filter(tok, lambda t: t IN ({_terms(b.POSITIVE)})))::DOUBLE AS pos, len(list_filter(tok, lambda t: t IN ({_terms(b.NEGATIVE)})))::DOUBLE AS neg FROM tokens)"
SENTIMENT = f"WITH {POSTS}, {TOKENS}, raw AS (SELECT *, least(1.0, 0.20 + 0.18 * (pos + neg)) AS conf, (pos - neg) / (pos + neg + 1) * least(1.0, 0.20 + 0.18 * (pos + neg)) AS s FROM hits), scored AS (SELECT *, round(s, 4) AS sentiment_score, CASE WHEN s > 0.2 THEN 'positive' WHEN s < -0.2 THEN 'negative' ELSE 'neutral' END AS sentiment_label, round(conf, 4) AS sentiment_confidence FROM raw)"
MEMBERS = "members AS (SELECT DISTINCT p_brand AS category, concat('S', l_suppkey) AS ticker FROM lineitem JOIN part ON l_partkey = p_partkey)"
METRICS = """m AS (SELECT concat('C', c_custkey) AS symbol, roe, roa, net_margin, operating_margin, revenue_growth FROM customer LEFT JOIN (SELECT o_custkey, round(avg(l_discount), 6) AS roe, round(avg(l_tax), 6) AS roa,
  round(avg(l_quantity), 6) AS net_margin, round(avg(l_extendedprice), 4) AS operating_margin, round(avg(o_totalprice), 4) AS revenue_growth FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey) ON c_custkey = o_custkey)"""
TOPICS = """topics AS (SELECT doc_id, source AS symbol, ((doc_id * 7 + k * 5) % 12)::INTEGER AS topic_id, ((doc_id + k * 3) % 10) / 23 AS weight, (doc_id % 9 - 4) / 4 AS sentiment_score FROM documents, (SELECT unnest([0, 1, 2, 3]) AS k))"""
PRICES = "prices AS (SELECT event_type AS symbol, ts, event_id, value AS c FROM events)"


def _scored_posts(spark: SparkSession, d: str) -> DataFrame:
    p = b.posts(spark, d).withColumn("clean", text.training_text("text"))
    return p.withColumns(rules.lexicon_score("clean", b.POSITIVE, b.NEGATIVE))


def _master(spark: SparkSession, d: str) -> DataFrame:
    universe = b.companies(spark, d).withColumn("instrument_universe", rules.instrument_class("company_name", "industry", "category"))
    return portfolio.master(universe, {"social": b.company_features(spark, d)}, {"posts_count": 0})


# --- identity and text


@query(f"WITH {COMPANIES} SELECT symbol, company_name, category, rank_in_category FROM companies WHERE true QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY rank_in_category, symbol) = 1")
def id2_first_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return identity.first_by(b.companies(spark, d), ["company_name"], F.col("rank_in_category"), F.col("symbol")).select("symbol", "company_name", "category", "rank_in_category")


@query("SELECT conv_id AS id, arg_max(text, length(text) * 1000 - turn) AS text, count(*) AS versions, min(turn) AS first_seen, max(turn) AS last_seen FROM conversations GROUP BY conv_id")
def id6_upsert_messages(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text", F.col("turn").alias("_ord"))
    return identity.upsert_messages(c)


@query("SELECT n_nationkey::BIGINT AS k, s_name AS matched, 1::BIGINT AS hits, 'matched' AS status FROM (SELECT n_nationkey, min(s_suppkey) AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) JOIN supplier ON s = s_suppkey")
def id4_match_candidates(spark: SparkSession, d: str) -> DataFrame:
    s = b.read(spark, d, "supplier")
    rows = s.groupBy(F.col("s_nationkey").cast("long").alias("k")).agg(F.min_by("s_name", "s_suppkey").alias("c")).withColumn("cands", F.array(F.concat(F.lit("x"), "c"), F.col("c")))
    return identity.match_candidates(rows, s, "k", "cands", "s_name")


@query("WITH m AS (SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0) SELECT count(*) AS n_unique, count(m.s_name) AS n_matched, count(*) - count(m.s_name) AS n_unmatched, 0::BIGINT AS n_ambiguous, round(count(m.s_name) / count(*), 4) AS match_rate FROM supplier s LEFT JOIN m ON s.s_name = m.s_name")
def id5_match_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = b.read(spark, d, "supplier")
    rows = s.select("s_suppkey", F.array("s_name").alias("cands"))
    return identity.match_statistics(identity.match_candidates(rows, s.where("s_acctbal > 0"), "s_suppkey", "cands", "s_name"))


@query(f"WITH {POSTS} SELECT doc_id, {_CLEAN} AS clean, length(text) AS text_length, trim(text) = '' AS is_text_empty FROM posts")
def tx1_training_text(spark: SparkSession, d: str) -> DataFrame:
    return b.posts(spark, d).select("doc_id", text.training_text("text").alias("clean"), F.length("text").cast("long").alias("text_length"), (F.trim("text") == "").alias("is_text_empty"))


@query(f"SELECT doc_id, {sqltext.topic('text')} AS clean FROM documents")
def tx2_topic_text(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "documents").select("doc_id", text.topic_text("text").alias("clean"))


@query("WITH t AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: NOT w IN ('the', 'that', 'with')) AS w FROM documents) SELECT doc_id, array_to_string(w, ' ') AS informative FROM t WHERE len(w) >= 3")
def tx4_informative_text(spark: SparkSession, d: str) -> DataFrame:
    t = b.read(spark, d, "documents").select("doc_id", text.informative_text(F.lower("text"), ["the", "that", "with"]).alias("informative"))
    return t.where(F.size(F.split("informative", " ")) >= 3)


@query("SELECT s_suppkey, round(abs(s_acctbal), 2) * CASE s_suppkey % 4 WHEN 0 THEN 1e3 WHEN 1 THEN 1e6 WHEN 2 THEN 1e9 ELSE 1e12 END AS cap FROM supplier")
def tx6_market_cap(spark: SparkSession, d: str) -> DataFrame:
    s = b.read(spark, d, "supplier")
    unit = F.element_at(F.array(*[F.lit(u) for u in "KMBT"]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return s.select("s_suppkey", text.market_cap(F.concat(F.lit("$"), F.format_number(F.abs("s_acctbal"), 2), F.lit(" "), unit)).alias("cap"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS ratio FROM customer")
def tx7_ratio(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "customer").select("c_custkey", F.format_string("%.2f", "c_acctbal").alias("t"))
    t = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("1,"), F.replace("t", F.lit("."), F.lit(","))))
    return c.select("c_custkey", text.ratio(F.coalesce(t, F.concat(F.replace("t", F.lit("."), F.lit(",")), F.lit("%")))).alias("ratio"))


@query(r"SELECT doc_id, CASE WHEN length(t) > 180 THEN rtrim(substr(t, 1, 179)) || '…' ELSE t END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)")
def tx9_snippet(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "documents").select("doc_id", text.snippet("text").alias("snippet"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def tx14_json_object(spark: SparkSession, d: str) -> DataFrame:
    e = b.read(spark, d, "events").withColumn("answer", F.concat(F.lit("sure: "), "props", F.lit(" done")))
    return e.select("event_id", F.from_json(text.json_object_text("answer"), "k long")["k"].alias("k"))


# --- filters and rules


@query(f"WITH t AS (SELECT doc_id, list_distinct(string_split_regex(lower(text), '[ \\t\\n\\f\\r]+')) AS w FROM documents), s AS (SELECT doc_id, list_sort(list_filter([{_terms(b.STEMS)}], lambda x: len(list_filter(w, lambda y: starts_with(y, x))) > 0)) AS m FROM t) SELECT doc_id, array_to_string(m, ',') AS stems FROM s WHERE len(m) > 0")
def fl1_seed_filter(spark: SparkSession, d: str) -> DataFrame:
    t = b.read(spark, d, "documents").select("doc_id", rules.seed_matches("text", b.STEMS).alias("m"))
    return t.where(F.size("m") > 0).select("doc_id", F.array_join("m", ",").alias("stems"))


@query("WITH c AS (SELECT list(x ORDER BY i) AS v FROM (SELECT i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE label = 1 GROUP BY i)), s AS (SELECT vec_id, list_inner_product(embedding::DOUBLE[], v) / (sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_inner_product(v, v))) AS s FROM embeddings, c) SELECT vec_id, round(s, 5) AS score FROM s WHERE s >= 0.16")
def fl3_embedding_filter(spark: SparkSession, d: str) -> DataFrame:
    e = b.read(spark, d, "embeddings")
    mean = e.where("label = 1").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    concept = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda r: r["x"]).alias("v"))  # one row of the vectors' width
    s = e.crossJoin(F.broadcast(concept)).select("vec_id", rules.cosine("embedding", "v").alias("s"))
    return s.where("s >= 0.16").select("vec_id", F.round("s", 5).alias("score"))


@query("SELECT count(*) AS total, count(*) FILTER (text LIKE '%that%') AS passed, round(avg((text LIKE '%that%')::INTEGER), 4) AS ratio FROM documents")
def fl4_filter_coverage(spark: SparkSession, d: str) -> DataFrame:
    hit = F.contains("text", F.lit("that"))
    return b.read(spark, d, "documents").agg(F.count("*").alias("total"), F.count_if(hit).alias("passed"), F.round(F.avg(hit.cast("int")), 4).alias("ratio"))


@query(f"WITH {COMPANIES} SELECT symbol, posts_count, technical_score FROM master WHERE posts_count >= 20 AND coalesce(technical_score >= 50, true) AND coalesce(profitability_score >= 40, false)")
def fl8_dimension_filters(spark: SparkSession, d: str) -> DataFrame:
    p = portfolio.Profile(min_posts=20, bounds={"technical_score": (50, None, True), "profitability_score": (40, None, False)})
    return portfolio.candidates(_master(spark, d), p).select("symbol", "posts_count", "technical_score")


@query(r"SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'crypto_coin' WHEN s_suppkey % 7 = 1 THEN 'reit' WHEN s_suppkey % 7 = 2 THEN 'fund_etf_trust' WHEN s_suppkey % 7 IN (3, 4) THEN 'ambiguous' ELSE 'common_equity' END AS cls FROM supplier")
def cl1_instrument_class(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey") % 7
    name = F.when(k == 2, "Alpha Index Fund").when(k == 3, "Beta Acquisition Corp").otherwise(F.col("s_name"))
    industry = F.when(k == 1, "Real Estate Investment Trusts").when(k == 4, "-").otherwise("Software")
    href = F.when(k == 0, "/coins/x").otherwise("/stocks/x")
    return b.read(spark, d, "supplier").select("s_suppkey", rules.instrument_class(name, industry, F.lit("Tech"), href).alias("cls"))


@query(r"SELECT doc_id, CASE WHEN p AND NOT n THEN 'positive' WHEN n AND NOT p THEN 'negative' END AS explicit FROM (SELECT doc_id, regexp_matches(lower(text), '\bthat\b') AS p, regexp_matches(lower(text), '\bwith\b') AS n FROM documents)")
def cl2_explicit_label(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "documents").select("doc_id", rules.explicit_label("text", "that", "with").alias("explicit"))


@query("SELECT p_partkey, round(least(1.0, greatest(0.0, 0.5 - CASE WHEN contains(lower(p_type), 'a') THEN 0.2 ELSE 0 END + CASE WHEN contains(lower(p_type), 'e') THEN 0.2 ELSE 0 END)), 4)::DOUBLE AS prior FROM part")
def cl3_category_prior(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "part").select("p_partkey", F.round(rules.category_prior("p_type", ("a",), ("e",)), 4).alias("prior"))


@query(f"{SENTIMENT} SELECT doc_id, sentiment_score, sentiment_label, sentiment_confidence FROM scored")
def cl4_lexicon_sentiment(spark: SparkSession, d: str) -> DataFrame:
    return _scored_posts(spark, d).select("doc_id", "sentiment_score", "sentiment_label", "sentiment_confidence")


# --- aggregates


@query(f"{SENTIMENT} SELECT symbol, count(*) AS posts_count, count(*) FILTER (trim(text) <> '') AS text_posts_count, count(DISTINCT username) AS authors_count, round(sum(sentiment_score::DECIMAL(18,4))::DOUBLE / count(sentiment_score), 4) AS avg_sentiment, round(count(*) FILTER (sentiment_label = 'positive') / count(*), 4) AS positive_share, round(count(*) FILTER (sentiment_label = 'negative') / count(*), 4) AS negative_share, round(count(*) FILTER (sentiment_label = 'neutral') / count(*), 4) AS neutral_share FROM scored GROUP BY symbol")
def ag1_company_social(spark: SparkSession, d: str) -> DataFrame:
    return discourse.company_social(_scored_posts(spark, d))


@query(f"{SENTIMENT}, a AS (SELECT symbol, count(*) AS n, count(DISTINCT username) AS u, round(sum(sentiment_score::DECIMAL(18,4))::DOUBLE / count(sentiment_score), 4) AS s, round(count(*) FILTER (sentiment_label = 'positive') / count(*), 4) AS p, round(count(*) FILTER (sentiment_label = 'negative') / count(*), 4) AS g FROM scored GROUP BY symbol) SELECT symbol, round(4 * p * g, 4) AS controversy_score, round(least(1.0, ln(1 + n) / ln(41)), 4) AS coverage_score, round(least(1.0, 3 * u / n), 4) AS author_diversity_score, round(100 * (0.45 * (s + 1) / 2 + 0.25 * (1 - 4 * p * g) + 0.20 * 0.5 + 0.10 * least(1.0, ln(1 + n) / ln(41))), 2) AS custom_esg_proxy_score FROM a")
def ag2_social_scores(spark: SparkSession, d: str) -> DataFrame:
    c = discourse.company_social(_scored_posts(spark, d)).withColumn("sector_norm_prior", F.lit(0.5))
    return discourse.social_scores(c).select("symbol", "controversy_score", "coverage_score", "author_diversity_score", "custom_esg_proxy_score")


@query(f"WITH {TOPICS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, topic_id) AS rn FROM topics WHERE weight >= 0.08), t AS (SELECT * FROM r WHERE rn <= 3), e AS (SELECT topic_id, list(doc_id ORDER BY doc_id) AS ex FROM (SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY weight DESC, doc_id) AS k FROM t) WHERE k <= 3 GROUP BY topic_id) SELECT topic_id, round(sum(weight), 6) AS corpus_weight, count(*) AS posts_with_topic, round(sum(weight * sentiment_score) / sum(weight), 4) AS average_sentiment, array_to_string(any_value(ex), ',') AS examples FROM t JOIN e USING (topic_id) GROUP BY topic_id")
def ag5_topic_summary(spark: SparkSession, d: str) -> DataFrame:
    return discourse.topic_summary(b.topic_weights(spark, d)).withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


@query(f"WITH {TOPICS}, g AS (SELECT symbol, topic_id, sum(weight::DECIMAL(38, 12)) AS exact, count(*) AS n, sum((weight * sentiment_score)::DECIMAL(38, 12))::DOUBLE / sum(weight::DECIMAL(38, 12))::DOUBLE AS s FROM topics WHERE weight >= 0.05 GROUP BY ALL), h AS (SELECT *, exact::DOUBLE AS w, (sum(exact) OVER (PARTITION BY symbol))::DOUBLE AS total FROM g) SELECT symbol, topic_id, round(w, 4) AS topic_weight_sum, n AS posts_with_topic, round(s, 4) AS avg_sentiment, round(w / total, 6) AS topic_share, round(w / total * s, 6) AS signed_topic_score FROM h")
def ag6_company_topics(spark: SparkSession, d: str) -> DataFrame:
    return discourse.company_topics(b.topic_weights(spark, d))


@query("WITH e AS (SELECT vec_id % 20 AS symbol, label FROM embeddings) SELECT symbol, count(*) AS post_count, count(*) FILTER (label IN (1, 2, 3)) AS axiological_count, round(count(*) FILTER (label IN (1, 2, 3)) / count(*), 4) AS axiological_coverage FROM e GROUP BY symbol")
def ag7_topic_exposure(spark: SparkSession, d: str) -> DataFrame:
    v = b.vectors(spark, d).withColumn("symbol", F.col("doc_id") % 20)
    return discourse.topic_exposure(v, [1, 2, 3]).drop("topic_exposure")


@query(f"WITH {MEMBERS} SELECT ticker, count(*)::INTEGER AS categories, string_agg(category, ',' ORDER BY category) AS slugs FROM members GROUP BY ticker HAVING count(*) >= 2")
def ag16_shared_tickers(spark: SparkSession, d: str) -> DataFrame:
    return discourse.shared_tickers(b.members(spark, d))


@query("SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS source FROM orders GROUP BY o_custkey")
def ag17_latest_values(spark: SparkSession, d: str) -> DataFrame:
    o = b.read(spark, d, "orders").withColumnRenamed("o_orderpriority", "source")
    return identity.latest_values(o, "o_custkey", ["source"], "o_orderkey")


@query("WITH c AS (SELECT p_brand AS category, count(*) AS listed, count(*) FILTER (p_size < 25) AS matched FROM part GROUP BY 1), a AS (SELECT * FROM c UNION ALL SELECT NULL, sum(listed)::BIGINT, sum(matched)::BIGINT FROM c) SELECT category, listed, matched, round(matched / listed, 4) AS rate FROM a")
def ag19_merge_report(spark: SparkSession, d: str) -> DataFrame:
    p = b.read(spark, d, "part").withColumn("category", F.col("p_brand"))
    return discourse.merge_report(p.where("p_size < 25"), p)


@query(f"{SENTIMENT}, f AS (SELECT DISTINCT symbol, unnest(['that which', 'keit']) AS label FROM scored) SELECT symbol, label, count(*) AS n_posts, round(sum(sentiment_score::DECIMAL(18,4))::DOUBLE / count(sentiment_score), 4) AS sentiment FROM f JOIN scored USING (symbol) WHERE contains(lower(text), CASE label WHEN 'keit' THEN 'keit' ELSE 'that' END) OR (label <> 'keit' AND contains(lower(text), 'which')) GROUP BY ALL")
def ag20_frame_sentiment(spark: SparkSession, d: str) -> DataFrame:
    p = _scored_posts(spark, d)
    frames = p.select("symbol").distinct().select("symbol", F.explode(F.array(F.lit("that which"), F.lit("keit"))).alias("label"))
    return discourse.frame_sentiment(frames, p.select("symbol", "text", "sentiment_score"))


# --- joins


@query(f"WITH {COMPANIES} SELECT * FROM master")
def jn1_company_master(spark: SparkSession, d: str) -> DataFrame:
    return _master(spark, d).drop("instrument_universe")


@query(f"WITH {COMPANIES}, r AS (SELECT symbol, max(p_size)::DOUBLE AS v FROM (SELECT concat('P', p_partkey % 500) AS symbol, p_size FROM part) GROUP BY 1), n AS (SELECT symbol, arg_max(v, o) AS v FROM (SELECT concat('P', p_partkey % 500) AS symbol, p_size::DOUBLE AS v, p_partkey AS o FROM part) GROUP BY 1) SELECT m.symbol, coalesce(n.v, m.technical_score) AS technical_score FROM master m LEFT JOIN n USING (symbol)")
def jn7_merge_raw(spark: SparkSession, d: str) -> DataFrame:
    raw = b.read(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey") % 500).alias("symbol"), F.col("p_size").cast("double").alias("technical_score"), F.col("p_partkey").alias("_ord"))
    return identity.merge_raw(_master(spark, d), raw, ["technical_score"])[0].select("symbol", "technical_score")


@query(f"WITH {MEMBERS} SELECT x.category AS a, y.category AS b, count(*) AS shared, array_to_string(list_sort(list(x.ticker))[1:5], ',') AS sample FROM members x JOIN members y ON x.ticker = y.ticker AND x.category < y.category GROUP BY 1, 2")
def jn9_category_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return discourse.category_overlaps(b.members(spark, d), 5)


# --- statistics and windows


def _bounds_sql(ms: tuple[str, ...]) -> str:
    parts = [f"quantile_cont({m}, 0.1) AS {m}_a, quantile_cont({m}, 0.9) AS {m}_b, min({m}) AS {m}_c, max({m}) AS {m}_d" for m in ms]
    out = [f"CASE WHEN {m}_a <> {m}_b THEN {m}_a WHEN {m}_c <> {m}_d THEN {m}_c END AS {m}_low, CASE WHEN {m}_a <> {m}_b THEN {m}_b WHEN {m}_c <> {m}_d THEN {m}_d END AS {m}_high" for m in ms]
    return f"q AS (SELECT {', '.join(parts)} FROM m), bounds AS (SELECT {', '.join(out)} FROM q)"


_MS = tuple(statistics.PROFITABILITY)
_NORM = {m: f"least(1.0, greatest(0.0, ({m} - {m}_low) / ({m}_high - {m}_low)))" for m in _MS}


@query(f"WITH {METRICS}, {_bounds_sql(_MS)} SELECT {', '.join(f'round({m}_{e}, 6) AS {m}_{e}' for m in _MS for e in ('low', 'high'))} FROM bounds")
def wn2_metric_bounds(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.metric_bounds(b.metrics(spark, d), list(_MS))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"WITH {METRICS}, {_bounds_sql(_MS)}, n AS (SELECT symbol, {', '.join(f'CASE WHEN {m} IS NOT NULL THEN {_NORM[m]} END AS n_{m}' for m in _MS)} FROM m, bounds), s AS (SELECT symbol, {' + '.join(f'coalesce({w} * n_{m}, 0)' for m, w in statistics.PROFITABILITY.items())} AS got, {' + '.join(f'CASE WHEN n_{m} IS NOT NULL THEN {w} ELSE 0 END' for m, w in statistics.PROFITABILITY.items())} AS have, {' + '.join(f'(n_{m} IS NOT NULL)::INTEGER' for m in _MS)} AS k FROM n) SELECT symbol, CASE WHEN have > 0 THEN round(100 * got / have, 4) END AS profitability_score, round(have::DOUBLE, 4) AS profitability_completeness, k AS profitability_metric_count FROM s")
def wn4_profitability_scores(spark: SparkSession, d: str) -> DataFrame:
    return statistics.score_metrics(b.metrics(spark, d), statistics.PROFITABILITY, prefix="profitability").select("symbol", "profitability_score", "profitability_completeness", "profitability_metric_count")


_AXES = "x AS (SELECT concat('P', l_partkey) AS symbol, l_linenumber AS axis_id, round(avg(l_discount), 6) AS raw, round(avg(l_tax) * 5, 6) AS exposure, count(*) AS posts FROM lineitem GROUP BY 1, 2)"


_SHRUNK = "p AS (SELECT *, CASE WHEN min(raw) OVER k = max(raw) OVER k THEN 50.0 ELSE (rank() OVER (PARTITION BY axis_id ORDER BY raw) - 1 + 0.5 * count(*) OVER (PARTITION BY axis_id, raw)) / count(*) OVER k * 100 END AS pct, least(1.0, ln(1 + posts) / ln(16)) * least(1.0, 0.2 + 0.8 * least(1.0, 3.5 * exposure)) AS conf FROM x WINDOW k AS (PARTITION BY axis_id)), shrunk AS (SELECT symbol, axis_id, exposure, round(conf, 4) AS confidence, round(50 + conf * (pct - 50), 2) AS axis_score FROM p)"


@query(f"WITH {_AXES}, p AS (SELECT *, CASE WHEN min(raw) OVER k = max(raw) OVER k THEN 50.0 ELSE (rank() OVER (PARTITION BY axis_id ORDER BY raw) - 1 + 0.5 * count(*) OVER (PARTITION BY axis_id, raw)) / count(*) OVER k * 100 END AS pct, least(1.0, ln(1 + posts) / ln(16)) * least(1.0, 0.2 + 0.8 * least(1.0, 3.5 * exposure)) AS conf FROM x WINDOW k AS (PARTITION BY axis_id)) SELECT symbol, axis_id, round(pct, 4) AS percentile, round(conf, 4) AS confidence, round(50 + conf * (pct - 50), 2) AS axis_score FROM p")
def wn6_axis_scores(spark: SparkSession, d: str) -> DataFrame:
    return statistics.shrunk_axis_scores(b.axis_scores(spark, d)).select("symbol", "axis_id", F.round("percentile", 4).alias("percentile"), "confidence", "axis_score")


@query(f"WITH {PRICES} SELECT symbol, event_id, CASE WHEN row_number() OVER w >= 20 THEN round(avg(c) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS 19 PRECEDING), 5) END AS ma20, CASE WHEN row_number() OVER w >= 50 THEN round(avg(c) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS 49 PRECEDING), 5) END AS ma50 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)")
def wn8_moving_averages(spark: SparkSession, d: str) -> DataFrame:
    p = series.moving_average(b.prices(spark, d), 20, "ma20", ["ts", "event_id"])
    p = series.moving_average(p, 50, "ma50", ["ts", "event_id"])
    return p.select("symbol", "event_id", F.round("ma20", 5).alias("ma20"), F.round("ma50", 5).alias("ma50"))


_INDICATORS = f"""WITH RECURSIVE {PRICES}, s AS MATERIALIZED (SELECT symbol, event_id, c, row_number() OVER w - 1 AS i, greatest(c - lag(c) OVER w, 0) AS up, greatest(lag(c) OVER w - c, 0) AS down
  FROM prices WHERE c IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)),
r AS (SELECT symbol, event_id, i, c AS e12, c AS e26, 0.0::DOUBLE AS sig, 0.0::DOUBLE AS g, 0.0::DOUBLE AS l FROM s WHERE i = 0 UNION ALL
  SELECT s.symbol, s.event_id, s.i, e12 * 11 / 13 + c * 2 / 13, e26 * 25 / 27 + c * 2 / 27, sig * 0.8::DOUBLE + ((e12 * 11 / 13 + c * 2 / 13) - (e26 * 25 / 27 + c * 2 / 27)) * 0.2::DOUBLE,
    CASE WHEN s.i <= 14 THEN g + up / 14 ELSE (g * 13 + up) / 14 END, CASE WHEN s.i <= 14 THEN l + down / 14 ELSE (l * 13 + down) / 14 END
  FROM r JOIN s ON s.symbol = r.symbol AND s.i = r.i + 1)
SELECT symbol, event_id, round(e12, 6) AS ema12, round(e26, 6) AS ema26, CASE WHEN i >= 25 THEN round(e12 - e26, 6) END AS macd, CASE WHEN i >= 25 THEN round(sig, 6) END AS macd_signal,
  CASE WHEN i >= 25 THEN round(e12 - e26 - sig, 6) END AS macd_hist, CASE WHEN i >= 14 THEN round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) END AS rsi14 FROM r"""


@query(_INDICATORS)
def wn9_wn11_indicators(spark: SparkSession, d: str) -> DataFrame:
    made = series.indicators(b.prices(spark, d), ["ts", "event_id"])
    return made.select("symbol", "event_id", *[F.round(c, 6).alias(c) for c in ("ema12", "ema26", "macd", "macd_signal", "macd_hist", "rsi14")])


@query(f"WITH {PRICES}, r AS (SELECT *, lag(c, 1) OVER w AS p1, lag(c, 30) OVER w AS b30, lag(c, 90) OVER w AS b90, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS late FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY ts, event_id)), s AS (SELECT *, CASE WHEN p1 <> 0 THEN c / p1 - 1 END AS ret FROM r), t AS (SELECT *, CASE WHEN ret IS NOT NULL THEN count(ret) OVER (PARTITION BY symbol ORDER BY late) END AS nth, max(CASE WHEN late <= 90 THEN c END) OVER (PARTITION BY symbol ORDER BY late DESC) AS peak FROM s) SELECT symbol, round(max(CASE WHEN late = 1 AND b30 <> 0 THEN c / b30 - 1 END), 6) AS momentum_30d, round(max(CASE WHEN late = 1 AND b90 <> 0 THEN c / b90 - 1 END), 6) AS momentum_90d, round(CASE WHEN count(*) FILTER (nth <= 30) >= 30 THEN stddev_pop(ret) FILTER (nth <= 30) END, 6) AS volatility_30d, round(max(CASE WHEN late <= 90 AND peak > 0 THEN 1 - c / peak END), 6) AS drawdown_90d FROM t GROUP BY symbol")
def wn12_wn14_technicals(spark: SparkSession, d: str) -> DataFrame:
    return series.technicals(b.prices(spark, d), ["ts", "event_id"])


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) SELECT l_orderkey, l_linenumber, l_extendedprice, rn::INTEGER AS rn FROM r WHERE rn <= 2")
def wn16_top_k(spark: SparkSession, d: str) -> DataFrame:
    return statistics.top_k(b.read(spark, d, "lineitem"), ["l_orderkey"], 2, F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).select("l_orderkey", "l_linenumber", "l_extendedprice", "rn")


@query()
def wn17_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    return statistics.stratified_sample(b.companies(spark, d), "category", "symbol", 50, 42).select("symbol", "category", "turn")


@query("WITH n AS (SELECT count(*) AS n FROM lineitem), t AS (SELECT unnest([0.02, 0.05, 0.08]) AS t) SELECT t::DOUBLE AS threshold, count(*) FILTER (l_discount >= t) AS passed, round(count(*) FILTER (l_discount >= t) / count(*), 4) AS rate FROM lineitem, t GROUP BY t")
def wn18_threshold_table(spark: SparkSession, d: str) -> DataFrame:
    return statistics.threshold_table(b.read(spark, d, "lineitem"), "l_discount", [0.02, 0.05, 0.08])


# --- portfolio

_W = portfolio.normal_weights(PROFILE.weights)


def _selection(weights: dict[str, float]) -> str:
    return " + ".join(f"{k} * {v!r}" for k, v in weights.items())


_SCORED = f"""c AS (SELECT *, round(0.45 * (1 / sqrt(rank_in_category)) + 0.35 * least(posts_count / 40, 1.0) + 0.20 * CASE WHEN market_cap_numeric > 0 THEN least(log10(market_cap_numeric) / 12, 1.0) ELSE 0 END, 4) AS base_quality,
  round(CASE WHEN custom_esg_proxy_score IS NULL THEN 0 ELSE least(1.0, greatest(0.0, custom_esg_proxy_score / 100)) END, 4) AS esg_alignment, 1.0 AS category_match,
  CASE WHEN profitability_score IS NULL THEN 0 ELSE least(1.0, greatest(0.0, profitability_score / 100)) END AS profitability_alignment,
  CASE WHEN technical_score IS NULL THEN 0 ELSE least(1.0, greatest(0.0, technical_score / 100)) END AS technical_alignment,
  CASE WHEN market_cap_numeric IS NULL THEN 0 ELSE least(1.0, greatest(0.0, log10(greatest(market_cap_numeric, 1.0)) / 12)) END AS market_cap_alignment FROM master WHERE posts_count >= {PROFILE.min_posts}),
scored AS (SELECT *, round({_selection(_W)}, 4) AS selection_score FROM c)"""
_PICK = f"""r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY selection_score DESC, symbol) AS cr FROM scored),
seeds AS (SELECT symbol FROM r WHERE cr = 1 ORDER BY selection_score DESC, symbol LIMIT {PROFILE.min_categories}),
ph AS (SELECT *, CASE WHEN symbol IN (SELECT symbol FROM seeds) THEN 0 WHEN cr <= {PROFILE.max_per_category} THEN 1 ELSE 2 END AS phase FROM r),
picked AS (SELECT *, row_number() OVER (ORDER BY phase, selection_score DESC, symbol) AS position FROM ph QUALIFY position <= {PROFILE.size}),
k AS (SELECT *, row_number() OVER (ORDER BY selection_score DESC, position) - 1 AS k, sum(selection_score) OVER (ORDER BY selection_score DESC, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM picked),
f AS (SELECT *, min(CASE WHEN (1 - k * {PROFILE.max_holding_weight}) * selection_score / rest <= {PROFILE.max_holding_weight} + 1e-9 THEN k END) OVER () AS capped FROM k),
w AS (SELECT *, round(CASE WHEN k < capped THEN {PROFILE.max_holding_weight} ELSE (1 - capped * {PROFILE.max_holding_weight}) * selection_score / max(CASE WHEN k = capped THEN rest END) OVER () END, 4) AS w0 FROM f),
holdings AS (SELECT *, round(w0 + CASE WHEN position = 1 THEN round(1 - sum(w0) OVER (), 4) ELSE 0 END, 4) AS weight FROM w)"""


@query(f"WITH {COMPANIES}, {_SCORED} SELECT symbol, category, base_quality, esg_alignment, round(market_cap_alignment, 6) AS market_cap_alignment, selection_score FROM scored")
def pf8_selection_scores(spark: SparkSession, d: str) -> DataFrame:
    s = portfolio.scored(portfolio.candidates(_master(spark, d), PROFILE), PROFILE)
    return s.select("symbol", "category", "base_quality", "esg_alignment", F.round("market_cap_alignment", 6).alias("market_cap_alignment"), "selection_score")


@query(f"WITH {COMPANIES}, {_SCORED}, {_PICK} SELECT symbol, category, selection_score, position::INTEGER AS position, weight FROM holdings")
def pf_holdings(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.preview(_master(spark, d), PROFILE).select("symbol", "category", "selection_score", "position", "weight")


@query(f"WITH {COMPANIES}, {_SCORED}, {_PICK} SELECT category, round(sum(weight), 4) AS weight, count(*) AS holdings, round(avg(selection_score), 4) AS mean_score FROM holdings GROUP BY category")
def ag12_allocations(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.allocations(portfolio.preview(_master(spark, d), PROFILE))


@query(f"WITH {COMPANIES}, {_SCORED}, {_PICK} SELECT count(*) AS holdings, round(sum(weight), 4) AS total_weight, round(sum(weight * weight), 4) AS hhi, max(weight) AS max_weight, count(DISTINCT category) AS categories, {', '.join(f'round(sum({c} * weight) / sum(CASE WHEN {c} IS NOT NULL THEN weight END), 4) AS avg_{c}' for c in ('selection_score', 'custom_esg_proxy_score', 'profitability_score', 'technical_score'))} FROM holdings")
def pf13_summary(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.summary(portfolio.preview(_master(spark, d), PROFILE))


SELECTED = dataclasses.replace(PROFILE, categories=("Brand#11", "Brand#23", "Brand#45"))


def _previewed(name: str, scored: str) -> str:
    return f"""SELECT * FROM (WITH {COMPANIES}, {scored}, {_PICK}, a AS (SELECT category, sum(weight) AS w, min(position) AS first FROM holdings GROUP BY category)
SELECT '{name}' AS profile, (SELECT count(*) FROM scored) AS matched, string_agg(symbol || ':' || weight, ',' ORDER BY position) AS holdings, count(*) AS n, round(sum(weight * weight), 4) AS hhi, max(weight) AS max_weight, (SELECT category FROM a ORDER BY round(w, 4) DESC, first LIMIT 1) AS top_category FROM holdings)"""


_IN_SELECTED = _SCORED.replace(f"WHERE posts_count >= {PROFILE.min_posts}", f"WHERE posts_count >= {PROFILE.min_posts} AND category IN ({_terms(SELECTED.categories)})")


@query(f"{_previewed('all', _SCORED)} UNION ALL {_previewed('selected', _IN_SELECTED)}")
def pf17_previews(spark: SparkSession, d: str) -> DataFrame:
    made = previews.previews(_master(spark, d), {"all": PROFILE, "selected": SELECTED})
    shown = F.array_join(F.transform("holdings", lambda h: F.concat(h["symbol"], F.lit(":"), h["weight"].cast("string"))), ",")
    return made.select("profile", "matched", shown.alias("holdings"), "summary.n", "summary.hhi", "summary.max_weight", "summary.top_category")


@query(f"WITH {COMPANIES}, m AS (SELECT *, CASE WHEN posts_count > 1000000 THEN technical_score END AS t FROM master), n AS (SELECT count(t) = 0 AS gone FROM m) SELECT 'asks' AS profile, CASE WHEN gone THEN 'no_technical_metrics' ELSE '' END AS warnings FROM n UNION ALL SELECT 'neutral', 'ambiguous_universe' FROM n")
def cl12_warnings(spark: SparkSession, d: str) -> DataFrame:
    m = _master(spark, d).withColumn("technical_score", F.when(F.col("posts_count") > 1_000_000, F.col("technical_score")))
    neutral = dataclasses.replace(PROFILE, technical_mode="neutral", universes=("common_equity", "ambiguous"))
    return previews.previews(m, {"asks": PROFILE, "neutral": neutral}).select("profile", F.array_join("warnings", ",").alias("warnings"))


_OTHER = _SCORED.replace(_selection(_W), _selection(portfolio.normal_weights(portfolio.BENCHMARK_WEIGHTS)))
_MEANS = ", ".join(f"round(sum({c} * weight) / sum(CASE WHEN {c} IS NOT NULL THEN weight END), 4) AS avg_{c}" for c in ("custom_esg_proxy_score", "profitability_score"))


@query(f"WITH {COMPANIES}, base AS (WITH {_SCORED}, {_PICK} SELECT * FROM holdings), other AS (WITH {_OTHER}, {_PICK} SELECT * FROM holdings), a AS (SELECT count(*) AS n, round(sum(weight * weight), 4) AS hhi, {_MEANS} FROM base), b AS (SELECT round(sum(weight * weight), 4) AS hhi, {_MEANS} FROM other), o AS (SELECT count(*) AS overlap FROM base WHERE symbol IN (SELECT symbol FROM other)) SELECT overlap, round(overlap / n, 4) AS overlap_ratio, round(a.hhi - b.hhi, 4) AS delta_hhi, round(a.avg_custom_esg_proxy_score - b.avg_custom_esg_proxy_score, 4) AS delta_avg_custom_esg_proxy_score, round(a.avg_profitability_score - b.avg_profitability_score, 4) AS delta_avg_profitability_score FROM a, b, o")
def pf15_comparison(spark: SparkSession, d: str) -> DataFrame:
    m = _master(spark, d)
    return portfolio.comparison(portfolio.preview(m, PROFILE), portfolio.preview(m, portfolio.benchmark_profile(PROFILE)))


@query(f"WITH {_AXES}, {_SHRUNK}, t AS (SELECT *, least(1.0, greatest(0.0, axis_score / 100)) AS x, CASE axis_id WHEN 1 THEN 0.8 WHEN 2 THEN 0.4 ELSE 0.5 END AS imp, least(1.0, exposure) AS e FROM shrunk WHERE axis_id <= 3), v AS (SELECT *, CASE WHEN axis_id < 3 THEN imp * (0.25 + 0.75 * confidence) * (0.20 + 0.80 * e) END AS w, CASE WHEN axis_id = 2 THEN 1 - x ELSE x END AS good FROM t) SELECT symbol, round(sum(good * w) / sum(w), 4) AS axis_component, count(w) AS match_count, round(sum(e * imp) / sum(imp), 4) AS perception FROM v GROUP BY symbol")
def pf5_axis_alignment(spark: SparkSession, d: str) -> DataFrame:
    axes = statistics.shrunk_axis_scores(b.axis_scores(spark, d)).withColumnRenamed("axis_score", "score")
    prefs = (portfolio.AxisPreference(1, "prefer_high", 0.8), portfolio.AxisPreference(2, "prefer_low", 0.4), portfolio.AxisPreference(3, "neutral", 0.5))
    a = portfolio.axis_alignment(axes, prefs)
    return a.select("symbol", F.round("axis_component", 4).alias("axis_component"), "match_count", "perception")


@query(f"WITH {COMPANIES} SELECT symbol, posts_count, rank_in_category FROM master WHERE posts_count >= 10 AND technical_score IS NULL ORDER BY posts_count DESC, rank_in_category, symbol LIMIT 100")
def pf20_worklist(spark: SparkSession, d: str) -> DataFrame:
    return portfolio.worklist(_master(spark, d), "technical_score", 10, 100).select("symbol", "posts_count", "rank_in_category")


@query()
def pf21_redundant_categories(spark: SparkSession, d: str) -> DataFrame:
    return discourse.redundant_categories(b.members(spark, d))


# --- evaluation and sets


@query("WITH r AS (SELECT quality AS i, toxic AS j, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT sum(n) AS t FROM r), a AS (SELECT i, sum(n) AS ri FROM r GROUP BY i), c AS (SELECT j, sum(n) AS cj FROM r GROUP BY j) SELECT sum(coalesce(n, 0))::BIGINT AS n, round(sum(CASE WHEN i = j THEN coalesce(n, 0) ELSE 0 END) / max(t), 4) AS exact, round(sum(CASE WHEN abs(i - j) <= 1 THEN coalesce(n, 0) ELSE 0 END) / max(t), 4) AS within_one, round(1 - sum((i <> j)::INTEGER * coalesce(n, 0)) / sum((i <> j)::INTEGER * ri * cj / t), 4) AS kappa, round(1 - sum(abs(i - j) * coalesce(n, 0)) / sum(abs(i - j) * ri * cj / t), 4) AS kappa_linear, round(1 - sum((i - j) ** 2 * coalesce(n, 0)) / sum((i - j) ** 2 * ri * cj / t), 4) AS kappa_quadratic FROM a CROSS JOIN c CROSS JOIN t LEFT JOIN r USING (i, j)")
def ev2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return statistics.agreement(b.read(spark, d, "labels"), "quality", "toxic")


@query("SELECT i::INTEGER AS i, count(*) FILTER (toxic = 0) AS c0, count(*) FILTER (toxic = 1) AS c1, 0::BIGINT AS c2, 0::BIGINT AS c3 FROM (SELECT unnest([0, 1, 2, 3]) AS i) LEFT JOIN labels ON quality = i GROUP BY i")
def ev3_confusion(spark: SparkSession, d: str) -> DataFrame:
    return statistics.confusion(b.read(spark, d, "labels"), "quality", "toxic", 4)


@query("SELECT p::INTEGER AS pos, l AS label, count(lang) AS n FROM (SELECT unnest([0, 1, 2, 3, 4]) AS p, unnest(['en', 'de', 'fr', 'es', 'xx']) AS l) LEFT JOIN documents ON lang = l GROUP BY ALL")
def ev5_distribution(spark: SparkSession, d: str) -> DataFrame:
    return statistics.distribution(b.read(spark, d, "documents"), "lang", ["en", "de", "fr", "es", "xx"])


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def so5_to_do(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return identity.to_do(c, b.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")), "k")


@query()
def fu5_fused_profiles(spark: SparkSession, d: str) -> DataFrame:
    v = b.vectors(spark, d).withColumn("symbol", F.concat(F.lit("s"), F.col("doc_id") % 20))
    parts = {n: discourse.topic_exposure(v, t) for n, t in (("seed", [1]), ("nofilter", [1, 2, 3]), ("embed", [4, 5]))}
    frame = F.struct(F.concat(F.lit("frame "), F.col("doc_id") % 3).alias("label"), F.lit("positive").alias("sentiment"))
    model = v.where("doc_id % 20 < 15").groupBy("symbol").agg(F.count("*").alias("post_count"), F.array_sort(F.collect_set(frame)).alias("frames"), F.max(F.col("doc_id") % 20 == 3).alias("error"))
    return discourse.fuse_profiles(parts, model)




# --- families, fusion formulas, label sets


@query(f"WITH {_AXES}, p AS (SELECT symbol, axis_id % 3 AS family_id, sum(raw * greatest(0.03, exposure) * (0.25 + 0.75 * 0.5)) / sum(greatest(0.03, exposure) * (0.25 + 0.75 * 0.5)) AS raw, least(1.0, sum(exposure)) AS exposure, count(*) AS dims, sum(posts)::BIGINT AS posts FROM x GROUP BY 1, 2) SELECT symbol, family_id, round(raw, 8) AS raw, round(exposure, 8) AS exposure, dims, posts FROM p")
def ag9_company_families(spark: SparkSession, d: str) -> DataFrame:
    axes = b.axis_scores(spark, d).withColumn("confidence", F.lit(0.5))
    families = axes.select("axis_id", (F.col("axis_id") % 3).alias("family_id")).distinct()
    out = discourse.company_families(axes, families)
    return out.select("symbol", "family_id", F.round("raw", 8).alias("raw"), F.round("exposure", 8).alias("exposure"), "dims", "posts")


@query("SELECT o_orderkey, CASE WHEN n = 0 OR c = 0 THEN 0.0 ELSE round(least(1.0, c * least(log10(n) / 2, 1.0) * (0.4 + 0.6 * m / 3)), 4) END::DOUBLE AS confidence FROM (SELECT o_orderkey, o_orderkey % 150 AS n, (o_orderkey % 11) / 10.0::DOUBLE AS c, o_orderkey % 5 AS m FROM orders)")
def fu2_profile_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = b.read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 150).alias("n"), ((F.col("o_orderkey") % 11) / 10.0).alias("c"), (F.col("o_orderkey") % 5).alias("m"))
    return o.select("o_orderkey", F.round(rules.profile_confidence("c", "n", "m"), 4).alias("confidence"))


@query(f"WITH {MEMBERS}, s AS (SELECT category, list(ticker) AS t FROM members GROUP BY category) SELECT x.category AS a, y.category AS b, round(len(list_intersect(x.t, y.t)) / (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t))), 4) AS likeness FROM s x JOIN s y ON x.category < y.category")
def ev4_label_jaccard(spark: SparkSession, d: str) -> DataFrame:
    s = b.members(spark, d).groupBy("category").agg(F.collect_set("ticker").alias("t"))
    x, y = s.select(F.col("category").alias("a"), F.col("t").alias("ta")), s.select(F.col("category").alias("b"), F.col("t").alias("tb"))
    # one row for each of the few categories
    return x.join(y, F.col("a") < F.col("b")).select("a", "b", F.round(statistics.jaccard(F.col("ta"), F.col("tb")), 4).alias("likeness"))


@query("SELECT p_brand AS category, p_type AS label, count(*) AS n FROM part GROUP BY ALL")
def ag3_value_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "part").groupBy(F.col("p_brand").alias("category"), F.col("p_type").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(CASE WHEN l_linenumber > 2 THEN l_quantity END), 6) AS mean FROM lineitem WHERE l_linenumber > 2 GROUP BY 1")
def ag13_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("l_linenumber") > 2, F.col("l_discount"))
    return b.read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(statistics.weighted_mean(value, F.col("l_quantity")), 6).alias("mean"))


from . import files_catalog, models_catalog, records_catalog  # noqa: E402, F401  register their queries beside these
