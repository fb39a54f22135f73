"""Queries of text and identity rules, joins of records, roll-ups and sheets; registered beside those of ``catalog``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import discourse, identity, portfolio, records, statistics
from . import bindings as b
from . import sqltext
from .catalog import COMPANIES, METRICS, SENTIMENT, _master, _scored_posts
from .registry import query

SUFFIXES = ("NSE", "TSX", "US")


# --- identity


def _listed(spark: SparkSession, d: str) -> DataFrame:
    suffix = F.element_at(F.array(*[F.lit(s) for s in SUFFIXES]), (F.col("s_suppkey") % 3 + 1).cast("int"))
    return b.read(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("S"), "s_suppkey", F.lit("."), suffix).alias("symbol"))


_LISTED = "s AS (SELECT s_suppkey, concat('S', s_suppkey) AS base, CASE s_suppkey % 3 WHEN 0 THEN 'NSE' WHEN 1 THEN 'TSX' ELSE 'US' END AS suffix FROM supplier)"


@query("SELECT p_partkey, replace(upper(trim(concat(' ', p_type, '-', p_size, ' '))), '-', '.') AS symbol FROM part")
def id1_symbol_key(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" "), "p_type", F.lit("-"), "p_size", F.lit(" "))
    return b.read(spark, d, "part").select("p_partkey", text.symbol_key(raw).alias("symbol"))


@query(f"WITH {_LISTED} SELECT s_suppkey, concat(base, '.', suffix, ',', base, '-', suffix, CASE WHEN suffix = 'US' THEN concat(',', base, '.USE,', base, '-USE') ELSE '' END, ',', base) AS candidates FROM s")
def id3_ticker_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).select("s_suppkey", F.array_join(identity.ticker_candidates("symbol"), ",").alias("candidates"))


@query(f"WITH {_LISTED} SELECT s_suppkey, CASE suffix WHEN 'NSE' THEN concat(base, '.NS,', base, '.NSE,', base) WHEN 'TSX' THEN concat(base, '.TO,', base, '.TSX,', base) ELSE concat(base, '.US') END AS candidates FROM s")
def id12_suffix_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _listed(spark, d).select("s_suppkey", F.array_join(records.suffix_candidates("symbol"), ",").alias("candidates"))


@query("SELECT o_custkey, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderkey % 3 <> 0) AS priority FROM orders GROUP BY o_custkey")
def id8_first_values(spark: SparkSession, d: str) -> DataFrame:
    o = b.read(spark, d, "orders").withColumn("priority", F.when(F.col("o_orderkey") % 3 == 0, "-").otherwise(F.col("o_orderpriority")))
    return identity.first_values(o, "o_custkey", ["priority"], "o_orderkey")


@query("SELECT o_custkey, coalesce(arg_min(concat('/l/', o_orderkey), o_orderkey) FILTER (o_orderkey % 4 = 0), arg_min(concat('/l/', o_orderkey), o_orderkey)) AS href FROM orders GROUP BY o_custkey")
def id10_preferred_links(spark: SparkSession, d: str) -> DataFrame:
    o = b.read(spark, d, "orders").withColumn("href", F.concat(F.lit("/l/"), "o_orderkey"))
    return records.preferred_links(o, "o_custkey", "href", F.col("o_orderkey") % 4 == 0, "o_orderkey")


@query("SELECT p_partkey, s || CASE WHEN n > 1 THEN concat('-', n) ELSE '' END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p_partkey) AS n FROM (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS s FROM part))")
def id11_unique_slugs(spark: SparkSession, d: str) -> DataFrame:
    return records.unique_slugs(b.read(spark, d, "part"), "p_name", "p_partkey").select("p_partkey", "slug")


# --- text


@query(f"SELECT doc_id, {sqltext.topic('text')} AS template FROM documents")
def tx3_template_text(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "documents").select("doc_id", text.template_text("text").alias("template"))


@query("SELECT p_partkey, concat(p_type, ' _ ', p_name) AS label FROM part")
def tx5_clean_label(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit("★ ☆x  "), F.lit("- "), "p_type", F.lit("  _ "), "p_name", F.lit(" -/"))
    return b.read(spark, d, "part").select("p_partkey", text.clean_label(raw).alias("label"))


@query(f"SELECT doc_id, {sqltext.post('text')} AS post FROM documents")
def tx8_clean_post(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "documents").select("doc_id", text.clean_post("text").alias("post"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('a', user_id, ',b') ELSE '' END AS items FROM events")
def tx13_json_array(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["a'), "user_id", F.lit('","b"]'))).otherwise(F.lit("[bad"))
    return b.read(spark, d, "events").select("event_id", F.array_join(text.json_array(raw, "string"), ",").alias("items"))


@query("SELECT conv_id, concat('Posts:', chr(10), string_agg('- ' || left(text, 20), chr(10) ORDER BY turn)) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 2 GROUP BY conv_id")
def tx15_prompt(spark: SparkSession, d: str) -> DataFrame:
    c = statistics.top_k(b.read(spark, d, "conversations"), ["conv_id"], 2, F.col("turn"))
    posts = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("p"))
    return posts.select("conv_id", text.prompt("p.text", "Posts:", 2, 20).alias("prompt"))


@query("SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' ')[1:4], lambda w: upper(w[1]) || lower(w[2:])), ' ') AS phrase FROM part")
def tx17_title_phrase(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "part").select("p_partkey", text.title_phrase("p_name").alias("phrase"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN round(c_custkey / 8, 2)::DOUBLE END AS v FROM customer")
def tx18_safe_number(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("c_custkey") % 4 == 0, "NaN").when(F.col("c_custkey") % 4 == 1, "Infinity").when(F.col("c_custkey") % 4 == 2, "n/a")
    return b.read(spark, d, "customer").select("c_custkey", text.safe_number(odd.otherwise((F.col("c_custkey") / 8).cast("string")), 2).alias("v"))


# --- filters and rules


@query(f"WITH t AS (SELECT doc_id, lower(text) AS low, {sqltext.topic('text')} AS template FROM documents), w AS (SELECT *, list_distinct(regexp_extract_all(template, '[a-z]{{2,}}')) AS w, count(*) OVER (PARTITION BY template) AS n FROM t) SELECT doc_id, contains(low, 'inst') OR (len(list_intersect(w, ['the', 'that', 'with', 'from', 'were'])) >= 4 AND len(w) <= 18) OR (n >= 40 AND len(string_split(template, ' ')) >= 5) AS boilerplate FROM w")
def fl5_boilerplate(spark: SparkSession, d: str) -> DataFrame:
    """Templates are counted over all rows."""
    docs = b.read(spark, d, "documents").select("doc_id", "text", text.template_text("text").alias("template"))
    docs = docs.withColumn("key", F.sha2("template", 256))
    counts = docs.groupBy("key").agg(F.count("*").alias("frequency"))
    found = rules.boilerplate("text", "template", "frequency", 40, ("inst",), ("the", "that", "with", "from", "were"))
    return docs.join(counts, "key").select("doc_id", found.alias("boilerplate"))


@query(f"WITH {COMPANIES} SELECT symbol FROM (SELECT *, CASE right(symbol, 1) WHEN '1' THEN 'reit' WHEN '2' THEN 'ambiguous' ELSE 'common_equity' END AS u FROM master) WHERE category IN ('Brand#1', 'Brand#2', 'Brand#3') AND u <> 'ambiguous' AND posts_count >= 28")
def fl7_candidates(spark: SparkSession, d: str) -> DataFrame:
    last = F.right("symbol", F.lit(1))
    m = _master(spark, d).withColumn("instrument_universe", F.when(last == "1", "reit").when(last == "2", "ambiguous").otherwise("common_equity"))
    return portfolio.candidates(m, portfolio.Profile(categories=("Brand#1", "Brand#2", "Brand#3"), excluded_universes=("ambiguous",), min_posts=28)).select("symbol")


@query("SELECT p_partkey FROM part WHERE contains(lower(concat(p_name, ' ', p_type)), 'ring')")
def fl9_axis_search(spark: SparkSession, d: str) -> DataFrame:
    return records.searched(b.read(spark, d, "part"), " Ring ", ["p_name", "p_type"]).select("p_partkey")


@query("SELECT p_partkey AS axis_id, p_brand AS cluster_id FROM part ORDER BY p_size DESC, p_partkey LIMIT 18")
def fl10_shown_axes(spark: SparkSession, d: str) -> DataFrame:
    axes = b.read(spark, d, "part").select(F.col("p_partkey").alias("axis_id"), F.col("p_brand").alias("cluster_id"), F.col("p_size").alias("corpus_weight"))
    return records.shown_axes(axes).drop("corpus_weight")


@query(f"""{SENTIMENT}, x AS (SELECT *, list_contains(tok, 'les') AS p, list_contains(tok, 'und') AS n FROM scored), e AS (SELECT *, sentiment_label = 'neutral' AND p <> n AS use FROM x)
SELECT doc_id, CASE WHEN use THEN CASE WHEN p THEN 0.75 ELSE -0.75 END ELSE sentiment_score END::DOUBLE AS score, CASE WHEN use THEN CASE WHEN p THEN 'positive' ELSE 'negative' END ELSE sentiment_label END AS label FROM e""")
def cl5_explicit_override(spark: SparkSession, d: str) -> DataFrame:
    p = _scored_posts(spark, d).withColumn("explicit", rules.explicit_label("clean", "les", "und"))
    made = rules.explicit_override("sentiment_label", "sentiment_score", "sentiment_confidence", "explicit")
    return p.select("doc_id", made["sentiment_score"].alias("score"), made["sentiment_label"].alias("label"))


@query("SELECT p_partkey, CASE WHEN contains(lower(p_brand), 'brand#1') THEN 'geographic' WHEN contains(lower(p_type), 'economy') THEN 'index_or_meta' ELSE 'thematic' END AS grp FROM part")
def cl6_category_group(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "part").select("p_partkey", rules.category_group(F.concat(F.lit("/c/"), "p_type"), "p_brand", "p_name", ("brand#1",), ("economy",)).alias("grp"))


@query("""WITH c AS (SELECT max(embedding) FILTER (vec_id = 0) AS a, max(embedding) FILTER (vec_id = 1) AS n FROM embeddings), s AS (SELECT vec_id, label, list_cosine_similarity(embedding::DOUBLE[], a::DOUBLE[]) AS x, list_cosine_similarity(embedding::DOUBLE[], n::DOUBLE[]) AS y FROM embeddings, c)
SELECT vec_id AS topic_id, round(x, 4)::DOUBLE AS axiological_score, round(y, 4)::DOUBLE AS noise_score, x > y AS is_axiological FROM s""")
def cl8_concept_topics(spark: SparkSession, d: str) -> DataFrame:
    v = b.vectors(spark, d).select(F.col("doc_id").alias("topic_id"), "vector")
    pick = lambda k: F.max(F.when(F.col("topic_id") == k, F.col("vector")))
    return records.concept_topics(v, v.where("topic_id in (0, 1)").agg(pick(0).alias("axiological"), pick(1).alias("noise")))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'dominant' ELSE 'none' END AS coverage, CASE c_custkey % 2 WHEN 0 THEN 'mixed' ELSE 'neutral' END AS sentiment FROM customer")
def cl9_validated_output(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "customer").withColumn("cov", F.when(F.col("c_custkey") % 3 == 0, "dominant").when(F.col("c_custkey") % 3 == 1, "huge"))
    frames = F.array(F.struct(F.lit("x").alias("label"), F.when(F.col("c_custkey") % 2 == 0, "mixed").otherwise("odd").alias("sentiment")))
    return c.select("c_custkey", rules.valid_coverage("cov").alias("coverage"), rules.valid_frames(frames)[0]["sentiment"].alias("sentiment"))


@query("SELECT l_orderkey, l_linenumber, coalesce(l_linenumber > 1 AND l_discount < 0.05, false) AS low FROM lineitem")
def cl10_low_signal(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", rules.low_signal("l_discount", F.col("l_linenumber") > 1).alias("low"))


@query(f"WITH {METRICS} SELECT bool_or(roe IS NOT NULL OR roa IS NOT NULL) AS profitability, false AS technicals FROM m")
def cl11_metric_availability(spark: SparkSession, d: str) -> DataFrame:
    m = b.metrics(spark, d).withColumn("momentum", F.lit(None).cast("double"))
    return records.metric_availability(m, {"profitability": ["roe", "roa"], "technicals": ["momentum"]})


# --- roll-ups


@query(f"SELECT {sqltext.topic('text')} AS template, count(*) AS n FROM conversations GROUP BY 1")
def ag4_template_frequency(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "conversations").groupBy(text.template_text("text").alias("template")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT p_partkey AS axis_id, p_brand AS f, (p_size % 10) / 10.0::DOUBLE AS rel, (p_size * 40)::DOUBLE AS cw, (p_partkey % 5 - 2) / 4.0::DOUBLE AS s FROM part), w AS (SELECT *, greatest(0.2, rel + least(1.0, cw / 2000)) AS w FROM a)
SELECT f AS family_id, count(*) AS axis_count, sum(cw) AS corpus_weight, round(sum(rel * w) / sum(w), 4) AS value_relevance, round(sum(s * w) / sum(w), 4) AS average_sentiment FROM w GROUP BY f""")
def ag8_family_catalog(spark: SparkSession, d: str) -> DataFrame:
    p = b.read(spark, d, "part")
    axes = p.select(F.col("p_partkey").alias("axis_id"), ((F.col("p_size") % 10) / 10.0).alias("relevance"), (F.col("p_size") * 40).cast("double").alias("corpus_weight"), ((F.col("p_partkey") % 5 - 2) / 4.0).alias("average_sentiment"))
    families = p.select(F.col("p_partkey").alias("axis_id"), F.col("p_brand").alias("family_id"), F.col("p_brand").alias("family_label"))
    return discourse.family_catalog(axes, families).drop("family_label")


@query("SELECT p_brand AS cluster_id, min(p_type) AS cluster_label, count(*) AS axis_count FROM part GROUP BY 1")
def ag10_cluster_counts(spark: SparkSession, d: str) -> DataFrame:
    return discourse.cluster_counts(b.read(spark, d, "part").select(F.col("p_brand").alias("cluster_id"), F.col("p_type").alias("cluster_label")))


@query("SELECT 0 AS pos, 'common_equity' AS id, count(*) FILTER (p_size % 4 IN (0, 1)) AS companies_count FROM part UNION ALL SELECT 1, 'ambiguous', count(*) FILTER (p_size % 4 = 2) FROM part")
def ag11_instrument_counts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(u) for u in ("common_equity", "reit", None, "crypto_coin")]), (F.col("p_size") % 4 + 1).cast("int"))
    return records.instrument_counts(b.read(spark, d, "part").select(kind.alias("instrument_universe")))


@query("SELECT count(*) AS companies, count(*) FILTER (o_orderkey % 3 = 0) AS with_signal, count(*) FILTER (o_orderkey % 7 = 0) AS null_profiles, round(avg(o_orderkey % 8) / 8, 4) AS mean_coverage, round(avg(o_orderkey % 4) / 4, 4) AS mean_agreement FROM orders")
def ag15_profile_summary(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return discourse.profile_summary(b.read(spark, d, "orders").select((k % 3 == 0).alias("has_signal"), (k % 7 == 0).alias("profile_null"), (k % 8 / 8).alias("axiological_coverage"), (k % 4 / 4).alias("agreement")))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def ag18_row_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.row_counts({n: b.read(spark, d, n) for n in ("orders", "events")})


@query("WITH u AS (SELECT source AS symbol, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE length(trim(text)) >= 200) SELECT symbol, n AS n_usable, string_agg(md5(coalesce(text, '')), ',' ORDER BY rn) AS posts FROM u JOIN documents USING (doc_id) WHERE rn <= 3 AND n >= 5 GROUP BY ALL")
def ag21_usable_posts(spark: SparkSession, d: str) -> DataFrame:
    out = records.usable_posts(b.posts(spark, d), 200, 5, 3, F.col("doc_id"))
    return out.select("symbol", "n_usable", F.array_join(F.transform("posts", F.md5), ",").alias("posts"))


@query("SELECT p_brand, p_size, rk FROM (SELECT *, 50 + least(1.0, ln(1 + d + least(p, 24)) / ln(29)) * least(1.0, 0.2 + 0.8 * least(1.0, 1.8 * e)) * (pct - 50) AS raw_rk, round(50 + least(1.0, ln(1 + d + least(p, 24)) / ln(29)) * least(1.0, 0.2 + 0.8 * least(1.0, 1.8 * e)) * (pct - 50), 2) AS rk FROM (SELECT *, 3 AS d, p_partkey % 40 AS p, (p_partkey % 8) / 8.0::DOUBLE AS e, 100 * (rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 + 0.5 * count(*) OVER (PARTITION BY p_brand, p_size)) / count(*) OVER (PARTITION BY p_brand) AS pct FROM part))")
def wn7_family_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = b.read(spark, d, "part").select("p_brand", "p_size", F.col("p_brand").alias("family_id"), F.col("p_size").cast("double").alias("raw"), F.lit(3).alias("dims"), (k % 40).alias("posts"), (k % 8 / 8).alias("exposure"))
    return statistics.shrunk_family_scores(rows).select("p_brand", "p_size", F.col("family_score").alias("rk"))


# --- joins


@query("WITH u AS (SELECT s_suppkey AS k, concat('Supplier#', lpad((s_suppkey * 2)::VARCHAR, 9, '0')) AS name, concat('U', s_suppkey * 3) AS url FROM supplier) SELECT k, coalesce(a.s_name, c.s_name) AS matched, CASE WHEN a.s_name IS NOT NULL THEN 0 WHEN c.s_name IS NOT NULL THEN 1 END AS index_no FROM u LEFT JOIN supplier a ON a.s_name = u.name LEFT JOIN supplier c ON concat('U', c.s_suppkey) = u.url")
def jn3_indexed_match(spark: SparkSession, d: str) -> DataFrame:
    s = b.read(spark, d, "supplier")
    k = F.col("s_suppkey")
    rows = s.select(k.alias("k"), F.array(F.concat(F.lit("U"), k * 3), F.concat(F.lit("Supplier#"), F.lpad((k * 2).cast("string"), 9, "0"))).alias("cands"))
    return records.match_indices(rows, s.withColumn("url", F.concat(F.lit("U"), k)), "k", "cands", ["s_name", "url"], "s_name")


@query("SELECT c_custkey AS symbol, c_mktsegment AS cmc_c_mktsegment, c_acctbal AS cmc_c_acctbal, n AS st_n FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE rn <= 50")
def jn4_universe_merge(spark: SparkSession, d: str) -> DataFrame:
    left = b.read(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), "c_mktsegment", "c_acctbal")
    right = b.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.count("*").alias("n"))
    return records.merge_universe(left, right, "symbol", "c_mktsegment", [F.col("c_acctbal").desc(), F.col("symbol")], top=50)


@query("SELECT l_orderkey, l_linenumber, coalesce(p_name, concat('P', l_partkey)) AS company_name, coalesce(p_brand, 'Unknown') AS category, coalesce(p_type, 'Unknown') AS industry FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size < 30")
def jn5_enriched_posts(spark: SparkSession, d: str) -> DataFrame:
    posts = b.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("P"), "l_partkey").alias("symbol"))
    return records.enriched_posts(posts, b.companies(spark, d).join(b.read(spark, d, "part").where("p_size < 30").select(F.concat(F.lit("P"), "p_partkey").alias("symbol")), "symbol")).drop("symbol")


@query("SELECT x.doc_id, x.quality AS a, y.toxic AS b FROM labels x JOIN labels y USING (doc_id) WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0")
def jn8_rater_pairs(spark: SparkSession, d: str) -> DataFrame:
    x = b.read(spark, d, "labels")
    one, two = (x.select("doc_id", F.col(c).alias("v"), (F.col("doc_id") % m == 0).alias("error")) for c, m in (("quality", 5), ("toxic", 7)))
    return records.rater_pairs(one, two, "doc_id", "v")


@query("SELECT l_orderkey, l_linenumber AS axis_id, coalesce(n_name, l_returnflag) AS axis_label FROM lineitem LEFT JOIN nation ON n_nationkey = l_linenumber AND n_nationkey <= 3")
def jn11_catalog_labels(spark: SparkSession, d: str) -> DataFrame:
    axes = b.read(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("axis_id"), F.col("l_returnflag").alias("axis_label"))
    catalog = b.read(spark, d, "nation").where("n_nationkey <= 3").select(F.col("n_nationkey").alias("axis_id"), F.col("n_name").alias("axis_label"))
    return records.with_catalog(axes, catalog, ["axis_label"])


@query("SELECT n_nationkey AS axis_id, CASE WHEN n_nationkey % 3 = 0 THEN 'prefer_high' ELSE 'neutral' END AS mode, CASE WHEN n_nationkey % 3 = 0 THEN 0.9 ELSE 0.5 END::DOUBLE AS importance FROM nation")
def jn12_synchronised(spark: SparkSession, d: str) -> DataFrame:
    n = b.read(spark, d, "nation").select(F.col("n_nationkey").alias("axis_id"))
    return records.synchronised(n, n.where("axis_id % 3 = 0").select("axis_id", F.lit("prefer_high").alias("mode"), F.lit(0.9).alias("importance")))


@query("WITH m AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent FROM conversations) SELECT conv_id, arg_max(coalesce(before, ''), turn) AS prompt, arg_max(coalesce(text, ''), turn) AS reply FROM m WHERE parent = turn - 1 GROUP BY conv_id")
def jn13_paired_replies(spark: SparkSession, d: str) -> DataFrame:
    name = lambda t: F.concat_ws("/", "conv_id", t)
    c = b.read(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), name("turn").alias("id"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent_id"))
    return records.paired_replies(c, "conv_id", "turn")


@query("WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), x AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) SELECT k FROM a UNION SELECT k FROM x")
def so3_union_keys(spark: SparkSession, d: str) -> DataFrame:
    a = b.read(spark, d, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return a.union(b.read(spark, d, "customer").where("c_acctbal < 0").select("c_custkey")).distinct()


@query("SELECT c_custkey AS k FROM customer WHERE c_acctbal < 1000 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def so4_common_keys(spark: SparkSession, d: str) -> DataFrame:
    a = b.read(spark, d, "customer").where("c_acctbal < 1000").select(F.col("c_custkey").alias("k"))
    return a.intersect(b.read(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey"))


# --- fusion, families and sheets


@query("SELECT o_orderkey, round(((o_orderkey % 2 = 0)::INT + (o_orderkey % 3 = 0)::INT + (o_orderkey % 5 = 0)::INT) / (3 + (o_orderkey % 7 = 0)::INT), 4) AS agreement FROM orders")
def fu1_method_agreement(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return b.read(spark, d, "orders").select("o_orderkey", rules.method_agreement([k % 2 == 0, k % 3 == 0, k % 5 == 0], k % 7 == 0).alias("agreement"))


@query("SELECT p_partkey, CASE WHEN lower(p_brand) = lower(p_type) THEN p_brand ELSE concat(p_brand, ',', p_type) END AS labels, CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS score FROM part")
def fu3_merged_frames(spark: SparkSession, d: str) -> DataFrame:
    frame = lambda c: F.struct(c.alias("label"))
    frames = F.array(frame(F.col("p_brand")), frame(F.lit(" ")), frame(F.concat(F.lit(" "), F.upper("p_brand"))), frame(F.col("p_type")))
    said = F.element_at(F.array(F.lit("Positive"), F.lit(" negative"), F.lit("mixed")), (F.col("p_size") % 3 + 1).cast("int"))
    return b.read(spark, d, "part").select("p_partkey", F.array_join(rules.merge_frames(frames)["label"], ",").alias("labels"), rules.sentiment_value(said).alias("score"))


@query("SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_discount DESC, l_tax DESC, l_linenumber) AS families FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey) GROUP BY l_orderkey")
def pf16_family_preview(spark: SparkSession, d: str) -> DataFrame:
    # rows that the order leaves equal count as they lie in the table
    lines = b.read(spark, d, "lineitem").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    one = identity.first_by(lines, ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("file"), F.col("at"))
    family = F.struct("l_linenumber", F.col("l_linenumber").cast("string").alias("family_id"), F.col("l_discount").alias("relevance"), F.col("l_tax").alias("exposure"), F.lit(None).cast("double").alias("confidence"))
    listed = one.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(family)).alias("f"))
    return listed.select("l_orderkey", F.array_join(F.transform(records.ordered_families("f"), lambda f: f["family_id"]), ",").alias("families"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_brand, ',', p_type) ELSE p_name END AS axes FROM part")
def pf7_company_axes(spark: SparkSession, d: str) -> DataFrame:
    axis = lambda c: F.struct(c.alias("axis_label"))
    nested = F.when(F.col("p_size") % 2 == 0, F.array(axis(F.col("p_brand")), axis(F.lit("")), axis(F.col("p_type"))))
    return b.read(spark, d, "part").select("p_partkey", F.array_join(records.company_axes(nested, F.array(axis(F.col("p_name")), axis(F.lit(" "))))["axis_label"], ",").alias("axes"))


@query("SELECT p_partkey, CASE WHEN round(60 * a, 2) >= round(40 * z, 2) THEN 'first,second' ELSE 'second,first' END AS titles FROM (SELECT p_partkey, (p_size % 8) / 8.0::DOUBLE AS a, (p_partkey % 7) / 8.0::DOUBLE AS z FROM part)")
def pf9_explanations(spark: SparkSession, d: str) -> DataFrame:
    p = b.read(spark, d, "part").select("p_partkey", (F.col("p_size") % 8 / 8).alias("a"), (F.col("p_partkey") % 7 / 8).alias("z"))
    return p.select("p_partkey", F.array_join(records.explanations({"a": "first", "z": "second"}, {"a": 0.6, "z": 0.4})["title"], ",").alias("titles"))


@query("SELECT p_partkey AS symbol, p_size < 10 AS profile_null, unnest(CASE WHEN p_size < 10 THEN ['(profile_null)'] ELSE [p_brand, p_type] END) AS frame_label, CASE WHEN p_size < 10 THEN '' ELSE 'neutral' END AS frame_sentiment, '' AS frame_confirmed, '' AS evidence_correct, '' AS notes FROM part")
def ev6_annotation_sheet(spark: SparkSession, d: str) -> DataFrame:
    frame = lambda c: F.struct(F.col(c).alias("label"), F.lit("neutral").alias("sentiment"))
    p = b.read(spark, d, "part")
    return records.annotation_sheet(p.select(F.col("p_partkey").alias("symbol"), (F.col("p_size") < 10).alias("profile_null"), F.array(frame("p_brand"), frame("p_type")).alias("frames")))


@query("SELECT round(count(*) FILTER (p_size % 3 = 1) / count(*) FILTER (p_size % 3 <> 2), 4) AS precision, round(count(*) FILTER (p_size % 2 = 1) / count(*), 4) AS evidence_accuracy, NULL::DOUBLE AS null_correctness FROM part")
def ev7_annotation_scores(spark: SparkSession, d: str) -> DataFrame:
    a = F.when(F.col("p_size") % 3 == 2, " ").otherwise((F.col("p_size") % 3).cast("string"))
    return statistics.annotation_scores(b.read(spark, d, "part").select(a.alias("frame_correct"), (F.col("p_size") % 2).cast("string").alias("evidence_correct"), F.lit("").alias("null_correct")))
