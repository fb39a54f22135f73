"""Queries of sources, sinks, streams and settings: tables go out to files in the shared folder and come back through the operator."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import discourse, identity, models, portfolio
from ..sources import commits, files, paged
from ..streaming import upserts
from . import bindings as b
from .catalog import COMPANIES, _master
from .registry import query

# --- sources


def _lines(spark: SparkSession, df: DataFrame, spoilt: str = "false") -> str:
    """``df`` as JSONL with blank lines; where ``spoilt`` holds, a line is cut short."""
    path = files.scratch(spark)
    line = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.select(F.explode(F.array(F.when(F.expr(spoilt), F.substring(line, 1, 12)).otherwise(line), F.lit(""))).alias("value")).write.text(path)
    return path


def _suppliers(spark: SparkSession, d: str) -> DataFrame:
    return b.read(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")


_SUPPLIER = "s_suppkey long, s_name string, s_nationkey int"


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::INTEGER AS s_nationkey FROM supplier")
def sc1_json_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.json_lines(spark, _lines(spark, _suppliers(spark, d)), _SUPPLIER)


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::INTEGER AS s_nationkey FROM supplier WHERE s_suppkey % 10 <> 3")
def sc2_lenient_json_lines(spark: SparkSession, d: str) -> DataFrame:
    return files.json_lines(spark, _lines(spark, _suppliers(spark, d), "s_suppkey % 10 = 3"), _SUPPLIER, strict=False)


@query("SELECT upper(o_orderpriority) AS symbol, max(o_orderkey)::BIGINT AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1")
def sc3_last_row_by_symbol(spark: SparkSession, d: str) -> DataFrame:
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.lower("o_orderpriority")).otherwise(F.col("o_orderpriority"))
    path = _lines(spark, b.read(spark, d, "orders").select(odd.alias("symbol"), "o_orderkey", F.col("o_totalprice").alias("price")))
    rows = files.json_lines(spark, path, "symbol string, o_orderkey long, price double").withColumn("symbol", F.upper("symbol"))
    return identity.last_by(rows, ["symbol"], "o_orderkey")


@query("SELECT n_nationkey::INTEGER AS n_nationkey, n_name FROM nation")
def sc4_csv_with_mark(spark: SparkSession, d: str) -> DataFrame:
    rows = b.read(spark, d, "nation").orderBy("n_nationkey").collect()  # 25 nations
    body = "﻿n_nationkey,n_name\n" + "".join(f'{r["n_nationkey"]},"{r["n_name"]}"\n' for r in rows)
    path = files.write_file(spark, f"{files.scratch(spark)}/nation.csv", body)
    return files.csv_table(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")


@query("SELECT n_nationkey::INTEGER AS axis_id, n_name AS label FROM nation")
def sc5_nested_document(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    axes = b.read(spark, d, "nation").agg(F.collect_list(F.struct(F.col("n_nationkey").alias("axis_id"), F.col("n_name").alias("label"))).alias("axes"))
    axes.select(F.to_json(F.struct("axes"), {"pretty": "true"}).alias("value")).write.text(path)  # one document of 25 axes
    return files.json_document(spark, path, "axes array<struct<axis_id: int, label: string>>", "axes")


def _tree(spark: SparkSession, d: str) -> str:
    """Two runs of each region, one message for each of its nations in the first, and of those with an even key in the second."""
    root = files.scratch(spark)
    regions = {r["r_regionkey"]: r["r_name"].replace(" ", "_").lower() for r in b.read(spark, d, "region").collect() if r["r_regionkey"] != 4}
    for n in b.read(spark, d, "nation").where("n_regionkey != 4").collect():
        for run in ("20250101", "20250301") if n["n_nationkey"] % 2 == 0 else ("20250101",):
            files.write_file(spark, f"{root}/{regions[n['n_regionkey']]}/runs/{run}/messages/m{n['n_nationkey']}/meta.json", '{"text": "' + n["n_name"] + '"}')
    return root


_TREE = """m AS (SELECT replace(upper(r_name), ' ', '_') AS symbol, unnest(CASE WHEN n_nationkey % 2 = 0 THEN ['20250101', '20250301'] ELSE ['20250101'] END) AS source_run, concat('m', n_nationkey) AS message_id, n_name AS text
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey <> 4), l AS (SELECT * FROM m WHERE true QUALIFY source_run = max(source_run) OVER (PARTITION BY symbol))"""


@query(f"WITH {_TREE} SELECT symbol, source_run, message_id, text FROM l")
def sc6_latest_runs(spark: SparkSession, d: str) -> DataFrame:
    return files.latest_runs(spark, _tree(spark, d), "text string").select("symbol", "source_run", "message_id", "text")


@query(f"WITH {_TREE}, c AS (SELECT symbol, count(*) AS n FROM l GROUP BY 1) SELECT replace(upper(r_name), ' ', '_') AS symbol, coalesce(n, 0) AS posts FROM region LEFT JOIN c ON symbol = replace(upper(r_name), ' ', '_')")
def sc7_run_counts(spark: SparkSession, d: str) -> DataFrame:
    symbols = b.read(spark, d, "region").select(F.replace(F.upper("r_name"), F.lit(" "), F.lit("_")).alias("symbol"))
    return files.run_counts(files.latest_runs(spark, _tree(spark, d), "text string"), symbols)


@query("SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS slug, concat('Top ', p_brand) AS name FROM part")
def sc8_category_catalog(spark: SparkSession, d: str) -> DataFrame:
    index = b.read(spark, d, "part").select(F.lower(F.replace("p_brand", F.lit("#"), F.lit("-"))).alias("slug"), F.concat(F.lit("★ - Top  "), "p_brand").alias("name")).distinct()
    return files.category_catalog(files.json_lines(spark, _lines(spark, index), "slug string, name string"))


@query("SELECT r_regionkey, r_name, true AS fell_back FROM region")
def sc9_resolved_source(spark: SparkSession, d: str) -> DataFrame:
    path = files.resolve(spark, f"{d}/absent.parquet", f"{d}/region.parquet")
    return spark.read.parquet(path).select("r_regionkey", "r_name", F.lit(not path.endswith("absent.parquet")).alias("fell_back"))


@query("WITH r AS (SELECT upper(concat('t', p_size, '.', p_partkey % 40)) AS symbol, p_name, p_type, p_brand, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_partkey % 100 + 1 END AS rank, p_partkey FROM part), f AS (SELECT * FROM r WHERE true QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY coalesce(rank, 999999), p_partkey) = 1) SELECT symbol, coalesce(p_name, symbol) AS company_name, p_brand AS category, rank::INTEGER AS rank, coalesce(n, 0) AS posts_count FROM f LEFT JOIN (SELECT concat('T', l_linenumber, '.', l_partkey % 40) AS s, count(*) AS n FROM lineitem GROUP BY 1) ON s = symbol")
def sc10_universe_fallback(spark: SparkSession, d: str) -> DataFrame:
    p = b.read(spark, d, "part")
    rank = F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 100 + 1)
    symbol = F.concat(F.lit(" t"), "p_size", F.lit("-"), F.col("p_partkey") % 40)
    listing = _lines(spark, p.select(symbol.alias("symbol"), F.col("p_name").alias("company_name"), F.col("p_type").alias("industry"), F.col("p_brand").alias("category"), rank.alias("rank"), F.col("p_partkey").alias("_ord")))
    counts = b.read(spark, d, "lineitem").groupBy(F.concat(F.lit("T"), "l_linenumber", F.lit("."), F.col("l_partkey") % 40).alias("symbol")).agg(F.count("*").alias("posts_count"))
    schema = "symbol string, company_name string, industry string, category string, rank int, _ord long"
    return identity.company_records(spark, f"{d}/absent.jsonl", listing, schema, counts).select("symbol", "company_name", "category", "rank", "posts_count")


@query("SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def sc11_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.first_rows(b.read(spark, d, "documents").select("doc_id", "source"), 25, "doc_id")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INTEGER AS rank FROM supplier) SELECT concat('/c/', s_nationkey) AS url, rank, concat('S', s_suppkey) AS ticker, concat('Company ', rank) AS name FROM r")
def sc13_listings(spark: SparkSession, d: str) -> DataFrame:
    w = F.row_number().over(b.Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    row = F.concat(F.lit("<tr><td>"), "k", F.lit("</td><td>Company "), "k", F.lit(" <span>S"), "s_suppkey", F.lit("</span></td><td>$1 B</td></tr>"))
    rows = b.read(spark, d, "supplier").withColumn("k", w).select("s_nationkey", F.struct("k", row.alias("row")).alias("x"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["row"]), "")
    head = "<table><tr><td>menu</td></tr></table><table><tr><th>Rank</th><th>Name</th><th>Market Cap</th></tr>"
    pages = rows.groupBy("s_nationkey").agg(body.alias("rows"))  # one page lists the suppliers of a nation
    return files.listings(pages.select(F.concat(F.lit("/c/"), "s_nationkey").alias("url"), F.concat(F.lit(head), "rows", F.lit("</table>")).alias("html")))


@query("SELECT r_regionkey::INTEGER AS r_regionkey, r_name FROM region")
def sc15_uploaded_csv(spark: SparkSession, d: str) -> DataFrame:
    body = "r_regionkey,r_name\n" + "".join(f'{r["r_regionkey"]},{r["r_name"]}\n' for r in b.read(spark, d, "region").collect())
    path = files.uploaded(spark, "../my regions.csv", base64.b64encode(body.encode()).decode(), files.scratch(spark), "20250101")
    return files.csv_table(spark, path, "r_regionkey int, r_name string")


@query("WITH s AS (SELECT DISTINCT s_nationkey, s_name FROM supplier) SELECT s_nationkey AS category, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name)::INTEGER AS rank, s_name AS ticker FROM s")
def sc16_flat_members(spark: SparkSession, d: str) -> DataFrame:
    by = b.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("category")).agg(F.array_sort(F.collect_set("s_name")).alias("t"))
    third = F.col("category") % 3
    none = F.array().cast("array<string>")
    made = by.select("category", F.when(third == 0, F.col("t")).otherwise(none).alias("tickers"), F.when(third == 1, F.col("t")).alias("companies"), F.when(third == 2, F.map_from_entries(F.transform("t", lambda x: F.struct(x, F.lit(1))))).alias("by_ticker"))
    return files.flat_members(made, "category", ["tickers", "companies"], ["by_ticker"]).select("category", F.col("rank").cast("int").alias("rank"), "ticker")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN round(c_acctbal / 7, 6) END AS net_margin, NULL::DOUBLE AS operating_margin, round(c_custkey / 3, 6)::DOUBLE AS roe, NULL::DOUBLE AS roa, NULL::DOUBLE AS revenue_growth FROM customer")
def sc17_fundamentals(spark: SparkSession, d: str) -> DataFrame:
    margin = F.when(F.col("c_custkey") % 5 == 0, "n/a").otherwise((F.col("c_acctbal") / 7).cast("string"))
    record = F.create_map(F.lit("profitMargins"), margin, F.lit("returnOnEquity"), (F.col("c_custkey") / 3).cast("string"), F.lit("returnOnAssets"), F.lit(None).cast("string"))
    return b.read(spark, d, "customer").select("c_custkey", record.alias("info")).select("c_custkey", *files.fundamentals("info"))


def _axes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    blank = F.lit(None).cast("string")
    n = b.read(spark, d, "nation").select(
        k.alias("axis_id"), F.when(k % 3 == 0, F.concat(F.lit(" "), "n_name")).otherwise("").alias("axis_display_label"), F.when(k % 3 == 1, F.col("n_name")).otherwise(blank).alias("axis_label"),
        F.lit(" ").alias("axis_summary"), F.array(F.lit(" "), F.lower("n_name"), F.lit("x ")).alias("keywords"), F.array(F.col("n_name"), F.lit("")).alias("topic_labels"),
        F.when(k % 2 == 0, k).alias("topic_count"), F.when(k % 2 == 0, k / 4).alias("corpus_weight"), F.col("n_regionkey").alias("cluster_id"), F.lit("c").alias("cluster_label"),
    )
    schema = "axis_id int, axis_display_label string, axis_label string, axis_summary string, keywords array<string>, topic_labels array<string>, topic_count int, corpus_weight double, cluster_id int, cluster_label string"
    return files.axis_catalog(files.json_lines(spark, _lines(spark, n), schema))


def _families(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("r_regionkey")
    r = b.read(spark, d, "region").select(k.alias("position"), F.when(k % 2 == 0, F.concat(F.lit("f"), k)).alias("family_id"), F.when(k < 3, F.col("r_name")).otherwise("").alias("family_label"), F.array(F.lit(""), F.lit(" a ")).alias("keywords"), F.when(k > 0, k / 2).alias("esg_relevance"))
    return files.family_definitions(files.json_lines(spark, _lines(spark, r), "position int, family_id string, family_label string, keywords array<string>, esg_relevance double"))


_AXES = """ax AS (SELECT n_nationkey::INTEGER AS axis_id, CASE WHEN n_nationkey % 3 = 2 THEN concat('Axis ', n_nationkey + 1) ELSE n_name END AS label, NULL::VARCHAR AS summary, concat(lower(n_name), ',x') AS keywords, n_name AS topic_labels,
  (CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE 1 END)::INTEGER AS topic_count, (CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey / 4 ELSE 0 END)::DOUBLE AS corpus_weight, n_regionkey::INTEGER AS cluster_id, 'c' AS cluster_label FROM nation)"""


@query(f"WITH {_AXES} SELECT * FROM ax")
def sc18_axis_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _axes(spark, d).withColumns({c: F.array_join(c, ",") for c in ("keywords", "topic_labels")})


@query("SELECT CASE WHEN r_regionkey % 2 = 0 THEN concat('f', r_regionkey) ELSE concat('family-', r_regionkey) END AS family_id, CASE WHEN r_regionkey < 3 THEN r_name WHEN r_regionkey = 3 THEN 'family-3' ELSE 'f4' END AS label, 'a' AS keywords, (r_regionkey / 2)::DOUBLE AS esg_relevance FROM region")
def sc18_family_catalog(spark: SparkSession, d: str) -> DataFrame:
    return _families(spark, d).withColumn("keywords", F.array_join("keywords", ","))


@query(f"WITH {COMPANIES}, {_AXES} SELECT count(*) AS companies, count(profitability_score) > 0 AS has_profitability_score, count(technical_score) > 0 AS has_technical_score, (SELECT count(DISTINCT p_brand) FROM part) AS categories, (SELECT count(*) FROM region) AS families, (SELECT count(*) FROM ax) AS axes, (SELECT count(DISTINCT cluster_id) FROM ax) AS clusters FROM master")
def sc19_composite_catalog(spark: SparkSession, d: str) -> DataFrame:
    categories = b.read(spark, d, "part").select("p_brand").distinct()
    return files.composite_catalog(_master(spark, d), categories, _axes(spark, d), _families(spark, d), ["profitability_score", "technical_score"])


@query("SELECT 'master' AS name, true AS present, count(*) AS rows FROM supplier UNION ALL SELECT 'technicals', false, 0")
def sc19_data_status(spark: SparkSession, d: str) -> DataFrame:
    return files.data_status(spark, {"master": _lines(spark, _suppliers(spark, d)), "technicals": f"{files.scratch(spark)}/technicals.jsonl"})


@query("SELECT c_custkey::VARCHAR AS symbol, c_mktsegment AS industry, round(c_acctbal, 2) AS roe FROM customer")
def tx11_header_mapping(spark: SparkSession, d: str) -> DataFrame:
    """A table whose headers go by other names, found by aliases whatever their case and signs."""
    path = files.scratch(spark)
    c = b.read(spark, d, "customer").select(F.col("c_custkey").alias("Ticker "), F.col("c_mktsegment").alias("INDUSTRY"), F.format_string("%.2f", "c_acctbal").alias("Return on Equity (%)"), F.lit("x").alias("other"))
    c.write.option("header", True).csv(path)
    df = files.csv_table(spark, path)
    found = files.header_mapping(df.columns, {"symbol": ["ticker"], "industry": [], "roe": ["ROE", "return_on_equity"]})
    named = df.select(*[F.col(f"`{source}`").alias(name) for name, source in found.items()])
    return named.select("symbol", "industry", text.ratio("roe").alias("roe"))


def _category() -> Column:
    return F.regexp_replace("p_brand", "#", "-")


def _saved_pages(spark: SparkSession, d: str) -> str:
    """Parts as listing pages of ten, by brand."""
    path = files.scratch(spark)
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    rows = b.read(spark, d, "part").withColumn("n", F.row_number().over(w) - 1)
    rows = rows.select(_category().alias("category"), (F.floor(F.col("n") / 10) + 1).cast("int").alias("page"), (F.col("n") % 10).cast("int").alias("place"), F.col("p_name").alias("item"))
    paged.save_pages(rows, path)
    return path


_PAGES = "SELECT replace(p_brand, '#', '-') AS category, (n // 10 + 1)::INTEGER AS page, (n % 10)::INTEGER AS place, p_name AS item FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part)"


@query(_PAGES)
def sc12_paged_listing(spark: SparkSession, d: str) -> DataFrame:
    spark.dataSource.register(paged.PagedListing)
    root = _saved_pages(spark, d)
    categories = [r[0] for r in b.read(spark, d, "part").select(_category()).distinct().collect()]  # what the crawl is asked for
    reader = spark.read.format("paged_listing").option("provider", "sieveline.sources.paged:SavedPages").option("root", root)
    return reader.option("categories", json.dumps(categories)).load()


# --- sinks


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::INTEGER AS s_nationkey FROM supplier")
def sk1_json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    files.write_json_lines(_suppliers(spark, d), path)
    return files.json_lines(spark, path, _SUPPLIER)


@query("SELECT c_custkey::BIGINT AS c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS segment FROM customer")
def sk2_csv_fields(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    segment = F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment"))
    files.write_csv(b.read(spark, d, "customer").withColumn("segment", segment), path, ["c_custkey", "segment"])
    return files.csv_table(spark, path, "c_custkey long, segment string")


@query("SELECT count(*) AS rows, count(o_totalprice) AS n_o_totalprice, 7 AS param_seed, (SELECT string_agg(concat(k, ':', n), ',' ORDER BY k) FROM (SELECT o_orderpriority AS k, count(*) AS n FROM orders GROUP BY 1)) AS by_priority FROM orders")
def sk3_run_summary(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    made = files.run_summary(b.read(spark, d, "orders"), ["o_totalprice"], {"seed": 7}, ("o_orderpriority",))
    files.write_json_lines(made, path)
    back = files.json_lines(spark, path, "rows long, n_o_totalprice long, param_seed int, by_o_orderpriority map<string, long>")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("by_o_orderpriority")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return back.select("rows", "n_o_totalprice", "param_seed", shown.alias("by_priority"))


@query(f"WITH {COMPANIES} SELECT symbol, company_name, category, industry, NULL::VARCHAR AS roe, NULL::VARCHAR AS source, NULL::VARCHAR AS as_of_date FROM companies")
def sk4_template(spark: SparkSession, d: str) -> DataFrame:
    path = files.scratch(spark)
    made = files.template(b.companies(spark, d), ["roe"])
    files.write_csv(made, path, made.columns)
    return files.csv_table(spark, path, ", ".join(f"{c} string" for c in made.columns))


@query("SELECT concat('| ', r_regionkey, ' | ', r_name, ' |') AS line FROM region UNION ALL SELECT unnest(['# Regions', '## All', '| r_regionkey | r_name |', '|---|---|'])")
def sk5_report(spark: SparkSession, d: str) -> DataFrame:
    made = files.report("Regions", {"All": b.read(spark, d, "region").select("r_regionkey", "r_name")})
    return spark.read.text(files.write_file(spark, f"{files.scratch(spark)}/report.md", made)).where("value != ''").select(F.col("value").alias("line"))


@query("SELECT 'All' AS section, r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def sk5_report_json(spark: SparkSession, d: str) -> DataFrame:
    made = files.report_json("Regions", {"All": b.read(spark, d, "region").select("r_regionkey", "r_name")})
    path = files.write_file(spark, f"{files.scratch(spark)}/report.json", made)
    rows = spark.read.schema("sections map<string, array<struct<r_regionkey: long, r_name: string>>>").json(path).select(F.explode("sections").alias("section", "rows"))
    return rows.select("section", F.inline("rows"))


@query("SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::INTEGER AS s_nationkey FROM supplier")
def sk6_resumed_append(spark: SparkSession, d: str) -> DataFrame:
    path, rows = files.scratch(spark), _suppliers(spark, d)
    commits.append_missing(rows.where("s_suppkey % 3 = 0"), path, "s_suppkey")
    commits.append_missing(rows, path, "s_suppkey", "all")
    commits.append_missing(rows, path, "s_suppkey", "all")
    return commits.read(spark, path, _SUPPLIER)


@query("SELECT r_regionkey::BIGINT AS r_regionkey, true AS refused FROM region")
def sk7_overwrite_guard(spark: SparkSession, d: str) -> DataFrame:
    path, rows, refused = files.scratch(spark), b.read(spark, d, "region").select("r_regionkey"), False
    files.write_json_lines(rows, path, overwrite=False)
    try:
        files.write_json_lines(rows.limit(0), path, overwrite=False)
    except Exception as e:  # noqa: BLE001  what Spark raises has no type of its own here
        refused = "PATH_ALREADY_EXISTS" in str(e)
    return files.json_lines(spark, path, "r_regionkey long").withColumn("refused", F.lit(refused))


@query("SELECT concat(conv_id, '-', turn) AS id, CASE WHEN turn % 2 = 0 THEN concat('2025-', turn) ELSE '' END AS datetime, CASE WHEN role = 'user' THEN 'user' ELSE 'unknown' END AS username, text[1:180] AS text FROM conversations")
def sk8_message_index(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "conversations")
    made = c.select(F.concat("conv_id", F.lit("-"), "turn").alias("id"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit("2025-"), "turn")).alias("datetime"), F.when(F.col("role") == "user", "user").otherwise(" ").alias("username"), "text")
    return files.message_index(made)


# --- identity and text


@query("SELECT conv_id AS id, text, turn::BIGINT AS _ord FROM conversations WHERE true QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1")
def id7_first_messages(spark: SparkSession, d: str) -> DataFrame:
    return identity.first_messages(b.read(spark, d, "conversations").select(F.col("conv_id").alias("id"), "text", F.col("turn").cast("long").alias("_ord")))


@query("WITH e AS (SELECT o_custkey, o_orderkey, concat('e', o_orderkey % 3) AS id, repeat('x', (o_orderkey % 11)::INTEGER) AS text, CASE WHEN o_orderkey % 2 = 0 THEN concat('t', o_orderkey) END AS datetime FROM orders), m AS (SELECT o_custkey, id, max(length(text)) AS n, coalesce(arg_min(datetime, o_orderkey), '') AS datetime, min(o_orderkey) AS place FROM e GROUP BY o_custkey, id) SELECT o_custkey AS id, string_agg(concat(id, ':', n, ':', datetime), ',' ORDER BY place) AS embeds FROM m GROUP BY o_custkey")
def id6_upsert_embeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    embed = F.struct(F.concat(F.lit("e"), k % 3).alias("id"), F.repeat(F.lit("x"), (k % 11).cast("int")).alias("text"), F.when(k % 2 == 0, F.concat(F.lit("t"), k)).alias("datetime"))
    rows = b.read(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.lit("m").alias("text"), F.array(embed, embed.withField("id", F.lit(""))).alias("embeds"), k.alias("_ord"))
    shown = F.transform("embeds", lambda e: F.concat(e["id"], F.lit(":"), F.length(e["text"]), F.lit(":"), F.coalesce(e["datetime"], F.lit(""))))
    return identity.upsert_messages(rows).select("id", F.array_join(shown, ",").alias("embeds"))


@query("SELECT p_partkey, length(p_name)::INTEGER AS text_length, false AS is_text_empty, (p_partkey % 4)::INTEGER AS n_media FROM part")
def tx12_text_shape(spark: SparkSession, d: str) -> DataFrame:
    media = F.when(F.col("p_partkey") % 4 > 0, F.array_repeat("p_brand", (F.col("p_partkey") % 4).cast("int")))
    return b.read(spark, d, "part").withColumn("media", media).select("p_partkey", *[c.alias(k) for k, c in text.text_shape("p_name", "media").items()])


@query("SELECT p_partkey, concat(p_name, ' ', p_type, chr(10), ' ', p_brand, ' ') AS prompt FROM part")
def tx16_printable(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat("p_name", F.lit("`"), "p_type", F.lit("\n\x07"), "p_brand", F.lit("\x7f"))
    return b.read(spark, d, "part").select("p_partkey", text.printable(raw).alias("prompt"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'n/d' WHEN c_custkey % 5 = 1 THEN printf('%.2f T', v / 1e12) WHEN c_custkey % 5 = 2 THEN printf('%.2f B', v / 1e9) WHEN c_custkey % 5 = 3 THEN printf('%.2f M', v / 1e6) ELSE printf('%.2f', v) END AS shown, printf('%.2f%%', c_custkey / 16 * 100) AS percent FROM (SELECT c_custkey, (c_custkey % 97 + 1.25) * CASE c_custkey % 5 WHEN 1 THEN 1e12 WHEN 2 THEN 1e9 WHEN 3 THEN 1e6 ELSE 1 END AS v FROM customer)")
def tx19_human_numbers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    v = (k % 97 + 1.25) * F.when(k % 5 == 1, 1e12).when(k % 5 == 2, 1e9).when(k % 5 == 3, 1e6).otherwise(1.0)
    return b.read(spark, d, "customer").select("c_custkey", text.human_number(F.when(k % 5 != 0, v)).alias("shown"), text.human_percent(k / 16).alias("percent"))


@query("SELECT p_partkey, concat('P', p_partkey) AS symbol, p_brand AS category, p_type AS industry, CASE WHEN p_partkey % 2 = 0 THEN p_size END::BIGINT AS post_count FROM part WHERE p_partkey % 5 > 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 5 = 0")
def tx20_prompt_header(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    line = F.concat(F.lit("Company: P"), k, F.lit(" | Category:  "), "p_brand", F.lit(" | Industry: "), "p_type", F.lit(" \nTotal posts collected: "), F.when(k % 2 == 0, F.col("p_size").cast("string")).otherwise("none"))
    raw = F.when(k % 5 > 0, line).otherwise(F.concat(F.lit("Total posts collected: "), "p_size"))
    return b.read(spark, d, "part").select("p_partkey", raw.alias("t")).select("p_partkey", *[c.alias(n) for n, c in text.prompt_header("t").items()])


@query("SELECT count(*) AS total, count(*) AS passed, 1.0::DOUBLE AS coverage FROM documents")
def fl2_passthrough(spark: SparkSession, d: str) -> DataFrame:
    p = rules.passthrough(b.posts(spark, d))
    return p.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.round(F.avg("filter_score"), 4).alias("coverage"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END::DOUBLE AS score FROM customer")
def fu4_sentiment_value(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    label = F.when(k == 0, " Positive").when(k == 1, "NEGATIVE").when(k == 2, "mixed")
    return b.read(spark, d, "customer").select("c_custkey", rules.sentiment_value(label).alias("score"))


@query("SELECT concat('P', l_partkey) AS symbol, min(CASE WHEN r = 1 THEN l_linenumber END)::INTEGER AS a1, min(CASE WHEN r = 2 THEN l_linenumber END)::INTEGER AS a2, min(CASE WHEN r = 3 THEN l_linenumber END)::INTEGER AS a3 FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber) AS r FROM (SELECT DISTINCT l_partkey, l_linenumber FROM lineitem)) GROUP BY 1")
def jn2_axis_columns(spark: SparkSession, d: str) -> DataFrame:
    axis = F.struct(F.col("axis_id").alias("axis_label"), F.col("raw").alias("axis_score"), F.col("exposure").alias("axis_exposure"), F.lit(1.0).alias("axis_confidence"))
    nested = b.axis_scores(spark, d).groupBy("symbol").agg(F.array_sort(F.collect_list(axis)).alias("axes"))  # seven axes at most
    wide = portfolio.axis_columns(nested, "axes", 3)
    return wide.select("symbol", *[F.col(f"custom_esg_axis_{i}_label").alias(f"a{i}") for i in (1, 2, 3)])


# --- topics


_QUALITY = """k AS (SELECT p_partkey AS topic_id, unnest(string_split(p_name, ' ')) AS k, p_size AS posts, (p_partkey % 21 - 10) / 20 AS s FROM part),
q AS (SELECT topic_id, count(*) AS n, sum((k IN ('blue', 'green'))::INTEGER) AS gen, sum((k = 'green')::INTEGER) AS dom, sum((k IN ('red', 'green'))::INTEGER) AS noisy, any_value(posts) AS posts, any_value(s) AS s FROM k GROUP BY 1),
v AS (SELECT *, 0.38 * (1 - gen / n) + 0.16 * (1 - dom / n) + 0.16 * (1 - noisy / n) + 0.20 * least(1.0, (topic_id % 12) / 8) AS spec, least(1.0, ln(1 + posts) / ln(3001)) AS sup, least(1.0, abs(s) * 2.5) AS st FROM q),
w AS (SELECT *, least(1.0, greatest(0.0, 0.52 * spec + 0.30 * sup + 0.18 * st - 0.30 * noisy / n)) AS rel FROM v)"""


def _topics(spark: SparkSession, d: str) -> DataFrame:
    p = b.read(spark, d, "part")
    made = p.select(F.col("p_partkey").alias("topic_id"), F.split("p_name", " ").alias("keywords"), (F.col("p_partkey") % 12).alias("example_tokens"), F.col("p_size").alias("posts_with_topic"), ((F.col("p_partkey") % 21 - 10) / 20).alias("average_sentiment"))
    return discourse.topic_quality(made, ("blue",), ("green",), ("red",))


@query(f"WITH {_QUALITY} SELECT topic_id, round(least(1.0, greatest(0.0, spec)), 4) AS specificity, round(sup, 4) AS support, round(st, 4) AS sentiment_strength, round(rel, 4) AS value_relevance, round(gen / n, 4) AS generic_ratio, round(dom / n, 4) AS domain_ratio, round(noisy / n, 4) AS noise_ratio FROM w")
def cl7_topic_quality(spark: SparkSession, d: str) -> DataFrame:
    return _topics(spark, d)


@query("WITH n AS (SELECT DISTINCT o_orderkey AS n FROM orders) SELECT n, CASE WHEN n <= 0 THEN 0 ELSE greatest(CASE WHEN n >= 5000 THEN 12 ELSE 6 END, least(40, CASE WHEN n >= 20000 THEN 72 WHEN n >= 10000 THEN 56 ELSE 24 END, greatest(n - 1, 1))) END::INTEGER AS topics, least(20, greatest(2, n // 50))::INTEGER AS least FROM n")
def ml6_topic_count(spark: SparkSession, d: str) -> DataFrame:
    n = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("n")).distinct()
    return n.select("n", models.topic_count(F.col("n"), 40).alias("topics"), models.least_documents(F.col("n")).alias("least"))


@query(f"WITH {_QUALITY}, z AS (SELECT topic_id, round(rel, 4) AS value_relevance, round(least(1.0, greatest(0.0, spec)), 4) >= 0.22 AND round(dom / n, 4) < 0.55 AND round(noisy / n, 4) < 0.50 AS passes, round(sup, 4) AS sup FROM w), r AS (SELECT *, row_number() OVER (ORDER BY passes DESC, value_relevance DESC, sup DESC, topic_id) AS rn FROM z) SELECT topic_id, passes, (passes AND rn <= 36) OR rn <= 24 AS chosen FROM r")
def ml9_selected_topics(spark: SparkSession, d: str) -> DataFrame:
    return discourse.select_topics(_topics(spark, d), 36).select("topic_id", "passes", "chosen")


# --- streams


def _batches(spark: SparkSession, d: str) -> str:
    """Messages in files, several versions of each over the files."""
    path = files.scratch(spark)
    c = b.read(spark, d, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("id"), F.concat(F.lit("/m/"), "turn").alias("url"), "role", F.lit(None).cast("string").alias("datetime"), "text", F.col("turn").cast("long").alias("_ord")).withColumnRenamed("role", "username")
    rows.repartition(4, "_ord").write.json(path)
    return path


@query("SELECT conv_id::VARCHAR AS id, concat('/m/', max(turn)) AS url, arg_max(text, length(text) * 1000 - turn) AS text, count(*) AS versions FROM conversations GROUP BY conv_id")
def st1_upserted_stream(spark: SparkSession, d: str) -> DataFrame:
    folder = files.scratch(spark)
    upserts.upsert_stream(upserts.message_stream(spark, _batches(spark, d), files=1), f"{folder}/store", f"{folder}/state")
    return upserts.current(spark, f"{folder}/store").select("id", "url", "text", "versions")


@query("WITH e AS (SELECT turn AS step, conv_id % 3 AS id FROM conversations), f AS (SELECT id, min(step) AS step FROM e GROUP BY id), s AS (SELECT DISTINCT step FROM e), q AS (SELECT step, sum((step NOT IN (SELECT step FROM f))::INTEGER) OVER (ORDER BY step ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS quiet FROM s) SELECT min(CASE WHEN quiet >= 2 THEN step END)::BIGINT AS stop_at FROM q")
def st2_last_extract(spark: SparkSession, d: str) -> DataFrame:
    c = b.read(spark, d, "conversations")
    return upserts.last_extract(c.select(F.col("turn").cast("long").alias("step"), (F.col("conv_id") % 3).alias("id")), 2)


@query("SELECT DISTINCT concat('C', c_custkey) AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderpriority = '1-URGENT')")
def st3_open_symbols(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderkey") % 3 == 1, "done").when(F.col("o_orderkey") % 3 == 2, "failed").otherwise("started")
    journal = b.read(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("C"), "o_custkey").alias("symbol"), status.alias("status"))
    return upserts.open_symbols(b.read(spark, d, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol")).distinct(), journal)


@query("SELECT p_brand AS category, max(p_size) + 1 AS next_page FROM part GROUP BY 1")
def st4_resume_pages(spark: SparkSession, d: str) -> DataFrame:
    return upserts.resume_pages(b.read(spark, d, "part").select(F.col("p_brand").alias("category"), F.col("p_size").alias("page")))


@query("SELECT event_type AS id, min(ts) AS first_seen_at, max(ts) AS updated_at FROM events GROUP BY 1")
def st5_seen_times(spark: SparkSession, d: str) -> DataFrame:
    return upserts.seen_times(b.read(spark, d, "events").select(F.col("event_type").alias("id"), F.col("ts").alias("seen_at")))


@query("SELECT count(*) + 1 AS rows, 2 AS loads FROM supplier")
def st6_signature_cache(spark: SparkSession, d: str) -> DataFrame:
    path, cache = files.scratch(spark), files.SignatureCache()
    _suppliers(spark, d).write.json(path)
    load = lambda p: files.json_lines(spark, p, _SUPPLIER)
    cache.get(spark, "supplier", path, load)
    cache.get(spark, "supplier", path, load)
    _suppliers(spark, d).limit(1).write.mode("append").json(path)
    return cache.get(spark, "supplier", path, load).agg(F.count("*").alias("rows"), F.lit(cache.loads).alias("loads"))
