"""File sources and sinks (SC, SK). Schemas are given; nothing is inferred."""

from __future__ import annotations

import base64
import functools
import html.parser
import json
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_label, header_key
from .commits import _store


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSONL; blank lines are skipped. A malformed line is fatal when ``strict``, else left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; Spark drops a byte order mark."""
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).csv(path)


def json_document(spark: SparkSession, path: str, schema: str, items: str) -> DataFrame:
    """Rows of a nested array in one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode(items).alias("x")).select("x.*")


RUN_PATH = r"/([^/]+)/runs/([^/]+)/messages/([^/]+)/"


def latest_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """<symbol>/runs/<time>/messages/<id>/*.json: messages of each symbol's latest run."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("multiLine", True).json(root).withColumn("path", F.col("_metadata.file_path"))
    df = df.select("*", F.upper(F.regexp_extract("path", RUN_PATH, 1)).alias("symbol"), F.regexp_extract("path", RUN_PATH, 2).alias("source_run"), F.regexp_extract("path", RUN_PATH, 3).alias("message_id")).where("source_run != ''")
    last = df.groupBy("symbol").agg(F.max("source_run").alias("source_run"))
    return df.join(last, ["symbol", "source_run"]).drop("path")


def run_counts(messages: DataFrame, symbols: DataFrame) -> DataFrame:
    """Messages of every symbol, 0 without a run."""
    return symbols.select("symbol").join(messages.groupBy("symbol").agg(F.count("*").alias("posts")), "symbol", "left").select("symbol", F.coalesce("posts", F.lit(0)).alias("posts"))


def category_catalog(df: DataFrame) -> DataFrame:
    return df.withColumn("name", clean_label("name")).orderBy(F.lower("name"))


def exists(spark: SparkSession, path: str) -> bool:
    store, there = _store(spark, path)
    return store.exists(there)


def write_file(spark: SparkSession, path: str, data: bytes | str) -> str:
    """One small file, from the driver."""
    store, there = _store(spark, path)
    out = store.create(there, True)
    out.write(bytearray(data.encode() if isinstance(data, str) else data))
    out.close()
    return path


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, below spark.checkpoint.dir; a session in one process may do without that setting. It goes
    when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
    path = f"{base or tempfile.gettempdir()}/files-{uuid.uuid4().hex}"
    store, there = _store(spark, path)
    store.mkdirs(there.getParent())
    store.deleteOnExit(there)  # with the session: what a query reads from it is read lazily
    return path


def resolve(spark: SparkSession, path: str, fallback: str) -> str:
    """The real path if it is there, else the fixture; the real one if neither is."""
    return path if exists(spark, path) or not exists(spark, fallback) else fallback


class SignatureCache:
    """Loaded frames by name, kept for as long as modification time and size of what lies at their path stay the same."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[object, DataFrame]] = {}
        self.loads = 0

    def signature(self, spark: SparkSession, path: str) -> tuple[int, int] | None:
        store, there = _store(spark, path)
        if not store.exists(there):
            return None
        if store.getFileStatus(there).isFile():
            found = [store.getFileStatus(there)]
        else:
            found = [f for f in store.listStatus(there) if not f.getPath().getName().startswith((".", "_"))]
        return max((f.getModificationTime() for f in found), default=0), sum(f.getLen() for f in found)

    def get(self, spark: SparkSession, name: str, path: str, load: Callable[[str], DataFrame]) -> DataFrame:
        now, old = self.signature(spark, path), self.kept.get(name)
        if old is not None and old[0] == now:
            return old[1]
        if old is not None:
            old[1].unpersist()
        self.loads += 1
        self.kept[name] = now, load(path).persist()
        return self.kept[name][1]


def flat_members(df: DataFrame, key: str, lists: list[str], maps: list[str]) -> DataFrame:
    """key, rank, ticker: the first list column that holds anything, else the keys of the first map."""
    ways = [F.when(F.size(c) > 0, F.col(c)) for c in lists] + [F.when(F.size(F.map_keys(c)) > 0, F.map_keys(c)) for c in maps]
    return df.select(key, F.posexplode(F.coalesce(*ways)).alias("rank", "ticker")).withColumn("rank", F.col("rank") + 1)


def provider_fields(record: str, fields: dict[str, str], digits: int = 4) -> list[Column]:
    """Numbers from a map column by provider key, null-safe and rounded."""
    return [F.round(F.try_element_at(record, F.lit(k)).try_cast("double"), digits).alias(name) for name, k in fields.items()]


#: Metrics and the provider's names for them.
FUNDAMENTALS = {"net_margin": "profitMargins", "operating_margin": "operatingMargins", "roe": "returnOnEquity", "roa": "returnOnAssets", "revenue_growth": "revenueGrowth"}


def fundamentals(record: str) -> list[Column]:
    """The provider's fundamentals from a map column, to six digits."""
    return provider_fields(record, FUNDAMENTALS, 6)


def _texts(c: str) -> Column:
    """The items of a list that aren't blank, trimmed."""
    return F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")


def axis_catalog(axes: DataFrame) -> DataFrame:
    """Axis definitions: the display label, else the label, else a numbered one; lists without blank items; missing numbers are 0."""
    some = lambda c: F.when(F.col(c) != "", F.col(c))
    label = F.trim(F.coalesce(some("axis_display_label"), some("axis_label"), F.concat(F.lit("Axis "), F.col("axis_id") + 1)))
    labels = _texts("topic_labels")
    return axes.select(
        "axis_id", label.alias("label"), F.nullif(F.trim("axis_summary"), F.lit("")).alias("summary"), _texts("keywords").alias("keywords"), labels.alias("topic_labels"),
        F.coalesce("topic_count", F.size(labels)).alias("topic_count"), F.coalesce("corpus_weight", F.lit(0.0)).alias("corpus_weight"), "cluster_id", "cluster_label",
    )


def family_definitions(families: DataFrame, place: str = "position") -> DataFrame:
    """Families by falling relevance, then label in lower case; a missing id follows from the place, a missing label from the id."""
    family = F.trim(F.coalesce(F.when(F.col("family_id") != "", F.col("family_id")), F.concat(F.lit("family-"), place)))
    named = families.withColumn("family_id", family).where("family_id != ''")
    named = named.withColumn("label", F.trim(F.coalesce(F.when(F.col("family_label") != "", F.col("family_label")), F.col("family_id")))).where("label != ''")
    relevance = F.coalesce("esg_relevance", F.lit(0.0)).alias("esg_relevance")
    return named.select("family_id", "label", _texts("keywords").alias("keywords"), relevance).orderBy(F.col("esg_relevance").desc(), F.lower("label"))


def composite_catalog(companies: DataFrame, categories: DataFrame, axes: DataFrame, families: DataFrame, metrics: list[str]) -> DataFrame:
    """One row: numbers of companies, categories, axes, families and clusters, and whether any company has each metric."""
    # five tables of one row each
    one = companies.agg(F.count("*").alias("companies"), *[(F.count(m) > 0).alias(f"has_{m}") for m in metrics])
    one = one.crossJoin(categories.agg(F.count("*").alias("categories"))).crossJoin(families.agg(F.count("*").alias("families")))
    return one.crossJoin(axes.agg(F.count("*").alias("axes"), F.count_distinct("cluster_id").alias("clusters")))


def data_status(spark: SparkSession, artefacts: dict[str, str]) -> DataFrame:
    """name, present, rows of each artefact (a JSONL file or folder); an absent one has 0 rows."""
    found = []
    for name, path in artefacts.items():
        there = exists(spark, path)
        lines = spark.read.text(path).where("trim(value) != ''") if there else None
        found.append((lines.agg(F.count("*").alias("rows")) if there else spark.range(1).select(F.lit(0).cast("long").alias("rows"))).select(F.lit(name).alias("name"), F.lit(there).alias("present"), "rows"))
    return functools.reduce(DataFrame.unionByName, found)


def header_mapping(columns: list[str], aliases: dict[str, list[str]], required: tuple[str, ...] = ("symbol",)) -> dict[str, str]:
    """Target to source column, aliases in order of priority; an error when a required one is missing."""
    by = {header_key(c): c for c in reversed(columns)}
    found = {t: next(by[header_key(a)] for a in [t, *names] if header_key(a) in by) for t, names in aliases.items() if any(header_key(a) in by for a in [t, *names])}
    if gone := [r for r in required if r not in found]:
        raise ValueError(f"no column for {', '.join(gone)}")
    return found


def uploaded(spark: SparkSession, name: str, content: str, folder: str, stamp: str) -> str:
    """Writes a base64 upload under a safe, stamped name."""
    data = base64.b64decode(content, validate=True)
    if not data:
        raise ValueError("the file is empty")
    safe = re.sub(r"[^A-Za-z0-9._-]+", "_", os.path.basename(name)).strip("._") or "upload.csv"
    return write_file(spark, f"{folder}/{stamp}_{safe}", data)


class _Tables(html.parser.HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag: str) -> None:
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data: str) -> None:
        if self.cell is not None:
            self.cell.append(data)


TICKER = re.compile(r"\b([A-Z0-9]{1,6}(?:[.\-][A-Z]{1,4})?)$")


def listing_rows(page: str | None) -> list[tuple[int, str, str]]:
    """rank, ticker, name from the table whose header and cells fit a listing best."""
    parser = _Tables()
    parser.feed(page or "")
    best, score = [], 0
    for t in parser.tables:
        if t and (s := sum(w in " ".join(t[0]).lower() for w in ("name", "rank", "symbol", "cap", "price")) * 10 + len(t)) > score:
            best, score = t, s
    if len(best) < 2:
        return []
    head = [h.lower() for h in best[0]]
    at = next((i for i, h in enumerate(head) if "name" in h or "company" in h), 0)
    out = []
    for i, row in enumerate(best[1:], 1):
        if at < len(row) and (m := TICKER.search(row[at])):
            out.append((i, m[1], row[at][: m.start()].strip()))
    return out


def listings(pages: DataFrame) -> DataFrame:
    """url, rank, ticker, name of saved listing pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(u, *r) for u, h in zip(b["url"], b["html"], strict=True) for r in listing_rows(h)], columns=["url", "rank", "ticker", "name"])

    return pages.select("url", "html").mapInPandas(run, "url string, rank int, ticker string, name string")


def first_rows(df: DataFrame, n: int, order: str = "_ord") -> DataFrame:
    """The first n rows in file order; 0 is no limit."""
    return df.orderBy(order).limit(n) if n else df


def write_json_lines(df: DataFrame, path: str, overwrite: bool = True) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def write_csv(df: DataFrame, path: str, fields: list[str], overwrite: bool = True) -> None:
    """A fixed list of fields, null as empty."""
    df.select(*fields).write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def template(universe: DataFrame, metrics: list[str]) -> DataFrame:
    """The universe with empty metric columns."""
    return universe.select("symbol", "company_name", "category", "industry", *[F.lit("").alias(m) for m in metrics], F.lit("").alias("source"), F.lit("").alias("as_of_date")).orderBy("symbol")


def run_summary(df: DataFrame, columns: list[str], params: dict[str, object], distributions: tuple[str, ...] = ()) -> DataFrame:
    """One row: rows, non-null counts, parameters, and for each column of ``distributions`` (few values) a map of value to count."""
    out = run_counts_row(df, columns, params)
    for c in distributions:
        pairs = df.groupBy(F.coalesce(F.col(c).cast("string"), F.lit("")).alias("key")).agg(F.count("*").alias("value"))
        out = out.crossJoin(pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(f"by_{c}")))
    return out


def run_counts_row(df: DataFrame, columns: list[str], params: dict[str, object]) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), *[F.count(c).alias(f"n_{c}") for c in columns]).withColumns({f"param_{k}": F.lit(v) for k, v in params.items()})


def message_index(messages: DataFrame) -> DataFrame:
    """Newest first by datetime text, defaults for blanks."""
    blank = lambda c, d: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(d)).alias(c)
    return messages.select("id", blank("datetime", ""), blank("username", "unknown"), F.substring(F.coalesce("text", F.lit("")), 1, 180).alias("text")).orderBy(F.col("datetime").desc(), "id")


def report(title: str, sections: dict[str, DataFrame], limit: int = 500) -> str:
    """Markdown of small results; a section of over ``limit`` rows says how many it leaves out."""
    out = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(limit + 1).collect()
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:limit]]
        if len(rows) > limit:
            out += ["", f"{df.count() - limit} more rows"]
    return "\n".join(out) + "\n"


def report_json(title: str, sections: dict[str, DataFrame]) -> str:
    """The same report whole, as one JSON document."""
    return json.dumps({"title": title, "sections": {name: [json.loads(r) for r in df.toJSON().collect()] for name, df in sections.items()}}, ensure_ascii=False)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Adds _ord, an order that increases with ``order`` without being dense (no global window)."""
    return df.orderBy(*order).withColumn("_ord", F.monotonically_increasing_id())


