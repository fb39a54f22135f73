import pytest

from sieveline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(same_as_sql, name):
    same_as_sql(catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.queries()[name](spark, sf_dir).columns


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_text_queries_over_all_languages_equal_plain_ones(spark, sf_dir):
    import collections
    import re

    from pyspark.sql import functions as F

    from sieveline.functions import text

    domain = r"\b\w[\w.-]*\.(?:com|app|gov|net|org|io|in|co)\b(?:/\S*)?"
    topic_domain = r"(?i)\b(?:[a-z0-9-]+\.)+(?:com|net|org|io|co|ai|gov|edu|biz|info|me|ca|uk|de|fr|jp|cn|ly|gg)\b(?:/\S*)?"

    def plain(t, *more):
        t = t.lower()
        for p in (r"https?://\S+", topic_domain, r"\$[A-Za-z][A-Za-z0-9.\-]*", r"@[A-Za-z0-9_]+", *more, r"[^a-z\s]", r"\s+"):
            t = re.sub(p, " ", t)
        return t.strip()

    def post(t):
        for p in ("(?i)" + domain, "(?i)instant stock alerts on whatsapp", "(?i)try free", r"\s+"):
            t = re.sub(p, " ", t)
        return t.strip()

    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    run = lambda name: {r[0]: r[1] for r in catalog.queries()[name](spark, sf_dir).collect()}
    templates = {i: plain(t, r"\d+") for i, t in rows.items()}
    assert run("tx2_topic_text") == {i: plain(t) for i, t in rows.items()} and run("tx3_template_text") == templates
    assert run("tx8_clean_post") == {i: post(t) for i, t in rows.items()}
    count = collections.Counter(templates.values())
    hints = {"the", "that", "with", "from", "were"}
    tokens = {i: set(re.findall("[a-z]{2,}", t)) for i, t in templates.items()}
    want = {i: "inst" in t.lower() or len(tokens[i] & hints) >= 4 and len(tokens[i]) <= 18 or count[templates[i]] >= 40 and len(templates[i].split()) >= 5 for i, t in rows.items()}
    assert run("fl5_boilerplate") == want
    odd = ["aü.com/x ö", "über.com", "x http://a.b\u00a0stays é", "Ünstant TRY\u2003FREE try free\u00a0\u3000x", "y.co\u0301 z.coé a.in/ü\u2028b", "\x1cq.io\x1d r", "see sub.site.ai/x and a.de,b.uk;c.fr mail@host.edu x-y.me é-z.gg _q.com 3.14 app.app"]
    made = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").select("i", text.topic_text("t").alias("a"), text.clean_post("t").alias("b"), F.col("t")).collect()
    assert [(r["a"], r["b"]) for r in sorted(made)] == [(plain(t), post(t)) for t in odd]


def test_boilerplate_counts_templates(spark, tmp_path):
    rows = [(i, f"un deux trois quatre cinq {i}", "fr") for i in range(40)] + [(50 + i, f"six sept huit neuf dix {i}", "fr") for i in range(39)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0]: r[1] for r in catalog.queries()["fl5_boilerplate"](spark, str(tmp_path)).collect()} == {i: i < 50 for i, _, _ in rows}


def test_redundant_categories_equal_a_plain_pass(spark):
    import random

    from sieveline.operators import discourse

    random.seed(4)
    sets = {f"c{i:02}": set(random.sample(range(30), random.randint(3, 25))) for i in range(25)}
    sets["c90"], sets["c91"] = set(sorted(sets["c00"])[:3]), set(sets["c01"])
    n = {c: len(s) for c, s in sets.items()}
    dropped = {}
    for rule in ("contained", "like"):
        pairs = sorted(((a, b) for a in sets for b in sets if a < b and sets[a] & sets[b]), key=lambda p: (-max(n[p[0]], n[p[1]]), p))
        for a, b in pairs:
            big, less = (a, b) if (n[a], b) >= (n[b], a) else (b, a)
            both = len(sets[a] & sets[b])
            if a not in dropped and b not in dropped and (both >= 0.85 * n[less] if rule == "contained" else both >= 0.6 * len(sets[a] | sets[b])):
                dropped[less] = big
    rows = spark.createDataFrame([(c, f"t{t}") for c, s in sets.items() for t in s], "category string, ticker string")
    assert dropped and sorted(map(tuple, discourse.redundant_categories(rows).collect())) == sorted(dropped.items())


def test_overlaps_of_a_hot_ticker_equal_all_pairs(spark, monkeypatch):
    """One ticker is in all categories, dealt in blocks of three; samples are the first tickers."""
    import itertools
    import random

    from sieveline.operators import discourse

    monkeypatch.setattr(discourse, "HOT_TICKER", 3)
    rng = random.Random(3)
    own = {f"c{i:02d}": {"HOT", *(f"T{rng.randrange(30)}" for _ in range(rng.randrange(12)))} for i in range(25)}
    rows = spark.createDataFrame([(c, t) for c, ts in own.items() for t in ts] * 2, "category string, ticker string")
    got = {(r["a"], r["b"]): (r["shared"], r["sample"]) for r in discourse.category_overlaps(rows, 2).collect()}
    assert got == {(a, b): (len(both), ",".join(sorted(both)[:2])) for a, b in itertools.combinations(sorted(own), 2) if (both := own[a] & own[b])}
    assert discourse.category_overlaps(rows.limit(0)).count() == 0 and discourse.redundant_categories(rows.limit(0)).count() == 0


def test_stratified_sample_equals_a_plain_one(spark):
    import struct

    import xxhash

    from sieveline.operators import statistics

    rows = [(f"k{i}", f"s{i % 7 % 4}") for i in range(90)]
    turn = lambda k: struct.unpack("<q", struct.pack("<Q", xxhash.xxh64(struct.pack("<i", 42), seed=xxhash.xxh64(k.encode(), seed=42).intdigest()).intdigest()))[0]
    groups = {s: sorted((k for k, t in rows if t == s), key=lambda k: (turn(k), k)) for s in {t for _, t in rows}}
    want = sorted((i + 1, s, k) for s, own in groups.items() for i, k in enumerate(own))[:30]
    made = statistics.stratified_sample(spark.createDataFrame(rows, "k string, s string"), "s", "k", 30, 42)
    assert sorted((r["turn"], r["s"], r["k"]) for r in made.collect()) == want


def test_fused_profiles_on_cases(spark):
    from sieveline.operators import discourse

    part = lambda rows: spark.createDataFrame(rows, "symbol string, post_count long, axiological_coverage double")
    filters = {"seed": part([("A", 10, 0.5), ("B", 4, 0.0)]), "embed": part([("A", 20, 0.25), ("C", 8, 0.02)])}
    frame = "array<struct<label:string,sentiment:string>>"
    model = spark.createDataFrame([("A", 30, [("x", "positive"), (" X", "neutral")], False), ("D", 5, [], True)], f"symbol string, post_count long, frames {frame}, error boolean")
    got = {r["symbol"]: r for r in discourse.fuse_profiles(filters, model).collect()}
    assert sorted(got) == ["A", "B", "C", "D"]
    a, b, c, e = (got[k] for k in "ABCD")
    assert (a["post_count"], a["axiological_coverage"], a["coverage_seed"], a["coverage_embed"], a["n_frames"], a["methods"], a["has_signal"]) == (30, 0.5, 0.5, 0.25, 1, 3, True)
    assert (b["methods"], b["has_signal"], b["profile_null"]) == (0, False, True)
    assert (c["post_count"], c["axiological_coverage"], c["methods"], c["profile_null"]) == (8, 0.02, 1, True)
    assert (e["post_count"], e["n_frames"], e["methods"], e["confidence"]) == (5, 0, 0, 0.0)


def test_family_preview_takes_equal_rows_as_they_lie(spark, tmp_path):
    """Lines that repeat order, number and part, in two files of which the later is the larger one and read first."""
    import random

    import duckdb
    import pyarrow as pa
    import pyarrow.parquet as pq

    from sieveline.plans import catalog

    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    for name, tax, copies in (("a", 0.01, 1), ("b", 0.02, 50)):
        rows = [(i, j, 7, (i * j + (c + j + 1) * (name == "b")) % 5 / 100, tax) for i in range(40) for c in range(copies) for j in range(3)]
        columns = dict(zip(["l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax"], map(list, zip(*rows, strict=True)), strict=True))
        columns["l_extendedprice"] = [random.random() for _ in rows]
        pq.write_table(pa.table(columns), folder / f"{name}.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    want = con.execute(catalog.oracle_sql()["pf16_family_preview"]).fetchall()
    assert sorted(map(tuple, catalog.queries()["pf16_family_preview"](spark, str(tmp_path)).collect())) == sorted(want)
