import json

import pytest
from pyspark.sql import functions as F

from sieveline.operators import identity, series, statistics
from sieveline.sources import commits, files
from sieveline.streaming import upserts


def wilder(v, n=14):
    if len(v) <= n:
        return [None] * len(v)
    d = [b - a for a, b in zip(v, v[1:])]
    g, l = sum(max(x, 0) for x in d[:n]) / n, sum(max(-x, 0) for x in d[:n]) / n  # noqa: E741
    out = [None] * n + [100.0 if l == 0 else 100 - 100 / (1 + g / l)]
    for x in d[n:]:
        g, l = (g * (n - 1) + max(x, 0)) / n, (l * (n - 1) + max(-x, 0)) / n  # noqa: E741
        out.append(100.0 if l == 0 else 100 - 100 / (1 + g / l))
    return out


@pytest.mark.parametrize("n", [1, 14, 15, 26, 60])
def test_indicators_equal_a_loop(spark, n):
    v = [100 + (i * 37 % 11) - i * 0.3 for i in range(n)]
    df = spark.createDataFrame([("S", i, x) for i, x in enumerate(v)], "symbol string, t int, c double")
    got = series.indicators(df, ["t"]).orderBy("t").collect()

    def ema(x, k):
        out = [x[0]]
        for y in x[1:]:
            out.append(y * 2 / (k + 1) + out[-1] * (1 - 2 / (k + 1)))
        return out

    line = [a - b for a, b in zip(ema(v, 12), ema(v, 26))]
    signal = ema(line, 9)
    close = lambda a, b: a is None and b is None or abs(a - b) < 1e-9
    assert all(close(r["rsi14"], w) for r, w in zip(got, wilder(v)))
    assert all(close(r["macd"], line[i] if i >= 25 else None) and close(r["macd_signal"], signal[i] if i >= 25 else None) for i, r in enumerate(got))


def test_flat_series_and_bounds(spark):
    flat = spark.createDataFrame([("S", i, 5.0) for i in range(20)], "symbol string, t int, c double")
    assert series.indicators(flat, ["t"]).orderBy("t").collect()[-1]["rsi14"] == 100
    b = statistics.metric_bounds(spark.createDataFrame([(1.0, 3.0), (1.0, 3.0), (9.0, 3.0)], "a double, b double"), ["a", "b"]).first()
    assert b["b_low"] is None and b["a_low"] == 1.0
    scores = statistics.score_metrics(spark.createDataFrame([(1.0, None), (3.0, None)], "a double, b double"), {"a": 0.4, "b": 0.6}).collect()
    assert [s["metric_completeness"] for s in scores] == [0.4, 0.4] and sorted(s["metric_score"] for s in scores) == [0.0, 100.0]


def test_identity(spark):
    rows = spark.createDataFrame([("a-b", 2, 1), ("A.B", 1, 2), ("A.B", 1, 3), ("C", None, 4)], "symbol string, rank int, _ord long")
    assert [(r["symbol"], r["_ord"]) for r in identity.distinct_universe(rows).orderBy("symbol").collect()] == [("A.B", 2), ("C", 4)]
    cases = [("brk/b ",), ("A2Z.NS",), ("AAWH.U.CSE",), ("ABC",), ("",), ("x.y/l n.v",)]
    spelt = [r["c"] for r in spark.createDataFrame(cases, "s string").select(identity.ticker_candidates("s").alias("c")).collect()]
    assert spelt == [
        ["BRK/B", "BRK.B", "BRK-B", "BRK"], ["A2Z.NS", "A2Z-NS", "A2Z.NSE", "A2Z-NSE", "A2Z"], ["AAWH.U.CSE", "AAWH-U-CSE", "AAWH.U-CSE", "AAWH.U", "AAWH-U", "AAWH"],
        ["ABC"], [], ["X.Y/L N.V", "X.Y.L N.V", "X-Y-L N-V", "X.Y.L N-V", "X.Y.L N-TSXV", "X-Y-L N-TSXV", "X.Y.L N.TSXV", "X.Y.L N", "X-Y-L N", "X", "X.Y-L-N.V"],
    ]
    c = spark.createDataFrame([("BRK/B",)], "s string").select(identity.ticker_candidates("s", {"B": ["X"]}).alias("c")).first()["c"]
    assert c == ["BRK/B", "BRK.B", "BRK-B", "BRK.X", "BRK-X", "BRK"]
    base = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "symbol string, m double")
    raw = spark.createDataFrame([("a", 5.0, 1), ("a", None, 2), ("z", 1.0, 3)], "symbol string, m double, _ord long")
    new, lost = identity.merge_raw(base, raw, ["m"])
    assert {r["symbol"]: r["m"] for r in new.collect()} == {"A": 5.0, "B": 2.0} and [r["symbol"] for r in lost.collect()] == ["Z"]
    assert {r["symbol"]: r["m"] for r in identity.merge_raw(base, raw, ["m"], True)[0].collect()} == {"A": None, "B": 2.0}


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"a": 1}\n\n{"a": \n{"a": 2}\n')
    assert files.json_lines(spark, str(p), "a int", strict=False).count() == 2
    with pytest.raises(Exception):
        files.json_lines(spark, str(p), "a int").collect()
    (tmp_path / "b.csv").write_bytes("﻿Symbol,x\nA,1\n".encode())
    df = files.csv_table(spark, str(tmp_path / "b.csv"))
    assert files.header_mapping(df.columns, {"symbol": ["ticker"], "m": ["x"]}) == {"symbol": "Symbol" if "Symbol" in df.columns else df.columns[0], "m": "x"}
    with pytest.raises(ValueError):
        files.header_mapping(["x"], {"symbol": ["ticker"]})
    for run, ids in (("1", "a"), ("2", "bc")):
        for i in ids:
            m = tmp_path / "tree" / "ACME" / "runs" / run / "messages" / i
            m.mkdir(parents=True)
            (m / "meta.json").write_text(json.dumps({"id": i}))
    runs = files.latest_runs(spark, str(tmp_path / "tree"), "id string")
    assert sorted(r["message_id"] for r in runs.collect()) == ["b", "c"]
    assert commits.append_missing(spark.createDataFrame([("a", 1)], "k string, v int"), str(tmp_path / "out"), "k") == 1
    assert commits.append_missing(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), str(tmp_path / "out"), "k") == 1
    page = "<table><tr><th>#</th><th>Name</th></tr><tr><td>1</td><td>Acme Corp ACM</td></tr></table>"
    assert [tuple(r) for r in files.listings(spark.createDataFrame([("u", page)], "url string, html string")).collect()] == [("u", 1, "ACM", "Acme Corp")]
    made = files.report("T", {"S": spark.range(1, 4)}, limit=2)
    assert "| 1 |" in made and "| 3 |" not in made and "1 more rows" in made


def test_stream_upsert_equals_batch(spark, tmp_path):
    rows = [("1", None, "u", "", "short", 1), ("1", "x", "", "t2", "much longer", 2), ("2", "y", "v", "t3", "b", 3), ("1", "", "w", "t4", "mid text", 4)]
    src = tmp_path / "in"
    src.mkdir()
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, upserts.SCHEMA).coalesce(1).write.mode("append").json(str(src))
    upserts.upsert_stream(upserts.message_stream(spark, str(src), files=1), str(tmp_path / "t"), str(tmp_path / "c"))
    stream = {r["id"]: r for r in upserts.current(spark, str(tmp_path / "t")).collect()}
    batch = {r["id"]: r for r in identity.upsert_messages(spark.createDataFrame(rows, upserts.SCHEMA)).collect()}
    assert stream == batch and stream["1"]["text"] == "much longer" and stream["1"]["url"] == "x" and stream["1"]["datetime"] == "t2" and stream["1"]["username"] == "w"


def test_agreement_matrix(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 3), (3, 3)], "a int, b int")
    r = statistics.agreement(df, "a", "b").first()
    assert r["n"] == 4 and r["exact"] == 0.75 and r["within_one"] == 1.0
    assert statistics.distribution(df, "a", [0, 9]).where(F.col("label") == 9).first()["n"] == 0
