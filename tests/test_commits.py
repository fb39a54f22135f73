"""Committed appends and the stateful upsert: writers that die, repeat or meet each other."""

import os

import pytest
from pyspark.sql import functions as F

from sieveline.operators import identity
from sieveline.sources import commits
from sieveline.streaming import upserts

SCHEMA = "k string, v long"


def rows_of(spark, path):
    return sorted((r["k"], r["v"]) for r in commits.read(spark, path, SCHEMA).collect())


def test_a_writer_that_dies_half_way_is_invisible(spark, tmp_path):
    path = str(tmp_path / "t")
    assert rows_of(spark, path) == [] and commits.append_missing(spark.createDataFrame([("a", 1), ("b", 2)], SCHEMA), path, "k") == 2
    broken = spark.range(0, 4, 1, 4).select(F.concat(F.lit("x"), "id").alias("k"), F.when(F.col("id") == 3, F.raise_error(F.lit("the writer dies")).cast("long")).otherwise(F.col("id")).alias("v"))
    with pytest.raises(Exception, match="the writer dies"):
        commits.append_missing(broken, path, "k")
    assert len(os.listdir(f"{path}/data")) == 2 and rows_of(spark, path) == [("a", 1), ("b", 2)]
    assert commits.append_missing(spark.createDataFrame([("b", 9), ("c", 3)], SCHEMA), path, "k") == 1
    assert commits.sweep(spark, path) == 1 and len(os.listdir(f"{path}/data")) == 2 and rows_of(spark, path) == [("a", 1), ("b", 2), ("c", 3)]
    assert commits.sweep(spark, path) == 0 and len([n for n in os.listdir(f"{path}/manifest") if not n.startswith(".")]) == 1


def test_a_repeated_append_does_nothing(spark, tmp_path):
    path, df = str(tmp_path / "t"), spark.createDataFrame([("a", 1)], SCHEMA)
    assert [commits.append(spark, path, lambda _: df, "once") for _ in range(3)] == [1, 0, 0] and rows_of(spark, path) == [("a", 1)]


def test_two_writers_lose_nothing(spark, tmp_path):
    """The second one publishes while the first one is writing: the first one decides again and keeps only what is still missing."""
    path, asked = str(tmp_path / "t"), []

    def first(parts):
        asked.append(len(parts))
        if len(asked) == 1:
            commits.append_missing(spark.createDataFrame([("a", 2), ("b", 2)], SCHEMA), path, "k")
        mine = spark.createDataFrame([("a", 1), ("c", 1)], SCHEMA)
        return mine.join(commits.read(spark, path, SCHEMA, parts).select("k"), "k", "left_anti")

    assert commits.append(spark, path, first) == 1 and asked == [0, 1]
    assert rows_of(spark, path) == [("a", 2), ("b", 2), ("c", 1)] and len(os.listdir(f"{path}/data")) == 2
    number, parts = commits.manifest(spark, path)
    assert number == 2 and not commits.publish(spark, path, 2, []) and commits.manifest(spark, path) == (number, parts)


def test_parts_become_one(spark, tmp_path):
    path = str(tmp_path / "t")
    for i in range(3):
        commits.append(spark, path, lambda _, i=i: spark.createDataFrame([(f"k{i}", i)], SCHEMA), f"t{i}")
    _, parts = commits.manifest(spark, path)
    assert commits.replace(commits.read(spark, path, SCHEMA), path, parts[:3])
    assert len(commits.manifest(spark, path)[1]) == 1 and rows_of(spark, path) == [("k0", 0), ("k1", 1), ("k2", 2)]
    assert not commits.replace(commits.read(spark, path, SCHEMA), path, parts[:2])
    assert commits.append(spark, path, lambda _: spark.createDataFrame([("again", 1)], SCHEMA), "t1") == 0 and commits.sweep(spark, path) == 4


def message_files(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, upserts.SCHEMA).coalesce(1).write.mode("append").json(folder)


def test_upsert_state_costs_its_batch_and_survives_a_crash(spark, tmp_path, monkeypatch):
    versions = [(str(i % 40), f"/{i}" if i % 3 else "", f"u{i % 5}", f"t{i}" if i % 4 else "", "x" * (i * 7 % 23), i) for i in range(120)]
    batches = [versions[:100], versions[100:103], versions[103:110], versions[110:]]
    folder, target, state = (str(tmp_path / n) for n in ("in", "t", "c"))
    message_files(spark, folder, batches[:1])
    stream = lambda: upserts.message_stream(spark, folder, files=1)
    upserts.upsert_stream(stream(), target, state)
    message_files(spark, folder, batches[1:3])
    publish, calls = commits.publish, []

    def dies(*a):
        calls.append(a)
        if len(calls) == 2:
            raise OSError("killed before the commit")
        return publish(*a)

    monkeypatch.setattr(commits, "publish", dies)
    with pytest.raises(Exception, match="killed before the commit"):
        upserts.upsert_stream(stream(), target, state)
    monkeypatch.setattr(commits, "publish", publish)
    message_files(spark, folder, batches[3:])
    query = upserts.upsert_stream(stream(), target, state)
    changed = [p["stateOperators"][0]["numRowsUpdated"] for p in query.recentProgress if p["numInputRows"]]
    assert sorted(changed) == sorted(len({r[0] for r in b}) for b in batches[2:])  # not the 40 that are known
    batch = {r["id"]: r.asDict() for r in identity.upsert_messages(spark.createDataFrame(versions, upserts.SCHEMA)).collect()}
    got = {r["id"]: r.asDict() for r in upserts.current(spark, target).collect()}
    assert got == batch and len(commits.manifest(spark, target)[1]) == 4
    assert upserts.compact(spark, target) and commits.sweep(spark, target) > 0
    assert {r["id"]: r.asDict() for r in upserts.current(spark, target).collect()} == batch and len(commits.manifest(spark, target)[1]) == 1
    again = upserts.upsert_stream(stream(), target, state)
    assert not any(p["numInputRows"] for p in again.recentProgress)
