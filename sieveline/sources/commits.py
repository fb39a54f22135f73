"""Appends that are seen whole or not at all (SK1, SK6, SK7).

A committed table is a folder with ``data/<id>`` folders, each written by one Spark job, and numbered manifests that name those that
count, with a token for each append. A manifest is published by a rename that fails if its number is taken; the append is then decided
again on what is there by now. So a job that dies half-way leaves a folder that nothing names, an append that is repeated under
its token does nothing, and of two writers at a time none loses rows. Readers take the greatest manifest. ``sweep`` removes what no
manifest names; it isn't for use beside a running writer. On file systems whose rename isn't exclusive (plain local ones) writers must take turns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _store(spark: SparkSession, path: str) -> tuple[object, object]:
    """The file system of a path, and the path in it: whatever Spark itself can read."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _names(spark: SparkSession, path: str) -> list[str]:
    store, there = _store(spark, path)
    return sorted(f.getPath().getName() for f in store.listStatus(there)) if store.exists(there) else []


def manifest(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """Number and parts (token, folder) of the newest manifest; 0 and none before the first."""
    numbers = [int(n) for n in _names(spark, f"{path}/manifest") if n.isdigit()]
    if not numbers:
        return 0, []
    store, there = _store(spark, f"{path}/manifest/{max(numbers):012d}")
    stream = store.open(there)
    try:
        return max(numbers), json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, number: int, parts: list[dict]) -> bool:
    """Makes ``parts`` the table, if ``number`` isn't taken."""
    store, draft = _store(spark, f"{path}/manifest/.{uuid.uuid4().hex}")
    out = store.create(draft, False)
    out.write(bytearray(json.dumps(parts).encode()))
    out.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    final = store.makeQualified(jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/{number:012d}"))
    try:
        context.rename(store.makeQualified(draft), final, spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 0))
        return True
    except Exception as e:  # noqa: BLE001  the gateway's own type
        if "FileAlreadyExists" not in str(e):
            raise
        store.delete(draft, False)
        return False


def read(spark: SparkSession, path: str, schema: str | StructType, parts: list[dict] | None = None) -> DataFrame:
    """The committed rows."""
    parts = manifest(spark, path)[1] if parts is None else parts
    if not parts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([f"{path}/data/{p['folder']}" for p in parts])


def append(spark: SparkSession, path: str, rows: Callable[[list[dict]], DataFrame], token: str | None = None) -> int:
    """Appends what ``rows`` gives for the parts there are, and returns how many rows that were: 0 for a token that is in already.

    ``rows`` is asked again if another append came first; what was written for the older parts is removed then.
    """
    token = token or uuid.uuid4().hex
    while True:
        number, parts = manifest(spark, path)
        if any(token in p["tokens"] for p in parts):
            return 0
        folder, seen = uuid.uuid4().hex, Observation()
        rows(parts).observe(seen, F.count("*").alias("n")).write.json(f"{path}/data/{folder}")
        if publish(spark, path, number + 1, [*parts, {"tokens": [token], "folder": folder}]):
            return seen.get["n"]
        store, there = _store(spark, f"{path}/data/{folder}")
        store.delete(there, True)


def append_missing(df: DataFrame, path: str, key: str, token: str | None = None) -> int:
    """Appends the rows whose key is not in the table yet, each key's first occurrence in the table staying as it is, and returns their number."""
    spark = df.sparkSession

    def missing(parts: list[dict]) -> DataFrame:
        if not parts:
            return df
        return df.join(read(spark, path, df.schema, parts).select(key).distinct(), key, "left_anti").select(df.columns)

    return append(spark, path, missing, token)


def replace(df: DataFrame, path: str, old: list[dict]) -> bool:
    """One part with the rows of ``df`` in place of the parts ``old``; their tokens stay known. False if they aren't all there any more."""
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    df.write.json(f"{path}/data/{folder}")
    gone = {p["folder"] for p in old}
    while True:
        number, parts = manifest(spark, path)
        if not gone <= {p["folder"] for p in parts}:
            return False
        one = {"tokens": [t for p in old for t in p["tokens"]], "folder": folder}
        if publish(spark, path, number + 1, [one, *[p for p in parts if p["folder"] not in gone]]):
            return True


def sweep(spark: SparkSession, path: str) -> int:
    """Removes folders that the newest manifest doesn't name, and older manifests; returns how many folders went."""
    number, parts = manifest(spark, path)
    named = {p["folder"] for p in parts}
    store, _ = _store(spark, path)
    lost = [n for n in _names(spark, f"{path}/data") if n not in named]
    old = [f"manifest/{n}" for n in _names(spark, f"{path}/manifest") if n != f"{number:012d}"]
    for n in [*(f"data/{x}" for x in lost), *old]:
        store.delete(_store(spark, f"{path}/{n}")[1], True)
    return len(lost)
