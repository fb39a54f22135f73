"""Session helpers of the llm operators."""

from __future__ import annotations

import contextlib
import gc
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

ARROW_ROWS = 512
ARROW_BYTES = 4 << 20


def small(batches: Iterable[pa.RecordBatch], rows: int = ARROW_ROWS, size: int = ARROW_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of Arrow batches in parts of at most so many rows and bytes of text, or of one row, which may be a very long text."""
    for b in batches:
        texts = [pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in b.columns if pa.types.is_string(c.type) or pa.types.is_binary(c.type)]
        upto = np.cumsum(sum(texts, np.zeros(b.num_rows, np.int64)), dtype=np.int64)
        at = 0
        while at < b.num_rows or not b.num_rows:
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, "right")) if b.num_rows else 0
            end = max(at + 1, min(end, at + rows, b.num_rows))
            yield b.slice(at, end - at)
            if end >= b.num_rows:
                break
            at = end


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared checkpoint folder and continue from there.

    The folder is the one the session was given, or else that named in spark.checkpoint.dir. Where neither is set a session in one
    process (tests, the bench) gets a folder of its own; on a cluster that would be one machine's disk, so there it is an error.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def no_collector() -> Iterator[None]:
    """Python's cycle collector rests: it would walk large memos again and again, and the code within makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()
