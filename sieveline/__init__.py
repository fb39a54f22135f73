"""Value-signal analytics and corpus preparation on PySpark."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> str:
    """Gives the running session's workers this package, for sessions that weren't started with it (``--py-files`` or an installed wheel).

    Functions that run in Python workers name their modules, so workers must be able to import them. Returns the archive's path.
    """
    here = os.path.dirname(os.path.abspath(__file__))
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="sieveline-"), "sieveline"), "zip", os.path.dirname(here), "sieveline")
    spark.sparkContext.addPyFile(made)
    return made
