"""Numbers of topics and documents, and pluggable profilers (ML6, ML10)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def topic_count(documents: Column, requested: Column | int) -> Column:
    """Number of topics: the requested one within bounds by the number of documents; 0 without documents."""
    least = F.when(documents >= 5_000, 12).otherwise(6)
    most = F.when(documents >= 20_000, 72).when(documents >= 10_000, 56).otherwise(24)
    wanted = F.lit(requested) if isinstance(requested, int) else requested
    return F.when(documents <= 0, 0).otherwise(F.greatest(least, F.least(wanted, most, F.greatest(documents - 1, F.lit(1))))).cast("int")


def least_documents(documents: Column, requested: int = 20) -> Column:
    """Least number of documents that a topic term must be in."""
    return F.least(F.lit(requested), F.greatest(F.lit(2), F.floor(documents / 50))).cast("int")


def profile_companies(prompts: DataFrame, call: Callable[[str], str], retries: int = 2) -> DataFrame:
    """symbol, profile (JSON text), error: an injected model call for each prompt; a failed one leaves an error row."""

    def one(prompt: str) -> tuple[str | None, bool]:
        for _ in range(retries + 1):
            try:
                answer = call(prompt)
                found = answer[answer.index("{") : answer.rindex("}") + 1]
                json.loads(found)
                return found, False
            except ValueError:
                continue
        return None, True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [one(p) for p in b["prompt"]]
            yield pd.DataFrame({"symbol": b["symbol"], "profile": [m[0] for m in made], "error": [m[1] for m in made]})

    return prompts.select("symbol", "prompt").mapInPandas(run, "symbol string, profile string, error boolean")
