"""Paged and keyed sources (SC12, SC14, ST4): listings fetched page by page, and series fetched by symbol with fallbacks.

``PagedListing`` is a Spark data source: batch and stream readers share out pages to tasks, a failing fetch is tried again, and offsets
are rounds of pages, so a batch that is run again asks for the same pages. What a page is comes from a provider: an object named
``module:attribute`` in the option ``provider``, called with the options, that has ``fetch(category, page)`` giving a page's items as
text, None after the last page, or OSError where another try may help. ``SavedPages`` reads pages that were saved before.

    spark.dataSource.register(PagedListing)
    spark.read.format("paged_listing").option("provider", "...").option("categories", '["a", "b"]').load()
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "category string, page int, place int, item string"
#: Exchange suffixes that are tried after the bare symbol, in order.
SUFFIXES = (".WA", ".L", ".DE", ".PA", ".AS", ".MC", ".MI", ".SW", ".HK", ".AX", ".TO")
#: So many names that a search finds are tried.
FOUND = 3
#: Saved pages that share a file.
VOLUME = 1000
#: What Spark calls the folder of rows without a category.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def patient(call: Callable[[], object], tries: int, pause: float) -> object:
    """What ``call`` gives, after up to ``tries`` tries; an OSError of the last one is raised. Pauses double."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k == tries - 1:
                raise
            time.sleep(pause * 2**k)
    raise ValueError("at least one try is needed")


class Pages(InputPartition):
    """Pages first, first + step, ... of a category, at most ``count`` of them (no limit for None)."""

    def __init__(self, category: str, first: int, step: int, count: int | None) -> None:
        super().__init__((category, first, step, count))
        self.category, self.first, self.step, self.count = category, first, step, count


class _Fetch:
    def __init__(self, options: dict) -> None:
        self.options = dict(options)
        self.categories: list[str] = json.loads(options["categories"])
        self.start: dict[str, int] = json.loads(options.get("start", "{}"))
        self.tries, self.pause = int(options.get("tries", "3")), float(options.get("pause", "0.5"))

    def first(self, category: str) -> int:
        return int(self.start.get(category, 1))

    def read(self, part: Pages) -> Iterator[tuple]:
        module, _, name = self.options["provider"].partition(":")
        provider = getattr(importlib.import_module(module), name)(self.options)
        page, left = part.first, part.count
        while left is None or left > 0:
            items = patient(lambda page=page: provider.fetch(part.category, page), self.tries, self.pause)
            if items is None:
                return
            yield from ((part.category, page, i, item) for i, item in enumerate(items))
            page, left = page + part.step, None if left is None else left - 1


class _Batch(DataSourceReader):
    """All pages from the start on. A category's pages are dealt to ``stripes`` tasks in turn; each ends at the first page that isn't there."""

    def __init__(self, options: dict) -> None:
        self.fetch, self.stripes = _Fetch(options), int(options.get("stripes", "4"))

    def partitions(self) -> list[InputPartition]:
        return [Pages(c, self.fetch.first(c) + k, self.stripes, None) for c in self.fetch.categories for k in range(self.stripes)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.fetch.read(partition)


class _Stream(DataSourceStreamReader):
    """Rounds of ``pages`` pages for every category, up to ``rounds`` of them; a category that has ended adds nothing."""

    def __init__(self, options: dict) -> None:
        self.fetch, self.pages, self.rounds = _Fetch(options), int(options.get("pages", "10")), int(options.get("rounds", "1"))
        self.told = 0

    def initialOffset(self) -> dict:
        return {"round": 0}

    def latestOffset(self) -> dict:
        self.told = min(self.told + 1, self.rounds)
        return {"round": self.told}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.told = max(self.told, end["round"])
        return [Pages(c, self.fetch.first(c) + r * self.pages, 1, self.pages) for r in range(start["round"], end["round"]) for c in self.fetch.categories]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return self.fetch.read(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return _Stream(self.options)


class SavedPages:
    """Pages saved as Parquet (category, page, place, item) in the folder ``root`` by ``save_pages``. One volume is held at a time."""

    def __init__(self, options: dict) -> None:
        self.root = options["root"].removeprefix("file://")
        self.held, self.pages = None, {}

    def fetch(self, category: str | None, page: int) -> list[str] | None:
        volume = (category, page // VOLUME)
        if volume != self.held:
            self.held, self.pages = volume, self._volume(*volume)
        return self.pages.get(page)

    def _volume(self, category: str | None, volume: int) -> dict[int, list[str]]:
        import pyarrow.parquet as pq

        name = NULL_FOLDER if category is None else category
        try:
            rows = pq.read_table(f"{self.root}/category={name}/volume={volume}", columns=["page", "place", "item"], partitioning=None)
        except FileNotFoundError:
            return {}
        pages: dict[int, list[str]] = {}
        rows = rows.sort_by([("page", "ascending"), ("place", "ascending")])
        for page, item in zip(rows.column("page").to_pylist(), rows.column("item").to_pylist(), strict=True):
            pages.setdefault(page, []).append(item)
        return pages


def save_pages(pages: DataFrame, root: str) -> None:
    """category, page, place, item as Parquet, ``VOLUME`` pages of a category to a file: a file for each page would have the driver list them all."""
    volumes = pages.withColumn("volume", F.floor(F.col("page") / VOLUME))
    volumes.repartition("category", "volume").write.partitionBy("category", "volume").parquet(root)


def resume_starts(fetched: DataFrame) -> str:
    """The option ``start``: after the greatest page of each category that is there. One number for each category."""
    return json.dumps({r["category"]: r["page"] + 1 for r in fetched.groupBy("category").agg(F.max("page").alias("page")).collect()})


def fetch_series(symbols: DataFrame, get: Callable[[str], list | None], search: Callable[[str], list[str]] | None = None, tries: int = 3, pause: float = 0.5) -> DataFrame:
    """symbol, found_as, points, failed: each symbol's series (``get`` gives numbers, or none) under the first name that has one.

    Names are tried in order: the symbol, the symbol with each suffix, then the first names that ``search`` finds. Where none has a series,
    ``found_as`` is null, and ``failed`` says whether the provider gave up on the way, after ``tries`` tries; a symbol never ends the
    job. Requests run in the tasks.
    """

    def one(symbol: str) -> tuple[str, str | None, list[float] | None, bool]:
        failed = False

        def found() -> Iterator[str]:
            yield symbol
            yield from (symbol + x for x in SUFFIXES)
            if search:
                yield from (n for n in patient(lambda: search(symbol), tries, pause)[:FOUND] if n and n != symbol)

        try:
            for name in found():
                if points := patient(lambda name=name: get(name), tries, pause):
                    return symbol, name, [float(p) for p in points], False
        except OSError:
            failed = True
        return symbol, None, None, failed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([one(s) for s in b["symbol"]], columns=["symbol", "found_as", "points", "failed"])

    return symbols.where(F.col("symbol").isNotNull()).select("symbol").mapInPandas(run, "symbol string, found_as string, points array<double>, failed boolean")
