"""Paged and keyed sources: fallbacks, retries, resumption, replays."""

import pytest

from sieveline.sources import paged


@pytest.fixture
def reader(spark, tmp_path):
    spark.dataSource.register(paged.PagedListing)

    def made(kind, **options):
        r = getattr(spark, kind).format("paged_listing").option("provider", "tests.paged_providers:Numbered").option("marks", str(tmp_path)).option("pause", "0.01")
        for k, v in ({"categories": '["x", "y"]', "pages": "7"} | options).items():
            r = r.option(k, v)
        return r.load()

    return made


def want(pages, first=1, categories="xy"):
    return sorted((c, p, i, f"{c}{p}{'ab'[i]}") for c in categories for p in range(first, pages + 1) for i in (0, 1))


def test_all_pages_in_stripes_with_retries(reader):
    for stripes in ("1", "3", "20"):
        assert sorted(map(tuple, reader("read", stripes=stripes).collect())) == want(7)
    assert sorted(map(tuple, reader("read", flaky="y/3").collect())) == want(7)
    with pytest.raises(Exception, match="out of order"):
        reader("read", broken="x/2", tries="2").collect()
    assert reader("read", pages="0").count() == 0


def test_fetching_goes_on_after_the_last_page(spark, reader):
    have = reader("read", pages="4")
    start = paged.resume_starts(have)
    assert start in ('{"x": 5, "y": 5}', '{"y": 5, "x": 5}')
    assert sorted(map(tuple, reader("read", start=start).collect())) == want(7, 5)


def test_stream_rounds_survive_a_stop(spark, reader, tmp_path):
    def run(rounds, fail=False):
        def store(batch, n):
            batch.write.mode("overwrite").json(f"{tmp_path}/out/batch={n}")
            if fail:
                raise OSError("stopped after writing")

        stream = reader("readStream", pages="7", rounds=str(rounds))
        query = stream.writeStream.foreachBatch(store).option("checkpointLocation", f"{tmp_path}/state").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    run(1)
    with pytest.raises(Exception, match="stopped after writing"):
        run(2, fail=True)
    run(3)
    rows = spark.read.schema(paged.SCHEMA).json(f"{tmp_path}/out/*")
    assert sorted((r["category"], r["page"], r["place"], r["item"]) for r in rows.collect()) == want(7)


def test_saved_pages_share_files(spark, tmp_path):
    """Files grow with pages by the volume, and every page comes back, also those without a category or at a volume's edge."""
    spark.dataSource.register(paged.PagedListing)
    n = 2 * paged.VOLUME + 1
    rows = [(c, p, i, f"{c}{p}{i}") for c, last in (("x", n), ("y", 3), (None, paged.VOLUME)) for p in range(1, last + 1) for i in (0, 1)]
    root = str(tmp_path / "saved")
    paged.save_pages(spark.createDataFrame(rows, paged.SCHEMA), root)
    assert len(list((tmp_path / "saved").rglob("*.parquet"))) == 3 + 1 + 2
    read = spark.read.format("paged_listing").option("provider", "sieveline.sources.paged:SavedPages").option("root", "file://" + root)
    got = read.option("categories", '["x", null, "y", "z"]').load().collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows, key=repr)


def test_series_by_fallback(spark):
    known = {"AAA": [1, 2], "BBB.DE": [3.5], "BBB.TO": [9], "CC-X": [4]}

    def get(name):
        if name == "DOWN":
            raise OSError("not now")
        return known.get(name)

    search = lambda s: {"CCC": ["CCC", "nothing", "CC-X"], "EEE": ["a", "b", "c", "AAA"]}.get(s, [])
    symbols = spark.createDataFrame([(s,) for s in ("AAA", "BBB", "CCC", "DOWN", "EEE", "ZZZ", None)], "symbol string")
    got = {r["symbol"]: (r["found_as"], r["points"], r["failed"]) for r in paged.fetch_series(symbols, get, search, tries=2, pause=0.01).collect()}
    assert got == {"AAA": ("AAA", [1.0, 2.0], False), "BBB": ("BBB.DE", [3.5], False), "CCC": ("CC-X", [4.0], False), "DOWN": (None, None, True), "EEE": (None, None, False), "ZZZ": (None, None, False)}
    assert {r["symbol"]: r["found_as"] for r in paged.fetch_series(symbols, get, None, 1).collect()}["CCC"] is None


def test_package_is_shipped(spark):
    import zipfile

    import sieveline

    names = zipfile.ZipFile(sieveline.ship(spark)).namelist()
    assert "sieveline/__init__.py" in names and "sieveline/sources/paged.py" in names
