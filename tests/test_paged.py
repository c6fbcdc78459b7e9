"""The source of paged records: batches, pushed filters, streams."""

import json
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tideframe.operators import publish
from tideframe.sources import paged
from tideframe.streaming import stream

NOW = datetime(2024, 1, 1)


def fetch(path, page):
    """A service in place of files."""
    if page == 13:
        raise OSError("not to be fetched")
    return json.dumps({"items": [{"id": page * 10 + i, "from": path} for i in range(3)]})


def land(path, page, value):
    folder = Path(path) / f"page={page}"
    folder.mkdir(parents=True)
    (folder / "_writing").write_text("no")
    (folder / "a.json").write_text(value if isinstance(value, str) else json.dumps(value))


@pytest.fixture
def pages(spark, tmp_path):
    paged.register(spark)
    path = str(tmp_path / "pages")
    for k in range(40):
        land(path, k, {"data": {"items": [{"id": k * 100 + i, "t": "é"} for i in range(k % 4)]}})
    return path


def read(spark, path, **options):
    return paged.pages(spark, path, rows="$.data.items", **options)


def test_all_pages(spark, pages):
    df = read(spark, pages, pagesPerTask="7")
    got = [(r["page"], r["place"], json.loads(r["value"])) for r in df.collect()]
    assert sorted(got, key=str) == sorted(((k, i, {"id": k * 100 + i, "t": "é"}) for k in range(40) for i in range(k % 4)), key=str)
    assert df.rdd.getNumPartitions() == 6


def test_only_pages_asked_for_are_read(spark, pages):
    (Path(pages) / "page=50").mkdir()
    (Path(pages) / "page=50" / "a.json").write_text("broken {")
    with pytest.raises(Exception):
        read(spark, pages).collect()
    df = read(spark, pages, pagesPerTask="1", first=9, last=11)
    assert sorted(r["page"] for r in df.filter("place = 0").collect()) == [9, 10, 11] and df.rdd.getNumPartitions() == 3
    assert read(spark, pages, first=45, last=49).count() == 0 and read(spark, pages, last=49).count() == 60


def test_uses_of_one_frame_do_not_mix(spark, pages):
    df = read(spark, pages)
    some = df.filter("page < 10")
    assert some.count() == 13 and df.count() == 60 and df.filter("page >= 10").count() == 47 and some.unionByName(df).count() == 73 and df.count() == 60


def test_records(tmp_path):
    assert paged.records('[{"a": 1}, 2]', "$") == [{"a": 1}, 2] and paged.records('{"a": {"b": [1]}}', "$.a.b") == [1]
    assert paged.records('{"a": {}}', "$.a.b") == [] and paged.records("", "$") == [] and paged.records('{"x": 1}', "$") == [{"x": 1}] and paged.records('{"a": null}', "$.a.b") == []
    assert paged.page_numbers(str(tmp_path / "none")) == {}


def test_a_service(spark):
    paged.register(spark)
    service = {"rows": "items", "fetch": "tests.test_paged:fetch", "pages": "20"}
    assert paged.pages(spark, "service", last=12, **service).count() == 36
    with pytest.raises(Exception, match="not to be fetched"):
        paged.pages(spark, "service", **service).collect()


def test_stream_goes_on(spark, pages, tmp_path):
    root = str(tmp_path / "t")

    def run():
        source = spark.readStream.format(paged.NAME).option("rows", "$.data.items").load(pages).select("page", F.get_json_object("value", "$.id").cast("long").alias("id"))
        stream.run_available(source, f"{tmp_path}/check", stream.appender(spark, root, NOW))

    run()
    first = publish.read(spark, root).count()
    run()
    assert publish.read(spark, root).count() == first == 60
    land(pages, 41, {"data": {"items": [{"id": 1}, {"id": 2}]}})
    run()
    held = publish.read(spark, root)
    assert held.count() == 62 and held.filter("page = 41").count() == 2
