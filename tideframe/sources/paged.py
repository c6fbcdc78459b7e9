"""A Spark source of paged records: ``pages``, and ``spark.readStream.format("tideframe_pages")``.

Pages are JSON documents with an array of records, as clients of paged services
land them: ``<path>/page=<number>/...``, in any store that pyarrow's file systems
reach, or whatever the function named by the option ``fetch`` (``module:name``,
taking the path and a number) returns. Tasks read pages, in groups; the options
``first`` and ``last`` bound them, so pages that a query does not ask for are not
fetched; a stream's offset is the last page it has read.

Filters are not pushed down: Spark 4.1 keeps one reader for all uses of a frame, so
a filter pushed by one use would leave out rows of another, as in the union of a
frame with a part of itself. Bounds as options make a frame of their own.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from importlib import import_module

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "tideframe_pages"
SCHEMA = "page long, place int, value string"
_ARROW = pa.schema([("page", pa.int64()), ("place", pa.int32()), ("value", pa.string())])
#: Pages of a task.
GROUP = 16


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PageSource)


def pages(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, **options: str) -> DataFrame:
    """page, place, value of the records of all pages, or of those from ``first`` to ``last``."""
    register(spark)
    bounds = {k: v for k, v in (("first", first), ("last", last)) if v is not None}
    return spark.read.format(NAME).options(**bounds, **options).load(path)


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else re.sub(r"^file:", "", path))


def page_numbers(path: str) -> dict[int, list[str]]:
    """The pages there are, and their files; a page that is still being written, with no file but hidden ones, is not there."""
    store, root = _open(path)
    found: dict[int, list[str]] = {}
    for info in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        named = re.search(r"/page=(\d+)/([^/]+)$", info.path)
        if named and info.type == fs.FileType.File and info.size and named[2][0] not in "._":
            found.setdefault(int(named[1]), []).append(info.path)
    return found


def records(text: str, rows: str) -> list:
    """The array of records at a dotted path (``$`` is the root); one object is one record, nothing none."""
    at = json.loads(text) if text.strip() else []
    for name in rows.removeprefix("$").strip(".").split("."):
        at = (at or {}).get(name) if name else at
    return at if isinstance(at, list) else [] if at is None else [at]


class Pages(InputPartition):
    def __init__(self, pages: list[tuple[int, list[str]]]):
        self.pages = pages


class _Reader:
    def __init__(self, options: dict[str, str]):
        self.path, self.rows, self.fetch = options["path"], options.get("rows", "$"), options.get("fetch")
        self.group, self.number = int(options.get("pagesPerTask", GROUP)), options.get("pages")
        self.first, self.last = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def known(self) -> dict[int, list[str]]:
        """All pages within the bounds; those of a function are numbered from 1 to the option ``pages``."""
        found = {k: [] for k in range(1, int(self.number) + 1)} if self.fetch else page_numbers(self.path)
        return {k: v for k, v in found.items() if self.first <= k <= self.last}

    def groups(self, pages: dict[int, list[str]]) -> list[InputPartition]:
        found = sorted(pages.items())
        return [Pages(found[k : k + self.group]) for k in range(0, len(found), self.group)]

    def texts(self, page: int, files: list[str]) -> Iterator[str]:
        if self.fetch:
            module, name = self.fetch.split(":")
            yield getattr(import_module(module), name)(self.path, page)
            return
        store, _ = _open(self.path)
        for file in sorted(files):
            with store.open_input_stream(file) as f:
                yield f.read().decode()

    def read(self, partition: Pages | None) -> Iterator[pa.RecordBatch]:
        # where there are no pages, Spark asks for one partition that is none
        for page, files in partition.pages if partition else []:
            found = [r for text in self.texts(page, files) for r in records(text, self.rows)]
            values = [json.dumps(r, ensure_ascii=False, separators=(",", ":")) for r in found]
            yield pa.RecordBatch.from_arrays([pa.array([page] * len(values), pa.int64()), pa.array(range(len(values)), pa.int32()), pa.array(values, pa.string())], schema=_ARROW)


class PageReader(_Reader, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        return self.groups(self.known())


class PageStreamReader(_Reader, DataSourceStreamReader):
    """Offsets are page numbers; pages come in rising order."""

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max(self.known(), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.groups({k: v for k, v in self.known().items() if start["page"] < k <= end["page"]})

    def commit(self, end: dict) -> None:
        pass


class PageSource(DataSource):
    """Options: path, rows (dotted path to the records), first and last, pagesPerTask, fetch and pages (see the module)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PageStreamReader(self.options)
