"""Versioned tables of which a batch rewrites only the files that may hold its keys.

A version is a list of files with, for each, the range of its first key column and
a Bloom filter of its keys. A batch's keys are held against these; what may hold
one is read, changed and written anew, every other file is taken over as it is.
Versions are committed optimistically: where another writer gets ahead, the batch
is applied again to what that one has made.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideframe.operators import cdc, incremental
from tideframe.operators.keys import require_unique
from tideframe.operators.publish import ConflictError, Log, _entry, _refuse, commit, read_log
from tideframe.sources.files import claim, delete

#: Keys of a batch that tasks hold against filters (a larger one is joined with the key columns), rows of a file, bits a key and at most a file, and hashes of a key.
MOST_KEYS, FILE_ROWS, BITS_A_KEY, MOST_BITS, HASHES = 1_000_000, 2_000_000, 10, 1 << 24, 4


@dataclass(frozen=True)
class Rewrite:
    """What a change has done: the version, files of the one before, those read and replaced, those written."""

    version: int
    files: int
    replaced: int
    written: int


def _key_hash(keys: list[str]) -> Column:
    return F.xxhash64(*(F.col(f"`{k}`") for k in keys))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row for each of HASHES."""
    step = (hashes >> 32) | 1
    return np.stack([(hashes + i * step) & (bits - 1) for i in range(HASHES)])


def _filters(files: DataFrame, bits: int) -> DataFrame:
    """name, bits: a Bloom filter of each file's hashes; ``files``: name, h."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"name": list(held), "bits": [np.packbits(b, bitorder="little").tobytes() for b in held.values()]}, pa.schema([("name", pa.string()), ("bits", pa.binary())]))

        for batch in batches:
            coded, h = batch.column("name").dictionary_encode(), batch.column("h").to_numpy(zero_copy_only=False)
            codes = coded.indices.to_numpy()
            for i, name in enumerate(coded.dictionary.to_pylist()):
                if name not in held:
                    if held:  # a task reads its files one after the other
                        yield out()
                        held.clear()
                    held[name] = np.zeros(bits, bool)
                held[name][_places(h[codes == i], bits)] = True
        if held:
            yield out()

    def unite(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(b, np.uint8) for b in table.column("bits").to_pylist()]
        whole = np.bitwise_or.reduce(parts)
        return pa.table({"name": [table.column("name")[0].as_py()], "bits": [whole.tobytes()]}, pa.schema([("name", pa.string()), ("bits", pa.binary())]))

    # a file that several tasks read has a part from each, which are few
    return files.mapInArrow(build, "name string, bits binary").groupBy("name").applyInArrow(unite, "name string, bits binary")


def index(spark: SparkSession, root: str, folder: int, keys: list[str]) -> DataFrame:
    """folder, name, rows, lo, hi, nulls, bits of each file of a folder: how many rows, the range of the first key column and its nulls, the filter of the keys."""
    held = spark.read.parquet(f"{root}/version={folder}").select(F.col("_metadata.file_name").alias("name"), *(F.col(f"`{k}`") for k in keys))
    first = F.col(f"`{keys[0]}`")
    stats = held.groupBy("name").agg(F.count("*").alias("rows"), F.min(first).alias("lo"), F.max(first).alias("hi"), F.count_if(first.isNull()).alias("nulls"))
    most = stats.agg(F.max("rows")).first()[0] or 1
    bits = min(MOST_BITS, max(1024, 1 << math.ceil(math.log2(BITS_A_KEY * most))))
    return stats.join(_filters(held.select("name", _key_hash(keys).alias("h")), bits), "name").select(F.lit(folder).cast("long").alias("folder"), "name", "rows", "lo", "hi", "nulls", "bits")


def may_hold(spark: SparkSession, root: str, files: DataFrame, batch: DataFrame, keys: list[str], schema: StructType) -> list[tuple[int, str]]:
    """(folder, name) of the files of an index that may hold a key of the batch; none that does is left out.

    Keys are taken as the table's types; one that is none of these counts as null. Up to MOST_KEYS keys go to every task, which holds them against the filters;
    the files that these leave, or all where there are more keys, are told by a join with their key columns. The list is the driver's, which plans the
    read of these files by it.
    """
    typed = batch.select(*(F.col(f"`{k}`").try_cast(schema[k].dataType).alias(k) for k in keys))
    wanted = typed.select(F.col(f"`{keys[0]}`").alias("k"), _key_hash(keys).alias("h")).distinct()
    if wanted.limit(MOST_KEYS + 1).count() > MOST_KEYS:
        return _holding(spark, root, [tuple(r) for r in files.select("folder", "name").collect()], wanted.select("h"), keys)
    table = wanted.orderBy(F.col("k").asc_nulls_first()).toArrow()
    values, hashes = table.column("k").to_pylist(), table.column("h").to_numpy()
    nulls = sum(v is None for v in values)
    shared = spark.sparkContext.broadcast((values[nulls:], hashes))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, hashes = shared.value
        for part in batches:
            keep = []
            for i, (lo, hi, none, raw) in enumerate(zip(*(part.column(c).to_pylist() for c in ("lo", "hi", "nulls", "bits")), strict=True)):
                from_, to = (bisect_left(values, lo) + nulls, bisect_right(values, hi) + nulls) if lo is not None else (0, 0)
                some = np.concatenate([hashes[:nulls] if none else hashes[:0], hashes[from_:to]])
                bits = np.frombuffer(raw, np.uint8)
                at = _places(some, 8 * len(bits))
                if ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0).any():
                    keep.append(i)
            yield part.select(["folder", "name"]).take(pa.array(keep, pa.int64()))

    found = files.select("folder", "name", "lo", "hi", "nulls", "bits").mapInArrow(test, "folder long, name string").collect()
    # a large file is asked for so many keys that some filter says yes to one it does not hold
    return _holding(spark, root, [tuple(r) for r in found], wanted.select("h"), keys)


def _holding(spark: SparkSession, root: str, files: list[tuple[int, str]], hashes: DataFrame, keys: list[str]) -> list[tuple[int, str]]:
    """Those of the files whose key columns, which are read, have one of the hashes (h)."""
    if not files:
        return []
    folder = F.regexp_extract("_metadata.file_path", r"/version=(\d+)/[^/]+$", 1).cast("long")
    held = spark.read.option("mergeSchema", True).parquet(*_paths(root, files)).select(folder.alias("folder"), F.col("_metadata.file_name").alias("name"), _key_hash(keys).alias("h"))
    return sorted(map(tuple, held.join(hashes.distinct(), "h", "left_semi").select("folder", "name").distinct().collect()))


def _index_of(spark: SparkSession, root: str, entry: dict) -> DataFrame:
    return spark.read.parquet(f"{root}/_index/{entry['index']}")


def _paths(root: str, files: list[tuple[int, str]]) -> list[str]:
    return [f"{root}/version={folder}/{name}" for folder, name in files]


def _rows(spark: SparkSession, root: str, files: list[tuple[int, str]], schema: StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(*_paths(root, files)) if files else spark.createDataFrame([], schema)


def files(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The index of the newest version, or of a given one."""
    log = read_log(spark, root)
    return _index_of(spark, root, log.newest if version is None else log.live[version])


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """The rows of the newest version, or of a given one; None where there is none."""
    log = read_log(spark, root)
    entry = log.newest if version is None else log.live.get(version)
    if entry is None:
        return None
    there = [tuple(r) for r in _index_of(spark, root, entry).select("folder", "name").collect()]
    return _rows(spark, root, there, StructType.fromJson(entry["schema"]))


def rows_of(spark: SparkSession, root: str, batch: DataFrame, keys: list[str], version: int | None = None) -> DataFrame | None:
    """The rows of files that may hold a key of the batch: all of the table's that have one, and others."""
    log = read_log(spark, root)
    entry = log.newest if version is None else log.live.get(version)
    if entry is None:
        return None
    return _rows(spark, root, may_hold(spark, root, _index_of(spark, root, entry), batch, keys, StructType.fromJson(entry["schema"])), StructType.fromJson(entry["schema"]))


def rewrite(spark: SparkSession, root: str, batch: DataFrame, keys: list[str], build: Callable[[DataFrame | None], DataFrame], now: datetime, tag: str | None = None, file_rows: int = FILE_ROWS, note: str | None = None) -> Rewrite:
    """Replace the files that may hold a key of the batch by ``build`` of their rows (None for the first version).

    ``build`` must leave rows without a key of the batch as they are; the batch
    is read several times and should be a table. With a ``tag`` known to the log
    nothing is done. New rows go into files of about ``file_rows``, by ranges of
    the keys.
    """
    while True:
        log = read_log(spark, root)
        if tag is not None and tag in log.tags:
            return Rewrite(log.tags[tag], 0, 0, 0)
        entry = log.newest
        if entry is None:
            old, kept, touched, held, schema = None, None, [], [], StructType()
        else:
            kept = _index_of(spark, root, entry)
            schema = StructType.fromJson(entry["schema"])
            touched = may_hold(spark, root, kept, batch, keys, schema)
            old = _rows(spark, root, touched, schema)
            held = [r["rows"] for r in kept.select("folder", "name", "rows").collect() if (r["folder"], r["name"]) in set(touched)]
        new = build(old)
        if old is not None and any(new.schema[k].dataType != schema[k].dataType for k in keys):
            raise ValueError("the types of keys must stay; cast the batch's")
        folder = log.newest_number + 1
        while not claim(spark, f"{root}/_claims/{folder}"):
            folder += 1
        parts = max(1, len(touched), math.ceil((sum(held) + batch.count()) / file_rows))
        # one file a range, sorted, so that a later batch of near keys meets few of them
        new.repartitionByRange(parts, *(F.col(f"`{k}`") for k in keys)).sortWithinPartitions(*(F.col(f"`{k}`") for k in keys)).write.mode("overwrite").parquet(f"{root}/version={folder}")
        fresh = index(spark, root, folder, keys).filter("rows > 0")
        if kept is not None:
            gone = spark.createDataFrame(touched, "folder long, name string")
            fresh = kept.join(F.broadcast(gone), ["folder", "name"], "left_anti").unionByName(fresh)
        fresh.write.mode("overwrite").parquet(f"{root}/_index/{folder}")
        written = spark.read.parquet(f"{root}/_index/{folder}")
        totals = written.agg(F.sum("rows").alias("rows"), F.count_if(F.col("folder") == folder).alias("files"), F.collect_set("folder").alias("folders")).first()
        known = {f.name.lower() for f in new.schema.fields}
        schema = StructType([*new.schema.fields, *(f for f in (schema.fields if entry else []) if f.name.lower() not in known)])
        made: dict = {}

        def claim_next(log: Log, folder=folder, totals=totals, schema=schema, entry=entry, made=made) -> dict | None:
            _refuse(log, entry["version"] if entry else 0)
            made.update(_entry(max(log.newest_number + 1, folder), totals["rows"] or 0, schema.names, None, None, 0, None, tag, now, sorted(totals["folders"]), note, log.version))
            made.update(index=folder, schema=schema.jsonValue())
            return made

        try:
            commit(spark, root, claim_next)
            return Rewrite(made["version"], 0 if kept is None else kept.count(), len(touched), totals["files"])
        except ConflictError:
            delete(spark, f"{root}/version={folder}")
            delete(spark, f"{root}/_index/{folder}")


def create(df: DataFrame, root: str, keys: list[str], now: datetime, file_rows: int = FILE_ROWS, tag: str | None = None) -> Rewrite:
    """The first version of a table."""
    return rewrite(df.sparkSession, root, df, keys, lambda old: _first(old, df), now, tag, file_rows)


def _first(old: DataFrame | None, df: DataFrame) -> DataFrame:
    if old is not None:
        raise ConflictError("the table is there already")
    return df


def merge(spark: SparkSession, root: str, batch: DataFrame, keys: list[str], now: datetime, tag: str | None = None, policy: str = "append_new_columns") -> Rewrite:
    """``incremental.merge`` over the files that may hold a key of the batch."""
    require_unique(batch, keys)
    return rewrite(spark, root, batch, keys, lambda old: incremental.merge(old, batch, keys, policy), now, tag)


def delete_insert(spark: SparkSession, root: str, batch: DataFrame, keys: list[str], now: datetime, tag: str | None = None, policy: str = "append_new_columns") -> Rewrite:
    """``incremental.delete_insert`` over the files that may hold a key of the batch."""
    return rewrite(spark, root, batch, keys, lambda old: incremental.delete_insert(old, batch, keys, policy), now, tag)


def apply_changes(spark: SparkSession, root: str, changes: DataFrame, keys: list[str], seq: str, op: str, now: datetime, tag: str | None = None) -> Rewrite:
    """``cdc.apply_changes`` over the files that may hold a changed key; the table has the keys, values, ``_seq`` and ``_deleted``."""
    return rewrite(spark, root, changes, keys, lambda old: cdc.apply_changes(old, changes, keys, seq, op), now, tag)
