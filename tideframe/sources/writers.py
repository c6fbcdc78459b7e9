"""Exports and compaction."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.operators.govern import Mask, apply_masks
from tideframe.sources.files import delete, exists, names, put_if_absent, read_text, rename, size
from tideframe.sources.readers import listed


def export_csv(df: DataFrame, path: str, masks: list[Mask] | None = None, role: str = "viewer") -> None:
    """The whole result, masked for a role, as CSV with a header."""
    apply_masks(df, masks or [], role).write.mode("overwrite").option("header", True).csv(path)


def export_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def compact(spark: SparkSession, source: str, target: str, file_bytes: int = 256 << 20) -> int:
    """Write a folder's rows anew in files of about ``file_bytes``; the number of files."""
    files = max(1, round(size(spark, source) / file_bytes))
    df = spark.read.parquet(source)
    # a round-robin shuffle: even files whatever the old ones were
    df.repartition(files).write.mode("overwrite").parquet(target)
    return files


def file_count(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().count()


def pack_small(files: list[tuple[str, int]], target: int) -> list[list[str]]:
    """Which files (path, bytes) to put together: first fit, largest first, of those below half the target; each folder by itself."""
    bins: dict[str, list[tuple[int, list[str]]]] = {}
    for path, held in sorted((f for f in files if 2 * f[1] < target), key=lambda f: (-f[1], f[0])):
        own = bins.setdefault(path.rpartition("/")[0], [])
        at = next((i for i, (full, _) in enumerate(own) if full + held <= target), None)
        if at is None:
            own.append((held, [path]))
        else:
            own[at] = (own[at][0] + held, [*own[at][1], path])
    return [paths for own in bins.values() for _, paths in own if len(paths) > 1]


def compact_small(spark: SparkSession, path: str, target: int = 256 << 20) -> tuple[int, int]:
    """Put the small files of a Parquet folder together; (files taken up, files made).

    Sizes are listed, files of half the target or more are neither read nor
    moved, and each new file stays in the folder, and so the partition, of those
    it is made of. The rows of the small files alone are shuffled, those of a new
    file to one task. What is to be moved and deleted is written down first, so a
    run that dies half way is finished by the next. Readers of that moment may see
    rows twice: where they must not, use a versioned table.
    """
    _finish(spark, path)
    bins = pack_small([(r["path"], r["bytes"]) for r in listed(spark, path).collect() if r["path"].endswith(".parquet")], target)
    if not bins:
        return 0, 0
    work = f"_compact-{uuid.uuid4().hex}"
    named = spark.createDataFrame([(p, i) for i, paths in enumerate(bins) for p in paths], "__path string, __bin int")
    rows = spark.read.option("mergeSchema", True).parquet(*(p for paths in bins for p in paths))
    # a row for each small file, from the listing above
    dealt = rows.withColumn("__path", F.col("_metadata.file_path")).join(F.broadcast(named), "__path").drop("__path")
    dealt.repartition(len(bins), "__bin").write.partitionBy("__bin").parquet(f"{path}/{work}")
    moves = []
    for i, paths in enumerate(bins):
        folder = f"{path}/{work}/__bin={i}"
        # a task that has several bins gives their files one name
        moves += [(f"{folder}/{n}", f"{paths[0].rpartition('/')[0]}/bin-{i}-{n}") for n in names(spark, folder) if n.endswith(".parquet")]
    put_if_absent(spark, f"{path}/_compact.json", json.dumps({"moves": moves, "gone": [p for paths in bins for p in paths], "work": work}))
    _finish(spark, path)
    return sum(map(len, bins)), len(moves)


def _finish(spark: SparkSession, path: str) -> None:
    """Do what is written down, or the rest of it."""
    journal = f"{path}/_compact.json"
    if not exists(spark, journal):
        return
    todo = json.loads(read_text(spark, journal))
    for old, new in todo["moves"]:
        if exists(spark, old):
            rename(spark, old, new)
    for gone in todo["gone"]:
        delete(spark, gone)
    delete(spark, f"{path}/{todo['work']}")
    delete(spark, journal)
