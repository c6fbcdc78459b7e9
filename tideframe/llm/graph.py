"""Connected components, and intermediate tables, shared by the corpus operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideframe.sources.files import delete, work_folder

#: Bits of a membership filter; 8 MB whatever the number of ids.
FILTER_BITS = 1 << 26


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the folder of ``spark.checkpoint.dir``; see ``forget``."""
    path = work_folder(df.sparkSession, "keep")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``keep`` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df._kept_path)


def id_filter(ids: DataFrame, column: str, hashed: bool = False) -> np.ndarray:
    """Bytes of a bitmap with the bit ``filter_slot`` of every id; some others pass by chance, none is missed."""
    slot = filter_slot(column, hashed)
    words = ids.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("word"))
    found = words.agg(F.expr("bit_or(shiftleft(1L, slot % 64))").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint8)


def filter_slot(column: str, hashed: bool = False) -> Column:
    """The bit of an id, or of a number that is a hash already."""
    return F.pmod(F.col(column) if hashed else F.xxhash64(column), F.lit(FILTER_BITS)).cast("int")


def filter_slots(hashes: np.ndarray) -> np.ndarray:
    """The bits of hashes."""
    return np.mod(hashes, FILTER_BITS)


def passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots have their bit set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``edges`` (u, v).

    Alternating large-star and small-star rounds: each is two aggregations with
    map-side combine, whose results are kept, and joins of the links with them.
    Nothing but the join reads what a key is dealt to, so AQE can split it and one
    node with very many links lands in no single task. Nodes without links are not
    returned; links with a null end are ignored. The result is a kept table.
    """
    links = keep(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    state = None
    for _ in range(max_rounds):
        now = links.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if now[0] == 0 or tuple(now) == state:
            break
        state = tuple(now)
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = keep(both.join(near, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, links = links, keep(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        forget(before, near, large, least)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = keep(
        links.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
            links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        )
    )
    forget(links)
    return out
