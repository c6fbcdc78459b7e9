"""Key matching, row hashes, duplicate guards and table checksums."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


#: Rows that ``spread`` gives to a task, about.
ROWS_A_TASK = 500_000


class DuplicateKeyError(ValueError):
    """Rows of a batch share a key that has to be unique."""


def row_hash(columns: list[str]) -> Column:
    """MD5 over the columns as text; nulls and separators inside values cannot be mistaken for others.

    Values are cast to text by Spark, so hashes are compared within Spark only.
    """
    parts = [F.coalesce(F.concat(F.lit("V:"), F.replace(F.replace(F.col(f"`{c}`").cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))), F.lit("N")) for c in columns]
    return F.md5(F.concat_ws("|", *parts))


def same_key(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """All keys equal, nulls matching nulls."""
    return reduce(lambda a, b: a & b, (left[k].eqNullSafe(right[k]) for k in keys))


def duplicate_keys(df: DataFrame, keys: list[str], most: int = 3) -> DataFrame:
    """The keys with most rows among those with several."""
    found = df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
    return found.orderBy(F.desc("n"), *(F.col(k).asc_nulls_last() for k in keys)).limit(most)


def require_unique(df: DataFrame, keys: list[str]) -> None:
    """Raise before anything is written when a key is not unique."""
    worst = duplicate_keys(df, keys).collect()
    if worst:
        raise DuplicateKeyError(f"key ({', '.join(keys)}) is not unique: " + "; ".join(str(tuple(r)) for r in worst))


def table_checksum(df: DataFrame) -> DataFrame:
    """One row: count, sum and xor of the row hashes; the order of rows and of partitions does not matter."""
    return df.agg(*checksum_columns(df))


def checksum_columns(df: DataFrame) -> list[Column]:
    """rows, hash_sum and hash_xor as aggregates; those of two tables of equal columns add up, and xor, to those of their union."""
    h = F.xxhash64(*sorted(df.columns))
    return [F.count("*").alias("rows"), F.sum(h.cast("decimal(38,0)")).alias("hash_sum"), F.bit_xor(h).alias("hash_xor")]


def comparable(schema: StructType, columns: list[str]) -> list[str]:
    """The columns that have an order, which those with maps have not."""
    return [c for c in columns if not any(kind in schema[c].dataType.simpleString() for kind in ("map<", "variant"))]


def spread(df: DataFrame, columns: list[str], rows: int | None = None) -> DataFrame:
    """The rows dealt by a hash of ``columns`` to tasks of about so many (ROWS_A_TASK).

    A file goes to tasks by its bytes, so one that is small for its rows is all
    but one task's. The count reads no column of a Parquet file.
    """
    parts = math.ceil(df.count() / (rows or ROWS_A_TASK))
    return df.repartition(parts, *(F.col(f"`{c}`") for c in comparable(df.schema, columns))) if parts > 1 else df
