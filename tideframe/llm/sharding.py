"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows fall into blocks by a hash. For every block the numbers of its rows that go
to each shard are drawn from the multivariate hypergeometric law, so the columns
of the matrix add up to the shard sizes exactly. Each block is permuted by a
keyed hash and its first rows go to the first shard, the next to the second, and
so on; the rows then change place and each shard is permuted again by another
keyed hash. All of it is DataFrame functions; the driver sees one count a block.
Blocks, and the ranges of hashes that a shard is permuted by, grow in number with
the table, so a task has about as many rows whatever the table's size.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block in small tables, blocks from which on they grow, and rows of a block and of a range of a shard then.
BLOCK_ROWS, MANY_BLOCKS, TASK_ROWS = 2_000, 4096, 200_000


def _keyed(seed: int, name: str, columns: list[str]) -> Column:
    return F.xxhash64(F.lit(f"{seed}/{name}"), *columns)


def _below(hash_: Column, n: int) -> Column:
    return F.pmod(hash_, F.lit(n)).cast("int")


def communication_matrix(block_rows: dict[int, int], sizes: list[int], seed: int) -> dict[int, list[int]]:
    """For each block, where each shard's rows begin in the permuted block; uniform given all sums."""
    rng = np.random.Generator(np.random.PCG64(seed))
    left = np.array(sizes, np.int64)
    out = {}
    for block in sorted(block_rows):
        need, drawn, rest = block_rows[block], np.zeros(len(left), np.int64), int(left.sum())
        for s, stock in enumerate(left):
            rest -= int(stock)
            if need:
                drawn[s] = hypergeometric(rng, int(stock), rest, need)
                need -= int(drawn[s])
        left -= drawn
        out[block] = [int(x) for x in np.concatenate(([0], np.cumsum(drawn)[:-1]))]
    return out


def _log_factorial(n: int) -> np.longdouble:
    """By Stirling's series, to the last digits of an extended double."""
    if n < 20:
        return np.log(np.longdouble(math.factorial(n)))
    x = np.longdouble(n)
    series = 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return (x + 0.5) * np.log(x) - x + np.log(2 * np.longdouble(np.pi)) / 2 + series


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` balls drawn without replacement are good.

    numpy draws where there are less than a billion of each kind. Beyond that
    the law itself is sampled by rejection under a table mountain of bounded
    height (ratio of uniforms), with factorials in extended doubles; there is no
    limit law in it.
    """
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    weight = lambda k: -(_log_factorial(k) + _log_factorial(good - k) + _log_factorial(n - k) + _log_factorial(bad - n + k))
    top = weight(mode)
    share = good / total
    centre = n * share + 0.5
    spread = math.sqrt((total - n) / (total - 1) * n * share * (1 - share) + 0.5)
    # the region of the ratio of uniforms lies within this many standard deviations and a constant
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(centre + width * (v - 0.5) / u)
        if low <= k <= high and 2 * math.log(u) <= weight(k) - top:
            return k


def assign(docs: DataFrame, shards: int = 40, seed: int = 1, keep: list[str] | None = None, block_rows: int = BLOCK_ROWS, many_blocks: int = MANY_BLOCKS, task_rows: int = TASK_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (and the columns ``keep``) for every row of ``docs``.

    Every shard gets the total over ``shards`` rows, the first ``total %
    shards`` one more; slots number each shard from 0 without gaps. size is the
    text's UTF-8 bytes (null: none) plus 16. The result depends on the rows'
    doc_id and text alone, not on partitions or order, so a lost task yields the
    same rows again; rows equal in both are interchangeable. Null ids and texts
    are placed like others. The columns ``keep`` come back as they are, whatever
    their names; one named like a result makes that name ambiguous. An empty table
    gives an empty result.
    """
    # columns of the documents travel in a struct, so that none clashes with a name in use here
    carried = [F.struct(*(F.col(f"`{c}`").alias(c) for c in keep)).alias("_row")] if keep else []
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *carried,
    )
    about = ["doc_id", "text_crc32", "size"]
    total = docs.count()
    blocks = max(64, min(total // block_rows, many_blocks), total // task_rows)
    # ranges of a shard: a power of two
    bits = max(6, math.ceil(math.log2(max(1, total / shards / task_rows))))
    rows = rows.withColumn("_block", _below(_keyed(seed, "block", about), blocks))
    counts = {r[0]: r[1] for r in rows.groupBy("_block").count().collect()}
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix(counts, sizes, seed)
    spark = docs.sparkSession
    # a row a block, which is one for many thousand rows of a large table
    begins = spark.createDataFrame([(b, m) for b, m in matrix.items()], "_block int, _begin array<long>")
    first = Window.partitionBy("_block").orderBy(_keyed(seed, "first", about), *about)
    placed = (
        rows.withColumn("_rank", F.row_number().over(first) - 1)
        .join(begins, "_block")
        .withColumn("shard", (F.size(F.filter("_begin", lambda x: x <= F.col("_rank"))) - 1))
        # a shard without rows from this block begins where the next one does; the last such one holds the row
        .withColumn("_order", _keyed(seed, "second", about))
        .withColumn("_part", F.shiftrightunsigned("_order", 64 - bits).cast("int"))
        .drop("_block", "_begin", "_rank")
    )
    # the second permutation is by unsigned hash: ranges of it are ordered apart, with offsets from their counts
    ahead = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "_part").count().select("shard", "_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_offset"))
    second = Window.partitionBy("shard", "_part").orderBy("_order", *about)
    return (
        placed.withColumn("_at", F.row_number().over(second) - 1)
        .join(offsets, ["shard", "_part"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("_offset") + F.col("_at")).alias("slot"), *(["_row.*"] if keep else []))
    )
