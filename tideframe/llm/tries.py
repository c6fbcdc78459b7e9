"""Conversation prefix trie by fixed-length block hashing.

Turns are cut into blocks of a few successive ones. Conversations are first
grouped by the digests of their successive blocks: those that agree on all blocks
so far are one group, and where a whole group agrees on its next block too, the
nodes of that block are one chain, read off a single member. Only where the
members of a group diverge inside a block, or end there, are its rows refined
turn by turn. The digest of a prefix is the xor of the digests of its blocks, each
with its place, so prefixes of any length come from one running aggregate.

Each node belongs to its smallest conversation, and a conversation owns a node
only together with all below it on its path. So what a node's subtree holds is a
sum over its members of what they own, less what its owner owns above it: two
passes of grouping, however deep the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideframe.llm.graph import forget, keep

#: Turns of a block; places that a running aggregate sees together; ids in a piece of a node's list.
BLOCK, SPAN, LISTED = 4, 1024, 400
NODE = ["depth", "a", "b"]


def digest(role: Column, text: Column) -> Column:
    """128 bits of a turn; nulls are empty, and no text runs into a role."""
    role, text = (F.coalesce(c.cast("string"), F.lit("")) for c in (role, text))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest, size of every turn: its place in the conversation from 0, its digest and its text's bytes; a kept table.

    By turn, null first; ties by role, then by digest. Null roles and texts are
    empty, repeated turns are turns like others, rows without a conv_id are left
    out; other columns are ignored. A conversation is dealt by ranges of its
    turns, so one of very many turns is no one task's.
    """
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        digest(F.col("role"), F.col("text")).alias("digest"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("size"),
    )
    # equal rows are told apart, so that very many of them can be cut too
    order = ["conv_id", "turn", "role", "digest", "apart"]
    dealt = rows.withColumn("apart", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, before = None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            new = np.concatenate(([ids[0] != last], ids[1:] != ids[:-1]))
            at = np.arange(len(ids))
            first = np.maximum.accumulate(np.where(new, at, -before))
            last, before = ids[-1], int(at[-1] - first[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), pa.array(at - first), batch.column("digest"), batch.column("size")], ["conv_id", "part", "place", "digest", "size"])

    parts = keep(dealt.select("conv_id", F.spark_partition_id().alias("part"), "digest", "size").mapInArrow(number, "conv_id long, part int, place long, digest binary, size long"))
    # only the first conversation of a part can have begun before it: a row a part at most
    held = parts.groupBy("conv_id", "part").count()
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begun = held.select("conv_id", "part", F.sum("count").over(before).alias("begun")).filter("begun is not null")
    return parts.join(F.broadcast(begun), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("begun", F.lit(0))).alias("place"), "digest", "size")


def _before(rows: DataFrame, key: str, at: str, values: list[str], how: Callable[[Column], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """``rows`` with ``before_<value>``: what the rows of the same key at smaller places come to; 0 without any.

    Spans of places are run through apart and shifted by the sums of earlier
    spans, so that a key with very many places is cut too.
    """
    cut = rows.withColumn("__span", F.floor(F.col(at) / SPAN))
    own = Window.partitionBy(key, "__span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy(key).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(key, "__span").agg(*(how(F.col(v)).alias(f"__s_{v}") for v in values))
    shift = sums.select(key, "__span", *(F.coalesce(how(F.col(f"__s_{v}")).over(ahead), F.lit(0)).alias(f"__a_{v}") for v in values))
    run = cut.select("*", *(F.coalesce(how(F.col(v)).over(own), F.lit(0)).alias(f"__o_{v}") for v in values))
    out = run.join(shift, [key, "__span"])
    return out.select(*rows.columns, *(both(F.col(f"__o_{v}"), F.col(f"__a_{v}")).alias(f"before_{v}") for v in values))


def _blocks(turns: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """conv_id, k, p1, p2, size, a, b: for each block its number, the digest of what lies before it and, turn by turn, text bytes and the digest of the prefix up to there.

    Every conversation ends in a block that is not full, empty if need be. A kept table.
    """
    rows = turns.groupBy("conv_id", F.floor(F.col("place") / block).alias("k")).agg(F.array_sort(F.collect_list(F.struct("place", "digest", "size"))).alias("t"))
    lengths = convs.join(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"))
    empty = lengths.filter(F.col("n") % block == 0).select("conv_id", F.floor(F.col("n") / block).alias("k"), F.filter(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("size"))), lambda _: F.lit(False)).alias("t"))
    chain = F.aggregate("t", F.array().cast("array<binary>"), lambda held, x: F.concat(held, F.array(F.unhex(F.md5(F.concat(F.coalesce(F.get(held, F.size(held) - 1), F.lit(b"")), x["digest"]))))))
    mark = lambda name: F.transform("q", lambda x, i: F.xxhash64(F.lit(name), F.col("k") * block + i + 1, x))
    marked = rows.unionByName(empty).withColumn("q", chain).select("conv_id", "k", F.col("t.size").alias("size"), mark("first").alias("x"), mark("second").alias("y"))
    full = lambda c: F.when(F.size(c) == block, F.element_at(c, -1)).otherwise(F.lit(0))
    placed = _before(marked.withColumn("x_end", full("x")).withColumn("y_end", full("y")), "conv_id", "k", ["x_end", "y_end"], F.bit_xor, lambda u, v: u.bitwiseXOR(v))
    return keep(
        placed.select(
            "conv_id",
            "k",
            F.col("before_x_end").alias("p1"),
            F.col("before_y_end").alias("p2"),
            "size",
            F.transform("x", lambda v: v.bitwiseXOR(F.col("before_x_end"))).alias("a"),
            F.transform("y", lambda v: v.bitwiseXOR(F.col("before_y_end"))).alias("b"),
        )
    )


def _turns_of(blocks: DataFrame, block: int, *others: str) -> DataFrame:
    """A row for each turn of the blocks: its node, the node above, the text's bytes."""
    rows = blocks.select("*", F.posexplode(F.arrays_zip("a", "b", "size")).alias("j", "z"))
    above = lambda c, p: F.when(F.col("j") == 0, F.col(p)).otherwise(F.get(F.col(c), F.col("j") - 1))
    return rows.select((F.col("k") * block + F.col("j") + 1).alias("depth"), F.col("z.a").alias("a"), F.col("z.b").alias("b"), above("a", "p1").alias("above_a"), above("b", "p2").alias("above_b"), F.col("z.size").alias("size"), *others)


def _listed(ends: DataFrame) -> DataFrame:
    """depth, a, b, ends_sha256 of the decimal conv_ids that end in a node, ascending and comma-joined.

    Ids are sorted by ranges and joined a few hundred at a time; a node's pieces
    are then digested one after the other as they stream by.
    """
    order = [*NODE, "conv_id"]

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in NODE])
            n = keys.shape[1]
            if not n:
                continue
            new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            at = np.arange(n)
            begin = np.flatnonzero((at - np.maximum.accumulate(np.where(new, at, 0))) % LISTED == 0)
            names = pc.cast(batch.column("conv_id"), pa.string()).to_pylist()
            texts = [",".join(names[x:y]) for x, y in zip(begin, [*begin[1:], n], strict=True)]
            take = pa.array(begin)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in order), pa.array(texts, pa.string())], [*order, "ids"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*NODE, "ends_sha256"]
        held, now = None, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([r[0][i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[1] for r in rows], pa.string())], names)

        for batch in batches:
            done = []
            columns = [batch.column(c).to_pylist() for c in (*NODE, "ids")]
            for node, rows in groupby(zip(*columns, strict=True), key=lambda r: r[:3]):
                if node != held:
                    if held is not None:
                        done.append((held, now.hexdigest()))
                    held, now, comma = node, hashlib.sha256(), b""
                else:
                    comma = b","
                for r in rows:
                    now.update(comma + r[3].encode())
                    comma = b","
            yield out(done)
        if held is not None:
            yield out([(held, now.hexdigest())])

    schema = "depth long, a long, b long"
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(joined, f"{schema}, conv_id long, ids string")
    return pieces.repartition(*NODE).sortWithinPartitions(*order).select(*NODE, "ids").mapInArrow(digested, f"{schema}, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct sequence of first turns: conv_id (its smallest conversation), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, place (from 0, gapless), digest and size, see
    ``ordered``; ``convs`` has each conv_id once, those without turns included.
    n_leaves counts the nodes without children in the subtree, saved_tokens adds
    up (n_convs - 1) * size over it, ends_sha256 digests the conversations that
    end in the node. Without conversations there are no nodes.
    """
    blocks = _blocks(turns, convs, block)
    end = F.when(F.size("a") == block, F.struct(F.element_at("a", -1).alias("a"), F.element_at("b", -1).alias("b")))
    groups = blocks.groupBy("k", "p1", "p2").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("owner"), (F.min(F.size("a")) == block).alias("all_full"), F.min(end).alias("lo"), F.max(end).alias("hi")
    )
    groups = keep(groups.select("k", "p1", "p2", "n", "owner", (F.col("all_full") & F.col("lo").eqNullSafe(F.col("hi"))).alias("chain")))
    # both are tables, and nothing else reads what a key is dealt to, so the one group of all beginnings can be split
    grouped = keep(blocks.join(groups, ["k", "p1", "p2"]))
    forget(blocks, groups)
    alike = _turns_of(grouped.filter("chain and conv_id = owner"), block, "n", "owner", "k", "p1", "p2")
    node = [*NODE, "above_a", "above_b", "size"]
    none = [F.lit(None).cast("long").alias(c) for c in ("k", "p1", "p2")]
    refined = _turns_of(grouped.filter("not chain"), block, "conv_id").groupBy(*node).agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")).select("*", *none)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("owner")).filter("n > 0").select(
        *(zero.alias(c) for c in NODE), *(F.lit(None).cast("long").alias(c) for c in ("above_a", "above_b")), zero.alias("size"), "n", "owner", *none
    )
    nodes = keep(alike.unionByName(refined).unionByName(root).withColumn("saves", (F.col("n") - 1) * F.col("size")))

    # what each conversation owns: what its nodes save, and a leaf at most
    above = nodes.filter("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("above_a").alias("a"), F.col("above_b").alias("b"))
    leaves = nodes.join(above.distinct(), NODE, "left_anti").select("owner", F.lit(0).alias("saves"), F.lit(1).alias("leaves"))
    owned = keep(
        nodes.select("owner", "saves", F.lit(0).alias("leaves")).unionByName(leaves)
        .groupBy(F.col("owner").alias("conv_id")).agg(F.sum("saves").alias("saves"), F.sum("leaves").alias("leaves")).filter("saves > 0 or leaves > 0")
    )
    members = grouped.join(owned, "conv_id")
    sums = [F.sum("saves").alias("saves_below"), F.sum("leaves").alias("n_leaves")]
    of_chains = members.filter("chain").groupBy("k", "p1", "p2").agg(*sums)
    chained = nodes.filter("k is not null").join(of_chains, ["k", "p1", "p2"]).select(*NODE, "saves_below", "n_leaves")
    others = _turns_of(members.filter("not chain"), block, "saves", "leaves").groupBy(*NODE).agg(*sums)
    whole = owned.agg(*sums).filter("n_leaves is not null").select(*(zero.alias(c) for c in NODE), "saves_below", "n_leaves")
    last = lambda c, p: F.coalesce(F.get(F.col(c), F.size(c) - 1), F.col(p))
    ends = _listed(grouped.filter(F.size("a") < block).select((F.col("k") * block + F.size("a")).alias("depth"), last("a", "p1").alias("a"), last("b", "p2").alias("b"), "conv_id"))

    owner = _before(nodes.select(*NODE, "above_a", "above_b", "n", "owner", "saves"), "owner", "depth", ["saves"], F.sum, lambda u, v: u + v)
    facts = owner.unionByName(above.groupBy(*NODE).agg(F.count("*").alias("n_children")), allowMissingColumns=True)
    for more in (chained, others, whole, ends):
        facts = facts.unionByName(more, allowMissingColumns=True)
    # each fact of a node stands in one row
    rows = keep(facts.groupBy(*NODE).agg(*(F.max(c).alias(c) for c in facts.columns if c not in NODE)))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("above_a"), F.col("b").alias("above_b"), F.col("owner").alias("parent_conv_id"))
    out = rows.join(parents, ["depth", "above_a", "above_b"], "left")
    return out.select(
        F.col("owner").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        (F.coalesce("saves_below", F.lit(0)) - F.col("before_saves")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
