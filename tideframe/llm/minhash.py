"""MinHash near-duplicates with tensored banding.

Two small collections of ``m`` minhash groups (``rows`` values each) are drawn;
every pair (group i of the first, group j of the second) is the key of a table.
``2 * m * rows`` minhashes thus serve ``m * m`` tables of ``2 * rows`` values,
about the square root of what separate tables would need. A pair of similarity s
meets in some table with probability ``(1 - (1 - s**rows)**m)**2``; ``m`` is the
smallest that makes this 0.9995 at the threshold.

Equal shingle sets are one class with one representative, however many copies
there are. Candidates of a table: all pairs of buckets of at most ``small``
classes; in larger ones every class meets the leader of its bucket, and leaders
are chosen in several ways among the tables. Each class is confirmed with the
candidate it shares most tables with, then with those it is still apart from. A
large bucket that is of several components even so is compared whole, by the
rarest shingles of its sets: two sets of the similarity asked for must share one
of them, so no link is lost, while members of a family that each have shingles
of their own do not meet. Every candidate is confirmed on the full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.graph import components, filter_slot, forget, id_filter, keep, passes
from tideframe.llm.wordhash import NOT_SPACE, grams, mix, texts, word_hashes

RECALL = 0.9995
ROWS = 3
#: Classes of a bucket whose pairs are all candidates at once, and ways to choose the leader of a larger one.
SMALL, LEADERS = 8, 4
#: Slots in which occurrences of shingles are counted for their order.
SLOTS = 1 << 18


def collections(threshold: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """Groups in each of the two collections."""
    miss = 1 - recall**0.5
    return max(2, int(np.ceil(log(miss) / log(1 - threshold**rows))))


def shingle_sets(array: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    Texts of fewer than ``k`` words, but not none, have the hash of the whole
    sequence as their only shingle; null and empty texts have none.
    """
    for lo, hi, data, offs in texts(array):
        words, first, _, _ = word_hashes(data, offs, NOT_SPACE)
        gram = grams(words, k)
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(gram[a : b - k + 1])
            elif b > a:
                yield grams(words[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def _sketcher(k: int, m: int, rows: int, seed: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.Generator(np.random.PCG64(seed))
        factor = rng.integers(1, 1 << 62, 2 * m * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        shift = rng.integers(0, 1 << 63, 2 * m * rows, dtype=np.uint64)
        fold = rng.integers(1, 1 << 62, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            sizes, keys, groups = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    groups.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                least = np.empty(2 * m * rows, np.uint64)
                for part in range(0, len(s), 2048):
                    low = (s[part : part + 2048, None] * factor + shift).min(axis=0)
                    least = low if part == 0 else np.minimum(least, low)
                group = mix((least.reshape(2 * m, rows) * fold).sum(axis=1, dtype=np.uint64) + np.arange(2 * m, dtype=np.uint64))
                groups.append(group.view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "groups"],
            )

    return sketch


def sketches(docs: DataFrame, k: int = 5, threshold: float = 0.8, rows: int = ROWS, seed: int = 1) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the set) and the 2 m group values."""
    m = collections(threshold, rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _sketcher(k, m, rows, seed), "doc_id long, n_shingles long, set_key binary, groups array<long>"
    )


def candidates(classes: DataFrame, m: int, threshold: float, small: int = SMALL) -> tuple[DataFrame, DataFrame]:
    """(pairs, large) of classes (rep, n_shingles, groups), both kept.

    pairs: (a, b, tables), a < b, the classes that tables propose and how many do;
    large: (key, rep), the members of buckets of more than ``small`` classes, of
    which only those with the bucket's leader are pairs.
    """
    values = classes.select("rep", F.posexplode("groups").alias("at", "value"))
    shared = values.groupBy("value").count().filter("count > 1").select("value")
    held = values.join(shared, "value").groupBy("rep").agg(F.collect_set("at").alias("held"))
    has = lambda v, i: F.array_contains("held", i)
    rows = (
        classes.join(held, "rep")
        .select("rep", "n_shingles", F.filter("groups", has).alias("v"), F.size(F.filter("held", lambda i: i < m)).alias("left"))
        .select("rep", "n_shingles", F.slice("v", F.lit(1), F.col("left")).alias("left"), F.slice("v", F.col("left") + 1, F.lit(2 * m)).alias("right"))
        .select("rep", "n_shingles", "right", F.explode("left").alias("l"))
        .select("rep", "n_shingles", F.explode(F.transform("right", lambda r: F.xxhash64("l", r))).alias("key"))
    )
    # leaders differ between tables, so that one that is no neighbour does not lead all
    order = F.xxhash64(F.pmod("key", F.lit(LEADERS)), "rep")
    size = rows.groupBy("key").agg(F.count("*").alias("n"), F.min_by("rep", order).alias("lead"), F.min_by("n_shingles", order).alias("lead_n")).filter("n > 1")
    rows = rows.join(size, "key")
    fits = lambda x, y: F.least(x, y) >= F.lit(threshold) * F.greatest(x, y)
    inner = (
        rows.filter(F.col("n") <= small)
        .groupBy(F.xxhash64(F.lit(0), "key").alias("bucket"))
        .agg(F.sort_array(F.collect_set(F.struct("rep", "n_shingles"))).alias("all"))
        .select(F.explode("all").alias("x"), "all")
        .select("x", F.explode(F.filter("all", lambda y: y["rep"] > F.col("x.rep"))).alias("y"))
        .filter(fits(F.col("x.n_shingles"), F.col("y.n_shingles")))
        .select(F.lit(None).cast("long").alias("key"), F.col("x.rep").alias("x"), F.col("y.rep").alias("y"), F.lit(True).alias("fits"))
    )
    star = rows.filter(F.col("n") > small).select("key", F.col("lead").alias("x"), F.col("rep").alias("y"), fits(F.col("lead_n"), F.col("n_shingles")).alias("fits"))
    met = keep(inner.union(star))
    pairs = met.filter("fits and x <> y").groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("tables"))
    pairs, large = keep(pairs), keep(met.filter("key is not null").select("key", F.col("y").alias("rep")))
    forget(met)
    return pairs, large


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.zeros(SLOTS, np.int64)
        for x in batch.column("shingles"):
            counts += np.bincount((np.frombuffer(x.as_buffer(), np.uint64) % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[at])], ["slot", "n"])


def stragglers(packed: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: pairs of classes in ``packed`` (rep, shingles) that no link has joined yet (``found``: node, component).

    Shingles are ordered by how often their slot of ``SLOTS`` occurs, rarest first;
    any order common to all sets would do. Sets with ``n`` in common share one of
    their first ``size - n + 1``, so only these meet, and only where both places
    leave enough shingles for the similarity. The largest component at a shingle
    is left in peace with itself.
    """
    counts = packed.select("shingles").mapInArrow(_counter, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    often = np.zeros(SLOTS, np.int64)
    often[counts.column("slot").to_numpy()] = counts.column("n").to_numpy()
    shared = packed.sparkSession.sparkContext.broadcast(often)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, places, shingles = [], [], []
            for x in batch.column("shingles"):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                spare = len(s) - (len(s) * percent + 99) // 100 + 1
                own = s[np.lexsort((s, shared.value[(s % np.uint64(SLOTS)).astype(np.int64)]))[:spare]]
                sizes.append(np.full(len(own), len(s)))
                places.append(np.arange(len(own)))
                shingles.append(own.view(np.int64))
            reps = np.repeat(batch.column("rep").to_numpy(), [len(x) for x in places])
            columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (sizes, places, shingles)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (reps, *columns)], ["rep", "n", "at", "s"])

    ahead = packed.mapInArrow(first, "rep long, n long, at long, s long")
    named = keep(ahead.join(found, F.col("rep") == F.col("node"), "left").select("rep", "n", "at", "s", F.coalesce("component", "rep").alias("c")))
    by_component = named.groupBy("s", "c").count()
    main = by_component.groupBy("s").agg(F.max_by("c", F.struct("count", -F.col("c"))).alias("main"), F.count("*").alias("kinds")).filter("kinds > 1").select("s", "main")
    held = named.join(main, "s")
    common = F.expr(f"({percent} * (x.n + y.n) + {99 + percent}) div {100 + percent}")
    condition = (
        (F.col("x.s") == F.col("y.s"))
        & (F.col("x.c") != F.col("y.c"))
        & ((F.col("y.c") == F.col("y.main")) | (F.col("x.rep") < F.col("y.rep")))
        & (F.col("x.at") <= F.col("x.n") - common)
        & (F.col("y.at") <= F.col("y.n") - common)
    )
    met = held.filter("c <> main").alias("x").join(held.alias("y"), condition)
    out = keep(met.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct())
    forget(named)
    return out


def _packed(whole: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(rep, shingles) of the rows of ``whole`` (rep, text) whose rep is in ``ids``, and of some others that a bounded filter lets through."""
    bits = whole.sparkSession.sparkContext.broadcast(id_filter(ids, "rep"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(passes(bits.value, batch.column("slot").to_numpy())))
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])

    sets = whole.select("rep", "text", filter_slot("rep").alias("slot")).mapInArrow(pack, "rep long, shingles binary")
    # rows that repeat an id and a text are one
    return sets.groupBy("rep").agg(F.collect_set("shingles").alias("all")).select("rep", F.explode("all").alias("shingles"))


def _confirmer(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = np.zeros(len(batch), bool)
            for i, (x, y) in enumerate(zip(batch.column("x"), batch.column("y"), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                inner = int((both[1:] == both[:-1]).sum())
                hit[i] = 100 * inner >= percent * (len(both) - inner)
            kept = batch.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return confirm


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, seed: int = 1, small: int = SMALL) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text, ...).

    Two documents are linked when ``100 * |A and B| >= percent * |A or B|`` over
    their sets of distinct ``k``-word shingles; component_id is the smallest
    doc_id reachable, kept marks that document. Null and empty texts have no
    shingles and link with nothing. A document is its doc_id: rows that repeat
    an id share a component. Rows with a null id get a null component and are
    kept. Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    threshold = percent / 100
    sketch = keep(sketches(docs, k, threshold, seed=seed))
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    classes = keep(known.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "groups")).alias("c")).select("set_key", F.col("c.doc_id").alias("rep"), "c.n_shingles", "c.groups"))
    links = keep(known.join(classes.select("set_key", "rep"), "set_key").filter("doc_id <> rep").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    rows = keep(sketch.select("doc_id", "n_shingles"))
    forget(sketch)
    pairs, large = candidates(classes.drop("set_key"), collections(threshold), threshold, small)
    forget(classes)
    whole = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).filter("rep is not null")

    def confirmed(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
        packed = _packed(whole, ends, k)
        return (
            pairs.join(packed.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
            .join(packed.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a")
            .select("a", "b", "x", "y")
            .mapInArrow(_confirmer(percent), "a long, b long")
            .select(F.col("a").alias("u"), F.col("b").alias("v"))
        )

    def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
        own = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        both = pairs.join(own("a"), "a", "left").join(own("b"), "b", "left")
        return both.filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    def settled(asked: DataFrame, found: DataFrame | None) -> DataFrame:
        """Components with those of ``asked`` that hold; ``asked`` and the old ones go."""
        if found is None:
            more = components(spark, links.union(confirmed(asked)))
        elif asked.isEmpty():
            more = found
        else:
            # a component counts as a star from here on
            more = components(spark, found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(confirmed(asked)))
            forget(found)
        forget(asked)
        return more

    # first each class with the one it shares most tables with, then the pairs which that leaves apart
    rank = F.col("tables") * 1_000_003 + F.pmod(F.xxhash64("a"), F.lit(1_000_003))
    best = pairs.groupBy("b").agg(F.max_by("a", rank).alias("a")).select("a", "b")
    found = settled(keep(best), None)
    found = settled(keep(apart(pairs.join(best, ["a", "b"], "left_anti"), found)), found)
    # buckets that are still of several components, whose members no leader has joined
    mixed = large.join(found, F.col("rep") == F.col("node"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    several = mixed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).filter("least <> most").select("key")
    rest = keep(large.join(several, "key", "left_semi").select("rep").distinct())
    if not rest.isEmpty():
        packed = keep(_packed(whole, rest, k).join(rest, "rep", "left_semi"))
        asked = stragglers(packed, found, percent)
        forget(packed)
        found = settled(asked, found)
    out = rows.join(found, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    out = keep(out.select("doc_id", "n_shingles", component.alias("component_id"), (component.eqNullSafe(F.col("doc_id"))).alias("kept")))
    forget(pairs, large, rest, links, rows, found)
    return out


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, seed: int = 1) -> DataFrame:
    """One row of each group of near-duplicates in ``docs`` (doc_id, text, ...), all columns.

    Rows are told apart by doc_id and text, null ids included: rows equal in both
    are one, of which the one with the smallest hash of all columns stays. Null
    and empty texts link with nothing. The row that stays is the one with the
    smallest hash of id and text.
    """
    names = docs.columns
    own = F.struct(*(F.col(f"`{c}`") for c in names))
    ids = [F.xxhash64(F.lit(s), F.col("doc_id").cast("long"), F.col("text").cast("string")) for s in (1, 2)]
    keyed = docs.select(ids[0].alias("node"), ids[1].alias("more"), own.alias("row"))
    found = near_duplicates(docs.select(ids[0].alias("doc_id"), "text"), k, percent, seed).filter("kept").select(F.col("doc_id").alias("node")).distinct()
    plain = [f"row.`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    single = keyed.groupBy("node", "more").agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return single.join(found, "node", "left_semi").select("row.*")


