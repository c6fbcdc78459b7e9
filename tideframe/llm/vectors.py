"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors of a label are one class, found by aggregation, so thousands of
   copies are one node.
2. Each label is cut into clusters fitted on a bounded sample. A vector is a
   member of its nearest clusters, so shards overlap; clusters of more members
   than a task should hold are split by hash into several shards, and a vector
   is a member of two shards of its own cluster then.
3. Within each shard a graph is built by insertion: nodes search the graph so
   far from its medoid, their neighbours are chosen by robust pruning, and links
   are made both ways. The adjacency lists of a node from all of its shards are
   united.
4. Every node visits the shards of its nearest clusters and searches them
   greedily from the medoid and from its own place. Once there, the search
   expands by range: all that is within half as much again of the angle is
   expanded until nothing new turns up. Nodes met on united lists that live in a
   shard not yet visited send the search on there, until none is left.
5. What is found is verified by its cosine in doubles. A shard counts only the
   nodes at home in it, so no link counts twice, and returns counts and a
   spanning forest of the links, never all pairs of a family.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideframe.llm.graph import components, forget, keep

#: Vectors that the clusters are fitted on at most (and as many values as 64 of each), and members of a cluster aimed at.
SAMPLE, SHARD_ROWS = 40_000, 500
#: Members of a shard before its cluster is split, and nodes that search a shard in one task.
MOST_ROWS, VISITORS = 2000, 1024
#: Clusters that a vector is a member of; neighbours of a node in a shard; slack of pruning; nodes a search holds.
OVERLAP, DEGREE, ALPHA, BEAM = 2, 16, 1.2, 40
#: Queries that are searched together.
TOGETHER = 256


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows of a list column whose lists are of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)) if len(column) else np.zeros((0, 1))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centre = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[lo : lo + 1024] @ centre.T).argmax(axis=1) for lo in range(0, len(x), 1024)])
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        empty = np.bincount(near, minlength=k) == 0
        total[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centre = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-30)
    return centre


def fit_clusters(classes: DataFrame, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, seed: int = 1) -> dict[tuple[str, int], tuple[int, np.ndarray]]:
    """(number of the first, unit centres) by (label, dimensions), about one for ``shard_rows`` vectors and for four of the sample at most."""
    about = classes.agg(F.count("*").alias("n"), F.max("dim").alias("dim")).first()
    most = max(1, min(sample, 64 * sample // max(64, about["dim"] or 1)))
    share = F.pmod(F.xxhash64("node"), F.lit(1_000_003)) < F.lit(int(1_000_003 * min(1.0, most / max(1, about["n"]))) + 1)
    drawn = classes.filter(share).select("label", "dim", "vector").limit(2 * most).toArrow()
    held: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(drawn.column("label").to_pylist(), drawn.column("dim").to_pylist(), strict=True)):
        held.setdefault(key, []).append(i)
    if not held:
        return {}
    # only labels of the sample have more than one cluster, so this is no longer than the sample
    names = classes.sparkSession.createDataFrame(list(held), "label string, dim int")
    sizes = {(r[0], r[1]): r[2] for r in classes.groupBy("label", "dim").count().join(names, ["label", "dim"], "left_semi").collect()}
    rng, out, first = np.random.Generator(np.random.PCG64(seed)), {}, 0
    for key in sorted(held):
        x = _matrix(drawn.column("vector").take(pa.array(held[key])))
        k = max(1, min(sizes[key] // shard_rows, len(x) // 4))
        out[key] = (first, _kmeans(x, k, rng))
        first += k
    return out


def _placed(classes: DataFrame, centres: dict[tuple[str, int], tuple[int, np.ndarray]], overlap: int) -> DataFrame:
    """(node, copies, vector, clusters): the nearest clusters of each class, nearest first."""
    shared = classes.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                own.setdefault(key, []).append(i)
            # labels that the sample lacks are a cluster each
            clusters = [[x] for x in batch.column("alone").to_pylist()]
            for key, at in own.items():
                first, centre = shared.value.get(key, (0, None))
                for lo in range(0, len(at) if centre is not None else 0, 512):
                    part = at[lo : lo + 512]
                    near = np.argsort(-(_matrix(batch.column("vector").take(pa.array(part))) @ centre.T), axis=1, kind="stable")[:, :overlap]
                    for i, c in zip(part, (near + first).tolist(), strict=True):
                        clusters[i] = c
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("vector"), pa.array(clusters, pa.list_(pa.int64()))], ["node", "copies", "vector", "clusters"])

    kind = classes.schema["vector"].dataType.simpleString()
    alone = (-1 - F.pmod(F.xxhash64("label", "dim"), F.lit(1 << 40))).alias("alone")
    return classes.select("node", "copies", "label", "dim", "vector", alone).mapInArrow(place, f"node long, copies long, vector {kind}, clusters array<long>")


def robust_prune(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours of each node out of its row of ``pool`` (-1: none): nearest first, dropping those alpha times nearer to a chosen one than to the node."""
    pool = np.sort(pool, axis=1)
    bad = (pool < 0) | (pool == nodes[:, None])
    bad[:, 1:] |= pool[:, 1:] == pool[:, :-1]
    v = x[pool]
    gap = np.where(bad, np.inf, np.sqrt(np.maximum(0, 2 - 2 * np.einsum("bpd,bd->bp", v, x[nodes]))))
    order = np.argsort(gap, axis=1, kind="stable")
    pool, gap = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1)
    v = x[pool]
    between = np.sqrt(np.maximum(0, 2 - 2 * (v @ v.transpose(0, 2, 1))))
    left, rows = np.isfinite(gap), np.arange(len(nodes))
    out = np.full((len(nodes), degree), -1)
    for r in range(degree):
        some = left.any(axis=1)
        if not some.any():
            break
        first = left.argmax(axis=1)
        out[some, r] = pool[rows, first][some]
        left &= alpha * between[rows, first] > gap
        left[rows, first] = False
    return out


def greedy_search(x: np.ndarray, near: np.ndarray, starts: np.ndarray, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(the ``beam`` nodes that each query held at last, its cosine to every node met and -2 to the others).

    ``starts`` has a row of entry nodes for each query (-1: none).
    """
    rows = np.arange(len(queries))
    sims = np.full((len(queries), len(x)), -2.0)
    held, value = np.full((len(queries), beam), -1), np.full((len(queries), beam), -3.0)
    done = np.ones((len(queries), beam), bool)

    def meet(who: np.ndarray, nodes: np.ndarray) -> None:
        nonlocal held, value, done
        nodes = np.sort(nodes, axis=1)
        new = (nodes >= 0) & (sims[who[:, None], nodes] == -2.0)
        new[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        found = np.where(new, np.einsum("qnd,qd->qn", x[nodes], queries[who]), -3.0)
        a, b = np.nonzero(new)
        sims[who[a], nodes[a, b]] = found[a, b]
        all_nodes, all_values = np.concatenate([held[who], nodes], axis=1), np.concatenate([value[who], found], axis=1)
        all_done = np.concatenate([done[who], ~new], axis=1)
        best = np.argsort(-all_values, axis=1, kind="stable")[:, :beam]
        held[who], value[who], done[who] = (np.take_along_axis(v, best, 1) for v in (all_nodes, all_values, all_done))

    meet(rows, starts)
    while True:
        who = np.flatnonzero(~done.all(axis=1))
        if not len(who):
            return held, sims
        at = (~done[who]).argmax(axis=1)
        done[who, at] = True
        meet(who, near[held[who, at]])


def expand_range(x: np.ndarray, near: np.ndarray, queries: np.ndarray, sims: np.ndarray, least: float) -> None:
    """Expand all nodes of cosine ``least`` or more, those that this turns up included; adds to ``sims``."""
    n, expanded = len(x), np.zeros(sims.shape, bool)
    while True:
        q, node = np.nonzero((sims >= least) & ~expanded)
        if not len(q):
            return
        expanded[q, node] = True
        for lo in range(0, len(q), 4096):
            to = near[node[lo : lo + 4096]]
            pairs = np.unique((q[lo : lo + 4096, None] * n + to)[to >= 0])
            a, b = pairs // n, pairs % n
            new = sims[a, b] == -2.0
            a, b = a[new], b[new]
            for k in range(0, len(a), 20_000):
                i, j = a[k : k + 20_000], b[k : k + 20_000]
                sims[i, j] = np.einsum("nd,nd->n", queries[i], x[j])


def _medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(axis=0)).argmax())


def build(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BEAM) -> np.ndarray:
    """Neighbours of every row (-1: none), by insertion in batches that double in size."""
    near, root, n = np.full((len(x), degree), -1), _medoid(x) if len(x) else 0, len(x)
    # an order that is the same whenever the rows are, and mixes what came in a row
    order = np.random.Generator(np.random.PCG64(n)).permutation(n)
    order = np.concatenate([[root], order[order != root]]).astype(int) if n else order
    lo = 1
    while lo < n:
        nodes = order[lo : min(n, 2 * lo, lo + TOGETHER)]
        held, _ = greedy_search(x, near, np.full((len(nodes), 1), root), x[nodes], beam)
        # those that come together may be each other's nearest
        peers = np.argsort(-(x[nodes] @ x[nodes].T), axis=1)[:, : degree + 1]
        near[nodes] = robust_prune(x, nodes, np.concatenate([held, nodes[peers]], axis=1), degree, alpha)
        back: dict[int, list[int]] = {}
        for node, own in zip(nodes.tolist(), near[nodes].tolist(), strict=True):
            for other in own:
                if other >= 0:
                    back.setdefault(other, []).append(node)
        width = max(map(len, back.values()))
        whom = np.array(list(back))
        more = np.array([v + [-1] * (width - len(v)) for v in back.values()])
        for k in range(0, len(whom), TOGETHER):
            near[whom[k : k + TOGETHER]] = robust_prune(x, whom[k : k + TOGETHER], np.concatenate([near[whom[k : k + TOGETHER]], more[k : k + TOGETHER]], axis=1), degree, alpha)
        lo += len(nodes)
    return near


def _lists(rows: list[np.ndarray]) -> pa.Array:
    cut = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)))


def _build_shard(table: pa.Table) -> pa.Table:
    ids = table.column("node").to_numpy()
    near = build(_matrix(table.column("vector")))
    return pa.table({"shard": table.column("shard"), "node": pa.array(ids), "near": _lists([ids[r[r >= 0]] for r in near])})


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of ``n`` reaches by the links (a, b)."""
    label = np.arange(n)
    while True:
        least, new = np.minimum(label[a], label[b]), label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


_FOUND = "kind int, u long, v long, w long, cosine double"
VISITOR, HOME, MEMBER, OUTSIDE = range(4)
COUNT, LINK, ONWARD = range(3)


def _search_shard(threshold: float, beam: int):
    angle = np.arccos(np.clip(threshold, -1, 1))
    loose = np.cos(min(np.pi, 1.5 * angle)) - 1e-9

    def search(table: pa.Table) -> pa.Table:
        kind, ids, shard = table.column("kind").to_numpy(), table.column("node").to_numpy(), table.column("shard")[0].as_py()
        x, out = _matrix(table.column("vector")), []
        inner = np.flatnonzero(kind != VISITOR)
        inner = inner[np.argsort(ids[inner])]
        members = np.flatnonzero((kind[inner] == HOME) | (kind[inner] == MEMBER))
        asking = np.flatnonzero(kind == VISITOR)
        if len(members) and len(asking):
            own, y, home = ids[inner], x[inner], table.column("home").to_numpy()[inner]
            copies, here = table.column("copies").to_numpy()[inner], kind[inner] == HOME
            lists = table.column("near").combine_chunks().take(pa.array(inner))
            counts = np.array([len(v) if v.is_valid else 0 for v in lists])
            to = lists.flatten().to_numpy()
            at = np.minimum(np.searchsorted(own, to), len(own) - 1)
            near = np.full((len(own), max(1, counts.max())), -1)
            row = np.repeat(np.arange(len(own)), counts)
            near[row, np.arange(len(to)) - np.repeat(np.cumsum(counts) - counts, counts)] = np.where(own[at] == to, at, -1)
            root, entry = members[_medoid(y[members])], table.column("entry").to_numpy()
            everyone = np.unique(np.concatenate([own, ids[asking]]))
            place, label = np.searchsorted(everyone, own), np.arange(len(everyone))
            for lo in range(0, len(asking), TOGETHER):
                part = asking[lo : lo + TOGETHER]
                known = [np.minimum(np.searchsorted(own, v), len(own) - 1) for v in (ids[part], entry[part])]
                starts = np.stack([np.full(len(part), root), *(np.where(own[k] == v, k, -1) for k, v in zip(known, (ids[part], entry[part]), strict=True))], axis=1)
                _, sims = greedy_search(y, near, starts, x[part], beam)
                expand_range(y, near, x[part], sims, loose)
                sims[ids[part][:, None] == own[None, :]] = -2.0
                q, node = np.nonzero(sims >= threshold)
                links = np.bincount(q[here[node]], copies[node[here[node]]], len(part)).astype(np.int64)
                out += [(COUNT, int(i), None, int(n), None) for i, n in zip(ids[part], links, strict=True) if n]
                me = np.searchsorted(everyone, ids[part])
                tied = np.flatnonzero(label != np.arange(len(label)))
                label = spanning(len(label), np.concatenate([me[q], tied]), np.concatenate([place[node], label[tied]]))
                far = (sims >= loose) & (home != shard)
                q, node = np.nonzero(far)
                order = np.lexsort((-sims[q, node], home[node], q))
                q, node = q[order], node[order]
                first = np.concatenate([[True], (q[1:] != q[:-1]) | (home[node[1:]] != home[node[:-1]])]) if len(q) else np.zeros(0, bool)
                out += [(ONWARD, int(ids[part[i]]), int(home[j]), int(own[j]), float(sims[i, j])) for i, j in zip(q[first], node[first], strict=True)]
            tied = np.flatnonzero(label != np.arange(len(label)))
            out += [(LINK, int(everyone[i]), int(everyone[label[i]]), None, None) for i in tied]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "u", "v", "w", "cosine"])

    return search


def _visit(graph: DataFrame, visits: DataFrame, threshold: float, visitors: int, beam: int) -> DataFrame:
    """What ``visits`` (shard, node, entry, vector) find in ``graph`` (shard, kind, node, copies, home, near, vector); a task for so many visitors of a shard."""
    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / visitors).cast("long").alias("blocks"))
    asking = visits.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("node"), "blocks").alias("block"), F.lit(VISITOR).alias("kind"), "node", F.lit(0).cast("long").alias("copies"), F.lit(0).cast("long").alias("home"), F.lit(None).cast("array<long>").alias("near"), "entry", "vector")
    there = graph.join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "kind", "node", "copies", "home", "near", F.lit(0).cast("long").alias("entry"), "vector")
    return asking.union(there).groupBy("shard", "block").applyInArrow(_search_shard(threshold, beam), _FOUND)


def link_counts(classes: DataFrame, threshold: float = 0.98, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS, most_rows: int = MOST_ROWS, visitors: int = VISITORS, overlap: int = OVERLAP, beam: int = BEAM) -> tuple[DataFrame, DataFrame]:
    """(counts (node, others), links (u, v)) of classes (node, copies, label, dim, vector), both kept.

    others sums the copies of the other nodes linked with a node; links span its components.
    """
    placed = keep(_placed(classes, fit_clusters(classes, sample, shard_rows), overlap))
    each = placed.select("node", "copies", "vector", F.posexplode("clusters").alias("rank", "cluster"))
    split = each.groupBy("cluster").agg(F.ceil(F.count("*") / most_rows).cast("long").alias("shards"))
    each = each.join(split, "cluster")
    number = lambda s: F.col("cluster") * (1 << 20) + s
    one, two = (number(F.pmod(F.xxhash64(F.lit(k), "node"), "shards")) for k in (1, 2))
    own = F.when(F.col("rank") == 0, F.array_distinct(F.array(one, two))).otherwise(F.array(one))
    members = keep(each.select("node", "copies", "vector", F.when(F.col("rank") == 0, one).alias("home"), F.explode(own).alias("shard")))
    built = keep(members.groupBy("shard").applyInArrow(_build_shard, "shard long, node long, near array<long>"))
    united = built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    places = members.filter("home = shard").select("node", "copies", "home", "vector")
    inside = keep(members.select("shard", "node", "copies", "vector").join(united.join(places.select("node", "home"), "node"), "node").select("shard", F.when(F.col("home") == F.col("shard"), HOME).otherwise(MEMBER).alias("kind"), "node", "copies", "home", "near", "vector"))
    # only lists from other shards name nodes that are not of this one
    named = inside.select("shard", "node").join(built.withColumnRenamed("shard", "origin"), "node").filter("origin <> shard").select("shard", F.explode("near").alias("node"))
    named = named.distinct().join(inside.select("shard", "node"), ["shard", "node"], "left_anti")
    outside = named.join(places, "node").select("shard", F.lit(OUTSIDE).alias("kind"), "node", "copies", "home", F.lit(None).cast("array<long>").alias("near"), "vector")
    graph = keep(inside.union(outside))
    visits = keep(each.select(F.explode(F.sequence(number(F.lit(0)), number(F.col("shards") - 1))).alias("shard"), "node", F.col("node").alias("entry"), "vector"))
    seen, found = visits, []
    while not visits.isEmpty():
        found.append(keep(_visit(graph.join(visits.select("shard").distinct(), "shard", "left_semi") if found else graph, visits, threshold, visitors, beam)))
        onward = found[-1].filter(F.col("kind") == ONWARD).groupBy(F.col("v").alias("shard"), F.col("u").alias("node")).agg(F.max_by("w", "cosine").alias("entry"))
        onward = onward.join(seen.select("shard", "node"), ["shard", "node"], "left_anti")
        visits = keep(onward.join(placed.select("node", "vector"), "node").select("shard", "node", "entry", "vector"))
        seen = seen.union(visits)
    all_found = found[0] if found else classes.sparkSession.createDataFrame([], _FOUND)
    for more in found[1:]:
        all_found = all_found.union(more)
    counts = keep(all_found.filter(F.col("kind") == COUNT).groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("others")))
    links = keep(all_found.filter(F.col("kind") == LINK).select("u", "v").distinct())
    forget(placed, members, built, inside, graph, *found)
    return counts, links


@dataclass
class Classes:
    """Rows keyed to the class of their vector, and the classes (node, copies, rep, label, dim, vector)."""

    rows: DataFrame
    table: DataFrame


def vector_classes(vectors: DataFrame) -> Classes:
    kind = vectors.schema["embedding"].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.withColumn("node", F.xxhash64("label", "embedding"))
    finite = "label is not null and embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    usable = rows.filter("vec_id is not null").filter(finite).filter("exists(embedding, x -> x <> 0)")
    table = usable.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.min_by("label", "vec_id").alias("label"), F.min_by("embedding", "vec_id").alias("vector"))
    return Classes(rows, keep(table.withColumn("dim", F.size("vector"))))


def duplicates(vectors: DataFrame, threshold: float = 0.98, **options: int) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label).

    Rows of equal non-null label are linked when the cosine of their vectors is
    at least ``threshold``; vectors that are null, empty, zero, or hold null or
    non-finite components link with nothing, nor do vectors of other dimensions.
    Rows are vectors of their own even where they repeat a vec_id; rows with a
    null vec_id get no links, a null component, and are kept. Other columns are
    ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    held = vector_classes(vectors)
    counts, links = link_counts(held.table, threshold, **options)
    found = components(spark, links)
    own = held.table.select("node", "rep", "copies").join(counts, "node", "left").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = own.groupBy("component").agg(F.min("rep").alias("component_id"))
    own = own.join(least, "component").select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"), "component_id")
    rows = held.rows.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("node")).alias("node")).join(own, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


def audit_recall(vectors: DataFrame, threshold: float = 0.98, block: int = 2048, most: int = 20_000, **options: int) -> tuple[int, int]:
    """(found, true) links of queries against all, the truth by brute force in blocks: rows whose vec_id is divisible by 100, ``most`` at most."""
    held = vector_classes(vectors)
    asked = held.table.filter("rep % 100 = 0").orderBy(F.xxhash64("node")).limit(most).select("node", "label", "dim", "copies", "vector").toArrow()
    counts, _ = link_counts(held.table, threshold, **options)
    found = {r[0]: r[1] for r in counts.join(held.table.filter("rep % 100 = 0").select("node"), "node", "left_semi").collect()}
    sc, true, got = vectors.sparkSession.sparkContext, 0, 0
    for lo in range(0, asked.num_rows, block):
        part = asked.slice(lo, block)
        shared = sc.broadcast([(n, (name, dim), _unit(np.array([v], float))[0]) for n, name, dim, v in zip(*(part.column(c).to_pylist() for c in ("node", "label", "dim", "vector")), strict=True)])

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = list(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True))
                for key in set(keys):
                    own = [(n, v) for n, name, v in shared.value if name == key]
                    at = [i for i, k in enumerate(keys) if k == key]
                    if own:
                        rows = batch.take(pa.array(at))
                        hit = _matrix(rows.column("vector")) @ np.array([v for _, v in own]).T >= threshold
                        hit &= rows.column("node").to_numpy()[:, None] != np.array([n for n, _ in own])[None, :]
                        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in own], pa.int64()), pa.array((hit * rows.column("copies").to_numpy()[:, None]).sum(axis=0), pa.int64())], ["q", "n"])

        truth = held.table.select("node", "label", "dim", "copies", "vector").mapInArrow(compare, "q long, n long").groupBy("q").agg(F.sum("n")).collect()
        true += sum(n for _, n in truth)
        got += sum(min(n, found.get(q, 0)) for q, n in truth)
        if any(found.get(q, 0) > n for q, n in truth):
            raise AssertionError("a link below the threshold was counted")
    return got, true
