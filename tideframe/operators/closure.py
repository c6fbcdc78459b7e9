"""What reaches each node of a graph along its edges, by joins until nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideframe.sources.files import drop_table, settled


def propagate(edges: DataFrame, seeds: DataFrame, combine: dict[str, Callable[[Column], Column]], stop: DataFrame | None = None, most: int = 10_000) -> DataFrame:
    """(node, values): for each node what the seeds that reach it come to.

    ``edges`` lead from ``source`` to ``derived``, ``seeds`` have ``node`` and the
    columns of ``combine``, an aggregate for each that takes a value any number of
    times (min, max, bit_and), so that diamonds and circles come out right. Nodes
    of ``stop`` take nothing from others, though they may be seeds. A round joins
    only what the last one has changed; there are as many as the longest path has
    edges, and states lie in the work folder between them. Joins are told to sort:
    each broadcast would go through the driver, in every round.
    """
    agg = [f(F.col(c)).alias(c) for c, f in combine.items()]
    values = list(combine)
    links = edges.select("source", "derived").filter("source is not null and derived is not null").distinct()
    if stop is not None:
        links = links.join(stop.select(F.col("node").alias("derived")).distinct().hint("merge"), "derived", "left_anti")
    links = settled(links)
    state = settled(seeds.filter("node is not null").groupBy("node").agg(*agg))
    frontier, old = state, [state]
    for _ in range(most):
        carried = links.join(frontier.withColumnRenamed("node", "source").hint("merge"), "source").groupBy(F.col("derived").alias("node")).agg(*agg)
        held = state.select("node", F.struct(*values).alias("__held"))
        # the state of nodes that are reached now, before and after
        both = carried.join(held.hint("merge"), "node", "left").select("node", F.struct(*values).alias("__new"), "__held")
        merged = both.select("node", "__held", F.explode(F.array_compact(F.array("__new", "__held"))).alias("x")).select("node", "__held", "x.*").groupBy("node", "__held").agg(*agg)
        changed = settled(merged.filter(~F.struct(*values).eqNullSafe(F.col("__held"))).drop("__held"))
        if changed.isEmpty():
            drop_table(changed, links, *(t for t in old if t is not state))
            return state
        after = settled(state.join(changed.select("node").hint("merge"), "node", "left_anti").unionByName(changed))
        drop_table(*{id(t): t for t in (state, frontier)}.values())
        state, frontier, old = after, changed, [after, changed]
    raise RuntimeError(f"no end after {most} rounds")
