"""Connected components of a link table, by contraction; no component is ever gathered in a task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join


def ordered(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, root (smallest node of its component) for every node of links(a long, b long).

    In every round each root hooks onto the smallest root that a link joins it with if that is smaller;
    chains of hooks are shortened by pointer jumping; nodes and links move to their new roots, and links
    inside a root go. Minima are aggregated before they are shuffled, and roots that hold a large share of the
    nodes or links are split over tasks. Rounds grow with the logarithm of
    the largest component. Null ends and self links are ignored.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    given = links.count()
    nodes = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).distinct()
    edges = scratch.write(ordered(links), f"{name}-edges0", given)
    size = edges.count()
    # a node is an end of a link, or of a link to itself
    table = scratch.write(nodes.withColumn("root", F.col("node")), f"{name}-table0", 2 * given)
    known, step = table.count(), 0
    while size:
        step += 1
        # b is the larger root of each link
        hooks = scratch.write(edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("to")), f"{name}-hooks{step}-0", size)
        jump = 0
        while True:
            jump += 1
            onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("further"))
            jumped = spread_join(hooks, onward, "to", rows=size).select("root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            jumped = scratch.write(jumped, f"{name}-hooks{step}-{jump}", size)
            scratch.drop(f"{name}-hooks{step}-{jump - 1}")
            hooks = jumped.select("root", "to")
            if not jumped.where("moved").limit(1).count():
                break
        moved_nodes = spread_join(table, hooks, "root", rows=known).select("node", F.coalesce("to", "root").alias("root"))
        table = scratch.write(moved_nodes, f"{name}-table{step}", known)
        moved = hooks.select(F.col("root").alias("a"), F.col("to").alias("a2"))
        moved_b = hooks.select(F.col("root").alias("b"), F.col("to").alias("b2"))
        far = spread_join(spread_join(edges, moved, "a", rows=size), moved_b, "b", "inner", rows=size)
        edges = scratch.write(ordered(far.select(F.coalesce("a2", "a").alias("a"), F.col("b2").alias("b"))), f"{name}-edges{step}", size)
        size = edges.count()
        scratch.drop(f"{name}-edges{step - 1}", f"{name}-table{step - 1}", f"{name}-hooks{step}-{jump}")
    return table
