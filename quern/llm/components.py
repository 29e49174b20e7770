"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.stage_table import drop_stage_table, stage_table


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` of any ordered type -> ``(node, component)`` for every node of an edge.

    The component is the smallest node that can be reached. Each round attaches
    larger neighbours to the smallest node around (large star), then does so for
    the smaller neighbours (small star), until nothing changes; the number of
    rounds grows with the logarithm of the longest chain. A hub appears in one
    partial aggregation and in one equi-join whose large side the adaptive
    planner splits, never in a collected group. Nulls and loops are ignored;
    no edges give no rows.
    """
    now = stage_table(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct(),
        "edges",
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stage_table(large, "edges")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        after = stage_table(small, "edges")
        drop_stage_table(large)
        drop_stage_table(now)
        before, mark, now = mark, _mark(after), after
        if mark == before:
            break
    roots = now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and an order-free sum of their hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
