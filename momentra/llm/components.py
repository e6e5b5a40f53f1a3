"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from momentra.llm.common import cut, let_go, packed


def _stars(pairs: DataFrame, small: bool, n: int) -> DataFrame:
    """One star round over n pairs (a, b) with a < b: every node's larger (small: no larger) neighbours move to its least one."""
    if small:  # b's smaller neighbours and b itself move to the least of them
        near = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
    else:
        near = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = near.join(least, "u")
    if small:
        moved = joined.select(F.col("v").alias("x"), "m").unionAll(least.select(F.col("u").alias("x"), "m"))
    else:
        moved = joined.where("v > u").select(F.col("v").alias("x"), "m")
    found = packed(moved.where("x != m").select(F.least("x", "m").alias("a"), F.greatest("x", "m").alias("b")), n)
    return packed(found.distinct(), n)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, component): component is the least node reachable.

    Nodes without an edge do not appear; loops, repeats and null ends are ignored; an empty table gives an empty one.
    Every round is cut through the shared folder, so a lost executor repeats one round only. A hub's rows are
    partially aggregated before they are shuffled, and its join is one that adaptive execution can split. Rounds over few
    pairs run as few tasks, and leave no files behind.
    """
    pairs = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    sign = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign or not now[0]:
            break
        sign = now
        n = now[0]
        pairs = packed(pairs, n)
        pairs = cut(_stars(_stars(pairs, False, n), True, n))
        let_go(pairs.sparkSession)
    stars = pairs.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return stars.unionAll(pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
