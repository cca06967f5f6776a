"""Connected components of a link table, by alternating stars on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hedgewise.plans import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v): neighbours of a node move to the smallest of node and neighbours."""
    both = edges.where("u != v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = both.join(lowest, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.select("u", F.col("m").alias("v"))
        )
    return moved.where("u != v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (u, v); a component's name is its smallest node.

    The edge table shrinks towards stars around the smallest nodes; it is written to shared storage after each round, so
    no lineage grows and no task holds a component. Ends when a round changes nothing.
    """
    now, before = written(edges.select("u", "v").where("u != v"), "edges"), None
    while before != (mark := _mark(now)):
        before = mark
        now = written(_star(_star(now, large=True), large=False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
