"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, and its result is a table in the shared folder, so a lost executor repeats one
step at most and no component or edge list ever reaches the driver. A node with very many neighbours is met by a map-side
minimum and by a shuffled join of two plain scans, whose skewed partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return row.n, row.x


def _with_least(both: DataFrame, least: DataFrame) -> DataFrame:
    return both.join(least.withColumnRenamed("a", "la"), F.col("a") == F.col("la")).drop("la")


def components(edges: DataFrame, folder: str, max_steps: int = 60) -> DataFrame:
    """Edges (a, b) to (node, root) for every node that has an edge; root is the component's least node.

    Null ends, loops and repeated edges are ignored. An empty table gives an empty result.
    """
    kind = edges.schema["a"].dataType
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = common.table(e, f"{folder}/edges")
    state = _state(e)
    for step in range(max_steps if state[0] else 0):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{folder}/least-{step}-0")
        large = _with_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = common.table(large, f"{folder}/large-{step}")
        least = common.table(large.groupBy("a").agg(F.min("b").alias("m")), f"{folder}/least-{step}-1")
        moved = _with_least(large, least).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = common.table(small, f"{folder}/small-{step}")
        before, state = state, _state(e)
        if state == before:
            break
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_steps} steps")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots).select(F.col("node").cast(kind), F.col("root").cast(kind))
