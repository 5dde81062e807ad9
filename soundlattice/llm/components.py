"""Connected components of an edge table by alternating stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from soundlattice.llm.shared import materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v): root is the smallest node that it reaches.

    A large star ties every greater neighbour of a node to the least neighbour; a small star ties a node and its
    lesser neighbours to the least of them.  Rounds grow with the logarithm of a component's width.  A node with
    very many neighbours is met by a minimum that is combined before the shuffle and by a join of two written
    tables, which adaptive execution splits.  State between rounds lies in the shared folder.
    """
    once = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    once = materialize(once, "edges")
    state = _state(once)
    while state[0]:
        both = once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "edges")
        lesser = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(lesser, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        once = materialize(small, "edges")
        before, state = state, _state(once)
        if before == state:
            break
    roots = once.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(once.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
