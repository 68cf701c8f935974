"""Connected components of a graph that fits no single task.

Alternates two rewrites of the edge list (each node points to the least node it knows) until
nothing changes. Every step is a grouped minimum, combined before the shuffle, and a join; no
neighbourhood is gathered in one row. Each round is cut with a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, component) of every node with an edge to another; component is its least node.

    Null ends and loops are left out. No edges give an empty table. Raises if `rounds` (far more
    than the logarithm of any graph needs) don't suffice.
    """
    e = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    last = None
    for _ in range(rounds):
        before, e = e, materialize(_small_star(_large_star(e)), "star")
        discard(before)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v"))).distinct()
        last = now
    raise RuntimeError("the components did not settle")
