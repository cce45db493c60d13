"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are a minimum per node (combined before the shuffle) and a join, so that a node with very
many neighbours is never gathered in one task: adaptive execution splits its side of the join. Every
round is written to the shared folder and its input deleted. Nothing but two counters reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_saved, save


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = both.filter("v > u").join(least, "u")
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # Every edge points from the larger node u to the smaller node v.
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """``(node, component_id)`` for every node that has an edge to another node.

    ``component_id`` is the smallest node reachable. Null ends, loops, repeated and reversed edges are
    allowed and change nothing; an empty edge table gives an empty result. The number of rounds grows with the
    logarithm of the longest chain; ``max_rounds`` only guards against an endless loop and raises when reached.
    """
    ends = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    now = save(ends.filter("_a is not null and _b is not null and u > v").select("u", "v").distinct(), "edges")
    before = _fingerprint(now)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        after = save(_small_star(_large_star(now)), "edges")
        drop_saved(now)
        now, mark = after, _fingerprint(after)
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component_id")).unionByName(
        roots.select("node", F.col("node").alias("component_id"))
    )
