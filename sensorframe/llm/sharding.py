"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring; a key belongs to the arc that its hash falls into and walks clockwise,
arc by arc, past shards that are full. Only counts per arc decide who overflows where, so the walk is done on one row per
arc (their number is a parameter), and the documents then read their shard from a table of segments
``(arc, from, to) -> shard``. There are at most arcs + shards segments: each either ends an arc's queue or fills a shard.
The documents are shuffled once, in narrow rows, and no shard is ever a group: slots follow from the segments.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read_table, text_of

GRID = 1 << 14  # places on the ring
VNODES = 64  # points of each shard


def ring(shards: int, vnodes: int = VNODES, grid: int = GRID) -> list[tuple[int, int]]:
    """``(place, shard)`` of all points in ring order. A taken place moves a point on to the next free one."""
    if shards * vnodes > grid:
        raise ValueError("more points than places on the ring")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = int.from_bytes(hashlib.md5(f"{shard}/{v}".encode()).digest()[:8], "big") % grid
            while at in taken:
                at = (at + 1) % grid
            taken[at] = shard
    return sorted(taken.items())


def arc_of(key_hash: Column, points: list[tuple[int, int]], grid: int = GRID) -> Column:
    """Number of the first point at or after the place of a hash, clockwise."""
    numbers, k = [], 0
    for place in range(grid):
        while k < len(points) and points[k][0] < place:
            k += 1
        numbers.append(str(k % len(points)))
    table = F.split(F.lit(",".join(numbers)), ",").cast("array<int>")  # folded to one literal
    return F.get(table, F.pmod(key_hash, F.lit(grid)).cast("int"))


def capacities(n: int, shards: int, epsilon: float = 0.0) -> list[int]:
    """Rows each shard may hold: ``ceil((1 + epsilon) n / shards)``; with 0 exactly all rows, at most one apart."""
    if epsilon > 0:
        return [math.ceil((1 + epsilon) * n / shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(counts: dict[int, int], points: list[tuple[int, int]], free: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Segments ``(arc, from, to, shard, slot)`` of each arc's queue; slots of a shard are gapless from 0.

    All arcs offer their first rows to their own shard, then all rests go one arc on, and so on; full shards are passed.
    """
    rest = {arc: n for arc, n in counts.items() if n}
    done = dict.fromkeys(rest, 0)
    used = [0] * len(free)
    out = []
    for step in range(len(points)):
        for arc in sorted(rest):
            shard = points[(arc + step) % len(points)][1]
            take = min(rest[arc], free[shard] - used[shard])
            if take > 0:
                out.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                used[shard] += take
                done[arc] += take
                rest[arc] -= take
        rest = {arc: n for arc, n in rest.items() if n}
        if not rest:
            return out
    raise ValueError("the shards cannot hold all rows")


def assign(rows: DataFrame, key: str, shards: int, order: list[str], vnodes: int = VNODES, epsilon: float = 0.0) -> DataFrame:
    """Adds ``shard`` and ``slot`` to every row, by key.

    ``order`` breaks ties between rows of one key. With ``epsilon`` 0 the counts of shards differ by one at most; a larger
    one leaves more keys on their own arc, so that a new shard moves fewer rows. Null keys and repeated rows are keys like
    others: what exceeds a full shard walks on. An empty frame gives an empty frame.
    """
    points = ring(shards, vnodes)
    placed = rows.withColumn("_hash", F.xxhash64(key)).withColumn("_arc", arc_of(F.col("_hash"), points))
    counts = {r["_arc"]: r["n"] for r in placed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per arc
    segments = walk(counts, points, capacities(sum(counts.values()), shards, epsilon))
    spark = rows.sparkSession
    table = spark.createDataFrame(segments, "_on int, _from long, _to long, shard int, _slot long")
    turn = Window.partitionBy("_arc").orderBy("_hash", key, *order)
    queued = placed.withColumn("_turn", F.row_number().over(turn) - 1)
    here = (F.col("_arc") == F.col("_on")) & (F.col("_turn") >= F.col("_from")) & (F.col("_turn") < F.col("_to"))
    joined = queued.join(F.broadcast(table), here)  # at most shards * (vnodes + 1) rows
    return joined.withColumn("slot", F.col("_slot") + F.col("_turn") - F.col("_from")).drop("_hash", "_arc", "_turn", "_on", "_from", "_to", "_slot")


def op6_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 16 shards under the law ``rows``: counts at most one apart."""
    docs = read_table(spark, sf_dir, "documents")
    text = text_of("text")
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = assign(rows, "doc_id", 16, ["size", "text_crc32"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
