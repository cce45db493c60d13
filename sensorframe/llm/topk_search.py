"""Exact top-k search by integer inner product: MaxScore over shards.

A term is a dimension with a sign; the posting list of a term holds the candidates of a shard whose component has that sign, with the
component as impact. A query's list for a dimension is that of its own sign there: only these postings raise a score. What a list can
add at most is the query's component times the list's largest impact. Terms are ordered by these bounds; the smallest of them, which
together stay below the k-th best score so far, are non-essential: a candidate found in none but their lists cannot enter the result.
The essential lists are traversed for all queries of a block at once; every candidate whose sum and the bounds of the terms left still
reach the k-th score is probed in the others, largest bound first, a few lists at a time, and dropped as soon as it cannot compete.
While many candidates compete, a probe reads its lists whole, later only the places of the competitors.

Rows of a written table are dealt to shards and blocks of queries by a hash of their place. Every block meets every shard, grouped by
(block, shard); each pair returns the best rows of its shard, and a group limit merges the shards. No group is larger than a block and a
shard. As the queries are a share of the rows, work grows with the square of the table, and nothing else does.

Defined results: components become ``floor(scale * x)``; vectors that are null or hold null or non-finite components take no part, rows
without a ``vec_id`` neither. Components and scores beyond the range of a long stop at its limits. Vectors of unlike length do not meet;
an empty vector scores 0 with other empty ones. Rows are told apart by their place in the table, so a row with the same ``vec_id`` as
the query is a candidate, and a repeated query id asks once a row. Equal scores are ordered by ``vec_id``. Columns beyond those
named are not read. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read_table, save

SCALE = 256
QUERY_ROWS = 2048  # queries of a block
SHARD_ROWS = (2048, 65536)  # least and most rows of a shard
TILES = (64, 2048)  # candidates looked at between two updates of the k-th scores: at first, and at most
PROBE = 8  # lists probed at a time
SPARSE = 16  # below one competitor in so many, a probe reads single places
EXACT = float(1 << 53)  # doubles are exact for whole numbers up to here


def whole(v: Column, scale: int) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(v: Column) -> Column:
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


class Best:
    """The ``k`` best rows of each query so far, best first: score, id and place; ``floor`` is what a candidate must reach."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = np.zeros(0, np.int64)
        self.score = np.zeros(0)
        self.id = np.zeros(0, np.int64)
        self.floor = np.full(queries, -np.inf)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        query, score, ids = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, query))
        query, score, ids = query[order], score[order], ids[order]
        start = np.searchsorted(query, query)
        keep = np.arange(len(query)) - start < self.k
        self.query, self.score, self.id = query[keep], score[keep], ids[keep]
        full = np.flatnonzero(np.arange(len(query))[keep] - start[keep] == self.k - 1)
        self.floor[self.query[full]] = self.score[full]


def max_score(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> Best:
    """The ``k`` best candidates of each query; ``same[i]`` is the place of query ``i`` among the candidates, or -1."""
    best = Best(len(queries), k)
    n, dim = queries.shape
    # Largest impact of each list: components above and below zero.
    above = np.maximum(candidates, 0).max(axis=0, initial=0)
    below = np.maximum(-candidates, 0).max(axis=0, initial=0)
    bounds = np.where(queries > 0, queries * above, -queries * below)
    order = np.argsort(bounds, axis=1, kind="stable")  # smallest bound first
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(dim), order.shape), axis=1)
    # upto[:, m]: what the m smallest lists add at most.
    upto = np.zeros((n, dim + 1))
    np.cumsum(np.take_along_axis(bounds, order, axis=1), axis=1, out=upto[:, 1:])
    start, step = 0, TILES[0]
    while start < len(candidates):
        tile = candidates[start : start + step]
        # Non-essential: as many of the smallest lists as stay below the k-th score together.
        left = np.maximum((upto < best.floor[:, None]).sum(axis=1) - 1, 0)
        sums = np.where(place >= left[:, None], queries, 0) @ tile.T
        own = (same >= start) & (same < start + len(tile))
        sums[np.flatnonzero(own), same[own] - start] = -np.inf
        i = j = None
        while True:
            rest = np.take_along_axis(upto, left[:, None], axis=1)[:, 0]
            if i is None:
                alive = sums + rest[:, None] >= best.floor[:, None]
                few = np.count_nonzero(alive) * SPARSE <= alive.size
                if few or not left.any():
                    i, j = np.nonzero(alive)
                    found = sums[i, j]
            else:
                keep = found + rest[i] >= best.floor[i]
                i, j, found = i[keep], j[keep], found[keep]
            if not left.any():
                break
            after = np.maximum(left - PROBE, 0)
            if i is None:
                sums += np.where((place >= after[:, None]) & (place < left[:, None]), queries, 0) @ tile.T
            else:
                for m in range(PROBE):
                    at = left[i] - 1 - m
                    more = at >= 0
                    d = order[i[more], at[more]]
                    found[more] += queries[i[more], d] * tile[j[more], d]
            left = after
        real = found > -np.inf
        best.add(i[real], found[real], ids[start : start + len(tile)][j[real]])
        start, step = start + len(tile), min(4 * step, TILES[1])
    return best


def in_whole_numbers(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, same: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query, id, score)`` of the ``k`` best, for components too large for doubles; scores stop at the limits of a long."""
    out = []
    wide = candidates.astype(object)
    for i, q in enumerate(queries.astype(object)):
        scores = [max(-(1 << 63), min((1 << 63) - 1, int(x))) for x in wide @ q]
        order = sorted((j for j in range(len(scores)) if j != same[i]), key=lambda j: (-scores[j], ids[j]))
        out += [(i, int(ids[j]), scores[j]) for j in order[:k]]
    return out


def _search(k: int):
    out = pa.schema([("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key: tuple[pa.Scalar, ...], asked: pa.Table, held: pa.Table) -> pa.Table:
        if not asked.num_rows or not held.num_rows:
            return out.empty_table()
        dim = key[2].as_py()
        queries, candidates = _matrix(asked.column("v"), dim), _matrix(held.column("w"), dim)
        names, asks = asked.column("vec_id").to_numpy(), asked.column("row").to_numpy()
        ids, rows = held.column("id").to_numpy(), held.column("at").to_numpy()
        # Doubles are exact for products of rows below this size; the few others are multiplied in whole numbers.
        size = int((EXACT / max(dim, 1)) ** 0.5)
        small = lambda x: ((x < size) & (x > -size)).all(axis=1)
        plain, light = small(queries), small(candidates)
        pieces = []
        for some, part in ((plain, light), (plain, ~light), (~plain, np.ones(len(ids), bool))):
            q, c = np.flatnonzero(some), np.flatnonzero(part)
            if not len(q) or not len(c):
                continue
            c = c[np.argsort(rows[c])]
            at = np.minimum(np.searchsorted(rows[c], asks[q]), len(c) - 1)
            same = np.where(rows[c][at] == asks[q], at, -1)
            if part is light:
                best = max_score(queries[q].astype(np.float64), candidates[c].astype(np.float64), ids[c], same, k)
                found, vec, score = best.query, best.id, best.score.astype(np.int64)
            else:
                rows_found = in_whole_numbers(queries[q], candidates[c], ids[c], same, k)
                found, vec, score = (np.array([r[n] for r in rows_found], np.int64) for n in range(3))
            pieces.append(pa.table([asks[q][found], names[q][found], vec, score], schema=out))
        return pa.concat_tables([out.empty_table(), *pieces])

    return run


def top_k(vectors: DataFrame, asked: Column, k: int = 5, scale: int = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for every row of ``vectors(vec_id, embedding)`` where ``asked`` holds."""
    spark = vectors.sparkSession
    picked = vectors.select("vec_id", asked.alias("_asked"), F.col("embedding").alias("v")).filter("vec_id is not null").filter(usable(F.col("v")))
    table = save(
        picked.select("vec_id", F.coalesce("_asked", F.lit(False)).alias("_asked"), whole(F.col("v"), scale).alias("v"))
        .withColumn("dim", F.size("v"))
        .withColumn("row", F.monotonically_increasing_id()),
        "vectors",
    )
    counts = table.agg(F.count(F.lit(1)).alias("n"), F.count_if("_asked").alias("q")).first()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = -(-counts["n"] // min(max(-(-counts["n"] // (4 * partitions)), SHARD_ROWS[0]), SHARD_ROWS[1])) or 1
    blocks = -(-counts["q"] // QUERY_ROWS) or 1
    # Rows are dealt by a hash of their place: every shard and block gets its share of hot and of equal vectors.
    shard = F.pmod(F.xxhash64("row"), F.lit(shards))
    block = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")).alias(name)
    asks = table.filter("_asked").select("row", "vec_id", "v", block.alias("block"), every(shards, "shard"), "dim")
    # New names: Spark prunes the columns of a cogrouped frame that shares them with the other one.
    held = table.select(F.col("row").alias("at"), F.col("vec_id").alias("id"), F.col("v").alias("w"), every(blocks, "b"), shard.alias("s"), F.col("dim").alias("d"))
    found = asks.groupBy("block", "shard", "dim").cogroup(held.groupBy("b", "s", "d"))
    found = found.applyInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op11_max_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of ``embeddings`` for every row whose id is divisible by 50."""
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score, q.r
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
