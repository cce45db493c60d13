"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors of a label become one class first, so that a very common vector is compared once. The axes of the second
moment matrix (summed over all vectors on Spark) order the dimensions by energy; classes are range-partitioned by label and leading
coordinate and cut into tiles of at most ``TILE`` rows. Two tiles of a label meet unless the gap between their ranges of leading
coordinates alone keeps the cosine below the threshold. Inside a pair of tiles, products are accumulated over blocks of leading
dimensions; what the rest can add is at most the product of the suffix norms, and pairs that cannot reach the threshold stop
there. Survivors are decided by the cosine of the given vectors in double precision.

Every pair of tiles returns link counts per vector and a spanning forest of its links, not the links: a group of ``n`` copies costs
rows in proportion to ``n`` per pair of tiles. All pairs of a label whose ranges touch are compared, so the work is quadratic
in the largest label; it is split evenly over pairs of tiles.

Defined results: vectors that are null, empty, zero, hold null or non-finite components or have no label link with nothing; so do
vectors of different length. ``vec_id`` identifies a vector: rows that repeat it count as other vectors linked to it if
equal, and share its component. Rows without an id link with nothing either; their component is null and they are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import read_table, save
from .components import connected_components

TILE = 512  # vectors of a tile
BLOCK = 16  # dimensions accumulated between two looks at the bound
LEAD = 4  # leading coordinates whose ranges tell tiles apart
SLACK = 1e-9  # rounding of rotated products


def _usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each length of ``vectors(dim, embedding)`` the orthogonal axes of its unit vectors, most energy first.

    Second moments are summed in each task and then by cell of the matrix; the driver receives ``dim ** 2`` numbers a length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                u = _units(_matrix(batch.column("embedding").filter(pa.array(dims == d))))
                sums[d] = sums.get(d, 0) + u.T @ u
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d)), pa.array(np.arange(m.size)), pa.array(m.ravel())], names=["dim", "cell", "x"])

    cells = vectors.select(F.col("dim").cast("long"), "embedding").mapInArrow(run, "dim long, cell long, x double")
    got = cells.groupBy("dim", "cell").agg(F.sum("x").alias("x")).toPandas()
    out = {}
    for d, part in got.groupby("dim"):
        moments = part.sort_values("cell")["x"].to_numpy().reshape(int(d), int(d))
        out[int(d)] = np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1].copy()
    return out


def _tiles(classes: DataFrame, rotations: dict[int, np.ndarray]) -> DataFrame:
    """``classes`` with leading coordinates ``l0..`` and ``tile``, rows of a tile adjacent in label and leading coordinate."""
    names = [f"l{k}" for k in range(LEAD)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            lead = np.zeros((batch.num_rows, LEAD))
            for d in np.unique(dims):
                z = _units(_matrix(batch.column("embedding").filter(pa.array(dims == d)))) @ rotations[int(d)][:, :LEAD]
                lead[np.ix_(dims == d, range(z.shape[1]))] = z
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, lead.T.copy())], names=[*batch.schema.names, *names])

    schema = classes.select("*", *[F.lit(0.0).alias(n) for n in names]).schema
    rows = classes.mapInArrow(run, schema)
    rows = rows.repartitionByRange("dim", "label", "l0").sortWithinPartitions("dim", "label", "l0", "rep")
    return rows.withColumn("tile", F.floor(F.monotonically_increasing_id() / TILE).cast("long"))


def _tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """Pairs of tiles of one label whose ranges of leading coordinates are near enough for the threshold."""
    ranges = [f(f"l{k}").alias(f"{n}{k}") for k in range(LEAD) for f, n in ((F.min, "lo"), (F.max, "hi"))]
    a = tiles.groupBy("dim", "label", "tile").agg(*ranges)
    b = a.select(*[F.col(c).alias(f"b_{c}") for c in a.columns])
    gaps = [
        F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"b_hi{k}"), F.col(f"b_lo{k}") - F.col(f"hi{k}")) for k in range(LEAD)
    ]
    near = reduce(lambda x, y: x + y, [g * g for g in gaps]) <= 2 - 2 * threshold + SLACK
    same = (F.col("dim") == F.col("b_dim")) & (F.col("label") == F.col("b_label")) & (F.col("tile") <= F.col("b_tile"))
    return a.join(b, same & near).select("dim", "label", "tile", F.col("b_tile").alias("other"))


def linked_pairs(a: np.ndarray, b: np.ndarray, rotation: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose cosine reaches the threshold (of one tile with itself: each pair once)."""
    ua, ub = _units(a), _units(b)
    za, zb = ua @ rotation, ub @ rotation
    rest_a = np.sqrt(np.maximum(0, np.cumsum((za * za)[:, ::-1], axis=1)[:, ::-1]))
    rest_b = np.sqrt(np.maximum(0, np.cumsum((zb * zb)[:, ::-1], axis=1)[:, ::-1]))
    dims = za.shape[1]
    first = min(BLOCK, dims)
    product = za[:, :first] @ zb[:, :first].T
    bound = product.copy() if first == dims else product + rest_a[:, first, None] * rest_b[None, :, first]
    alive = bound >= threshold - SLACK
    if same:
        alive &= np.triu(np.ones(alive.shape, bool), 1)
    i, j = np.nonzero(alive)
    left = product[i, j]
    for start in range(first, dims, BLOCK):
        if not len(i):
            break
        stop = min(start + BLOCK, dims)
        left = left + np.concatenate([np.einsum("ij,ij->i", za[i[k : k + 65536], start:stop], zb[j[k : k + 65536], start:stop]) for k in range(0, len(i), 65536)])
        bound = left if stop == dims else left + rest_a[i, stop] * rest_b[j, stop]
        keep = bound >= threshold - SLACK
        i, j, left = i[keep], j[keep], left[keep]
    exact = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", ua[i[k : k + 65536]], ub[j[k : k + 65536]]) for k in range(0, len(i), 65536))])
    keep = exact >= threshold
    return i[keep], j[keep]


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` nodes the smallest node reachable over the links ``u, v``."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[u], root[v])
        after = root.copy()
        np.minimum.at(after, u, least)
        np.minimum.at(after, v, least)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _compare(rotations: dict[int, np.ndarray], threshold: float):
    def run(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        second = table.column("second").to_numpy()
        rep, copies = table.column("rep").to_numpy(), table.column("copies").to_numpy()
        x = _matrix(table.column("embedding"))
        same = not second.any()
        in_a = np.flatnonzero(~second)
        in_b = in_a if same else np.flatnonzero(second)
        i, j = linked_pairs(x[in_a], x[in_b], rotations[dim], threshold, same)
        i, j = in_a[i], in_b[j]
        counts = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
        root = forest(i, j, len(x))
        hit = np.flatnonzero(counts)
        return pa.table({"rep": rep[hit], "root": rep[root[hit]], "n": counts[hit].astype(np.int64)})

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``."""
    rows = vectors.select("vec_id", "embedding", "label").withColumn("_ok", _usable(F.col("embedding")))
    key = [F.xxhash64(F.lit(s), "label", "embedding").alias(f"_h{s}") for s in (1, 2)]
    usable = rows.filter("_ok").select("vec_id", "label", "embedding", *key)
    grouped = usable.groupBy("label", "_h1", "_h2").agg(
        F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")
    )
    classes = save(grouped.withColumn("dim", F.size("embedding").cast("long")), "classes")
    rotations = axes(classes)
    tiles = save(_tiles(classes.select("rep", "label", "dim", "copies", "embedding"), rotations), "tiles")
    pairs = save(_tile_pairs(tiles, threshold), "tile-pairs")
    here = tiles.select("rep", "dim", "copies", "embedding", F.col("tile").alias("_t"), F.col("label").alias("_l"))
    of = lambda side: (F.col("_t") == F.col(side)) & (F.col("_l") == F.col("label")) & (F.col("dim") == F.col("_d"))
    keys = pairs.withColumnRenamed("dim", "_d")
    first = keys.join(here, of("tile")).withColumn("second", F.lit(False))
    second = keys.filter("tile < other").join(here, of("other")).withColumn("second", F.lit(True))
    work = first.unionByName(second).drop("_t", "_l")
    met = work.groupBy("label", "_d", "tile", "other").applyInArrow(_compare(rotations, threshold), "rep long, root long, n long")
    met = save(met, "links")
    counts = met.groupBy("rep").agg(F.sum("n").alias("_n"))
    parts = connected_components(met.filter("rep <> root"), "rep", "root")
    known = classes.drop("embedding", "dim").join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(
        F.col("label").alias("_l"), F.col("_h1").alias("_k1"), F.col("_h2").alias("_k2"),
        (F.coalesce("_n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"),
    )
    of_class = (F.col("label") == F.col("_l")) & (F.col("_h1") == F.col("_k1")) & (F.col("_h2") == F.col("_k2"))
    linked = usable.drop("embedding").join(known, of_class).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~F.col("_ok")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of ``embeddings`` within their labels at a cosine of 0.98."""
    return near_vectors(read_table(spark, sf_dir, "embeddings"), 0.98)
