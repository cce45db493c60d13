"""Three exact percentile flavours: discrete, rank index and interpolated.

Values are ranked with a sorted window and the wanted ranks are picked, which spills and was faster than
the percentile aggregates for few and for many groups. Large frames count equal values first and rank
those with an ordered scan, which splits heavy groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.ordered import Scan, ordered_scan, scan_cells
from ..plans.skew import is_large, same_keys, split_cells


def _totals(df: DataFrame, counted: DataFrame, keys: Sequence[str], weight: Column, name: str) -> DataFrame:
    """Add the number of rows of each row's group to ``counted``."""
    if not keys:
        return counted.withColumn(name, df.select(F.sum(weight)).scalar())
    total = df.groupBy(*[F.col(k).alias(f"_t_{k}") for k in keys]).agg(F.sum(weight).alias(name))
    joined = counted.join(total, same_keys([F.col(k) for k in keys], [F.col(f"_t_{k}") for k in keys]))
    return joined.drop(*[f"_t_{k}" for k in keys])


def with_rank(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cell_rows: int | None = None
) -> DataFrame:
    """Add ``_rn`` (1-based rank by ``order``) and ``_n`` (group size)."""
    cells = split_cells(df, keys, order, cell_rows)
    if not cells.columns:
        window = Window.partitionBy(*(keys or [F.lit(0)]))
        return cells.dealt(keys).select(
            "*",
            F.row_number().over(window.orderBy(*order)).alias("_rn"),
            F.count(F.lit(1)).over(window).alias("_n"),
        )
    ranked = scan_cells(cells, keys, order, [Scan("_rn", "count")]).plain()
    return _totals(df, ranked, keys, F.lit(1), "_n")


def rank_index(n: Column, p: float) -> Column:
    return F.floor(n * F.lit(p) - F.lit(0.5)).cast("long")


def pctl_rank(
    df: DataFrame, keys: Sequence[str], col: str, ps: Mapping[str, float], cell_rows: int | None = None
) -> DataFrame:
    """The value at index ``int(n*p - 0.5)`` of each group, 0 for index 0; nulls rank first and count as 0."""
    counted = weighted_ranks(df.select(*keys, col).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_m")), keys, col, cell_rows)
    return counted.groupBy(*keys).agg(*[pick_weighted(F.col(col), p).alias(n) for n, p in ps.items()])


def weighted_ranks(counts: DataFrame, keys: Sequence[str], col: str, cell_rows: int | None = None) -> DataFrame:
    """``counts(keys, col, _m, ...)``, one row a value, with the rank range ``(_before, _before + _m]`` of the value in a group of ``_n`` rows.

    A value that most rows share is one row; the scan over many distinct values is cut into cells.
    """
    given = counts.withColumn("_given", F.col(col).isNotNull().cast("int"))
    scanned = ordered_scan(given, keys, ["_given", col], [Scan("_before", "sum", F.col("_m"), before=True)], cell_rows)
    return _totals(counts, scanned.na.fill(0, ["_before"]).drop("_given"), keys, F.col("_m"), "_n")


def pick_weighted(value: Column, p: float) -> Column:
    """Aggregate over :func:`weighted_ranks` rows: the value at index ``int(n*p - 0.5)``, 0 for index 0."""
    rank = rank_index(F.col("_n"), p)
    return F.coalesce(F.max(F.when((F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_m")), value)), F.lit(0))


def _cumulative(df: DataFrame, keys: Sequence[str], col: str, cell_rows: int | None) -> DataFrame:
    """Distinct values with the rank range ``(_before, _before + _m]`` they cover in a group of ``_n``."""
    values = df.filter(F.col(col).isNotNull()).select(*keys, col)
    counts = values.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_m"))
    scanned = ordered_scan(counts, keys, [col], [Scan("_before", "sum", F.col("_m"), before=True)], cell_rows)
    return _totals(counts, scanned.na.fill(0, ["_before"]), keys, F.col("_m"), "_n")


def _value_at(col: str, rank: Column) -> Column:
    inside = (F.col("_before") < rank) & (rank <= F.col("_before") + F.col("_m"))
    return F.max(F.when(inside, F.col(col)))


def disc_rank(p: float) -> Column:
    return F.greatest(F.ceil(F.col("_n") * F.lit(p)), F.lit(1))


def pick_disc(value: Column, p: float) -> Column:
    """Aggregate over :func:`with_rank` rows: the discrete percentile."""
    return F.max(F.when(F.col("_rn") == disc_rank(p), value))


def pctl_disc(
    df: DataFrame, keys: Sequence[str], col: str, ps: Mapping[str, float], cell_rows: int | None = None
) -> DataFrame:
    """Smallest value whose cumulative share reaches ``p``."""
    if cell_rows is None and not is_large(df):
        ranked = with_rank(df.filter(F.col(col).isNotNull()).select(*keys, col), keys, [col])
        return ranked.groupBy(*keys).agg(*[pick_disc(F.col(col), p).alias(n) for n, p in ps.items()])
    cumulative = _cumulative(df, keys, col, cell_rows)
    return cumulative.groupBy(*keys).agg(*[_value_at(col, disc_rank(p)).alias(n) for n, p in ps.items()])


def quantiles(
    df: DataFrame, keys: Sequence[str], col: str, qs: Mapping[str, float], cell_rows: int | None = None
) -> DataFrame:
    """Linear interpolation between neighbouring ranks."""
    if not keys and cell_rows is None and not is_large(df):
        return df.agg(*[F.percentile(col, F.lit(q)).alias(n) for n, q in qs.items()])
    cumulative = _cumulative(df, keys, col, cell_rows)
    aggs, outs = [], []
    for name, q in qs.items():
        position = (F.col("_n") - 1) * F.lit(q)
        aggs += [
            _value_at(col, F.floor(position) + 1).alias(f"_l_{name}"),
            _value_at(col, F.ceil(position) + 1).alias(f"_h_{name}"),
            F.max(position - F.floor(position)).alias(f"_f_{name}"),
        ]
        low, high, part = (F.col(f"_{x}_{name}") for x in "lhf")
        outs.append((low * (1 - part) + high * part).alias(name))
    return cumulative.groupBy(*keys).agg(*aggs).select(*keys, *outs)
