"""Sorted tables and top-k reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F


def sort_table(df: DataFrame, cols: Sequence[str], reverse: bool = False) -> DataFrame:
    """Sort by the named columns; unknown names are ignored."""
    known = [F.col(c).desc() if reverse else F.col(c).asc() for c in cols if c in df.columns]
    return df.orderBy(*known) if known else df


def topk_wide(
    df: DataFrame, snapshot: Sequence[str], order: Sequence, k: int, cols: Sequence[str]
) -> DataFrame:
    """The top ``k`` rows of each snapshot side by side: ``<col>1 .. <col>k``."""
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*snapshot).orderBy(*order)))
    top = ranked.filter(F.col("_rn") <= k)
    return top.groupBy(*snapshot).agg(
        *[F.max(F.when(F.col("_rn") == i, F.col(c))).alias(f"{c}{i}") for i in range(1, k + 1) for c in cols]
    )


def tail_rows(
    df: DataFrame, key: Sequence[str], order: Sequence[str], n: int, text: str | None = None, width: int = 0
) -> DataFrame:
    """Last ``n`` rows per key; the text column is cut to ``width``."""
    newest = Window.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    out = df.withColumn("_rn", F.row_number().over(newest)).filter(F.col("_rn") <= n).drop("_rn")
    return out.withColumn(text, F.substring(text, 1, width)) if text and width else out
