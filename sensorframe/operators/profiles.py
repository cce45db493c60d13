"""Call profiles over the calls found by ``pair_calls``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.storage import written

ELAPSED = "VRT_OP_ELAPSED"  # fixed value: marks the whole-trace elapsed time, level 0


def counted_calls(calls: DataFrame, buckets: bool = False) -> DataFrame:
    """Calls that take part in profiles."""
    rows = calls.filter(F.col("name") != ELAPSED)
    return rows if buckets else rows.filter(F.col("bucket") == 0)


def _measures() -> list[Column]:
    real = F.col("calls") > 0
    return [
        F.sum("duration").alias("total"),
        F.sum("calls").alias("calls"),
        F.sum("errors").alias("errors"),
        # 0 means "not measured" for the minimum.
        F.coalesce(F.min(F.when(real & (F.col("min_time") != 0), F.col("min_time"))), F.lit(0.0)).alias("minimum"),
        F.coalesce(F.max(F.when(real, F.col("max_time"))), F.lit(0.0)).alias("maximum"),
        F.sum("records").alias("records"),
    ]


def _profile(rows: DataFrame, keys: Sequence) -> DataFrame:
    """Sums per key. The level-1 total is a scalar subquery over the grouped rows, which are written so that calls are paired once."""
    level1 = F.sum(F.when(F.col("level") == 1, F.col("duration"))).alias("_level1")
    sums = written(rows.groupBy(*keys).agg(*_measures(), level1), "profile")
    elapsed = sums.select(F.coalesce(F.sum("_level1"), F.lit(0.0))).scalar()
    sums = sums.withColumn("_elapsed", elapsed)
    share = F.when(F.col("_elapsed") == 0, F.lit(100.0)).otherwise(100 * F.col("total") / F.col("_elapsed"))
    average = F.when(F.col("calls") > 0, F.col("total") / F.col("calls")).otherwise(F.col("total"))
    return sums.withColumn("percentage", F.round(share, 2)).withColumn("average", F.round(average, 6)).withColumn(
        "total", F.round("total", 6)
    ).drop("_level1", "_elapsed")


def call_profile(calls: DataFrame) -> DataFrame:
    """Totals by operation name; the percentage is of the level-1 elapsed time."""
    rows = counted_calls(calls)
    return _profile(rows, ["name"])


def call_path_profile(calls: DataFrame, depth: int | None = None) -> DataFrame:
    """Totals by full call path; calls nested deeper than ``depth`` are left out."""
    rows = counted_calls(calls)
    shown = rows if depth is None else rows.filter(F.col("level") <= depth)
    return _profile(shown.withColumn("path", F.array_join("path", ".")), ["path"])


def virtual_name(name: Column) -> Column:
    short = F.regexp_extract(name, r"\w{1,3}_OP_(.*)", 1)
    return F.concat(F.lit("VRT_OP_"), F.when(short != "", short).otherwise(name))


def exclusive_time(calls: DataFrame, base_ops: Sequence[str] = ()) -> DataFrame:
    """Own time of calls with nested calls, as virtual calls one level below.

    Only calls whose nested calls took time and left a positive rest count; ``base_ops`` are skipped.
    """
    rows = counted_calls(calls)
    # Each call counts for itself and for its caller: one shuffle instead of a self-join.
    zero, none = F.lit(0.0), F.lit(None)
    parts = F.array(
        F.struct(
            F.col("call_id").alias("id"), F.col("name"), F.col("path"), F.col("calls"),
            F.col("duration").alias("own"), zero.alias("nested"),
        ),
        F.when(
            F.col("parent_id").isNotNull(),
            F.struct(
                F.col("parent_id").alias("id"), none.cast("string").alias("name"), none.cast("array<string>").alias("path"),
                F.lit(0).cast("long").alias("calls"), zero.alias("own"), F.col("duration").alias("nested"),
            ),
        ),
    )
    both = rows.select("file", F.explode(parts).alias("_p")).filter("_p IS NOT NULL").select("file", "_p.*")
    own = both.groupBy("file", "id").agg(
        F.max("name").alias("name"), F.max("path").alias("path"), F.sum("calls").alias("calls"),
        F.sum("own").alias("_own"), F.sum("nested").alias("_nested"),
    ).withColumn("duration", F.round(F.col("_own") - F.col("_nested"), 6))
    own = own.filter(F.col("name").isNotNull() & (F.col("_nested") > 0) & (F.col("duration") > 0))
    if base_ops:
        own = own.filter(~F.col("name").isin(list(base_ops)))
    return own.select(
        F.array_join(F.array_append("path", virtual_name(F.col("name"))), ".").alias("path"),
        virtual_name(F.col("name")).alias("name"),
        "calls",
        "duration",
    ).groupBy("path", "name").agg(F.sum("calls").alias("calls"), F.round(F.sum("duration"), 6).alias("total"))


def call_buckets(calls: DataFrame) -> DataFrame:
    """Share of an operation's calls per latency bucket; bucket 0 holds all calls."""
    rows = counted_calls(calls, buckets=True).groupBy("name", "bucket").agg(
        F.sum("calls").alias("calls"), F.max("range_from").alias("range_from"), F.max("range_to").alias("range_to")
    )
    every = F.max(F.when(F.col("bucket") == 0, F.col("calls"))).over(Window.partitionBy("name"))
    share = F.when(F.col("_all") > 0, 100.0 * F.col("calls") / F.col("_all")).otherwise(F.lit(0.0))
    return rows.withColumn("_all", every).filter("bucket > 0").select(
        "name", "bucket", "range_from", "range_to", "calls", F.round(share, 2).alias("share")
    )


def cache_profile(calls: DataFrame) -> DataFrame:
    """Cached calls as an entry of their own below the operation, next to the plain profile."""
    rows = counted_calls(calls)
    entries = F.array(
        F.struct("name", "calls", "duration"),
        F.when(
            F.col("cache_calls") > 0,
            F.struct(
                F.concat("name", F.lit("*TXN*")).alias("name"),
                F.col("cache_calls").alias("calls"),
                F.col("cache_time").alias("duration"),
            ),
        ),
    )
    both = rows.select(F.explode(entries).alias("_e")).filter("_e IS NOT NULL").select("_e.*")
    return both.groupBy("name").agg(
        F.sum("calls").alias("calls"), F.round(F.sum("duration"), 6).alias("total")
    )


def call_totals(calls: DataFrame, base_ops: Sequence[str] = ()) -> DataFrame:
    """One row: distinct operations, calls, errors, elapsed time and the share of base operations."""
    rows = counted_calls(calls).filter(~F.col("name").startswith("VRT_OP"))
    base = F.col("name").isin(list(base_ops)) if base_ops else F.lit(False)
    zero = F.lit(0).cast("long")
    sums = rows.agg(
        F.countDistinct("file").alias("files"),
        F.countDistinct("name").alias("names"),
        F.coalesce(F.sum("calls"), zero).alias("calls"),
        F.coalesce(F.sum("errors"), zero).alias("errors"),
        F.coalesce(F.sum(F.when(F.col("level") == 1, F.col("duration"))), F.lit(0.0)).alias("elapsed"),
        F.coalesce(F.sum(F.when(base, F.col("duration"))), F.lit(0.0)).alias("base_elapsed"),
        F.coalesce(F.sum(F.when(base, F.col("calls"))), zero).alias("base_calls"),
    )

    def pct(part: str, whole: str) -> Column:
        return F.round(100.0 * F.col(part) / F.coalesce(F.nullif(F.col(whole).cast("double"), F.lit(0.0)), F.lit(1.0)), 2)

    files = F.greatest(F.col("files"), F.lit(1))
    return sums.select(
        "files", "names", "calls", "errors",
        F.round("elapsed", 6).alias("elapsed"),
        F.round("base_elapsed", 6).alias("base_elapsed"),
        "base_calls",
        pct("errors", "calls").alias("errors_pct"),
        pct("base_elapsed", "elapsed").alias("base_elapsed_pct"),
        pct("base_calls", "calls").alias("base_calls_pct"),
        F.floor(F.col("calls") / files).alias("calls_per_file"),
        F.round(F.col("elapsed") / files, 6).alias("elapsed_per_file"),
    )


def order_profile(profile: DataFrame, mode: str = "total") -> DataFrame:
    """By total time descending then name, or alphabetically by path."""
    if mode == "path":
        return profile.orderBy("path")
    return profile.orderBy(F.col("total").desc(), F.col("name").asc())
