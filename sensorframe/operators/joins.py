"""Joins of flow tables and series.

No side is hinted for broadcast: sizes are data dependent, so the choice is left to the
optimizer's statistics and to adaptive execution, which also splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import scalars as S
from .windows import first_per_key, longest_per_key


def pair_stages(
    df: DataFrame, key: Sequence[str], stage_a: Column, stage_b: Column, ts: str = "created"
) -> DataFrame:
    """Rows of stage b matched with rows of stage a of the same key; ``duration`` in seconds."""
    started = df.filter(stage_a).select(*key, F.col(ts).alias("_started"))
    ended = df.filter(stage_b)
    return (
        ended.join(started, list(key))
        .withColumn("duration", S.seconds_between(F.col("_started"), F.col(ts)))
        .drop("_started")
    )


def pair_flows(
    df: DataFrame,
    dn: str,
    key: str,
    flows: Mapping[str, tuple[str, str]],
    ts: str = "created",
) -> DataFrame:
    """All flows in one pass: ``flows`` maps a name to the LIKE patterns of its start and end stage.

    Rows are tagged with the flows they start or end, then one join on (flow, key) replaces a branch per flow.
    """

    def tagged(rows: DataFrame, stage: int) -> DataFrame:
        names = F.array(*[F.when(F.col(dn).like(pair[stage]), F.lit(name)) for name, pair in flows.items()])
        return rows.select("*", F.explode(names).alias("flow")).filter("flow IS NOT NULL")

    started = tagged(df.select(key, dn, F.col(ts).alias("_started")), 0).drop(dn)
    return (
        tagged(df, 1)
        .join(started, ["flow", key])
        .withColumn("duration", S.seconds_between(F.col("_started"), F.col(ts)))
        .drop("_started")
    )


def fault_rows(instances: DataFrame, faults: DataFrame, id_col: str = "id", fault_id: str = "composite_instance_id") -> DataFrame:
    """Instance rows once per fault, with ``err`` set."""
    keyed = faults.select(F.col(fault_id).alias(id_col))
    return instances.join(keyed, id_col).withColumn("err", F.lit("ERROR"))


def enrich(df: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left outer joins, one per ``(frame, key columns)``."""
    for other, keys in others:
        df = df.join(other, list(keys), "left")
    return df


def group_messages(groups: DataFrame, messages: DataFrame, keys: Sequence[str], max_status: int = 3) -> DataFrame:
    """Messages with their group; both statuses at most ``max_status`` (filtered before the join)."""
    g = groups.filter(F.col("group_status") <= max_status)
    m = messages.filter(F.col("message_status") <= max_status)
    return g.join(m, list(keys))


def coverage_union(groups: DataFrame, leases: DataFrame, key: str, status: str) -> DataFrame:
    """Error and locked groups per container, also for containers known on one side only.

    The left part counts groups in status 1 or 3; the right part covers every leased container.
    """

    of_lease = leases.groupBy(F.col(key).alias("_c"), "renewal_time").agg(F.count(F.lit(1)).alias("_leases"))
    # Groups are counted per container first: a container is one row when it meets its leases.
    found = groups.groupBy(key).agg(F.count_if(F.col(status) == 3).alias("_errors"), F.count_if(F.col(status) == 1).alias("_locked"))
    flagged = found.filter("_errors + _locked > 0")
    times = F.coalesce("_leases", F.lit(1))
    errors, locked = (F.coalesce(F.col(c), F.lit(0)).cast("long") * times for c in ("_errors", "_locked"))
    counts = [errors.alias("error_groups"), locked.alias("locked_groups")]
    left = flagged.join(of_lease, F.col(key) == F.col("_c"), "left").select(key, *counts)
    right = of_lease.join(found, F.col(key) == F.col("_c"), "left")
    # Leases without a group count together by their time of renewal, under no container.
    known = right.filter(F.col(key).isNotNull()).select(key, *counts)
    unknown = right.filter(F.col(key).isNull()).groupBy("renewal_time").agg(F.lit(None).cast(groups.schema[key].dataType).alias(key)).select(
        key, F.lit(0).cast("long").alias("error_groups"), F.lit(0).cast("long").alias("locked_groups")
    )
    return left.union(known).union(unknown).distinct()


def flag_member(df: DataFrame, members: DataFrame, on: str, name: str) -> DataFrame:
    """Boolean column: the key occurs in ``members``."""
    known = members.select(on).distinct().withColumn(name, F.lit(True))
    return df.join(known, on, "left").withColumn(name, F.coalesce(F.col(name), F.lit(False)))


def join_flow_class(
    df: DataFrame, key: str, item: str, order: Sequence[str], classes: Mapping[str, str], name: str = "flow"
) -> DataFrame:
    """Detail rows with the class of their key, found from the ordered list of its items.

    A key that has more items than the longest class has parts cannot match: one item more than that is kept a key, by a group limit
    that runs before the shuffle.
    """
    from .aggregates import listagg

    most = max((c.count(", ") + 1 for c in classes), default=0) + 1
    first = Window.partitionBy(key).orderBy(F.col(item).isNull(), *order, item)
    heads = df.select(*dict.fromkeys([key, item, *order])).withColumn("_place", F.row_number().over(first)).filter(F.col("_place") <= most)
    chains = listagg(heads, [key], item, order, "_chain")
    label = S.ordered_case([(F.col("_chain") == c, n) for c, n in classes.items()], F.lit("UNKNOWN"))
    return df.join(chains.select(key, label.alias(name)), key)


def align_series(a: DataFrame, b: DataFrame, bucket: Sequence[str]) -> DataFrame:
    """Series b on the buckets of series a."""
    return a.join(b, list(bucket), "left")


def first_and_longest(
    faults: DataFrame, instances: DataFrame, key: str, order: Sequence[str], message: str
) -> DataFrame:
    """Per key: its first fault and longest message, with the instance and one row per fault."""
    first = first_per_key(faults, [key], order).select(key, F.col("composite_instance_id").alias("id"), F.col("created").alias("first_created"))
    longest = longest_per_key(faults, [key], message, order).select(key, F.col(message))
    each = faults.select(key)
    return first.join(longest, key).join(each, key).join(instances.drop(key), "id")
