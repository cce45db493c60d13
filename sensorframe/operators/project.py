"""Column projections: rewriting, tags and fields, pivots, entity routing."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import scalars as S

SYSTEM_COLUMNS = ("datetime", "timezone", "timestamp", "system", "source")
NUMBER_PATTERN = r"^[+-]?[0-9]*(\.[0-9]+)?$"


def rewrite_columns(
    df: DataFrame, columns: Sequence[str], system_n: int = 5, null_mark: str = "(!)"
) -> DataFrame:
    """The first ``system_n`` columns, then ``columns`` in this order; a missing one holds the mark."""
    have = set(df.columns)
    return df.select(
        *df.columns[:system_n], *[F.col(c) if c in have else F.lit(null_mark).alias(c) for c in columns]
    )


def add_timestamp(df: DataFrame, system: str, source: str, at: Column | None = None) -> DataFrame:
    """Prefix the five system columns; ``at`` is the instant of the row (default: now)."""
    moment = (at if at is not None else F.current_timestamp()).cast("timestamp")
    return df.select(
        F.date_format(moment, "yyyy-MM-dd HH:mm:ss").alias("datetime"),
        F.date_format(moment, "xx").alias("timezone"),
        F.unix_seconds(moment).alias("timestamp"),
        F.lit(system).alias("system"),
        F.lit(source).alias("source"),
        *[F.col(c) for c in df.columns if c not in SYSTEM_COLUMNS],
    )


def _listed(names: Sequence[str], common: Sequence[str]) -> list[str]:
    dropped = {n[1:] for n in names if n.startswith("!")}
    wanted = [*[c for c in common if c not in dropped], *[n for n in names if not n.startswith("!")]]
    return list(dict.fromkeys(wanted))


def non_null_map(columns: Mapping[str, Column]) -> Column:
    pairs = F.map_from_arrays(
        F.array(*[F.lit(n) for n in columns]), F.array(*[c for c in columns.values()])
    )
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def split_tags_fields(
    df: DataFrame,
    tags: Sequence[str],
    fields: Sequence[str],
    common_tags: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """``tags`` map of text and ``fields`` map of doubles (null when not numeric).

    ``!name`` in ``tags`` removes a common tag. Columns of ``keep`` pass through.
    """
    tag_names = _listed(tags, common_tags)
    field_names = _listed(fields, ())
    return df.select(
        *keep,
        F.map_from_arrays(
            F.array(*[F.lit(t) for t in tag_names]), F.array(*[F.col(t).cast("string") for t in tag_names])
        ).alias("tags"),
        F.map_from_arrays(
            F.array(*[F.lit(f) for f in field_names]),
            F.array(*[F.col(f).cast("string").try_cast("double") for f in field_names]),
        ).alias("fields"),
    )


def infer_tags_fields(df: DataFrame) -> DataFrame:
    """One row per column: a field when every non-null value reads as a number, else a tag."""
    checks = [
        F.coalesce(F.bool_and(F.col(c).cast("string").rlike(NUMBER_PATTERN)), F.lit(False)).alias(c)
        for c in df.columns
    ]
    flat = df.agg(*checks).unpivot([], df.columns, "name", "numeric")
    return flat.select("name", F.when(F.col("numeric"), "field").otherwise("tag").alias("role"))


def clean_header(name: str) -> str:
    return name.strip().replace(".", "_")


def normalize_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[clean_header(c) for c in df.columns])


def include_exclude(
    df: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> DataFrame:
    wanted = [c for c in df.columns if (include is None or c in include) and c not in exclude]
    return df.select(*wanted)


_ASSIGN = re.compile(r"^\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+)$", re.S)


def parse_assignment(text: str) -> tuple[str, str]:
    match = _ASSIGN.match(text)
    if match is None:
        raise ValueError(f"not an assignment: {text!r}")
    return match.groups()


def apply_transforms(df: DataFrame, transforms: Sequence[str]) -> DataFrame:
    """Run ``"name = expression"`` in order; later ones see earlier results.

    An expression that fails or gives null keeps the old value of its column.
    """
    for text in transforms:
        name, body = parse_assignment(text)
        with S.lenient(df.sparkSession):
            value = F.expr(body)
            if name in df.columns:
                value = F.coalesce(value, F.col(name))
            df = df.withColumn(name, value)
    return df


def resource_id(df: DataFrame, cols: Sequence[str], name: str = "resource_id") -> DataFrame:
    return df.withColumn(name, S.safe_name(*[F.col(c).cast("string") for c in cols]))


def to_state_map(df: DataFrame, keep: Sequence[str] = (), name: str = "state") -> DataFrame:
    """The row as a text map of column name to value."""
    return df.select(
        *keep,
        F.map_from_arrays(
            F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.col(c).cast("string") for c in df.columns])
        ).alias(name),
    )


_PLACEHOLDER = re.compile(r"\{([\w.]+)\}")


def template_column(template: str) -> Column:
    """``{a.b}`` alone keeps its type; mixed with text it is a string with ``-`` for null."""
    whole = _PLACEHOLDER.fullmatch(template)
    if whole:
        return F.col(whole.group(1))
    parts, at = [], 0
    for match in _PLACEHOLDER.finditer(template):
        if match.start() > at:
            parts.append(F.lit(template[at : match.start()]))
        parts.append(F.coalesce(F.col(match.group(1)).cast("string"), F.lit("-")))
        at = match.end()
    if at < len(template):
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")


def project_templates(df: DataFrame, table_def: Mapping[str, str]) -> DataFrame:
    columns = []
    for name, template in table_def.items():
        value = template_column(template)
        columns.append(value.alias(name))
    out = df.select(*columns)
    return out.select(
        *[
            F.coalesce(F.col(f.name), F.lit("-")).alias(f.name) if f.dataType.simpleString() == "string" else f.name
            for f in out.schema
        ]
    )


def pivot_stats(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], metric="metric", stat="stat", value="value"
) -> DataFrame:
    """Long ``(metric, stat, value)`` rows to one wide row per key, columns ``metric#stat``.

    ``columns`` names the wide columns, so the pivot needs no pass over the data to find them.
    """
    named = df.withColumn("_column", F.concat_ws("#", metric, stat))
    return named.groupBy(*keys).pivot("_column", list(columns)).agg(F.max(value))


def one_hot_value(
    df: DataFrame, code: str, value: str, prefix: str, codes: Sequence
) -> DataFrame:
    """One column per code of ``codes``: the value where the code matches, else 0. No pass over the data finds the codes."""
    zero = F.lit(0).cast(df.schema[value].dataType)
    return df.select(
        "*", *[F.when(F.col(code) == c, F.col(value)).otherwise(zero).alias(f"{prefix}{c}") for c in codes]
    )


def split_path(path: Column, sep: str) -> tuple[Column, Column]:
    """``(parent, last item)``; the parent of a bare item is ``None`` as text."""
    has_parent = F.instr(path, sep) > 0
    last = F.substring_index(path, sep, -1)
    parent = F.left(path, F.length(path) - F.length(last) - F.lit(len(sep)))
    return F.when(has_parent, parent).otherwise(F.lit("None")), last


def changing_metrics(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """``(metric_group, metric, std)`` for metrics whose standard deviation is above zero."""
    metrics = [m for names in groups.values() for m in names]
    spread = df.agg(*[F.stddev_samp(m).alias(m) for m in metrics]).unpivot([], metrics, "metric", "std")
    label = S.ordered_case([(F.col("metric").isin(list(names)), group) for group, names in groups.items()])
    return spread.filter("std > 0").select(label.alias("metric_group"), "metric", "std")


def route_entities(
    df: DataFrame,
    entities: Sequence[tuple[str, Mapping[str, str]]],
    metrics: Sequence[str],
    common: Mapping[str, str],
    keep: Sequence[str] = (),
) -> DataFrame:
    """One record per row and matching entity.

    ``entities`` holds ``(predicate, properties)``, with properties as SQL expressions overriding
    ``common``. Metrics that are not null become the arrays ``metricNames`` and ``metricValues``.
    """

    def props(pairs: Mapping[str, str]) -> Column:
        names = sorted({*common, *pairs})
        return F.map_from_arrays(
            F.array(*[F.lit(n) for n in names]),
            F.array(*[F.expr(pairs.get(n, common.get(n))).cast("string") for n in names]),
        )

    candidates = F.array(*[F.when(F.expr(pred), F.struct(props(pairs).alias("props"))) for pred, pairs in entities])
    present = F.filter(
        F.array(
            *[F.struct(F.lit(m).alias("n"), F.col(m).cast("string").alias("v")) for m in metrics]
        ),
        lambda x: x["v"].isNotNull(),
    )
    return (
        df.withColumn("_entity", F.explode(candidates))
        .filter("_entity IS NOT NULL")
        .withColumn("_present", present)
        .select(
            *keep,
            F.col("_entity.props").alias("properties"),
            F.col("_present")["n"].alias("metricNames"),
            F.array(F.col("_present")["v"]).alias("metricValues"),
        )
    )


def series_view(df: DataFrame, view: Mapping[str, str], date: str | None = None) -> DataFrame:
    """The named series of a dashboard: ``view`` maps output names to columns of a daily log."""
    rows = df if date is None else df.filter(F.col("date") == F.lit(date))
    return rows.select(*[F.col(c).alias(name) for name, c in view.items()])


def clip_above(df: DataFrame, col: str, q: float, bound: Column | None = None) -> DataFrame:
    """Values above the ``q`` percentile of the whole frame become 0."""
    from .percentiles import quantiles

    if bound is None:
        bound = quantiles(df, [], col, {"_q": q}).scalar()
    zero = F.lit(0).cast(df.schema[col].dataType)
    return df.withColumn(col, F.when(F.col(col) > bound, zero).otherwise(F.col(col)))


def any_of(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns)
