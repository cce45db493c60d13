"""Runs catalog queries next to their SQL and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal

import duckdb

from sensorframe.catalog.base import TABLES


def connect(path: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


SAME = {
    "bigint": {"BIGINT"}, "int": {"INTEGER"}, "double": {"DOUBLE"}, "string": {"VARCHAR"},
    "boolean": {"BOOLEAN"}, "timestamp": {"TIMESTAMP", "TIMESTAMP WITH TIME ZONE"},
    "timestamp_ntz": {"TIMESTAMP"},
}


def differences(df, con, sql: str) -> list[str]:
    out = []
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]) for c in result.description}
    want = rows_of(names, result.fetchall())
    got = rows_of(df.columns, df.collect())
    if sorted(names) != sorted(df.columns):
        out.append(f"columns {sorted(df.columns)} / {sorted(names)}")
    for field in df.schema:
        kind = field.dataType.simpleString()
        if kind in SAME and field.name in kinds and kinds[field.name] not in SAME[kind]:
            out.append(f"type of {field.name}: {kind} / {kinds[field.name]}")
    if len(got) != len(want):
        out.append(f"rows {len(got)} / {len(want)}")
    if got != want:
        in_want, in_got = set(want), set(got)
        only_got = [r for r in got if r not in in_want][:3]
        only_want = [r for r in want if r not in in_got][:3]
        out.append(f"values differ\n   spark {only_got}\n   sql   {only_want}")
    if not want:
        out.append("no rows")
    return out
