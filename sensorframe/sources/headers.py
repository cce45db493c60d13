"""CSV lines read by the header of their own file.

Order of columns may differ from file to file and columns may be missing. The headers become a small written table, one row a
file, with the place of every wanted column; lines are joined to it and parsed by ``from_csv``, so that quoted commas stay inside
their cell. Files stay splittable: a line finds its header by the file, not by what stands before it. The same functions
serve a batch read and a micro-batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.project import clean_header
from ..plans.storage import written

OUTSIDE_QUOTES = r',(?=(?:[^"]*"[^"]*")*[^"]*$)'


def header_names(header: Column) -> Column:
    """Names in a header line: trimmed, without quotes, cleaned."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, r'^\s*"?\s*|\s*"?\s*$', ""), r"\.", "_")
    return F.transform(F.split(header, OUTSIDE_QUOTES, -1), bare)


def plain_names(header: str) -> list[str]:
    return [clean_header(n.strip().strip('"')) for n in header.split(",")]


def file_headers(lines: DataFrame, is_header: Column | None = None) -> DataFrame:
    """``_of, _header, _names`` with the first header of every file of ``lines(file, block, pos, value)``; written once.

    Without ``is_header`` a file's first line is its header. Files without a header have no row.
    """
    found = lines.filter("block = 0") if is_header is None else lines.filter(is_header)
    first = found.groupBy(F.col("file").alias("_of")).agg(F.min_by("value", F.struct("block", "pos")).alias("_header"))
    return written(first.withColumn("_names", header_names(F.col("_header"))), "headers")


def every_name(headers: DataFrame) -> tuple[list[str], int]:
    """All column names, as they first appear in the order of files, and the length of the longest header."""
    names = headers.select("_of", F.size("_names").alias("_n"), F.posexplode("_names").alias("_at", "_name")).groupBy("_name")
    found = names.agg(F.min(F.struct("_of", "_at")).alias("_first"), F.max("_n").alias("_n")).collect()
    return [r["_name"] for r in sorted(found, key=lambda r: tuple(r["_first"]))], max([0, *(r["_n"] for r in found)])


def by_header(
    lines: DataFrame,
    headers: DataFrame,
    columns: Sequence[str],
    is_header: Column | None = None,
    default: str | None = None,
    null_mark: str | None = None,
    known_only: bool = False,
    widest: int | None = None,
) -> DataFrame:
    """``lines`` with one text column for each of ``columns``, header and blank lines dropped.

    A column that a file's header does not name holds ``null_mark``. Files without a header are read by the header line
    ``default``; without one they are an error, or are left out with ``known_only``. ``widest`` is the length of the longest
    header where it is known.
    """
    wanted = F.array(*[F.lit(c) for c in columns])
    places = F.transform(wanted, lambda c: F.array_position(F.col("_names"), c).cast("int"))
    table = headers.select("_of", "_header", places.alias("_at"))
    kept = lines.filter(F.trim("value") != "")
    if is_header is not None:
        kept = kept.filter(~is_header)
    rows = kept.join(table, F.col("file") == F.col("_of"), "inner" if known_only else "left")
    if is_header is None:
        rows = rows.filter(~F.coalesce(F.col("value") == F.col("_header"), F.lit(False)))
    if widest is None:
        widest = headers.agg(F.max(F.size("_names"))).first()[0] or 0
    at = F.col("_at")
    if default is not None:
        fallback = plain_names(default)
        widest = max(widest, len(fallback))
        at = F.coalesce(at, F.array(*[F.lit(fallback.index(c) + 1 if c in fallback else 0) for c in columns]))
    elif not known_only:
        at = F.when(at.isNull(), F.raise_error(F.concat(F.lit("no header in the file "), "file"))).otherwise(at)
    names = [f"_c{k}" for k in range(max(widest, 1))]
    cells = F.from_csv("value", ", ".join(f"{n} STRING" for n in names), {"escape": '"'})
    # As a generator, so that a line is parsed once whatever is filtered or taken from it afterwards.
    rows = rows.select(*[F.col(c) for c in lines.columns], at.alias("_at"), F.inline(F.array(cells)))
    every = F.array(*names)

    def pick(k: int) -> Column:
        place = F.get("_at", F.lit(k))
        return F.when(place > 0, F.get(every, place - 1)).otherwise(F.lit(null_mark).cast("string"))

    taken = {c.lower() for c in columns}
    return rows.select(*[F.col(c) for c in lines.columns if c != "value" and c.lower() not in taken], *[pick(k).alias(c) for k, c in enumerate(columns)])
