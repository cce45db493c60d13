"""Named transform functions that :func:`..operators.project.apply_transforms` can call."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.project import apply_transforms, parse_assignment
from ..operators.windows import difference_positive
from .scalars import lenient

# A window step: frame, names of the argument columns, order of the rows, name of the result.
Step = Callable[[DataFrame, Sequence[str], Sequence[str], str], DataFrame]


class TransformRegistry:
    """Functions by name: a SQL template is inlined, a Python callable becomes a session UDF, a stateful function is a
    step over the ordered rows of a key.

    Templates stay inside generated code and are preferred. Column functions may stand anywhere in an expression; a stateful
    function is the whole right side of an assignment, see :meth:`run`.
    """

    def __init__(self) -> None:
        self._templates: dict[str, tuple[tuple[str, ...], str]] = {}
        self._python: dict[str, tuple[Callable, str]] = {}
        self._stateful: dict[str, tuple[int, Step]] = {}

    def template(self, name: str, params: tuple[str, ...], sql: str) -> None:
        self._templates[name] = (params, sql)

    def python(self, name: str, fn: Callable, returns: str) -> None:
        self._python[name] = (fn, returns)

    def stateful(self, name: str, arguments: int, step: Step) -> None:
        """``step`` adds the result column to the rows; it may partition and sort them, but keeps all."""
        self._stateful[name] = (arguments, step)

    def names(self) -> list[str]:
        return sorted([*self._templates, *self._python, *self._stateful])

    def install(self, spark: SparkSession) -> None:
        """Make the functions callable from SQL expressions of ``spark``."""
        for name, (params, sql) in self._templates.items():
            args = ", ".join(f"{p} {kind}" for p, kind in (x.split(":") for x in params))
            body = re.sub(r"\s+", " ", sql)
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
        for name, (fn, returns) in self._python.items():
            spark.udf.register(name, fn, returns)

    def run(self, df: DataFrame, transforms: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
        """Run ``"name = expression"`` in order, where an expression may be one call of a stateful function.

        Arguments of such a call are expressions over the columns so far, later assignments see its result. ``order`` is
        the order in which rows arrive. As in :func:`..operators.project.apply_transforms`, a null keeps the old value.
        """
        self.install(df.sparkSession)
        plain: list[str] = []
        for text in transforms:
            name, body = parse_assignment(text)
            called = re.match(r"(\w+)\s*\((.*)\)\s*$", body, re.S)
            if called is None or called.group(1) not in self._stateful:
                plain.append(text)
                continue
            if not order:
                raise ValueError(f"{called.group(1)} needs the order of the rows")
            df, plain = apply_transforms(df, plain), []
            df = self._step(df, name, called.group(1), called.group(2), order)
        return apply_transforms(df, plain)

    def _step(self, df: DataFrame, name: str, function: str, arguments: str, order: Sequence[str]) -> DataFrame:
        count, step = self._stateful[function]
        given, result = free_names(df, "argument", 1 + count)[1:], free_names(df, "result", 1)[0]
        holder = free_names(df, "argument", 1)[0]
        # Spark's own parser splits the arguments.
        with lenient(df.sparkSession):
            held = df.withColumn(holder, F.expr(f"struct({arguments})"))
            fields = held.schema[holder].dataType.fields
            if len(fields) != count:
                raise ValueError(f"{function} takes {count} arguments, not {len(fields)}")
            # By place: an argument may occur twice.
            named = F.col(holder).cast(T.StructType([T.StructField(g, f.dataType) for g, f in zip(given, fields)]))
            held = held.select(*df.columns, named.alias(holder)).select(*df.columns, f"{holder}.*")
        stepped = step(held, given, order, result)
        value = F.coalesce(result, name) if name in df.columns else F.col(result)
        return stepped.withColumn(name, value).select(*dict.fromkeys([*df.columns, name]))


def free_names(df: DataFrame, stem: str, count: int) -> list[str]:
    """Column names that ``df`` does not have."""
    taken, names, n = {c.lower() for c in df.columns}, [], 0
    while len(names) < count:
        if f"_{stem}{n}" not in taken:
            names.append(f"_{stem}{n}")
        n += 1
    return names


def default_transforms() -> TransformRegistry:
    """``difference_positive(timestamp, key, value)``: increase of a counter since the key's last accepted row."""
    registry = TransformRegistry()
    registry.stateful(
        "difference_positive", 3, lambda df, given, order, out: difference_positive(df, [given[1]], given[0], given[2], order, out)
    )
    return registry
