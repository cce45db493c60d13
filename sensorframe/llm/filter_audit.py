"""Which filter takes what: an audit of filters that overlap.

Every document gets a bit mask of the filters it fails. Counts by part and mask are all that the audit needs from the corpus: for each
coalition of filters (with five filters 32) they give how many documents it removes. From that table come

* the steps of every order of the filters, as differences between the coalitions before and after a step;
* the Shapley value of each filter, as the exact solution of the least squares problem whose weights are the Shapley kernel's
  ``(n - 1) / (C(n, s) s (n - s))`` and whose values add up to what all filters remove (:func:`shapley_rows`). The normal equations
  are solved in rationals. Their matrix depends on the number of filters alone, so it is solved once for all right-hand sides;
  times ``n!`` the solution has whole coefficients, and the values of a part are whole numbers summed over all orders.

Defined results: a null text is the empty text, a null language the empty string; documents without a label lose nothing in the label
columns, and a document labelled more than once counts as good or toxic if any of its labels says so. Rows that repeat a
``doc_id`` count as documents of their own and are no earlier texts for one another; a null ``doc_id`` is neither earlier nor later than
another. An empty table has no parts and so no rows. Columns beyond those named are not read.
"""

from __future__ import annotations

import itertools
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import read_table, text_of

FILTERS = "ABCDE"
GAP = r"[\x20\x09-\x0D]+"


def shapley_rows(n: int) -> list[list[int]]:
    """For each of ``n`` players the whole coefficients that turn coalition values into ``n!`` times its Shapley value.

    Minimises ``sum w(S) (v(S) - sum of phi over S) ** 2`` over the coalitions but the empty and the full one, under ``sum of
    phi = v(all)``. The equations of phi and the multiplier are eliminated in fractions, with one right-hand side a coalition.
    """
    full = (1 << n) - 1
    inside = [[(s >> i) & 1 for i in range(n)] for s in range(full + 1)]
    rows = [[Fraction(0)] * (n + 1 + full + 1) for _ in range(n + 1)]
    for s in range(1, full):
        size = sum(inside[s])
        weight = Fraction(n - 1, math.comb(n, size) * size * (n - size))
        for i in range(n):
            if inside[s][i]:
                for j in range(n):
                    rows[i][j] += weight * inside[s][j]
                rows[i][n + 1 + s] += weight
    for i in range(n):
        rows[i][n] = rows[n][i] = Fraction(1)
    rows[n][n + 1 + full] = Fraction(1)
    for k in range(n + 1):
        pivot = next(r for r in range(k, n + 1) if rows[r][k])
        rows[k], rows[pivot] = rows[pivot], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for r in range(n + 1):
            if r != k and rows[r][k]:
                factor = rows[r][k]
                rows[r] = [x - factor * y for x, y in zip(rows[r], rows[k])]
    scaled = [[x * math.factorial(n) for x in rows[i][n + 1 :]] for i in range(n)]
    assert all(x.denominator == 1 for row in scaled for x in row)
    return [[int(x) for x in row] for row in scaled]


def failures(text: Column) -> list[Column]:
    """The first four failure conditions of the audit, as functions of the text alone."""
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    n_words, n_distinct = F.size(words), F.size(F.array_distinct(words))
    return [
        n_words < 200,
        100 * n_distinct < 50 * n_words,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        text.rlike("[#$%&*|]"),
    ]


def audited(docs: DataFrame, labels: DataFrame, conditions: list[Column]) -> DataFrame:
    """``part, mask`` with the documents failing exactly those filters: ``n``, of them ``good`` and ``toxic``.

    ``conditions`` are bits 0 to ``k - 1``; bit ``k`` says that a smaller ``doc_id`` has the same text. Equal texts are found by their
    SHA-256; texts do not leave the scan. Documents meet their labels by id, are combined there, and once more by text, so
    that a text which stands in most rows arrives as one row a task and part.
    """
    text = text_of("text")
    mask = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))
    part = F.coalesce(F.col("lang"), F.lit(""))
    narrow = docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("_text"), part.alias("part"), mask.cast("int").alias("_mask"))
    marked = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").alias("_id"))
    marked = marked.agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("_good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("_toxic")
    )
    met = narrow.join(marked, F.col("doc_id") == F.col("_id"), "left")
    by_id = met.groupBy("doc_id", "_text", "part", "_mask").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.coalesce("_good", F.lit(0))).alias("_g"), F.sum(F.coalesce("_toxic", F.lit(0))).alias("_t")
    )
    # Per text and part: all rows, and those of the smallest id; rows without an id stand apart, as first ones.
    known = F.col("doc_id").isNotNull()
    by_text = by_id.groupBy("_text", "part", "_mask").agg(
        *[F.sum(c).alias(f"{c}_all") for c in ("_n", "_g", "_t")],
        *[F.coalesce(F.sum(F.when(~known, F.col(c))), F.lit(0)).alias(f"{c}_none") for c in ("_n", "_g", "_t")],
        F.min("doc_id").alias("_least"),
        *[F.coalesce(F.min_by(c, "doc_id"), F.lit(0)).alias(f"{c}_least") for c in ("_n", "_g", "_t")],
    )
    # A text has one row a part here.
    texts = by_text.withColumn("_first", F.min("_least").over(Window.partitionBy("_text")))
    kept = lambda c: F.col(f"{c}_none") + F.when(F.col("_least") == F.col("_first"), F.col(f"{c}_least")).otherwise(0)
    repeat = 1 << len(conditions)
    split = texts.select(
        "part",
        F.explode(
            F.array(
                F.struct(F.col("_mask").alias("mask"), *[kept(f"_{c[0]}").alias(c) for c in ("n", "good", "toxic")]),
                F.struct(
                    F.col("_mask").bitwiseOR(F.lit(repeat)).alias("mask"),
                    *[(F.col(f"_{c[0]}_all") - kept(f"_{c[0]}")).alias(c) for c in ("n", "good", "toxic")],
                ),
            )
        ).alias("x"),
    )
    return split.select("part", "x.*").filter("n > 0").groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def coalitions(counts: DataFrame, n: int) -> DataFrame:
    """``part, n_docs`` with the arrays ``removed, good, toxic``: for every set of filters (index: bits) the documents that fail one of them."""
    sums = [f"array({', '.join(f'sum(if(mask & {s} <> 0, {c}, 0))' for s in range(1 << n))})" for c in ("n", "good", "toxic")]
    return counts.groupBy("part").agg(F.sum("n").alias("n_docs"), *[F.expr(x).alias(name) for x, name in zip(sums, ("removed", "good", "toxic"))])


def literal(values: list) -> Column:
    """An array of whole numbers or of short names, parsed at once."""
    return F.expr(f"array({', '.join(str(v) if str(v).rstrip('L').lstrip('-').isdigit() else repr(v) for v in values)})")


def audit(docs: DataFrame, labels: DataFrame, conditions: list[Column] | None = None, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step; the last letter of ``names`` is the filter of repeated texts."""
    conditions = failures(text_of("text")) if conditions is None else conditions
    n = len(names)
    assert n == len(conditions) + 1
    full = (1 << n) - 1
    table = coalitions(audited(docs, labels, conditions), n)
    steps = []
    for order in itertools.permutations(range(n)):
        before = 0
        for k, i in enumerate(order):
            steps.append(("".join(names[j] for j in order), k + 1, i, before, before | 1 << i))
            before |= 1 << i
    # n! x n steps, a table of fixed size: one array literal a field.
    fields = {name: literal([row[k] for row in steps]) for k, name in enumerate(("filter_order", "step", "i", "before", "after"))}
    weights = F.array(*[literal([f"{x}L" for x in row]) for row in shapley_rows(n)])
    values = F.transform(weights, lambda row: F.aggregate(F.zip_with(row, "removed", lambda a, b: a * b), F.lit(0).cast("long"), lambda a, b: a + b))
    at = lambda column, index: F.element_at(column, index + 1)
    spread = table.withColumn("_shapley", values).select("*", F.explode(F.arrays_zip(*[v.alias(k) for k, v in fields.items()])).alias("_s"))
    before, after, i = F.col("_s.before"), F.col("_s.after"), F.col("_s.i")
    alone = after - before
    gone = at("removed", after) - at("removed", before)
    return spread.select(
        "part", "_s.filter_order", F.col("_s.step").alias("step"),
        (F.col("n_docs") - at("removed", after)).alias("kept"),
        gone.alias("removed"),
        (at("removed", alone) - gone).alias("redundant"),
        (at("removed", F.lit(full)) - at("removed", F.lit(full) - alone)).alias("unique_fails"),
        (at("good", after) - at("good", before)).alias("good_lost"),
        (at("toxic", after) - at("toxic", before)).alias("toxic_lost"),
        at("_shapley", i).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents: short, repetitive, shouting, holding signs, repeated."""
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
    100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY t), false) AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM words LEFT JOIN marked ON marked.doc_id = words.doc_id),
masks AS (
  SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (
  SELECT l1.f || l2.f || l3.f || l4.f || l5.f AS filter_order, [l1.bit, l2.bit, l3.bit, l4.bit, l5.bit] AS bits
  FROM letters l1, letters l2, letters l3, letters l4, letters l5
  WHERE l2.bit <> l1.bit AND l3.bit NOT IN (l1.bit, l2.bit) AND l4.bit NOT IN (l1.bit, l2.bit, l3.bit) AND l5.bit NOT IN (l1.bit, l2.bit, l3.bit, l4.bit)),
steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum(bits[:step])::INT AS upto FROM orders, unnest([1, 2, 3, 4, 5]) AS u(step)),
counted AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & upto = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit <> 0 AND mask & (upto - bit) = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit <> 0 AND mask & (upto - bit) <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit <> 0 AND mask & (upto - bit) = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit <> 0 AND mask & (upto - bit) = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM masks, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted
"""
