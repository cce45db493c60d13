"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are computed where the documents are, in Arrow batches. The trees are fitted in numpy on a bounded sample of
labelled rows (``MAX_ROWS``, chosen by a seeded hash of the id) and flattened into arrays of a complete binary tree each, so that
scoring steps all rows and all trees down one level at a time. Labels, language, source and id are no inputs.

Defined results: null texts count as empty and get a score like others; without labelled rows, or with one class only, every score is
the share of ones (0.5 without any). Labels that are null, or whose document is missing, are left out.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ids, read_table, seeded, slices

MAX_ROWS = 20_000  # labelled rows the trees are fitted on
FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "repeated_next", "upper_words", "capital_words", "digits",
    "marks", "stops", "bars", "exclamations", "symbols", "spaces", "controls", "multibyte", "log_lines", "words_per_line", "distinct_lines",
    "distinct_pairs", "compressed", "longest_word", "long_words", "short_words", "word_length_spread",
)


def _classes() -> np.ndarray:
    """For each byte the classes it counts in."""
    table = np.zeros((256, 9))
    for k, chars in enumerate((b"0123456789", b",;:'\"()-", b".?", b"|", b"!", b"*&$#%@^~_=+<>{}[]\\/`", b" ", bytes(range(32)))):
        table[list(chars), k] = 1
    table[128:, 8] = 1
    return table


CLASSES = _classes()


def statistics(text: str) -> list[float]:
    """The statistics of one whole text, in the order of ``FEATURES``."""
    data = text.encode()
    words = text.split()
    n, size = max(1, len(words)), max(1, len(data))
    counts = Counter(words)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ CLASSES / size
    again = sum(map(str.__eq__, words[1:], words))
    return [
        np.log1p(len(text)), np.log1p(len(words)), lengths.mean(), len(counts) / n, max(counts.values(), default=0) / n, again / n,
        sum(map(str.isupper, words)) / n, sum(map(str.istitle, words)) / n, *shares, np.log1p(len(lines)), len(words) / len(lines),
        len(set(lines)) / len(lines), len(set(zip(words, words[1:], strict=False))) / n, len(zlib.compress(data, 1)) / size,
        np.log1p(lengths.max()), (lengths > 15).mean(), (lengths < 3).mean(), lengths.std(),
    ]


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth: node ``i`` has the children ``2i + 1`` and ``2i + 2``; the last level holds the values."""

    base: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        trees = np.arange(self.feature.shape[0])
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(trees)), np.int64)
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        margin = self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for the logistic loss; splits are chosen on histograms of at most ``bins`` quantile bins per feature.

    ``least`` is the smallest sum of second derivatives a child may have. Equal gains go to the first feature and lowest cut.
    """
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        clipped = min(max(share, 1e-6), 1 - 1e-6)
        none = np.zeros((0, inner))
        return Trees(float(np.log(clipped / (1 - clipped))), depth, none.astype(np.int64), none, np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    base = float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    gain_of = lambda g, h: g * g / (h + l2)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 2**level, 2**level - 1
            best = np.full(width, 1e-9)
            total_g = np.bincount(node, g, width)
            total_h = np.bincount(node, h, width)
            where = np.full((width, 2), -1, np.int64)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = node * bins + binned[:, f]
                left_g = np.bincount(key, g, width * bins).reshape(width, bins)[:, : len(c)].cumsum(axis=1)
                left_h = np.bincount(key, h, width * bins).reshape(width, bins)[:, : len(c)].cumsum(axis=1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = gain_of(left_g, left_h) + gain_of(right_g, right_h) - gain_of(total_g, total_h)[:, None]
                gain[(left_h < least) | (right_h < least)] = -1
                at = gain.argmax(axis=1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better], where[better, 0], where[better, 1] = top[better], f, at[better]
            for k in range(width):
                if where[k, 0] >= 0:
                    feature[t, first + k], threshold[t, first + k] = where[k, 0], cuts[where[k, 0]][where[k, 1]]
            node = 2 * node + (x[np.arange(len(y)), feature[t, first + node]] > threshold[t, first + node])
        value[t] = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        margin += value[t][node]
    return Trees(base, depth, feature, threshold, value)


def is_held_out(doc_id: Column) -> Column:
    """Ids whose CRC-32 as text leaves 1 when divided by 3; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most ``max_rows`` labelled rows that are not held out, by a seeded order."""
    usable = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    chosen = usable.select(F.col("doc_id").alias("_id"), F.col("quality").cast("double").alias("_y")).distinct()
    chosen = chosen.orderBy(seeded(seed, "_id"), "_id", "_y").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))  # at most max_rows rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [statistics(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_y"), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    got = rows.mapInArrow(run, "y double, x array<double>").limit(max_rows).toArrow()
    x = np.array(got.column("x").to_pylist()).reshape(-1, len(FEATURES))
    y = np.array(got.column("y").to_pylist())
    order = np.lexsort((y, *x.T))  # the fit does not depend on the order of tasks
    return x[order], y[order]


def score(docs: DataFrame, trees: Trees, text: str = "text", to: str = "score") -> DataFrame:
    """Adds the score of every whole text, 0 to 1; other columns pass through unchanged."""
    if to.lower() in ids(docs):
        raise ValueError(f"column {to} exists")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t or "") for t in batch.column(text).to_pylist()]).reshape(-1, len(FEATURES))
            found = np.concatenate([trees.score(x[i : i + 1000]) for i in range(0, len(x), 1000)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(to)).schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by trees learnt from the labels that are not held out."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = fit(*training_rows(docs, read_table(spark, sf_dir, "labels")))
    scored = score(docs, trees).drop("text")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
