"""Lempel-Ziv phrase fingerprints of documents.

A text's UTF-8 bytes are parsed into dictionary phrases: each phrase is the shortest prefix of the rest that is not in the
dictionary yet. The phrases are hashed and the ``SIGNATURE`` smallest hashes kept, in hex, as the fingerprint. The share of
common hashes among the smallest of the union estimates the Jaccard similarity of two phrase sets, a likeness in the sense of
compression: texts are alike when the dictionary of one serves the other.

Defined results: null and empty texts have the empty fingerprint; two empty fingerprints have likeness 1, an empty and
another one 0. The parse is linear in the text, whatever its length. Rows are ordered by ``doc_id``, nulls first, repeated ids by text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ids, read_table, text_of

SIGNATURE = 128  # hashes in a fingerprint
CELL_ROWS = 500  # documents in a run of neighbours
MAX_CELLS = 1 << 16  # bounds what the driver holds: one id per run


def phrases(data: bytes, start: int, stop: int, seen: set[bytes]) -> tuple[list[bytes], int]:
    """Adds the phrases that end inside ``data[start:stop]`` to ``seen``; the new ones, and where the open phrase begins.

    The dictionary holds all prefixes of its phrases, so the longest known prefix is found by stepping from a guess in either
    direction instead of from length one.
    """
    found: list[bytes] = []
    size = 1
    while start < stop:
        end = start + size
        if end > stop:
            end = stop
        word = data[start:end]
        if word in seen:
            while True:
                if end == stop:
                    return found, start
                end += 1
                word = data[start:end]
                if word not in seen:
                    break
        else:
            while end - start > 1:
                shorter = data[start : end - 1]
                if shorter in seen:
                    break
                word, end = shorter, end - 1
        seen.add(word)
        found.append(word)
        size = end - start
        start = end
    return found, start


def hashes(words: list[bytes]) -> np.ndarray:
    """Well mixed 32-bit hashes of phrases."""
    h = np.fromiter(map(crc32, words), np.uint32, len(words))
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def smallest(*parts: np.ndarray) -> np.ndarray:
    h = np.unique(np.concatenate(parts))
    return h[:SIGNATURE]


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of two phrase sets, from their smallest hashes."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:SIGNATURE]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).sum()) / len(union)


@dataclass
class Parsed:
    """A parsed text that can be continued from its middle in another way."""

    doc_id: int | None
    text: str
    kept: str  # what an edit leaves of the text
    seen: set[bytes]
    open: int  # where the phrase open at the end of ``kept`` begins
    common: np.ndarray
    signature: np.ndarray

    @classmethod
    def of(cls, doc_id: int | None, text: str) -> Parsed:
        kept = text[: len(text) - len(text) // 2]
        data = text.encode()
        middle = len(kept.encode())
        seen: set[bytes] = set()
        first, start = phrases(data, 0, middle, seen)
        half = set(seen)
        rest, _ = phrases(data, start, len(data), seen)
        common = hashes(first)
        return cls(doc_id, text, kept, half, start, common, smallest(common, hashes(rest)))

    def edited(self, following: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by the first characters of another, and its signature."""
        text = self.kept + following[: len(self.text) // 2]
        data = text.encode()
        rest, _ = phrases(data, self.open, len(data), self.seen)
        return text, smallest(self.common, hashes(rest))


def fingerprint(df: DataFrame, text: str = "text", to: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every whole text; other columns pass through unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(text).to_pylist():
                data = (x or "").encode()
                out.append(to_text(smallest(hashes(phrases(data, 0, len(data), set())[0]))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, to])

    if to.lower() in ids(df):
        raise ValueError(f"column {to} exists")
    return df.mapInArrow(run, df.select("*", F.lit("").alias(to)).schema)


def _cell(value: Column, cuts: list[float]) -> Column:
    """Number of cuts at or below a value, by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>")
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    zero = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        right = F.struct((middle + 1).alias("lo"), s["hi"].alias("hi"))
        left = F.struct(s["lo"].alias("lo"), middle.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.get(table, middle) <= value, right).otherwise(left)

    return F.coalesce(F.aggregate(steps, zero, step, lambda s: s["lo"]), F.lit(0))


def neighbours(docs: DataFrame, rows_per_cell: int = CELL_ROWS, max_cells: int = MAX_CELLS) -> DataFrame:
    """``(_cell, _guest, doc_id, text)`` in runs of neighbours by ``doc_id``, each run in one task and in order.

    A run ends with a guest row: the first document of the next run, or of all after the last. Texts are shuffled once. The
    driver holds one cut and one id per run.
    """
    n = docs.count()
    cells = max(1, min(max_cells, -(-n // rows_per_cell)))
    cuts: list[float] = []
    if cells > 1:
        probabilities = [i / cells for i in range(1, cells)]
        found = docs.select(F.col("doc_id").cast("double").alias("x")).approxQuantile("x", probabilities, 0.25 / cells)
        cuts = sorted(set(found))
    cell = _cell(F.col("doc_id").cast("double"), cuts)
    placed = docs.select("doc_id", text_of("text").alias("text"), cell.alias("_cell"))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id"))
    starts = [(r["_cell"], r["f"]["doc_id"]) for r in placed.groupBy("_cell").agg(first.alias("f")).orderBy("_cell").collect()]
    if not starts:
        return placed.withColumn("_guest", F.lit(False)).select("_cell", "_guest", "doc_id", "text")
    guests = [(doc_id, starts[i - 1][0]) for i, (_, doc_id) in enumerate(starts)]
    table = docs.sparkSession.createDataFrame(guests, "_start long, _previous int")
    with_guests = placed.join(F.broadcast(table), F.col("doc_id").eqNullSafe(F.col("_start")), "left")  # at most max_cells rows
    places = F.array(
        F.struct(F.col("_cell").alias("c"), F.lit(False).alias("g")), F.struct(F.col("_previous").alias("c"), F.lit(True).alias("g"))
    )
    rows = with_guests.select(F.explode(F.filter(places, lambda p: p["c"].isNotNull())).alias("p"), "doc_id", "text")
    rows = rows.select(F.col("p.c").alias("_cell"), F.col("p.g").alias("_guest"), "doc_id", "text")
    return rows.repartition(F.col("_cell")).sortWithinPartitions("_cell", "_guest", "doc_id", "text")


FIELDS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64(),
}
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every document with its successor in the run."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values(), strict=True)], names=list(FIELDS))

    out: list[tuple] = []
    cell, open_doc = None, None
    for batch in batches:
        for at, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != cell:
                cell, open_doc = at, None
            elif guest and open_doc is None:
                continue  # another row with the id of the guest
            now = Parsed.of(doc_id, text)
            if open_doc is not None:
                edited, signature = open_doc.edited(text)
                out.append(
                    (
                        open_doc.doc_id, len(open_doc.text), hashlib.sha256(edited.encode()).hexdigest(), to_text(open_doc.signature),
                        to_text(signature), likeness(open_doc.signature, signature), likeness(open_doc.signature, now.signature),
                    )
                )
                if len(out) == 500:
                    yield batch_of(out)
                    out = []
            open_doc = None if guest else now
    if out:
        yield batch_of(out)


def op1_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and how alike they and their successors are."""
    return neighbours(read_table(spark, sf_dir, "documents").select("doc_id", "text")).mapInArrow(_compare, SCHEMA)
