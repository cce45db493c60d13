"""Byte-level BPE encoding and decoding by a rank table.

A text is cut by the tokenizer's pattern; of each Arrow batch the distinct words are encoded once, each by folding the ranked
merges over its bytes with the rank table as a literal of the task; ids are decoded by joining the pieces of the ids. Nothing is
shuffled. README.md says why the fold is not written as Spark higher-order functions.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read_table, text_of

CACHED_WORDS = 400_000  # distinct words a task keeps; it only saves time
LONG_WORD = 200  # bytes from which a word is folded with a heap
NO_RANK = 1 << 40
# Fixed value: the pattern that the rank files are made for.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}


def fold_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Merge the adjacent pair of the lowest rank, leftmost first, until no pair has a rank."""
    whole = ranks.get(word)
    if whole is not None:
        return (whole,)
    if len(word) > LONG_WORD:
        return fold_long_word(word, ranks)
    # part k is word[cuts[k]:cuts[k + 1]]; near[k] ranks the pair of the parts k and k + 1
    cuts = list(range(len(word) + 1))
    near = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while near:
        least = min(near)
        if least == NO_RANK:
            break
        k = near.index(least)
        del cuts[k + 1], near[k]
        if k < len(near):
            near[k] = ranks.get(word[cuts[k] : cuts[k + 2]], NO_RANK)
        if k:
            near[k - 1] = ranks.get(word[cuts[k - 1] : cuts[k + 1]], NO_RANK)
    return tuple([ranks[word[i:j]] for i, j in pairwise(cuts)])


def fold_long_word(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same fold with pairs in a heap and parts in a linked list, so that a word of any length costs ``n log n``."""
    n = len(word)
    end = list(range(1, n + 1))  # the part at i is word[i:end[i]]; gone parts have end 0
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i : i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if not middle or middle >= n or end[middle] != stop:
            continue  # one of the two parts has been merged since
        end[i], end[middle] = stop, 0
        if stop < n:
            before[stop] = i
            rank = ranks.get(word[i : end[stop]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[stop]))
        left = before[i]
        if left >= 0:
            rank = ranks.get(word[left:stop])
            if rank is not None:
                heapq.heappush(heap, (rank, left, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return tuple(out)


class Words:
    """Cuts texts into the matches of the GPT-2 style pattern, by the class of each character.

    The classes (letter, number, white space, other) come from the ``regex`` module once per task. A word is a run of one
    class with one blank before it; white space before a word keeps all but its last character to itself; ``'s``
    and the like at the start of a run are words. Texts are cut all at once as one array of characters.
    """

    ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")  # fixed values of the pattern

    def __init__(self) -> None:
        every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        text = "".join(map(chr, every))
        self.kind = np.full(0x110000, 2, np.uint8)
        for kind, name in enumerate((r"\p{L}", r"\p{N}", None, r"\s")):
            if name:
                self.kind[[ord(c) for c in regex.findall(name, text)]] = kind

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The words of all texts, and where each text's words begin (one more entry than texts)."""
        whole = "".join(texts)
        borders = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=borders[1:])
        n = len(whole)
        if not n:
            return [], np.zeros(len(texts) + 1, np.int64)
        chars = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        kind = self.kind[chars]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[borders] = True
        starts = edge.copy()
        starts[1:n] |= kind[1:] != kind[:-1]
        runs = np.flatnonzero(starts[:n])
        ends = np.append(runs[1:], n)
        space = kind[runs] == 3
        # The last white space before a word stands alone, or with the word if it is a blank.
        followed = space & ~edge[ends]
        starts[ends[followed] - 1] = True
        glued = ends[followed]
        starts[glued[chars[glued - 1] == 32]] = False
        # Endings: an apostrophe that is a run and not glued to a blank.
        quote = runs[(chars[runs] == 39) & (ends - runs == 1) & starts[runs] & ~edge[ends]]
        if len(quote):
            padded = np.append(chars, [0, 0])
            one, two = padded[quote + 1], padded[quote + 2]
            two = np.where(edge[quote + 2 - (quote + 2 > n)] | (quote + 2 >= n), 0, two)
            for ending in self.ENDINGS:
                hit = one == ord(ending[0])
                if len(ending) == 2:
                    hit &= two == ord(ending[1])
                starts[quote[hit] + 1] = False
                starts[quote[hit] + 1 + len(ending)] = True
        at = np.flatnonzero(starts[:n])
        cuts = at.tolist()
        cuts.append(n)
        return [whole[i:j] for i, j in pairwise(cuts)], np.searchsorted(at, borders)


class Codec:
    """Encoder and decoder of one task."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if pattern != PATTERN:
            raise ValueError("another pattern needs other rules for words")
        self.ranks, self.words = ranks, Words()
        self.pieces = {rank: piece for piece, rank in ranks.items()}
        self.numerals = {rank: str(rank) for rank in self.pieces}
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        words, borders = self.words(texts)
        known = self.known
        if len(known) > CACHED_WORDS:
            known.clear()
        for word in set(words).difference(known):
            known[word] = fold_word(word.encode(), self.ranks)
        found = list(map(known.__getitem__, words))
        return [list(chain.from_iterable(found[i:j])) for i, j in pairwise(borders.tolist())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


def _per_task(ranks: dict[bytes, int], pattern: str, rows: Callable[[Codec, pa.RecordBatch], pa.RecordBatch]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(ranks, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # bounds the ids held at a time
                yield rows(codec, batch.slice(at, 64))

    return run


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", to: str = "token_ids") -> DataFrame:
    """Adds the ids of every text (null: none) as an array of ints; other columns pass through unchanged."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = codec.encode([x or "" for x in batch.column(text).to_pylist()])
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, to])

    schema = df.select("*", F.array().cast("array<int>").alias(to)).schema
    return df.mapInArrow(_per_task(ranks, pattern, rows), schema)


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "token_ids", to: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for (null ids: none); an id outside the vocabulary fails the task."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        data = [codec.decode(x or []) for x in batch.column(ids).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(data, pa.binary())], names=[*batch.schema.names, to])

    return df.mapInArrow(_per_task(ranks, pattern, rows), df.select("*", F.lit(b"").alias(to)).schema)


def digest(df: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of ``df(doc_id, text)``; ids are encoded and decoded in one task."""

    def rows(codec: Codec, batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, decoded = [], [], []
        for ids in codec.encode([x or "" for x in batch.column("text").to_pylist()]):
            counts.append(len(ids))
            hashes.append(hashlib.sha256(" ".join(map(codec.numerals.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return df.select("doc_id", "text").mapInArrow(
        _per_task(ranks, pattern, rows), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` through the 50k byte vocabulary and back."""
    import public_tokenizers

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    docs = read_table(spark, sf_dir, "documents").select("doc_id", text_of("text").alias("text"))
    return digest(docs, ranks, public_tokenizers.PATTERN)
