"""Substring dedup by paragraph MinHash banding.

Paragraphs here are pieces that a passage keeps wherever it is pasted: texts are cut at line ends, after sentences, and where a capitalised
word follows a lower-case one (unless that leaves only pieces too short to compare); lines that are short themselves are joined. As a passage
may have no such borders, or be joined otherwise after other short sentences, all texts are cut a second time where the hash of two words is the
smallest of ``2 REACH + 1`` in a row, which depends on the ``REACH`` words around only. The two cuts never meet each other. Pieces of ``MIN_WORDS`` words or
more are compared. Equal pieces are one class; all classes also meet through the bands of a MinHash: 10 bands of 3 rows find a Jaccard
similarity of 0.8 with a probability of 0.999. One word more at an end leaves 0.8 between 8 and 9 words already, so there is no shorter
piece to leave out. What collides is verified by the exact
Jaccard similarity of five-word shingles and clustered by components; the first occurrence of a cluster stays, the others are
removals. Neighbouring pieces of a document that repeat in
another one are joined into a passage, reported from ``RUN_WORDS`` words on.

Most pieces resemble no other one. So all texts are cut twice: first only short hashes of keys and bands are shuffled, packed in arrays, to find
those that several pieces have; then only pieces with one of these are written, with their bands and shingles.

Large groups are not expanded into pairs: all of a band first meet one of its members. What is still in different components meets by its band and a shingle of
its prefix, the ``n - ceil(0.8 n) + 1`` rarest shingles of a set: sets that reach the threshold share one of these, and have enough others behind the first
one that they share. Of each of these smaller groups, too, all first meet one member and then what is left meets in pairs. Null and empty texts have no pieces. Rows that repeat a ``doc_id`` are one document; rows without an id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import drop_saved, read_table, save, save_result, seeded, slices, text_of
from .components import connected_components
from .jaccard_join import _alike, verified
from .shingles import Shingler, mixed

WIDTH, PERCENT = 5, 80
MIN_WORDS = 8  # of a compared piece
RUN_WORDS = 30  # of a reported passage
REACH = 7  # words on either side of a border by content; pieces between two of them have more words than that
BANDS, ROWS = 10, 3
BUCKETS = 1 << 10  # of hashes that are searched for repeats; each holds 32 bits more
HELD = 100_000  # pieces whose hashes a task holds before it deals them out
REPEAT_BITS, MARKS = 24, 5  # of a filter with repeats for each of them, and of these those that it sets
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 29  # of a filter; a fuller one lets more pieces pass, which costs disk and time
RANKED = 1 << 22  # buckets of shingles that are counted; counts decide which shingles come first, not what links

WHITE, BLANK, ENDS, LOWER, UPPER = 1, 2, 4, 8, 16  # kinds of bytes; of the second byte after LATIN as well, above 127
LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF
CAPITAL, SENTENCE, LINE, TEXT = 1, 2, 3, 4  # kinds of borders


def _byte_kinds() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    for kind, chars in (
        (WHITE, b" \t\n\v\f\r"), (BLANK, b" \t"), (ENDS, b".!?"), (LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        (LOWER, "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ".encode()[1::2]), (UPPER, "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ".encode()[1::2]),
    ):
        kinds[list(chars)] |= kind
    return kinds


KINDS = _byte_kinds()


def _letter(b: np.ndarray, at: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether a letter of that kind begins at each place, and whether it takes two bytes."""
    two = b[at] == LATIN
    at = at + two
    return (KINDS[b[at]] & kind > 0) & ((b[at] >= 128) == two), two


def word_borders(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All texts as one; the first word of each; the border before each word: 0 or the strongest kind."""
    whole = b"\n".join(texts)
    b = np.frombuffer(b"\n" + whole + b"\n\n\n", np.uint8)  # so that every place has neighbours
    kinds = KINDS[b]
    white = (kinds & WHITE).astype(bool)
    edges = np.flatnonzero(white[1:] != white[:-1]) + 1
    first, end = edges[::2], edges[1::2]
    out = np.zeros(len(first) + 1, np.uint8)
    before, after = end[:-1], first[1:]  # the gap before each word but the first
    hit = (kinds[before] & BLANK > 0) & (kinds[before - 1] & ENDS > 0)
    out[1:-1][hit] = SENTENCE
    some = np.flatnonzero((kinds[after] & UPPER > 0) & (b[after] < 128) | (b[after] == LATIN))
    big, two = _letter(b, after[some], UPPER)
    some = some[big & _letter(b, after[some] + 1 + two, LOWER)[0]]
    last = b[before[some] - 1]
    small = (kinds[before[some] - 1] & LOWER > 0) & ((last < 128) | (b[before[some] - 2] == LATIN)) | (last == ord(",")) | (last == ord(";"))
    out[1:-1][some[small]] = CAPITAL
    other = np.searchsorted(first, np.flatnonzero(white & (kinds & BLANK == 0)))  # words after white space that is not blank
    out[other[out[other] == CAPITAL]] = 0
    out[np.searchsorted(first, np.flatnonzero(b == 10))] = LINE
    begins = np.cumsum([1, *(len(x) + 1 for x in texts[:-1])])
    begins = np.searchsorted(first, begins) if texts else np.zeros(0, np.int64)
    out[begins] = TEXT
    return whole, begins, out[:-1]


def pieces(borders: np.ndarray) -> np.ndarray:
    """First words of the pieces. Short pieces are joined inside a line, and over the ends of short lines."""
    at = np.flatnonzero(borders)
    kind, n = borders[at], np.diff(at, append=len(borders))
    sentences, lines = np.flatnonzero(kind >= SENTENCE), np.flatnonzero(kind >= LINE)
    if not len(at):
        return at
    short = (np.maximum.reduceat(n, sentences) < MIN_WORDS).repeat(np.diff(sentences, append=len(at)))
    cut = kind == TEXT
    cut[lines] |= np.add.reduceat(n, lines) >= MIN_WORDS  # a long line has a border of its own at its start
    keep = np.flatnonzero(~short | (kind >= SENTENCE))  # a sentence of short parts only is one
    at, cut = at[keep], cut[keep]
    out, held = [], MIN_WORDS  # words of the last piece, which is whole when it has enough
    for first, alone, n in zip(at.tolist(), cut.tolist(), np.diff(at, append=len(borders)).tolist(), strict=True):
        if alone or held >= MIN_WORDS:
            out.append(first)
            held = 0
        held += n
    return np.array(out)


def content_pieces(words: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """First words of the pieces between borders that the words around them decide, in texts that begin with the words ``begins``."""
    h = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    if len(h) <= 2 * REACH:
        return np.unique(begins[begins < len(words)])
    least = np.minimum(h[:-1], h[1:])
    least = np.minimum(least[:-2], least[2:])
    least = np.minimum(least[: 4 - REACH], least[REACH - 4 :])  # of REACH in a row
    inner = h[REACH:-REACH]
    hit = (inner < least[: len(inner)]) & (inner <= least[REACH + 1 :])
    at = np.flatnonzero(hit) + REACH
    own = np.searchsorted(begins, at, "right")
    inside = (at - REACH >= begins[own - 1]) & (at + REACH + 1 < np.append(begins, len(words))[own])
    return np.unique(np.concatenate([begins[begins < len(words)], at[inside]]))


_MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Cutter:
    """Pieces of a batch of texts with their shingles, computed on one array of all words."""

    def __init__(self) -> None:
        self.shingler = Shingler(WIDTH)

    def __call__(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """``row, start, n`` (in words), ``first, m`` (in ``shingles``), keys ``k1, k2`` of each compared piece."""
        whole, begins, borders = word_borders(texts)
        words = self.shingler.words(whole)
        w = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
        h = np.zeros(len(w) - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : len(w) - WIDTH + 1 + k]
        at, sizes, offsets = [], [], []
        for second, first in enumerate((pieces(borders), content_pieces(words, begins))):
            n = np.diff(first, append=len(words))
            keep = n >= MIN_WORDS
            at.append(first[keep])
            sizes.append(n[keep])
            offsets.append(first[keep] + second * len(h))
        h = np.concatenate([mixed(h), mixed(~h)])  # other shingles for the second cut
        at, n = (np.concatenate(x).astype(np.int64) for x in (at, sizes))
        m = n - WIDTH + 1
        first = np.cumsum(m) - m
        h = h[np.repeat(np.concatenate(offsets).astype(np.int64) - first, m) + np.arange(m.sum())]
        sums = [np.add.reduceat(mixed(h ^ np.uint64(salt)), first) if len(first) else h for salt in (1, 2)]
        row = np.searchsorted(begins, at, "right") - 1
        return {"row": row, "start": at - begins[row], "n": n, "first": first, "m": m, "k1": sums[0].view(np.int64), "k2": sums[1].view(np.int64), "shingles": h}


def _bands(found: dict[str, np.ndarray]) -> np.ndarray:
    """Band hashes of the pieces, a row each."""
    keys = np.zeros((BANDS, len(found["n"])), np.uint64)
    if not len(found["n"]):
        return keys.T
    h, buffer = found["shingles"], np.empty_like(found["shingles"])
    for k, by in enumerate(_MULTIPLIERS):
        least = np.minimum.reduceat(np.multiply(h, by, out=buffer), found["first"])
        keys[k // ROWS] = keys[k // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(k)
    return np.ascontiguousarray(mixed(keys).T)


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])[: len(values)]]


def _short(h: np.ndarray) -> np.ndarray:
    """The 42 bits of a hash by which repeats are looked for: 10 tell the bucket, 32 the place in it."""
    return h.view(np.uint64) >> np.uint64(22)


def _dealt(values: np.ndarray, low: int, kind: int) -> pa.RecordBatch:
    """``bucket, h, f`` of sorted values with ``low`` bits below the hash; ``f`` holds these."""
    at = np.searchsorted(values, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(32 + low))
    used = np.flatnonzero(np.diff(at))
    offsets = pa.array(np.append(at[used], len(values)).astype(np.int32))
    h = pa.array((values >> np.uint64(low)).astype(np.uint32).view(np.int32))
    f = pa.array((values & np.uint64((1 << low) - 1)).astype(np.uint16).view(np.int16))
    return pa.RecordBatch.from_arrays(
        [pa.array((used + kind * BUCKETS).astype(np.int32)), pa.ListArray.from_arrays(offsets, h), pa.ListArray.from_arrays(offsets, f)], names=["bucket", "h", "f"]
    )


def hash_rows(docs: DataFrame) -> DataFrame:
    """``bucket, h, f``: hashes of the keys (``f`` 0) and of the bands (``f`` of their key) of all compared pieces, many to a row.

    Of the same among some of the pieces of a task two are kept for keys and one for bands, so no bucket holds many of a common one.
    """

    def rows(keys: list[np.ndarray], bands: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k = np.sort(np.concatenate(keys))
        yield _dealt(k[np.append([True, True], k[2:] != k[:-2])[: len(k)]], 0, 0)
        yield _dealt(_distinct(np.concatenate(bands)), 16, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, keys, bands, held = Cutter(), [], [], 0
        for part in slices(batches, 64):
            found = cut(part.column("text").cast(pa.binary()).to_pylist())
            own = found["k1"].view(np.uint64)[:, None] * _MULTIPLIERS[:BANDS] >> np.uint64(48)  # other bits in each band
            keys.append(_short(found["k1"]))
            bands.append((_short(_bands(found)) << np.uint64(16) | own).ravel())
            held += len(keys[-1])
            if held > HELD:
                yield from rows(keys, bands)
                keys, bands, held = [], [], 0
        if held:
            yield from rows(keys, bands)

    return docs.select("text").mapInArrow(run, "bucket int, h array<int>, f array<short>")


def _repeats(rows: pa.Table) -> pa.Table:
    """``band, h`` of the hashes of one bucket that two pieces have; those of bands, that two pieces of other keys have."""
    band = rows.column("bucket")[0].as_py() >= BUCKETS
    h, f = (np.concatenate([c.flatten().to_numpy() for c in rows.column(name).chunks]) for name in ("h", "f"))
    h = h.view(np.uint32).astype(np.uint64)
    h = _distinct(h << np.uint64(16) | f.view(np.uint16)) >> np.uint64(16) if band else np.sort(h)
    h = _distinct(h[1:][h[1:] == h[:-1]]).view(np.int64)
    return pa.table({"band": np.full(len(h), band), "h": h})


def _repeats_everywhere(rows: pa.Table) -> pa.Table:
    """``_repeats`` with all 42 bits of the hashes."""
    found = _repeats(rows)
    high = (rows.column("bucket")[0].as_py() % BUCKETS) << 32
    return pa.table({"band": found.column("band"), "h": pa.array(found.column("h").to_numpy() + high, pa.int64())})


def _marks(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Word of a filter and ``MARKS`` bits in it for each of the short hashes."""
    g = mixed(h)
    bits = np.uint64(1) << (g >> np.uint64(34) & np.uint64(63))
    for k in range(1, MARKS):
        bits |= np.uint64(1) << (g >> np.uint64(34 + 6 * k) & np.uint64(63))
    return (g & np.uint64(words - 1)).astype(np.int64), bits


def _filter(hashes: DataFrame) -> np.ndarray:
    """Words of a filter of ``hashes(h)``, ``REPEAT_BITS`` bits for each or more up to ``MOST_BITS``."""
    words = min(MOST_BITS, max(LEAST_BITS, 1 << (REPEAT_BITS * hashes.count()).bit_length())) // 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, bits = _marks(batch.column("h").to_numpy().view(np.uint64), words)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.int32()), pa.array(bits.view(np.int64))], names=["w", "b"])

    found = hashes.mapInArrow(run, "w int, b long").groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()
    out = np.zeros(words, np.uint64)
    out[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return out


def repeat_filters(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Filters of the keys that stand twice and of the bands that pieces of several keys have."""
    found = save(hash_rows(docs).groupBy("bucket").applyInArrow(_repeats_everywhere, "band boolean, h long"), "repeats")
    out = _filter(found.filter(~F.col("band")).select("h")), _filter(found.filter("band").select("h"))
    drop_saved(found)
    return out


def _in(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    w, bits = _marks(_short(h), len(words))
    return words[w] & bits == bits


def piece_rows(docs: DataFrame) -> DataFrame:
    """``doc_id, start, n, k1, k2, bands, s`` of the compared pieces that equal another one or share a band with it, and of a few others.

    ``bands`` holds the shared ones only; it and ``s``, the shingles sorted without sign, are empty where none is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(repeat_filters(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, (same, near) = Cutter(), shared.value
        for part in slices(batches, 64):
            found = cut(part.column("text").cast(pa.binary()).to_pylist())
            bands = _bands(found)
            met = _in(near, bands)
            at = np.flatnonzero(met.any(axis=1) | _in(same, found["k1"]))
            met = met[at]
            offsets = pa.array(np.append(0, np.cumsum(met.sum(axis=1))).astype(np.int32))
            of = np.flatnonzero(met.any(axis=1))
            m = found["m"][at][of]
            piece, begin = np.repeat(of, m), np.cumsum(m) - m
            h = found["shingles"][np.repeat(found["first"][at][of] - begin, m) + np.arange(m.sum())]
            order = np.lexsort((h, piece))
            h = h[order]
            new = np.append(True, (h[1:] != h[:-1]) | (piece[1:] != piece[:-1]))[: len(h)]
            sizes = np.bincount(piece[new], minlength=len(at))
            sets = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(h[new].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").take(pa.array(found["row"][at])), *(pa.array(found[c][at]) for c in ("start", "n", "k1", "k2")),
                    pa.ListArray.from_arrays(offsets, pa.array(bands[at][met].view(np.int64))), sets,
                ],
                names=["doc_id", "start", "n", "k1", "k2", "bands", "s"],
            )

    return docs.mapInArrow(run, "doc_id long, start long, n long, k1 long, k2 long, bands array<long>, s array<long>")


def shingle_ranks(sets: DataFrame) -> np.ndarray:
    """How common the shingles of each of ``RANKED`` buckets are in ``sets(s)``: 0 for most, else the logarithm of their number."""
    counts = save(sets.select(F.explode("s").alias("t")).groupBy(F.expr(f"int(t & {RANKED - 1}L)").alias("t")).count(), "shingle-counts")
    mean = counts.agg(F.avg("count")).first()[0] or 0
    found = counts.filter(F.col("count") > 2 * mean).select("t", F.log2("count").cast("byte").alias("rank")).toArrow()
    drop_saved(counts)
    ranks = np.zeros(RANKED, np.uint8)
    ranks[found.column("t").to_numpy()] = found.column("rank").to_numpy()
    return ranks


def meeting_keys(sets: DataFrame, ranks: np.ndarray) -> DataFrame:
    """``key, doc, comp, n, left``: each band of ``sets(doc, comp, bands, s)`` with each shingle of the set's prefix, rare shingles first.

    Sets that reach the threshold share a shingle of their prefixes, and the first one they share has enough others behind it: ``left`` counts it and these.
    """
    shared = sets.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for part in slices(batches):
            s, bands = part.column("s"), part.column("bands")
            n, width = s.value_lengths().to_numpy(), bands.value_lengths().to_numpy()
            h, piece = s.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(n)), n)
            h = h[np.lexsort((h, common[h & np.uint64(RANKED - 1)], piece))]
            left = n[piece] - (np.arange(len(h)) - (np.cumsum(n) - n)[piece])
            first = np.flatnonzero(left >= (PERCENT * n[piece] + 99) // 100)  # of a prefix; a partner lacks fewer shingles than it has
            owner, times = piece[first], width[piece[first]]
            at = np.repeat((np.cumsum(width) - width)[owner] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            row = np.repeat(np.arange(len(first)), times)
            key = mixed(bands.flatten().to_numpy().view(np.uint64)[at] * np.uint64(0x9E3779B97F4A7C15) + h[first][row])
            of = pa.array(owner[row])
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), part.column("doc").take(of), part.column("comp").take(of), pa.array(n[owner][row], pa.int32()), pa.array(left[first][row], pa.int32())],
                names=["key", "doc", "comp", "n", "left"],
            )

    return sets.select("doc", "comp", "bands", "s").mapInArrow(run, "key long, doc long, comp long, n int, left int")


def _can_reach(n: str, m: str, left: str, other: str) -> Column:
    """Whether sets of ``n`` and ``m`` shingles may reach the threshold if the first one they share has so many left with it."""
    return _alike(n, m, PERCENT) & (F.least(left, other) * (100 + PERCENT) >= (F.col(n) + F.col(m)) * PERCENT)


def near_classes(classes: DataFrame) -> DataFrame:
    """``node, component_id`` of the classes ``(k1, bands, s)`` linked by similarity."""
    sets = classes.filter("size(s) > 0").select(F.col("k1").alias("doc"), "s", "bands")
    sets_for = lambda _: sets.select("doc", "s")
    rows = save(sets.select("doc", F.size("s").alias("n"), F.explode("bands").alias("band")), "bands")
    least = F.min(F.struct(seeded(1, "doc").alias("h"), F.col("doc").alias("b"), F.col("n").alias("nb"))).alias("p")
    pivots = rows.groupBy("band").agg(least, F.count(F.lit(1)).alias("c")).filter("c > 1")
    pivots = save(pivots.select(F.col("band").alias("_band"), "p.b", "p.nb", "c"), "pivots")
    shared = save(rows.join(pivots, F.col("band") == F.col("_band")).select("band", "doc", "n", "b", "nb", "c"), "shared-bands")
    for done in (rows, pivots):
        drop_saved(done)
    pair = [F.greatest("doc", "b").alias("a"), F.least("doc", "b").alias("b"), F.lit(1).cast("long").alias("l")]
    links = verified(shared.filter("doc <> b").filter(_alike("n", "nb", PERCENT)).select(*pair).distinct(), sets_for, PERCENT)
    comps = save_result(classes.sparkSession, lambda: connected_components(links, "a", "b"), "components")
    # Bands of two have met; others go on while they have several components.
    placed = shared.filter("c > 2").select("band", "doc").join(comps, F.col("doc") == F.col("node"), "left")
    placed = save(placed.select("band", "doc", F.coalesce("component_id", "doc").alias("comp")), "placed-bands")
    for done in (shared, comps):
        drop_saved(done)
    several = placed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select(F.col("band").alias("_band"))
    left = placed.join(several, F.col("band") == F.col("_band")).groupBy(F.col("doc").alias("_doc")).agg(F.collect_list("band").alias("bands"), F.first("comp").alias("comp"))
    left = save(sets.drop("bands").join(left, F.col("doc") == F.col("_doc")).drop("_doc"), "sets-left")
    sets_left = lambda _: left.select("doc", "s")
    keys = save(meeting_keys(left, shingle_ranks(left)), "meeting-keys")
    drop_saved(placed)
    # Of a key all meet the member with the fewest rare shingles, then what is still in different components meets.
    least = F.min(F.struct((F.col("n") - F.col("left")).alias("far"), seeded(2, "doc").alias("h"), *(F.col(c).alias(f"_{c}") for c in ("doc", "comp", "n", "left")))).alias("p")
    pivots = keys.groupBy("key").agg(least, F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("_key"), "c", "p.*").drop("far", "h")
    shared = save(keys.join(pivots, F.col("key") == F.col("_key")).drop("_key"), "shared-keys")
    drop_saved(keys)
    met = shared.filter("comp <> _comp").filter(_can_reach("n", "_n", "left", "_left"))
    pair = [F.greatest("doc", "_doc").alias("a"), F.least("doc", "_doc").alias("b"), F.lit(1).cast("long").alias("l")]
    links = links.unionByName(verified(met.select(*pair).distinct(), sets_left, PERCENT))
    comps = save_result(classes.sparkSession, lambda: connected_components(links, "a", "b"), "components")
    placed = shared.filter("c > 2").select("key", "doc", "n", "left").join(comps, F.col("doc") == F.col("node"), "left")
    placed = save(placed.select("key", "doc", "n", "left", F.coalesce("component_id", "doc").alias("comp")), "placed-keys")
    for done in (shared, comps):
        drop_saved(done)
    x, y = placed.alias("x"), placed.alias("y")
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.doc") > F.col("y.doc")) & (F.col("x.comp") != F.col("y.comp")) & _can_reach("x.n", "y.n", "x.left", "y.left"))
    rest = met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), F.lit(1).cast("long").alias("l")).distinct()
    links = links.unionByName(verified(rest, sets_left, PERCENT))
    for done in (placed, left):
        drop_saved(done)
    return connected_components(links, "a", "b")


def repeated_passages(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """``doc_id, passage, start, n_words, component_id, kept`` of every passage that occurs in another document as well.

    ``start`` and ``n_words`` count words; ``component_id`` is the smallest ``doc_id`` that holds the first occurrence of one of its pieces;
    ``kept`` tells that this occurrence is the one that stays.
    """
    docs = docs.filter("doc_id is not null").select("doc_id", text_of("text").alias("text"))
    found = save(piece_rows(docs), "pieces")
    at = F.struct("doc_id", "start")
    classes = found.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.first("bands").alias("bands"), F.first("s").alias("s"))
    classes = save(classes.withColumn("again", F.col("first.doc_id") != F.col("last.doc_id")), "classes")
    near = save_result(docs.sparkSession, lambda: near_classes(classes), "near")
    placed = classes.select("k1", "k2", "first", "last", "again").join(near, F.col("k1") == F.col("node"), "left").filter("again or node is not null")
    placed = save(placed.drop("node"), "placed-classes")
    linked = placed.filter("component_id is not null")
    keepers = linked.groupBy("component_id").agg(F.min("first").alias("keeper"), F.max("last").alias("last"))
    keepers = keepers.filter("keeper.doc_id <> last.doc_id").drop("last")
    decided = linked.select("k1", "k2", "component_id").join(keepers, "component_id").select("k1", "k2", "keeper")
    lone = placed.filter("component_id is null").select("k1", "k2", F.col("first").alias("keeper"))
    decided = decided.unionByName(lone).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "keeper")
    hits = found.join(decided, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).select("doc_id", "start", "n", "keeper")
    hits = save(hits, "hits")
    for done in (found, classes, near, placed):
        drop_saved(done)
    hits = hits.repartition("doc_id").distinct()  # dealt out as the window needs it
    order = Window.partitionBy("doc_id").orderBy("start", "n", "keeper")
    end = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = hits.withColumn("_end", end).withColumn("_new", F.when(F.col("start") - F.col("_end") < MIN_WORDS, 0).otherwise(1))
    runs = runs.withColumn("passage", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    covered = F.greatest(F.lit(0), F.col("start") + F.col("n") - F.greatest("start", F.coalesce("_end", "start")))
    stays = F.struct("doc_id", "start") == F.col("keeper")
    out = runs.groupBy("doc_id", "passage").agg(
        F.min("start").alias("start"), F.sum(covered).alias("n_words"), F.min("keeper.doc_id").alias("component_id"), F.every(stays).alias("kept")
    )
    return out.filter(F.col("n_words") >= run_words)


def op5_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of 30 words or more in all documents."""
    return repeated_passages(read_table(spark, sf_dir, "documents"))
