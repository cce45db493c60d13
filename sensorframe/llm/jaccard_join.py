"""N-gram Jaccard join with adaptive multi-match prefixes.

Shingles are ordered by their hash. If two sets reach the threshold they share at least ``l`` of the shingles in their
``l``-prefixes, the first ``n - ceil(t n) + l`` each, for every ``l``. A document whose short prefix holds ``h`` shingles that very
many documents have would meet all of those, so its prefix is lengthened until it holds enough others: with ``l`` one more than the number of common
shingles passed over, a partner must share ``l`` shingles of it, hence at least one that is not common, and only those are joined. What is
common (expected to cost more than ``max_cost`` candidates) is one global set, and a pair uses the smaller ``l`` of the two, so that no pair
is lost whichever shingles are in the set; its size is bounded because only the most common are taken.

Shingles rank as the common ones last, else by hash. A pair is a candidate only through shingles after which both sets have enough others left
to reach the threshold.

Groups of copies are not expanded. Equal sets are one class; classes that share a MinHash band are compared with one of
them, then sets of mostly common shingles with the one that has the fewest others. What that links is one component before the prefixes are joined;
only pairs between components become candidates. The answer
is exact: components can only hide pairs that they already link, and which shingles are common, as one set in ``SAMPLED`` shows, only decides their order.

Texts are read three times (sets and bands, prefixes, sets of candidates); the sets themselves are shuffled only for candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import SLICE, drop_saved, ids, ranked, read_table, save, save_result, seeded, slices, text_of, without_ids
from .components import connected_components
from .shingles import Shingler, band_keys, set_key

BANDS, BAND_ROWS = 8, 3
MAX_COST = 8  # components with a shingle from which passing it over, at one more posting, is cheaper than its candidates
SAMPLED = 5  # one class in so many shows which shingles are common; that decides the order of the shingles, not the result
MAX_COMMON = 1 << 20  # bounds the set of common shingles
COMMON_BITS = 1 << 24  # of the filter with these that every task holds; what falls on the bit of another one counts as common too
FILTER_BITS = 1 << 23  # of the filter that keeps texts without candidates from being cut again
EXTRA = 20  # a lengthened prefix asks for one in so many of a set's shingles
STARS = 1
BLOCK = 128  # documents of a block of candidates


def _base(n: np.ndarray | int, percent: int):
    """Shingles that a partner may lack: ``n - ceil(percent n / 100)``."""
    return n - (percent * n + 99) // 100


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(33)).astype(np.int32)


def profiles(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, n, k1, k2, bands, buckets``: size and key of the set, band hashes, and, of one set in ``SAMPLED``, all shingles as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(width)
        for batch in slices(batches):
            n, keys, bands, buckets = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = cut(text)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else (None, None))
                bands.append(band_keys(s, BANDS, BAND_ROWS) if len(s) else [])
                buckets.append(_bucket(s) if len(s) and keys[-1][0] % SAMPLED == 0 else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(k, pa.int64()) for k in zip(*keys, strict=True)),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(buckets, pa.list_(pa.int32())),
                ],
                names=["doc_id", "n", "k1", "k2", "bands", "buckets"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, bands array<long>, buckets array<int>")


def common_shingles(buckets: DataFrame, max_cost: int) -> np.ndarray:
    """Bits of the common ones among ``buckets(t)`` of one set in ``SAMPLED``."""
    often = save(buckets.groupBy("t").count().filter(F.col("count") * SAMPLED > max_cost), "common")
    left, least = MAX_COMMON, 0
    for count, n in sorted(often.groupBy("count").agg(F.count(F.lit(1))).collect(), reverse=True):
        left -= n
        if left < 0:
            break
        least = count
    bits = bit_filter(often.filter(F.col("count") >= (least or MAX_COMMON)).select((F.col("t") % COMMON_BITS).cast("long").alias("p")), COMMON_BITS)
    drop_saved(often)
    return bits


def prefixes(docs: DataFrame, common: np.ndarray, width: int, percent: int) -> DataFrame:
    """``doc_id, n, passed, extra, rare, tokens``: the adaptive prefix without its ``passed`` common shingles. Its first ``rare`` are not common.

    It holds enough others for a partner to share ``1 + extra`` of them. A set with too few others ends its prefix with common ones, which then meet only those of such sets.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, often = Shingler(width), shared.value
        for batch in slices(batches):
            n, passed, extra, others, tokens = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                s = cut(text)
                size = _base(len(s), percent) + 1 if len(s) else 0
                known = passes(often, _bucket(s) % COMMON_BITS)
                # A document that passes over common shingles is lengthened once more, to ask for several others in common.
                more = len(s) // EXTRA if known[:size].any() else 0
                size += more
                rare = np.flatnonzero(~known)[:size]
                last = rare[-1] + 1 if len(rare) == size and size else len(s)
                over = np.flatnonzero(known[:last])
                take = np.concatenate([rare, over[: size - more - len(rare)]]) if len(rare) < size - more else rare
                n.append(len(s))
                # A set with too few others passes over more than that, but a partner shares only ceil(t n) shingles for sure.
                passed.append(min(len(over), max(0, len(s) - _base(len(s), percent) - 1)))
                extra.append(more if len(rare) == size else 0)
                others.append(len(rare))
                tokens.append(s[take].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, passed, extra, others)), pa.array(tokens, pa.list_(pa.int64()))],
                names=["doc_id", "n", "passed", "extra", "rare", "tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, n long, passed long, extra long, rare long, tokens array<long>")


def id_slot(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def bit_filter(slots: DataFrame, size: int = FILTER_BITS) -> np.ndarray:
    """Bits of ``slots(p)``, numbers below ``size``. It has a fixed size; where it is full it lets everything pass and only costs time."""
    words = slots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 AS int)))").alias("b"))
    found = words.toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().view(np.uint64)
    return bits


def passes(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    p = slots.astype(np.uint64)
    return ((bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).astype(bool)


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``doc, s``: whole sets of the documents in ``wanted(doc)`` and of a few others."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(id_slot("doc").alias("p"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, bits = Shingler(width), shared.value
        for batch in batches:
            hit = np.flatnonzero(passes(bits, batch.column("p").to_numpy()))
            texts = batch.column("text")
            for k in range(0, len(hit), SLICE):
                some = hit[k : k + SLICE]
                sets = [cut(texts[i].as_py()).view(np.int64) for i in some.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(some)), pa.array(sets, pa.list_(pa.int64()))], names=["doc", "s"])

    return docs.select("doc_id", "text", id_slot("doc_id").alias("p")).mapInArrow(run, "doc long, s array<long>")


def _count(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _verify(percent: int):
    """Links among the pairs of one block, from the sets of the block."""

    def run(sets: pa.Table, pairs: pa.Table) -> pa.Table:
        of: dict[int, list[np.ndarray]] = {}
        for doc, s in zip(sets.column("doc").to_pylist(), sets.column("s"), strict=True):
            of.setdefault(doc, []).append(s.values.to_numpy().view(np.uint64))
        hit = []
        for k, (a, b, least) in enumerate(zip(*(pairs.column(c).to_pylist() for c in ("a", "b", "l")), strict=True)):
            for x in of.get(a, ()):
                for y in of.get(b, ()):
                    if _count(x[: _base(len(x), percent) + least], y[: _base(len(y), percent) + least]) >= least:
                        near = _count(x, y)
                        if 100 * near >= percent * (len(x) + len(y) - near):
                            hit.append(k)
        return pairs.select(["a", "b"]).take(pa.array(sorted(set(hit)), pa.int64()))

    return run


def verified(pairs: DataFrame, sets_for: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Those of ``pairs(a, b, l)`` that reach the threshold; ``sets_for`` finds the sets ``(doc, s)`` for a frame of ids ``(doc)``.

    First ``l`` shingles must be common to the ``l``-prefixes, then the whole sets are intersected. Pairs are gathered in blocks of
    about ``BLOCK`` documents that meet each other, so that a set travels once per block and not once per pair: components
    of the candidates that are small share blocks, large ones are dealt over blocks that meet two by two.
    """
    pairs = save(pairs, "pairs")
    parts = save_result(pairs.sparkSession, lambda: connected_components(pairs, "a", "b"), "pair-components")
    blocks = max(1, -(-parts.count() // BLOCK))
    sizes = parts.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    large = F.col("size") > BLOCK
    placed = parts.join(sizes, "component_id").select(
        "node", large.alias("large"), F.when(large, F.col("component_id")).otherwise(F.pmod(F.xxhash64("component_id"), F.lit(blocks))).alias("g"),
        F.when(large, F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK))).otherwise(F.lit(0)).cast("long").alias("part"),
    )
    other = placed.select(F.col("node").alias("b"), F.col("part").alias("pb"))
    keys = ["large", "g", "i", "j"]
    dealt = pairs.join(placed.withColumnRenamed("node", "a"), "a").join(other, "b")
    dealt = save(dealt.select("large", "g", F.least("part", "pb").alias("i"), F.greatest("part", "pb").alias("j"), "a", "b", "l"), "dealt")
    own = [f"_{k}" for k in keys]
    needed = dealt.select(*[F.col(k).alias(f"_{k}") for k in keys], F.explode(F.array("a", "b")).alias("doc")).distinct()
    sets = needed.join(sets_for(parts.select(F.col("node").alias("doc"))), "doc")
    links = save(sets.groupBy(*own).cogroup(dealt.groupBy(*keys)).applyInArrow(_verify(percent), "a long, b long"), "links")
    for done in (dealt, parts, pairs):
        drop_saved(done)
    return links


def _alike(a: str, b: str, percent: int) -> Column:
    """Sizes that can reach the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _stars(rows: DataFrame, percent: int) -> DataFrame:
    """Candidates between each document of ``rows(key, doc, n, comp, far)`` and the least far one of each of its keys, if of another component."""
    pivots = rows.groupBy("key").agg(
        F.min(F.struct("far", F.col("doc").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))).alias("p"), F.count(F.lit(1)).alias("c")
    ).filter("c > 1").select(F.col("key").alias("_key"), "p.b", "p.nb", "p.cb")
    met = rows.join(pivots, F.col("key") == F.col("_key")).filter("comp <> cb").filter(_alike("n", "nb", percent))
    return met.select(F.greatest("doc", "b").alias("a"), F.least("doc", "b").alias("b")).distinct().withColumn("l", F.lit(1).cast("long"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, max_cost: int = MAX_COST) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Two documents link when ``100 * intersection >= percent * union`` of their sets of shingles. ``component_id`` is the smallest ``doc_id``
    reachable over links, its own without links. Null texts count as empty; empty texts link with nothing. Repeated
    rows are copies. ``doc_id`` identifies a document: rows that repeat it with another text share its links. Rows without an id
    take the component of their copies, or null.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", text_of("text").alias("text"))
    rows = save(profiles(docs, width, percent), "profiles")
    classes = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("doc"))
    whole = rows.filter("doc_id is not null and n > 0")
    of_class = (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")) & (F.col("doc_id") == F.col("doc"))
    names = classes.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), "doc")
    reps = save(whole.join(names, of_class).select("doc", "n", "bands", "buckets"), "classes")
    sets_for = lambda wanted: sets_of(docs, wanted, width)
    comps, links = None, None

    def united(rows: DataFrame) -> DataFrame:
        """Components of the links so far and those of the stars over ``rows``."""
        nonlocal links
        found = verified(_stars(rows, percent), sets_for, percent)
        links = found if links is None else links.unionByName(found)
        after = save_result(spark, lambda: connected_components(links, "a", "b"), "components")
        if comps is not None:
            drop_saved(comps)
        return after

    for seed in range(STARS):
        bands = _with_component(reps, comps).select(F.explode("bands").alias("key"), "doc", "n", "comp")
        comps = united(bands.withColumn("far", seeded(seed, "doc")))
    placed = _with_component(reps, comps)
    common = common_shingles(placed.filter("doc = comp").select(F.explode("buckets").alias("t")), max_cost)
    long = save(prefixes(docs, common, width, percent).filter("n > 0"), "prefixes")
    # Sets that need common shingles meet the one with the fewest others first, which is near to most of them.
    of_common = long.filter("size(tokens) > rare").select(
        F.explode(F.expr("slice(tokens, int(rare) + 1, size(tokens))")).alias("key"), "doc_id", (F.col("rare") / F.col("n")).alias("far")
    )
    comps = united(of_common.join(placed.select("doc", "n", "comp"), F.col("doc_id") == F.col("doc")).drop("doc_id"))
    placed = _with_component(reps, comps).select("doc", "comp")
    # ``left``: shingles from this one on, so that a pair cannot share more of them.
    fields = ["doc", "n", "passed", "extra", "comp"]
    postings = long.join(placed, F.col("doc_id") == F.col("doc")).select(F.posexplode("tokens").alias("pos", "t"), *fields)
    postings = save(postings.withColumn("left", F.col("n") - F.col("pos")).drop("pos"), "postings")
    drop_saved(long)
    x, y = postings.alias("x"), postings.alias("y")
    extra = F.least("x.extra", "y.extra")
    enough = (F.least("x.left", "y.left") + extra) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    met = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.doc") > F.col("y.doc")) & (F.col("x.comp") != F.col("y.comp")) & _alike("x.n", "y.n", percent))
    met = met.filter(enough)
    met = met.select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"), extra.alias("e"), (F.least("x.passed", "y.passed") + extra + 1).alias("l"))
    candidates = met.groupBy("a", "b", "e", "l").count().filter("count > e").select("a", "b", "l")
    links = links.unionByName(verified(candidates, sets_for, percent))
    for done in (postings, comps, reps):
        drop_saved(done)
    final = save_result(spark, lambda: connected_components(links, "a", "b"), "final-components")
    known = save(classes.join(final, F.col("doc") == F.col("node"), "left").select(
        F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.coalesce("component_id", "doc").alias("component_id")
    ), "class-components")
    drop_saved(final)
    linked = rows.filter("n > 0").join(known, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    alone = rows.filter("n = 0").withColumn("component_id", F.col("doc_id"))
    fields = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return linked.select(*fields).unionByName(alone.select(*fields))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest id. Rows without an id stay as they are.

    Rows that repeat an id are documents of their own, in the order of their texts' hashes: they stay unless their texts are near copies.
    """
    known = docs.filter("doc_id is not null")
    if known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        found = save_result(docs.sparkSession, lambda: jaccard_components(docs, width, percent), "near")
        return without_ids(docs, found.filter("doc_id <> component_id").select("doc_id"))
    place = "_place"
    while place in ids(docs):
        place += "_"
    rows = save(ranked(known, [F.col("doc_id"), F.xxhash64("text")], place, "numbered"), "places")
    found = jaccard_components(rows.select(F.col(place).alias("doc_id"), "text"), width, percent)
    others = save(found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_other")), "others")
    kept = rows.join(others, F.col(place) == F.col("_other"), "left_anti").drop(place)
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def _with_component(reps: DataFrame, comps: DataFrame | None) -> DataFrame:
    if comps is None:
        return reps.withColumn("comp", F.col("doc"))
    return reps.join(comps, F.col("doc") == F.col("node"), "left").withColumn("comp", F.coalesce("component_id", "doc")).drop("node", "component_id")


def op7_prefix_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on sets of four-word shingles at a Jaccard similarity of 0.85."""
    return jaccard_components(read_table(spark, sf_dir, "documents"), 4, 85)
