"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

Targets. Every source asks for a share of the total proportional to its weight. A source whose share is
above ``max_epochs`` times its size is clamped there and the excess is dealt again among the others by weight, until
none is above. A round is one aggregate over the small table of sources; only its single row reaches the driver.

Sampling. A source with target ``t`` and size ``s`` takes each of its documents ``floor(t / s)`` times in whole. The
rest, less than ``s``, is filled by documents in the order of a seeded hash, the last of them in part, so that the words taken
equal the target rounded down to whole words. The fill works on two levels: sizes are summed per hash bucket
first, whole buckets are decided from those sums, and only the bucket where the fill ends is ordered row by
row. A hot source is thus spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, ranked, read_table, save, seeded, text_of

BUCKETS = 1024


def n_words(text: Column) -> Column:
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def water_fill(sources: DataFrame, total: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to ``sources(source, weight double, source_size long)``.

    Empty sources and weights of zero or null get 0. If all caps together are below ``total``, every source
    stops at its cap. ``total`` is in words.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    weight = F.when((F.col("source_size") > 0) & (F.col("weight") > 0), F.col("weight").cast("double")).otherwise(0.0)
    work = sources.withColumn("_w", weight)
    level, clamped = 0.0, -1
    while True:
        # Sources whose share at this level reaches their cap are clamped; the others share what is left.
        over = (F.col("_w") > 0) & (cap <= F.col("_w") * F.lit(level))
        row = work.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)).alias("full"),
            F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0)).alias("open"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row["n"] == clamped:
            break
        clamped = row["n"]
        if row["open"] <= 0:
            level = None
            break
        level = max(0.0, float(total) - row["full"]) / row["open"]
    share = cap if level is None else F.least(cap, F.col("_w") * F.lit(level))
    return work.withColumn("target", F.when(F.col("_w") > 0, share).otherwise(0.0)).drop("_w")


def mix(sizes: DataFrame, targets: DataFrame, seed: int = 17, buckets: int = BUCKETS) -> DataFrame:
    """``taken`` words for each row of ``sizes(doc_id, source, size)`` under ``targets(source, source_size, target)``.

    Null sources are a source of their own. Rows without words take 0. Repeated rows and equal ``doc_id`` are separate
    documents. Reruns give the same rows.
    """
    plan = targets.withColumn("_k", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0))).withColumn(
        "_rest", F.floor(F.col("target")) - F.col("_k") * F.col("source_size")
    )
    rows = sizes.withColumn("_h", seeded(seed, "doc_id")).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    per_bucket = rows.groupBy("source", "_b").agg(F.sum("size").alias("_sum"))
    upto = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    p = plan.select(F.col("source").alias("_s"), "source_size", "target", "_k", "_rest")
    starts = starts.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    cut = starts.select(
        F.col("source").alias("_s"), F.col("_b").alias("_c"), "source_size", "target", "_k",
        # Words the fill takes from this bucket.
        F.greatest(F.lit(0), F.least(F.col("_sum"), F.col("_rest") - F.col("_before"))).alias("_fill"), "_sum",
    )
    joined = rows.join(cut, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    whole = (F.col("_fill") == 0) | (F.col("_fill") == F.col("_sum"))
    even = joined.filter(whole).withColumn("_extra", F.when(F.col("_fill") == 0, F.lit(0)).otherwise(F.col("size")))
    within = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    part = joined.filter(~whole).withColumn("_seen", F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = part.withColumn("_extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_fill") - F.col("_seen")))).drop("_seen")
    out = even.unionByName(part)
    return out.withColumn("taken", (F.col("_k") * F.col("size") + F.col("_extra")).cast("long")).drop("_h", "_b", "_s", "_c", "_k", "_fill", "_sum", "_extra")


def repeated(docs: DataFrame, taken: str = "taken", text: str = "text") -> DataFrame:
    """The mix as documents: each row of ``docs`` as often as its column ``taken`` says, in words.

    A row taken ``k`` times and a part comes as ``k`` whole rows and one whose text ends after the last word
    taken; rows taken 0 times go. ``n_chars`` follows the text where the frame has it.
    """
    size = n_words(text_of(text))
    rest = F.col(taken) - F.col("_i") * F.col("_size")
    copies = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col(taken) / F.col("_size")) - 1).cast("int"))
    rows = docs.withColumn("_size", size).filter((F.col(taken) > 0) & (F.col("_size") > 0)).withColumn("_i", F.explode(copies))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    head = F.array_join(F.slice(words, F.lit(1), rest.cast("int")), "")
    out = rows.withColumn(text, F.when(rest >= F.col("_size"), F.col(text)).otherwise(head))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast("long"))
    return out.drop("_i", "_size", taken)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, sources weighing 5, 2, 1 in turn by code point, sharing 150 % of all words, at most two epochs."""
    docs = read_table(spark, sf_dir, "documents")
    sizes = save(docs.select("doc_id", "source", n_words(text_of("text")).alias("size")), "sizes")
    return mix_documents(sizes, (5.0, 2.0, 1.0), 1.5, 2.0)


def targets_of(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Targets of the sources of ``sizes(source, size)`` for ``share`` times all words; weights repeat over sources by code point, null last."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = ranked(by_source, [F.col("source").asc_nulls_last()], "_at", "sources")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = save(placed.withColumn("weight", F.get(cycle, F.pmod("_at", F.lit(len(weights))).cast("int"))).drop("_at"), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("n")).first()["n"] * share
    return water_fill(sources, total, max_epochs)


def mix_documents(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int = 17) -> DataFrame:
    """``sizes(doc_id, source, size)`` with what the mix takes of each row, in words."""
    mixed = mix(sizes, targets_of(sizes, weights, share, max_epochs), seed)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_texts(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int = 17) -> DataFrame:
    """The mix of ``docs`` as documents with the same columns, whole and fractional repetitions as rows of their own."""
    sizes = save(docs.select("source", n_words(text_of("text")).alias("size")), "sizes")
    targets = targets_of(sizes, weights, share, max_epochs)
    rows = docs.withColumn("size", n_words(text_of("text")))
    return repeated(mix(rows, targets, seed), "taken").select(*docs.columns)
