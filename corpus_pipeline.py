"""The corpus pipeline: quality, repeated lines, near-duplicate documents, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sensorframe.llm import bpe, jaccard_join, line_dedup, mixing, quality
from sensorframe.llm.common import drop_saved, read_table, save, save_result  # noqa: F401 - save: for callers that run single stages


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    trees = quality.fit(*quality.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return quality.score(docs, trees, to="_score").filter("_score >= 0.5").drop("_score")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand earlier in the corpus, equal or within two edits; copies that the next stage drops stay whole."""
    return line_dedup.without_repeats(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 on five-word shingles."""
    return jaccard_join.one_of_each(docs, 5, 80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weighing 5, 2, 1 in turn share 150 % of all words, none above two epochs."""
    return mixing.mixed_texts(docs, (5.0, 2.0, 1.0), 1.5, 2.0)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text as decoded from them."""
    import public_tokenizers

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bpe.encode(docs, ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded.drop("text"), ranks, public_tokenizers.PATTERN)
    text = F.decode("decoded", "UTF-8").alias("text")
    return decoded.select("doc_id", text, "lang", "source", "n_chars", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]
ORACLE_SQL = None  # a classifier and a byte-level tokenizer are beyond SQL; tests hold the rows against a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``; each reads the Parquet files the one before it wrote, which are deleted after that."""
    docs, written = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = save_result(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name)
        if written is not None:
            drop_saved(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
