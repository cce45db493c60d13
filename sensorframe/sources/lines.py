"""Text files as ordered lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

LINE_ORDER = ("block", "pos")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, block, pos, value``; inside a file the lines are ordered by ``(block, pos)``.

    Files stay splittable: the start offset of a block orders the blocks of a file and the row id orders
    lines inside a block, because a block is read by one task from front to back.
    """
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("pos"),
            "value",
        )
    )
