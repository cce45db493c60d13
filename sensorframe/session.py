"""Session settings the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime SQL settings only, so that an existing session can be configured in place.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join partition even when that costs one more shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def use_disk_state(spark: SparkSession) -> None:
    """Keep streaming state in RocksDB so that it may outgrow the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
