"""Reading the given parquet tables with enough tasks for text work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clauselake.session import bound_batches, compile_wide_plans


def task_count(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Hash rows by key into at least one partition per core.

    Text work is bound by CPU, so a small file that arrives as one split would
    run as one task.  Windows and aggregates on the key reuse this exchange.
    """
    return rows.repartition(task_count(rows.sparkSession), key)


def spread_scan(scan: DataFrame, key: str) -> DataFrame:
    """Spread a plain file scan only when it has fewer splits than the cluster has cores."""
    if scan.rdd.getNumPartitions() >= scan.sparkSession.sparkContext.defaultParallelism:
        return scan
    return spread(scan, key)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    compile_wide_plans(spark)
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
