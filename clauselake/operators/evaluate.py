"""Corpus statistics over per-document metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def corpus_stats(metrics: DataFrame) -> DataFrame:
    """One row of totals; averages cover successful documents only."""
    ok = F.col("status") == "success"
    return metrics.agg(
        F.count("*").alias("total_contracts"),
        F.count_if(ok).alias("successful_contracts"),
        (1 - F.count_if(ok) / F.count("*")).alias("error_rate"),
        F.avg(F.when(ok, F.col("risks_count"))).alias("avg_risks_per_contract"),
        F.avg(F.when(ok, F.col("sections_count"))).alias("avg_sections_per_contract"))


def type_distribution(metrics: DataFrame) -> DataFrame:
    counted = metrics.where("status = 'success'").groupBy("contract_type").agg(F.count("*").alias("n"))
    # the window sees one row per agreement type
    return counted.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy()))


def mean_risks_by_type(metrics: DataFrame) -> DataFrame:
    return (metrics.where("status = 'success'").groupBy("contract_type")
            .agg(F.avg("risks_count").alias("avg_risks"), F.count("*").alias("n")))


def histogram(rows: DataFrame, measure: str, bins: int = 20) -> DataFrame:
    """Equal-width bins between minimum and maximum; the maximum belongs to the last bin.

    The range is one row, computed first and broadcast by the optimizer as a
    scalar; the counts combine before the shuffle.
    """
    x = F.col(measure).cast("double")
    rows = rows.where(x.isNotNull())
    span = rows.select(F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"))).scalar()
    lo, hi = span["lo"], span["hi"]
    # a constant measure spans no range: half a unit on each side, as plotting tools do
    lo, hi = F.when(lo == hi, lo - 0.5).otherwise(lo), F.when(lo == hi, hi + 0.5).otherwise(hi)
    binned = rows.select(x.alias("x"), lo.alias("lo"), hi.alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    no = F.least(F.floor((F.col("x") - F.col("lo")) / width), F.lit(bins - 1))
    return (binned.select((no + 1).cast("int").alias("bin"), "lo", width.alias("width"))
            .groupBy("bin").agg(F.count("*").alias("n"),
                                F.max(F.col("lo") + (F.col("bin") - 1) * F.col("width")).alias("bin_start")))


def report_tables(metrics: DataFrame) -> dict[str, DataFrame]:
    return {
        "summary": corpus_stats(metrics),
        "types": type_distribution(metrics),
        "details": metrics.where("status = 'success'").select("filename", "contract_type", "risks_count",
                                                              "sections_count"),
    }
