"""Result sinks and their read-back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OVERLAY_COLUMNS = ["sample_id", "ratio", "row", "col", "state", "num_thr", "den_thr", "threshold"]


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Statistics, predictions, medians and the like; NULLs become empty cells."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "").csv(path)
    else:
        writer.format(fmt).save(path)


def read_table(spark: SparkSession, path: str, schema, fmt: str = "csv") -> DataFrame:
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)


def write_overlay(states: DataFrame, path: str) -> None:
    """A10: pixel states with the thresholds that made them, one folder per ratio."""
    states.select(*OVERLAY_COLUMNS).write.mode("overwrite").partitionBy("ratio").parquet(path)


def read_overlay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Pixel tables bucketed alike (by sample, row and column) join without a shuffle.

    Spectra and their cluster labels are joined again and again; written this way
    once, the spectra never move for it.
    """
    keys = ["sample_id", "row", "col"]
    df.write.mode("overwrite").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return df.sparkSession.table(table)
