"""Breakpoint files as they arrive: running counts and exactly-once appends with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import genome, pair_tag
from ..sources.files import ACC_COLUMNS, sample_of


def breakpoint_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder as a stream of breakpoints with their sample."""
    rows = spark.readStream.schema(ACC_COLUMNS).option("header", True).option("comment", "#").option("maxFilesPerTrigger", files_per_trigger).csv(folder)
    return rows.select("*", sample_of().alias("sample"))


def pair_counts(stream: DataFrame) -> DataFrame:
    """Running counts of breakpoints for each genome pair (complete or update mode)."""
    a, b = genome(F.col("from_ref")), genome(F.col("to_ref"))
    return stream.filter(a != b).groupBy(pair_tag(a, b).alias("pair")).agg(F.count("*").alias("n"), F.approx_count_distinct("sample").alias("n_samples"))


def append_table(stream: DataFrame, table: str, checkpoint: str):
    """Appends cleaned breakpoints to a Parquet table, each batch once: a batch has its own partition and overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        cleaned = batch.filter(genome(F.col("from_ref")) != genome(F.col("to_ref")))
        cleaned.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
