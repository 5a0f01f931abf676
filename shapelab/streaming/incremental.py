"""Incremental profiles of a stream: each micro-batch is reduced to mergeable rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.profile import column_facts


def partial(df: DataFrame, table: str) -> DataFrame:
    """Counts, sums and extremes of a batch, one row for each column."""
    c = column_facts(df, table)
    return c.select("table_name", "column_name", "row_count", "non_null", "min_value", "max_value", "min_length", "max_length")


def merge(parts: DataFrame) -> DataFrame:
    """Parts of any number of batches as one."""
    return parts.groupBy("table_name", "column_name").agg(
        F.sum("row_count").alias("row_count"), F.sum("non_null").alias("non_null"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length")
    )


def start(stream: DataFrame, table: str, path: str, checkpoint: str):
    """Writes the parts of each micro-batch under path; a repeated batch overwrites its own."""

    def write(batch, epoch):
        partial(batch, table).write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
