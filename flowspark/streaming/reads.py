"""Streams of reads (read_id, ord, clip, flows)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flows import homopolymers
from ..operators.clean import clean_reads


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of reads as they land in folder."""
    schema = "read_id string, ord long, clip int, flows array<int>"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def clean_stream(reads: DataFrame, primer: str = ".", **options) -> DataFrame:
    """Reads that pass; no state is kept."""
    return clean_reads(reads, primer, **options).where("passed")


def pattern_counts(reads: DataFrame) -> DataFrame:
    """Number of reads of each rounded pattern, for update mode. The state is a row a pattern."""
    return reads.groupBy(F.array_join(homopolymers("flows").cast("array<string>"), "").alias("pattern")).agg(F.count(F.lit(1)).alias("weight"))


def write_samples(split: DataFrame, path: str, checkpoint: str):
    """A folder a sample, each batch written once: the batch number is part of its path."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").partitionBy("sample").parquet(f"{path}/batch={number}")

    return split.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
