"""Ends of lineage between steps that would otherwise be computed again by each of their readers."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Partitions that dealt() makes where shuffles have fewer.
PARTS = 96


def staged(df: DataFrame) -> DataFrame:
    """df computed once, into the shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only where that is unset and everything runs on one machine (tests), a temporary folder; on
    a cluster, where the driver and each executor would have their own, that is an error."""
    sc = spark.sparkContext
    if where := sc.getConf().get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file://{tempfile.gettempdir()}/flowspark"


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many partitions as shuffles have, or, where these are few, up to eight times as many: a few large
    groups then seldom fall into one task. Where the work on a row is large against its bytes, Spark must not put small
    partitions together, as it would by their size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(n, min(8 * n, PARTS)), *keys)
