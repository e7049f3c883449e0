"""Record ordinals without a single task: rows are numbered within splits or partitions, and these by their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import staged

_BEFORE = (Window.unboundedPreceding, -1)


def _sum_before(window) -> Column:
    return F.coalesce(F.sum("_rows").over(window.rowsBetween(*_BEFORE)), F.lit(0))


def scan_ordinals(scan: DataFrame) -> DataFrame:
    """A scan of files as it was read, with _nth (number of the file, by path), _line (place in its file) and _total
    (place in all files). Spark packs the splits of files into tasks by size, so places come from the files' splits:
    the rows of a split are read in a row. What is broadcast is 40 bytes a split (800,000 splits for 100 TB); a row
    whose split is not among them is an error."""
    tagged = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    splits = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first"))
    order = Window.orderBy("_file", "_start")
    name = F.xxhash64("_file", "_start").alias("_split")
    places = splits.select(name, "_first", _sum_before(order).alias("_all"), _sum_before(Window.partitionBy("_file").orderBy("_start")).alias("_here"), (F.dense_rank().over(Window.orderBy("_file")) - 1).alias("_nth"))
    joined = tagged.withColumn("_split", name).join(F.broadcast(places), "_split", "left")
    place = F.when(F.col("_first").isNull(), F.raise_error(F.lit("files changed while they were read")).cast("bigint")).otherwise(F.col("_id") - F.col("_first"))
    return joined.withColumns({"_line": F.col("_here") + place, "_total": F.col("_all") + place}).drop("_file", "_start", "_id", "_split", "_first", "_all", "_here")


def with_ordinal(df: DataFrame, name: str = "ord", scan: bool = False) -> DataFrame:
    """0, 1, 2 ... in the order of df: with scan, of the files that df reads and nothing else; else of its partitions,
    which are checkpointed first, as the partitions of a shuffle may differ from one reading to the next. What is summed
    in one place is one row a split or partition."""
    if scan:
        return scan_ordinals(df).drop("_nth", "_line").withColumnRenamed("_total", name)
    tagged = staged(df).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.select("_part", _sum_before(Window.orderBy("_part")).alias("_start"))
    joined = tagged.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_id", "_start")


def renumber(df: DataFrame, key: str, name: str = "number", block: str | None = None) -> DataFrame:
    """Consecutive numbers of the distinct keys in order, within a block where there is one. Without a block the keys
    are sorted over all tasks and numbered by partitions."""
    keys = df.select(*([block] if block else []), key).distinct()
    if block:
        keys = keys.withColumn(name, F.row_number().over(Window.partitionBy(block).orderBy(key)) - 1)
    else:
        keys = with_ordinal(keys.orderBy(key), name)
    return df.join(keys, [block, key] if block else key)


def by_length(df: DataFrame, length: str = "len", order: str = "ord", name: str = "place") -> DataFrame:
    """Places by length, and of equal lengths by order."""
    return with_ordinal(df.orderBy(length, order), name)
