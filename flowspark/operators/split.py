"""Demultiplexing by barcode and primer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.flows import KEY
from ..functions.sequences import iupac_column, iupac_pattern

#: Barcode tables are lab sheets; a larger one meets the reads by a shuffle.
BROADCAST_ROWS = 10_000


def check_barcodes(barcodes: DataFrame) -> DataFrame:
    """name, barcode, primer with the primer's pattern; repeated names or pairs are errors."""
    for columns, what in ((["name"], "name"), (["barcode", "primer"], "barcode and primer")):
        again = barcodes.groupBy(*columns).count().where("count > 1").limit(1).collect()
        if again:
            raise ValueError(f"repeated {what}: {again[0]}")
    return barcodes.select("name", "barcode", "primer", iupac_column("primer").alias("primer_re"))


def _small(barcodes: DataFrame) -> DataFrame:
    return F.broadcast(barcodes) if barcodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else barcodes


def _at_length(reads: DataFrame, barcodes: DataFrame, length: int, name: str) -> DataFrame:
    """reads with name: (place, sample) of the last primer that follows a barcode of this length, null for none. An
    equi-join on the barcode brings its primers, in order, as one array; no row is repeated."""
    barcode = F.substring("bases", len(KEY) + 1, length)
    rest = F.col("bases").substr(F.lit(len(KEY) + length + 1), F.length("bases"))
    primers = barcodes.where(F.length("barcode") == length).groupBy(F.col("barcode").alias("_barcode"))
    table = primers.agg(F.sort_array(F.collect_list(F.struct(F.col("ord").cast("bigint").alias("place"), "name", "primer_re"))).alias("_primers"))
    joined = reads.join(_small(table), barcode == F.col("_barcode"), "left")
    hit = F.try_element_at(F.filter("_primers", lambda p: F.rlike(rest, F.concat(F.lit("(?i)^"), p["primer_re"]))), F.lit(-1))
    return joined.withColumn(name, F.when(hit.isNotNull(), F.struct(hit["place"].alias("place"), hit["name"].alias("name")))).drop("_barcode", "_primers")


def split_by_barcode(reads: DataFrame, barcodes: DataFrame, default: str = "unmatched") -> DataFrame:
    """reads (bases and any others) with sample: behind the key, the barcode as it is and then a primer, in any case. Of
    several primers that match, the last of the table wins. barcodes: name, barcode, primer_re, ord. One join for each
    length of barcode; reads need no numbers, so they may come from any number of files."""
    lengths = sorted(r[0] for r in barcodes.select(F.length("barcode")).distinct().collect())
    found = [f"_sample_{n}" for n in lengths]
    for n, name in zip(lengths, found, strict=True):
        reads = _at_length(reads, barcodes, n, name)
    won = F.greatest(*found) if len(found) > 1 else F.col(found[0]) if found else F.lit(None).cast("struct<place:bigint,name:string>")
    return reads.withColumn("sample", F.coalesce(won["name"], F.lit(default))).drop(*found)


def split_equal_barcodes(reads: DataFrame, barcodes: DataFrame, length: int, default: str = "unmatched") -> DataFrame:
    """The same where all barcodes are known to have one length."""
    done = _at_length(reads, barcodes, length, "_sample")
    return done.withColumn("sample", F.coalesce(F.col("_sample")["name"], F.lit(default))).drop("_sample")


def split_counts(split: DataFrame, top: int | None = None) -> DataFrame:
    counts = split.groupBy("sample").count().withColumnRenamed("count", "n")
    return counts.orderBy(F.desc("n"), "sample").limit(top) if top else counts


def split_by_key(reads: DataFrame, keys: DataFrame, primer: str) -> tuple[DataFrame, DataFrame]:
    """(matched with sample, rejected) by the tag between key and the last primer; reads without one are in neither.
    keys: name, tag."""
    pattern = f"^{KEY}(\\w*){iupac_pattern(primer)}"
    tagged = reads.where(F.col("bases").rlike(pattern)).withColumn("tag", F.regexp_extract("bases", pattern, 1))
    keys = _small(keys.select(F.col("name").alias("sample"), "tag"))
    return tagged.join(keys, "tag"), tagged.join(keys, "tag", "left_anti")
