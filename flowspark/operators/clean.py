"""Cleaning of flowgram reads, all in built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import flows as fl
from ..functions.sequences import iupac_pattern


def clean_reads(reads: DataFrame, primer: str = ".", min_flows: int = 360, max_flows: int = 720, max_empty: int = 0, high: int = fl.HIGH, greedy: bool = False, anchored: bool = False) -> DataFrame:
    """reads (read_id, ord, clip, flows in hundredths; others are kept) with seq (from the primer on, of the flows up to
    the first bad four), len (those flows up to max_flows, rounded up to a multiple of four), flows (the read's own, up
    to max_flows) and passed: min_flows good ones and a primer behind the key."""
    between = "" if anchored else ".*" if greedy else ".*?"
    pattern = f"^{fl.KEY}{between}((?i:{iupac_pattern(primer) if primer != '.' else '.'}).*)"
    kept = fl.clean_prefix(F.slice("flows", 1, F.greatest("clip", F.lit(0))), max_empty, high)
    own = [c for c in reads.columns if c not in ("clip", "flows", "kept", "bases", "seq", "len", "passed")]
    out = reads.withColumn("kept", kept).withColumn("bases", fl.flow_to_seq("kept"))
    n = F.least(F.size("kept"), F.lit(max_flows))
    return out.select(
        *own, F.regexp_extract("bases", pattern, 1).alias("seq"), (F.ceil(n / 4) * 4).cast("int").alias("len"), F.slice("flows", 1, max_flows).alias("flows"),
        ((F.size("kept") >= min_flows) & F.col("bases").rlike(pattern)).alias("passed"),
    )


def pass_fail(cleaned: DataFrame) -> DataFrame:
    return cleaned.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def base_length_filter(reads: DataFrame, primer: str, least: int = 204) -> DataFrame:
    """The variant that asks for a number of bases right behind key and primer."""
    bases = fl.bases_from_flows("flows", F.col("clip"))
    found = F.regexp_extract(bases, f"^{fl.KEY}({iupac_pattern(primer)}.*)", 1)
    return reads.withColumn("seq", found).where(F.length("seq") >= least)
