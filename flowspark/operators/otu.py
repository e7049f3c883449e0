"""Tables of operational taxonomic units by sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def otu_table(members: DataFrame, samples: list[str], lineages: DataFrame | None = None) -> DataFrame:
    """otu and a column of summed frequencies a sample, 0 for none; units without any are left out. members: otu,
    sample, freq. The samples are given, so no job is needed to find the columns."""
    table = members.groupBy("otu").pivot("sample", samples).agg(F.sum("freq")).fillna(0, samples)
    table = table.where(" + ".join(f"`{s}`" for s in samples) + " > 0")
    return table.join(lineages, "otu", "left") if lineages is not None else table


def sample_order(samples: list[str]) -> list[str]:
    """By the number at the end of the names."""
    digits = lambda s: int("0" + "".join(c for c in s if c.isdigit())[-9:])
    return sorted(samples, key=lambda s: (digits(s), s))


def otu_typical(members: DataFrame) -> DataFrame:
    """otu, seq of the largest weight (the first of equals, the last by text on one place) and total weight. members: otu, pos, weight, seq."""
    return members.groupBy("otu").agg(F.max_by("seq", F.struct("weight", (-F.col("pos")).alias("_n"), "seq")).alias("seq"), F.sum("weight").alias("weight"))
