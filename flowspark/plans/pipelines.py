"""From reads to denoised sequences, chimera-free sequences and tables. Every step takes a block column, so many
samples run side by side."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chimera, clean, cluster, em, pairs, unique
from ..operators.ordinals import with_ordinal
from ..operators.stage import staged


def _numbered(rows: DataFrame, block: str, order: str = "ord") -> DataFrame:
    """Ordinals from 0 within each block."""
    return rows.withColumn("_source", F.col("ord")).withColumn("ord", F.row_number().over(Window.partitionBy(block).orderBy(order)) - 1)


def _lone(rows: DataFrame, clusters: DataFrame, block: str) -> DataFrame:
    """Clusters with those of blocks of one item, which have no pairs."""
    lone = rows.groupBy(block).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return clusters.select(block, "cluster", "pos", "member").unionByName(lone.select(block, F.lit(0).alias("cluster"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("member")))


def flow_denoise_plan(reads: DataFrame, block: str, primer: str = ".", min_flows: int = 320, max_flows: int = 720, max_empty: int = 0, sigma: float = 60.0, cutoff: float = 0.01, lookup: np.ndarray | None = None) -> DataFrame:
    """Clean, compare, cluster and denoise the reads (block, ord, read_id, clip, flows)."""
    cleaned = clean.clean_reads(reads, primer, min_flows, max_flows, max_empty).where("passed").drop("passed", "seq")
    rows = staged(_numbered(cleaned, block))
    distances = pairs.flows_by_tile(rows, lookup, block)
    clusters = _lone(rows, cluster.cut_at(cluster.linkage(distances, block), block, cutoff), block)
    return em.flow_denoise(rows, clusters, block, sigma, lookup)


def sequence_denoise_plan(seqs: DataFrame, block: str, sigma: float = 30.0, cutoff: float = 0.08, table: np.ndarray | None = None, length: int | None = None) -> DataFrame:
    """Compare, cluster and denoise weighted sequences (block, ord, seq_id, weight, seq), cut to length first."""
    rows = _numbered(seqs.withColumn("seq", F.substring("seq", 1, length)) if length else seqs, block)
    rows = staged(rows)
    distances = pairs.sequences_by_value(rows, table, block)
    distances = pairs.ByValue(distances.rows, staged(distances.pairs))
    clusters = _lone(rows, cluster.cut_at(cluster.linkage(distances, block), block, cutoff), block)
    return em.sequence_denoise(rows, distances, clusters, block, sigma)


def split_plan(seqs: DataFrame, block: str, most: int = 5000, least: int = 1000) -> DataFrame:
    """block, ord, split, seq_id: even blocks for large samples. The sequences of each block by itself are collapsed,
    compared by identity, clustered by average linkage, and the tree is split. (block, ord) names a sequence."""
    rows = seqs.select(block, F.col("ord").alias("_own"), "seq_id", "seq")
    # the collapse needs one number a sequence over all blocks
    rows = staged(with_ordinal(rows.orderBy(block, "_own")))
    collapsed = staged(unique.fasta_unique(rows, block))
    reps = staged(_numbered(rows.join(collapsed.where("ord = rep_ord").select("ord"), "ord", "left_semi"), block))
    merges = cluster.linkage(pairs.identities_by_value(reps, block), block, "average")
    parts = cluster.split_even(merges, block, most, least)
    lone = reps.groupBy(block).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1").select(block, F.lit("C000").alias("split"), F.lit(0).alias("pos"), F.lit(0).cast("long").alias("member"))
    named = parts.unionByName(lone).join(reps.select(block, F.col("ord").alias("member"), F.col("_source").alias("rep_ord")), [block, "member"])
    return collapsed.join(named.select("rep_ord", "split"), "rep_ord").join(rows.select("ord", F.col("_own")), "ord").select(block, F.col("_own").alias("ord"), "split", "seq_id")


def full_plan(reads: DataFrame, block: str, primer: str = ".", min_flows: int = 320, max_flows: int = 720, most: int = 5000, least: int = 1000, **options) -> DataFrame:
    """Large samples: split evenly, denoise the flows of each part, then the sequences of each sample. (block, ord) names
    a read."""
    cleaned = clean.clean_reads(reads, primer, min_flows, max_flows).where("passed")
    seqs = staged(cleaned.select(block, "ord", F.col("read_id").alias("seq_id"), "seq"))
    parts = staged(split_plan(seqs, block, most, least).select(block, "ord", "split"))
    split = reads.join(parts, [block, "ord"]).withColumn("_part", F.struct(block, "split"))
    # a part is a block of its own; its name carries the sample's
    split = split.withColumn("_part", F.to_json("_part"))
    denoised = flow_denoise_plan(split, "_part", primer, min_flows, max_flows, **options)
    sample = F.from_json("_part", f"struct<`{block}`:{dict(reads.dtypes)[block]},split:string>")
    back = denoised.withColumn("_p", sample).withColumn(block, F.col("_p").getField(block)).withColumn("_split", F.col("_p.split")).where(F.length("sequence") > 0)
    weighted = back.select(block, F.struct("_split", "cluster").alias("ord"), F.concat_ws("_", F.col(block).cast("string"), "_split", F.col("cluster").cast("string"), F.col("weight").cast("string")).alias("seq_id"), "weight", F.col("sequence").alias("seq"))
    return sequence_denoise_plan(weighted, block)


def chimera_plan(seqs: DataFrame, block: str, primer: str | None = None, alpha: float = -7.5, beta: float = 0.5, below: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(good, chimeras) of weighted sequences (block, ord, seq_id, freq, seq)."""
    from ..functions.sequences import strip_primer

    rows = seqs.withColumn("seq", strip_primer("seq", primer)) if primer else seqs
    # both sides read it
    judged = staged(chimera.classify(chimera.chimera_check(rows, block), alpha, beta).select(F.col("i").alias("ord"), "p"))
    return chimera.good_class_filter(seqs, judged, "ord", below)


def otu_plan(seqs: DataFrame, block: str, cutoff: float = 0.03) -> DataFrame:
    """block, cluster, member: units by average linkage of identity distances."""
    rows = staged(_numbered(seqs, block))
    merges = cluster.linkage(pairs.identities_by_value(rows, block), block, "average")
    found = _lone(rows, cluster.cut_at(merges, block, cutoff), block)
    return found.join(rows.select(block, F.col("ord").alias("member"), "seq_id", "_source"), [block, "member"]).select(block, "cluster", "pos", F.col("_source").alias("member"), "seq_id")
