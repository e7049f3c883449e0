"""Mappings from clusters to reads, weighted records, samples and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import parse_wheader, read_weight


def merge_mapping(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """outer (cluster_id, ord, members: inner cluster ids) with the inner clusters' members instead, in order. A member
    that inner does not have is an error."""
    steps = outer.select("cluster_id", "ord", F.posexplode("members").alias("_pos", "_member"))
    joined = steps.join(inner.select(F.col("cluster_id").alias("_member"), F.col("members").alias("_found")), "_member", "left")
    joined = joined.withColumn("_found", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("no such cluster: "), "_member")).cast("array<string>")).otherwise(F.col("_found")))
    packed = joined.groupBy("cluster_id", "ord").agg(F.sort_array(F.collect_list(F.struct("_pos", "_found"))).alias("_all"))
    return packed.select("cluster_id", "ord", F.flatten("_all._found").alias("members"))


def output_mapping(sequences: DataFrame, mapping: DataFrame) -> DataFrame:
    """cluster, centre (inner cluster of the medoid), members: raw reads. sequences: cluster, medoid, member_ords (by
    the place of the inner clusters); mapping: ord, cluster_id, members."""
    steps = sequences.select("cluster", "medoid", F.posexplode("member_ords").alias("_pos", "ord"))
    packed = steps.join(mapping.select("ord", "members"), "ord").groupBy("cluster", "medoid").agg(F.sort_array(F.collect_list(F.struct("_pos", "members"))).alias("_all"))
    names = mapping.select(F.col("ord").alias("medoid"), F.col("cluster_id").alias("centre"))
    return packed.join(names, "medoid").select("cluster", "centre", F.flatten("_all.members").alias("members"))


def redup(sequences: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each denoised sequence once for each original read: read_id, seq, cluster_id."""
    return sequences.join(mapping, "cluster_id").select(F.explode("members").alias("read_id"), "seq", "cluster_id")


def list_to_reads(levels: DataFrame, names: DataFrame, cutoff_level: int) -> DataFrame:
    """otu, reads at a level of cuts (level, cluster, members by ordinal). names: member, read."""
    at = levels.where(F.col("level") == cutoff_level).select(F.col("cluster").alias("otu"), F.posexplode("members").alias("_pos", "member"))
    packed = at.join(names, "member").groupBy("otu").agg(F.sort_array(F.collect_list(F.struct("_pos", "read"))).alias("_all"))
    return packed.select("otu", F.col("_all.read").alias("reads"))


def scan_list(levels: DataFrame, cutoff: float, resolution: float = 0.01) -> DataFrame:
    """cluster, member of the level whose cutoff is the given one; no such level is an error."""
    level = round(cutoff / resolution)
    found = levels.where(F.col("level") == level)
    if not found.limit(1).count():
        raise ValueError(f"no level with cutoff {cutoff}")
    return found.select("cluster", F.explode("members").alias("member"))


def count_weighted(records: DataFrame, header: str) -> DataFrame:
    return records.agg(F.sum(read_weight(header)).alias("n"))


def min_frequency(records: DataFrame, header: str, least: int) -> DataFrame:
    return records.where(parse_wheader(header)["frequency"] >= least)


def wfasta_repeat(records: DataFrame, header: str, seq: str) -> DataFrame:
    """Each weighted record as often as its frequency: id (with a number behind), seq."""
    n = parse_wheader(header)["frequency"]
    numbered = records.where(n > 0).select(F.col(header), F.col(seq), F.explode(F.sequence(F.lit(0), n - 1)).alias("_k"))
    return numbered.select(F.concat_ws("_", header, F.col("_k").cast("string")).alias("id"), F.col(seq).alias("seq"))


def wfasta_table(records: DataFrame, header: str, seq: str) -> DataFrame:
    return records.select(parse_wheader(header).alias("_h"), F.col(seq).alias("sequence")).select("_h.id", "_h.index", "_h.frequency", "sequence")


def dat_join(*tables: DataFrame) -> DataFrame:
    """Tables of (ord, len, flows) one after another, numbered anew: each keeps its own numbers behind those of the
    tables before. Numbers are places in a file, 0 ... n - 1; a table with others is numbered in their order first."""
    from functools import reduce

    from .ordinals import with_ordinal

    start, parts = 0, []
    for t in tables:
        t = t.select("ord", "len", "flows")
        n, last = t.agg(F.count(F.lit(1)), F.max("ord")).first()
        if n and last + 1 != n:
            t = with_ordinal(t.orderBy("ord"), "_new").select(F.col("_new").alias("ord"), "len", "flows")
        parts.append(t.select((F.col("ord") + F.lit(start).cast("bigint")).alias("ord"), "len", "flows"))
        start += n
    return reduce(DataFrame.unionByName, parts)


def sample_n(records: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """Exactly n rows (all, where there are fewer) without replacement, in their order; the same rows on each run."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ord").cast("string")))
    return records.orderBy(key, "ord").limit(n).orderBy("ord")


def chunk(records: DataFrame, total: int, parts: int, offset: int = 0) -> DataFrame:
    """records from offset on with chunk: runs of (total - offset) // parts; the first chunk has the remainder too."""
    size, rest = divmod(total - offset, parts)
    place = F.col("ord") - offset
    number = F.when(place < size + rest, F.lit(0)).otherwise(F.floor((place - rest) / max(size, 1)))
    return records.where(place >= 0).withColumn("chunk", number.cast("int"))
