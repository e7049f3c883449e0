"""Mixing sources to target weights by systematic sampling.

Each source has a target number of words. A document's expected number of copies is target / size of its
source, the same for all documents of the source. The documents of a source stand in a fixed order (by size
class, eight to a doubling, then by a hash of doc_id), the expected copies are summed along it from one
pseudo-random offset in [0, 1), and a document is emitted once for each integer that its own step crosses. As
neighbours in the order have like sizes, the words taken stay near the target.

The running sum needs each document's rank in its source. No task holds a source: the rank is the number of
documents in earlier size classes, plus that in earlier buckets of the class, plus the rank within the bucket.
A bucket is a range of the hash; there are the more buckets the more rows, about 65536 rows to a class and bucket
at most, and the order does not depend on their number.

Nulls: a null text has size 0 and takes nothing; a null source is a source of its own, last in order; rows without
doc_id are ordered by a hash of the whole row. Rows of one doc_id are ordered by size and that hash, so only equal
rows are ever exchanged and reruns agree. Equal rows each have a place of their own. An empty table gives an empty
result. Other columns are kept whatever they are called, but for source_size, target and copies, whose place the
operator's columns take.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import WORD, cut, table

#: Rows of a bucket, and the least and most bits of the hash that name one.
ROWS, LEAST_BITS, MOST_BITS = 1 << 16, 6, 20


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Of source, source_size (a row a source): adds target. Weights repeat cycle along the sources in code
    point order, null last; the sum of all sizes is shared by weight; no target passes most times its
    source's size, and what is over goes to the others by weight until none is above."""
    w = F.element_at(F.array(*map(F.lit, cycle)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(cycle) + 1).cast("int"))
    t = totals.withColumn("_w", w.cast("double")).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    t = t.withColumn("_at", F.row_number().over(order)).withColumn("_level", (F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    level = F.min_by("_level", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.col("_at"))).over(Window.partitionBy())
    return t.withColumn("target", F.coalesce(F.least("_cap", level * F.col("_w")), F.col("_cap"))).drop("_w", "_cap", "_at", "_level")


def _row_hash(docs: DataFrame) -> Column:
    """A hash of the whole row; maps have none of their own."""
    return F.xxhash64(F.to_json("_row") if "map<" in docs.schema.simpleString() else F.col("_row"))


def mix(docs: DataFrame, seed: int = 17, cycle: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """docs (doc_id, source, size and any others) with source_size, target and copies."""
    bits = min(MOST_BITS, max(LEAST_BITS, (docs.count() // ROWS).bit_length()))
    kept = [c for c in docs.columns if c not in ("source_size", "target", "copies")]
    field = lambda c: F.col("_row").getField(c)
    size, digits = F.col("_size"), F.length(F.bin("_size"))
    name = F.coalesce(field("doc_id").cast("string"), F.concat(F.lit("row "), F.col("_mark").cast("string")))
    sized = docs.select(F.struct("*").alias("_row")).withColumns({"_mark": _row_hash(docs), "_size": field("size").cast("long"), "source": field("source")}).withColumns({
        "_key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")),
        "_class": F.when(size < 8, size).otherwise(digits * 8 + F.expr("shiftright(_size, length(bin(_size)) - 4)") % 8),
        "_order": F.md5(name.cast("binary")),
    }).withColumn("_sub", F.shiftright(F.conv(F.substring("_order", 1, 5), 16, 10).cast("int"), 20 - bits))
    buckets = sized.groupBy("_key", "_class", "_sub").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words"), F.max("source").alias("source"))
    classes = buckets.groupBy("_key", "_class").agg(F.sum("_n").alias("_n"), F.sum("_words").alias("_words"), F.max("source").alias("source"))
    earlier = lambda window: F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = targets(classes.groupBy("_key").agg(F.max("source").alias("source"), F.sum("_words").alias("source_size")), cycle, most)
    start = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}"), F.col("_key"))), 1, 5), 16, 10).cast("double") + 0.5) / float(1 << 20)
    totals = totals.select("_key", "source_size", "target", start.alias("_start"))
    classes = classes.select("_key", "_class", earlier(Window.partitionBy("_key").orderBy("_class")).alias("_classes")).join(totals, "_key")
    buckets = buckets.select("_key", "_class", "_sub", earlier(Window.partitionBy("_key", "_class").orderBy("_sub")).alias("_subs")).join(classes, ["_key", "_class"])
    joined = sized.drop("source").join(buckets, ["_key", "_class", "_sub"])
    within = Window.partitionBy("_key", "_class", "_sub").orderBy("_order", "_size", "_mark")
    rank = F.col("_classes") + F.col("_subs") + F.row_number().over(within)
    step = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = joined.withColumn("_rank", rank).withColumn("_step", step)
    copies = F.floor(F.col("_start") + F.col("_step") * F.col("_rank")) - F.floor(F.col("_start") + F.col("_step") * (F.col("_rank") - 1))
    return joined.select(*(field(c).alias(c) for c in kept), "source_size", "target", F.least(copies, F.lit(int(most))).alias("copies"))


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    # sizes are read twice, by the bucket counts and by the ranks; the texts only once
    out = mix(cut(table(spark, sf_dir, "documents").select("doc_id", "source", n_words("text").alias("size")), "sizes"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
b AS (SELECT *, COALESCE('=' || source, '') AS k,
        CASE WHEN size < 8 THEN size ELSE length(bin(size)) * 8 + (size >> (length(bin(size)) - 4)::INT) % 8 END AS c,
        md5(doc_id::VARCHAR) AS h FROM d),
t AS (SELECT k, max(source) AS source, sum(size)::BIGINT AS source_size FROM b GROUP BY k),
w AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM t),
l AS (SELECT *, row_number() OVER o AS pos,
        ((sum(source_size) OVER ())::DOUBLE - COALESCE(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
      FROM w WINDOW o AS (ORDER BY cap / w, source ASC NULLS LAST)),
g AS (SELECT k, source_size, COALESCE(least(cap, (SELECT min_by(lev, pos) FROM l WHERE lev * w <= cap) * w), cap) AS target,
        (('0x' || substr(md5('17' || k), 1, 5))::BIGINT::DOUBLE + 0.5) / 1048576.0::DOUBLE AS u FROM l),
r AS (SELECT b.*, row_number() OVER (PARTITION BY k ORDER BY c, h, size) AS rank FROM b),
x AS (SELECT doc_id, size, source_size, target, u, rank, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS step FROM r JOIN g USING (k)),
y AS (SELECT *, least(floor(u + step * rank) - floor(u + step * (rank - 1)), 3)::BIGINT AS copies FROM x)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM y
"""
