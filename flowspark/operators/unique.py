"""Distinct patterns and sequences.

The collapse of prefixes goes by a greedy order: each sequence in turn, if it is still there, takes up the shorter ones
behind it that it begins with, up to the first one behind it that begins with it (or equals it); there it joins that one.
What comes of it can be said without going through the list. Of the sequences that a text x begins strictly, let f(x) be
the least place (first row of the longer one; none where x is maximal), and via(x) the one that has it.

- Rows of x before f(x) are still there when their turn comes. They join each other and then via(x), so they end where
  via(x) ends: root(x) = root(via(x)), and a maximal text ends in its own last row.
- A row of x at place o behind f(x) is taken up by a row of some longer s that is there (first(s) < o < f(s)), and ends
  in root(s). Where several s with different roots could, it is the one whose last row before o comes first.

So the work is one join that finds the longer sequences of each distinct text, by hashes of the first 2**c letters (c
from the shorter's length) and a check of the whole, and pointer jumping along via. Texts that share a primer and no more
do not meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.flows import homopolymers
from .ordinals import with_ordinal
from .stage import staged


def calc_unique(reads: DataFrame, width: int | None = None, block: str | None = None) -> DataFrame:
    """Distinct rounded patterns of reads (ord, len, flows), numbered by their first read: u_id, pattern, first_ord,
    len_u (of the first read), weight. Patterns are brought to width with zeros where it is given. Without a block they
    are sorted over all tasks and numbered by partitions."""
    pattern = homopolymers("flows")
    if width:
        pattern = F.slice(F.concat(pattern, F.array_repeat(F.lit(0), width)), 1, width)
    by = [block] if block else []
    groups = reads.withColumn("pattern", pattern).groupBy(*by, "pattern").agg(F.min("ord").alias("first_ord"), F.min_by("len", "ord").alias("len_u"), F.count(F.lit(1)).alias("weight"))
    if block:
        return groups.withColumn("u_id", F.row_number().over(Window.partitionBy(block).orderBy("first_ord")) - 1)
    return with_ordinal(groups.orderBy("first_ord"), "u_id")


def _longer(distinct: DataFrame, by: list[str]) -> DataFrame:
    """x, s, first: of each distinct text (last, first, seq) the ones that it begins strictly, by their last rows."""
    size = F.length("seq")
    kind = F.length(F.bin(size.cast("bigint"))) - F.when(size > 0, 1).otherwise(2)  # -1 for the empty text
    head = lambda c: F.xxhash64(F.substring("seq", 1, F.when(c < 0, 0).otherwise(F.expr("cast(pow(2, _c) as int)"))))
    short = distinct.withColumn("_c", kind.cast("int")).select(*by, "_c", head(F.col("_c")).alias("_h"), F.col("last").alias("x"), size.alias("_x"))
    long = distinct.withColumn("_c", F.explode(F.sequence(F.lit(-1), kind.cast("int")))).select(*by, "_c", head(F.col("_c")).alias("_h"), F.col("last").alias("s"), F.col("first"), size.alias("_s"))
    near = short.join(long, [*by, "_c", "_h"]).where("_s > _x").select("x", "s", "first")
    text = lambda k: distinct.select(F.col("last").alias(k), F.col("seq").alias(f"_{k}"))
    return near.join(text("x"), "x").join(text("s"), "s").where(F.col("_s").startswith(F.col("_x"))).select("x", "s", "first")


def _ends(steps: DataFrame) -> DataFrame:
    """id, to: where the steps (id, to; to = id at an end) lead, by doubling them until nothing moves."""
    while True:
        on = staged(steps.alias("a").join(steps.alias("b"), F.col("a.to") == F.col("b.id")).select("a.id", F.col("b.to").alias("to"), (F.col("a.to") != F.col("b.to")).alias("_moved")))
        steps = on.drop("_moved")
        if not on.where("_moved").limit(1).count():
            return steps


def fasta_unique(seqs: DataFrame, block: str | None = None) -> DataFrame:
    """seqs (ord, seq_id, seq, and block where given: each by itself) with the sequence that each one collapses into: ord,
    seq_id, rep_ord, rep_id. ord is unique. A null seq counts as empty."""
    by = [block] if block else []
    seqs = seqs.select(*by, "ord", "seq_id", F.coalesce("seq", F.lit("")).alias("seq"))
    distinct = staged(seqs.groupBy(*by, "seq").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.max_by("seq_id", "ord").alias("last_id")))
    longer = staged(_longer(distinct, by))
    before = longer.groupBy("x").agg(F.min("first").alias("f"), F.min_by("s", "first").alias("via"))
    known = staged(distinct.join(before, F.col("last") == F.col("x"), "left").select(*by, "seq", "first", "last", "last_id", "f", "via"))
    roots = _ends(known.select(F.col("last").alias("id"), F.coalesce("via", "last").alias("to")))
    above = longer.join(roots, F.col("s") == F.col("id")).groupBy("x").agg((F.min("to") != F.max("to")).alias("_forked"))
    told = known.join(roots, F.col("last") == F.col("id")).join(above, F.col("last") == F.col("x"), "left").select(*by, "seq", "f", F.col("last").alias("_x"), F.col("to").alias("root"), F.coalesce("_forked", F.lit(False)).alias("_forked"))
    rows = staged(seqs.join(told, [*by, "seq"]).withColumn("_late", F.col("_forked") & (F.col("ord") > F.col("f"))).drop("seq", "f", "_forked"))

    # rows behind f(x) of texts below several roots: the longer texts that are there, and their last rows before
    late = rows.where("_late").select("ord", "_x").join(longer, F.col("_x") == F.col("x")).where("first < ord")
    state = known.select(F.col("last").alias("s"), (F.col("first") < F.col("last")).alias("_many"), F.col("f").alias("_f"))
    there = staged(late.select("ord", "s", "first").join(state, "s").where("_f IS NULL OR ord < _f"))
    many = there.where("_many").select("ord", "s")
    own = rows.join(many.select(F.col("s").alias("_x")).distinct(), "_x", "left_semi").select("ord", F.col("_x").alias("s"), F.col("ord").alias("_row"))
    line = Window.partitionBy("s").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = own.unionByName(many.withColumn("_row", F.lit(None).cast("bigint"))).withColumn("_at", F.max("_row").over(line)).where("_row IS NULL").select("ord", "s", "_at")
    placed = there.where("NOT _many").select("ord", "s", F.col("first").alias("_at")).unionByName(last)
    taken = placed.groupBy("ord").agg(F.min_by("s", "_at").alias("s")).join(roots, F.col("s") == F.col("id")).select("ord", F.col("to").alias("_root"))

    ended = rows.where("NOT _late").select(*by, "ord", "seq_id", F.col("root").alias("rep_ord")).unionByName(rows.where("_late").join(taken, "ord").select(*by, "ord", "seq_id", F.col("_root").alias("rep_ord")))
    return ended.join(distinct.select(F.col("last").alias("rep_ord"), F.col("last_id").alias("rep_id")), "rep_ord").select(*by, "ord", "seq_id", "rep_ord", "rep_id")


def unique_map(collapsed: DataFrame) -> DataFrame:
    """rep_ord, u, rep_id, n, members, member_ids, the representatives numbered in order. Members are one line of the
    format, so a group is one row."""
    groups = collapsed.groupBy("rep_ord", "rep_id").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("ord", "seq_id"))).alias("_m"))
    return with_ordinal(groups.orderBy("rep_ord"), "u").select("rep_ord", F.col("u").cast("int").alias("u"), "rep_id", "n", F.col("_m.ord").alias("members"), F.col("_m.seq_id").alias("member_ids"))
