"""The queries over the test tables, and their SQL."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from . import oracles
from .functions import flows as fl
from .functions import kernels as K
from .functions import sequences as sq
from .operators import chimera, clean, cluster, em, mapping, ordinals, otu, pairs, split, unique
from .operators.stage import dealt, shared_folder, staged
from .plans import pipelines
from .sources import sff, sinks, text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return register


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _text(array) -> F.Column:
    return F.array_join(F.col(array).cast("array<string>") if isinstance(array, str) else array.cast("array<string>"), ",")


_SEQ = "array_to_string(list_transform({f}, lambda x, i: repeat(substr('TACG', ((i - 1) % 4 + 1)::INT, 1), ((x + 50) // 100)::INT)), '')"


def _one(f: str, of: str = "reads") -> str:
    return f"WITH {ad.KEYED} SELECT ord, {f} FROM {of}"


# ---------------------------------------------------------------- flows


@query(_one(_SEQ.format(f="flows") + " AS seq"))
def flow_to_seq(spark, d) -> DataFrame:
    return ad.reads(spark, d).select("ord", fl.flow_to_seq("flows").alias("seq"))


@query(_one("array_to_string(list_transform(flows, lambda x, i: list_sum(flows[1:i])::BIGINT), ',') AS sums"))
def cumsum(spark, d) -> DataFrame:
    return ad.reads(spark, d).select("ord", _text(fl.cumsum("flows")).alias("sums"))


@query(_one("list_sum(list_transform(flows[1:5], lambda x: 1 + x % 3))::INT AS clip_left, list_sum(list_transform(flows[1:clip], lambda x: 1 + x % 3))::INT AS clip_right"))
def find_clip(spark, d) -> DataFrame:
    rows = ad.reads(spark, d).withColumn("steps", F.transform("flows", lambda x: 1 + x % 3)).withColumn("left", F.lit(4))
    return rows.select("ord", fl.find_clip("steps", "left", "clip").alias("c")).select("ord", F.col("c.left").alias("clip_left"), F.col("c.right").alias("clip_right"))


@query(_one(_SEQ.format(f="flows[1:clip]") + " AS seq"))
def bases_from_flows(spark, d) -> DataFrame:
    return ad.reads(spark, d).select("ord", fl.bases_from_flows("flows", F.col("clip")).alias("seq"))


@query(_one("array_to_string(list_transform(flows, lambda x: printf('%.2f', x / 100.0::DOUBLE)), ' ') AS line"))
def flows_to_string(spark, d) -> DataFrame:
    return ad.reads(spark, d).select("ord", fl.flows_to_string("flows").alias("line"))


@query("SELECT vec_id AS ord, array_to_string(list_transform(embedding, lambda x: trunc(x::DOUBLE * 100)::INT), ',') AS cut_off, array_to_string(list_transform(embedding, lambda x: floor(x::DOUBLE * 100 + 0.5)::INT), ',') AS rounded FROM embeddings")
def cast_hundredths(spark, d) -> DataFrame:
    values = F.transform("embedding", lambda x: x.cast("double"))
    return ad.table(spark, d, "embeddings").select(F.col("vec_id").alias("ord"), _text(fl.cast_hundredths(values, exact=False)).alias("cut_off"), _text(fl.cast_hundredths(values)).alias("rounded"))


@query(_one("array_to_string(list_transform(flows, lambda x: ((x + 50) // 100)::INT), ',') AS pattern"))
def round_pattern(spark, d) -> DataFrame:
    return ad.reads(spark, d).select("ord", _text(fl.homopolymers("flows")).alias("pattern"))


@query(_one("regexp_replace(" + _SEQ.format(f="flows[1:len]") + ", '^TCAG', '') AS seq", "keyed"))
def dat_to_fasta(spark, d) -> DataFrame:
    rows = ad.keyed_reads(spark, d)
    return rows.select("ord", F.regexp_replace(fl.flow_to_seq(F.slice("flows", 1, F.col("len"))), f"^{fl.KEY}", "").alias("seq"))


_QUADS = f"WITH {ad.KEYED}, q AS (SELECT ord, k, flows[k * 4 + 1 : k * 4 + 4] AS g FROM reads, unnest(range(0, 16)) AS t(k)) SELECT ord, k::INT AS quad, "
_EMPTY, _HIGH, _AMB = "list_max(g) < 50", "list_max(g) > 300", "len(list_filter(g, lambda x: x > 50 AND x < 70)) > 0"


def _quads(spark, d) -> DataFrame:
    return ad.reads(spark, d).select("ord", F.posexplode(fl.quads("flows")).alias("quad", "g"))


@query(_QUADS + f"({_EMPTY}) AS hit FROM q")
def flowgram_is_empty(spark, d) -> DataFrame:
    return _quads(spark, d).select("ord", "quad", fl.flowgram_is_empty(F.col("g")).alias("hit"))


@query(_QUADS + f"({_HIGH}) AS hit FROM q")
def flowgram_is_high(spark, d) -> DataFrame:
    return _quads(spark, d).select("ord", "quad", fl.flowgram_is_high(F.col("g"), 300).alias("hit"))


@query(_QUADS + f"({_AMB}) AS hit FROM q")
def flowgram_is_ambiguous(spark, d) -> DataFrame:
    return _quads(spark, d).select("ord", "quad", fl.flowgram_is_ambiguous(F.col("g")).alias("hit"))


@query(_QUADS + f"(NOT ({_EMPTY} OR {_HIGH} OR {_AMB})) AS hit FROM q")
def flowgram_is_valid(spark, d) -> DataFrame:
    return _quads(spark, d).select("ord", "quad", fl.flowgram_is_valid(F.col("g"), 300).alias("hit"))


_KEPT = f"""kq AS (SELECT ord, k, flows[k * 4 + 1 : least(k * 4 + 4, clip)] AS g FROM keyed, unnest(range(0, 18)) AS t(k) WHERE k * 4 < clip),
bad AS (SELECT ord, min(k) AS k FROM kq WHERE {_EMPTY} OR list_max(g) > 949 OR {_AMB} GROUP BY ord),
kept AS (SELECT r.*, r.flows[1 : CASE WHEN bad.k IS NULL THEN clip ELSE bad.k * 4 END] AS kept FROM keyed r LEFT JOIN bad USING (ord))"""


@query(f"WITH {ad.KEYED}, {_KEPT} SELECT ord, array_to_string(kept, ',') AS kept FROM kept")
def clean_prefix(spark, d) -> DataFrame:
    rows = ad.keyed_reads(spark, d)
    return rows.select("ord", _text(fl.clean_prefix(F.slice("flows", 1, F.col("clip")))).alias("kept"))


_CLEANED = f"""cleaned AS (SELECT ord, read_id, regexp_extract({_SEQ.format(f="kept")}, '^TCAG.*?([CT][AG].*)', 1) AS seq, (ceil(least(len(kept), 40) / 4.0) * 4)::INT AS len, flows[1:40] AS flows,
  (len(kept) >= 12 AND regexp_matches({_SEQ.format(f="kept")}, '^TCAG.*?([CT][AG].*)')) AS passed FROM kept)"""


def _cleaned(spark, d) -> DataFrame:
    return clean.clean_reads(ad.keyed_reads(spark, d), "YR", 12, 40)


@query(f"WITH {ad.KEYED}, {_KEPT}, {_CLEANED} SELECT ord, read_id, seq, len, array_to_string(flows, ',') AS flows FROM cleaned WHERE passed")
def clean_reads(spark, d) -> DataFrame:
    return _cleaned(spark, d).where("passed").select("ord", "read_id", "seq", "len", _text("flows").alias("flows"))


@query(f"WITH {ad.KEYED}, {_KEPT}, {_CLEANED} SELECT count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed FROM cleaned")
def pass_fail(spark, d) -> DataFrame:
    return clean.pass_fail(_cleaned(spark, d))


# ---------------------------------------------------------------- sequences

_S = f"WITH {ad.SEQS} SELECT ord, "


@query(_S + "CASE WHEN starts_with(seq, 'CAC') THEN substr(seq, 4, 17) ELSE substr(seq, 1, 20) END AS seq FROM seqs")
def truncate_tag(spark, d) -> DataFrame:
    return ad.seqs(spark, d).select("ord", sq.truncate_tag("seq", "GGCAC", 20).alias("seq"))


@query(_S + "substr(regexp_extract(seq, 'CA(.*)', 1), 1, 15) AS seq FROM seqs")
def parse_tag(spark, d) -> DataFrame:
    return ad.seqs(spark, d).select("ord", sq.parse_tag("seq", "GCA", 15).alias("seq"))


@query(_S + "substr(seq, 1, 25) AS seq FROM seqs")
def truncate_len(spark, d) -> DataFrame:
    return ad.seqs(spark, d).select("ord", F.substring("seq", 1, 25).alias("seq"))


@query(_S + "regexp_replace(seq, '^[AG][CT]', '') AS seq FROM seqs")
def strip_primer(spark, d) -> DataFrame:
    return ad.seqs(spark, d).select("ord", sq.strip_primer("seq", "RY").alias("seq"))


@query("""SELECT p_partkey AS ord, array_to_string(list_transform(string_split(upper(p_name), ''), lambda c: CASE c WHEN 'R' THEN '[AG]' WHEN 'Y' THEN '[CT]' WHEN 'K' THEN '[GT]' WHEN 'M' THEN '[AC]'
  WHEN 'S' THEN '[CG]' WHEN 'W' THEN '[AT]' WHEN 'B' THEN '[CGT]' WHEN 'D' THEN '[AGT]' WHEN 'H' THEN '[ACT]' WHEN 'V' THEN '[ACG]' WHEN 'N' THEN '[ACGT]' ELSE c END), '') AS pattern FROM part""")
def iupac_pattern(spark, d) -> DataFrame:
    return ad.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), sq.iupac_column("p_name").alias("pattern"))


_W = f"WITH {ad.WEIGHTED} "
_H = r"regexp_extract(header, '^(.*?)_(\d+)_(\d+)$', {k})"


@query(_W + f"SELECT ord, {_H.format(k=1)} AS id, {_H.format(k=2)}::INT AS \"index\", {_H.format(k=3)}::INT AS frequency FROM weighted")
def parse_wheader(spark, d) -> DataFrame:
    return ad.weighted(spark, d).select("ord", sq.parse_wheader("header").alias("h")).select("ord", "h.*")


@query(_W + "SELECT ord, COALESCE(TRY_CAST(NULLIF(regexp_extract(header, '_([0-9.]+)$', 1), '') AS DOUBLE), 1.0) AS weight FROM weighted")
def read_weight(spark, d) -> DataFrame:
    return ad.weighted(spark, d).select("ord", sq.read_weight("header").alias("weight"))


@query(_W + f"SELECT ord, header FROM weighted WHERE {_H.format(k=3)}::INT >= 25")
def min_frequency(spark, d) -> DataFrame:
    return mapping.min_frequency(ad.weighted(spark, d), "header", 25).select("ord", "header")


@query(_W + f"SELECT sum({_H.format(k=3)}::DOUBLE) AS n FROM weighted")
def count_weighted(spark, d) -> DataFrame:
    return mapping.count_weighted(ad.weighted(spark, d), "header")


@query("SELECT count(*) AS n FROM documents")
def count_sequences(spark, d) -> DataFrame:
    return ad.seqs(spark, d).agg(F.count(F.lit(1)).alias("n"))


@query(_W + f"SELECT header || '_' || k AS id, seq FROM weighted, unnest(range(0, {_H.format(k=3)}::BIGINT)) AS t(k)")
def wfasta_repeat(spark, d) -> DataFrame:
    return mapping.wfasta_repeat(ad.weighted(spark, d), "header", "seq")


@query(_W + f"SELECT {_H.format(k=1)} AS id, {_H.format(k=2)}::INT AS \"index\", {_H.format(k=3)}::INT AS frequency, seq AS sequence FROM weighted")
def sink_wfasta_tab(spark, d) -> DataFrame:
    return mapping.wfasta_table(ad.weighted(spark, d), "header", "seq")


# ---------------------------------------------------------------- splitting

_BARCODES = [("s_ac", "AC", "RN"), ("s_ag", "AG", "NN"), ("s_ac2", "AC", "AN"), ("s_ct", "CT", "Y")]
_BASES = "bases AS (SELECT ord, 'TCAG' || seq AS bases FROM seqs)"
_SPLIT = """hit AS (SELECT ord, substr(bases, 5, 2) AS bc, substr(bases, 7) AS rest FROM bases),
split AS (SELECT ord, CASE WHEN bc = 'AC' AND regexp_matches(rest, '^A[ACGT]') THEN 's_ac2' WHEN bc = 'AC' AND regexp_matches(rest, '^[AG][ACGT]') THEN 's_ac' WHEN bc = 'AG' AND regexp_matches(rest, '^[ACGT][ACGT]') THEN 's_ag'
  WHEN bc = 'CT' AND regexp_matches(rest, '^[CT]') THEN 's_ct' ELSE 'unmatched' END AS sample FROM hit)"""


def _split(spark, d, equal: bool = True) -> DataFrame:
    codes = spark.createDataFrame([(k, *row) for k, row in enumerate(_BARCODES)], "ord int, name string, barcode string, primer string")
    codes = codes.withColumn("primer_re", sq.iupac_column("primer"))
    rows = ad.seqs(spark, d).select("ord", F.concat(F.lit(fl.KEY), "seq").alias("bases"))
    return split.split_equal_barcodes(rows, codes, 2) if equal else split.split_by_barcode(rows, codes)


@query(f"WITH {ad.SEQS}, {_BASES}, {_SPLIT} SELECT ord, sample FROM split")
def split_by_barcode(spark, d) -> DataFrame:
    return _split(spark, d, False).select("ord", "sample")


@query(f"WITH {ad.SEQS}, {_BASES}, {_SPLIT} SELECT ord, sample FROM split")
def split_equal_barcodes(spark, d) -> DataFrame:
    return _split(spark, d).select("ord", "sample")


@query(f"WITH {ad.SEQS}, {_BASES}, {_SPLIT} SELECT sample, count(*) AS n FROM split GROUP BY 1")
def split_counts(spark, d) -> DataFrame:
    return split.split_counts(_split(spark, d))


@query(f"WITH {ad.SEQS}, {_BASES}, {_SPLIT} SELECT sample, count(*) AS n FROM split GROUP BY 1 ORDER BY n DESC, sample LIMIT 3")
def top_k(spark, d) -> DataFrame:
    return split.split_counts(_split(spark, d), 3)


_KEYED_SQL = f"WITH {ad.SEQS}, {_BASES}, tagged AS (SELECT ord, regexp_extract(bases, '^TCAG(\\w*)CA', 1) AS tag FROM bases WHERE regexp_matches(bases, '^TCAG(\\w*)CA'))"


def _by_key(spark, d):
    keys = spark.createDataFrame([("k1", ""), ("k2", "A"), ("k3", "AC"), ("k4", "GC")], "name string, tag string")
    rows = ad.seqs(spark, d).select("ord", F.concat(F.lit(fl.KEY), "seq").alias("bases"))
    return split.split_by_key(rows, keys, "CA")


@query(_KEYED_SQL + " SELECT ord, tag, name AS sample FROM tagged JOIN (VALUES ('k1', ''), ('k2', 'A'), ('k3', 'AC'), ('k4', 'GC')) v(name, t) ON tag = t")
def split_by_key(spark, d) -> DataFrame:
    return _by_key(spark, d)[0].select("ord", "tag", "sample")


@query(_KEYED_SQL + " SELECT ord, tag FROM tagged WHERE tag NOT IN ('', 'A', 'AC', 'GC')")
def split_by_key_rejects(spark, d) -> DataFrame:
    return _by_key(spark, d)[1].select("ord", "tag")


# ---------------------------------------------------------------- pairs


@query(f"""WITH {ad.READS}, p AS (SELECT a.block, a.ord AS i, b.ord AS j, a.flows AS x, b.flows AS y FROM reads a JOIN reads b ON a.block = b.block AND b.ord < a.ord)
SELECT block, i, j, list_sum(list_transform(x, lambda v, k: abs(v - y[k])))::DOUBLE / len(x) AS d FROM p""")
def mean_flow_dist(spark, d) -> DataFrame:
    return pairs.mean_abs_distances(ad.reads(spark, d), "block")


def _mismatches(a, b):
    import numpy as np

    x, y = (np.array([list(s.ljust(20, ".").encode()) for s in t], np.uint8) for t in (a, b))
    return ((x != y).sum(axis=1) / 20).round(9)


_MISMATCHES = "SELECT a.block, a.ord AS i, b.ord AS j, round(1.0::DOUBLE * hamming(rpad(a.seq, 20, '.'), rpad(b.seq, 20, '.')) / 20, 9) AS d FROM tags a JOIN tags b ON a.block = b.block AND "


@query(f"WITH {ad.TAGS} {_MISMATCHES} b.ord < a.ord")
def all_pairs(spark, d) -> DataFrame:
    return pairs.all_pairs(ad.tags(spark, d), "seq", _mismatches, "block")


@query(f"WITH {ad.TAGS} {_MISMATCHES} b.ord <> a.ord")
def all_pairs_full(spark, d) -> DataFrame:
    return pairs.all_pairs(ad.tags(spark, d), "seq", _mismatches, "block", full=True)


@query(f"WITH {ad.SEQS} SELECT a.block, a.ord AS i, b.ord AS j FROM seqs a JOIN seqs b ON a.block = b.block AND b.freq >= a.freq AND a.ord <> b.ord")
def parent_candidates(spark, d) -> DataFrame:
    return chimera.parent_candidates(ad.seqs(spark, d), "block")


@query("SELECT l_orderkey AS i, arg_min(l_linenumber, (l_quantity, l_linenumber)) AS j, min(l_quantity) AS n_diff FROM lineitem GROUP BY 1")
def best_hit(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_quantity").alias("n_diff"))
    return chimera.best_hits(rows)


_LOOKUP = """raw AS (SELECT s, b, CASE WHEN s = 0 THEN exp(-0.5 * ((ln((b + 0.5) / 100) + 2.2) / 0.7) ** 2) / ((b + 0.5) / 100) ELSE exp(-0.5 * (((b + 0.5) / 100 - s) / (0.04 + 0.03 * s)) ** 2) END AS p
  FROM (SELECT s::DOUBLE AS s FROM range(10) t(s)), (SELECT b::DOUBLE AS b FROM range(1000) t(b))),
look AS (SELECT s::INT AS s, b::INT AS b, -ln(greatest(p / sum(p) OVER (PARTITION BY s), 1e-12)) AS l FROM raw), single AS (SELECT b, min(l) AS l FROM look GROUP BY b),
lists AS (SELECT b, list(l ORDER BY s) AS l, min(l) AS m FROM look GROUP BY b)"""


@query(f"""WITH {ad.READS}, {_LOOKUP}, cells AS (SELECT r.block, r.ord, k, lists.l, lists.m FROM (SELECT block, ord, unnest(range(1, (len // 4) * 4 + 1)) AS k, flows FROM reads) r JOIN lists ON lists.b = least(r.flows[k], 999)),
pairs AS (SELECT a.block, a.ord AS i, b.ord AS j, list_min(list_transform(a.l, lambda x, n: x + b.l[n])) - a.m - b.m AS d FROM cells a JOIN cells b ON a.block = b.block AND b.ord < a.ord AND a.k = b.k)
SELECT block, i, j, round(avg(d), 6) AS d FROM pairs GROUP BY 1, 2, 3""")
def flow_dist(spark, d) -> DataFrame:
    return pairs.flow_distances(ad.reads(spark, d), None, "block").select("block", "i", "j", F.round("d", 6).alias("d"))


_TAGS = f"WITH RECURSIVE {ad.TAGS}, "
_COSTED = _TAGS + oracles.alignment("tags", K.SEQUENCE_GAP, K.HOMOPOLYMER_GAP, oracles.costs(K.default_costs()))
_COSTED_ONE_SIDED = _TAGS + oracles.alignment("tags", K.SEQUENCE_GAP, K.HOMOPOLYMER_GAP, oracles.costs(K.default_costs()), free_left=False, ordered=True)
_ALIGNED = _TAGS + oracles.alignment("tags", K.GAP)


def _rounded() -> dict:
    return {"d": F.round("d", 9)}


@query(f"{_ALIGNED}, {oracles.IDENTITY}")
def nw_identity(spark, d) -> DataFrame:
    return pairs.identity_distances(ad.tags(spark, d), "block", _rounded())


@query(f"{_COSTED} {oracles.SCORE}")
def nw_homopolymer(spark, d) -> DataFrame:
    return pairs.sequence_distances(ad.tags(spark, d), None, "block", then=_rounded())


@query(f"{_COSTED_ONE_SIDED} {oracles.SCORE_ONE_SIDED}")
def nw_homopolymer_asym(spark, d) -> DataFrame:
    return pairs.sequence_distances(ad.tags(spark, d), None, "block", asymmetric=True, then=_rounded())


@query(f"{_ALIGNED}, {oracles.DIFFS}")
def nw_diff(spark, d) -> DataFrame:
    return pairs.differences(ad.tags(spark, d), "block", then={"n_diff": F.col("n_diff"), "d": _text("d"), "r": _text("r")})


@query(SQL["nw_diff"].replace("SELECT block, i, j, n_diff::INT AS n_diff, array_to_string(d, ',') AS d, array_to_string(r, ',') AS r FROM v", "SELECT block, i, j, k::INT AS base, d[k + 1]::INT AS d, r[k + 1]::INT AS r FROM v, unnest(range(0, len(d))) u(k)"))
def cumulative_diffs(spark, d) -> DataFrame:
    """The differences up to each base, from both ends."""
    rows = pairs.differences(ad.tags(spark, d), "block", then={"c": F.arrays_zip("d", "r")})
    return rows.select("block", "i", "j", F.posexplode("c").alias("base", "c")).select("block", "i", "j", "base", "c.d", "c.r")


_SQUARE = "x AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ord, round(abs(embedding[1]::DOUBLE), 4) AS x FROM embeddings)"


@query(f"WITH {_SQUARE}, v AS (SELECT a.ord AS i, b.ord AS j, round(abs(2 * a.x - b.x), 4)::FLOAT AS v FROM x a JOIN x b ON a.ord <> b.ord) SELECT a.i, a.j, round(((a.v::DOUBLE + b.v::DOUBLE) / 2)::FLOAT::DOUBLE, 6) AS d FROM v a JOIN v b ON a.i = b.j AND a.j = b.i AND a.j < a.i")
def scan_dist_full(spark, d) -> DataFrame:
    """A square file that is not symmetric, read as the mean of both directions."""
    x = _numbered_values(spark, d)
    n, path = x.count(), _folder(spark, "square")
    cell = lambda b, j: F.when(j == F.col("i"), 0.0).otherwise(F.round(F.abs(2 * F.col("a") - b), 4))
    rows = pairs.square(x, n, sinks.LINES).select("i", F.transform("b", cell).alias("d"))
    sinks.sink_rows(rows, n, path, placed=True, compression="lz4")
    return text.scan_dist(spark, path, full=True).select("i", "j", F.round(F.col("d").cast("double"), 6).alias("d"))


# ---------------------------------------------------------------- distinct


_UNIQUE = f"""WITH {ad.READS}, p AS (SELECT ord, len, array_to_string(list_transform(flows, lambda x: ((x + 50) // 100)::INT), ',') AS pattern FROM reads),
u AS (SELECT pattern, min(ord) AS first_ord, arg_min(len, ord) AS len_u, count(*) AS weight FROM p GROUP BY 1)"""


@query(_UNIQUE + " SELECT row_number() OVER (ORDER BY first_ord) - 1 AS u_id, pattern, first_ord, len_u, weight FROM u")
def calc_unique(spark, d) -> DataFrame:
    return unique.calc_unique(ad.reads(spark, d)).select(F.col("u_id").cast("long").alias("u_id"), _text("pattern").alias("pattern"), "first_ord", "len_u", "weight")


@query(f"WITH RECURSIVE {ad.SEQS}, {oracles.greedy('seqs')} SELECT ord, seq_id, rep_ord, rep_id FROM done")
def fasta_unique(spark, d) -> DataFrame:
    return unique.fasta_unique(ad.seqs(spark, d))


@query(f"WITH RECURSIVE {ad.SEQS}, {oracles.greedy('seqs')} SELECT rep_ord, rep_id, count(*) AS n, string_agg(ord, ',' ORDER BY ord) AS members FROM done GROUP BY ALL")
def prefix_collapse(spark, d) -> DataFrame:
    """What collapses into each text, as a map is written."""
    return unique.unique_map(unique.fasta_unique(ad.seqs(spark, d))).select("rep_ord", "rep_id", "n", _text("members").alias("members"))


# ---------------------------------------------------------------- mappings

_MEMBERS = "m AS (SELECT l_suppkey AS c, l_orderkey AS o, l_linenumber AS n FROM lineitem)"


def _inner(spark, d) -> DataFrame:
    """Orders as clusters of their lines."""
    rows = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat_ws(".", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string")).alias("read")))).alias("m"))
    return rows.select(F.col("o").alias("ord"), F.concat(F.lit("o"), F.col("o").cast("string")).alias("cluster_id"), F.col("m.read").alias("members"))


def _outer(spark, d) -> DataFrame:
    """Customers as clusters of orders."""
    rows = ad.table(spark, d, "orders").join(ad.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_semi")
    rows = rows.groupBy(F.col("o_custkey").alias("ord")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("m"))
    return rows.select("ord", F.concat(F.lit("c"), F.col("ord").cast("string")).alias("cluster_id"), F.transform("m", lambda x: F.concat(F.lit("o"), x.cast("string"))).alias("members"), F.col("m").alias("member_ords"))


_MERGED = """SELECT {key}, string_agg(concat_ws('.', l_orderkey, l_linenumber, l_partkey), ',' ORDER BY l_orderkey, l_linenumber, concat_ws('.', l_orderkey, l_linenumber, l_partkey)) AS members FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_custkey"""


@query(_MERGED.format(key="'c' || o_custkey AS cluster_id"))
def merge_mapping(spark, d) -> DataFrame:
    return mapping.merge_mapping(_outer(spark, d), _inner(spark, d)).select("cluster_id", _text("members").alias("members"))


@query(_MERGED.format(key="o_custkey AS cluster, 'o' || min(o_orderkey) AS centre"))
def output_mapping(spark, d) -> DataFrame:
    rows = _outer(spark, d).select(F.col("ord").alias("cluster"), F.get("member_ords", F.lit(0)).alias("medoid"), "member_ords")
    return mapping.output_mapping(rows, _inner(spark, d)).select("cluster", "centre", _text("members").alias("members"))


@query("SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey) AS read_id, o_orderpriority AS seq, 'o' || o_orderkey AS cluster_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def redup(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("cluster_id"), F.col("o_orderpriority").alias("seq"))
    return mapping.redup(rows, _inner(spark, d).drop("ord"))


def _levels(spark, d) -> DataFrame:
    """Five cuts of all customers: at level k, k + 1 neighbours are one cluster."""
    levels = spark.range(5).select(F.col("id").cast("int").alias("level"))
    rows = _outer(spark, d).select(F.col("ord"), "member_ords").crossJoin(F.broadcast(levels)).groupBy("level", F.expr("ord div (level + 1)").alias("cluster"))
    return rows.agg(F.array_sort(F.flatten(F.collect_list("member_ords"))).alias("members"))


@query("SELECT o_custkey // 3 AS otu, string_agg('r' || o_orderkey, ',' ORDER BY o_orderkey) AS reads FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1")
def list_to_reads(spark, d) -> DataFrame:
    names = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("member"), F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("read"))
    return mapping.list_to_reads(_levels(spark, d), names, 2).select("otu", _text("reads").alias("reads"))


@query("SELECT (dense_rank() OVER (ORDER BY o_custkey // 4) - 1)::INT AS cluster, o_orderkey::VARCHAR AS member FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def scan_list(spark, d) -> DataFrame:
    """A list file of five levels, of which the one with cutoff 0.03 is read."""
    path = _folder(spark, "list")
    sinks.sink_levels(_levels(spark, d).withColumn("cutoff", F.col("level") / 100), path)
    return mapping.scan_list(text.scan_levels(spark, path), 0.03)


# ---------------------------------------------------------------- aggregates, ranks, samples


@query("SELECT l_orderkey AS otu, COALESCE(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'A'), 0)::BIGINT AS A, COALESCE(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'N'), 0)::BIGINT AS N, COALESCE(sum(l_quantity::BIGINT) FILTER (l_returnflag = 'R'), 0)::BIGINT AS R FROM lineitem GROUP BY 1")
def otu_table(spark, d) -> DataFrame:
    return otu.otu_table(ad.assignments(spark, d), ["A", "N", "R"])


@query("SELECT l_orderkey AS otu, arg_max(concat_ws('-', l_partkey, l_suppkey), (l_quantity, -l_linenumber, concat_ws('-', l_partkey, l_suppkey))) AS seq, sum(l_quantity) AS weight FROM lineitem GROUP BY 1")
def otu_typical(spark, d) -> DataFrame:
    return otu.otu_typical(ad.assignments(spark, d))


@query(f"WITH {ad.RESP} SELECT k, round(sum(tau * weight), 6) AS w FROM resp GROUP BY 1")
def cluster_weights(spark, d) -> DataFrame:
    return em.cluster_weights(ad.responsibilities(spark, d)).select("k", F.round("w", 6).alias("w"))


_WEIGHTS = f"WITH {ad.RESP}, w AS (SELECT k, sum(tau * weight) AS w FROM resp GROUP BY 1)"


@query(_WEIGHTS + ", s AS (SELECT i, sum(w * exp(-60 * d)) AS s FROM resp JOIN w USING (k) GROUP BY 1) SELECT round(-sum(ln(s)) - count(*) * ln(60), 3) AS nll FROM s")
def nll(spark, d) -> DataFrame:
    rows = ad.responsibilities(spark, d)
    return em.negative_log_likelihood(rows.select("i", "k", "d"), em.cluster_weights(rows), 60.0).select(F.round("nll", 3).alias("nll"))


_STEP = ", l AS (SELECT i, k, w, d - min(d) OVER (PARTITION BY i) AS d FROM resp JOIN w USING (k) WHERE w > 0.1), p AS (SELECT i, k, w * exp(-60 * d) AS p FROM l), t AS (SELECT i, k, p / sum(p) OVER (PARTITION BY i) AS tau FROM p)"


def _step(spark, d) -> DataFrame:
    rows = ad.responsibilities(spark, d)
    return em.expectation_step(rows.select("i", "k", "d"), em.cluster_weights(rows), 60.0)


@query(_WEIGHTS + _STEP + " SELECT i, k, round(tau, 6) AS tau FROM t WHERE tau > 1e-4")
def em_step(spark, d) -> DataFrame:
    return _step(spark, d).select("i", "k", F.round("tau", 6).alias("tau"))


@query(_WEIGHTS + _STEP + ", w2 AS (SELECT k, sum(t.tau * r.weight) AS w FROM t JOIN resp r USING (i, k) WHERE t.tau > 1e-4 GROUP BY 1) SELECT k, round(w, 5) AS w FROM w2")
def em_two_steps(spark, d) -> DataFrame:
    rows = ad.responsibilities(spark, d)
    return em.cluster_weights(_step(spark, d).join(rows.select("i", "k", "weight"), ["i", "k"])).select("k", F.round("w", 5).alias("w"))


@query(f"WITH {ad.RESP} SELECT i, arg_max(k, (tau, -k)) AS z, round(1 - max(tau), 9) AS p FROM resp GROUP BY 1")
def set_z(spark, d) -> DataFrame:
    return em.set_z(ad.responsibilities(spark, d)).select("i", "z", F.round("p", 9).alias("p"))


@query("SELECT o_custkey AS k, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS c FROM orders GROUP BY 1")
def centroid(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("c"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("seen"))
    return em.medoids(rows)


@query("SELECT DISTINCT o_custkey AS k, dense_rank() OVER (ORDER BY o_custkey) - 1 AS number FROM orders")
def renumber(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "orders").select(F.col("o_custkey").alias("k")).distinct()
    return ordinals.renumber(rows, "k").select("k", F.col("number").cast("long").alias("number"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer")
def ordinal_ids(spark, d) -> DataFrame:
    """Customers stand in the order of their keys in the file."""
    return ordinals.with_ordinal(ad.table(spark, d, "customer"), scan=True).select("c_custkey", "ord")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount >= 0.09 OR l_tax > 0.05 THEN 0.0::DOUBLE ELSE round(1 / (1 + exp(-(-7.5 + 0.5 * l_quantity))), 9) END AS p FROM lineitem")
def logistic(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "lineitem")
    p = sq.logistic(F.when(F.col("l_discount") >= 0.09, 0.2).otherwise(0.0), F.when(F.col("l_tax") > 0.05, 1.0).otherwise(0.0), F.col("l_quantity"))
    return rows.select("l_orderkey", "l_linenumber", F.round(p, 9).alias("p"))


@query("SELECT o_orderkey AS ord, o_orderpriority AS seq FROM orders JOIN (SELECT l_orderkey, max(l_discount) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE p < 0.05")
def good_class_filter(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), F.col("o_orderpriority").alias("seq"))
    classes = ad.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("ord")).agg(F.max("l_discount").alias("p"))
    return chimera.good_class_filter(rows, classes, below=0.05)[0].select("ord", "seq")


@query("WITH n AS (SELECT count(*) AS n FROM customer), r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer), s AS (SELECT (n - 7) // 4 AS size, (n - 7) % 4 AS rest FROM n) SELECT c_custkey, CASE WHEN ord - 7 < size + rest THEN 0 ELSE (ord - 7 - rest) // size END::INT AS chunk FROM r, s WHERE ord >= 7")
def chunk(spark, d) -> DataFrame:
    rows = ordinals.with_ordinal(ad.table(spark, d, "customer"), scan=True)
    return mapping.chunk(rows, rows.count(), 4, 7).select("c_custkey", "chunk")


@query("SELECT o_orderkey AS ord FROM orders ORDER BY md5('1:' || o_orderkey), o_orderkey LIMIT 50")
def sample_n(spark, d) -> DataFrame:
    return mapping.sample_n(ad.table(spark, d, "orders").select(F.col("o_orderkey").alias("ord")), 50)


@query("SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier")
def union_all(spark, d) -> DataFrame:
    one = lambda name, key, mark: ad.table(spark, d, name).select(F.concat(F.lit(mark), F.col(key).cast("string")).alias("id"))
    return one("customer", "c_custkey", "c").unionByName(one("supplier", "s_suppkey", "s"))


@query(_one("ord AS new_ord, len, flows[1]::INT AS first FROM reads UNION ALL SELECT ord, ord + (SELECT count(*) FROM reads), len, flows[1]::INT"))
def dat_join(spark, d) -> DataFrame:
    rows = ad.reads(spark, d).select("ord", "len", "flows")
    n = rows.count()
    out = mapping.dat_join(rows, rows)
    return out.select((F.col("ord") % n).alias("ord"), F.col("ord").alias("new_ord"), "len", F.get("flows", F.lit(0)).alias("first"))


@query("SELECT p_partkey AS ord, row_number() OVER (ORDER BY len(p_name), p_partkey) - 1 AS place FROM part")
def len_cmp(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "part").select(F.col("p_partkey").alias("ord"), F.length("p_name").alias("len"))
    return ordinals.by_length(rows).select("ord", "place")


# ---------------------------------------------------------------- formats: written, then read


@query(_one("read_id, clip, array_to_string(flows, ',') AS flows"))
def scan_raw(spark, d) -> DataFrame:
    path = _folder(spark, "raw")
    sinks.sink_raw(ad.reads(spark, d), path, "ACGT", "reads")
    return text.scan_raw(spark, path).select("ord", "read_id", "clip", _text("flows").alias("flows"))


@query(_one("read_id, len, array_to_string(flows, ',') AS flows"))
def scan_dat(spark, d) -> DataFrame:
    path = _folder(spark, "dat")
    sinks.sink_dat(ad.reads(spark, d), path)
    return text.scan_dat(spark, path).select("ord", "read_id", "len", _text("flows").alias("flows"))


@query(_S + "seq_id, weight, seq FROM seqs")
def scan_fasta(spark, d) -> DataFrame:
    path = _folder(spark, "fasta")
    sinks.sink_fasta(ad.seqs(spark, d), path, 25)
    return text.scan_fasta(spark, path, "ACGT")


def _numbered_values(spark, d) -> DataFrame:
    x = ad.table(spark, d, "embeddings").select("vec_id", F.round(F.abs(F.get("embedding", F.lit(0)).cast("double")), 4).alias("x"))
    return staged(ordinals.with_ordinal(x.orderBy("vec_id")).select("ord", "x"))


@query("WITH a AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, round(abs(embedding[1]::DOUBLE), 4) AS x FROM embeddings) SELECT a.i, b.i AS j, round(abs(a.x - b.x)::FLOAT::DOUBLE, 6) AS d FROM a JOIN a b ON b.i < a.i")
def scan_dist(spark, d) -> DataFrame:
    """The triangle of all rows, by their ordinals in order of vec_id."""
    x = _numbered_values(spark, d)
    n, path = x.count(), _folder(spark, "dist")
    rows = pairs.triangle(x, n, sinks.LINES).select("i", "j", F.abs(F.col("a") - F.col("b")).alias("d"))
    sinks.sink_dist(rows, n, path, placed=True, compression="gzip")
    return text.scan_dist(spark, path).select("i", "j", F.round(F.col("d").cast("double"), 6).alias("d"))


@query("WITH r AS (SELECT o_custkey, string_agg('x_noise_' || o_orderkey || '_' || (1 + o_orderkey % 3), ',' ORDER BY o_orderkey) AS members, sum(1 + o_orderkey % 3)::BIGINT AS w, row_number() OVER (ORDER BY o_custkey) - 1 AS ord FROM orders GROUP BY 1) SELECT ord, 'c' || o_custkey AS rep, 'm_' || ord || '_' || w AS name, members FROM r")
def scan_mapping(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("m"))
    member = lambda x: F.concat_ws("_", F.lit("x_noise"), x.cast("string"), (1 + x % 3).cast("string"))
    path = _folder(spark, "mapping")
    sinks.sink_mapping(rows.select(F.col("o_custkey").alias("ord"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("rep"), F.transform("m", member).alias("members")), path)
    return text.scan_mapping(spark, path, "m").select("ord", "rep", "name", _text("members").alias("members"))


@query("SELECT o_custkey AS rep_ord, 'c' || o_custkey AS rep_id, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY 1")
def scan_unique_map(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("rep_ord")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("members"), F.count(F.lit(1)).alias("n"))
    path = _folder(spark, "map")
    sinks.sink_unique_map(rows.select("rep_ord", F.lit(0).alias("u"), F.concat(F.lit("c"), F.col("rep_ord").cast("string")).alias("rep_id"), "n", "members", F.col("members").cast("array<string>").alias("member_ids")), path)
    return text.scan_unique_map(spark, path).select("rep_ord", "rep_id", "n", _text("members").alias("members"))


@query(_one("read_id, clip, array_to_string(flows, ',') AS flows"))
def scan_sff(spark, d) -> DataFrame:
    """Reads in a binary file for each block, read back from all of them."""
    path = _folder(spark, "sff")
    ones = lambda n, v: F.array_repeat(F.lit(v), n)
    rows = ad.reads(spark, d).withColumn("read_id", F.concat_ws(" ", F.col("ord").cast("string"), "read_id")).withColumns({"clip_left": F.lit(0), "clip_right": F.col("clip"), "flow_index": ones(F.col("clip"), 1), "quals": ones(F.col("clip"), 20), "bases": F.repeat(F.lit("A"), F.col("clip"))})
    sff.sink_sff(rows, path if "://" in path else f"file://{path}", "block", "TACG" * 16).collect()  # a row a file
    back = sff.sff_to_raw(sff.scan_sff(spark, f"{path}/*.sff"))
    name = F.split("read_id", " ")
    return back.select(F.get(name, F.lit(0)).cast("long").alias("ord"), F.get(name, F.lit(1)).alias("read_id"), "clip", _text("flows").alias("flows"))


@query(_one("read_id, clip, array_to_string(flows, ',') AS flows"))
def scan_sffinfo(spark, d) -> DataFrame:
    rows = ad.reads(spark, d)
    line = F.concat_ws("\n", F.concat(F.lit(">"), "read_id"), F.lit("  # of Bases:   64\n  Clip Qual Left:   5"), F.concat(F.lit("  Clip Qual Right:   "), F.col("clip").cast("string")), F.concat(F.lit("Flowgram:\t"), F.regexp_replace(fl.flows_to_string("flows"), " ", "\t")), F.lit("Flow Indexes:\t" + "\t".join(map(str, range(1, 65)))), F.lit("Bases:\t" + "acgt" * 16), F.lit("Quality Scores:\t" + "\t".join(["20"] * 64)))
    path = _folder(spark, "sffinfo")
    sinks._ordered(rows.select(F.col("ord").alias("_n"), line.alias("value")), path, "Common Header:\n  # of Reads:    1\n  # of Flows:    64\n")
    return text.scan_sffinfo(spark, path).select("ord", "read_id", "clip", _text("flows").alias("flows"))


@query(_one("read_id, 64::INT AS clip, array_to_string(flows, ',') AS flows"))
def scan_flower(spark, d) -> DataFrame:
    line = F.concat_ws("\n", F.concat(F.lit(">"), "read_id"), F.lit("  Info:\t2024\n  Clip:\t1\t64"), F.concat(F.lit("  Flows:\t"), fl.flows_to_string("flows")), F.lit("  Index:\t" + " ".join(map(str, range(1, 65)))), F.lit("  Bases:\t" + "acgt" * 16))
    rows = ad.reads(spark, d)
    path = _folder(spark, "flower")
    sinks._ordered(rows.select(F.col("ord").alias("_n"), line.alias("value")), path)
    found = text.scan_flower(spark, path)
    return found.select("ord", "read_id", F.get("flow_indexes", F.get("clips", F.lit(1)) - 1).alias("clip"), _text("flows").alias("flows"))


@query("SELECT 'c' || c_custkey AS name, 'AC' AS barcode, c_mktsegment AS primer, row_number() OVER (ORDER BY c_custkey) - 1 AS ord FROM customer")
def scan_barcodes(spark, d) -> DataFrame:
    line = F.concat_ws(",", F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.lit("AC"), "c_mktsegment", F.lit("ignored"))
    path = _folder(spark, "barcodes")
    sinks._ordered(ad.table(spark, d, "customer").select(F.col("c_custkey").alias("_n"), line.alias("value")), path)
    return text.scan_barcodes(spark, path)


@query("SELECT s_name AS name, 's' || s_suppkey AS tag FROM supplier")
def scan_keyfile(spark, d) -> DataFrame:
    path = _folder(spark, "keys")
    ad.table(spark, d, "supplier").select(F.concat_ws(",", "s_name", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))).write.text(path)
    return text.scan_keyfile(spark, path)


@query("SELECT 'n' || c_nationkey AS cluster_id, string_agg('c' || c_custkey, ',' ORDER BY c_custkey) AS members FROM customer GROUP BY c_nationkey")
def scan_noise_dir(spark, d) -> DataFrame:
    """A FASTA file for each nation, its customers behind its own record."""
    rows = ad.table(spark, d, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list("c_custkey")).alias("m"))
    record = lambda name: F.concat(F.lit(">"), name, F.lit(" x\nACGT"))
    body = F.concat(F.lit(">"), record(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))), F.lit("\n"), F.array_join(F.transform("m", lambda x: record(F.concat(F.lit("c"), x.cast("string")))), "\n"))
    path = _folder(spark, "noise")
    rows.select("c_nationkey", body.alias("value")).repartition("c_nationkey").write.partitionBy("c_nationkey").text(path)
    return text.scan_noise_dir(spark, f"{path}/*/*.txt").select("cluster_id", _text("members").alias("members"))


@query("SELECT 'c' || o_custkey AS cluster_id, string_agg('o' || o_orderkey, ',' ORDER BY o_orderkey) AS members FROM orders GROUP BY o_custkey")
def scan_noise_mapping(spark, d) -> DataFrame:
    rows = ad.table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("m"))
    line = F.concat_ws("\t", F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.array_join(F.transform("m", lambda x: F.concat(F.lit("o"), x.cast("string"))), ","))
    path = _folder(spark, "names")
    rows.select(line).write.text(path)
    return text.scan_noise_mapping(spark, path).select("cluster_id", _text("members").alias("members"))


@query("WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS k, round(p_retailprice, 2) AS v, count(*) OVER () // 10 AS w FROM part) SELECT (k // w)::INT AS s, (k % w - 1)::INT AS bin, round(v, 4) AS nll FROM p WHERE k < 10 * w")
def scan_lookup(spark, d) -> DataFrame:
    """The prices of all parts as ten blocks of a table of signals; bin -1 is the prior."""
    prices = ad.table(spark, d, "part").select(F.col("p_partkey").alias("_n"), F.format_string("%.4f", "p_retailprice").alias("value"))
    path = _folder(spark, "lookup")
    sinks._ordered(prices, path)
    table, priors = text.scan_lookup(spark, path, prices.count() // 10 - 1)
    s, bins = np.divmod(np.arange(table.size + 10), table.shape[1] + 1)
    return spark.createDataFrame(pa.table({"s": s.astype(np.int32), "bin": (bins - 1).astype(np.int32), "nll": np.column_stack([priors, table]).ravel()}))


@query("SELECT substr('ACTG', (l_linenumber % 4 + 1)::INT, 1) AS a, substr('ACTG', (l_suppkey % 4 + 1)::INT, 1) AS b, round(avg(l_quantity), 6) AS cost FROM lineitem GROUP BY ALL")
def scan_tran(spark, d) -> DataFrame:
    """Mean quantities by two remainders as a table of costs."""
    cells = ad.table(spark, d, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("_n"), (F.col("l_suppkey") % 4).alias("b")).agg(F.avg("l_quantity").alias("c"))
    lines = cells.groupBy("_n").agg(F.sort_array(F.collect_list(F.struct("b", F.format_string("%.9f", "c").alias("t")))).alias("c")).select("_n", F.array_join("c.t", ",").alias("value"))
    path = _folder(spark, "tran")
    sinks._ordered(lines, path)
    found = text.scan_tran(spark, path)
    return spark.createDataFrame([(x, y, round(float(found[i, j]), 6)) for i, x in enumerate(K.BASES) for j, y in enumerate(K.BASES)], "a string, b string, cost double")


@query("SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_discount, l_tax, l_quantity, l_returnflag) - 1 AS ord, concat_ws('_', l_orderkey, l_linenumber) AS id, l_discount AS c_index, l_tax AS excess, l_quantity AS loon, CASE WHEN l_returnflag = 'A' THEN 'Trimera' ELSE 'Chimera' END AS class FROM lineitem")
def scan_chimera_rows(spark, d) -> DataFrame:
    """Lines of orders as rows of a chimera check."""
    rows = ad.table(spark, d, "lineitem")
    name = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    kind = F.when(F.col("l_returnflag") == "A", "Trimera").otherwise("Chimera")
    line = F.concat_ws(" ", F.lit("0"), name, *[F.lit("7")] * 10, *(F.col(c).cast("string") for c in ("l_discount", "l_tax", "l_quantity")), F.lit("3 1 9"), kind)
    path = _folder(spark, "chimeras")
    order = F.struct("l_orderkey", "l_linenumber", "l_discount", "l_tax", "l_quantity", "l_returnflag")
    sinks._ordered(ordinals.with_ordinal(rows.select(order.alias("_o"), line.alias("value")).orderBy("_o"), "_n"), path)
    return text.scan_chimeras(spark, path)


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, s_name AS id, round(s_acctbal, 2) AS p FROM supplier")
def scan_class(spark, d) -> DataFrame:
    line = F.concat_ws(" ", F.translate("s_name", " ", "_"), F.format_string("%.2f", "s_acctbal"))
    path = _folder(spark, "classes")
    sinks._ordered(ad.table(spark, d, "supplier").select(F.col("s_suppkey").alias("_n"), line.alias("value")), path)
    return text.scan_classes(spark, path)


@query("SELECT s_suppkey AS otu, 'k;' || s_name AS lineage FROM supplier")
def scan_taxonomy(spark, d) -> DataFrame:
    path = _folder(spark, "taxonomy")
    ad.table(spark, d, "supplier").select(F.col("s_suppkey").cast("string"), F.concat(F.lit("k;"), "s_name")).write.csv(path, sep="\t")
    return text.scan_taxonomy(spark, path).select(F.col("otu").cast("long").alias("otu"), "lineage")


_VARIANT = f"""cleaned AS (SELECT ord, regexp_extract({_SEQ.format(f="kept")}, '^TCAG.*([CT][AG].*)', 1) AS seq, (len(kept) >= 12 AND regexp_matches({_SEQ.format(f="kept")}, '^TCAG.*([CT][AG].*)')) AS passed FROM kept)"""


@query(f"WITH {ad.KEYED}, {_KEPT.replace('949', '649')}, {_VARIANT} SELECT ord, seq FROM cleaned WHERE passed")
def clean_min_max(spark, d) -> DataFrame:
    """The variant with a lower ceiling and the last primer."""
    return clean.clean_reads(ad.keyed_reads(spark, d), "YR", 12, 40, high=649, greedy=True).where("passed").select("ord", "seq")


@query(f"WITH {ad.KEYED}, b AS (SELECT ord, regexp_extract({_SEQ.format(f='flows[1:clip]')}, '^TCAG([ACGT][ACGT].*)', 1) AS seq FROM keyed) SELECT ord, seq FROM b WHERE length(seq) >= 30")
def base_length_filter(spark, d) -> DataFrame:
    return clean.base_length_filter(ad.keyed_reads(spark, d), "NN", 30).select("ord", "seq")


@query(_WEIGHTS + " SELECT count(*) FILTER (w > 0.1) AS k_eff FROM w")
def effective_clusters(spark, d) -> DataFrame:
    return em.effective_clusters(em.cluster_weights(ad.responsibilities(spark, d)))


@query("SELECT o_custkey AS cluster, count(*) AS members FROM orders GROUP BY 1")
def sink_clusters(spark, d) -> DataFrame:
    """Customers as clusters of orders, in all files of the writer. The members are those of a cluster's folder; where its
    sequence, mapping or quality says otherwise, they are null."""
    path = _folder(spark, "clusters")
    rows = ad.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.sort_array(F.collect_list(F.col("o_orderkey").cast("string"))).alias("members"))
    seq = F.expr("repeat('ACGT', cast(1 + cluster % 30 as int))")
    rows = rows.select("cluster", F.size("members").cast("long").alias("weight"), seq.alias("sequence"), F.concat(F.lit("c"), F.col("cluster").cast("string")).alias("representative"), "members", F.array_repeat(F.lit(20), F.length(seq)).alias("quality"))
    sinks.sink_clusters(staged(rows), "k", path)
    place = F.split("seq_id", "_")
    seqs = text.scan_fasta(spark, f"{path}/k_cd.fa", "ACGT").select(F.get(place, F.lit(1)).cast("long").alias("cluster"), F.get(place, F.lit(2)).cast("long").alias("_weight"), F.length("seq").alias("_length"))
    lines = text.scan_mapping(spark, f"{path}/k.mapping").select(F.substring("rep", 2, 20).cast("long").alias("cluster"), F.sort_array("members").alias("_mapped"))
    words = text._tokens("_v")
    quality = text._records(spark, f"{path}/k_cd.qual").select(F.get(F.split(F.get(words, F.lit(0)), "_"), F.lit(1)).cast("long").alias("cluster"), (F.size(words) - 1).alias("_quals"))
    folder = text.scan_members(spark, f"{path}/k").select(F.col("cluster").cast("long").alias("cluster"), F.sort_array("members").alias("_members"), F.size("members").cast("long").alias("_n"))
    same = (F.col("_weight") == F.col("_n")) & (F.col("_mapped") == F.col("_members")) & (F.col("_quals") == F.col("_length"))
    return folder.join(seqs, "cluster", "full").join(lines, "cluster", "full").join(quality, "cluster", "full").select("cluster", F.when(same, F.col("_n")).alias("members"))


@query(f"WITH {ad.SEQS}, {_BASES}, {_SPLIT}, c AS (SELECT sample, count(*) AS n FROM split GROUP BY 1) SELECT sample, '{{\"primer\":\"' || primer || '\",\"barcode\":\"' || barcode || '\",\"sequence_file\":\"' || sample || '.raw\",\"output_format\":\"raw\",\"sequence_count\":' || n || '}}' AS control FROM c JOIN (VALUES ('s_ac', 'AC', 'RN'), ('s_ag', 'AG', 'NN'), ('s_ac2', 'AC', 'AN'), ('s_ct', 'CT', 'Y')) v(s, barcode, primer) ON sample = s")
def sink_control(spark, d) -> DataFrame:
    codes = spark.createDataFrame(_BARCODES, "name string, barcode string, primer string")
    return sinks.control_rows(split.split_counts(_split(spark, d)), codes)


# ---------------------------------------------------------------- clustering and denoising: results without SQL


_IDENTITY = oracles.IDENTITY.replace("SELECT block, i, j, round(", "SELECT block, i, j, (").replace(", 9) AS d FROM z", ") AS d FROM z")
_DISTANCES = f"""WITH RECURSIVE {ad.TAGS}, numbered AS (SELECT * REPLACE (row_number() OVER (PARTITION BY block ORDER BY ord) - 1 AS ord) FROM tags), {oracles.alignment("numbered", K.GAP)},
dist AS (WITH {_IDENTITY.strip()}), """
_SCALED = "scaled AS (SELECT block, i, j, (d::FLOAT - min(d::FLOAT) OVER (PARTITION BY block)) / greatest(max(d::FLOAT) OVER (PARTITION BY block) - min(d::FLOAT) OVER (PARTITION BY block), 1e-30::FLOAT) AS d FROM dist), "
_MERGES = "SELECT block, step, lft::INT AS \"left\", rgt::INT AS \"right\", dist FROM merge"
_COMPLETE, _AVERAGE = (_DISTANCES + oracles.linkage("dist", method).strip() for method in ("complete", "average"))


def _numbered(spark, d) -> DataFrame:
    return staged(pipelines._numbered(ad.tags(spark, d), "block"))


def _merges(spark, d, method: str = "complete") -> DataFrame:
    return cluster.linkage(pairs.identities_by_value(_numbered(spark, d), "block"), "block", method)


@query(f"{_COMPLETE} {_MERGES}")
def linkage_complete(spark, d) -> DataFrame:
    return _merges(spark, d)


@query(f"{_AVERAGE} {_MERGES}")
def linkage_average(spark, d) -> DataFrame:
    return _merges(spark, d, "average")


@query(f"{_DISTANCES} {oracles.linkage('dist', 'average', 'numbered').strip()} {_MERGES}")
def linkage_average_weighted(spark, d) -> DataFrame:
    rows = _numbered(spark, d)
    return cluster.linkage(pairs.identities_by_value(rows, "block"), "block", "average", weights=rows)


@query(f"{_DISTANCES} {_SCALED} {oracles.linkage('scaled').strip()} {_MERGES}")
def linkage_rescaled(spark, d) -> DataFrame:
    return cluster.linkage(pairs.identities_by_value(_numbered(spark, d), "block"), "block", scale=True)


_LEVEL = "SELECT block, t.k AS level, t.k * 0.05::DOUBLE AS cutoff FROM (SELECT block, arg_max(dist::DOUBLE, step) AS h FROM merge GROUP BY 1), unnest(range(0, floor(h / 0.05::DOUBLE + 1e-7::DOUBLE)::BIGINT)) t(k)"
_LEVELS = _COMPLETE + oracles.NODES + oracles.PARENTS + oracles.clusters_below(_LEVEL)


def _cut(spark, d) -> DataFrame:
    return cluster.cut_levels(_merges(spark, d), "block", 0.05)


@query(_LEVELS + " SELECT block, level::INT AS level, round(cutoff, 6) AS cutoff, cluster::INT AS cluster, array_to_string(members, ',') AS members FROM found")
def cut_levels(spark, d) -> DataFrame:
    return _cut(spark, d).select("block", "level", F.round("cutoff", 6).alias("cutoff"), "cluster", _text("members").alias("members"))


@query(_LEVELS + " SELECT block, printf('%.6f', cutoff) || ' ' || count(*) || ' ' || string_agg(array_to_string(members, ','), ' ' ORDER BY cluster) AS line FROM found GROUP BY block, level, cutoff")
def sink_list(spark, d) -> DataFrame:
    path = _folder(spark, "lists")
    sinks.sink_lists(_cut(spark, d), "block", path)
    return spark.read.text(f"{path}/list").select("block", F.col("value").alias("line"))


@query(_LEVELS + " SELECT block, printf('%.6f', cutoff) || ' ' || count(*) || ' ' || string_agg(len(members), ' ' ORDER BY cluster) AS line FROM found GROUP BY block, level, cutoff")
def sink_otu(spark, d) -> DataFrame:
    path = _folder(spark, "lists")
    sinks.sink_lists(_cut(spark, d), "block", path)
    return spark.read.text(f"{path}/otu").select("block", F.col("value").alias("line"))


_TREES = _COMPLETE + oracles.NODES


@query(_TREES + " SELECT block, arg_max(tree, k) || ';' AS tree FROM node GROUP BY 1")
def newick(spark, d) -> DataFrame:
    return cluster.newick(_merges(spark, d), "block")


@query(_TREES + " SELECT arg_max(tree, k) || ';' AS tree FROM node GROUP BY block")
def sink_tree(spark, d) -> DataFrame:
    path = _folder(spark, "trees")
    sinks.sink_tree(cluster.newick(_merges(spark, d), "block"), path)
    return spark.read.text(path).select(F.col("value").alias("tree"))


@query(_TREES + oracles.PARENTS + """, root AS (SELECT block, arg_max(tree, k) AS tree FROM node GROUP BY 1),
nth AS (SELECT n.block, -n.k - 1 AS name, height, row_number() OVER (PARTITION BY n.block ORDER BY instr(r.tree, n.tree) + len(n.tree)) AS r FROM node n JOIN root r USING (block))
SELECT '-' || u.r AS parent, CASE WHEN p.name >= 0 THEN p.name::VARCHAR ELSE '-' || c.r END AS child, printf('%.3f', u.height - COALESCE(c.height, 0.0))::DOUBLE AS branch FROM parent p JOIN nth u ON u.block = p.block AND u.name = p.up LEFT JOIN nth c ON c.block = p.block AND c.name = p.name""")
def scan_newick(spark, d) -> DataFrame:
    path = _folder(spark, "trees")
    sinks.sink_tree(cluster.newick(_merges(spark, d), "block"), path)
    return text.scan_newick(spark, path)


@query(_TREES + " SELECT block, k::INT AS step, len(leaves)::INT AS leaves FROM node")
def leaf_counts(spark, d) -> DataFrame:
    return cluster.leaf_counts(_merges(spark, d), "block")


_SPLITS = _AVERAGE + oracles.NODES + oracles.PARENTS + oracles.even_splits(5, 2)
_TOTALS = _SPLITS + ", totals AS (SELECT s.block, split, count(*) AS leaves, sum(n.weight)::BIGINT AS reads FROM split s JOIN numbered n ON n.block = s.block AND n.ord = s.member GROUP BY ALL)"


def _splits(spark, d) -> DataFrame:
    return cluster.split_even(_merges(spark, d, "average"), "block", 5, 2)


def _totals(spark, d) -> DataFrame:
    weights = _numbered(spark, d).select("block", F.col("ord").cast("long").alias("member"), F.col("weight").cast("long").alias("n"))
    return cluster.split_totals(_splits(spark, d), weights, "block")


@query(_SPLITS + " SELECT block, split, pos::INT AS pos, member FROM split")
def split_cluster_even(spark, d) -> DataFrame:
    return _splits(spark, d)


@query(_TOTALS + " SELECT * FROM totals")
def split_read_total(spark, d) -> DataFrame:
    return _totals(spark, d)


@query(_TOTALS + " SELECT block, split, row_number() OVER (ORDER BY leaves DESC, block, split) - 1 AS place FROM totals")
def sort_splits(spark, d) -> DataFrame:
    """The place of each split, the largest first."""
    return ordinals.with_ordinal(_totals(spark, d), "place").select("block", "split", "place")


_BINS = f"{ad.READS}, {_LOOKUP}, shape AS (SELECT block, list_transform(flows, lambda x: least((x + 50) // 100, 9)::INT) AS shape, min(ord) AS first, list(flows ORDER BY ord) AS all_flows FROM reads GROUP BY 1, 2), u AS (SELECT *, (row_number() OVER (PARTITION BY block ORDER BY first) - 1)::INT AS u FROM shape)"


@query(f"WITH {_BINS}, c AS (SELECT r.block, r.ord, u.u, r.len // 4 * 4 AS n, unnest(range(1, r.len // 4 * 4 + 1)) AS k, r.flows, u.shape FROM reads r JOIN u USING (block)) SELECT c.block, ord, u, round(sum(look.l) / any_value(n), 6) AS d FROM c JOIN look ON look.s = c.shape[k] AND look.b = least(c.flows[k], 949) GROUP BY c.block, ord, u")
def align_x(spark, d) -> DataFrame:
    return em.pattern_distances(ad.reads(spark, d), "block").select("block", "ord", "u", F.round("d", 6).alias("d"))


@query(f"""WITH {_BINS}, f AS (SELECT block, u, shape, unnest(range(1, 65)) AS k, unnest(all_flows) AS x FROM (SELECT block, u, shape, f AS all_flows FROM u, unnest(all_flows) t(f))),
n AS (SELECT block, u, k, shape[k] AS n, s, sum(l) AS l FROM f JOIN look ON look.b = least(x, 999) WHERE shape[k] > 0 GROUP BY ALL),
q AS (SELECT block, u, k, n, s, exp(min(l) OVER (PARTITION BY block, u, k) - l) AS e FROM n),
c AS (SELECT block, u, k, n, s, sum(e) OVER (PARTITION BY block, u, k ORDER BY s) / sum(e) OVER (PARTITION BY block, u, k) AS wrong FROM q),
b AS (SELECT block, u, k, s, CASE WHEN wrong > 0 THEN least(100, floor(-10 * log10(wrong)))::INT ELSE 100 END AS p FROM c WHERE s < n),
a AS (SELECT block, u, string_agg(p, ',' ORDER BY k, s) AS quality FROM b GROUP BY 1, 2) SELECT u.block, u.u, COALESCE(quality, '') AS quality FROM u LEFT JOIN a USING (block, u)""")
def phred_quality(spark, d) -> DataFrame:
    return em.pattern_qualities(ad.reads(spark, d), "block").select("block", "u", _text("quality").alias("quality"))


@query()
def flow_denoise_pipeline(spark, d) -> DataFrame:
    return pipelines.flow_denoise_plan(ad.keyed_reads(spark, d), "block", ".", 12, 72, cutoff=0.5)


@query()
def sequence_denoise_pipeline(spark, d) -> DataFrame:
    return pipelines.sequence_denoise_plan(ad.tags(spark, d), "block")


@query()
def full_pipeline(spark, d) -> DataFrame:
    return pipelines.full_plan(ad.keyed_reads(spark, d), "block", ".", 12, 72, most=10, least=3, cutoff=0.5)


def _clusters(spark, d):
    """Keyed reads, numbered by block, and their clusters by flow distance."""
    rows = pipelines._numbered(ad.keyed_reads(spark, d), "block")
    merges = cluster.linkage(pairs.flows_by_tile(rows, None, "block"), "block")
    return rows, cluster.cut_at(merges, "block", 0.5)


@query()
def flow_denoise(spark, d) -> DataFrame:
    return em.flow_denoise(*_clusters(spark, d), "block")


@query()
def flow_denoise_unseen(spark, d) -> DataFrame:
    """With a cost of 10 for flows behind the end of a pattern, and at most 50 steps."""
    return em.flow_denoise(*_clusters(spark, d), "block", unseen=10.0, most_steps=50)


@query()
def sequence_denoise(spark, d) -> DataFrame:
    rows = pipelines._numbered(ad.tags(spark, d), "block")
    distances = pairs.sequences_by_value(rows, None, "block", asymmetric=True)
    merges = cluster.linkage(pairs.mean_of_both(distances, "block"), "block")
    return em.sequence_denoise(rows, distances, cluster.cut_at(merges, "block", 0.08), "block")


@query()
def responsibilities(spark, d) -> DataFrame:
    """The last responsibilities, and of each block the likelihood by step."""
    return em.flow_responsibilities(*_clusters(spark, d), "block")


@query(f"{_TAGS} {oracles.alignment('tags', K.GAP, ordered=True).strip()}, {oracles.PARENTS_OF}")
def best_parents(spark, d) -> DataFrame:
    """Best hit and the best two and three parents, of sequences that have two candidates; -1 where three are not tried."""
    rows = chimera.chimera_check(ad.tags(spark, d), "block").where("class <> 'Null'")
    return rows.select("block", "i", "best", "ref", "best_chimera", "p1", "p2", F.coalesce("best_trimera", F.lit(-1)).alias("best_trimera"), "class")


@query("SELECT 's' || s_suppkey || '_' || (s_suppkey * 7919 % 101) AS sample, row_number() OVER (ORDER BY (s_suppkey::VARCHAR || (s_suppkey * 7919 % 101)::VARCHAR)::BIGINT, 's' || s_suppkey || '_' || (s_suppkey * 7919 % 101)) - 1 AS place FROM supplier")
def sort_samples(spark, d) -> DataFrame:
    """Columns of a table in order of the numbers in their names."""
    key = F.col("s_suppkey").cast("string")
    names = [r[0] for r in ad.table(spark, d, "supplier").select(F.concat_ws("_", F.concat(F.lit("s"), key), (F.col("s_suppkey") * 7919 % 101).cast("string"))).collect()]
    return spark.createDataFrame([(s, k) for k, s in enumerate(otu.sample_order(names))], "sample string, place long")


@query()
def chimera_check(spark, d) -> DataFrame:
    return chimera.chimera_check(ad.tags(spark, d), "block")


@query()
def chimera_script(spark, d) -> DataFrame:
    good, bad = pipelines.chimera_plan(ad.tags(spark, d), "block")
    return good.select("ord", "p", F.lit(True).alias("good")).unionByName(bad.select("ord", "p", F.lit(False).alias("good")))


@query()
def otu_pipeline(spark, d) -> DataFrame:
    return pipelines.otu_plan(ad.tags(spark, d), "block")


#: Writers are held against their readers: what is written is read back.
for _writer, _reader in {"sink_raw": "scan_raw", "sink_dat": "scan_dat", "sink_fasta": "scan_fasta", "sink_dist": "scan_dist", "sink_mapping": "scan_mapping", "sink_unique_map": "scan_unique_map"}.items():
    query(SQL[_reader], _writer)(QUERIES[_reader])
