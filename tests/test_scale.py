"""Many partitions, several files and several samples: no row is lost, and none is taken for another."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.functions import kernels
from flowspark.operators import chimera, cluster, mapping, ordinals, pairs, split, stage, unique
from flowspark.plans import pipelines
from flowspark.sources import sff, sinks, text


@pytest.fixture()
def many_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def dat(spark, n, mark):
    return spark.range(n).repartition(13).select(F.col("id").alias("ord"), (F.col("id") % 40).cast("int").alias("len"), F.array(F.lit(mark), F.col("id").cast("int")).alias("flows"))


def test_joined_tables_keep_every_row(spark, many_partitions):
    a, b = dat(spark, 60_000, 1), dat(spark, 50_000, 2).withColumn("ord", F.col("ord") * 3)  # sparse numbers are made dense
    for _ in range(2):
        got = mapping.dat_join(a, b).select("ord", F.get("flows", F.lit(0)).alias("t"), F.get("flows", F.lit(1)).alias("k"))
        assert got.count() == 110_000 and got.select("ord").distinct().count() == 110_000
        assert got.where("ord <> IF(t = 1, k, 60000 + k)").count() == 0


def test_ordinals_behind_a_shuffle_are_whole(spark, many_partitions):
    rows = spark.range(100_000).select((F.col("id") * 7919 % 100_003).alias("v"), F.repeat(F.lit("x"), 50).alias("wide"))
    got = ordinals.with_ordinal(rows.repartitionByRange("v").sortWithinPartitions("v"))
    assert got.agg(F.count("*"), F.count_distinct("ord"), F.max("ord")).first()[:] == (100_000, 100_000, 99_999)
    assert got.where("ord <> 0").join(got.select((F.col("ord") + 1).alias("ord"), F.col("v").alias("before")), "ord").where("v <= before").count() == 0


def test_ordinals_follow_files_by_name(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        want = []
        for name, n in (("b.txt", 30), ("a.txt", 900), ("c.txt", 400)):
            lines = [f"{name}-{k:04d}" for k in range(n)]
            (tmp_path / name).write_text("\n".join(lines) + "\n")
            want += lines
        got = ordinals.with_ordinal(spark.read.text(str(tmp_path)), scan=True).orderBy("ord").collect()
        assert [r["value"] for r in got] == sorted(want) and [r["ord"] for r in got] == list(range(len(want)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_folder_of_files_with_headers(spark, tmp_path):
    for k, n in enumerate((3, 0, 2)):
        (tmp_path / f"x{k}.dat").write_text(f"{n} 2\n" + "".join(f"r{k}{i} 2 1.00 0.0{i}\n" for i in range(n)))
    got = text.scan_dat(spark, f"{tmp_path}/*.dat").orderBy("ord").collect()
    assert [(r["ord"], r["read_id"]) for r in got] == [(0, "r00"), (1, "r01"), (2, "r02"), (3, "r20"), (4, "r21")]
    for k in range(2):
        (tmp_path / f"y{k}.raw").write_text(f"2 AC y\n>a{k}\n1 1.00\n>b{k}\n1 2.00\n")
    got = text.scan_raw(spark, f"{tmp_path}/*.raw").orderBy("ord").collect()
    assert [(r["ord"], r["read_id"]) for r in got] == [(0, "a0"), (1, "b0"), (2, "a1"), (3, "b1")]


def test_writers_deal_lines_and_leave_nothing_half(spark, tmp_path, many_partitions):
    rows = spark.range(5000).repartition(9).select(F.col("id").alias("ord"), F.concat(F.lit("r"), F.col("id").cast("string")).alias("read_id"), F.lit(2).alias("len"), F.array(F.lit(100), F.col("id").cast("int") % 900).alias("flows"))
    path = str(tmp_path / "d")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sinks.sink_dat(rows, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "d").glob("part-*"))) > 1
    assert [r["read_id"] for r in text.scan_dat(spark, path).orderBy("ord").collect()] == [f"r{k}" for k in range(5000)]
    sinks.join_parts(spark, path, str(tmp_path / "whole.dat"))
    lines = (tmp_path / "whole.dat").read_text().splitlines()
    assert lines[0] == "5000 2" and [x.split()[0] for x in lines[1:]] == [f"r{k}" for k in range(5000)]
    with pytest.raises(Exception, match="broken"):
        sinks.sink_fasta(rows.select("ord", F.col("read_id").alias("seq_id"), F.when(F.col("ord") == 4000, F.raise_error(F.lit("broken"))).otherwise("A").alias("seq")), path)
    assert [r["read_id"] for r in text.scan_dat(spark, path).where("ord < 2").orderBy("ord").collect()] == ["r0", "r1"]
    assert {p.name for p in tmp_path.iterdir()} <= {"d", "whole.dat", ".whole.dat.crc"}


def sff_read(name, bases):
    return {"read_id": name, "clip_left": 0, "clip_right": len(bases), "flows": [100] * 8, "flow_index": [1] * len(bases), "bases": bases, "quals": [30] * len(bases)}


def test_two_binary_files_are_split_by_read(spark, tmp_path):
    (tmp_path / "a.sff").write_bytes(sff.build_sff([sff_read("a0", "TCAGACGGTT"), sff_read("a1", "TCAGCTGGTT")], "TACGTACG"))
    (tmp_path / "b.sff").write_bytes(sff.build_sff([sff_read("b0", "TCAGCTGGTT"), sff_read("b1", "TCAGACGGTT"), sff_read("b2", "TCAG")], "TACGTACG"))
    codes = spark.createDataFrame([(0, "s1", "AC", "GG"), (1, "s2", "CT", "GG"), (2, "s3", "ACG", "G")], "ord int, name string, barcode string, primer string")
    codes = codes.join(split.check_barcodes(codes).select("name", "primer_re"), "name")
    reads = sff.scan_sff(spark, [str(tmp_path / "a.sff"), str(tmp_path / "b.sff")])
    want = {"a0": "s3", "a1": "s2", "b0": "s2", "b1": "s3", "b2": "unmatched"}  # the last of the table wins over all lengths
    done = split.split_by_barcode(reads, codes)
    assert {r["read_id"]: r["sample"] for r in done.collect()} == want
    found = sff.sink_sff(done, f"file://{tmp_path}/out", "sample", "TACGTACG").collect()
    assert {r["sample"]: r["n"] for r in found} == {"s3": 2, "s2": 2, "unmatched": 1}
    assert {r["read_id"] for r in sff.scan_sff(spark, f"{tmp_path}/out/s3.sff").collect()} == {"a0", "b1"}
    sinks.sink_split_raw(done.withColumn("clip", F.col("clip_right")), str(tmp_path / "raw"))
    assert [r["read_id"] for r in text.scan_raw(spark, f"{tmp_path}/raw/sample=s2").orderBy("ord").collect()] == ["a1", "b0"]
    assert text.raw_header(spark, f"{tmp_path}/raw/sample=s2").first()["count"] == 2


def test_many_barcodes_meet_reads_by_a_shuffle(spark, monkeypatch):
    reads = spark.createDataFrame([(0, "TCAGACGT"), (1, "TCAGCCGT"), (2, "TCAGGGGT")], "ord long, bases string")
    codes = spark.createDataFrame([(k, f"s{k}", b, "G") for k, b in enumerate(("AC", "CC", "TT"))], "ord int, name string, barcode string, primer_re string")
    want = split.split_by_barcode(reads, codes).orderBy("ord").collect()
    monkeypatch.setattr(split, "BROADCAST_ROWS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = split.split_by_barcode(reads, codes)
        plan = got._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and got.orderBy("ord").collect() == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


# ---------------------------------------------------------------- collapse


def plain_collapse(seqs):
    into = list(range(len(seqs)))
    for i in range(len(seqs)):
        for j in range(i + 1, len(seqs)):
            if into[i] != i:
                break
            if into[j] == j:
                if len(seqs[i]) > len(seqs[j]):
                    if seqs[i].startswith(seqs[j]):
                        into[j] = i
                elif seqs[j].startswith(seqs[i]):
                    into[i] = j

    def root(k):
        return k if into[k] == k else root(into[k])

    return [root(k) for k in range(len(seqs))]


def test_collapse_in_the_greedy_order(spark):
    """Small alphabets, so nearly all sequences are copies, prefixes or extensions of others."""
    r = random.Random(11)
    cases = [["ACG", "ACGT", "ACGA", "ACGT"], ["ACG", "ACGT", "ACGT"], ["ACGT", "A", "AC", "AT", "A"], ["", "A", ""], ["AC", "ACA", "AC", "ACC", "AC", "ACA", "AC"]]
    cases += [["".join(r.choice("AC" if k % 2 else "A") for _ in range(r.randint(0, 6))) for _ in range(r.randint(1, 16))] for k in range(250)]
    rows, want, at = [], {}, 0
    for k, seqs in enumerate(cases):
        for p, root in enumerate(plain_collapse(seqs)):
            rows.append((f"b{k}", at + p, f"q{at + p}", None if seqs[p] == "" and p % 2 else seqs[p]))
            want[at + p] = at + root
        at += len(seqs)
    seqs = spark.createDataFrame(rows, "block string, ord long, seq_id string, seq string")
    got = unique.fasta_unique(seqs, "block").collect()
    assert {x["ord"]: x["rep_ord"] for x in got} == want and len(got) == len(rows) and all(x["rep_id"] == f"q{x['rep_ord']}" for x in got)
    one = spark.createDataFrame([r[1:] for r in rows], "ord long, seq_id string, seq string")
    whole = plain_collapse([r[3] or "" for r in rows])
    assert {x["ord"]: x["rep_ord"] for x in unique.fasta_unique(one).collect()} == dict(enumerate(whole))


def test_sequences_behind_a_primer_do_not_all_meet(spark):
    """What shares a primer and no more is no candidate pair."""
    r = random.Random(2)
    rows = [(k, f"q{k}", "CAGGGAGCTGGAAAG" + "".join(r.choice("ACGT") for _ in range(r.randint(60, 120)))) for k in range(300)]
    rows += [(300 + k, f"p{k}", rows[k][2][:50]) for k in range(50)]
    seqs = spark.createDataFrame(rows, "ord long, seq_id string, seq string")
    distinct = seqs.select(F.col("ord").alias("first"), F.col("ord").alias("last"), "seq")
    assert unique._longer(distinct, []).count() == 50
    assert {x["ord"]: x["rep_ord"] for x in unique.fasta_unique(seqs).where("ord >= 300").collect()} == {300 + k: k for k in range(50)}


# ---------------------------------------------------------------- samples


def test_samples_are_split_apart(spark):
    r = random.Random(4)
    base = ["".join(r.choice("ACGT") for _ in range(30)) for _ in range(6)]
    sample = lambda name, picks: [(name, k, f"{name}{k}", base[p][: 30 - k % 3]) for k, p in enumerate(picks)]
    x, y = sample("x", [0, 1, 2, 3, 0, 1]), sample("y", [0, 4, 5, 0, 1, 4, 5])
    make = lambda rows: spark.createDataFrame(rows, "block string, ord long, seq_id string, seq string")
    told = lambda rows: {(q["block"], q["ord"]): q["split"] for q in pipelines.split_plan(make(rows), "block", 3, 2).collect()}
    both = told(x + y)
    assert both == told(x) | told(y) and len(both) == len(x) + len(y)


def test_ordinals_of_a_block_may_be_sparse(spark):
    items = spark.createDataFrame([("b", k, float(k)) for k in (3, 10**12, 10**15)], "block string, ord long, v double")
    got = pairs.all_pairs(items, "v", lambda a, b: np.abs(np.array(a) - np.array(b)), "block").collect()
    assert {(r["i"], r["j"]) for r in got} == {(10**12, 3), (10**15, 3), (10**15, 10**12)}


def test_several_trees_in_a_file(spark, tmp_path):
    (tmp_path / "t").write_text("(0:1.000,1:1.000);\n(0:2.000,\n1:2.000);\n")
    assert sorted((r["child"], r["branch"]) for r in text.scan_newick(spark, str(tmp_path / "t")).collect()) == [("0", 1.0), ("0", 2.0), ("1", 1.0), ("1", 2.0)]


def test_lists_of_blocks(spark, tmp_path):
    merges = spark.createDataFrame([("a/b", 0, 1, 0, 0.25), ("c", 0, 1, 0, 0.15), ("c", 1, 2, -1, 0.35)], "block string, step int, left int, right int, dist float")
    levels = cluster.cut_levels(merges, "block", 0.1)
    sinks.sink_lists(levels, "block", str(tmp_path / "l"))
    got = sorted((r["block"], r["value"]) for r in spark.read.text(str(tmp_path / "l" / "list")).collect())
    assert got == [("a/b", "0.000000 2 0 1"), ("a/b", "0.100000 2 0 1"), ("c", "0.000000 3 0 1 2"), ("c", "0.100000 3 0 1 2"), ("c", "0.200000 2 0,1 2")]


def test_no_private_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        stage.shared_folder(Session())


def test_a_table_in_parts_is_read_in_their_order(spark, tmp_path):
    """Spark packs large files first: the second part here would come before the first."""
    values = [f"{k}.5" for k in range(110)]
    for name, part in (("part-0", values[:20]), ("part-1", [*values[20:], ""])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    table, priors = text.scan_lookup(spark, str(tmp_path), 10)
    assert priors.tolist() == [11 * k + 0.5 for k in range(10)] and table[9].tolist() == [100.5 + k for k in range(10)]
    for name, part in (("part-0", ["1,2,3,4"]), ("part-1", ["5,6,7,8", "9,10,11,12", "13,14,15,16"])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    assert text.scan_tran(spark, str(tmp_path)).ravel().tolist() == list(range(1, 17))


@pytest.mark.parametrize("full", [False, True])
def test_copies_are_compared_once(spark, full):
    """However many rows have two values, and however far apart they stand, a kernel sees the two once; d says how many
    pairs of a block it was given at a time."""
    items = spark.range(300).select((F.col("id") * 10).alias("ord"), (F.col("id") % 2).alias("block"), (F.col("id") % 6).cast("string").alias("v"))
    got = pairs.all_pairs(items, "v", lambda a, b: {"d": np.full(len(a), len(a)), "n": np.array([int(x) * 10 + int(y) for x, y in zip(a, b, strict=True)])}, "block", full=full, columns="d double, n int")
    rows = got.collect()
    want = {(b, i * 10, j * 10, i % 6 * 10 + j % 6) for b in range(2) for i in range(b, 300, 2) for j in range(b, 300, 2) if (i != j if full else j < i)}
    assert len(rows) == len(want) and {(r["block"], r["i"], r["j"], r["n"]) for r in rows} == want
    assert max(r["d"] for r in rows) <= 9


@pytest.mark.parametrize("method,scale,weighted", [("complete", True, False), ("average", False, True)])
def test_linkage_by_values_is_that_of_all_rows(spark, method, scale, weighted):
    """What is sent to a block's task grows with its distinct values, not with the square of its rows."""
    items = spark.range(60).select("id", (F.col("id") % 2).alias("block"), F.expr("id div 2").alias("ord"), (F.col("id") * 7 % 11).cast("string").alias("v"), (1.0 + F.col("id") % 3).alias("weight"))
    kernel = lambda a, b: np.array([abs(int(x) - int(y)) + int(x) / 100 for x, y in zip(a, b, strict=True)])
    found, weights = pairs.by_value(items, "v", kernel, "block"), items if weighted else None
    assert found.pairs.count() <= 2 * 11 * 11
    one, other = (cluster.linkage(x, "block", method, scale, weights).orderBy("block", "step").collect() for x in (found, pairs.all_pairs(items, "v", kernel, "block")))
    assert one == other and len(one) == 58


def plain_linkage(d):
    """The first least distance row by row below the diagonal, slots moved as the kernel says."""
    d, name, out = d.copy(), list(range(len(d))), []
    for k in range(len(d) - 1):
        m = len(d) - k
        least, high, into = min((d[i, j], i, j) for i in range(m) for j in range(i))
        out.append((name[high], name[into], float(least)))
        row = np.maximum(d[high], d[into])
        d[into], d[:, into] = row, row
        name[into], name[high] = -k - 1, name[m - 1]
        d[high], d[:, high] = d[m - 1].copy(), d[:, m - 1].copy()
    return out


def test_a_block_of_copies_is_linked_in_a_byte_a_cell():
    """Distances by values that are not the same in both directions, with zeros between other values."""
    r = np.random.default_rng(7)
    for _ in range(20):
        m, n = int(r.integers(2, 6)), int(r.integers(8, 40))
        number = np.concatenate([np.arange(m), r.integers(0, m, n - m)])
        table = r.integers(0, 5, (m, m)).astype(np.float32) / np.float32(7)
        np.fill_diagonal(table, 0)
        p, q = np.divmod(np.arange(m * m), m)
        found = pd.DataFrame({"p": p, "q": q, "d": table.ravel()})
        levels = np.unique(table)
        codes = cluster.by_number(found, number, levels=levels)
        assert codes.dtype == np.uint8
        merges, heights = kernels.linkage(codes, own=True, levels=levels)
        want = plain_linkage(cluster.by_number(found, number))
        assert [(*x, float(h)) for x, h in zip(merges.tolist(), heights, strict=True)] == want
        levels = kernels.cut_levels(merges, heights, n, 0.1)
        assert levels == [(k, kernels.cut(merges, heights, n, k * 0.1)) for k in range(len(levels))]


def test_cuts_of_many_blocks_are_many_tasks(spark, many_partitions):
    """Few bytes of merges are much work: their blocks must not be put into one task by their size."""
    merges = spark.range(64).select(F.col("id").alias("block"), F.lit(0).alias("step"), F.lit(1).alias("left"), F.lit(0).alias("right"), F.lit(0.25).cast("float").alias("dist"))
    for found in (cluster.cut_levels(merges, "block", 0.1), cluster.cut_at(merges, "block", 0.3), cluster.split_even(merges, "block", 1, 1)):
        assert found.select(F.spark_partition_id().alias("t")).distinct().count() > 8


def test_rows_of_one_text_and_frequency_have_one_query():
    """Each row's query is that of its own candidates; names may stand for several rows, or for none of the references."""
    r = random.Random(5)
    for case in range(30):
        n = 60
        texts, freq = [r.choice(["AC", "ACG", "TTG", "G"]) for _ in range(n)], [float(r.randint(1, 3)) for _ in range(n)]
        names = [f"q{r.randrange(n) if case % 2 else k}" for k in range(n)]
        number = np.unique(texts, return_inverse=True)[1]
        queries, which = chimera._queries([*names, "new"], [*freq, 2.0], [*texts, "ACG"], names, np.array(freq), number)
        for name, least, seq, k in zip([*names, "new"], [*freq, 2.0], [*texts, "ACG"], which, strict=True):
            at = [j for j in range(n) if names[j] != name and freq[j] >= least]
            if len(at) < 2 or len(seq) < 2:
                assert k == 0
                continue
            want = {max((j for j in at if texts[j] == t), key=lambda j: (freq[j], -j)): min(j for j in at if texts[j] == t) for t in {texts[j] for j in at}}
            got = queries[k - 1]
            assert (got.seq, got.at.tolist(), got.first, min(got.candidates, 3)) == (seq, sorted(want), want, min(len(at), 3))
    n = 3000
    queries, which = chimera._queries([f"q{k}" for k in range(n)], [1.0 + k % 2 for k in range(n)], ["ACG" if k % 3 else "ATT" for k in range(n)], [f"q{k}" for k in range(n)], np.array([1.0 + k % 2 for k in range(n)]), np.minimum(np.arange(n) % 3, 1))
    assert len(which) == n and min(which) == 1 and len(queries) <= 12


def test_pairs_of_texts_are_compared_once_for_many_blocks(spark):
    """Blocks with the same texts share what a worker found, and a block's size takes no join; t says in which call of the
    kernel a result was made."""
    import uuid

    items = spark.range(1200).select("id", (F.col("id") % 300).alias("block"), F.col("id").alias("ord"), F.expr("cast(id div 300 as string)").alias("v"))
    kernel = lambda a, b: {"t": np.full(len(a), uuid.uuid4().int % (1 << 40)), "n": np.array([int(x) * 10 + int(y) for x, y in zip(a, b, strict=True)])}
    got = pairs.all_pairs(items, "v", kernel, "block", columns="t double, n int")
    rows = got.collect()
    assert {(r["block"], r["i"], r["j"], r["n"]) for r in rows} == {(b, b + 300 * x, b + 300 * y, 10 * x + y) for b in range(300) for x in range(4) for y in range(x)}
    assert len({r["t"] for r in rows}) < 100
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
