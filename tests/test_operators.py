"""Operators over small DataFrames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import chimera, clean, cluster, em, mapping, ordinals, otu, pairs, split, unique
from flowspark.plans import cli, pipelines

KEY = [100, 0, 100, 0, 0, 100, 0, 100]


def encode(seq):
    """Flows of a sequence, key included."""
    flows, at, k = [], 0, 0
    while at < len(seq):
        n = 0
        while at < len(seq) and seq[at] == "TACG"[k % 4]:
            n, at = n + 1, at + 1
        flows.append(n * 100)
        k += 1
    return flows + [0] * (-len(flows) % 4)


def read_table(spark, seqs, block="b"):
    rows = [(block, k, f"r{k}", len(f := encode(s)), f) for k, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "block string, ord long, read_id string, clip int, flows array<int>")


def test_clean_reads_recovers_sequences(spark):
    reads = read_table(spark, ["TCAGCATTACGA", "TCAGGGGTTT", "ACGT"])
    got = {r["ord"]: r for r in clean.clean_reads(reads, "CAY", 4, 40).collect()}
    assert got[0]["passed"] and got[0]["seq"] == "CATTACGA" and got[0]["len"] % 4 == 0
    assert not got[1]["passed"] and not got[2]["passed"]
    assert clean.pass_fail(clean.clean_reads(reads, "CAY", 4, 40)).first().asDict() == {"passed": 1, "failed": 2}


def test_last_primer_wins_and_the_rest_is_unmatched(spark):
    codes = spark.createDataFrame([(0, "one", "AC", "GN"), (1, "two", "AC", "GT"), (2, "three", "CC", "A")], "ord int, name string, barcode string, primer string")
    codes = codes.join(split.check_barcodes(codes).select("name", "primer_re"), "name")
    reads = spark.createDataFrame([(0, "TCAGACGTTT"), (1, "TCAGACgcTT"), (2, "TCAGCCTT"), (3, "")], "ord long, bases string")
    for how in (split.split_by_barcode(reads, codes), split.split_equal_barcodes(reads, codes, 2)):
        assert {r["ord"]: r["sample"] for r in how.collect()} == {0: "two", 1: "one", 2: "unmatched", 3: "unmatched"}


@pytest.mark.parametrize("rows", [[("a", "AC", "G"), ("a", "CC", "G")], [("a", "AC", "G"), ("b", "AC", "G")]])
def test_repeated_barcodes_are_errors(spark, rows):
    with pytest.raises(ValueError, match="repeated"):
        split.check_barcodes(spark.createDataFrame(rows, "name string, barcode string, primer string"))


def test_ordinals_follow_the_file(spark, tmp_path):
    spark.range(1000).repartitionByRange(7, "id").write.parquet(str(tmp_path / "x"))
    got = ordinals.with_ordinal(spark.read.parquet(str(tmp_path / "x")), scan=True).collect()
    assert len(got) == 1000 and all(r["ord"] == r["id"] for r in got)


def test_prefixes_collapse_to_the_longest(spark):
    rows = spark.createDataFrame([(0, "a", "ACG"), (1, "b", "ACGT"), (2, "c", "ACGT"), (3, "d", "TTT"), (4, "e", "AC")], "ord long, seq_id string, seq string")
    got = {r["seq_id"]: r["rep_id"] for r in unique.fasta_unique(rows).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "d": "d", "e": "c"}
    maps = unique.unique_map(unique.fasta_unique(rows)).orderBy("rep_ord").collect()
    assert [(m["rep_id"], m["n"], m["members"]) for m in maps] == [("c", 4, [0, 1, 2, 4]), ("d", 1, [3])]


def test_tiles_give_every_pair_once(spark):
    items = spark.range(60).select(F.lit("b").alias("block"), F.col("id").alias("ord"), F.col("id").cast("double").alias("v"))
    kernel = lambda a, b: np.abs(np.array(a) - np.array(b))
    half = pairs.all_pairs(items, "v", kernel, "block", tile=16).collect()
    assert len(half) == len({(r["i"], r["j"]) for r in half}) == 60 * 59 // 2 and all(r["d"] == r["i"] - r["j"] > 0 for r in half)
    full = pairs.all_pairs(items, "v", kernel, "block", full=True, tile=16)
    assert full.count() == 60 * 59 and pairs.symmetrise(full).count() == 60 * 59 // 2


def test_even_splits_hold_each_leaf_once():
    from flowspark.functions import kernels as K

    d = np.random.default_rng(1).random((40, 40))
    merges, _ = K.linkage(np.maximum(d, d.T), "average")
    parts = cluster.even_splits(merges, 10, 4)
    assert sorted(x for _, m in parts for x in m) == list(range(40))
    assert all(len(m) <= 10 for name, m in parts if not name.endswith("+")) and all(len(m) >= 4 for name, m in parts if not name.endswith("+"))


def test_merge_mapping_keeps_the_order(spark):
    inner = spark.createDataFrame([(0, "p_0", ["a", "b"]), (1, "p_1", ["c"])], "ord long, cluster_id string, members array<string>")
    outer = spark.createDataFrame([("s_0", 0, ["p_1", "p_0"])], "cluster_id string, ord long, members array<string>")
    assert mapping.merge_mapping(outer, inner).first()["members"] == ["c", "a", "b"]
    with pytest.raises(Exception, match="no such cluster"):
        mapping.merge_mapping(outer.withColumn("members", F.array(F.lit("x"))), inner).collect()


def test_weighted_records(spark):
    rows = spark.createDataFrame([("a_0_2", "AC"), ("b_1_0", "GT")], "h string, s string")
    assert [(r["id"], r["seq"]) for r in mapping.wfasta_repeat(rows, "h", "s").orderBy("id").collect()] == [("a_0_2_0", "AC"), ("a_0_2_1", "AC")]
    assert mapping.min_frequency(rows, "h", 1).count() == 1 and mapping.count_weighted(rows, "h").first()["n"] == 2


def test_chunks_and_samples(spark):
    rows = spark.range(23).withColumnRenamed("id", "ord")
    got = [r["n"] for r in mapping.chunk(rows, 23, 4, 2).groupBy("chunk").agg(F.count("*").alias("n")).orderBy("chunk").collect()]
    assert got == [6, 5, 5, 5]
    assert mapping.sample_n(rows, 5).collect() == mapping.sample_n(rows, 5).collect() and mapping.sample_n(rows, 50).count() == 23


def test_otu_table(spark):
    rows = spark.createDataFrame([(1, "s2", 3), (1, "s10", 1), (2, "s2", 0)], "otu int, sample string, freq long")
    assert otu.sample_order(["s10", "s2"]) == ["s2", "s10"]
    assert [tuple(r) for r in otu.otu_table(rows, ["s2", "s10"]).collect()] == [(1, 3, 1)]


def test_both_forms_of_em_agree(spark):
    r = np.random.default_rng(2)
    d, w = r.random((12, 4)), np.array([3.0, 2.0, 0.05, 4.0])
    want = em.expectation(d, w, 9.0)
    rows = spark.createDataFrame([(i, k, float(d[i, k])) for i in range(12) for k in range(4)], "i int, k int, d double")
    got = em.expectation_step(rows, spark.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k int, w double"), 9.0).collect()
    have = np.zeros_like(want)
    for x in got:
        have[x["i"], x["k"]] = x["tau"]
    assert np.allclose(have, want)


def test_denoising_finds_the_true_sequences(spark):
    true = ["TCAGCATTACGACCA", "TCAGCAGGTACGTTA"]
    r = np.random.default_rng(4)
    rows = []
    for k in range(24):
        flows = np.maximum(0, np.array(encode(true[k % 2])) + r.normal(0, 6, len(encode(true[k % 2]))).round()).astype(int)
        rows.append(("b", k, f"r{k}", len(flows), flows.tolist()))
    reads = spark.createDataFrame(rows, "block string, ord long, read_id string, clip int, flows array<int>")
    out = pipelines.flow_denoise_plan(reads, "block", ".", 4, 40).collect()
    assert {(x["sequence"], x["weight"]) for x in out} == {(s[4:], 12) for s in true}
    assert sorted(m for x in out for m in x["members"]) == sorted(f"r{k}" for k in range(24))
    assert all(len(x["quality"]) >= len(x["sequence"]) for x in out)


def test_sequence_denoising_keeps_every_member(spark):
    base = "ACGTTGCAACGTTAGCCATG"
    seqs = [base] + [base[:k] + "A" + base[k + 1 :] for k in (3, 9)] + ["TTTTGGGGCCCCAAAATTTT"]
    rows = [("b", k, f"x_{k}_{w}", float(w), s) for k, (s, w) in enumerate(zip(seqs, (50, 1, 1, 30), strict=True))]
    out = pipelines.sequence_denoise_plan(spark.createDataFrame(rows, "block string, ord long, seq_id string, weight double, seq string"), "block", cutoff=1.5).collect()
    assert {(x["sequence"], x["weight"]) for x in out} == {(base, 52), (seqs[3], 30)}
    assert sorted(m for x in out for m in x["members"]) == sorted(r[2] for r in rows)


def test_a_made_up_chimera_is_found(spark):
    r = np.random.default_rng(6)
    a, b = ("".join(r.choice(list("ACGT"), 60)) for _ in range(2))
    rows = [("b", 0, "a_0_9", 9.0, a), ("b", 1, "b_1_9", 9.0, b), ("b", 2, "c_2_1", 1.0, a[:30] + b[30:])]
    seqs = spark.createDataFrame(rows, "block string, ord long, seq_id string, freq double, seq string")
    got = {x["i"]: x for x in chimera.chimera_check(seqs, "block").collect()}
    assert got[2]["class"] == "Chimera" and got[2]["best_chimera"] == 0 and {got[2]["p1"], got[2]["p2"]} == {0, 1} and got[2]["c_index"] == 0
    assert got[0]["class"] == "Null"
    good, bad = pipelines.chimera_plan(seqs, "block")
    assert {x["ord"] for x in good.collect()} | {x["ord"] for x in bad.collect()} == {0, 1, 2}


def test_full_plan_covers_all_reads(spark):
    reads = read_table(spark, ["TCAGCATTACGACCA"] * 5 + ["TCAGCAGGTACGTTA"] * 4)
    out = pipelines.full_plan(reads, "block", "CA", 4, 40, most=4, least=2).collect()
    assert sum(x["weight"] for x in out) == 9


def test_command_line_parses():
    args = cli.parser().parse_args(["truncate", "ACG", "220", "in.fa", "out"])
    assert args.length == 220 and args.command == "truncate"
