"""Queries take whole tables and whole texts."""

import glob
import os

import pyarrow.parquet as pq
import pytest

from flowspark import queries as Q

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows_of(name):
    return pq.read_table(glob.glob(f"{DATA}/{name}.parquet")[0]).to_pylist()


def test_triangle_of_all_rows(spark):
    x = [round(abs(float(r["embedding"][0])), 4) for r in sorted(rows_of("embeddings"), key=lambda r: r["vec_id"])]
    got = {(r["i"], r["j"]): r["d"] for r in Q.QUERIES["sink_dist"](spark, DATA).collect()}
    assert len(got) == len(x) * (len(x) - 1) // 2 > 60 * 59 // 2
    assert all(abs(d - abs(x[i] - x[j])) < 1e-6 for (i, j), d in got.items())


def dna(text):
    return "".join("ACGT"[(ord(c.upper()) - 65) % 4] for c in text if c.isascii() and c.isalpha())


def test_sequences_have_all_bases_of_the_texts(spark):
    from flowspark import adapters as ad

    docs = rows_of("documents")
    assert max(len(dna(r["text"])) for r in docs) > 60
    assert {r["ord"]: r["seq"] for r in ad.seqs(spark, DATA).collect()} == {r["doc_id"]: dna(r["text"]) for r in docs}
    assert {r["ord"]: r["seq"] for r in ad.tags(spark, DATA).collect()} == {r["p_partkey"]: dna(r["p_name"]) for r in rows_of("part")}


def test_pairs_of_all_sequences(spark):
    from flowspark import adapters as ad

    reads = {r["ord"]: r for r in ad.tags(spark, DATA).collect()}
    sizes = {}
    for r in reads.values():
        sizes[r["block"]] = sizes.get(r["block"], 0) + 1
    got = Q.QUERIES["all_pairs"](spark, DATA)
    assert {r["block"]: r["count"] for r in got.groupBy("block").count().collect()} == {b: n * (n - 1) // 2 for b, n in sizes.items() if n > 1}
    for r in got.collect():
        a, b = (reads[r[x]]["seq"].ljust(20, ".") for x in "ij")
        assert reads[r["i"]]["block"] == reads[r["j"]]["block"] == r["block"] and abs(r["d"] - sum(x != y for x, y in zip(a, b)) / 20) < 1e-8


def test_whole_texts_collapse(spark):
    docs = {r["doc_id"]: dna(r["text"]) for r in rows_of("documents")}
    got = {r["ord"]: r["rep_ord"] for r in Q.QUERIES["fasta_unique"](spark, DATA).collect()}
    assert set(got) == set(docs) and all(docs[r].startswith(docs[k]) for k, r in got.items())
    reps = {docs[r] for r in got.values()}
    assert len(reps) == len(set(got.values())) == sum(not any(t != s and t.startswith(s) for t in set(docs.values())) for s in set(docs.values()))


def test_blocks_come_from_the_data(spark):
    """Pairs of a label, and of a source and language, however far their ids are apart."""
    labels = {r["vec_id"]: r["label"] for r in rows_of("embeddings")}
    want = {(i, j) for i in labels for j in labels if j < i and labels[i] == labels[j]}
    assert {(r["i"], r["j"]) for r in Q.QUERIES["flow_dist"](spark, DATA).select("i", "j").collect()} == want
    from flowspark import adapters as ad

    place = {r["doc_id"]: f"{r['source']}/{r['lang']}" for r in rows_of("documents")}
    assert {(r["ord"], r["block"]) for r in ad.seqs(spark, DATA).collect()} == set(place.items())


def test_prefixes_are_in_the_collapse(spark, tmp_path):
    """Against the greedy order on small texts, most of them prefixes of others."""
    import random

    r = random.Random(2)
    long = ["".join(r.choice("abcd") for _ in range(40)) for _ in range(6)]
    texts = [t[: r.randint(14, 40)] for t in long for _ in range(6)]
    spark.createDataFrame([(k, t, "en", "a") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    seqs, into = [dna(t) for t in texts], list(range(len(texts)))
    for i in range(len(seqs)):
        for j in range(i + 1, len(seqs)):
            if into[i] == i and into[j] == j:
                short, whole = (i, j) if len(seqs[i]) <= len(seqs[j]) else (j, i)
                if seqs[whole].startswith(seqs[short]):
                    into[short] = whole

    def root(k):
        return k if into[k] == k else root(into[k])

    got = {r["ord"]: r["rep_ord"] for r in Q.QUERIES["fasta_unique"](spark, str(tmp_path)).collect()}
    assert got == {k: root(k) for k in range(len(seqs))} and any(seqs[k] != seqs[v] for k, v in got.items())
    maps = {r["rep_ord"]: r["members"] for r in Q.QUERIES["prefix_collapse"](spark, str(tmp_path)).collect()}
    assert maps == {v: ",".join(str(k) for k in sorted(got) if got[k] == v) for v in set(got.values())}


def test_distinct_patterns_of_all_flows(spark, tmp_path):
    """Copies are one pattern; reads that differ from the fifth flow on are not."""
    base = [0.1] * 64
    vectors = [base, base[:4] + [0.3] + base[5:], base, base[:63] + [0.4]]
    spark.createDataFrame([(k, v, 0) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted((r["first_ord"], r["weight"]) for r in Q.QUERIES["calc_unique"](spark, str(tmp_path)).collect()) == [(0, 2), (1, 1), (3, 1)]


def test_a_late_primer_is_found(spark, tmp_path):
    text = "C" * 16 + "BADD"
    assert dna(text) == "G" * 16 + "CATT"
    spark.createDataFrame([(0, text, "en", "a")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["tag"] for r in Q.QUERIES["split_by_key_rejects"](spark, str(tmp_path)).collect()] == ["G" * 16]


def test_a_level_has_all_orders(spark):
    lines = {r["l_orderkey"] for r in rows_of("lineitem")}
    want = {(r["o_custkey"] // 4, r["o_orderkey"]) for r in rows_of("orders") if r["o_orderkey"] in lines}
    number = {c: k for k, c in enumerate(sorted({c for c, _ in want}))}  # clusters stand in a line by their places
    got = [tuple(r) for r in Q.QUERIES["scan_list"](spark, DATA).collect()]
    assert set(got) == {(number[c], str(m)) for c, m in want} and len(got) == len(want)
    assert sum(len(r["reads"].split(",")) for r in Q.QUERIES["list_to_reads"](spark, DATA).collect()) == len(want)


def test_clusters_come_from_all_files_of_the_writer(spark, monkeypatch):
    """What the writer leaves out is missed."""
    from pyspark.sql import functions as F

    from flowspark.sources import sinks

    assert {r["cluster"] for r in Q.QUERIES["sink_clusters"](spark, DATA).where("members IS NOT NULL").collect()} == {r["o_custkey"] for r in rows_of("orders")}
    write = sinks.sink_clusters
    monkeypatch.setattr(sinks, "sink_clusters", lambda rows, stub, path: write(rows.withColumn("quality", F.slice("quality", 1, 1)), stub, path))
    assert Q.QUERIES["sink_clusters"](spark, DATA).where("members IS NOT NULL").count() == 0
