"""Formats: what is written is read back; texts of other tools are read."""

import pytest
from pyspark.sql import functions as F

from flowspark.sources import sff, sinks, text
from flowspark.streaming import reads as streams


def write(tmp_path, name, body):
    (tmp_path / name).write_text(body)
    return str(tmp_path / name)


def test_raw(spark, tmp_path):
    path = write(tmp_path, "x.raw", "2 ACGT x\n>r1\n4 0.99 0.02 1.09 0.07 6.00\n>r2\n2 1.00 2.01\n")
    rows = text.scan_raw(spark, path).orderBy("ord").collect()
    assert [(r["read_id"], r["clip"], r["flows"]) for r in rows] == [("r1", 4, [99, 2, 109, 7, 600]), ("r2", 2, [100, 201])]
    assert text.scan_raw(spark, path, exact=False).where("ord = 1").first()["flows"] == [100, 200]
    assert text.raw_header(spark, path).first().asDict() == {"count": 2, "barcode": "ACGT", "name": "x"}


def test_dat_with_and_without_ids(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 2, [100, 5]), (1, "b", 1, [250, 0])], "ord long, read_id string, len int, flows array<int>")
    sinks.sink_dat(rows, str(tmp_path / "d"))
    assert text.scan_dat(spark, str(tmp_path / "d")).orderBy("ord").collect() == rows.orderBy("ord").collect()
    plain = write(tmp_path, "n.dat", "1 2\n2 1.00 0.05\n")
    assert text.scan_dat(spark, plain, ids=False).first()["read_id"] == "0"


def test_fasta(spark, tmp_path):
    path = write(tmp_path, "x.fa", ">a_0_7 more\nACG\nTTx\n>b\nacgt\n")
    rows = text.scan_fasta(spark, path, "ACGTacgt").orderBy("ord").collect()
    assert [(r["seq_id"], r["weight"], r["seq"]) for r in rows] == [("a_0_7", 7.0, "ACGTT"), ("b", 1.0, "ACGT")]


def test_dist_triangle_and_square(spark, tmp_path):
    path = write(tmp_path, "x.dist", "3\na\nb\nc\n0.1\n0.2\n0.3\n")
    got = {(r["i"], r["j"]): round(r["d"], 6) for r in text.scan_dist(spark, path, ids=True).collect()}
    assert got == {(1, 0): 0.1, (2, 0): 0.2, (2, 1): 0.3}
    assert [r["seq_id"] for r in text.dist_ids(spark, path).orderBy("ord").collect()] == ["a", "b", "c"]
    square = write(tmp_path, "f.dist", "2\n0 0.2\n0.4 0\n")
    assert round(text.scan_dist(spark, square, full=True).first()["d"], 6) == 0.3


def test_places_in_a_large_triangle(spark):
    i, j = text.triangle_place(F.col("p"))
    n = 3_000_000_000
    rows = spark.createDataFrame([(n * (n - 1) // 2,), (n * (n - 1) // 2 + n - 1,), (0,)], "p long").select(i.alias("i"), j.alias("j")).collect()
    assert [(r["i"], r["j"]) for r in rows] == [(n, 0), (n, n - 1), (1, 0)]


def test_sffinfo(spark, tmp_path):
    good = ">r1\n  # of Bases:   3\n  Clip Qual Left:   1\n  Clip Qual Right:   2\nFlowgram:\t1.00\t0.00\t2.01\nFlow Indexes:\t1\t3\t3\nBases:\tTCC\nQuality Scores:\t40\t40\t40\n"
    path = write(tmp_path, "x.txt", "Common Header:\n  # of Reads:    2\n  # of Flows:    3\n\n" + good + "\n" + good.replace("r1", "r2").replace("\t2.01", ""))
    rows = text.scan_sffinfo(spark, path).collect()
    assert [(r["read_id"], r["clip"], r["flows"], r["quals"]) for r in rows] == [("r1", 3, [100, 0, 201], [40, 40, 40])]


def test_mapping_and_lists(spark, tmp_path):
    path = write(tmp_path, "m.mapping", "r a,b\nq x_noise_0_3,x_noise_1_1\n")
    assert [(r["name"], r["members"]) for r in text.scan_mapping(spark, path).orderBy("ord").collect()] == [("m_0_2", ["a", "b"]), ("m_1_4", ["x_noise_0_3", "x_noise_1_1"])]
    path = write(tmp_path, "x.list", "0.000000 3 0 1 2 \n0.010000 2 0,2 1 \n")
    assert [r["members"] for r in text.scan_levels(spark, path).where("level = 1").orderBy("cluster").collect()] == [["0", "2"], ["1"]]


def test_newick():
    rows = text.parse_newick("((0:0.100,2:0.100):0.400,1:0.500);")
    assert ("-1", "0", 0.1) in rows and ("-2", "-1", 0.4) in rows and ("-2", "1", 0.5) in rows


def test_sff_round_trip(spark, tmp_path):
    read = {"read_id": "r1", "clip_left": 4, "clip_right": 6, "flows": [100, 0, 205, 7], "flow_index": [1, 2, 0, 1, 0, 0], "bases": "TCCGGG", "quals": [40] * 6}
    data = sff.build_sff([read, read | {"read_id": "longer-name"}], "TACG")
    assert sff.parse_sff(data)[0] == read
    (tmp_path / "x.sff").write_bytes(data)
    rows = sff.sff_to_raw(sff.scan_sff(spark, str(tmp_path / "x.sff"))).orderBy("ord").collect()
    assert [(r["read_id"], r["clip"]) for r in rows] == [("r1", 4), ("longer-name", 4)]
    with pytest.raises(ValueError, match="SFF"):
        sff.parse_sff(b"nothing at all")


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", 0, 12, [100, 0, 100, 0, 0, 100, 0, 100, 100, 0, 0, 0]), ("b", 1, 12, [100, 0, 100, 0, 0, 100, 0, 100, 100, 0, 0, 0])], "read_id string, ord long, clip int, flows array<int>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"))
    run = streams.pattern_counts(stream).writeStream.format("memory").queryName("patterns").outputMode("complete").start()
    run.processAllAvailable()
    run.stop()
    assert [r["weight"] for r in spark.sql("SELECT weight FROM patterns").collect()] == [2]
    done = streams.write_samples(streams.clean_stream(stream, min_flows=4).withColumn("sample", F.lit("s")), str(tmp_path / "out"), str(tmp_path / "check"))
    done.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
