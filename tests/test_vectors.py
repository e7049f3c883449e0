"""Worked cases of the published formats and steps, as fixed values."""

import pytest
from pyspark.sql import functions as F

from flowspark.functions import flows as fl
from flowspark.functions import sequences as sq
from flowspark.operators import mapping, split
from flowspark.sources import sff, sinks, text

# One read's flows, steps between its bases and clip points, and its raw record.
FLOWS = [101, 1, 99, 2, 0, 103, 2, 100, 0, 111, 110, 1, 3, 108, 0, 2, 107, 0, 0, 103, 101, 1, 13, 102, 0, 8, 204, 12, 0, 105, 1, 290, 2, 92, 7, 98, 9, 6, 98, 4, 101, 10, 0, 199, 5, 299, 3, 101, 4, 99]
STEPS = [1, 2, 3, 2, 2, 1, 3, 3, 3, 1, 3, 3, 0, 3, 2, 0, 0, 2, 2, 3, 2, 3, 0, 2, 0, 0, 2, 2, 3, 0, 2, 1, 3, 3, 0, 3, 0, 1, 0, 3, 2, 0, 2, 3, 0, 3, 0, 2, 0, 0]
RAW = "30 1.01 0.01 0.99 0.02 0.00 1.03 0.02 1.00 0.00 1.11 1.10 0.01 0.03 1.08 0.00 0.02 1.07 0.00 0.00 1.03 1.01 0.01 0.13 1.02 0.00 0.08 2.04 0.12 0.00 1.05 0.01 2.90 0.02 0.92 0.07 0.98 0.09 0.06 0.98 0.04 1.01 0.10 0.00 1.99 0.05 2.99 0.03 1.01 0.04 0.99"
# Two mappings, one of whose lists is of the other's names.
INNER = [("x_0_1", ["HNURVDS01DLT4H"]), ("x_1_2", ["HNURVDS01CZVIU", "HNURVDS01D26KT"]), ("x_2_3", ["HNURVDS01CC1CQ", "HNURVDS01DKD2V", "HNURVDS01B4O4G"]), ("x_3_1", ["HNURVDS01A8G9D"]), ("x_4_1", ["HNURVDS01B7BIK"]), ("x_5_1", ["HNURVDS01A660L"])]


def test_flows_to_bases(spark):
    rows = spark.createDataFrame([([18, 103, 102, 70, 112, 7, 14, 465],)], "f array<int>")
    assert rows.select(fl.flow_to_seq("f")).first()[0] == "ACGTGGGGG"


def test_raw_record_of_a_read(spark, tmp_path):
    rows = spark.createDataFrame([(0, "FTWCYXX01BTPDQ", 4, 14, FLOWS, STEPS)], "ord long, read_id string, clip_left int, clip_right int, flows array<int>, flow_index array<int>")
    sinks.sink_raw(sff.sff_to_raw(rows), str(tmp_path / "x"), "AC", "name")
    lines = "".join(p.read_text() for p in sorted((tmp_path / "x").glob("part-*")))
    assert lines == f"1 AC name\n>FTWCYXX01BTPDQ\n{RAW}\n"


@pytest.mark.parametrize("quad, good", [([100, 100, 0, 100], True), ([100, 100, 949, 20], True), ([100, 100, 951, 20], False), ([100, 100, 100, 70], True), ([100, 100, 100, 60], False), ([0, 0, 0, 0], False)])
def test_fours_of_flows(spark, quad, good):
    assert spark.createDataFrame([(quad,)], "q array<int>").select(fl.flowgram_is_valid(F.col("q"))).first()[0] is good


def test_five_flows_are_an_error(spark):
    with pytest.raises(Exception, match="more than four"):
        spark.createDataFrame([([0, 1, 2, 3, 4],)], "q array<int>").select(fl.flowgram_is_valid(F.col("q"))).collect()


def test_tag_is_cut_off(spark):
    seq = "CGATCTAAGTTCATAACCCATCCAAGGAATGGAGGTTCTTTCTGATGCTTTTTGTCTGGTGTAGTGAATCCCCAGCTCAATAGGTGAGCT"
    rows = spark.createDataFrame([(seq,), ("T" + seq,)], "s string")
    assert [r[0] for r in rows.select(sq.truncate_tag("s", "GCGATCT", 20)).collect()] == ["AAGTTCATAACCCA", ("T" + seq)[:20]]


def test_barcode_sheets(spark, tmp_path):
    def sheet(body):
        (tmp_path / "b.csv").write_text(body)
        return split.check_barcodes(text.scan_barcodes(spark, str(tmp_path / "b.csv"))).collect()

    assert [r["name"] for r in sheet("Barcode1,ACGTGA,ACGT,Data from patient X\nBarcode2,ACTGAA,ACGT,Data from patient Y")] == ["Barcode1", "Barcode2"]
    for body in ("Barcode1,ACGTGA,ACGT\nBarcode2,ACGTGA,ACGT", "Barcode1,ACGTGA,ACGT\nBarcode1,ACGTGG,ACGT"):
        with pytest.raises(ValueError, match="repeated"):
            sheet(body)


def test_mappings_are_named_and_merged(spark, tmp_path):
    (tmp_path / "x.mapping").write_text("".join(f"{m[0]} {','.join(m)}\n" for _, m in INNER))
    (tmp_path / "y.mapping").write_text("x_noise_0_1 " + ",".join(f"x-noise_{n.split('_', 1)[1]}" for n, _ in INNER) + "\n")
    inner = text.scan_mapping(spark, str(tmp_path / "x.mapping"))
    assert [(r["name"], r["members"]) for r in inner.orderBy("ord").collect()] == INNER
    outer = text.scan_mapping(spark, str(tmp_path / "y.mapping"))
    assert outer.first()["name"] == "y_0_9"
    names = inner.select(F.regexp_replace("name", "^x_", "x-noise_").alias("cluster_id"), "ord", "members")
    merged = mapping.merge_mapping(outer.withColumnRenamed("name", "cluster_id"), names).first()
    assert (merged["cluster_id"], merged["members"]) == ("y_0_9", [r for _, m in INNER for r in m])
