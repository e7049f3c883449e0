"""Flow and sequence expressions against worked values."""

import pytest
from pyspark.sql import functions as F

from flowspark.functions import flows as fl
from flowspark.functions import sequences as sq


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


def test_flow_to_seq(spark):
    assert one(spark, fl.flow_to_seq("f"), f=[18, 103, 102, 70, 112, 7, 14, 465]) == "ACGTGGGGG"
    assert one(spark, fl.flow_to_seq(F.array().cast("array<int>"))) == ""


def test_clip_points(spark):
    steps = [1, 2, 3, 2, 2, 1, 3, 1, 1, 2, 4, 3, 2, 3]
    found = one(spark, fl.find_clip("s", "l", "r"), s=steps, l=4, r=14)
    assert (found["left"], found["right"]) == (10, 30)


def test_hundredths_round_or_cut(spark):
    assert one(spark, fl.cast_hundredths("f"), f=[2.01, 0.5, 0.004]) == [201, 50, 0]
    assert one(spark, fl.cast_hundredths("f", exact=False), f=[2.01, 0.5]) == [200, 50]


def test_flows_to_string(spark):
    assert one(spark, fl.flows_to_string("f"), f=[99, 2, 109, 7, 600]) == "0.99 0.02 1.09 0.07 6.00"


def test_cumsum(spark):
    assert one(spark, fl.cumsum("f"), f=[1, 2, 3]) == [1, 3, 6]


@pytest.mark.parametrize("quad, valid", [([949, 0, 0, 100], True), ([951, 0, 0, 100], False), ([70, 100, 0, 0], True), ([60, 100, 0, 0], False), ([0, 0, 0, 0], False)])
def test_quads(spark, quad, valid):
    assert one(spark, fl.flowgram_is_valid(F.col("q")), q=quad) is valid


def test_five_flows_are_an_error(spark):
    with pytest.raises(Exception, match="more than four"):
        one(spark, fl.flowgram_is_valid(F.col("q")), q=[100] * 5)


def test_clean_prefix_skips_empty_quads(spark):
    flows = [100, 0, 0, 100, 0, 0, 0, 0, 0, 100, 0, 0, 60, 0, 100, 0]
    assert one(spark, fl.clean_prefix("f"), f=flows) == flows[:4]
    assert one(spark, fl.clean_prefix("f", max_empty=1), f=flows) == flows[:4] + flows[8:12]


def test_tags_and_headers(spark):
    seq = "CGATCTAAGTTCATAACCCATTGAC"
    assert one(spark, sq.truncate_tag("s", "GCGATCT", 20), s=seq) == "AAGTTCATAACCCA"
    assert one(spark, sq.truncate_tag("s", "TTTT", 5), s=seq) == seq[:5]
    assert one(spark, sq.parse_tag("s", "GTAAG", 4), s=seq) == "TTCA"
    head = one(spark, sq.parse_wheader("h"), h="a_b_3_17")
    assert (head["id"], head["index"], head["frequency"]) == ("a_b", 3, 17)
    with pytest.raises(Exception, match="no weighted header"):
        one(spark, sq.parse_wheader("h"), h="plain")
    assert one(spark, sq.read_weight("h"), h="x_2.5") == 2.5 and one(spark, sq.read_weight("h"), h="plain") == 1.0


def test_primers(spark):
    assert sq.iupac_pattern("CAYN") == "CA[CT][ACGT]"
    assert one(spark, sq.iupac_column("p"), p="caNW") == "CA[ACGT][AT]"
    assert one(spark, sq.strip_primer("s", "RY"), s="ACGG") == "GG"
    assert one(spark, sq.wrap("s", 3), s="ABCDEF") == "ABC\nDEF"
    assert one(spark, sq.accepted("s"), s="ACGNT") == "ACG"
