"""The files of clusters."""

import gzip
import os
import time

import pyarrow as pa
from pyspark.sql import functions as F

from flowspark.operators import pairs
from flowspark.sources import sinks, text


def test_many_clusters_have_files_in_no_time(spark, tmp_path):
    """A command for each of 3000 files takes longer; a cluster without members has none, and what an earlier run left is
    gone."""
    rows = spark.range(3001).select((F.col("id") * 3).alias("cluster"), F.when(F.col("id") < 3000, F.transform(F.sequence(F.lit(0), (F.col("id") % 3).cast("int")), lambda k: F.concat_ws("-", "id", k))).otherwise(F.array()).alias("members"))
    os.makedirs(tmp_path / "k" / "old")
    start = time.time()
    sinks._named_when_done(spark, f"file://{tmp_path}/k", lambda work: sinks._sink_members(rows, work))
    assert time.time() - start < 15
    want = {(str(k * 3), tuple(f"{k}-{m}" for m in range(k % 3 + 1))) for k in range(3000)}
    assert {(r["cluster"], tuple(r["members"])) for r in text.scan_members(spark, str(tmp_path / "k")).collect()} == want
    assert sorted(os.listdir(tmp_path / "k")) == ["0", "1", "2"] and (tmp_path / "k" / "1" / "i_4098").read_text() == "1366-0\n1366-1\n"


def test_clusters_off_the_disk_are_the_same(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(1, ["a", "b"]), (22, ["c"])], "cluster long, members array<string>")
    where = f"{tmp_path}/k"
    sinks._sink_members(rows, where)
    one = text.scan_members(spark, where).orderBy("cluster").collect()
    monkeypatch.setattr(sinks, "disk_path", lambda *_: None)
    monkeypatch.setattr(text, "disk_path", lambda *_: None)
    sinks._sink_members(rows, where + "2")
    assert one == text.scan_members(spark, where + "2").orderBy("cluster").collect()


def test_lines_of_a_triangle_are_made_once(spark, tmp_path, monkeypatch):
    """A triangle's length is known, so its lines are not made a first time to find ranges; parts follow each other."""
    monkeypatch.setattr(sinks, "LINES", 7)
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return float(x)

    rows = spark.range(100, numPartitions=3).select((F.floor((1 + F.sqrt(1 + 8 * F.col("id"))) / 2)).alias("i"), "id").select("i", (F.col("id") - F.expr("i * (i - 1) div 2")).alias("j"), "id").where("i < 12")
    sinks.sink_dist(rows.select("i", "j", seen("id").alias("d")), 12, f"file://{tmp_path}/d")
    assert made.value == 66
    lines = [line for name in sorted(os.listdir(tmp_path / "d")) if name.startswith("part-") for line in (tmp_path / "d" / name).read_text().split()]
    assert lines[0] == "12" and [float(x) for x in lines[1:]] == list(range(66))
    assert {(r["i"], r["j"]) for r in text.scan_dist(spark, f"{tmp_path}/d").collect()} == {(i, j) for i in range(12) for j in range(i)}


def test_a_placed_triangle_is_written_without_a_shuffle(spark, tmp_path):
    """Pairs are made in the file's order, so its lines are not sent to other tasks; packed parts follow each other."""
    values = spark.createDataFrame([(k, float((7 * k) % 11)) for k in range(12)], "ord long, x double")
    rows = pairs.triangle(values, 12, 7)
    assert rows.rdd.getNumPartitions() >= 10 and "Exchange hash" not in (plan := rows._jdf.queryExecution().toString()) and "Exchange range" not in plan
    assert [(r["i"], r["j"], r["a"], r["b"]) for r in rows.collect()] == [(i, j, float(7 * i % 11), float(7 * j % 11)) for i in range(12) for j in range(i)]
    sinks.sink_dist(rows.select("i", "j", (F.col("a") * 100 + F.col("b")).alias("d")), 12, f"file://{tmp_path}/d", placed=True, compression="gzip")
    names = [name for name in sorted(os.listdir(tmp_path / "d")) if name.startswith("part-")]
    lines = [line for name in names for line in gzip.decompress((tmp_path / "d" / name).read_bytes()).decode().split()]
    want = {(i, j): 7 * i % 11 * 100 + 7 * j % 11 for i in range(12) for j in range(i)}
    assert lines[0] == "12" and [float(x) for x in lines[1:]] == list(want.values())
    assert {(r["i"], r["j"]): r["d"] for r in text.scan_dist(spark, f"{tmp_path}/d").collect()} == want


def test_the_head_of_a_distance_file_is_read_by_itself(spark, tmp_path, monkeypatch):
    """Its first line is found without numbering all lines; words behind a value, and empty files, are no harm."""
    folder = tmp_path / "a b[1]"
    folder.mkdir()
    for name, lines in (("part-0", ""), ("part-1", "3 x\n0.125\n"), ("part-2", " 0.25\tb\n0.5\r\n")):
        (folder / name).write_bytes(lines.encode())
    got = text.scan_dist(spark, f"{tmp_path}/a b*").collect()
    assert {(r["i"], r["j"]): r["d"] for r in got} == {(1, 0): 0.125, (2, 0): 0.25, (2, 1): 0.5}
    whole = spark.range(1).select(F.raise_error(F.lit("all lines were read")).cast("bigint").alias("_line"), F.lit("1").alias("_v"))
    monkeypatch.setattr(text, "_lines", lambda *_: whole)
    assert text.scan_dist(spark, f"{tmp_path}/a b*").columns == ["i", "j", "d"]


def test_a_square_meets_its_mirror_image_by_tiles(spark, tmp_path, monkeypatch):
    """No cell is a row of a shuffle: 1300 x 1300 cells are sent in some thousand pieces. Ragged lines keep what they have."""
    n = 1300
    values = spark.createDataFrame([(k, float((7 * k) % 11)) for k in range(n)], "ord long, x double")
    rows = pairs.square(values, n, 100_000).select("i", F.transform("b", lambda b, j: F.when(j == F.col("i"), 0.0).otherwise(F.col("a") * 100 + b)).alias("d"))
    sinks.sink_rows(rows, n, f"file://{tmp_path}/s", placed=True, compression="gzip")
    got = text.scan_dist(spark, f"{tmp_path}/s", full=True)
    table = got.toPandas()
    i, j = table["i"].to_numpy(), table["j"].to_numpy()
    assert len(table) == n * (n - 1) // 2 and len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(table) and (j < i).all()
    assert (table["d"] == ((7 * i % 11) * 101 + (7 * j % 11) * 101) / 2).all()
    assert "posexplode" not in got._jdf.queryExecution().toString()

    cells = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(4) for j in range(4)], "i int, j int, d double")
    sinks.sink_square(cells, 4, f"file://{tmp_path}/c")
    assert {(r["i"], r["j"]): r["d"] for r in text.scan_dist(spark, f"{tmp_path}/c", full=True).collect()} == {(i, j): 5.5 * (i + j) for i in range(4) for j in range(i)}
    (tmp_path / "ragged").write_text("3\n0 +2 4\n\t6  NaN 8 1e1\n2\n")
    got = {(r["i"], r["j"]): str(r["d"]) for r in text.scan_dist(spark, f"{tmp_path}/ragged", full=True).collect()}
    assert got == {(1, 0): "4.0", (2, 0): "3.0", (2, 1): "4.0", (3, 1): "5.0"}


def test_values_of_a_row_are_written_as_format_string_has_them(spark):
    values = [0.0, -0.0, 1.0, 1.0, 0.1234, 123456.789, 1e-300, -2.5e12, float("inf"), float("-inf"), float("nan"), None]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").select(F.format_string("%.8e", "d")).collect()]
    assert sinks._row_line(pa.array(values, pa.float64())).split(" ") == want
