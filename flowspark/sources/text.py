"""Readers of the text formats. Records are split by Spark's text source, so large files are read in parallel. A path
may be a file, a folder or a pattern: files follow each other by name, and the order in them is kept as ord. A folder
that a writer of this package made is one file in parts; files with headers of their own may stand side by side too."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.flows import cast_hundredths
from ..functions.sequences import accepted, read_weight
from ..operators.ordinals import scan_ordinals, with_ordinal
from ..operators.stage import dealt
from .sinks import disk_path


#: Rows and columns of a tile in which a square's cells meet their mirror images.
SQUARE = 512


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return with_ordinal(spark.read.text(path), "_line", scan=True).withColumnRenamed("value", "_v")


def _first_line(spark: SparkSession, path: str) -> str:
    """The first line of the files in order, from the first file that has any; the others are not read."""
    scan = spark.read.text(path)
    for name in sorted(re.sub("^file:/+", "file:/", f) for f in scan.inputFiles()):  # as file_path has them
        if row := scan.where((F.col("_metadata.file_path") == name) & (F.col("_metadata.file_block_start") == 0)).first():
            return row["value"]
    return _lines(spark, path).where("_line = 0").first()["_v"]


def _records(spark: SparkSession, path: str, mark: str = ">") -> DataFrame:
    """Text between marks, in order, without what stands before the first of each file."""
    whole = scan_ordinals(spark.read.option("lineSep", mark).text(path))
    return whole.where(F.col("_line") > 0).select((F.col("_total") - F.col("_nth") - 1).alias("ord"), F.col("value").alias("_v"))


def _tokens(column: str) -> F.Column:
    return F.filter(F.split(F.trim(column), r"\s+"), lambda x: x != "")


def scan_raw(spark: SparkSession, path: str, exact: bool = True) -> DataFrame:
    """ord, read_id, clip, flows in hundredths (rounded, or cut off with exact=False)."""
    rows = _records(spark, path).select("ord", _tokens("_v").alias("t"))
    values = F.transform(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0))), lambda x: x.try_cast("double"))
    return rows.select("ord", F.get("t", F.lit(0)).alias("read_id"), F.get("t", F.lit(1)).try_cast("int").alias("clip"), cast_hundredths(values, exact).alias("flows"))


def raw_header(spark: SparkSession, path: str) -> DataFrame:
    """count, barcode, name of the first line."""
    t = _tokens("value")
    return spark.read.text(path).limit(1).select(F.get(t, F.lit(0)).try_cast("int").alias("count"), F.get(t, F.lit(1)).alias("barcode"), F.get(t, F.lit(2)).alias("name"))


def scan_dat(spark: SparkSession, path: str, ids: bool = True, exact: bool = True) -> DataFrame:
    """ord, read_id (the ordinal without ids), len, flows."""
    lines = scan_ordinals(spark.read.text(path)).where(F.trim("value") != "")
    # a file's first line of two whole numbers is its header; the parts of one file but the first have none
    head = (F.col("_line") == 0) & F.col("value").rlike(r"^\s*\d+\s+\d+\s*$")
    lines = lines.withColumn("_head", head)
    heads = lines.groupBy("_nth").agg(F.max(F.col("_head").cast("int")).alias("_h")).select("_nth", F.sum("_h").over(Window.orderBy("_nth")).alias("_heads"))  # a row a file
    rows = lines.where("NOT _head").join(F.broadcast(heads), "_nth").select((F.col("_total") - F.col("_heads")).alias("ord"), _tokens("value").alias("t"))
    skip = 1 if ids else 0
    values = F.transform(F.slice("t", skip + 2, F.greatest(F.size("t") - skip - 1, F.lit(0))), lambda x: x.try_cast("double"))
    name = F.get("t", F.lit(0)) if ids else F.col("ord").cast("string")
    return rows.select("ord", name.alias("read_id"), F.get("t", F.lit(skip)).try_cast("int").alias("len"), cast_hundredths(values, exact).alias("flows"))


def scan_fasta(spark: SparkSession, path: str, alphabet: str | None = None) -> DataFrame:
    """ord, seq_id (first word), weight (from the id), seq; each line up to its first character outside the alphabet."""
    rows = _records(spark, path).select("ord", F.split("_v", r"\r?\n").alias("l"))
    lines = F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0)))
    seq = F.array_join(F.transform(lines, lambda x: accepted(x, alphabet) if alphabet else F.trim(x)), "")
    name = F.get(F.split(F.get("l", F.lit(0)), r"\s+"), F.lit(0))
    return rows.select("ord", name.alias("seq_id"), read_weight(name).alias("weight"), F.upper(seq).alias("seq"))


def scan_sffinfo(spark: SparkSession, path: str) -> DataFrame:
    """ord, read_id, n_bases, clip_left, clip_right, flows, flow_indexes, bases, quals, clip (the flow of the last base
    kept) of a text dump. Reads whose number of flows is not the header's, or that lack a line, are left out."""
    whole = scan_ordinals(spark.read.option("lineSep", "\n>").text(path)).withColumn("value", F.regexp_replace("value", "^>", ""))
    whole = whole.withColumn("_header", F.col("value").rlike("^\\s*Common Header"))
    line = lambda name, kind: F.regexp_extract("value", f"(?m)^\\s*{name}:[ \\t]*(.*)$", 1).cast(kind)
    numbers = lambda name, kind: F.transform(F.filter(F.split(F.trim(line(name, "string")), r"\s+"), lambda x: x != ""), lambda x: x.try_cast(kind))
    head = whole.where("_total = 0").select(line("# of Flows", "string").try_cast("int").alias("_flows"))
    rows = whole.where("NOT _header").select(
        (F.col("_total") - 1).alias("ord"), F.get(F.split("value", r"\s+"), F.lit(0)).alias("read_id"), line("# of Bases", "string").try_cast("int").alias("n_bases"), line("Clip Qual Left", "string").try_cast("int").alias("clip_left"),
        line("Clip Qual Right", "string").try_cast("int").alias("clip_right"), cast_hundredths(numbers("Flowgram", "double")).alias("flows"), numbers("Flow Indexes", "int").alias("flow_indexes"), F.trim(line("Bases", "string")).alias("bases"), numbers("Quality Scores", "int").alias("quals"),
    )
    good = rows.join(F.broadcast(head), F.size("flows") == F.col("_flows")).where("clip_right IS NOT NULL AND size(flow_indexes) > 0").drop("_flows")
    return good.withColumn("clip", F.get("flow_indexes", F.col("clip_right") - 1))


def scan_flower(spark: SparkSession, path: str) -> DataFrame:
    """The variant with Clip, Flows, Index and Bases lines."""
    line = lambda name: F.trim(F.regexp_extract("_v", f"(?m)^\\s*{name}:[ \\t]*(.*)$", 1))
    numbers = lambda name, kind: F.transform(F.filter(F.split(line(name), r"\s+"), lambda x: x != ""), lambda x: x.try_cast(kind))
    rows = _records(spark, path).select("ord", F.get(F.split("_v", r"\s+"), F.lit(0)).alias("read_id"), numbers("Clip", "int").alias("_clip"), cast_hundredths(numbers("Flows", "double")).alias("flows"), numbers("Index", "int").alias("flow_indexes"), line("Bases").alias("bases"))
    return rows.withColumn("clip", F.get("flow_indexes", F.get("_clip", F.lit(1)) - 1)).withColumnRenamed("_clip", "clips")


def triangle_place(position: F.Column) -> tuple[F.Column, F.Column]:
    """(i, j) of a place in a lower triangle read row by row. The root is put right by whole numbers."""
    guess = F.floor((1 + F.sqrt(1 + 8 * position.cast("double"))) / 2).cast("bigint")
    before = lambda k: F.shiftright(k * (k - 1), 1)
    i = F.when(before(guess) > position, guess - 1).when(before(guess + 1) <= position, guess + 1).otherwise(guess)
    return i, position - before(i)


def scan_dist(spark: SparkSession, path: str, ids: bool = False, full: bool = False) -> DataFrame:
    """i, j, d (single precision): a triangle, or with full a square that is made symmetric by the mean."""
    lines = _lines(spark, path).where(F.trim("_v") != "")
    n = int(_first_line(spark, path).split()[0])
    skip = 1 + (n if ids else 0)
    values = lines.where(F.col("_line") >= skip).select((F.col("_line") - skip).alias("p"), "_v")
    if full:
        pieces = values.mapInArrow(_row_pieces, "row int, col int, i long, below boolean, d binary")
        return dealt(pieces, "row", "col").groupBy("row", "col").applyInArrow(_mean_of_pieces, "i long, j long, d float")
    i, j = triangle_place(F.col("p"))
    # a line that is a number as it stands is not cut into words first
    d = F.coalesce(F.col("_v").try_cast("float"), F.get(_tokens("_v"), F.lit(0)).cast("float"))
    return values.select(i.alias("i"), j.alias("j"), d.alias("d"))


def _row_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (p, _v) of a square, cut by columns into pieces of SQUARE values in single precision, for the tile of the
    lower triangle where each meets its mirror image: below, or that image."""
    kinds, rows = [("row", pa.int32()), ("col", pa.int32()), ("i", pa.int64()), ("below", pa.bool_()), ("d", pa.binary())], []

    def handed() -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])

    for batch in batches:
        for k, i in enumerate(batch["p"].to_pylist()):
            words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(batch["_v"].slice(k, 1))).flatten()
            try:
                v = words.cast(pa.float32()).to_numpy()
            except pa.ArrowInvalid:  # such as +1
                v = np.array([float(w) for w in words.to_pylist()], np.float32)
            own = i // SQUARE
            rows += [(max(own, c), min(own, c), i, c <= own, v[c * SQUARE : (c + 1) * SQUARE].tobytes()) for c in range(-(-len(v) // SQUARE))]
            if len(rows) >= 2048:
                yield handed()
                rows = []
    if rows:
        yield handed()


def _mean_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """i, j, d of a tile below the diagonal: half the sum of a cell and its mirror image, if there is one of them."""
    group = pa.Table.from_batches(batches)
    row, col = group["row"][0].as_py(), group["col"][0].as_py()
    total, found = np.zeros((SQUARE, SQUARE)), np.zeros((SQUARE, SQUARE), bool)
    for i, below, cells in zip(*(group[n].to_pylist() for n in ("i", "below", "d")), strict=True):
        v = np.frombuffer(cells, np.float32)
        for mirrored in (False, True) if row == col else (not below,):
            at = (slice(len(v)), i - col * SQUARE) if mirrored else (i - row * SQUARE, slice(len(v)))
            total[at] += v
            found[at] = True
    x, y = np.nonzero(np.tril(found, -1) if row == col else found)
    d = (total[x, y] / 2).astype(np.float32)
    yield pa.RecordBatch.from_arrays([pa.array(x + row * SQUARE), pa.array(y + col * SQUARE), pa.array(d)], names=["i", "j", "d"])


def dist_ids(spark: SparkSession, path: str) -> DataFrame:
    lines = _lines(spark, path)
    n = int(lines.where("_line = 0").first()["_v"].split()[0])
    return lines.where((F.col("_line") > 0) & (F.col("_line") <= n)).select((F.col("_line") - 1).alias("ord"), F.trim("_v").alias("seq_id"))


def scan_levels(spark: SparkSession, path: str, resolution: float = 0.01) -> DataFrame:
    """level, cutoff, cluster, members (names) of a list file."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(_tokens("value").alias("t"))
    cut = F.get("t", F.lit(0)).cast("double")
    return rows.select(F.round(cut / resolution).cast("int").alias("level"), cut.alias("cutoff"), F.posexplode(F.slice("t", 3, F.greatest(F.size("t") - 2, F.lit(0)))).alias("cluster", "_m")).select("level", "cutoff", "cluster", F.split("_m", ",").alias("members"))


def scan_mapping(spark: SparkSession, path: str, stem: str | None = None) -> DataFrame:
    """ord, rep, name (<stem>_<ord>_<sum of the members' weights>), members. Members named ...noise_<i>_<w> weigh w,
    others 1."""
    rows = _lines(spark, path).where(F.trim("_v") != "").select(F.col("_line").alias("ord"), _tokens("_v").alias("t"))
    members = F.split(F.get("t", F.lit(1)), ",")
    weight = lambda m: F.coalesce(F.regexp_extract(m, r"noise_\d+_(\d+)$", 1).try_cast("bigint"), F.lit(1).cast("bigint"))
    total = F.aggregate(F.transform(members, weight), F.lit(0).cast("bigint"), lambda a, x: a + x)
    stem = stem or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return rows.select("ord", F.get("t", F.lit(0)).alias("rep"), F.concat_ws("_", F.lit(stem), F.col("ord").cast("string"), total.cast("string")).alias("name"), members.alias("members"))


def scan_members(spark: SparkSession, path: str) -> DataFrame:
    """cluster (its number as text), members of each cluster's file. On a disk the folders are dealt to tasks, which list
    and read them: Spark's own listing holds every file in the driver."""
    where = disk_path(spark, path)
    if where is None:
        return spark.read.text(path).groupBy(F.col("cluster").cast("string").alias("cluster")).agg(F.collect_list("value").alias("members"))

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array(os.listdir(where), pa.string())], names=["folder"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["folder"].to_pylist():
                names, found = [n for n in os.listdir(f"{where}/{folder}") if n.startswith("i_")], []
                for name in names:
                    with open(f"{where}/{folder}/{name}", "rb") as f:
                        found.append(f.read().decode().removesuffix("\n").split("\n"))
                yield pa.RecordBatch.from_arrays([pa.array([n[2:] for n in names], pa.string()), pa.array(found, pa.list_(pa.string()))], names=["cluster", "members"])

    names = spark.range(0, 1, 1, 1).mapInArrow(folders, "folder string")
    return dealt(names, "folder").mapInArrow(read, "cluster string, members array<string>")


def scan_noise_mapping(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, members (in their order) of lines of a name and a list: the first of equal names counts."""
    rows = _lines(spark, path).where(F.trim("_v") != "").select("_line", _tokens("_v").alias("t"))
    named = rows.select("_line", F.get("t", F.lit(0)).alias("cluster_id"), F.filter(F.split(F.coalesce(F.get("t", F.lit(1)), F.lit("")), ","), lambda x: x != "").alias("members"))
    return named.groupBy("cluster_id").agg(F.max_by("members", "_line").alias("members"))


def scan_noise_dir(spark: SparkSession, pattern: str) -> DataFrame:
    """cluster_id, members from one FASTA file a cluster: the first record names it."""
    return noise_clusters(spark.read.text(pattern, wholetext=True))


def noise_clusters(files: DataFrame) -> DataFrame:
    """The same of whole texts (value). The first header may begin with two marks."""
    names = F.transform(F.filter(F.split("value", r"\n"), lambda l: l.startswith(">")), lambda l: F.get(F.split(F.regexp_replace(l, "^>+", ""), r"\s+"), F.lit(0)))
    return files.select(F.get(names, F.lit(0)).alias("cluster_id"), F.slice(names, 2, F.greatest(F.size(names) - 1, F.lit(0))).alias("members"))


def scan_unique_map(spark: SparkSession, path: str) -> DataFrame:
    """rep_ord, u, rep_id, n, members, member_ids of lines rep,u,id,n:ords:ids."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), ":").alias("p"))
    head = F.split(F.get("p", F.lit(0)), ",")
    listed = lambda k: F.filter(F.split(F.get("p", F.lit(k)), ","), lambda x: x != "")
    return rows.select(F.get(head, F.lit(0)).cast("bigint").alias("rep_ord"), F.get(head, F.lit(1)).cast("int").alias("u"), F.get(head, F.lit(2)).alias("rep_id"), F.get(head, F.lit(3)).cast("bigint").alias("n"), listed(1).cast("array<bigint>").alias("members"), listed(2).alias("member_ids"))


def parse_newick(text: str) -> list[tuple[str, str, float]]:
    """(parent, child, branch) of each node; leaves have their names, inner nodes -1, -2 ... in the order they close."""
    stack: list[list[tuple[str, float]]] = []
    rows, inner, at, last = [], 0, 0, ""
    while at < len(text) and text[at] != ";":
        c = text[at]
        if c == "(":
            stack.append([])
            at += 1
        elif c in ",)":
            at += 1
            if c == ")":
                inner += 1
                last = str(-inner)
                rows += [(last, child, branch) for child, branch in stack.pop()]
                if stack:
                    at, branch = _branch(text, at)
                    stack[-1].append((last, branch))
        elif c.isspace():
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in ":,();":
                end += 1
            name = text[at:end]
            at, branch = _branch(text, end)
            if stack:
                stack[-1].append((name, branch))
    return rows


def _branch(text: str, at: int) -> tuple[int, float]:
    if at >= len(text) or text[at] != ":":
        return at, 0.0
    end = at + 1
    while end < len(text) and text[end] not in ",();":
        end += 1
    return end, float(text[at + 1 : end])


def scan_newick(spark: SparkSession, path: str) -> DataFrame:
    """parent, child, branch of all trees under path; a tree is one value, parsed where it is read."""
    rows = spark.read.option("lineSep", ";").text(path).where(F.trim(F.regexp_replace("value", r"\s", "")) != "").mapInPandas(_trees, "parent string, child string, branch double")
    return rows


def _trees(batches):
    import pandas as pd

    for batch in batches:
        yield pd.DataFrame([r for t in batch["value"] for r in parse_newick(t)], columns=["parent", "child", "branch"])


def scan_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, barcode, primer; further fields are left out."""
    t = F.split("_v", ",")
    return _lines(spark, path).where(F.trim("_v") != "").select(F.col("_line").alias("ord"), *(F.trim(F.get(t, F.lit(k))).alias(n) for k, n in enumerate(("name", "barcode", "primer"))))


def scan_keyfile(spark: SparkSession, path: str) -> DataFrame:
    t = F.split("value", ",")
    return spark.read.text(path).where(F.trim("value") != "").select(F.trim(F.get(t, F.lit(0))).alias("name"), F.trim(F.get(t, F.lit(1))).alias("tag"))


def _first(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n lines that are not empty, in their order in the file, which Spark's own order of splits is not."""
    return _lines(spark, path).where(F.trim("_v") != "").orderBy("_line").limit(n)


def scan_lookup(spark: SparkSession, path: str, bins: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(table of 10 x bins, 10 priors): blocks of a prior and its bins, a value a line. Its size is fixed."""
    values = _first(spark, path, 10 * (bins + 1)).select(F.trim("_v").cast("double").alias("x")).toPandas()["x"].to_numpy()
    blocks = values.reshape(10, bins + 1)
    return blocks[:, 1:], blocks[:, 0]


def scan_tran(spark: SparkSession, path: str) -> np.ndarray:
    """4 x 4 costs over ACTG."""
    return np.array([[float(x) for x in r["value"].split(",")[:4]] for r in _first(spark, path, 4).select(F.col("_v").alias("value")).collect()])


def scan_chimeras(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, c_index, excess, loon, class of space-separated rows."""
    rows = _lines(spark, path).where(F.trim("_v") != "").select(F.col("_line").alias("ord"), _tokens("_v").alias("t"))
    number = lambda k: F.get("t", F.lit(k)).try_cast("double")
    return rows.select("ord", F.get("t", F.lit(1)).alias("id"), number(12).alias("c_index"), number(13).alias("excess"), number(14).alias("loon"), F.element_at("t", -1).alias("class"))


def scan_classes(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, p."""
    rows = _lines(spark, path).where(F.trim("_v") != "").select(F.col("_line").alias("ord"), _tokens("_v").alias("t"))
    return rows.select("ord", F.get("t", F.lit(0)).alias("id"), F.element_at("t", -1).try_cast("double").alias("p"))


def scan_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="otu string, lineage string")
