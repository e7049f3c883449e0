"""Writers of the text formats. Parquet is what stages hand on; these are for other tools. A folder is written whose
parts, joined in order of their names, are the file: lines are dealt to tasks by ranges of their number, so no task has
all of them. join_parts makes one file of them where another tool needs that."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.flows import flows_to_string

#: Numbers of clusters whose files share a folder.
FOLDER = 4096
#: Values in a part of a file whose length is known beforehand.
LINES = 1 << 20


def _ordered(lines: DataFrame, path: str, header: str | None = None, total: int | None = None, each: int = LINES, placed: bool = False, compression: str | None = None) -> None:
    """lines (_n, value) in order behind the header, in parts by ranges of _n. Where their total is known (_n from 0 on),
    the ranges are of that many each, and the lines are not made a first time to find them. Lines that are placed come in
    order, partition after partition, and each is a part as it comes: nothing is shuffled."""
    lines = lines.select(F.col("_n").cast("long").alias("_n"), "value")
    if header is not None:
        lines = lines.sparkSession.createDataFrame([(-1, header)], "_n long, value string").coalesce(1).unionByName(lines)
    if placed:
        write_whole(lines.select("value"), path, compression=compression)
        return
    if total is None:
        dealt = lines.repartitionByRange("_n")
    else:
        parts = max(1, -(-total // each))
        dealt = lines.repartitionById(parts, F.least(F.lit(parts - 1), F.expr(f"greatest(_n, 0) div {each}")).cast("int"))
    write_whole(dealt.sortWithinPartitions("_n").select("value"), path, compression=compression)


def write_whole(df: DataFrame, path: str, kind: str = "text", compression: str | None = None) -> None:
    """Writes into a folder beside path, which takes its name once the job has succeeded; a job that fails leaves path as
    it was and nothing else. Compressed parts (gzip), joined by name, are one compressed file."""
    to = df.write.format(kind)
    _named_when_done(df.sparkSession, path, (to.option("compression", compression) if compression else to).save)


def _named_when_done(spark: SparkSession, path: str, save: Callable[[str], None]) -> None:
    work = f"{path.rstrip('/')}.part-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, new = hadoop(path), hadoop(work)
    store = new.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        save(work)
        store.delete(old, True)
        if not store.rename(new, old):
            raise OSError(f"cannot name {path}")
    finally:
        store.delete(new, True)


def disk_path(spark: SparkSession, path: str) -> str | None:
    """path as the operating system knows it, or None for one that is not on a disk."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri()
    return at.getPath() if at.getScheme() == "file" else None


def join_parts(spark: SparkSession, path: str, to: str) -> None:
    """The parts of a folder as one file, copied by the driver a block at a time; it has its name once it is whole."""
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    folder, work = hadoop.fs.Path(path), hadoop.fs.Path(f"{to}.part-{uuid.uuid4().hex}")
    store = folder.getFileSystem(conf)
    names = sorted(str(f.getPath().getName()) for f in store.listStatus(folder) if str(f.getPath().getName()).startswith("part-"))
    out = store.create(work)
    try:
        for name in names:
            part = store.open(hadoop.fs.Path(folder, name))
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    store.delete(hadoop.fs.Path(to), False)
    store.rename(work, hadoop.fs.Path(to))


def sink_raw(reads: DataFrame, path: str, barcode: str = "", name: str = "") -> None:
    record = F.concat(F.lit(">"), "read_id", F.lit("\n"), F.concat_ws(" ", F.col("clip").cast("string"), flows_to_string("flows")))
    _ordered(reads.select(F.col("ord").alias("_n"), record.alias("value")), path, f"{reads.count()} {barcode} {name}")


def sink_dat(reads: DataFrame, path: str) -> None:
    line = F.concat_ws(" ", "read_id", F.col("len").cast("string"), flows_to_string("flows"))
    size = reads.agg(F.count(F.lit(1)), F.max(F.size("flows"))).first()
    _ordered(reads.select(F.col("ord").alias("_n"), line.alias("value")), path, f"{size[0]} {size[1] or 0}")


def sink_fasta(seqs: DataFrame, path: str, width: int | None = None) -> None:
    from ..functions.sequences import wrap

    body = wrap("seq", width) if width else F.col("seq")
    _ordered(seqs.select(F.col("ord").alias("_n"), F.concat(F.lit(">"), "seq_id", F.lit("\n"), body).alias("value")), path)


def sink_dist(distances: DataFrame, n: int, path: str, ids: list[str] | None = None, placed: bool = False, compression: str | None = None) -> None:
    """distances (i, j, d with j < i) as a triangle, one value a line. With placed they come in order of i and j, partition
    after partition (pairs.triangle), and are written as they come."""
    lines = distances.select((F.col("i") * (F.col("i") - 1) / 2 + F.col("j")).cast("long").alias("_n"), F.format_string("%.8e", F.col("d").cast("double")).alias("value"))
    _ordered(lines, path, "\n".join([str(n), *(ids or [])]), n * (n - 1) // 2, placed=placed, compression=compression)


def sink_square(cells: DataFrame, n: int, path: str) -> None:
    """All distances (i, j, d, with i = j too) as a square, a row a line."""
    rows = cells.groupBy("i").agg(F.sort_array(F.collect_list(F.struct("j", "d"))).alias("_c"))
    sink_rows(rows.select("i", F.col("_c.d").alias("d")), n, path)


def sink_rows(rows: DataFrame, n: int, path: str, placed: bool = False, compression: str | None = None) -> None:
    """The rows of a square (i, and d with all its distances in order), a line each; with placed they come in order, as of
    sink_dist."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch["_n"].slice(k, 1), pa.array([_row_line(batch["d"].slice(k, 1).flatten())], pa.string())], names=["_n", "value"])

    found = rows.select(F.col("i").cast("long").alias("_n"), F.col("d").cast("array<double>").alias("d")).mapInArrow(lines, "_n long, value string")
    _ordered(found, path, str(n), n, max(1, LINES // max(n, 1)), placed, compression)


def _row_line(d: pa.Array) -> str:
    """Values as format_string has them with %.8e; one that a row has often is made text once."""
    code = d.dictionary_encode()
    texts = [("NaN" if v != v else "Infinity" if v > 0 else "-Infinity") if v - v != 0 else f"{v:.8e}" for v in code.dictionary.to_pylist()]
    return " ".join(pa.array(texts, pa.string()).take(code.indices).fill_null("null").to_pylist())


def sink_lists(levels: DataFrame, block: str, path: str) -> None:
    """The lines of clusters (folder list) and of their sizes (folder otu) of each block's cuts (block, level, cutoff,
    cluster, members), a folder a block."""
    from ..operators.cluster import list_lines
    from ..operators.stage import staged

    # the cuts are made once, not for each folder and for the sample of the ranges
    lines = staged(list_lines(levels, block)).repartitionByRange(block).sortWithinPartitions(block, "level")
    for name in ("list", "otu"):
        lines.select(block, F.col(name).alias("value")).write.mode("overwrite").partitionBy(block).text(f"{path}/{name}")


def sink_levels(levels: DataFrame, path: str) -> None:
    """A list file of cuts (level, cutoff, cluster, members)."""
    one = levels.groupBy("level", "cutoff").agg(F.sort_array(F.collect_list(F.struct("cluster", "members"))).alias("_c"))
    text = F.concat_ws(" ", F.format_string("%f", "cutoff"), F.size("_c").cast("string"), F.array_join(F.transform("_c", lambda c: F.array_join(c["members"].cast("array<string>"), ",")), " "))
    _ordered(one.select(F.col("level").alias("_n"), text.alias("value")), path)


def sink_sizes(levels: DataFrame, path: str) -> None:
    """The table of cluster sizes of cuts (level, cutoff, cluster, members): cutoff, clusters, sizes."""
    one = levels.groupBy("level", "cutoff").agg(F.sort_array(F.collect_list(F.struct("cluster", F.size("members").alias("n")))).alias("_c"))
    text = F.concat_ws(" ", F.format_string("%f", "cutoff"), F.size("_c").cast("string"), F.array_join(F.col("_c.n").cast("array<string>"), " "))
    _ordered(one.select(F.col("level").alias("_n"), text.alias("value")), path)


def sink_tree(trees: DataFrame, path: str) -> None:
    """A Newick tree a line (tree), by order of block."""
    write_whole(trees.orderBy(trees.columns[0]).select("tree"), path)


def sink_mapping(mapping: DataFrame, path: str) -> None:
    _ordered(mapping.select(F.col("ord").alias("_n"), F.concat_ws(" ", "rep", F.array_join("members", ",")).alias("value")), path)


def sink_unique_map(maps: DataFrame, path: str) -> None:
    head = F.concat_ws(",", F.col("rep_ord").cast("string"), F.col("u").cast("string"), "rep_id", F.col("n").cast("string"))
    line = F.concat_ws(":", head, F.array_join(F.col("members").cast("array<string>"), ","), F.array_join("member_ids", ","))
    _ordered(maps.select(F.col("rep_ord").alias("_n"), line.alias("value")), path)


def cluster_fasta(clusters: DataFrame, stub: str) -> DataFrame:
    """ord, seq_id (<stub>_<cluster>_<weight>), seq of denoised clusters."""
    return clusters.select(F.col("cluster").alias("ord"), F.concat_ws("_", F.lit(stub), F.col("cluster").cast("string"), F.col("weight").cast("string")).alias("seq_id"), F.col("sequence").alias("seq"))


def sink_clusters(clusters: DataFrame, stub: str, path: str) -> None:
    """Sequences, mapping, and the members of each cluster in a file of its own."""
    sink_fasta(cluster_fasta(clusters, stub), f"{path}/{stub}_cd.fa", 80)
    sink_mapping(clusters.select(F.col("cluster").alias("ord"), F.col("representative").alias("rep"), "members"), f"{path}/{stub}.mapping")
    if "quality" in clusters.columns:
        text = F.concat(F.lit(f">{stub}_"), F.col("cluster").cast("string"), F.lit("\n"), F.array_join(F.col("quality").cast("array<string>"), " "))
        _ordered(clusters.select(F.col("cluster").alias("_n"), text.alias("value")), f"{path}/{stub}_cd.qual")
    _named_when_done(clusters.sparkSession, f"{path}/{stub}", lambda work: _sink_members(clusters.select("cluster", "members"), work))


def _sink_members(clusters: DataFrame, path: str) -> None:
    """A file i_<k> with the members of each cluster (a number) that has some, in folders of FOLDER numbers, each filled by
    one task. Hadoop's client runs a command for the permissions of each file of a disk, which takes milliseconds, so the
    tasks make the files themselves; elsewhere each cluster has a folder cluster=<k>."""
    where = disk_path(clusters.sparkSession, path)
    if where is None:
        clusters.select("cluster", F.explode("members").alias("value")).write.partitionBy("cluster").text(path)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for folder, cluster, members in zip(*(batch[n].to_pylist() for n in ("_folder", "cluster", "members")), strict=True):
                if folder not in made:
                    os.makedirs(f"{where}/{folder}", exist_ok=True)
                    made.add(folder)
                # not emptied first: another attempt of the task may have written it
                with os.fdopen(os.open(f"{where}/{folder}/i_{cluster}", os.O_WRONLY | os.O_CREAT, 0o666), "wb") as f:
                    f.write("".join(f"{m or ''}\n" for m in members).encode())
                    f.truncate()
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    os.makedirs(where)
    whole = clusters.where(F.size("members") > 0).withColumn("_folder", F.expr(f"cluster div {FOLDER}"))
    whole = whole.repartition("_folder").groupBy("_folder", "cluster").agg(F.flatten(F.collect_list("members")).alias("members"))
    whole.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def sink_split(split: DataFrame, path: str) -> None:
    """A folder a sample, written by all tasks at once."""
    split.write.mode("overwrite").partitionBy("sample").parquet(path)


def sink_split_raw(split: DataFrame, path: str) -> None:
    """The reads of each sample (sample, ord, read_id, clip, flows, and file where reads are of several) as raw records
    behind a line with their number, a folder a sample. Samples are dealt by ranges, so a large one is many parts."""
    place = F.struct(*(c for c in ("file", "ord") if c in split.columns))
    record = F.concat(F.lit(">"), "read_id", F.lit("\n"), F.concat_ws(" ", F.col("clip").cast("string"), flows_to_string("flows")))
    rows = split.select("sample", F.lit(1).alias("_k"), place.alias("_n"), record.alias("value"))
    heads = split.groupBy("sample").agg(F.count(F.lit(1)).alias("n")).select("sample", F.lit(0).alias("_k"), F.lit(None).cast(rows.schema["_n"].dataType).alias("_n"), F.concat_ws(" ", F.col("n").cast("string"), F.lit("-"), "sample").alias("value"))
    lines = heads.unionByName(rows).repartitionByRange("sample", "_k", "_n").sortWithinPartitions("sample", "_k", "_n")
    lines.select("sample", "value").write.mode("overwrite").partitionBy("sample").text(path)


def control_rows(counts: DataFrame, barcodes: DataFrame, output_format: str = "raw") -> DataFrame:
    """sample, control: a JSON description of each split."""
    joined = counts.join(barcodes.withColumnRenamed("name", "sample"), "sample")
    fields = F.struct("primer", "barcode", F.concat("sample", F.lit(f".{output_format}")).alias("sequence_file"), F.lit(output_format).alias("output_format"), F.col("n").alias("sequence_count"))
    return joined.select("sample", F.to_json(fields).alias("control"))


def sink_wfasta_table(table: DataFrame, path: str) -> None:
    """id, index, frequency, sequence as tab-separated values with a header."""
    table.write.mode("overwrite").csv(path, sep="\t", header=True)
