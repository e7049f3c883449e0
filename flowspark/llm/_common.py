"""Helpers that the operators of this subpackage share: shared storage, word hashing over Arrow
buffers, joins that survive hot keys, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of bytes other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only where that is unset and
    everything runs on one machine (tests), a temporary folder; on a cluster that is an error."""
    where = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("flowspark.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="flowspark-")
        spark.conf.set("flowspark.shared.dir", where)
    return where.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back: its lineage ends there, and it
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Deletes the files behind tables that cut() wrote, once nothing reads them any more. Spark has no public call
    for that, and only its own file systems reach every shared folder."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema_with(df: DataFrame, *more: tuple[str, T.DataType]) -> T.StructType:
    """The schema of df and further columns, whatever its names are."""
    return T.StructType([*df.schema.fields, *(T.StructField(name, kind) for name, kind in more)])


# ---------------------------------------------------------------- words


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n."""
    if len(_powers[0]) < n:
        m = max(n, 1 << 16)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            x = np.full(m, b, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mixer on uint64."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: doc (row of the text), start and end (byte positions in data, which
    holds the texts back to back), h (64-bit hash) and first (number of each text's first word; one
    more entry than texts)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.cast(pa.large_string())
        if texts.null_count:
            texts = texts.fill_null("")
        n = len(texts)
        _, where, body = texts.buffers()
        off = np.frombuffer(where, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
        data = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and n else np.zeros(0, np.uint8)
        off = off - off[0]
        self.data, self.off = data, off
        gap = _GAP[data]
        word = ~gap
        head, tail = word.copy(), word.copy()
        head[1:] &= gap[:-1]
        tail[:-1] &= gap[1:]
        full = off[1:] > off[:-1]
        at = off[:-1][full]
        head[at] = word[at]
        at = off[1:][full] - 1
        tail[at] = word[at]
        self.start, self.end = np.flatnonzero(head), np.flatnonzero(tail) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(n), np.diff(self.first))
        pw, inverse = powers(len(data) + 1)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data] if lower else data] * pw[: len(data)], out=prefix[1:])
        self._sums = prefix, inverse
        self.h = self.head(None)

    def head(self, k: int | None) -> np.ndarray:
        """Hash of the first k bytes of each word; of the whole word with None."""
        prefix, inverse = self._sums
        end = self.end if k is None else np.minimum(self.start + k, self.end)
        return mix64((prefix[end] - prefix[self.start]) * inverse[self.start] + (end - self.start).astype(np.uint64))

    def grams(self, k: int, salt: int = 0) -> np.ndarray:
        """Hash of the k words from each position; positions too near the end of all words are absent,
        those that run over a text's end are to be masked with inside(k)."""
        return grams(self.h, k, salt)

    def inside(self, k: int) -> np.ndarray:
        return self.doc[k - 1 :] == self.doc[: max(0, len(self.doc) - k + 1)]


def grams(h: np.ndarray, k: int, salt: int = 0) -> np.ndarray:
    m = max(0, len(h) - k + 1)
    pw, inverse = powers(len(h) + 1)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum((mix64(h + np.uint64(salt)) if salt else h) * pw[: len(h)], out=prefix[1:])
    return mix64((prefix[k : k + m] - prefix[:m]) * inverse[:m])


def pieces_of(batch: pa.RecordBatch, column: int, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about limit bytes of text, a row at least."""
    import pyarrow.compute as pc

    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        done = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


# ---------------------------------------------------------------- joins on hot keys


#: A key counts as hot where it holds more than this share of the rows, so there are at most 1/HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def hot_keys(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Of a table with one row for each key and its number of rows: the keys with over HOT_SHARE of all
    rows. There are fewer than 1/HOT_SHARE = 1000 of them whatever the data, which bounds the broadcast."""
    total = counts.agg(F.sum(n).alias("_all"))
    return counts.join(F.broadcast(total), F.col(n) > F.greatest(F.lit(64.0), F.col("_all") * HOT_SHARE)).drop("_all")


def heavy_join(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "left") -> DataFrame:
    """rows joined with groups (one row a key, n rows of which are in rows), where one key may hold any
    share of the rows: hot keys meet their rows by a broadcast of fewer than 1000 groups, all others by a
    shuffle join. how: left or inner."""
    rest = [c for c in groups.columns if c != key]
    hot = hot_keys(groups, key, n)
    marked = rows.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    by_broadcast = marked.where("_hot").drop("_hot")
    by_shuffle = marked.where("_hot IS NULL").drop("_hot", *rest).join(groups, key, how)
    return by_broadcast.unionByName(by_shuffle)


#: Parts that the links of one node are dealt in.
SALTS = 64


def _least(pairs: DataFrame) -> DataFrame:
    """x, y with m, the smallest y of each x. An x may hold any share of the rows: its rows are dealt in SALTS parts, each
    part has a least of its own, and what is joined back is a row a part."""
    salted = pairs.withColumn("_s", F.pmod(F.xxhash64("y"), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy("x", "_s").agg(F.min("y").alias("m"))
    least = parts.select("x", "_s").join(parts.groupBy("x").agg(F.min("m").alias("m")), "x")
    return salted.join(least, ["x", "_s"]).select("x", "y", "m")


def _print(links: DataFrame) -> tuple:
    """Number of links, and two sums of their hashes: two sets of links with equal prints are equal."""
    sums = (F.sum(F.xxhash64(F.lit(k), "v", "u").cast("decimal(38,0)")) for k in (1, 2))
    return tuple(links.agg(F.count(F.lit(1)), *sums).first())


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node that edges reach from it) for each node of edges(a, b).

    Alternating large-star and small-star steps, which keep the number of edges and end after a number of
    rounds that grows with the logarithm of the longest path; they go on until nothing changes. Each round is cut
    in the shared folder. The links of a giant component's centre are dealt to many tasks. Only a count and two sums
    come to the driver."""
    both = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    now = cut(both, "links")
    seen = None
    while True:
        # large star: each node's larger neighbours go to its smallest neighbour (itself included)
        near = now.select(F.col("v").alias("x"), F.col("u").alias("y")).union(now.select("u", "v"))
        large = _least(near).where("y > x").select(F.col("y").alias("x"), F.least("m", "x").alias("y")).distinct()
        # small star: each node and its smaller neighbours go to the smallest of these
        step = F.array(F.struct(F.col("y").alias("v"), F.col("m").alias("u")), F.struct(F.col("x").alias("v"), F.col("m").alias("u")))
        small = _least(large).select(F.explode(step).alias("e")).select("e.v", "e.u").where("u <> v").distinct()
        after = cut(small, "links")
        drop_cut(now)
        now, before, seen = after, seen, _print(after)
        if seen == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def long_of(x: np.ndarray) -> np.ndarray:
    """uint64 as the int64 of the same bits, as Spark has no unsigned type."""
    return np.ascontiguousarray(x, np.uint64).view(np.int64)
