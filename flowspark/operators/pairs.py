"""All pairs within blocks, tile by tile, with vectorised kernels."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..sources.text import triangle_place
from .stage import dealt

TILE = 256
#: Pairs of texts whose results a worker keeps for the other blocks that have them, and how long both may be together.
KEPT, SHORT = 1 << 16, 256
#: Rows with one value that stand together in an item of a tile, pairs that a kernel takes at a time, and pairs of items
#: that are handed on at a time.
COPIES, KERNEL, BATCH = 64, 2048, 8192


def _blocked(items: DataFrame, block: str | None) -> tuple[DataFrame, str]:
    return (items, block) if block else (items.withColumn("_block", F.lit(0)), "_block")


def _distinct(items: DataFrame, value: str, by: str) -> DataFrame:
    """block, _number, _value, _members: the values of a block, numbered from 0 by their first rows, and the ordinals of
    the rows that have each."""
    values = items.groupBy(by, F.col(value).alias("_value")).agg(F.sort_array(F.collect_list(F.col("ord").cast("long"))).alias("_members"))
    place = Window.partitionBy(by).orderBy(F.get("_members", F.lit(0)), "_value")
    return values.withColumn("_number", F.row_number().over(place) - 1)


def _spread(items: DataFrame, by: str, tile: int) -> DataFrame:
    """items (_place within a block) once for each tile (_row, _col) of their row and column (_t). A block's rows lie
    together where they were numbered, so its size takes no join."""
    items = items.withColumn("_t", F.expr(f"_place div {tile}")).drop("_place").withColumn("_tiles", F.max("_t").over(Window.partitionBy(by)))
    place = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), "_tiles"), lambda k: F.struct(F.greatest("_t", k).alias("_row"), F.least("_t", k).alias("_col"))))
    return items.withColumn("_tile", place).drop("_tiles").select("*", "_tile._row", "_tile._col").drop("_tile")


#: Results of pairs of texts in this worker, of one query only: its name, and of each pair the columns.
_results: tuple[str, dict] = ("", {})


def _once(kernel: Callable, names: list[str], query: str, first: list, second: list) -> list:
    """The kernel's columns of each pair. Blocks often have the same short texts, and a pair of them gets the same in all:
    a worker keeps up to KEPT results and hands the rest to the kernel."""
    global _results
    known = _results[1] if _results[0] == query else {}
    _results = (query, known)
    pairs = list(zip(first, second, strict=True))
    new = [p for p in dict.fromkeys(pairs) if p not in known]
    found: dict = {}
    if new:
        columns = kernel([a for a, _ in new], [b for _, b in new])
        columns = columns if isinstance(columns, dict) else {names[0]: columns}
        if len(new) == len(pairs):
            rows = [columns[n] for n in names]
        found = dict(zip(new, zip(*(columns[n] for n in names), strict=True), strict=True))
        for p in new[: KEPT - len(known)]:
            if len(p[0] or "") + len(p[1] or "") <= SHORT:
                known[p] = found[p]
        if len(new) == len(pairs):
            return rows
    return [list(c) for c in zip(*(found[p] if p in found else known[p] for p in pairs), strict=True)]


def _compared(values: DataFrame, kernel: Callable, by: str, full: bool, tile: int, columns: str, members: bool) -> DataFrame:
    """Of each two values of which rows are compared the kernel's columns; with members block, _i, _j (ordinals of rows,
    some pairs of which may not be asked for), else block, p, q (numbers of values)."""
    fields = [c.strip().split() for c in columns.split(", ")]
    ends = (("_first", F.element_at("_members", 1)), ("_last", F.element_at("_members", -1)))
    if members:
        pieces = F.explode(F.transform(F.sequence(F.lit(0), F.expr(f"(size(_members) - 1) div {COPIES}")), lambda k: F.slice("_members", k * COPIES + 1, COPIES)))
        items = values.withColumn("_members", pieces)
        items = items.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy("_number", F.element_at("_members", 1))) - 1)
    else:
        items = values.withColumn("_place", F.col("_number"))
    spread = _spread(items.withColumns(dict(ends)).drop(*([] if members else ["_members"])), by, tile)

    texts, query = dict(values.dtypes)["_value"] == "string", uuid.uuid4().hex
    types = {"double": pa.float64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    names = [by, *(("_i", "_j") if members else ("p", "q")), *(f[0] for f in fields)]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).combine_chunks()
        of = {name: group[name].chunk(0) for name in (by, "_value")} | ({"_members": group["_members"].chunk(0).cast(pa.list_(pa.int64()))} if members else {})
        t, number = group["_t"].to_numpy(), group["_number"].to_numpy().astype(np.int64)
        first, last = group["_first"].to_numpy(), group["_last"].to_numpy()
        row, col = group["_row"][0].as_py(), group["_col"][0].as_py()
        rows, cols = np.flatnonzero(t == row), np.flatnonzero(t == col)
        known = dict(zip(number.tolist(), of["_value"].to_pylist(), strict=True))
        most = int(number.max()) + 1
        for a, b in [(rows, cols)] + ([(cols, rows)] if row != col else []):
            if full:  # all but a row with itself
                asked = (first[a][:, None] != last[b][None, :]) | (first[b][None, :] != last[a][:, None])
            else:
                asked = last[a][:, None] > first[b][None, :]
            x, y = np.nonzero(asked)
            x, y = a[x], b[y]
            pair, which = np.unique(number[x] * most + number[y], return_inverse=True)
            order = np.argsort(which, kind="stable")
            at = np.searchsorted(which[order], np.arange(0, len(pair) + KERNEL, KERNEL))
            for k, lo in enumerate(range(0, len(pair), KERNEL)):
                some = pair[lo : lo + KERNEL]
                ends = [known[n] for n in (some // most).tolist()], [known[n] for n in (some % most).tolist()]
                if texts:
                    found = _once(kernel, [n for n, _ in fields], query, *ends)
                else:
                    found = kernel(*ends)
                    found = [found[n] for n, _ in fields] if isinstance(found, dict) else [found]
                arrays = [pa.array(c, kind) for c, kind in zip(found, (types[kind] for _, kind in fields), strict=True)]
                mine = order[at[k] : at[k + 1]]
                for start in range(0, len(mine), BATCH):
                    part = mine[start : start + BATCH]
                    ends = [of["_members"].take(pa.array(z[part])) if members else pa.array(number[z[part]].astype(np.int32)) for z in (x, y)]
                    take = pa.array(which[part] - lo)
                    yield pa.RecordBatch.from_arrays([of[by].take(pa.array(x[part])), *ends, *(v.take(take) for v in arrays)], names=names)

    kind = dict(spread.dtypes)[by]
    ends = "_i array<long>, _j array<long>" if members else "p int, q int"
    return dealt(spread, by, "_row", "_col").groupBy(by, "_row", "_col").applyInArrow(compare, f"`{by}` {kind}, {ends}, {columns}")


def all_pairs(items: DataFrame, value: str, kernel: Callable[[list, list], np.ndarray | dict], block: str | None = None, full: bool = False, tile: int = TILE, columns: str = "d double", then: dict[str, Column] | None = None) -> DataFrame:
    """block, i, j, d of items (ord and the value) within their block: j < i, or all pairs with full. A kernel may give
    other columns, by name (double, int or array<int>); then are columns made of those, instead of them.

    What a pair gets depends on its two values only, so a kernel sees each two values of a block once, and then rows are
    put in their places. The values are numbered and cut into tiles, however sparse the ordinals are. Each is repeated
    once for each tile of its row and column, which is the number of a block's values over the tile's, and a task compares
    two ranges at a time, so a large block spreads over many tasks. The number of pairs is quadratic in a block by
    definition; blocks are what keeps it bounded."""
    items, by = _blocked(items, block)
    out = _compared(_distinct(items, value, by), kernel, by, full, tile, columns, True)
    names = [c.strip().split()[0] for c in columns.split(", ")]
    if then:
        out = out.select(by, "_i", "_j", *(c.alias(n) for n, c in then.items()))
        names = list(then)
    out = out.withColumn("i", F.explode("_i")).drop("_i").withColumn("j", F.explode("_j")).drop("_j").where("i <> j" if full else "j < i")
    return out.select(*([by] if block else []), "i", "j", *names)


@dataclass
class ByValue:
    """Distances of a block's rows by their values: rows (block, ord, number, and what else they have), and pairs (block,
    p, q, d) of the numbers of the two values, for a row with p and one with q before it, or any two rows with full."""

    rows: DataFrame
    pairs: DataFrame
    full: bool = False


def by_value(items: DataFrame, value: str, kernel: Callable, block: str, full: bool = False, tile: int = TILE) -> ByValue:
    """all_pairs with d, without its rows: for what holds a block's matrix anyhow."""
    values = _distinct(items, value, block)
    rows = values.select(block, F.explode("_members").alias("ord"), F.col("_number").alias("number"))
    return ByValue(rows, _compared(values, kernel, block, full, tile, "d double", False), full)


@dataclass
class ByTile:
    """Distances of a block's rows by their values: rows as in ByValue, and tiles (block, row, col, d) of the values'
    matrix, of which what is below its diagonal counts, each the bytes of a piece of it in single precision."""

    rows: DataFrame
    tiles: DataFrame
    tile: int = TILE


def by_tile(items: DataFrame, value: str, kernel: Callable[[list, list], np.ndarray], block: str, tile: int = TILE) -> ByTile:
    """by_value for a kernel that gives the matrix of two lists of values and means the same in both directions: four bytes
    a distance are sent to the block's task instead of a row."""
    values = _distinct(items, value, block)
    rows = values.select(block, F.explode("_members").alias("ord"), F.col("_number").alias("number"))
    spread = _spread(values.withColumn("_place", F.col("_number")).drop("_members"), block, tile)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = pa.Table.from_batches(batches).sort_by("_number")
        row, col, t = group["_row"][0].as_py(), group["_col"][0].as_py(), group["_t"].to_numpy()
        a, b = (group["_value"].take(pa.array(np.flatnonzero(t == k))).to_pylist() for k in (row, col))
        cells = np.ascontiguousarray(kernel(a, b), np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([group[block].slice(0, 1).combine_chunks(), pa.array([row], pa.int32()), pa.array([col], pa.int32()), pa.array([cells], pa.binary())], names=[block, "row", "col", "d"])

    found = dealt(spread, block, "_row", "_col").groupBy(block, "_row", "_col").applyInArrow(compare, f"`{block}` {dict(spread.dtypes)[block]}, row int, col int, d binary")
    return ByTile(rows, found, tile)


def _flows(first: list, second: list) -> np.ndarray:
    return K.flow_dist([np.asarray(x, np.int64) for x in first], [np.asarray(x, np.int64) for x in second])


def _counted(reads: DataFrame) -> DataFrame:
    return reads.withColumn("_flows", F.expr("slice(flows, 1, cast(floor(len / 4) * 4 as int))"))


def _flow_kernel(lookup: np.ndarray | None) -> Callable:
    return _flows if lookup is None else (lambda a, b: K.flow_dist([np.asarray(x, np.int64) for x in a], [np.asarray(x, np.int64) for x in b], lookup))


def flow_distances(reads: DataFrame, lookup: np.ndarray | None = None, block: str | None = None) -> DataFrame:
    """Flow distance of reads (ord, len, flows); flows up to len rounded down to a multiple of four count."""
    return all_pairs(_counted(reads), "_flows", _flow_kernel(lookup), block)


def flows_by_tile(reads: DataFrame, lookup: np.ndarray | None, block: str) -> ByTile:
    return by_tile(_counted(reads), "_flows", lambda a, b: K.flow_dist_table(a, b, lookup), block)


def identity_distances(seqs: DataFrame, block: str | None = None, then: dict[str, Column] | None = None) -> DataFrame:
    return all_pairs(seqs, "seq", K.nw_identity, block, then=then)


def sequence_distances(seqs: DataFrame, table: np.ndarray | None = None, block: str | None = None, asymmetric: bool = False, then: dict[str, Column] | None = None) -> DataFrame:
    """Homopolymer-aware distance; the asymmetric form gives all ordered pairs."""
    return all_pairs(seqs, "seq", homopolymer(table, asymmetric), block, full=asymmetric, then=then)


def homopolymer(table: np.ndarray | None = None, asymmetric: bool = False) -> Callable:
    return lambda a, b: K.nw_homopolymer(a, b, table, both_ends=not asymmetric, unknown=None if asymmetric else 0.0)


def differences(seqs: DataFrame, block: str | None = None, full: bool = False, then: dict[str, Column] | None = None) -> DataFrame:
    """Of each pair the number of differences and, at each base of the first sequence, how many there are up to it from
    the left (d) and from the right (r)."""

    return all_pairs(seqs, "seq", K.diff_profiles, block, full, columns="n_diff int, d array<int>, r array<int>", then=then)


def triangle(values: DataFrame, n: int, each: int) -> DataFrame:
    """i, j, a, b: the values (ord from 0 to n - 1, x) of each row and of each before it, in the order of a triangle file,
    partition after partition, each with up to so many. A pair is made where it stands; the n values are broadcast."""
    total, spark = n * (n - 1) // 2, values.sparkSession
    i, j = triangle_place(F.col("id"))
    places = spark.range(0, total, 1, max(-(-total // each), spark.sparkContext.defaultParallelism)).select(i.alias("i"), j.alias("j"))
    of = lambda place, name: F.broadcast(values.select(F.col("ord").alias(place), F.col("x").alias(name)))
    return places.join(of("i", "a"), "i").join(of("j", "b"), "j").select("i", "j", "a", "b")


def square(values: DataFrame, n: int, each: int) -> DataFrame:
    """i, a, b: of each row its value and all n in order (ord from 0 to n - 1, x), in the order of a square file, partition
    after partition, each with up to so many cells."""
    spark = values.sparkSession
    whole = values.agg(F.sort_array(F.collect_list(F.struct("ord", "x"))).alias("_c")).select(F.col("_c.x").alias("b"))
    rows = spark.range(0, n, 1, max(-(-n // max(1, each // max(n, 1))), spark.sparkContext.defaultParallelism)).withColumnRenamed("id", "i")
    return rows.join(F.broadcast(values.select(F.col("ord").alias("i"), F.col("x").alias("a"))), "i").crossJoin(F.broadcast(whole)).select("i", "a", "b")


def symmetrise(full: DataFrame) -> DataFrame:
    """i, j, d with j < i from all ordered pairs: the mean of both directions."""
    return full.groupBy(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).agg(F.avg("d").alias("d"))


def sequences_by_value(seqs: DataFrame, table: np.ndarray | None, block: str, asymmetric: bool = False) -> ByValue:
    return by_value(seqs, "seq", homopolymer(table, asymmetric), block, asymmetric)


def mean_of_both(found: ByValue, block: str) -> ByValue:
    """One distance a pair: the mean of both directions."""
    one = found.pairs.groupBy(block, F.greatest("p", "q").alias("p"), F.least("p", "q").alias("q")).agg(F.avg("d").alias("d"))
    return ByValue(found.rows, one.unionByName(one.where("p <> q").select(block, F.col("q").alias("p"), F.col("p").alias("q"), "d")))


def identities_by_value(seqs: DataFrame, block: str) -> ByValue:
    return by_value(seqs, "seq", K.nw_identity, block)


def mean_abs_distances(items: DataFrame, block: str) -> DataFrame:
    """Mean absolute difference of arrays over their common length, in built-ins, as an equi-join within blocks."""
    a = items.select(block, F.col("ord").alias("i"), F.col("flows").alias("_a"))
    b = items.select(block, F.col("ord").alias("j"), F.col("flows").alias("_b"))
    n = F.least(F.size("_a"), F.size("_b"))
    gap = F.aggregate(F.zip_with(F.slice("_a", 1, n), F.slice("_b", 1, n), lambda x, y: F.abs(x - y)), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return a.join(b, block).where("j < i").select(block, "i", "j", F.when(n > 0, gap / n).alias("d"))
