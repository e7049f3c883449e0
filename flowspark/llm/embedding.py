"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c and more have a squared distance of 2 - 2c at most. They are turned by a fixed random
rotation and split into BLOCKS blocks of coordinates; each block gets the share of that budget that its number of
coordinates has. A pair over the budget in every block would be over it in all, so each linked pair is within budget
in some block. Each block is a range join: vectors are laid into slabs of the block's first coordinate, as wide as
the block's radius, and compared within a slab and with the next one, tile by tile, so no task holds a slab. Pairs
within the block's budget are verified by their cosine in double precision, and count in the first block whose
budget they keep, so each is counted once and never written out as a pair: a tile gives each vector's number of
partners and a star of links to the smallest member of each of its groups.

Equal vectors are one class with a number of members. The class, its links and its component go back to all
members; hot classes by a broadcast of under 1000 rows.

In high dimensions a range join prunes little: the work is about that of comparing all distinct vectors block by
block in matrix products, and grows with the square of their number. No pair is missed for that.

Nulls: vectors that are null, empty, zero or hold null or non-finite components link with nothing; so do rows with a
null vec_id, whose component is null. Vectors of another length are only compared among themselves. Very large and very
small vectors are scaled first. Equal rows link with each other. An empty table gives an empty result. Only the id and
the vector are read, so other columns may be called anything.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, cut, drop_cut, heavy_join, shuffle_partitions, table

BLOCKS, TILE = 4, 8192


@lru_cache(maxsize=8)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(11).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, cosine: float) -> list[tuple[slice, float]]:
    """Coordinates and squared-distance budget of each block."""
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int)
    return [(slice(a, b), (2 - 2 * cosine) * (b - a) / dim) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _unit(blobs: list[bytes], dim: int) -> np.ndarray:
    if all(len(b) == 4 * dim for b in blobs):
        x = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dim).astype(np.float64)
    else:  # some need double precision
        x = np.stack([np.frombuffer(b, np.float32 if len(b) == 4 * dim else np.float64).astype(np.float64) for b in blobs])
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _keyed(vectors: DataFrame, id: str, column: str) -> DataFrame:
    """vec_id, key (of the vector's bytes; null for those that link with nothing), dim, vec."""

    def keyed(batches):
        for batch in batches:
            keys, dims, out = [], [], []
            for vec_id, value in zip(batch.column(0), batch.column(1), strict=True):
                value = value.as_py()
                x = np.array(value, np.float64) if vec_id.is_valid and value and None not in value else np.zeros(1)
                if np.isfinite(x).all() and x.any():
                    # by a power of two, which leaves the direction as it is: squares neither over- nor underflow
                    e = int(np.frexp(np.abs(x).max())[1])
                    x = np.ldexp(x, -e) if abs(e) > 60 else x
                    short = x.astype(np.float32)
                    blob = (short if (short == x).all() else x).tobytes()
                    keys.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest())
                    dims.append(len(x))
                    out.append(blob)
                else:
                    for rows in (keys, dims, out):
                        rows.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], names=["vec_id", "key", "dim", "vec"])

    return vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(column)).mapInArrow(keyed, "vec_id long, key binary, dim int, vec binary")


def _slabs(classes: DataFrame, cosine: float) -> DataFrame:
    """Each class once a block, with its slab there."""

    def laid(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                turned = _unit(part.column(3).to_pylist(), dim) @ rotation(dim)
                for b, (at, budget) in enumerate(blocks_of(dim, cosine)):
                    slab = np.floor(turned[:, at.start] / (np.sqrt(budget) * (1 + 1e-9) + 1e-12)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, b, np.int32)), pa.array(slab)], names=[*part.schema.names, "block", "slab"])

    return classes.select("rep", "n", "dim", "vec").mapInArrow(laid, "rep long, n long, dim int, vec binary, block int, slab long")


def _tiles(slabs: DataFrame) -> DataFrame:
    """Each row in every tile pair that it takes part in: dim, block, slab, next (with the next slab), low, high, side."""
    at = ["dim", "block", "slab"]
    sizes = slabs.groupBy(*at).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("sides"))
    # slabs of a block lie in [-1, 1] / radius, so there are some tens of sizes for each vector length
    for shift, name in ((0, "here"), (1, "after"), (-1, "before")):
        slabs = slabs.join(F.broadcast(sizes.select("dim", "block", (F.col("slab") - shift).alias("slab"), F.col("sides").alias(name))), at, "left")
    own = F.pmod(F.xxhash64("rep"), F.col("here")).cast("int")
    slabs = slabs.withColumn("own", own)

    def pairs(count: str, slab, follows: bool, low, high, side) -> F.Column:
        return F.when(F.col(count).isNull(), F.array()).otherwise(F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(1)) - 1), lambda j: F.struct(slab.alias("slab"), F.lit(follows).alias("follows"), low(j).alias("low"), high(j).alias("high"), side.alias("side"))))

    me = F.col("own")
    same = pairs("here", F.col("slab"), False, lambda j: F.least(me, j), lambda j: F.greatest(me, j), me)
    left = pairs("after", F.col("slab"), True, lambda j: me, lambda j: j, F.lit(0))
    right = pairs("before", F.col("slab") - 1, True, lambda j: j, lambda j: me, F.lit(1))
    kind = "array<struct<slab: bigint, follows: boolean, low: int, high: int, side: int>>"
    rows = slabs.withColumn("t", F.explode(F.concat(same.cast(kind), left.cast(kind), right.cast(kind))))
    return rows.select("dim", "block", "t.*", "rep", "n", "vec")


def _compare(x: np.ndarray, y: np.ndarray, same: bool, block: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows of x and y that count in this block."""
    dim = x.shape[1]
    parts = blocks_of(dim, cosine)
    at, budget = parts[block]
    turn = rotation(dim)
    rx, ry = x @ turn, y @ turn
    a, b = rx[:, at].astype(np.float32), ry[:, at].astype(np.float32)
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    found = []
    for lo in range(0, len(a), 512):
        near = a[lo : lo + 512] @ b.T
        near -= (nb * np.float32(0.5))[None, :]
        i, j = np.nonzero(near >= (na[lo : lo + 512, None] - np.float32(budget + 1e-4)) * np.float32(0.5))
        i += lo
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 1 << 15):
            p, q = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            linked = np.einsum("ij,ij->i", x[p], y[q]) >= cosine
            p, q = p[linked], q[linked]
            square = (rx[p] - ry[q]) ** 2
            keeps = np.stack([square[:, s].sum(axis=1) <= most + 1e-9 for s, most in parts], axis=1)
            first = keeps.argmax(axis=1) == block
            found.append((p[first], q[first]))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True)) if found else (none, none)


def _stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes by the links."""
    label = np.arange(n)
    while len(i):
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def _links(tiles: DataFrame, cosine: float) -> DataFrame:
    """rep, links (members of linked classes), star (smallest class that its links in the tile reach)."""
    key = ["dim", "block", "slab", "follows", "low", "high"]

    def tile(rows: pa.Table):
        dim, block, follows, low, high = (rows.column(c)[0].as_py() for c in ("dim", "block", "follows", "low", "high"))
        side, rep, n = (rows.column(c).to_numpy() for c in ("side", "rep", "n"))
        order = np.argsort(rep, kind="stable")
        vec, side, rep, n = _unit(rows.column("vec").to_pylist(), dim)[order], side[order], rep[order], n[order]
        same = not follows and low == high
        left = np.arange(len(rep)) if same else np.flatnonzero(side == (0 if follows else low))
        right = left if same else np.flatnonzero(side == (1 if follows else high))
        i, j = _compare(vec[left], vec[right], same, block, cosine)
        if not len(i):
            return None
        i, j = left[i], right[j]
        total = (np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))).astype(np.int64)
        star = rep[_stars(i, j, len(rep))]
        hit = total > 0
        return pa.RecordBatch.from_arrays([pa.array(rep[hit]), pa.array(total[hit]), pa.array(star[hit])], names=["rep", "links", "star"])

    def linked(batches):
        held, last = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in key), strict=True))
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo]:
                    hi += 1
                if keys[lo] != last and held:
                    if (out := tile(pa.Table.from_batches(held))) is not None:
                        yield out
                    held = []
                held.append(batch.slice(lo, hi - lo))
                last, lo = keys[lo], hi
        if held and (out := tile(pa.Table.from_batches(held))) is not None:
            yield out

    names = [f.name for f in tiles.schema.fields]
    dealt = tiles.select(*names).repartition(shuffle_partitions(tiles.sparkSession), *key).sortWithinPartitions(*key)
    return dealt.mapInArrow(linked, "rep long, links long, star long")


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept, a row for each of the vectors' rows."""
    rows = cut(_keyed(vectors, id, column), "vectors")
    classes = rows.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim"), F.max("vec").alias("vec"))
    classes = cut(classes, "classes")
    links = cut(_links(_tiles(_slabs(classes, cosine)), cosine), "links")
    found = cut(components(links.where("rep <> star").select(F.col("rep").alias("a"), F.col("star").alias("b"))), "components")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    told = classes.select("key", "n", "rep").join(counts, "rep", "left").join(found, F.col("rep") == F.col("node"), "left")
    told = told.select("key", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    told = cut(told, "told")
    drop_cut(classes, links, found)
    out = heavy_join(rows.select("vec_id", "key"), told, "key", "n", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op3_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
