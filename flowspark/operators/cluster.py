"""Hierarchical clustering of blocks, cuts, trees and even splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .pairs import ByTile, ByValue
from .stage import dealt

_MERGES = "step int, `left` int, `right` int, dist float"


def _matrix(pairs: pd.DataFrame, n: int, scale: bool = False) -> np.ndarray:
    d = np.zeros((n, n), np.float32)
    i, j, v = pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs["d"].to_numpy(np.float32)
    if scale and len(v):
        v = (v - v.min()) / max(v.max() - v.min(), np.float32(1e-30))
    d[i, j], d[j, i] = v, v
    return d


def by_number(pairs: pd.DataFrame, number: np.ndarray, mirrored: bool = True, levels: np.ndarray | None = None) -> np.ndarray:
    """The matrix of rows from the distances of their values (p, q, d); mirrored for those of a row and one before it.
    With levels, ascending from 0 on, its cells are places in them, in as few bytes as hold these."""
    n, m = len(number), int(number.max()) + 1
    v = pairs["d"].to_numpy(np.float32)
    d = np.zeros((m, m), np.float32 if levels is None else np.min_scalar_type(len(levels)))
    d[pairs["p"].to_numpy(), pairs["q"].to_numpy()] = v if levels is None else np.searchsorted(levels, v)
    if m < n or (number != np.arange(n)).any():
        d = d[number].take(number, axis=1)
    for i in range(n):
        d[i, i] = 0
        if mirrored:
            d[:i, i] = d[i, :i]
    return d


def of_tiles(tiles: pd.DataFrame, number: np.ndarray, tile: int) -> np.ndarray:
    """The matrix of rows from the tiles (row, col, d) of their values' matrix."""
    m = int(number.max()) + 1
    d = np.zeros((m, m), np.float32)
    for row, col, cells in tiles[["row", "col", "d"]].itertuples(index=False):
        a, b = (slice(k * tile, min(m, (k + 1) * tile)) for k in (row, col))
        piece = np.frombuffer(cells, np.float32).reshape(a.stop - a.start, b.stop - b.start)
        if row == col:
            piece = np.tril(piece) + np.tril(piece, -1).T
        d[a, b], d[b, a] = piece, piece.T
    if m < len(number) or (number != np.arange(m)).any():
        d = d[number].take(number, axis=1)
    np.fill_diagonal(d, 0)
    return d


def linkage(distances: DataFrame | ByValue | ByTile, block: str, method: str = "complete", scale: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """block, step, left, right, dist from distances (block, i, j, d with j < i, ordinals from 0), or by values. method:
    complete or average, by number or by weights (block, ord, weight). scale brings distances to 0 ... 1. One block is one
    task's matrix: n * n distances, which is why samples are split into blocks first (split_even). By values what is sent
    there is no more than the distances of its distinct values."""
    names, weighted = [block, "step", "left", "right", "dist"], weights is not None

    def rows(of, d: np.ndarray, sizes: np.ndarray | None, levels: np.ndarray | None = None) -> pd.DataFrame:
        merges, heights = K.linkage(d, method, sizes, own=True, levels=levels)
        return pd.DataFrame({block: of, "step": np.arange(len(d) - 1), "left": merges[:, 0], "right": merges[:, 1], "dist": heights})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        return rows(group[block].iat[0], _matrix(group, int(group["i"].max()) + 1, scale), None)

    def merge_weighted(group: pd.DataFrame, sizes: pd.DataFrame) -> pd.DataFrame:
        return rows(group[block].iat[0], _matrix(group, int(group["i"].max()) + 1, scale), sizes.sort_values("ord")["weight"].to_numpy()) if len(group) else pd.DataFrame(columns=names)

    def merge_numbered(items: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if len(items) < 2:
            return pd.DataFrame(columns=names)
        items = items.sort_values("ord")
        if scale:
            v = pairs["d"].to_numpy(np.float32)
            pairs = pairs.assign(d=(v - v.min()) / max(v.max() - v.min(), np.float32(1e-30)))
        # complete linkage takes the distances as they are, which few values mostly have: a byte or two hold a place in them
        levels = np.unique(np.append(pairs["d"].to_numpy(np.float32), np.float32(0))) if method == "complete" else None
        if levels is not None and (len(levels) > 1 << 15 or levels[0] < 0 or np.isnan(levels[-1])):
            levels = None
        return rows(items[block].iat[0], by_number(pairs, items["number"].to_numpy(), levels=levels), items["weight"].to_numpy() if weighted else None, levels)

    if isinstance(distances, ByTile):
        if weighted or scale:
            raise ValueError("tiles are linked as they are, without weights")
        tile, kind = distances.tile, dict(distances.rows.dtypes)[block]

        def merge_tiles(items: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
            if len(items) < 2:
                return pd.DataFrame(columns=names)
            return rows(items[block].iat[0], of_tiles(tiles, items.sort_values("ord")["number"].to_numpy(), tile), None)

        return dealt(distances.rows, block).groupBy(block).cogroup(dealt(distances.tiles, block).groupBy(block)).applyInPandas(merge_tiles, f"`{block}` {kind}, {_MERGES}")
    if isinstance(distances, ByValue):
        if distances.full:
            raise ValueError("a linkage takes one distance a pair")
        kind, items = dict(distances.rows.dtypes)[block], distances.rows.select(block, "ord", "number")
        items = items if weights is None else items.join(weights.select(block, "ord", "weight"), [block, "ord"])
        return dealt(items, block).groupBy(block).cogroup(dealt(distances.pairs, block).groupBy(block)).applyInPandas(merge_numbered, f"`{block}` {kind}, {_MERGES}")
    schema = f"`{block}` {dict(distances.dtypes)[block]}, {_MERGES}"
    grouped = dealt(distances, block).groupBy(block)
    if weights is None:
        return grouped.applyInPandas(merge, schema)
    return grouped.cogroup(dealt(weights.select(block, "ord", "weight"), block).groupBy(block)).applyInPandas(merge_weighted, schema)


def cut_at(merges: DataFrame, block: str, below: float) -> DataFrame:
    """block, cluster (by slot), pos, member of each block of two and more, after the merges of less than below."""
    kind = dict(merges.dtypes)[block]

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        clusters = K.cut(group[["left", "right"]].to_numpy(), group["dist"].to_numpy(), len(group) + 1, below)
        rows = [(group[block].iat[0], c, p, m) for c, members in enumerate(clusters) for p, m in enumerate(members)]
        return pd.DataFrame(rows, columns=[block, "cluster", "pos", "member"])

    return dealt(merges, block).groupBy(block).applyInPandas(cut, f"`{block}` {kind}, cluster int, pos int, member long")


def cut_levels(merges: DataFrame, block: str, resolution: float = 0.01) -> DataFrame:
    """block, level, cutoff, cluster, members for all levels under the last merge. Levels are whole numbers; cutoff is
    level * resolution."""
    kind = dict(merges.dtypes)[block]

    def levels(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        found = K.cut_levels(group[["left", "right"]].to_numpy(), group["dist"].to_numpy(), len(group) + 1, resolution)
        rows = [(group[block].iat[0], k, k * resolution, c, m) for k, clusters in found for c, m in enumerate(clusters)]
        return pd.DataFrame(rows, columns=[block, "level", "cutoff", "cluster", "members"])

    return dealt(merges, block).groupBy(block).applyInPandas(levels, f"`{block}` {kind}, level int, cutoff double, cluster int, members array<long>")


def newick(merges: DataFrame, block: str) -> DataFrame:
    """block, tree with ordinals as names."""
    kind = dict(merges.dtypes)[block]

    def tree(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        return pd.DataFrame({block: [group[block].iat[0]], "tree": [K.newick(group[["left", "right"]].to_numpy(), group["dist"].to_numpy(), [str(k) for k in range(len(group) + 1)])]})

    return dealt(merges, block).groupBy(block).applyInPandas(tree, f"`{block}` {kind}, tree string")


def leaf_counts(merges: DataFrame, block: str) -> DataFrame:
    """block, step, leaves under each merge."""
    kind = dict(merges.dtypes)[block]

    def count(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        n: list[int] = []
        for left, right in group[["left", "right"]].itertuples(index=False):
            n.append(sum(1 if x >= 0 else n[-x - 1] for x in (left, right)))
        return pd.DataFrame({block: group[block].iat[0], "step": group["step"], "leaves": n})

    return dealt(merges, block).groupBy(block).applyInPandas(count, f"`{block}` {kind}, step int, leaves int")


def even_splits(merges: np.ndarray, most: int, least: int) -> list[tuple[str, list[int]]]:
    """Subtrees of at most `most` leaves, largest first, named C000, C001 ...; those of fewer than `least` together
    make the last one, with a plus behind its name."""
    n = len(merges) + 1
    sizes: list[int] = []
    steps = merges.tolist()
    for pair in steps:
        sizes.append(sum(1 if x >= 0 else sizes[-x - 1] for x in pair))

    def under(node: int) -> list[int]:
        open_, leaves = [node], []
        while open_:
            x = open_.pop()
            if x >= 0:
                leaves.append(x)
            else:
                open_ += steps[-x - 1][::-1]
        return leaves

    todo, found = [-len(merges) if len(merges) else 0], []
    while todo:
        node = todo.pop()
        if node >= 0 or sizes[-node - 1] <= most:
            found.append(under(node))
        else:
            left, right = steps[-node - 1]
            todo += [right, left]
    found.sort(key=lambda m: (-len(m), min(m)))
    large = [m for m in found if len(m) >= least]
    small = [x for m in found if len(m) < least for x in m]
    out = [(f"C{k:03d}", m) for k, m in enumerate(large)]
    assert sum(map(len, found)) == n
    return out + ([(f"C{len(large):03d}+", small)] if small else [])


def split_even(merges: DataFrame, block: str, most: int = 5000, least: int = 1000) -> DataFrame:
    """block, split, pos, member: the blocks for what is quadratic later."""
    kind = dict(merges.dtypes)[block]

    def split(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("step")
        rows = [(group[block].iat[0], name, p, m) for name, members in even_splits(group[["left", "right"]].to_numpy(), most, least) for p, m in enumerate(members)]
        return pd.DataFrame(rows, columns=[block, "split", "pos", "member"])

    return dealt(merges, block).groupBy(block).applyInPandas(split, f"`{block}` {kind}, split string, pos int, member long")


def split_totals(splits: DataFrame, weights: DataFrame, block: str) -> DataFrame:
    """Leaves and reads of each split, largest first. weights: block, member, n."""
    out = splits.join(weights, [block, "member"], "left").groupBy(block, "split").agg(F.count(F.lit(1)).alias("leaves"), F.sum(F.coalesce("n", F.lit(1))).alias("reads"))
    return out.orderBy(F.desc("leaves"), block, "split")


def list_lines(levels: DataFrame, block: str) -> DataFrame:
    """The list and size lines of each level: cutoff, number of clusters, members or sizes."""
    one = levels.groupBy(block, "level", "cutoff").agg(F.sort_array(F.collect_list(F.struct("cluster", "members"))).alias("_c"))
    head = F.concat(F.format_string("%f", "cutoff"), F.lit(" "), F.size("_c").cast("string"))
    line = lambda what: F.concat_ws(" ", head, F.array_join(F.transform("_c", what), " "))
    return one.select(block, "level", line(lambda c: F.array_join(c["members"].cast("array<string>"), ",")).alias("list"), line(lambda c: F.size(c["members"]).cast("string")).alias("otu"))
