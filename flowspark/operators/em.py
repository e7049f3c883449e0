"""Expectation-maximisation: denoising of flows and of sequences, by block in one task or over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from .cluster import by_number
from .pairs import ByValue
from .stage import dealt

#: When to stop, and what counts as gone.
DELTA, MOST_STEPS, FLOW_STEPS, SEQUENCE_STEPS = 1e-6, 1000, 10, 20
LEAST_COUNT, LEAST_TAU, LEAST_WEIGHT = 0.1, 1e-4, 0.1
#: Costs of reads and patterns that are handed on at a time, and cells of a matrix that are reckoned roughly at a time.
CELLS, PRODUCT = 1 << 16, 1 << 22


#: Cells whose chance is below exp(-REACH) of an item's best one are too small for its sum in double precision, unless
#: that is below FAINT; then the item is reckoned with all of them.
REACH, FAINT = 69.0, 1e-9


@dataclass
class Costs:
    """Costs of items (rows) and candidate centroids, of which only the cells that count are held: their items, candidates
    and chances exp(-sigma * (cost - least of the item)). exact gives any piece by items and candidates."""

    item: np.ndarray
    candidate: np.ndarray
    chance: np.ndarray
    least: np.ndarray
    sigma: float
    exact: Callable[[np.ndarray, np.ndarray], np.ndarray]
    #: All costs of items that were reckoned whole once: they often are in the next step, too.
    rows: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def near(pieces: Iterable[np.ndarray], sigma: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Costs:
        """From pieces of some items each, in their order."""
        cells, least, at = [], [], 0
        for piece in pieces:
            low = piece.min(axis=1)
            gap = sigma * (piece - low[:, None])
            i, u = np.nonzero(gap <= REACH)
            cells.append((i + at, u, np.exp(-gap[i, u])))
            least.append(low)
            at += len(piece)
        return Costs(*(np.concatenate(x) for x in zip(*cells, strict=True)), np.concatenate(least), sigma, exact)

    @staticmethod
    def of(cost: np.ndarray, sigma: float) -> Costs:
        step = max(1, CELLS // max(cost.shape[1], 1))
        return Costs.near((cost[lo : lo + step] for lo in range(0, len(cost), step)), sigma, lambda i, u: cost[np.ix_(i, u)])

    def shares(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By the weights of candidates: of the cells that count and have one their items, candidates and parts of the
        item's sum, and of each item the log of its sum of weight * exp(-sigma * cost), and which were reckoned whole."""
        n = len(self.least)
        part = self.chance * weight[self.candidate]
        total = np.bincount(self.item, part, n)
        faint = np.flatnonzero(total < FAINT)
        live = (part > 0) & (total >= FAINT)[self.item]
        item, candidate = self.item[live], self.candidate[live]
        part = part[live] / total[item]
        with np.errstate(divide="ignore"):
            logs = np.log(total) - self.sigma * self.least
        if len(faint):
            used = np.flatnonzero(weight > 0)
            step = max(1, CELLS // max(len(used), 1))
            more = [(item, candidate, part)]
            for lo in range(0, len(faint), step):
                some = faint[lo : lo + step]
                new = np.array([i for i in some.tolist() if i not in self.rows], np.int64)
                if len(new):
                    self.rows.update(zip(new.tolist(), self.exact(new, np.arange(len(weight))), strict=True))
                d = np.array([self.rows[i][used] for i in some.tolist()])
                low = d.min(axis=1)
                p = weight[used] * np.exp(-self.sigma * (d - low[:, None]))
                s = p.sum(axis=1)
                logs[some] = np.log(s) - self.sigma * low
                i, u = np.nonzero(p)
                more.append((some[i], used[u], p[i, u] / s[i]))
            item, candidate, part = (np.concatenate(x) for x in zip(*more, strict=True))
        return item, candidate, part, logs, faint


@dataclass
class Denoised:
    """cluster of each item, centroid (candidate number) of each cluster that has one, its weight, -log-likelihood
    at each step, and the last responsibilities: items, clusters and shares, by item."""

    cluster: np.ndarray
    centroid: dict[int, int]
    weight: np.ndarray
    likelihood: list[float]
    soft: tuple[np.ndarray, np.ndarray, np.ndarray]

    @property
    def tau(self) -> np.ndarray:
        """The responsibilities as items x clusters."""
        item, cluster, share = self.soft
        out = np.zeros((len(self.cluster), len(self.weight)))
        out[item, cluster] = share
        return out


def expectation(distance: np.ndarray, weight: np.ndarray, sigma: float) -> np.ndarray:
    """Responsibilities of clusters (columns) of weight over LEAST_WEIGHT; small ones are dropped, the rest not scaled."""
    live = weight > LEAST_WEIGHT
    tau = np.zeros_like(distance)
    d = distance[:, live]
    part = weight[live] * np.exp(-sigma * (d - d.min(axis=1, keepdims=True)))
    part /= part.sum(axis=1, keepdims=True)
    tau[:, live] = np.where(part > LEAST_TAU, part, 0.0)
    return tau


def centroids(soft: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, costs: Costs, candidate: np.ndarray, weight: np.ndarray, known: dict) -> np.ndarray:
    """For each of k clusters the candidate with the least weighted cost among its members' candidates, the first of
    equals; -1 where little is left of it. soft: items, clusters and shares; candidate: of each item. known keeps the
    costs of a cluster's members and options for the next step."""
    item, cluster, share = soft
    out = np.full(k, -1)
    order = np.lexsort((item, cluster))
    item, cluster, share = item[order], cluster[order], share[order]
    ends = np.searchsorted(cluster, np.arange(k + 1))
    for c in np.flatnonzero(np.bincount(cluster, share, k) > LEAST_COUNT).tolist():
        at = slice(ends[c], ends[c + 1])
        members = item[at]
        first = candidate[members[0]]
        if len(members) == 1 or (candidate[members] == first).all():
            out[c] = first
            continue
        if c not in known or not np.array_equal(known[c][0], members):
            options = pd.unique(candidate[members])
            known[c] = members, options, costs.exact(members, options)
        _, options, cost = known[c]
        out[c] = options[((share[at] * weight[members]) @ cost).argmin()]
    return out


def denoise(start: np.ndarray, cost: np.ndarray | Costs, candidate: np.ndarray, sigma: float, item_weight: np.ndarray | None = None, least_steps: int = FLOW_STEPS, most_steps: int = MOST_STEPS) -> Denoised:
    """EM from clusters start (a number for each item) over cost (items x candidate centroids). A step takes the cells
    that count, not all items by all clusters."""
    costs = cost if isinstance(cost, Costs) else Costs.of(cost, sigma)
    n, k = len(start), int(start.max()) + 1
    w = np.ones(n) if item_weight is None else item_weight.astype(float)
    most = max(int(candidate.max()), int(costs.candidate.max())) + 1
    soft, known = (np.arange(n), np.asarray(start), np.ones(n)), {}
    before, likelihood, step = np.zeros(k), [], 0

    def expect(center: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        live = np.flatnonzero((center >= 0) & (weight > LEAST_WEIGHT))
        of, amount = np.full(most, -1), np.zeros(most)
        of[center[live]], amount[center[live]] = live, weight[live]
        item, at, part, *_ = costs.shares(amount)
        large = part > LEAST_TAU
        return item[large], of[at[large]], part[large]

    while True:
        center = centroids(soft, k, costs, candidate, w, known)
        item, cluster, share = soft
        weight = np.bincount(cluster, share * w[item], k)
        delta = np.abs(weight - before).max()
        has = center >= 0
        live = has & (weight > LEAST_WEIGHT)
        logs = costs.shares(np.bincount(center[live], weight[live], most))[3]
        likelihood.append(float(-(w * np.maximum(logs, np.log(1e-300))).sum() - w.sum() * np.log(sigma)))
        alike = np.flatnonzero(has & (weight >= LEAST_WEIGHT))
        which, count = np.unique(center[alike], return_counts=True)
        for u in which[count > 1]:
            one, *same = alike[center[alike] == u]
            weight[one] += weight[same].sum()
            weight[same], center[same], has[same] = 0.0, -1, False
            alike = np.flatnonzero(has & (weight >= LEAST_WEIGHT))
        before = weight
        if step >= least_steps and (delta <= DELTA or step >= most_steps):
            break
        step += 1
        soft = expect(center, weight)
    item, cluster, share = soft = expect(center, weight)
    order = np.lexsort((cluster, -share, item))
    item, cluster = item[order], cluster[order]
    first = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
    best = np.zeros(n, np.int64)  # of the largest share, the first cluster of equals
    best[item[first]] = cluster[first]
    center = centroids((np.arange(n), best, np.ones(n)), k, costs, candidate, w, known)
    return Denoised(best, {c: int(center[c]) for c in np.unique(best)}, np.bincount(best, w, k), likelihood, soft)


# ---------------------------------------------------------------- flows


def patterns(flows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rounded patterns in order of their first read, the pattern of each read, and each pattern's first read."""
    width = max(map(len, flows))
    rounded = np.zeros((len(flows), width), np.int64)
    for row, f in zip(rounded, flows, strict=True):
        row[: len(f)] = (np.asarray(f) + 50) // 100
    rounded = np.clip(rounded, 0, 9)
    _, first, of = np.unique(rounded, axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rounded[first[order]], rank[of.ravel()], first[order]


def pattern_costs(flows: list[np.ndarray], lengths: np.ndarray, shapes: np.ndarray, lookup: np.ndarray, unseen: float | None = None, seen: np.ndarray | None = None) -> np.ndarray:
    """Mean -log chance of each read's signals from each pattern. With unseen, flows behind a pattern's own length
    (seen) cost that each."""
    out = np.zeros((len(flows), len(shapes)))
    cells: dict[int, tuple] = {}  # by length: of each pattern and flow its place in a read's costs, and what is unseen
    for i, (f, n) in enumerate(zip(flows, lengths.tolist(), strict=True)):
        n = min(n, len(f))
        if n not in cells:
            cells[n] = shapes[:, :n] * n + np.arange(n), None if unseen is None or seen is None else np.arange(n)[None, :] >= seen[:, None]
        place, behind = cells[n]
        costs = lookup[:, np.clip(np.asarray(f[:n]), 0, 949)].ravel().take(place)
        if behind is not None:
            costs[behind] = unseen
        out[i] = costs.sum(axis=1) / max(n, 1)
    return out


def near_costs(flows: list[np.ndarray], lengths: np.ndarray, shapes: np.ndarray, lookup: np.ndarray, sigma: float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], unseen: float | None = None, seen: np.ndarray | None = None) -> Costs:
    """Costs.near of all reads and patterns, to the last bit. All of them are reckoned in single precision, as products of
    matrices, with a bound of the error; exactly, only those cells that may count by it."""
    n_of, n_shapes = np.minimum(lengths, [len(f) for f in flows]), len(shapes)
    states = np.unique(shapes)
    most = max(float(np.abs(lookup).max()), abs(unseen or 0.0))
    if not (np.isfinite(most) and sigma > 0):
        step, every = max(1, CELLS // n_shapes), np.arange(n_shapes)
        return Costs.near((exact(np.arange(lo, min(lo + step, len(flows))), every) for lo in range(0, len(flows), step)), sigma, exact)
    item, candidate, chance, least = [], [], [], np.zeros(len(flows))
    for n in np.unique(n_of).tolist():
        slack = (n + 4) * 2.0**-23 * most
        reads = np.flatnonzero(n_of == n)
        rows, cols = max(1, PRODUCT // n_shapes), max(64, PRODUCT // max(len(states) * n, 1))
        for lo in range(0, len(reads), rows):
            some = reads[lo : lo + rows]
            signals = np.clip(np.array([flows[i][:n] for i in some.tolist()], np.int64).reshape(len(some), n), 0, 949)
            signals = np.concatenate([lookup[s].astype(np.float32)[signals] for s in states], axis=1)
            rough = np.empty((len(some), n_shapes), np.float32)
            for at in range(0, n_shapes, cols):
                of = shapes[at : at + cols, :n].T
                behind = np.zeros(of.shape, bool) if unseen is None or seen is None else np.arange(n)[:, None] >= seen[at : at + cols]
                is_state = np.concatenate([(of == s) & ~behind for s in states]).astype(np.float32)
                rough[:, at : at + cols] = signals @ is_state + np.float32(unseen or 0.0) * behind.sum(axis=0).astype(np.float32)
            rough /= max(n, 1)
            may = rough <= (rough.min(axis=1) + (REACH / sigma + 4 * slack))[:, None]
            for k, i in enumerate(some.tolist()):
                u = np.flatnonzero(may[k])
                cost = exact(np.array([i]), u)[0]
                least[i] = cost.min()
                gap = sigma * (cost - least[i])
                near = gap <= REACH
                item.append(np.full(int(near.sum()), i))
                candidate.append(u[near])
                chance.append(np.exp(-gap[near]))
    item, candidate, chance = (np.concatenate(x) for x in (item, candidate, chance))
    order = np.lexsort((candidate, item))
    return Costs(item[order], candidate[order], chance[order], least, sigma, exact)


def qualities(flows: list[np.ndarray], members: np.ndarray, shape: np.ndarray, lookup: np.ndarray) -> list[int]:
    """Phred value of each base of a centroid: the chance that the run is shorter than called."""
    out = []
    for p in range(len(shape)):
        signal = [int(np.clip(flows[i][p], 0, 999)) for i in members if p < len(flows[i])]
        nll = lookup[:, signal].sum(axis=1) if signal else np.zeros(10)
        chance = np.exp(nll.min() - nll)
        chance /= chance.sum()
        for b in range(int(shape[p])):
            wrong = chance[: b + 1].sum()
            out.append(min(100, int(np.floor(-10 * np.log10(wrong))) if wrong > 0 else 100))
    return out


def _sequence(shape: np.ndarray, first: int = 8) -> str:
    return "".join("TACG"[p % 4] * int(s) for p, s in enumerate(shape) if p >= first)


def _flow_start(group: pd.DataFrame, table: np.ndarray, unseen: float | None, sigma: float) -> tuple:
    """Flows, lengths, patterns, each read's pattern, each pattern's first read, clusters to start from, costs."""
    flows = [np.asarray(f, np.int64) for f in group["flows"]]
    lengths = group["len"].to_numpy() // 4 * 4
    shapes, of, firsts = patterns(flows)
    start = np.unique(group["cluster"], return_inverse=True)[1] if "cluster" in group else None

    def exact(reads: np.ndarray, at: np.ndarray) -> np.ndarray:
        return pattern_costs([flows[i] for i in reads], lengths[reads], shapes[at], table, unseen, lengths[firsts[at]])

    costs = near_costs(flows, lengths, shapes, table, sigma, exact, unseen, lengths[firsts])
    return flows, lengths, shapes, of, firsts, start, costs


def _clustered(reads: DataFrame, clusters: DataFrame, block: str) -> DataFrame:
    joined = reads.select(block, "ord", "read_id", "len", "flows").join(clusters.select(block, F.col("member").alias("ord"), "cluster"), [block, "ord"])
    return dealt(joined, block)


def pattern_distances(reads: DataFrame, block: str, lookup: np.ndarray | None = None, unseen: float | None = None) -> DataFrame:
    """block, ord, u, d: of each read (block, ord, len, flows) and each rounded pattern of its block (by its first read)
    the mean -log chance of the read's signals."""
    table = K.default_lookup() if lookup is None else lookup
    kind = dict(reads.dtypes)[block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        name, group = whole[block].chunk(0), whole.select(["ord", "len", "flows"]).to_pandas().sort_values("ord").reset_index(drop=True)
        flows = [np.asarray(f, np.int64) for f in group["flows"]]
        lengths, ords = group["len"].to_numpy() // 4 * 4, group["ord"].to_numpy().astype(np.int64)
        shapes, _, firsts = patterns(flows)
        n, u = len(flows), len(shapes)
        step = max(1, CELLS // u)
        for lo in range(0, n, step):  # some reads at a time: all costs of a block are its reads by its patterns
            cost = pattern_costs(flows[lo : lo + step], lengths[lo : lo + step], shapes, table, unseen, lengths[firsts])
            m = len(cost)
            yield pa.RecordBatch.from_arrays([name.take(pa.array(np.zeros(m * u, np.int64))), pa.array(np.repeat(ords[lo : lo + step], u)), pa.array(np.tile(np.arange(u, dtype=np.int32), m)), pa.array(cost.ravel())], names=[block, "ord", "u", "d"])

    return dealt(reads.select(block, "ord", "len", "flows"), block).groupBy(block).applyInArrow(run, f"`{block}` {kind}, ord long, u int, d double")


def pattern_qualities(reads: DataFrame, block: str, lookup: np.ndarray | None = None) -> DataFrame:
    """block, u, quality: of each rounded pattern of a block the Phred values of its bases, from the reads that have it."""
    table = K.default_lookup() if lookup is None else lookup
    kind = dict(reads.dtypes)[block]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord").reset_index(drop=True)
        flows = [np.asarray(f, np.int64) for f in group["flows"]]
        shapes, of, _ = patterns(flows)
        return pd.DataFrame({block: group[block].iat[0], "u": np.arange(len(shapes)), "quality": [qualities(flows, np.flatnonzero(of == u), shapes[u], table) for u in range(len(shapes))]})

    return dealt(reads.select(block, "ord", "flows"), block).groupBy(block).applyInPandas(run, f"`{block}` {kind}, u int, quality array<int>")


def flow_responsibilities(reads: DataFrame, clusters: DataFrame, block: str, sigma: float = 60.0, lookup: np.ndarray | None = None, unseen: float | None = None, most_steps: int = MOST_STEPS) -> DataFrame:
    """block, i, k, tau: the last responsibilities of flow_denoise, and of each block -log-likelihood by step in rows with
    k null (i is the step, tau the value)."""
    table = K.default_lookup() if lookup is None else lookup
    kind = dict(reads.dtypes)[block]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord").reset_index(drop=True)
        *_, of, _firsts, start, cost = _flow_start(group, table, unseen, sigma)
        found = denoise(start, cost, of, sigma, most_steps=most_steps)
        i, k, share = found.soft
        soft = pd.DataFrame({block: group[block].iat[0], "i": group["ord"].to_numpy()[i], "k": pd.array(k, "Int32"), "tau": share})
        trace = pd.DataFrame({block: group[block].iat[0], "i": np.arange(len(found.likelihood)), "k": pd.array([None] * len(found.likelihood), "Int32"), "tau": found.likelihood})
        return pd.concat([soft, trace])

    return _clustered(reads, clusters, block).groupBy(block).applyInPandas(run, f"`{block}` {kind}, i long, k int, tau double")


_FLOW_OUT = "cluster int, sequence string, weight long, representative string, members array<string>, member_ords array<long>, quality array<int>"


def flow_denoise(reads: DataFrame, clusters: DataFrame, block: str, sigma: float = 60.0, lookup: np.ndarray | None = None, unseen: float | None = None, first: int = 8, most_steps: int = MOST_STEPS) -> DataFrame:
    """Denoised flows of each block. reads: block, ord (from 0), read_id, len, flows; clusters: block, cluster, member.
    A row a cluster: its sequence from flow `first` on, weight, representative (first read with its pattern), members."""
    table = K.default_lookup() if lookup is None else lookup
    kind = dict(reads.dtypes)[block]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("ord").reset_index(drop=True)
        flows, lengths, shapes, of, firsts, start, cost = _flow_start(group, table, unseen, sigma)
        found = denoise(start, cost, of, sigma, most_steps=most_steps)
        rows = []
        for number, c in enumerate(found.centroid):
            at, u = np.flatnonzero(found.cluster == c), found.centroid[c]
            rows.append((group[block].iat[0], number, _sequence(shapes[u][: lengths[firsts[u]]], first), len(at), group["read_id"].iat[firsts[u]], group["read_id"].iloc[at].tolist(), group["ord"].iloc[at].tolist(), qualities(flows, at, shapes[u][: lengths[firsts[u]]], table)[4:]))
        return pd.DataFrame(rows, columns=[block, "cluster", "sequence", "weight", "representative", "members", "member_ords", "quality"])

    return _clustered(reads, clusters, block).groupBy(block).applyInPandas(run, f"`{block}` {kind}, {_FLOW_OUT}")


# ---------------------------------------------------------------- sequences


def sequence_denoise(seqs: DataFrame, distances: DataFrame | ByValue, clusters: DataFrame, block: str, sigma: float = 30.0, most_steps: int = MOST_STEPS) -> DataFrame:
    """Denoised sequences of each block. seqs: block, ord (from 0), seq_id, weight, seq; distances: block, i, j, d (one
    or both directions), or by values. A row a cluster: sequence of the medoid, weight, representative, members."""
    kind = dict(seqs.dtypes)[block]

    numbered, full = isinstance(distances, ByValue), getattr(distances, "full", False)
    names = [block, "cluster", "sequence", "weight", "representative", "members", "member_ords"]

    def run(_key, group: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        if group.empty:
            return pd.DataFrame(columns=names)
        group = group.sort_values("ord").reset_index(drop=True)
        n = len(group)
        if numbered:
            return found_in(group, by_number(pairs, group["number"].to_numpy(), not full))
        d = np.zeros((n, n), np.float32)
        i, j, v = pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs["d"].to_numpy(np.float32)
        d[i, j] = v
        if len(v) <= n * (n - 1) // 2:
            d[j, i] = v
        return found_in(group, d)

    def found_in(group: pd.DataFrame, d: np.ndarray) -> pd.DataFrame:
        n = len(group)
        start = np.unique(group["cluster"], return_inverse=True)[1]
        found = denoise(start, d.astype(np.float64), np.arange(n), sigma, group["weight"].to_numpy(float), SEQUENCE_STEPS, most_steps)
        rows = []
        for number, c in enumerate(found.centroid):
            at, m = np.flatnonzero(found.cluster == c), found.centroid[c]
            rows.append((group[block].iat[0], number, group["seq"].iat[m], int(group["weight"].iloc[at].astype(int).sum()), group["seq_id"].iat[m], group["seq_id"].iloc[at].tolist(), group["ord"].iloc[at].tolist()))
        return pd.DataFrame(rows, columns=names)

    if numbered:
        seqs = seqs.join(distances.rows.select(block, "ord", "number"), [block, "ord"])
        distances = distances.pairs
    joined = seqs.select(block, "ord", "seq_id", "weight", "seq", *(["number"] if numbered else [])).join(clusters.select(block, F.col("member").alias("ord"), "cluster"), [block, "ord"])
    return dealt(joined, block).groupBy(block).cogroup(dealt(distances, block).groupBy(block)).applyInPandas(run, f"`{block}` {kind}, cluster int, sequence string, weight long, representative string, members array<string>, member_ords array<long>")


# ---------------------------------------------------------------- over DataFrames


def cluster_weights(tau: DataFrame) -> DataFrame:
    """k, w of responsibilities (i, k, tau, weight)."""
    return tau.groupBy("k").agg(F.sum(F.col("tau") * F.col("weight")).alias("w"))


def expectation_step(distances: DataFrame, weights: DataFrame, sigma: float) -> DataFrame:
    """i, k, tau from distances (i, k, d) and weights (k, w): one join on k and one window by i. An item's clusters are
    those that it has a distance to, so a window holds no more than the clusters of its block."""
    live = distances.join(weights.where(F.col("w") > LEAST_WEIGHT), "k")
    item = Window.partitionBy("i")
    part = live.withColumn("_p", F.col("w") * F.exp(-sigma * (F.col("d") - F.min("d").over(item))))
    return part.select("i", "k", (F.col("_p") / F.sum("_p").over(item)).alias("tau")).where(F.col("tau") > LEAST_TAU)


def negative_log_likelihood(distances: DataFrame, weights: DataFrame, sigma: float) -> DataFrame:
    each = distances.join(weights, "k").groupBy("i").agg(F.sum(F.col("w") * F.exp(-sigma * F.col("d"))).alias("_s"))
    return each.agg((-F.sum(F.log("_s")) - F.count(F.lit(1)) * F.log(F.lit(float(sigma)))).alias("nll"))


def effective_clusters(weights: DataFrame) -> DataFrame:
    return weights.agg(F.count_if(F.col("w") > LEAST_WEIGHT).alias("k_eff"))


def set_z(tau: DataFrame) -> DataFrame:
    """i, z (the cluster of the largest responsibility, the lowest of equals), p (what the others have)."""
    best = F.max_by("k", F.struct("tau", (-F.col("k")).alias("_n")))
    return tau.groupBy("i").agg(best.alias("z"), (1 - F.max("tau")).alias("p"))


def medoids(scores: DataFrame) -> DataFrame:
    """k, c: of candidates (k, c, score, seen) the one with the least score, the first seen of equals."""
    return scores.groupBy("k").agg(F.min_by("c", F.struct("score", "seen")).alias("c"))


def candidate_scores(tau: DataFrame, distances: DataFrame) -> DataFrame:
    """k, c, score, seen: of each cluster's members as centroids, the weighted distance of all its members. tau: i, k,
    tau, weight; distances: i, c, d."""
    members = tau.select("k", F.col("i").alias("c"))
    pairs = tau.join(distances, "i").join(members, ["k", "c"])
    return pairs.groupBy("k", "c").agg(F.sum(F.col("d") * F.col("tau") * F.col("weight")).alias("score")).withColumn("seen", F.col("c"))
