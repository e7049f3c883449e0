"""Numeric kernels on numpy arrays: alignment in step over many pairs, linkage, signal tables, binomial tails."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

DIAG, LEFT, UP = 0, 1, 2
#: Costs of the two alignments.
GAP, HOMOPOLYMER_GAP, SEQUENCE_GAP = 1.5, 4.0, 15.0
BASES = "ACTG"


@dataclass
class Alignment:
    """Of each pair: score, and the columns from the right end: a and b (0 for a gap, 1 for one behind the end of the
    other sequence, else the character), and how many columns."""

    score: np.ndarray
    a: np.ndarray
    b: np.ndarray
    length: np.ndarray


def _codes(sequences: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(s) for s in sequences], np.int64)
    out = np.zeros((len(sequences), int(lengths.max(initial=0))), np.uint8)
    for row, s in zip(out, sequences, strict=True):
        row[: len(s)] = np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    return out, lengths


def align(first: list[str], second: list[str], cost: np.ndarray | None, gap: float, homopolymer: float | None = None, free_left: bool = True) -> Alignment:
    """Global alignments of pairs, all pairs at once, one antidiagonal after another. cost is 256 x 256 by character,
    or None for 1 where characters differ. Gaps behind the end of a sequence are free (for the second one only with
    free_left). A diagonal step must be better than both others, a step left no worse than the diagonal and better than
    up. With homopolymer, a gap costs that where the second sequence's next base repeats the base that the step before
    it ended on."""
    (a, la), (b, lb) = _codes(first), _codes(second)
    pairs, n, m = len(first), a.shape[1], b.shape[1]
    at, bt = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    moves = np.full((n + 1, m + 1, pairs), UP, np.uint8)
    moves[0] = LEFT
    score = np.where(la == 0, lb * gap, np.where(lb == 0, la * gap, 0.0))
    # scores, and the base that each cell's step ended on (0 for none), by row, on the last two antidiagonals
    older, old = np.zeros((n + 1, pairs)), np.zeros((n + 1, pairs))
    last = np.zeros((n + 1, pairs), np.uint8)
    ends = la + lb
    for k in range(1, n + m + 1):
        new, came = np.empty((n + 1, pairs)), np.zeros((n + 1, pairs), np.uint8)
        if k <= m:
            new[0] = k * gap
        if k <= n:
            new[k], came[k] = k * gap, at[k - 1]
        lo, hi = max(1, k - m), min(n, k - 1)
        if lo <= hi:
            rows = np.arange(lo, hi + 1)
            x, y = at[lo - 1 : hi], bt[k - hi - 1 : k - lo][::-1]
            fee = gap if homopolymer is None else np.where(y == last[lo : hi + 1], homopolymer, gap)
            diag = older[lo - 1 : hi] + ((x != y) if cost is None else cost[x, y])
            left = old[lo : hi + 1] + (np.where(rows[:, None] == la, 0.0, fee) if free_left else fee)
            up = old[lo - 1 : hi] + np.where((k - rows)[:, None] == lb, 0.0, fee)
            best = np.minimum(left, up)
            move = np.where(diag < best, DIAG, np.where((left <= diag) & (left < up), LEFT, UP)).astype(np.uint8)
            moves[rows, k - rows] = move
            new[lo : hi + 1] = np.minimum(best, diag)
            if homopolymer is not None:
                came[lo : hi + 1] = np.where(move == DIAG, np.where(x == y, x, 0), np.where(move == LEFT, y, x))
        done = np.flatnonzero((ends == k) & (la > 0) & (lb > 0))
        score[done] = new[la[done], done]
        older, old, last = old, new, came
    width, p = n + m, np.arange(pairs)
    out_a, out_b = np.zeros((pairs, width), np.uint8), np.zeros((pairs, width), np.uint8)
    i, j, length = la.copy(), lb.copy(), np.zeros(pairs, np.int64)
    for k in range(width):
        live = (i > 0) | (j > 0)
        if not live.any():
            break
        move = moves[i, j, p]
        move = np.where(i == 0, LEFT, np.where(j == 0, UP, move))
        takes_a, takes_b = live & (move != LEFT), live & (move != UP)
        inner = (i > 0) & (j > 0)
        ca = np.where(takes_a, a[p, np.maximum(i - 1, 0)] if n else 0, np.where(live & inner & (i == la), 1, 0))
        cb = np.where(takes_b, b[p, np.maximum(j - 1, 0)] if m else 0, np.where(live & inner & (j == lb), 1, 0))
        out_a[:, k], out_b[:, k] = np.where(live, ca, 0), np.where(live, cb, 0)
        i, j, length = i - takes_a, j - takes_b, length + live
    return Alignment(score, out_a, out_b, length)


def nw_identity(first: list[str], second: list[str]) -> np.ndarray:
    """Share of differences between aligned ends: a run of gaps is one difference, N agrees with anything, and pairs
    that do not overlap are 1 apart."""
    al = align(first, second, None, GAP)
    gap_a, gap_b = al.a < 2, al.b < 2
    column = np.arange(al.a.shape[1])[None, :]
    inside = column < al.length[:, None]
    ends = [((np.where(~g & inside, column, 1 << 30)).min(axis=1, initial=1 << 30), (np.where(~g & inside, column, -1)).max(axis=1, initial=-1) + 1) for g in (gap_a, gap_b)]
    start, end = np.maximum(ends[0][0], ends[1][0]), np.minimum(ends[0][1], ends[1][1])
    inside &= (column >= start[:, None]) & (column < end[:, None])
    events = np.zeros(len(first))
    for gap in (gap_a & inside, gap_b & inside):
        opened = gap.copy()
        opened[:, 1:] &= ~gap[:, :-1]
        events += opened.sum(axis=1)
    both = inside & ~gap_a & ~gap_b
    other = both & (al.a != al.b) & (al.a != ord("N")) & (al.b != ord("N"))
    residues = events + both.sum(axis=1)
    return np.where((end > start) & (residues > 0), (events + other.sum(axis=1)) / np.maximum(residues, 1), 1.0)


def substitution_cost(table: np.ndarray, unknown: float | None = 0.0) -> np.ndarray:
    """256 x 256 costs from a 4 x 4 table over ACTG. Other characters cost unknown, or count as A with None."""
    at = np.zeros(256, np.int64)
    for k, base in enumerate(BASES):
        at[ord(base)] = k
    cost = np.asarray(table, np.float64)[at][:, at]
    if unknown is not None:
        other = np.ones(256, bool)
        other[[ord(b) for b in BASES]] = False
        cost[other], cost[:, other] = unknown, unknown
    return cost


#: Measured costs of substitutions, over ACTG.
SUBSTITUTIONS = (
    (0.0, 11.619259, 11.694004, 7.748623),
    (11.619259, 0.0, 7.619657, 12.852562),
    (11.694004, 7.619657, 0.0, 10.964048),
    (7.748623, 12.852562, 10.964048, 0.0),
)


def default_costs() -> np.ndarray:
    """The measured table; another is read by scan_tran."""
    return np.array(SUBSTITUTIONS)


def nw_homopolymer(first: list[str], second: list[str], table: np.ndarray | None = None, both_ends: bool = True, unknown: float | None = 0.0) -> np.ndarray:
    """Alignment score by columns, those at the right end that run over one sequence's end left out. both_ends=False
    is the asymmetric form: gaps past the second sequence's start cost like others and only the first may run over."""
    cost = substitution_cost(default_costs() if table is None else table, unknown)
    al = align(first, second, cost, SEQUENCE_GAP, HOMOPOLYMER_GAP, free_left=both_ends)
    column = np.arange(al.a.shape[1])[None, :]
    over = (al.a == 1) | (al.b == 1) if both_ends else (al.b == 1)
    over &= column < al.length[:, None]
    tail = np.cumprod(over, axis=1).sum(axis=1)
    return al.score / np.maximum(al.length - tail, 1)


def diff_profiles(first: list[str], second: list[str]) -> dict[str, list | np.ndarray]:
    """n_diff, d and r of nw_diff for many pairs at once, without texts and maps."""
    al = align(first, second, None, GAP)
    inside = np.arange(al.a.shape[1])[None, :] < al.length[:, None]
    base = (al.a > 1) & inside
    other = (base & (al.b > 1) & (al.a != al.b)) | ((al.a == 0) & inside)
    left, right = other | (base & (al.b == 0)), other | (base & (al.b < 2))
    total = left.sum(axis=1)
    row, column = np.nonzero(base)  # from the right end on
    r = np.cumsum(right, axis=1)[row, column]
    d = total[row] - (np.cumsum(left, axis=1) - left)[row, column]
    ends = np.cumsum(np.bincount(row, minlength=len(first)))[:-1] if len(first) else []
    return {"n_diff": total, "d": [x[::-1] for x in np.split(d, ends)], "r": np.split(r, ends)}


def nw_diff(first: list[str], second: list[str]) -> list[dict]:
    """Of each pair: n_diff, and at each base of the first sequence the differences up to it (d, from the left) and
    from it on (r, from the right), with the columns they lie in (map_d, map_r). Columns past the end of the second
    sequence are free from the left and count from the right."""
    al, out = align(first, second, None, GAP), []
    for k, n in enumerate(al.length.tolist()):
        a, b = al.a[k, :n][::-1], al.b[k, :n][::-1]
        base = a > 1
        left = (a == 0) | (base & (b == 0)) | (base & (b > 1) & (a != b))
        right = (a == 0) | (base & (b < 2)) | (base & (b > 1) & (a != b))
        d, r = np.cumsum(left), np.cumsum(right[::-1])
        at, back = np.flatnonzero(base), np.flatnonzero(base[::-1])
        out.append({"n_diff": int(d[-1]) if n else 0, "d": d[at].tolist(), "r": r[back].tolist(), "map_d": at.tolist(), "map_r": (n - 1 - back).tolist(), "a": _text(a), "b": _text(b)})
    return out


def _text(codes: np.ndarray) -> str:
    return np.where(codes == 0, ord("-"), np.where(codes == 1, ord("."), codes)).astype(np.uint8).tobytes().decode("latin-1")


# ---------------------------------------------------------------- linkage


def linkage(distances: np.ndarray, method: str = "complete", weights: np.ndarray | None = None, own: bool = False, levels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merges (left, right; the k-th merge is -k-1) and their distances, from a symmetric matrix. The first smallest
    distance row by row below the diagonal merges; the result takes the smaller slot, the last slot fills the other.
    Arithmetic is in single precision. method: complete or average (by weights, else by number). With own the matrix, in
    single precision, is worked in and lost. With levels (complete only) it holds places in these ascending distances."""
    n = len(distances)
    d = distances if own else np.array(distances, np.float32 if levels is None else distances.dtype)
    name, size = np.arange(n), np.ones(n, np.float32) if weights is None else np.asarray(weights, np.float32).copy()
    merges, heights = np.zeros((max(n - 1, 0), 2), np.int64), np.zeros(max(n - 1, 0), np.float32)
    at = np.arange(n)  # of each slot its row and column in the matrix, which is not moved
    # of each slot the first least distance below the diagonal, and its place
    nearest = np.zeros(n, np.int64)
    least = np.full(n, np.inf, np.float32) if levels is None else np.full(n, len(levels), np.int64)
    for i in range(1, n):
        nearest[i] = d[i, :i].argmin()
        least[i] = d[i, nearest[i]]
    for k in range(n - 1):
        m = n - k
        high = int(least[1:m].argmin()) + 1
        into = int(nearest[high])
        heights[k], merges[k] = least[high] if levels is None else levels[least[high]], (name[high], name[into])
        old, gone = at[into], at[high]
        if method == "complete":
            row = np.maximum(d[gone], d[old])
        else:
            row = (d[gone] * size[high] + d[old] * size[into]) / (size[high] + size[into])
            size[into] += size[high]
        changed = np.flatnonzero(d[old] != row)
        d[old, changed] = d[changed, old] = row[changed]
        name[into] = -k - 1
        end = m - 1
        name[high], size[high], at[high] = name[end], size[end], at[end]
        # slots whose part below the diagonal has changed: the two, and those that see them
        redo = [i for i in (into, high) if 0 < i < end]
        for slot in (into, high):
            lo = slot + 1
            if lo >= end:
                continue
            new, near, low = d[at[slot]][at[lo:end]], nearest[lo:end], least[lo:end]
            mine = near == slot
            redo += (np.flatnonzero(mine & (new > low)) + lo).tolist()
            closer = (new < low) | ((new == low) & (near > slot))
            near[closer], low[closer] = slot, new[closer]
        for i in redo:
            below = d[at[i]][at[:i]]
            nearest[i] = below.argmin()
            least[i] = below[nearest[i]]
    return merges, heights


def cut(merges: np.ndarray, heights: np.ndarray, n: int, below: float) -> list[list[int]]:
    """Members of each cluster after the merges of less than below, by slot; who is taken up comes behind."""
    members: list[list[int] | None] = [[i] for i in range(n)]
    slot: list[int] = []
    for (left, right), height in zip(merges.tolist(), heights.tolist(), strict=True):
        if height >= below:
            break
        left, right = (x if x >= 0 else slot[-x - 1] for x in (left, right))
        keep, gone = min(left, right), max(left, right)
        slot.append(keep)
        members[keep] += members[gone]
        members[gone] = None
    return [m for m in members if m is not None]


def cut_levels(merges: np.ndarray, heights: np.ndarray, n: int, resolution: float = 0.01) -> list[tuple[int, list[list[int]]]]:
    """Level k, with clusters of merges below k * resolution (as cut gives them), for all levels under the last merge."""
    levels = math.floor(float(heights[-1]) / resolution + 1e-7) if len(heights) else 0
    members: list[list[int] | None] = [[i] for i in range(n)]
    slot: list[int] = []
    pairs, tall, out = merges.tolist(), heights.tolist(), []
    for k in range(levels):
        while len(slot) < len(pairs) and tall[len(slot)] < k * resolution:  # on from where the level before has stopped
            left, right = (x if x >= 0 else slot[-x - 1] for x in pairs[len(slot)])
            keep, gone = min(left, right), max(left, right)
            slot.append(keep)
            members[keep] += members[gone]
            members[gone] = None
        out.append((k, [m.copy() for m in members if m is not None]))
    return out


def newick(merges: np.ndarray, heights: np.ndarray, names: list[str]) -> str:
    text: list[tuple[str, float]] = []
    part = lambda x: (names[x], 0.0) if x >= 0 else text[-x - 1]
    for (left, right), height in zip(merges.tolist(), heights.tolist(), strict=True):
        (a, ha), (b, hb) = part(left), part(right)
        text.append((f"({a}:{height - ha:.3f},{b}:{height - hb:.3f})", height))
    return (text[-1][0] if text else f"({names[0]})" if names else "()") + ";"


# ---------------------------------------------------------------- signals


@lru_cache(maxsize=4)
def default_lookup(bins: int = 1000) -> np.ndarray:
    """-log of the chance of a signal in hundredths (column) from a run of s bases (row). A stand-in for a measured
    table: normal around s with deviation 0.04 + 0.03 s, and for none log-normal around exp(-2.2). Give the measured
    table (scan_lookup) where there is one."""
    f = (np.arange(bins) + 0.5) / 100
    rows = [np.exp(-0.5 * ((np.log(f) + 2.2) / 0.7) ** 2) / f]
    rows += [np.exp(-0.5 * ((f - s) / (0.04 + 0.03 * s)) ** 2) for s in range(1, 10)]
    p = np.array(rows)
    return -np.log(np.maximum(p / p.sum(axis=1, keepdims=True), 1e-12))


@lru_cache(maxsize=4)
def flow_tables(lookup_bytes: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """m1[b], the best single fit of a signal, and m2[a, b], the best fit of one run to two signals."""
    lookup = default_lookup() if lookup_bytes is None else np.frombuffer(lookup_bytes).reshape(10, -1)
    pair = np.full((lookup.shape[1],) * 2, np.inf)
    for row in lookup:
        np.minimum(pair, row[:, None] + row[None, :], out=pair)
    return lookup.min(axis=0), pair


@lru_cache(maxsize=4)
def _worse(lookup_bytes: bytes | None = None) -> np.ndarray:
    """How much worse one run explains two signals than each its own."""
    single, pair = flow_tables(lookup_bytes)
    return pair - single[:, None] - single[None, :]


def flow_dist_table(rows: list, cols: list, lookup: np.ndarray | None = None) -> np.ndarray:
    """flow_dist of each of rows with each of cols, to the last bit: eight sums, put together in pairs, and the rest."""
    worse = _worse(None if lookup is None else np.ascontiguousarray(lookup, np.float64).tobytes())
    width, flat, sides = worse.shape[1], worse.ravel(), []
    for flows in (rows, cols):
        n = np.array([len(f) for f in flows], np.int64)
        order = np.argsort(-n, kind="stable")  # the longest first: what has a flow k, or eight more, are the first ones
        signals = np.zeros((int(n.max(initial=0)), len(flows)), np.int64)
        for at, k in enumerate(order.tolist()):
            signals[: n[k], at] = flows[k]
        sides.append((n[order], order, np.clip(signals, 0, 999)))
    out, (lb, by_b, b) = np.zeros((len(rows), len(cols))), sides[1]
    over = lambda n: (len(n) - np.searchsorted(np.sort(n), np.arange(int(n.max(initial=0))), "right")).tolist()
    ys, vs = over(lb), over(lb // 8 * 8)
    places, values = np.empty(32 * len(cols), np.int64), np.empty(32 * len(cols))
    for lo in range(0, len(rows), 32):  # as much as a core's cache holds
        la, by_a, a = sides[0][0][lo : lo + 32], sides[0][1][lo : lo + 32], sides[0][2][:, lo : lo + 32] * width
        xs, us = over(la), over(la // 8 * 8)
        sums, rest = np.zeros((8, len(la), len(lb))), []
        for k, (x, y) in enumerate(zip(xs, ys)):  # how many have a flow k, and as one of eight
            u, v = us[k] if k < len(us) else 0, vs[k] if k < len(vs) else 0
            place, cells = places[: x * y].reshape(x, y), values[: x * y].reshape(x, y)
            np.add(a[k, :x, None], b[k, :y], out=place)
            flat.take(place, out=cells, mode="clip")  # all are inside; the mode spares a copy
            sums[k % 8, :u, :v] += cells[:u, :v]
            if u < x:
                rest.append((slice(u, x), slice(0, y), cells[u:].copy()))
            if v < y and u:
                rest.append((slice(0, u), slice(v, y), cells[:u, v:].copy()))
        total = ((sums[0] + sums[1]) + (sums[2] + sums[3])) + ((sums[4] + sums[5]) + (sums[6] + sums[7]))
        for at, to, cells in rest:
            total[at, to] += cells
        out[by_a[:, None], by_b[None, :]] = total / np.maximum(np.minimum(la[:, None], lb[None, :]), 1)
    return out


def flow_dist(first: list[np.ndarray], second: list[np.ndarray], lookup: np.ndarray | None = None) -> np.ndarray:
    """Mean over common positions of how much worse one run explains both signals than each its own."""
    worse = _worse(None if lookup is None else np.ascontiguousarray(lookup, np.float64).tobytes())
    out = np.zeros(len(first))
    for k, (a, b) in enumerate(zip(first, second, strict=True)):
        n = min(len(a), len(b))
        if n:
            out[k] = worse[np.clip(a[:n], 0, 999), np.clip(b[:n], 0, 999)].mean()
    return out


def binomial_tail(n: int, k: int, p: float) -> float:
    """-log P(at least k of n)."""
    if k <= 0:
        return 0.0
    if p <= 0 or k > n:
        return math.inf
    if p >= 1:
        return 0.0
    term = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    logs = [term(i) for i in range(k, n + 1)]
    top = max(logs)
    return -(top + math.log(sum(math.exp(x - top) for x in logs)))
