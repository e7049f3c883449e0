"""Chimera detection: best two and three parents, chimera and imbalance indices, and the class filter."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.sequences import logistic
from .stage import dealt

#: Fixed value: by how much three parents must be better than two, and how bad two must be before three are tried.
TRIMERA = 3


def parent_candidates(seqs: DataFrame, block: str) -> DataFrame:
    """block, i, j: sequences of at least the query's frequency, itself left out. seqs: block, ord, freq."""
    a, b = (seqs.select(block, F.col("ord").alias(x), F.col("freq").alias(f"_{x}")) for x in ("i", "j"))
    return a.join(b, block).where((F.col("_j") >= F.col("_i")) & (F.col("i") != F.col("j"))).select(block, "i", "j")


def best_hits(diffs: DataFrame) -> DataFrame:
    """i, j, n_diff of the fewest differences, the first of equals."""
    return diffs.groupBy("i").agg(F.min_by("j", F.struct("n_diff", "j")).alias("j"), F.min("n_diff").alias("n_diff"))


def _best(values: np.ndarray, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Column minima and their rows; of equals the most frequent, then the first."""
    least = values.min(axis=0)
    rank = np.where(values == least[None, :], freq[:, None], -np.inf)
    return least, rank.argmax(axis=0)


def best_chimera(d: np.ndarray, r: np.ndarray, freq: np.ndarray) -> dict:
    """Of the prefix and suffix differences of all candidates (rows): the split and the two parents with the least sum."""
    (dk, pd_), (rk, pr) = _best(d, freq), _best(r, freq)
    n = d.shape[1]
    total = dk[: n - 1] + rk[n - 2 :: -1][: n - 1]
    k = int(total.argmin())
    return {"best": int(total[k]), "split": k, "p1": int(pd_[k]), "p2": int(pr[n - k - 2])}


def best_trimera(d: np.ndarray, r: np.ndarray, freq: np.ndarray) -> dict:
    """The same with three parents and two splits."""
    (dk, pd_), (rk, pr) = _best(d, freq), _best(r, freq)
    n, found = d.shape[1], None
    for k in range(n - 1):
        middle, pm = _best(d[:, k : n - 1] - d[:, k : k + 1], freq)
        total = middle + dk[k] + rk[n - 2 - np.arange(k, n - 1)]
        x = int(total.argmin())
        if found is None or total[x] < found["best"]:
            split = k + x
            found = {"best": int(total[x]), "split1": k, "split2": split, "t1": int(pd_[k]), "t2": int(pm[x]), "t3": int(pr[n - split - 2])}
    return found or {"best": 1 << 30}


def _projected(al: dict) -> str:
    """The other sequence's character (- for none) at each base of the query."""
    return "".join(al["b"][k] for k in al["map_d"]).replace(".", "-")


def _joined(parts: list[tuple[dict, int, int]]) -> str:
    """A sequence made of pieces of aligned parents, each from one query position to another, gaps left out."""
    out = ""
    for al, lo, hi in parts:
        at = al["map_d"]
        left, right = (0 if lo == 0 else at[lo]), (len(al["b"]) if hi >= len(at) else at[hi])
        out += al["b"][left:right]
    return out.replace("-", "").replace(".", "")


def imbalance(query: str, first: str, second: str, with_balance: bool = False) -> tuple[float, int]:
    """(index, split). An approximation of the index that is defined on a three-way alignment: here both parents are
    laid along the query by their own alignments, so insertions against the query do not count."""
    n = len(query)
    d1 = [k for k in range(n) if query[k] != first[k]]
    d2 = [k for k in range(n) if query[k] != second[k]]
    # differences to the first parent left of the split, and to the second right of it
    steps = sorted([(k, 0, 1) for k in d1] + [(k, 1, -1) for k in d2])
    totals, places = [len(d2)], [-1]
    for k, _, change in steps:
        totals.append(totals[-1] + change)
        places.append(k)
    s = int(np.argmin(totals))
    split = (places[s] + places[s + 1]) // 2 if s + 1 < len(places) else n - 1
    left, right, z = [0, 0], [0, 0], 0
    for k in range(n):
        chars = (query[k], first[k], second[k])
        most = max(chars, key=lambda c: (chars.count(c), -chars.index(c)))
        z += query[k] != most
        for p in (0, 1):
            if chars[p + 1] != most:
                (left if k <= split else right)[p] += 1
    share = (split + 1) / max(n, 1)
    near = 0 if len(d1) <= len(d2) else 1
    x, y = left[near] + right[near], left[1 - near] + right[1 - near]
    xb, ya = (right[0], left[1]) if near == 0 else (left[1], right[0])
    pa, pb = (share, 1 - share) if near == 0 else (1 - share, share)
    total = K.binomial_tail(x + z, x, 0.5) if with_balance and x + z else 0.0
    return total + (K.binomial_tail(y, ya, pa) if y else 0.0) + (K.binomial_tail(x, xb, pb) if x else 0.0), split


_OUT = "i long, id string, best int, ref long, ref_id string, best_chimera int, p1 long, p2 long, d_best double, c_index double, excess double, loon double, best_trimera int, split int, class string"


#: Texts of a task's queries, queries of a task, and pairs that are aligned at a time: a task holds the references' texts
#: once and, of a query, nothing but minima by position, however many references there are.
GROUP, ROWS, PAIRS = 32, 2048, 2048


class _Query:
    """One sequence (of all rows with its text, frequency and candidates), its candidates (places in the references, in
    their order) and what is known of them so far. Of candidates with one text only the most frequent, first one (at) can
    be a parent; first is the first one's place."""

    def __init__(self, seq: str, at: np.ndarray, first: dict[int, int], candidates: int):
        n = len(seq)
        self.at, self.first, self.candidates, self.seq, self.n = at, first, candidates, seq, n
        self.hit = (1 << 30, -1)
        # least differences up to each position, the frequency and the place of whose they are; from the left and right
        self.sides = [[np.full(n, 1 << 30), np.full(n, -np.inf), np.full(n, -1)] for _ in range(2)]
        self.three = None

    def see(self, at: np.ndarray, freq: np.ndarray, als: dict) -> None:
        self.hit = min(self.hit, *((int(n), self.first[k]) for n, k in zip(als["n_diff"], at.tolist(), strict=True)))
        for side, name in zip(self.sides, ("d", "r"), strict=True):
            least, row = _best(np.array(als[name]), freq)
            better = (least < side[0]) | ((least == side[0]) & (freq[row] > side[1]))
            for old, new in zip(side, (least, freq[row], at[row]), strict=True):
                old[better] = new[better]

    def two(self) -> dict:
        """The split and the two parents with the least sum."""
        (dk, _, pd_), (rk, _, pr) = self.sides
        total = dk[: self.n - 1] + rk[self.n - 2 :: -1][: self.n - 1]
        k = int(total.argmin())
        return {"best": int(total[k]), "split": k, "p1": int(pd_[k]), "p2": int(pr[self.n - k - 2])}

    def see_three(self, at: np.ndarray, freq: np.ndarray, als: dict) -> None:
        """The least sum with a middle parent among these, the first splits and the most frequent parent of equals."""
        (dk, _, pd_), (rk, _, pr) = self.sides
        d, n = np.array(als["d"]), self.n
        for k in range(n - 1):
            middle, pm = _best(d[:, k : n - 1] - d[:, k : k + 1], freq)
            total = middle + dk[k] + rk[n - 2 - np.arange(k, n - 1)]
            x = int(total.argmin())
            key = (int(total[x]), k, k + x, -float(freq[pm[x]]), int(at[pm[x]]))
            if self.three is None or key < self.three:
                self.three = key

    def three_parents(self) -> dict:
        best, k, x, _, middle = self.three
        return {"best": best, "split1": k, "split2": x, "t1": int(self.sides[0][2][k]), "t2": middle, "t3": int(self.sides[1][2][self.n - x - 2])}


def _queries(own: list, least_of: list[float], seqs: list[str], names: list, freq: np.ndarray, number: np.ndarray) -> tuple[list[_Query], list[int]]:
    """The queries of rows (names, frequencies, texts) against references (names, frequencies, numbers of texts), and of
    each row its query, counted from 1, or 0 for fewer than two candidates. Rows with one text and frequency have one,
    but for those that themselves are what a text is known by among the candidates."""
    by_freq = np.lexsort((-freq, number))
    named: dict = {}
    for k, name in enumerate(names):
        named.setdefault(name, []).append(k)

    def options(ok: np.ndarray) -> tuple[np.ndarray, dict[int, int]]:
        """Of each text the first of the most frequent candidates, and for these the first candidate with the text."""
        order, at = by_freq[ok[by_freq]], np.flatnonzero(ok)
        best = order[np.append(True, number[order[1:]] != number[order[:-1]])] if len(order) else order
        firsts = at[np.unique(number[at], return_index=True)[1]]
        return np.sort(best), dict(zip(best.tolist(), firsts.tolist(), strict=True))

    queries, which = [], []
    at_least: dict = {}  # of each frequency
    of: dict = {}  # of each row's name, frequency and text
    known: dict = {}  # of each text, frequency, name that matters, and number of candidates (3 for more)
    for row in zip(own, least_of, seqs, strict=True):
        if row not in of:
            name, least, seq = row
            if least not in at_least:
                ok = freq >= least
                best, first = options(ok)
                at_least[least] = int(ok.sum()), best, first, {*first, *first.values()}
            total, best, first, places = at_least[least]
            mine = [k for k in named.get(name, ()) if freq[k] >= least]
            candidates, matters = total - len(mine), not places.isdisjoint(mine)
            key = (seq, least, name if matters else None, matters, min(candidates, 3))
            if candidates < 2 or len(seq) < 2:
                known[key] = 0
            elif key not in known:
                if matters:
                    ok = freq >= least
                    ok[mine] = False
                    best, first = options(ok)
                queries.append(_Query(seq, best, first, candidates))
                known[key] = len(queries)
            of[row] = known[key]
        which.append(of[row])
    return queries, which


def _aligned(todo: list[tuple[_Query, np.ndarray]], texts: list[str], whole: bool = False):
    """(query, places, profiles) of all pairs, many together: of several queries, or of a part of one's candidates. With
    whole, alignments instead of profiles."""
    held, size = [], 0
    for query, at in todo:
        for lo in range(0, len(at), PAIRS):
            held.append((query, at[lo : lo + PAIRS]))
            size += len(held[-1][1])
            if size >= PAIRS:
                yield from _align(held, texts, whole)
                held, size = [], 0
    if held:
        yield from _align(held, texts, whole)


def _align(held: list[tuple[_Query, np.ndarray]], texts: list[str], whole: bool):
    places: dict[tuple[str, str], int] = {}  # each two texts once
    of = [[places.setdefault((q.seq, texts[k]), len(places)) for k in at.tolist()] for q, at in held]
    als = (K.nw_diff if whole else K.diff_profiles)([a for a, _ in places], [b for _, b in places])
    for (query, at), some in zip(held, of, strict=True):
        yield query, at, [als[k] for k in some] if whole else {n: v[some] if isinstance(v, np.ndarray) else [v[k] for k in some] for n, v in als.items()}


def _judged(query: _Query, als: dict[int, dict], names: list, ords: list, with_balance: bool) -> tuple[dict, str]:
    """A query's row without distances, and the sequence that its parents make up."""
    two, n, kind = query.two(), query.n, "Chimera"
    model = _joined([(als[two["p1"]], 0, two["split"] + 1), (als[two["p2"]], two["split"] + 1, n)])
    tri = query.three_parents() if query.three else None
    if tri and two["best"] - tri["best"] >= TRIMERA:
        kind = "Trimera"
        model = _joined([(als[tri["t1"]], 0, tri["split1"] + 1), (als[tri["t2"]], tri["split1"] + 1, tri["split2"] + 1), (als[tri["t3"]], tri["split2"] + 1, n)])
    loon, split = imbalance(query.seq, _projected(als[two["p1"]]), _projected(als[two["p2"]]), with_balance)
    best, hit = query.hit
    return {"best": best, "ref": ords[hit], "ref_id": names[hit], "best_chimera": two["best"], "p1": ords[two["p1"]], "p2": ords[two["p2"]], "loon": loon, "best_trimera": tri["best"] if tri else None, "split": split, "class": kind}, model


def chimera_check(seqs: DataFrame, block: str, table: np.ndarray | None = None, with_balance: bool = False, references: DataFrame | None = None) -> DataFrame:
    """A row for each sequence (block, ord, seq_id, freq, seq), with class Null for fewer than two candidates, Chimera
    or Trimera. The queries of GROUP texts, ROWS at most, and the references of their block are a task's work, so a block spreads over many tasks,
    and the references are sent once a group. References are the sequences unless given. A null seq counts
    as empty."""
    refs = seqs if references is None else references
    text = lambda df: df.withColumn("seq", F.coalesce("seq", F.lit("")))
    named = text(seqs).select(block, "ord", "seq_id", "freq", "seq").withColumn("_top", F.max("freq").over(Window.partitionBy(block, "seq")))
    # GROUP texts to a group, the most frequent first, and ROWS of their rows
    named = named.withColumn("_texts", F.floor((F.dense_rank().over(Window.partitionBy(block).orderBy(F.desc("_top"), "seq")) - 1) / GROUP).cast("long"))
    place = F.row_number().over(Window.partitionBy(block, "_texts").orderBy(F.desc("freq"), "ord")) - 1
    queries = named.withColumn("_group", F.struct("_texts", F.floor(place / ROWS).cast("long").alias("_rows"))).drop("_top", "_texts")
    groups = queries.groupBy(block, "_group").agg(F.min("freq").alias("_least"))
    other = text(refs).select(block, F.col("ord").alias("_ord"), F.col("seq_id").alias("_id"), F.col("freq").alias("_freq"), F.col("seq").alias("_seq"))
    spread = other.join(groups, block).where("_freq >= _least").select(F.col(block).alias("_block"), F.col("_group").alias("_of"), "_ord", "_id", "_freq", "_seq")
    kind = dict(seqs.dtypes)[block]
    columns = [block, *(c.split()[0] for c in _OUT.split(", "))]

    def judge(_key, own: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
        refs, own = refs.sort_values("_ord"), own.sort_values("ord")
        names, ords, texts, freq = refs["_id"].tolist(), refs["_ord"].tolist(), refs["_seq"].tolist(), refs["_freq"].to_numpy(float)
        number = np.unique(np.array(texts, object), return_inverse=True)[1] if texts else np.zeros(0, int)
        queries, which = _queries(own["seq_id"].tolist(), own["freq"].tolist(), own["seq"].tolist(), names, freq, number)
        rows, todo = [{**dict.fromkeys(columns), "class": "Null"}], list(enumerate(queries, 1))
        rows += [dict.fromkeys(columns) for _ in todo]
        for query, at, als in _aligned([(q, q.at) for _, q in todo], texts):
            query.see(at, freq[at], als)
        hard = [q for _, q in todo if q.two()["best"] >= TRIMERA and q.candidates >= 3]
        for query, at, als in _aligned([(q, q.at) for q in hard], texts):
            query.see_three(at, freq[at], als)
        chosen = []
        for _, q in todo:
            tri = q.three_parents() if q.three else {}
            chosen.append((q, np.unique([*(q.two()[k] for k in ("p1", "p2")), *(tri[k] for k in ("t1", "t2", "t3") if tri)])))
        parents: dict[int, dict] = {}
        for query, at, als in _aligned(chosen, texts, True):
            parents.setdefault(id(query), {}).update(zip(at.tolist(), als, strict=True))
        ends = []
        for k, q in todo:
            row, model = _judged(q, parents[id(q)], names, ords, with_balance)
            rows[k] |= row
            ends.append((q.seq, texts[q.hit[1]], model))
        if ends:
            both = {pair: k for k, pair in enumerate(dict.fromkeys([(e[0], e[k]) for k in (1, 2) for e in ends]))}
            near = [K.nw_homopolymer([a for a, _ in list(both)[lo : lo + PAIRS]], [b for _, b in list(both)[lo : lo + PAIRS]], table, unknown=None) for lo in range(0, len(both), PAIRS)]
            found = np.concatenate(near)[[both[e[0], e[k]] for k in (1, 2) for e in ends]]
            for (k, _), near, index in zip(todo, found[: len(ends)], found[len(ends) :], strict=True):
                rows[k] |= {"d_best": near, "c_index": index, "excess": index - near}
        out = pd.DataFrame(rows, columns=columns, dtype=object).take(which)
        return out.assign(**{block: own[block].to_numpy(), "i": own["ord"].to_numpy(), "id": own["seq_id"].to_numpy()})

    return dealt(queries, block, "_group").groupBy(block, "_group").cogroup(dealt(spread, "_block", "_of").groupBy("_block", "_of")).applyInPandas(judge, f"`{block}` {kind}, {_OUT}")


def classify(rows: DataFrame, alpha: float = -7.5, beta: float = 0.5) -> DataFrame:
    """The rows with p, the chance to be a chimera."""
    p = F.when(F.col("class") == "Null", F.lit(0.0)).otherwise(logistic(F.col("c_index"), F.col("excess"), F.col("loon"), alpha, beta))
    return rows.withColumn("p", p)


def good_class_filter(seqs: DataFrame, classes: DataFrame, key: str = "ord", below: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(good, chimeras) of seqs by p in classes (key, p)."""
    joined = seqs.join(classes.select(key, "p"), key)
    return joined.where(F.col("p") < below), joined.where(F.col("p") >= below)
