"""Expectation-maximisation, parents of chimeras and pattern costs against plain versions, number by number."""

import math
import random

import numpy as np
import pytest

from flowspark.functions import kernels as K
from flowspark.operators import chimera, em, stage


def plain_em(start, cost, candidate, sigma, weights, least, most=1000):
    n, k = len(start), max(start) + 1
    item = weights or [1.0] * n
    tau = [[1.0 if start[i] == c else 0.0 for c in range(k)] for i in range(n)]
    old, steps = [0.0] * k, 0

    def centres(t):
        out = []
        for c in range(k):
            best = None
            if sum(t[i][c] for i in range(n)) > 0.1:
                seen = []
                for i in range(n):
                    if t[i][c] > 0 and candidate[i] not in seen:
                        seen.append(candidate[i])
                for u in seen:
                    score = sum(t[i][c] * item[i] * cost[i][u] for i in range(n))
                    if best is None or score < best[0] - 1e-12:
                        best = (score, u)
            out.append(best[1] if best else None)
        return out

    def expect(center, w):
        out = []
        for i in range(n):
            live = [c for c in range(k) if w[c] > 0.1 and center[c] is not None]
            least_d = min(cost[i][center[c]] for c in live)
            p = {c: w[c] * math.exp(-sigma * (cost[i][center[c]] - least_d)) for c in live}
            all_p = sum(p.values())
            out.append([p[c] / all_p if c in p and p[c] / all_p > 1e-4 else 0.0 for c in range(k)])
        return out

    while True:
        center = centres(tau)
        w = [sum(tau[i][c] * item[i] for i in range(n)) for c in range(k)]
        delta = max(abs(a - b) for a, b in zip(w, old))
        for a in range(k):
            for b in range(a + 1, k):
                if w[a] >= 0.1 and w[b] >= 0.1 and center[a] is not None and center[a] == center[b]:
                    w[a] += w[b]
                    w[b], center[b] = 0.0, None
        old = list(w)
        if steps >= least and (delta <= 1e-6 or steps >= most):
            break
        steps += 1
        tau = expect(center, w)
    tau = expect(center, w)
    cluster = [max(range(k), key=lambda c: (tau[i][c], -c)) for i in range(n)]
    hard = [[1.0 if cluster[i] == c else 0.0 for c in range(k)] for i in range(n)]
    return cluster, {c: x for c, x in enumerate(centres(hard)) if c in cluster}


@pytest.mark.parametrize("weighted", [False, True])
def test_denoising_equals_the_plain_steps(weighted):
    r = random.Random(7)
    for case in range(40):
        n, u = r.randint(2, 9), r.randint(1, 5)
        candidate = list(range(n)) if weighted else [r.randrange(u) for _ in range(n)]
        width = n if weighted else u
        cost = [[0.0 if weighted and i == c else round(r.random() * (0.3 if case % 2 else 2), 3) for c in range(width)] for i in range(n)]
        start = [r.randrange(3) for _ in range(n)]
        start = [sorted(set(start)).index(s) for s in start]
        weights = [float(r.randint(1, 20)) for _ in range(n)] if weighted else None
        least = em.SEQUENCE_STEPS if weighted else em.FLOW_STEPS
        got = em.denoise(np.array(start), np.array(cost), np.array(candidate), 12.0, np.array(weights) if weighted else None, least)
        cluster, center = plain_em(start, cost, candidate, 12.0, weights, least)
        assert got.cluster.tolist() == cluster and got.centroid == center
        assert len(got.likelihood) > least and (got.tau.argmax(axis=1) == got.cluster).all()


def test_costs_of_patterns_number_by_number():
    r = np.random.default_rng(3)
    flows = [r.integers(0, 500, 12) for _ in range(5)]
    lengths = np.array([4, 8, 12, 12, 8])
    look = K.default_lookup()
    shapes, of, firsts = em.patterns(flows)
    for unseen in (None, 10.0):
        got = em.pattern_costs(flows, lengths, shapes, look, unseen, lengths[firsts])
        for i, f in enumerate(flows):
            for u, shape in enumerate(shapes):
                each = [unseen if unseen is not None and p >= lengths[firsts[u]] else look[shape[p], min(int(f[p]), 949)] for p in range(lengths[i])]
                assert abs(got[i, u] - sum(each) / lengths[i]) < 1e-9


def test_parents_against_all_choices():
    r = np.random.default_rng(5)
    for _ in range(60):
        refs, n = r.integers(2, 5), r.integers(2, 7)
        d, s = np.cumsum(r.integers(0, 3, (refs, n)), axis=1), np.cumsum(r.integers(0, 3, (refs, n)), axis=1)
        freq = r.integers(1, 4, refs).astype(float)
        best = min(d[a, k] + s[b, n - k - 2] for a in range(refs) for b in range(refs) for k in range(n - 1))
        two = chimera.best_chimera(d, s, freq)
        assert two["best"] == best == d[two["p1"], two["split"]] + s[two["p2"], n - two["split"] - 2]
        three = chimera.best_trimera(d, s, freq)
        want = min(d[a, k] + d[b, x] - d[b, k] + s[c, n - x - 2] for a in range(refs) for b in range(refs) for c in range(refs) for k in range(n - 1) for x in range(k, n - 1))
        k, x = three["split1"], three["split2"]
        assert three["best"] == want == d[three["t1"], k] + d[three["t2"], x] - d[three["t2"], k] + s[three["t3"], n - x - 2]


def test_responsibilities_and_likelihood(spark):
    from pyspark.sql import functions as F

    rows = [("b", k, f"r{k}", 8, [100 + (k % 3), 0, 200 * (k % 2), 0, 100, 0, 0, 100]) for k in range(8)] + [("c", 0, "s", 8, [100] * 8)]
    reads = spark.createDataFrame(rows, "block string, ord long, read_id string, len int, flows array<int>")
    clusters = reads.select("block", F.col("ord").alias("member"), (F.col("ord") % 2).cast("int").alias("cluster"))
    got = em.flow_responsibilities(reads, clusters, "block").collect()
    soft, trace = [r for r in got if r["k"] is not None], [r for r in got if r["k"] is None]
    for b, n in (("b", 8), ("c", 1)):
        assert all(abs(sum(r["tau"] for r in soft if r["block"] == b and r["i"] == i) - 1) < 1e-3 for i in range(n))
        assert sorted(r["i"] for r in trace if r["block"] == b) == list(range(em.FLOW_STEPS + 1))
    assert {r["k"] for r in soft if r["block"] == "b" and r["i"] % 2 == 0}.isdisjoint({r["k"] for r in soft if r["block"] == "b" and r["i"] % 2})


def test_rows_without_candidates_are_null(spark):
    rows = [("a", 0, "only", 3.0, "ACGTACGT"), ("b", 1, "x", 2.0, "ACGT"), ("b", 2, "y", 2.0, "ACGA"), ("b", 3, "z", 1.0, None)]
    got = {r["i"]: r["class"] for r in chimera.chimera_check(spark.createDataFrame(rows[:3], "block string, ord long, seq_id string, freq double, seq string"), "block").collect()}
    assert got == {0: "Null", 1: "Null", 2: "Null"}


def test_pattern_distances_are_handed_on_in_parts(spark, monkeypatch):
    """No more than CELLS costs at a time, whatever the number of reads and patterns of a block."""
    monkeypatch.setattr(em, "CELLS", 7)
    rng = random.Random(3)
    rows = [(f"b{k % 2}" if k % 3 else None, k, 8, [rng.randrange(300) for _ in range(8)]) for k in range(40)]
    got = em.pattern_distances(spark.createDataFrame(rows, "block string, ord long, len int, flows array<int>"), "block").collect()
    for block in ("b0", "b1", None):
        mine = [r for r in rows if r[0] == block]
        flows = [np.array(r[3]) for r in mine]
        shapes, _, firsts = em.patterns(flows)
        cost = em.pattern_costs(flows, np.array([8] * len(mine)), shapes, K.default_lookup())
        assert {(r["ord"], r["u"]): r["d"] for r in got if r["block"] == block} == {(mine[i][1], u): cost[i, u] for i in range(len(mine)) for u in range(len(shapes))}


def test_two_texts_are_aligned_once(monkeypatch):
    from types import SimpleNamespace

    seen, whole = [], K.diff_profiles
    monkeypatch.setattr(K, "diff_profiles", lambda a, b: seen.append(len(a)) or whole(a, b))
    held = [(SimpleNamespace(seq="ACGT"), np.array([0, 1, 2])), (SimpleNamespace(seq="ACGT"), np.array([1, 2]))]
    got = [(at.tolist(), als["n_diff"].tolist(), [x.tolist() for x in als["d"]]) for _, at, als in chimera._align(held, ["ACGT", "ACCT", "ACCT"], False)]
    assert got == [([0, 1, 2], [0, 1, 1], [[0, 0, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1]]), ([1, 2], [1, 1], [[0, 0, 1, 1], [0, 0, 1, 1]])]
    assert seen == [2]


@pytest.mark.parametrize("full", [False, True])
def test_denoising_by_values_is_that_of_all_rows(spark, full):
    from flowspark.operators import cluster, pairs

    seqs = spark.range(40).selectExpr("id % 2 as block", "id div 2 as ord", "concat('s', id) as seq_id", "1.0D + id % 4 as weight", "repeat(substr('ACGT', cast(1 + id % 3 as int), 1), 6) as seq")
    found, rows = pairs.sequences_by_value(seqs, None, "block", full), pairs.sequence_distances(seqs, None, "block", full)
    merges = cluster.linkage(pairs.mean_of_both(found, "block") if full else found, "block")
    got, want = (em.sequence_denoise(seqs, x, cluster.cut_at(merges, "block", 0.08), "block").orderBy("block", "cluster").collect() for x in (found, rows))
    assert got == want and sum(len(r["members"]) for r in got) == 40


def test_a_step_takes_the_cells_that_count():
    """Items far from all clusters but their own, and some far from every cluster that is left (reckoned whole), against
    all cells."""
    r = np.random.default_rng(3)
    for case in range(20):
        n = 40
        cost = r.random((n, n)) * 9 + 3
        groups = np.arange(n) // 4
        near = groups[:, None] == groups[None, :]
        cost[near] = (r.random((n, n)) * (0.05 if case % 2 else 0.4))[near]
        costs = em.Costs.of(cost, 60.0)
        assert len(costs.item) <= 4 * n
        weight = np.where(r.random(n) < 0.3, r.random(n) * 5, 0.0)
        weight[0], weight[4:8] = 1.0, 0.0
        item, candidate, part, logs, faint = costs.shares(weight)
        got = np.zeros((n, n))
        got[item, candidate] = part
        live = np.flatnonzero(weight)
        d = cost[:, live]
        low = d.min(axis=1, keepdims=True)
        want = np.zeros((n, n))
        want[:, live] = weight[live] * np.exp(-60.0 * (d - low))
        total = want.sum(axis=1)
        assert len(faint) and np.allclose(got, want / total[:, None], atol=1e-12) and np.allclose(logs, np.log(total) - 60.0 * low[:, 0])


def test_flow_distances_of_a_tile_are_those_of_pairs():
    r = np.random.default_rng(4)
    a, b = ([r.integers(0, 1200, r.integers(0, 75)) for _ in range(m)] for m in (45, 37))
    want = K.flow_dist([x for x in a for _ in b], [y for _ in a for y in b]).reshape(45, 37)
    assert (K.flow_dist_table(a, b) == want).all() and K.flow_dist_table([], b).shape == (0, 37)


@pytest.mark.parametrize("copies", [1, 3])
def test_linkage_by_tiles_is_that_of_all_rows(spark, copies):
    """Some tiles a block, sent as pieces of the matrix."""
    from pyspark.sql import functions as F

    from flowspark.operators import cluster, pairs

    items = spark.range(60).select((F.col("id") % 2).alias("block"), F.expr("id div 2").alias("ord"), F.expr(f"cast(id div {2 * copies} * 7 % 31 as string)").alias("v"))
    table = lambda a, b: np.array([[abs(int(x) - int(y)) * 1.25 for y in b] for x in a])
    tiles = pairs.by_tile(items, "v", table, "block", 8)
    assert tiles.tiles.count() == (20 if copies == 1 else 6)
    rows = pairs.all_pairs(items, "v", lambda a, b: np.array([table([x], [y])[0, 0] for x, y in zip(a, b, strict=True)]), "block")
    one, other = (cluster.linkage(x, "block").orderBy("block", "step").collect() for x in (tiles, rows))
    assert one == other and len(one) == 58


@pytest.mark.parametrize("unseen", [None, 10.0])
def test_only_cells_that_may_count_are_reckoned_exactly(unseen):
    numbers = np.random.default_rng(3)
    flows = [np.clip(np.abs(numbers.normal(0, 150, 64)), 0, 2000).astype(int) for _ in range(300)]
    lengths = numbers.integers(0, 17, 300) * 4
    shapes, _, firsts = em.patterns(flows)
    seen, table, cells = lengths[firsts], K.default_lookup(), []

    def exact(reads, at):
        cells.append(len(reads) * len(at))
        return em.pattern_costs([flows[i] for i in reads], lengths[reads], shapes[at], table, unseen, seen[at])

    want = em.Costs.near([exact(np.arange(300), np.arange(len(shapes)))], 60.0, exact)
    cells.clear()
    got = em.near_costs(flows, lengths, shapes, table, 60.0, exact, unseen, seen)
    for name in ("item", "candidate", "chance", "least"):
        assert np.array_equal(getattr(want, name), getattr(got, name)), name
    assert sum(cells) < 0.5 * 300 * len(shapes)


def test_few_large_groups_are_dealt_to_many_tasks(spark):
    rows = stage.dealt(spark.range(10), "id")
    assert rows.rdd.getNumPartitions() == min(96, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
