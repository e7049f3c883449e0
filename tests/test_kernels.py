"""Kernels against plain versions and worked cases."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowspark.functions import kernels as K

dna = st.text("ACGT", min_size=1, max_size=12)


def plain_score(a, b, cost, gap, homopolymer=None):
    """The same dynamic programme, cell by cell, with the step taken to each cell."""
    n, m = len(a), len(b)
    f = [[0.0] * (m + 1) for _ in range(n + 1)]
    last = [[None] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        f[i][0], last[i][0] = gap * i, a[i - 1] if i else None
    for j in range(m + 1):
        f[0][j], last[0][j] = gap * j, b[j - 1] if j else None
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            fee = gap if homopolymer is None else homopolymer if b[j - 1] == last[i][j - 1] else gap
            diag = f[i - 1][j - 1] + cost(a[i - 1], b[j - 1])
            left = f[i][j - 1] + (0 if i == n else fee)
            up = f[i - 1][j] + (0 if j == m else fee)
            f[i][j] = min(diag, left, up)
            if diag < left and diag < up:
                last[i][j] = a[i - 1] if a[i - 1] == b[j - 1] else None
            else:
                last[i][j] = b[j - 1] if left <= diag and left < up else a[i - 1]
    return f[n][m]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(dna, dna), min_size=1, max_size=6))
def test_scores_equal_the_plain_programme(pairs):
    a, b = map(list, zip(*pairs, strict=True))
    got = K.align(a, b, None, K.GAP).score
    assert np.allclose(got, [plain_score(x, y, lambda p, q: float(p != q), K.GAP) for x, y in pairs])
    table = K.default_costs()
    cost = lambda p, q: table[K.BASES.index(p), K.BASES.index(q)]
    got = K.align(a, b, K.substitution_cost(table), K.SEQUENCE_GAP, K.HOMOPOLYMER_GAP).score
    assert np.allclose(got, [plain_score(x, y, cost, K.SEQUENCE_GAP, K.HOMOPOLYMER_GAP) for x, y in pairs])


def test_identity_distance_cases():
    got = K.nw_identity(["ACGT", "ACGT", "ACGTACGTACGT", "ACNT", "A"], ["ACGT", "ACCT", "ACGTCGTACGT", "ACGT", ""])
    assert got.tolist() == [0.0, 0.25, pytest.approx(1 / 12), 0.0, 1.0]


@settings(max_examples=40, deadline=None)
@given(dna)
def test_a_sequence_is_no_distance_from_itself(s):
    assert K.nw_identity([s], [s])[0] == 0 and K.nw_homopolymer([s], [s])[0] == 0 and K.nw_diff([s], [s])[0]["n_diff"] == 0


def test_differences_from_both_sides():
    got = K.nw_diff(["ACGTACGT"], ["ACGTTCGT"])[0]
    assert got["d"] == [0, 0, 0, 0, 1, 1, 1, 1] and got["r"] == [0, 0, 0, 1, 1, 1, 1, 1] and got["n_diff"] == 1


def plain_linkage(d, method, weights=None):
    n = len(d)
    d, name, size, out = d.astype(np.float32).copy(), list(range(n)), [np.float32(1)] * n if weights is None else list(weights), []
    for k in range(n - 1):
        m = n - k
        _, i, j = min((d[i, j], i, j) for i in range(m) for j in range(i))
        out.append((name[i], name[j], float(d[i, j])))
        row = np.maximum(d[i], d[j]) if method == "complete" else (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        size[j] += size[i]
        d[j], d[:, j] = row, row
        name[j] = -k - 1
        d[i], d[:, i] = d[m - 1], d[:, m - 1]
        name[i], size[i] = name[m - 1], size[m - 1]
    return out


@pytest.mark.parametrize("method", ["complete", "average"])
@pytest.mark.parametrize("digits", [1, 6])
def test_linkage_equals_the_plain_one(method, digits):
    r = np.random.default_rng(3)
    for n in range(2, 12):
        d = np.round(r.random((n, n)), digits)
        d = np.maximum(d, d.T)
        merges, heights = K.linkage(d, method)
        assert [(a, b, float(h)) for (a, b), h in zip(merges.tolist(), heights, strict=True)] == plain_linkage(d, method)
        if method == "complete":
            assert (np.diff(heights) >= 0).all()


def test_weighted_linkage_equals_the_plain_one():
    r = np.random.default_rng(5)
    for n in range(2, 10):
        d, w = r.random((n, n)), r.integers(1, 9, n).astype(np.float32)
        d = np.maximum(d, d.T)
        merges, heights = K.linkage(d, "average", w)
        assert [(a, b, float(h)) for (a, b), h in zip(merges.tolist(), heights, strict=True)] == plain_linkage(d, "average", w)


def test_cuts_and_trees():
    d = np.array([[0, 0.1, 0.5, 0.6], [0.1, 0, 0.5, 0.6], [0.5, 0.5, 0, 0.2], [0.6, 0.6, 0.2, 0]])
    merges, heights = K.linkage(d)
    assert K.cut(merges, heights, 4, 0.15) == [[0, 1], [2], [3]]
    assert K.cut(merges, heights, 4, 0.3) == [[0, 1], [2, 3]]
    assert [len(c) for _, c in K.cut_levels(merges, heights, 4, 0.1)][:4] == [4, 4, 3, 2]
    tree = K.newick(merges, heights, list("abcd"))
    assert "(b:0.100,a:0.100):0.500" in tree and "(c:0.200,d:0.200):0.400" in tree


def test_flow_distance():
    single, pair = K.flow_tables()
    a, b = np.array([100, 0, 210]), np.array([105, 3, 90, 400])
    want = np.mean([pair[x, y] - single[x] - single[y] for x, y in zip(a, b)])
    assert K.flow_dist([a, a], [b, a]).tolist() == pytest.approx([want, np.mean([pair[x, x] - 2 * single[x] for x in a])])
    assert K.flow_dist([np.array([], int)], [a])[0] == 0


def test_binomial_tail():
    want = sum(math.comb(6, i) * 0.3**i * 0.7 ** (6 - i) for i in range(2, 7))
    assert K.binomial_tail(6, 2, 0.3) == pytest.approx(-math.log(want)) and K.binomial_tail(4, 0, 0.5) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("ACGT", max_size=12), st.text("ACGT", max_size=12)), min_size=1, max_size=8))
def test_profiles_are_those_of_the_alignments(pairs):
    a, b = map(list, zip(*pairs, strict=True))
    got, want = K.diff_profiles(a, b), K.nw_diff(a, b)
    assert got["n_diff"].tolist() == [w["n_diff"] for w in want]
    for name in ("d", "r"):
        assert [x.tolist() for x in got[name]] == [w[name] for w in want]
