"""SQL (DuckDB) of operators that go step by step: alignments, linkage and its trees, the greedy collapse. Each is written
cell by cell, merge by merge or row by row, with recursion, and shares nothing with the operators."""

from __future__ import annotations


def alignment(rows: str, gap: float, homopolymer: float | None = None, cost: str = "CASE WHEN x = y THEN 0.0 ELSE 1.0 END", free_left: bool = True, ordered: bool = False) -> str:
    """CTEs up to al(block, i, j, n, m, score, a, b): the alignment of each pair of rows (block, ord, seq) of a block, i
    behind j (all ordered pairs with ordered). a and b are the aligned texts: - for a gap, . for one behind the other's
    end. Both sequences must have letters. A diagonal of cells is a step; each cell carries its texts, so nothing is
    traced back."""
    fee = f"{gap}" if homopolymer is None else f"CASE WHEN y = l.h THEN {homopolymer} ELSE {gap} END"
    free = f"CASE WHEN c = n THEN 0.0 ELSE {fee} END" if free_left else fee
    return f"""
pair AS (SELECT block, a.ord AS i, b.ord AS j, a.seq AS p, b.seq AS q, len(a.seq) AS n, len(b.seq) AS m FROM {rows} a JOIN {rows} b USING (block) WHERE {'a.ord <> b.ord' if ordered else 'b.ord < a.ord'} AND a.seq <> '' AND b.seq <> ''),
text AS (SELECT DISTINCT p, q, n, m FROM pair),
cell AS (SELECT p, q, n, m, 0 AS k, 0 AS c, 0.0::DOUBLE AS s, '' AS h, '' AS a, '' AS b, NULL::STRUCT(s DOUBLE, a VARCHAR, b VARCHAR) AS d FROM text
  UNION ALL
  SELECT p, q, n, m, k, c,
    CASE WHEN u IS NULL OR l IS NULL THEN k * {gap}::DOUBLE WHEN diag < least(lft, up) THEN diag ELSE least(lft, up) END,
    CASE WHEN u IS NULL THEN '' WHEN l IS NULL THEN x WHEN diag < least(lft, up) THEN CASE WHEN x = y THEN x ELSE '' END WHEN lft <= diag AND lft < up THEN y ELSE x END,
    CASE WHEN u IS NULL THEN l.a || '-' WHEN l IS NULL THEN u.a || x WHEN diag < least(lft, up) THEN u.d.a || x WHEN lft <= diag AND lft < up THEN l.a || CASE WHEN c = n THEN '.' ELSE '-' END ELSE u.a || x END,
    CASE WHEN u IS NULL THEN l.b || y WHEN l IS NULL THEN u.b || '-' WHEN diag < least(lft, up) THEN u.d.b || y WHEN lft <= diag AND lft < up THEN l.b || y ELSE u.b || CASE WHEN k - c = m THEN '.' ELSE '-' END END,
    CASE WHEN l IS NOT NULL THEN {{'s': l.s, 'a': l.a, 'b': l.b}} END
  FROM (SELECT *, u.d.s + {cost} AS diag, l.s + {free} AS lft, u.s + CASE WHEN k - c = m THEN 0.0 ELSE {fee} END AS up
    FROM (SELECT *, substr(p, c, 1) AS x, substr(q, k - c, 1) AS y
      FROM (SELECT p, q, n, m, k + 1 AS k, c + dx AS c, any_value({{'s': s, 'h': h, 'a': a, 'b': b}}) FILTER (dx = 0) AS l, any_value({{'s': s, 'a': a, 'b': b, 'd': d}}) FILTER (dx = 1) AS u
        FROM cell, (VALUES (0), (1)) t(dx) WHERE c + dx <= n AND k + 1 - c - dx <= m GROUP BY p, q, n, m, k, c + dx)))),
al AS (SELECT block, i, j, pair.n, pair.m, cell.s AS score, cell.a, cell.b FROM pair JOIN cell USING (p, q) WHERE cell.k = pair.n + pair.m AND cell.c = pair.n)"""


#: Columns between the later first and the earlier last letter: runs of gaps count once, N agrees with all.
IDENTITY = """
w AS (SELECT block, i, j, a, b, greatest(len(a) - len(ltrim(a, '-.')), len(b) - len(ltrim(b, '-.'))) AS lo, least(len(rtrim(a, '-.')), len(rtrim(b, '-.'))) AS hi FROM al),
v AS (SELECT block, i, j, lo, hi, substr(a, lo + 1, hi - lo) AS a, substr(b, lo + 1, hi - lo) AS b FROM w),
t AS (SELECT block, i, j, lo, hi, len(regexp_extract_all(a, '[-.]+')) + len(regexp_extract_all(b, '[-.]+')) AS gaps,
  list_transform(range(1, len(a) + 1), lambda k: substr(a, k, 1) || substr(b, k, 1)) AS cols FROM v),
z AS (SELECT block, i, j, lo, hi, gaps, list_filter(cols, lambda x: NOT regexp_matches(x, '[-.]')) AS cols FROM t)
SELECT block, i, j, round(CASE WHEN hi > lo AND gaps + len(cols) > 0 THEN (gaps + len(list_filter(cols, lambda x: substr(x, 1, 1) <> substr(x, 2, 1) AND NOT contains(x, 'N'))))::DOUBLE / (gaps + len(cols)) ELSE 1.0 END, 9) AS d FROM z"""

#: The score by columns, those at the right end that run over one sequence's end left out (over the second's, one-sided).
SCORE = "SELECT block, i, j, round(score / greatest(len(a) - greatest(len(a) - len(rtrim(a, '.')), len(b) - len(rtrim(b, '.'))), 1), 9) AS d FROM al"
SCORE_ONE_SIDED = "SELECT block, i, j, round(score / greatest(len(a) - (len(b) - len(rtrim(b, '.'))), 1), 9) AS d FROM al"

#: Differences up to each letter of the first sequence from the left, and from the right end on.
DIFFS = """
t AS (SELECT block, i, j, list_transform(range(1, len(a) + 1), lambda k: substr(a, k, 1)) AS a, list_transform(range(1, len(a) + 1), lambda k: substr(b, k, 1)) AS b FROM al),
u AS (SELECT block, i, j, list_transform(a, lambda x, k: x NOT IN ('-', '.')) AS base, list_transform(a, lambda x, k: CASE WHEN x = '-' OR (x <> '.' AND b[k] <> '.' AND x <> b[k]) THEN 1 ELSE 0 END) AS l,
  list_transform(a, lambda x, k: CASE WHEN x = '-' OR (x <> '.' AND x <> b[k]) THEN 1 ELSE 0 END) AS r FROM t),
v AS (SELECT block, i, j, list_sum(l) AS n_diff, list_filter(list_transform(l, lambda x, k: CASE WHEN base[k] THEN list_sum(l[1:k]) END), lambda x: x IS NOT NULL) AS d,
  list_reverse(list_filter(list_transform(r, lambda x, k: CASE WHEN base[k] THEN list_sum(r[k:]) END), lambda x: x IS NOT NULL)) AS r FROM u)
SELECT block, i, j, n_diff::INT AS n_diff, array_to_string(d, ',') AS d, array_to_string(r, ',') AS r FROM v"""


#: From rows tags and al of all ordered pairs: best hit, best two and three parents of each sequence that has two
#: candidates of at least its frequency. Of equal parents the most frequent, then the first.
PARENTS_OF = (
    DIFFS.replace("SELECT block, i, j, n_diff::INT AS n_diff, array_to_string(d, ',') AS d, array_to_string(r, ',') AS r FROM v", "").rstrip()
    + """,
cand AS (SELECT v.block, v.i, v.j, v.n_diff, v.d, v.r, b.freq, len(a.seq) AS n FROM v JOIN tags a ON a.ord = v.i JOIN tags b ON b.ord = v.j WHERE b.freq >= a.freq AND len(a.seq) > 1),
ok AS (SELECT * FROM cand WHERE i IN (SELECT i FROM cand GROUP BY i HAVING count(*) > 1)),
pos AS (SELECT block, i, j, freq, n, d, k, d[k + 1] AS dk, r[k + 1] AS rk FROM ok, unnest(range(0, n)) t(k)),
best AS (SELECT block, i, k, any_value(n) AS n, min(dk) AS dk, arg_min(j, (dk, -freq, j)) AS dj, min(rk) AS rk, arg_min(j, (rk, -freq, j)) AS rj FROM pos GROUP BY block, i, k),
two AS (SELECT a.block, a.i, min(a.dk + b.rk) AS best_chimera, arg_min(a.dj, (a.dk + b.rk, a.k)) AS p1, arg_min(b.rj, (a.dk + b.rk, a.k)) AS p2 FROM best a JOIN best b ON a.i = b.i AND b.k = a.n - 2 - a.k GROUP BY a.block, a.i),
mid AS (SELECT i, k, x, any_value(n) AS n, min(d[x + 1] - dk) AS m FROM pos, unnest(range(k, n - 1)) t(x) WHERE k < n - 1 GROUP BY i, k, x),
three AS (SELECT mid.i, min(m + a.dk + b.rk) AS t FROM mid JOIN best a ON a.i = mid.i AND a.k = mid.k JOIN best b ON b.i = mid.i AND b.k = mid.n - 2 - mid.x GROUP BY mid.i),
hit AS (SELECT i, min(n_diff) AS best, arg_min(j, (n_diff, j)) AS ref, count(*) AS refs FROM ok GROUP BY i)
SELECT two.block, two.i, best::INT AS best, ref, best_chimera::INT AS best_chimera, p1, p2, CASE WHEN best_chimera >= 3 AND refs >= 3 THEN t ELSE -1 END::INT AS best_trimera, CASE WHEN best_chimera >= 3 AND refs >= 3 AND best_chimera - t >= 3 THEN 'Trimera' ELSE 'Chimera' END AS class FROM two JOIN hit USING (i) JOIN three USING (i)"""
)


def costs(table) -> str:
    """x and y by a 4 x 4 table over ACTG, others as A."""
    base = lambda v: f"CASE {v} WHEN 'C' THEN 1 WHEN 'T' THEN 2 WHEN 'G' THEN 3 ELSE 0 END"
    return f"({[float(v) for row in table for v in row]}::DOUBLE[])[1 + 4 * ({base('x')}) + {base('y')}]"


def linkage(distances: str, method: str = "complete", weights: str | None = None) -> str:
    """CTEs up to merge(block, step, lft, rgt, dist) from distances(block, i, j, d) with j < i from 0 on, in single
    precision. A step is a merge in each block: the least distance, of equals the first row and column; what is merged
    takes the smaller slot, the last slot fills the other."""
    size = f"JOIN {weights} p ON p.block = q.block AND p.ord = i JOIN {weights} r ON r.block = q.block AND r.ord = j" if weights else ""
    si, sj = ("p.weight::FLOAT", "r.weight::FLOAT") if weights else ("1::FLOAT", "1::FLOAT")
    gone, kept = "any_value(d) FILTER (o = 1)", "any_value(d) FILTER (o = 0)"
    new = f"greatest({gone}, {kept})" if method == "complete" else f"({gone} * any_value(sh) + {kept} * any_value(st)) / (any_value(sh) + any_value(st))"
    low = """(SELECT *, first_value(i) OVER w AS h, first_value(j) OVER w AS t, max(i) OVER (PARTITION BY block) AS z, first_value(si) OVER w AS sh, first_value(sj) OVER w AS st
      FROM mat WINDOW w AS (PARTITION BY block ORDER BY d, i, j)) low"""
    return f"""
mat AS (SELECT q.block, 0 AS step, i::BIGINT AS i, j::BIGINT AS j, d::FLOAT AS d, i::BIGINT AS ni, j::BIGINT AS nj, {si} AS si, {sj} AS sj FROM {distances} q {size}
  UNION ALL
  SELECT block, step, greatest(e, f), least(e, f), d, CASE WHEN e > f THEN ne ELSE nf END, CASE WHEN e > f THEN nf ELSE ne END, CASE WHEN e > f THEN se ELSE sf END, CASE WHEN e > f THEN sf ELSE se END
  FROM (
    SELECT block, step + 1 AS step, CASE WHEN y = z THEN h ELSE y END AS e, t AS f,
      CASE WHEN count(*) = 1 THEN any_value(d) ELSE {new} END AS d, any_value(ny) AS ne, -step - 1 AS nf, any_value(sy) AS se, any_value(sh + st) AS sf
    FROM (SELECT block, step, h, t, z, d, CASE WHEN i IN (h, t) THEN j ELSE i END AS y, CASE WHEN i IN (h, t) THEN nj ELSE ni END AS ny, CASE WHEN i IN (h, t) THEN sj ELSE si END AS sy, CASE WHEN h IN (i, j) THEN 1 ELSE 0 END AS o, sh, st
      FROM {low} WHERE (h IN (i, j)) <> (t IN (i, j))) GROUP BY block, step, h, t, z, y
    UNION ALL
    SELECT block, step + 1, CASE WHEN i = z THEN h ELSE i END, CASE WHEN j = z THEN h ELSE j END, d, ni, nj, si, sj FROM {low} WHERE h NOT IN (i, j) AND t NOT IN (i, j))),
merge AS (SELECT block, step::INT AS step, arg_min(ni, (d, i, j)) AS lft, arg_min(nj, (d, i, j)) AS rgt, arg_min(d, (d, i, j)) AS dist FROM mat GROUP BY block, step)"""


#: From merge: node(block, k, members, slot, leaves, height, tree) for each merge k: its members by slot (what is taken up
#: comes behind), from left to right, its height and its tree. A block's nodes so far travel as lists.
NODES = """,
walk AS (SELECT block, -1 AS k, []::BIGINT[][] AS ms, []::BIGINT[][] AS ls, []::DOUBLE[] AS hs, []::VARCHAR[] AS ts FROM (SELECT DISTINCT block FROM merge)
  UNION ALL
  SELECT block, step, list_append(ms, CASE WHEN list_min(am) < list_min(bm) THEN list_concat(am, bm) ELSE list_concat(bm, am) END), list_append(ls, list_concat(al, bl)), list_append(hs, h),
    list_append(ts, '(' || ta || ':' || printf('%.3f', h - ha) || ',' || tb || ':' || printf('%.3f', h - hb) || ')')
  FROM (SELECT w.*, m.step, m.dist::DOUBLE AS h, CASE WHEN lft >= 0 THEN [lft] ELSE ms[-lft] END AS am, CASE WHEN rgt >= 0 THEN [rgt] ELSE ms[-rgt] END AS bm, CASE WHEN lft >= 0 THEN [lft] ELSE ls[-lft] END AS al, CASE WHEN rgt >= 0 THEN [rgt] ELSE ls[-rgt] END AS bl,
      CASE WHEN lft >= 0 THEN 0.0 ELSE hs[-lft] END AS ha, CASE WHEN rgt >= 0 THEN 0.0 ELSE hs[-rgt] END AS hb, CASE WHEN lft >= 0 THEN lft::VARCHAR ELSE ts[-lft] END AS ta, CASE WHEN rgt >= 0 THEN rgt::VARCHAR ELSE ts[-rgt] END AS tb
    FROM walk w JOIN merge m ON m.block = w.block AND m.step = w.k + 1)),
node AS (SELECT block, k, ms[k + 1] AS members, ls[k + 1] AS leaves, hs[k + 1] AS height, ts[k + 1] AS tree FROM walk WHERE k >= 0)"""

#: The parent of each node and leaf (null for the root), by the names that merges use.
PARENTS = """,
named AS (SELECT block, -k - 1 AS name, members, leaves, height FROM node UNION ALL SELECT DISTINCT block, x, [x], [x], 0.0 FROM (SELECT block, lft AS x FROM merge WHERE lft >= 0 UNION ALL SELECT block, rgt FROM merge WHERE rgt >= 0)),
parent AS (SELECT block, lft AS name, -step - 1 AS up, step FROM merge UNION ALL SELECT block, rgt, -step - 1, step FROM merge)"""


def clusters_below(level: str) -> str:
    """From node and merge: found(block, level, cluster, members) of levels(block, level, cutoff): the nodes of the merges
    before the first of cutoff and more that are under no other such merge."""
    return f""",
levels AS ({level}),
upto AS (SELECT l.block, l.level, l.cutoff, COALESCE(min(m.step) FILTER (m.dist::DOUBLE >= l.cutoff), max(m.step) + 1) AS stop FROM levels l JOIN merge m USING (block) GROUP BY ALL),
top AS (SELECT u.block, u.level, u.cutoff, n.members FROM upto u JOIN named n USING (block) LEFT JOIN parent p ON p.block = n.block AND p.name = n.name WHERE (n.name >= 0 OR -n.name - 1 < u.stop) AND (p.step IS NULL OR p.step >= u.stop)),
found AS (SELECT block, level, cutoff, row_number() OVER (PARTITION BY block, level ORDER BY list_min(members)) - 1 AS cluster, members FROM top)"""


def even_splits(most: int, least: int) -> str:
    """From node and merge: split(block, split, pos, member): subtrees of at most `most` leaves whose parent has more."""
    return f""",
sub AS (SELECT n.block, n.leaves FROM named n LEFT JOIN parent p ON p.block = n.block AND p.name = n.name LEFT JOIN named u ON u.block = p.block AND u.name = p.up WHERE len(n.leaves) <= {most} AND (u.name IS NULL OR len(u.leaves) > {most})),
ranked AS (SELECT *, len(leaves) >= {least} AS large, row_number() OVER (PARTITION BY block ORDER BY len(leaves) DESC, list_min(leaves)) - 1 AS r FROM sub),
counted AS (SELECT block, count(*) FILTER (large) AS n FROM ranked GROUP BY block),
pooled AS (SELECT block, printf('C%03d', r::INT) AS split, leaves FROM ranked WHERE large UNION ALL SELECT block, printf('C%03d+', any_value(n)::INT), flatten(list(leaves ORDER BY r)) FROM ranked JOIN counted USING (block) WHERE NOT large GROUP BY block),
split AS (SELECT block, split, generate_subscripts(leaves, 1) - 1 AS pos, unnest(leaves) AS member FROM pooled)"""


def greedy(rows: str) -> str:
    """The collapse of prefixes, row after row over all rows (ord, seq_id, seq): CTEs up to done(ord, seq_id, rep_ord,
    rep_id)."""
    return f"""
o AS (SELECT row_number() OVER (ORDER BY ord) AS k, ord, seq_id, COALESCE(seq, '') AS seq FROM {rows}),
turn AS (SELECT 0::BIGINT AS i, k AS p, k AS gone FROM o
  UNION ALL
  SELECT i + 1, p, CASE WHEN NOT there THEN gone WHEN p = i + 1 THEN COALESCE(nxt, gone) WHEN p > i + 1 AND gone = p AND (nxt IS NULL OR p < nxt) AND len(seq) < len(mine) AND starts_with(mine, seq) THEN i + 1 ELSE gone END
  FROM (SELECT t.i, t.p, t.gone, o.seq, c.seq AS mine, bool_or(t.p = t.i + 1 AND t.gone = t.p) OVER () AS there, min(CASE WHEN t.p > t.i + 1 AND t.gone = t.p AND starts_with(o.seq, c.seq) THEN t.p END) OVER () AS nxt
    FROM turn t JOIN o ON o.k = t.p JOIN o c ON c.k = t.i + 1)),
step AS (SELECT p, gone FROM turn WHERE i = (SELECT count(*) FROM o)),
climb AS (SELECT p, gone AS q FROM step UNION SELECT c.p, s.gone FROM climb c JOIN step s ON s.p = c.q),
ends AS (SELECT c.p, c.q FROM climb c JOIN step s ON s.p = c.q AND s.gone = s.p),
done AS (SELECT a.ord, a.seq_id, r.ord AS rep_ord, r.seq_id AS rep_id FROM ends JOIN o a ON a.k = ends.p JOIN o r ON r.k = ends.q)"""
