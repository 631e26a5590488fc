"""SQL for the dense operators: eigenvectors by repeated squaring, trees and communities by recursion."""

from __future__ import annotations

from skeinlab.plans import views as V

P = "WITH RECURSIVE " + V.PROFILES
D = P + "," + V.JS
G = D + "," + V.KNN
SQUARINGS = 14  # the matrix to the power 2^14 has only its first eigenvector left


def eigenvectors(name: str, matrix: str, axes: int) -> str:
    """CTEs name_1, name_2, ... (sample, x, value): unit eigenvectors of the greatest eigenvalues by size of a symmetric
    matrix (u, v, x), the largest entry (the first of equals) positive. After each its part is taken off."""
    out, now = [], matrix
    for a in range(1, axes + 1):
        m = f"{name}_m{a}"
        out.append(f"{m}_0 AS MATERIALIZED (SELECT u, v, x / (SELECT sqrt(sum(x * x)) FROM {now}) AS x FROM {now})")
        for i in range(SQUARINGS):
            out.append(f"{m}_s{i} AS MATERIALIZED (SELECT p.u, q.v, sum(p.x * q.x) AS x FROM {m}_{i} p JOIN {m}_{i} q ON p.v = q.u GROUP BY ALL)")
            out.append(f"{m}_{i + 1} AS MATERIALIZED (SELECT u, v, x / (SELECT sqrt(sum(x * x)) FROM {m}_s{i}) AS x FROM {m}_s{i})")
        last = f"{m}_{SQUARINGS}"
        out.append(f"{m}_c AS MATERIALIZED (SELECT u AS sample, x FROM {last} WHERE v = (SELECT u FROM {last} WHERE u = v ORDER BY x DESC, u LIMIT 1))")
        out.append(f"""{m}_f AS MATERIALIZED (SELECT sample, x / (SELECT sqrt(sum(x * x)) FROM {m}_c)
          * (SELECT CASE WHEN x < 0 THEN -1 ELSE 1 END FROM {m}_c ORDER BY round(abs(x), 9) DESC, sample LIMIT 1) AS x FROM {m}_c)""")
        out.append(f"{name}_{a} AS MATERIALIZED (SELECT sample, x, (SELECT sum(e.x * p.x * q.x) FROM {now} e JOIN {m}_f p ON p.sample = e.u JOIN {m}_f q ON q.sample = e.v) AS value FROM {m}_f)")
        if a < axes:
            out.append(f"{m}_d AS MATERIALIZED (SELECT e.u, e.v, e.x - p.value * p.x * q.x AS x FROM {now} e JOIN {name}_{a} p ON p.sample = e.u JOIN {name}_{a} q ON q.sample = e.v)")
            now = f"{m}_d"
    return ",\n".join(out)


def scaled(name: str, axes: int) -> str:
    return " UNION ALL ".join(f"SELECT sample, CAST({a} AS INTEGER) AS axis, round(x * sqrt(value) + 0.0, 6) AS value FROM {name}_{a}" for a in range(1, axes + 1))


CENTRED = """,
sq AS (SELECT u, v, d * d AS s FROM both_ways UNION ALL SELECT DISTINCT sample, sample, 0.0 FROM probs),
gram AS MATERIALIZED (SELECT u, v, -0.5 * (s - avg(s) OVER (PARTITION BY u) - avg(s) OVER (PARTITION BY v) + avg(s) OVER ()) AS x FROM sq)"""

STANDARD = """,
grid AS (SELECT s.sample, b.bin, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT sample FROM probs) s CROSS JOIN (SELECT DISTINCT bin FROM probs) b LEFT JOIN probs p ON p.sample = s.sample AND p.bin = b.bin),
std AS (SELECT sample, bin, (p - avg(p) OVER (PARTITION BY bin)) / sd AS z FROM grid JOIN (SELECT bin, stddev_pop(p) AS sd FROM grid GROUP BY bin HAVING var_pop(p) > 1e-24) USING (bin)),
gram AS MATERIALIZED (SELECT p.sample AS u, q.sample AS v, sum(p.z * q.z) AS x FROM std p JOIN std q USING (bin) GROUP BY ALL)"""

# The walk's symmetric form plus the identity, so that the greatest eigenvalues are also the greatest by size.
WALK = """,
sg AS (SELECT CASE WHEN median(d) > 0 THEN median(d) ELSE avg(d) END AS sg FROM edges),
w AS (SELECT u, v, exp(-d * d / (2 * sg * sg)) AS x FROM adj, sg),
root AS (SELECT u, sqrt(sum(x)) AS r FROM w GROUP BY u),
gram AS MATERIALIZED (
  SELECT p.u, q.u AS v, coalesce(w.x / (p.r * q.r), 0) + CASE WHEN p.u = q.u THEN 1 ELSE 0 END AS x FROM root p CROSS JOIN root q LEFT JOIN w ON w.u = p.u AND w.v = q.u)"""

KERNEL = """,
sg AS (SELECT greatest(median(d), 1e-9) AS sg FROM both_ways),
w AS (SELECT u, v, exp(-d * d / (sg * sg)) AS x FROM both_ways, sg UNION ALL SELECT DISTINCT sample, sample, 1.0 FROM probs),
root AS (SELECT u, sqrt(sum(x)) AS r FROM w GROUP BY u),
gram AS MATERIALIZED (SELECT w.u, w.v, w.x / (p.r * q.r) AS x FROM w JOIN root p ON p.u = w.u JOIN root q ON q.u = w.v)"""


def signed(vector: str) -> str:
    """The vector (sample, x) with its largest entry positive."""
    return f"(SELECT sample, x * (SELECT CASE WHEN x < 0 THEN -1 ELSE 1 END FROM ({vector}) ORDER BY round(abs(x), 9) DESC, sample LIMIT 1) AS x FROM ({vector}))"


def left_vectors() -> str:
    parts = []
    for a in (1, 2, 3):
        raw = f"SELECT e.sample, e.x * r.r / (SELECT sqrt(sum(x * x * r * r)) FROM ev_{a + 1} JOIN root ON u = sample) AS x FROM ev_{a + 1} e JOIN root r ON r.u = e.sample"
        parts.append(f"SELECT s.sample, CAST({a} AS INTEGER) AS axis, round(s.x * (SELECT any_value(value) - 1 FROM ev_{a + 1}) + 0.0, 6) AS value FROM {signed(raw)} s")
    return " UNION ALL ".join(parts)


def right_vectors() -> str:
    parts = []
    for a in (1, 2):
        raw = f"SELECT e.sample, e.x / r.r AS x FROM ev_{a + 1} e JOIN root r ON r.u = e.sample"
        parts.append(f"SELECT sample, CAST({a} AS INTEGER) AS axis, round(x + 0.0, 6) AS value FROM {signed(raw)}")
    return " UNION ALL ".join(parts)


# Groups of samples that merge step by step: the two of least mean distance, ties by their first members.
MERGES = """,
tree(step, members, l, r, h, more) AS (
  SELECT 0, [sample], NULL::VARCHAR[], NULL::VARCHAR[], NULL::DOUBLE, true FROM (SELECT DISTINCT sample FROM probs)
  UNION ALL
  SELECT step + 1, unnest(after.members), after.l, after.r, after.h, true FROM (
    SELECT any_value(t.step) AS step, any_value(b.l) AS l, any_value(b.r) AS r, any_value(b.h) AS h,
           list_append(list(t.members) FILTER (WHERE t.members <> b.l AND t.members <> b.r), any_value(b.l || b.r)) AS members
    FROM tree t, (
      SELECT l, r, h FROM (
        SELECT x.members AS l, y.members AS r, avg(w.d) AS h
        FROM tree x JOIN tree y ON x.members[1] < y.members[1]
        JOIN both_ways w ON list_contains(x.members, w.u) AND list_contains(y.members, w.v) GROUP BY ALL)
      ORDER BY round(h, 12), l[1], r[1] LIMIT 1) b
    HAVING count(*) > 1) after)"""

# Neighbour joining, one row a step: the names of the open nodes and their distances as a list of rows.
JOINS = """,
sq AS (SELECT u, v, d FROM both_ways UNION ALL SELECT DISTINCT sample, sample, 0.0 FROM probs),
rows AS (SELECT u, list(d ORDER BY v) AS r FROM sq GROUP BY u),
nj(names, d) AS (
  SELECT list(u ORDER BY u), list(r ORDER BY u) FROM rows
  UNION ALL
  SELECT list_append(list_transform(rest, lambda k: names[k]), printf('(%s:%.6f,%s:%.6f)', names[i], greatest(raw, 0.0), names[j], greatest(d[i][j] - raw, 0.0))),
         list_append(list_transform(rest, lambda a: list_append(list_transform(rest, lambda b: d[a][b]), 0.5 * (d[i][a] + d[j][a] - d[i][j]))),
                     list_append(list_transform(rest, lambda a: 0.5 * (d[i][a] + d[j][a] - d[i][j])), 0.0))
  FROM (
    SELECT names, d, i, j, 0.5 * d[i][j] + (total[i] - total[j]) / (2 * (n - 2)) AS raw, list_filter(range(1, n + 1), lambda k: k <> i AND k <> j) AS rest
    FROM (SELECT names, d, n, total, best.i AS i, best.j AS j FROM (
      SELECT *, list_min(flatten(list_transform(range(1, n), lambda a: list_transform(range(a + 1, n + 1), lambda b:
        {'q': round((n - 2) * d[a][b] - total[a] - total[b], 12), 'i': a, 'j': b})))) AS best
      FROM (SELECT names, d, len(names) AS n, list_transform(d, lambda r: list_sum(r)) AS total FROM nj WHERE len(names) > 2)))))"""
NEWICK = " SELECT printf('(%s:%.6f,%s:%.6f);', names[1], greatest(d[1][2] / 2, 0.0), names[2], greatest(d[1][2] / 2, 0.0)) AS newick FROM nj WHERE len(names) = 2"

GAINS = """,
ge AS MATERIALIZED (SELECT u, v FROM sedges UNION ALL SELECT v, u FROM sedges),
tot AS (SELECT sum(k) AS m, map_from_entries(list((u, [k]))) AS deg FROM (SELECT u, count(*) AS k FROM ge GROUP BY u)),
com(step, members) AS (
  SELECT 0, [u] FROM (SELECT DISTINCT u FROM ge)
  UNION ALL
  SELECT step + 1, unnest(members) FROM (
    SELECT any_value(t.step) AS step, list_append(list(t.members) FILTER (WHERE t.members <> b.l AND t.members <> b.r), any_value(list_sort(b.l || b.r))) AS members
    FROM com t, (
      SELECT l, r, 2 * (c / m - list_sum(list_transform(l, lambda s: deg[s][1])) / m * list_sum(list_transform(r, lambda s: deg[s][1])) / m) AS gain FROM (
        SELECT x.members AS l, y.members AS r, count(*) AS c
        FROM com x JOIN com y ON x.members[1] < y.members[1] JOIN ge ON list_contains(x.members, ge.u) AND list_contains(y.members, ge.v) GROUP BY ALL), tot
      WHERE gain > 1e-12 ORDER BY round(gain, 12) DESC, l[1], r[1] LIMIT 1) b
    HAVING count(*) > 1))"""

CONNECTED = """,
near1 AS MATERIALIZED (SELECT u, v, d, row_number() OVER (PARTITION BY u ORDER BY d, v) AS r FROM both_ways),
steps AS (SELECT DISTINCT r AS k FROM near1),
ke AS MATERIALIZED (SELECT DISTINCT k, least(u, v) AS u, greatest(u, v) AS v, d FROM near1 JOIN steps ON r <= k),
reach(k, v) AS (SELECT k, (SELECT min(sample) FROM probs) FROM steps UNION SELECT r.k, CASE WHEN e.u = r.v THEN e.v ELSE e.u END FROM reach r JOIN ke e ON e.k = r.k AND (e.u = r.v OR e.v = r.v)),
good AS (SELECT min(k) AS k FROM (SELECT k FROM reach GROUP BY k HAVING count(*) = (SELECT count(DISTINCT sample) FROM probs)))"""


def oracles(similar: str) -> dict[str, str]:
    """similar: CTEs up to sedges, the edges of the similarity network."""
    last = "(SELECT max(step) FROM tree)"
    return {
        "pcoa": D + CENTRED + ",\n" + eigenvectors("ev", "gram", 2) + " " + scaled("ev", 2),
        "pca": P + STANDARD + ",\n" + eigenvectors("ev", "gram", 2) + " " + scaled("ev", 2),
        "diffusion_map": G + WALK + ",\n" + eigenvectors("ev", "gram", 4) + " " + left_vectors(),
        "diffusion_spectrum": G + WALK + ",\n" + eigenvectors("ev", "gram", 4) + " " + " UNION ALL ".join(f"SELECT CAST({a} AS INTEGER) AS axis, round(any_value(value) - 1, 6) AS eigenvalue FROM ev_{a + 1}" for a in range(4)),
        "dense_diffusion": D + KERNEL + ",\n" + eigenvectors("ev", "gram", 3) + " " + right_vectors(),
        "upgma": D + MERGES + " SELECT DISTINCT step, array_to_string(l, ',') AS members_left, array_to_string(r, ',') AS members_right, round(h, 6) AS height FROM tree WHERE step > 0",
        "leaf_order": D + MERGES + f" SELECT unnest(members) AS sample, CAST(unnest(range(len(members))) AS INTEGER) AS place FROM tree WHERE step = {last}",
        "tree_groups": D + MERGES + f" SELECT unnest(members) AS sample, 'G' || place AS auto_group FROM (SELECT members, row_number() OVER (ORDER BY list_min(members)) AS place FROM tree WHERE step = {last} - 4)",
        "neighbour_joining": D + JOINS + NEWICK,
        "communities": similar + GAINS + " SELECT unnest(members) AS sample, CAST(place AS INTEGER) AS community FROM (SELECT members, row_number() OVER (ORDER BY len(members) DESC, members[1]) AS place FROM com WHERE step = (SELECT max(step) FROM com))",
        "connected_knn": D + CONNECTED + " SELECT u, v, round(min(d), 6) AS d FROM ke WHERE k = (SELECT k FROM good) GROUP BY u, v",
    }
