import gzip
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skeinlab.functions import sequence as S
from skeinlab.operators import curvature, distance, graph, kmers, metrics, mixtures, qc, spectral
from skeinlab.plans import pipelines
from skeinlab.sources import fastq, sinks, tables
from skeinlab.streaming import kmers as stream


def edges_of(spark, pairs):
    return spark.createDataFrame([(min(a, b), max(a, b), float(d)) for a, b, d in pairs], "u string, v string, d double")


def dist_of(spark, points):
    rows = [(a, b, math.dist(points[a], points[b])) for a in points for b in points if a < b]
    return spark.createDataFrame(rows, "a string, b string, d double"), spark.createDataFrame([(p,) for p in points], "sample string")


def probs_of(spark, table):
    return spark.createDataFrame([(s, b, float(p)) for s, bins in table.items() for b, p in bins.items()], "sample string, bin int, p double")


def test_forman_on_triangle_path_and_star(spark):
    k3 = edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1)])
    assert {r.forman_F for r in graph.forman(k3).collect()} == {3}
    path = edges_of(spark, [("a", "b", 1), ("b", "c", 1)])
    assert {r.forman_F for r in graph.forman(path).collect()} == {1}
    star = edges_of(spark, [("h", x, 1) for x in "abcd"])
    assert {r.forman_F for r in graph.forman(star).collect()} == {-1}


def test_topology_of_triangle(spark, monkeypatch):
    d, samples = dist_of(spark, {"a": (0, 0), "b": (1, 0), "c": (0.5, 0.8)})
    last = graph.topology_counts(d, samples, 3).orderBy("step").collect()
    assert last[0].V == 3 and last[-1].components == 1
    step = spark.createDataFrame([(0, "a", "b"), (0, "b", "c"), (0, "a", "c"), (1, "a", "b"), (1, "b", "c")], "step int, u string, v string")
    sides = edges_of(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("a", "c", 3.0), ("c", "d", 2.0), ("a", "d", 5.0), ("b", "d", 4.0)])
    for bound in (50_000, 0):
        monkeypatch.setattr(graph, "IN_ONE_TASK", bound)
        counts = {(r["size"], r.birth): r.n for r in graph.cliques(sides).collect()}
        assert counts == {(2, 1.0): 1, (2, 2.0): 2, (2, 3.0): 1, (2, 4.0): 1, (2, 5.0): 1, (3, 3.0): 1, (3, 4.0): 1, (3, 5.0): 2, (4, 5.0): 1}
    entropy = {r.step: r.vn_entropy for r in spectral.von_neumann_entropy(step, "step").collect()}
    assert entropy[1] == pytest.approx(0.562335, abs=1e-6)
    with pytest.raises(ValueError):
        graph.cliques(sides, most=2)


def test_spanning_forest_and_components_in_a_task_and_in_rounds(spark, monkeypatch):
    rng = random.Random(8)
    rows = list({(f"n{a:02d}", f"n{b:02d}"): float(rng.randint(1, 9)) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(55)) if a != b}.items())
    rows = [(u, v, w) for (u, v), w in rows]
    parent = {x: x for u, v, _ in rows for x in (u, v)}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    weight, joins = 0.0, 0
    for u, v, w in sorted(rows, key=lambda r: r[2]):
        if find(u) != find(v):
            a, b = sorted((find(u), find(v)))
            parent[b], weight, joins = a, weight + w, joins + 1
    table = spark.createDataFrame(rows, "u string, v string, w double")
    for most in (50_000, 0):
        monkeypatch.setattr(graph, "IN_ONE_TASK", most)
        assert graph.spanning_forest(table).agg(S.F.count(S.F.lit(1)), S.F.sum("w")).first()[:] == (joins, weight)
        assert {r.node: r.label for r in graph.components(table).collect()} == {x: find(x) for x in parent}


def test_components_paths_closeness_betweenness(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(9)]
    pairs = [(a, b, rng.randint(1, 4)) for a, b in itertools.combinations(names, 2) if rng.random() < 0.33]
    samples = spark.createDataFrame([(n,) for n in names], "sample string")
    e = edges_of(spark, pairs)
    d = {(a, b): 0.0 if a == b else math.inf for a in names for b in names}
    for a, b, w in pairs:
        d[a, b] = d[b, a] = min(d[a, b], w)
    for k, i, j in itertools.product(names, repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    paths = graph.cut(graph.shortest_paths(e, samples))
    assert {(r.u, r.v): r.d for r in paths.collect()} == {k: v for k, v in d.items() if v < math.inf}
    labels = {r.node: r.label for r in graph.components(e).collect()}
    assert all((labels[a] == labels[b]) == (d[a, b] < math.inf) for a in labels for b in labels)
    # all shortest paths by enumeration
    adj = {n: {} for n in names}
    for a, b, w in pairs:
        adj[a][b] = adj[b][a] = w

    def walks(a, b):
        if a == b:
            return [[b]]
        return [[a, *rest] for x, w in adj[a].items() if abs(w + d[x, b] - d[a, b]) < 1e-9 for rest in walks(x, b)]

    between = Counter()
    for a, b in itertools.combinations(names, 2):
        if d[a, b] < math.inf:
            found = walks(a, b)
            for w in found:
                for x in w[1:-1]:
                    between[x] += 1 / len(found)
    got = {r.sample: r.betweenness for r in graph.betweenness(e, paths).collect()}
    assert all(got[n] == pytest.approx(between[n] * 2 / (8 * 7), abs=1e-9) for n in names)
    close = {r.sample: r.closeness for r in graph.closeness(paths).collect()}
    for n in names:
        reach = [v for (a, b), v in d.items() if a == n and b != n and v < math.inf]
        assert close[n] == pytest.approx(len(reach) / sum(reach) * len(reach) / 8 if reach else 0.0)


def test_connected_knn_takes_the_least_k(spark):
    d, _ = dist_of(spark, {"a": (0, 0), "b": (0, 1), "c": (0, 2.1), "x": (9, 0), "y": (9, 1), "z": (9, 2.1)})
    edges, k = graph.connected_knn_graph(d, 1)
    assert k == 3 and graph.components(edges).select("label").distinct().count() == 1


@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_transport_meets_its_dual(m, n, seed):
    rng = np.random.default_rng(seed)
    mu, nu, cost = rng.dirichlet(np.ones(m)), rng.dirichlet(np.ones(n)), rng.random((m, n))
    flow, u, v = curvature.transport(mu, nu, cost)
    got = float((flow * cost).sum())
    assert flow.sum(axis=1) == pytest.approx(mu) and flow.sum(axis=0) == pytest.approx(nu)
    assert (v[None, :] - u[:, None] <= cost + 1e-12).all() and nu @ v - mu @ u == pytest.approx(got, abs=1e-9)
    if m == 1 or n == 1:
        assert got == pytest.approx(float((np.outer(mu, nu) * cost).sum()), abs=1e-9)
    # on the line the distance is the area between the distribution functions
    x = np.sort(rng.random(m + n))
    a, b = np.concatenate([mu, np.zeros(n)]), np.concatenate([np.zeros(m), nu])
    line = float((np.abs(np.cumsum(a - b))[:-1] * np.diff(x)).sum())
    cost = np.abs(x[:, None] - x[None, :])
    assert float((curvature.transport(a, b, cost)[0] * cost).sum()) == pytest.approx(line, abs=1e-9)


def test_a_plan_that_is_not_the_cheapest_is_not_proven(spark):
    plans = curvature.transport_plans(edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)]), graph.shortest_paths(e := edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("c", "d", 1)]), spark.createDataFrame([(x,) for x in "abcd"], "sample string")), 0.25)
    assert all(r.balanced and r.bounded and r.optimal for r in curvature.proven(plans).collect()) and e.count() == 3
    worse = plans.withColumn("flow", S.F.col("mx") * S.F.col("my"))  # every place sends to all: balanced, but dear
    assert any(r.balanced and r.bounded and not r.optimal for r in curvature.proven(worse).collect())
    assert not any(r.balanced for r in curvature.proven(plans.withColumn("flow", S.F.col("flow") / 2)).collect())


def test_pools_that_share_nothing_and_individuals_without_bins(spark):
    probs = probs_of(spark, {"i1": {0: 0.5, 1: 0.5}, "i2": {2: 1.0}, "p1": {0: 0.25, 1: 0.25, 2: 0.5}, "p2": {9: 1.0}})
    names = lambda *x: spark.createDataFrame([(s,) for s in x], "sample string")
    pools, individuals = names("p1", "p2", "p3"), names("i1", "i2", "i3")
    got = {(r.pool_sample, r.sample): (round(r.weight, 9), round(r.residual_norm, 9)) for r in spectral.deconvolve(probs, pools, individuals).collect()}
    assert got == {
        ("p1", "i1"): (0.5, 0.0), ("p1", "i2"): (0.5, 0.0), ("p1", "i3"): (0.0, 0.0),
        **{("p2", i): (0.0, 1.0) for i in ("i1", "i2", "i3")}, **{("p3", i): (0.0, 0.0) for i in ("i1", "i2", "i3")},
    }
    raw = spectral.raw_weights(probs, pools, individuals)
    assert all(r.optimal for r in spectral.optimal_weights(raw, probs, pools, individuals).collect())
    off = raw.withColumn("raw", S.F.col("raw") + 0.1)
    assert not all(r.optimal for r in spectral.optimal_weights(off, probs, pools, individuals).collect())


def test_curvature_signs(spark):
    samples = spark.createDataFrame([(x,) for x in "abcdef"], "sample string")
    bridge = edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1)])
    orc = {(r.u, r.v): r.orc for r in curvature.ollivier_ricci(bridge, graph.shortest_paths(bridge, samples)).collect()}
    assert orc["c", "d"] < 0 < orc["a", "b"]


def test_distances_against_dense_and_bounds(spark):
    rng = np.random.default_rng(1)
    table = {f"s{i}": {j: 0 for j in range(0)} for i in range(6)}
    for s in list(table)[:-1]:
        bins = rng.choice(40, 12, replace=False)
        table[s] = dict(zip(bins.tolist(), rng.dirichlet(np.ones(12)).tolist(), strict=True))
    table["far"] = {99: 1.0}
    probs = probs_of(spark, table)
    samples = spark.createDataFrame([(s,) for s in table], "sample string")
    dense = {s: np.array([table[s].get(j, 0.0) for j in range(100)]) for s in table}

    def eps_in_log(p, q, e=1e-12):
        m = (p + q) / 2
        kl = lambda a: float((a[a > 0] * np.log((a[a > 0] + e) / (m[a > 0] + e))).sum())
        return math.sqrt(max(0.5 * kl(p) + 0.5 * kl(q), 0))

    def clip(p, q):
        p, q = (np.clip(x, 1e-12, 1) / np.clip(x, 1e-12, 1).sum() for x in (p, q))
        m = (p + q) / 2
        return math.sqrt(max(0.5 * float((p * np.log(p / m)).sum() + (q * np.log(q / m)).sum()), 0))

    got = {(r.a, r.b): r.d for r in distance.js_log_eps(probs, samples).collect()}
    assert len(got) == 21 and all(v == pytest.approx(eps_in_log(dense[a], dense[b]), abs=1e-9) for (a, b), v in got.items())
    assert got["far", "s5"] == pytest.approx(0.588705, abs=1e-6) and got["far", "s0"] == pytest.approx(math.sqrt(math.log(2)), abs=1e-6)
    got = {(r.a, r.b): r.d for r in distance.js_clip(probs, samples, 100).collect()}
    assert all(v == pytest.approx(clip(dense[a], dense[b]), abs=1e-7) for (a, b), v in got.items())
    got = {(r.a, r.b): r.cos for r in distance.cosine(probs, samples).collect()}
    assert got["s0", "s1"] == pytest.approx(float(dense["s0"] @ dense["s1"] / np.linalg.norm(dense["s0"]) / np.linalg.norm(dense["s1"])))


def test_pcoa_gives_back_euclidean_distances_and_pca_equals_svd(spark):
    rng = np.random.default_rng(5)
    d, samples = dist_of(spark, {f"p{i}": tuple(rng.random(2)) for i in range(7)})
    rows = {(r.sample, r.axis): r.value for r in spectral.pcoa(d, samples).collect()}
    for r in d.collect():
        assert math.hypot(rows[r.a, 1] - rows[r.b, 1], rows[r.a, 2] - rows[r.b, 2]) == pytest.approx(r.d, abs=1e-9)
    x = rng.random((6, 5))
    x[:, 4] = 0.25
    probs = probs_of(spark, {f"s{i}": dict(enumerate(x[i])) for i in range(6)})
    z = (x - x.mean(0))[:, :4] / x.std(0)[:4]
    u, s, _ = np.linalg.svd(z, full_matrices=False)
    got = spectral.pca(probs, probs).toPandas().pivot(index="sample", columns="axis", values="value").sort_index().to_numpy()
    assert np.abs(got) == pytest.approx(np.abs(u[:, :2] * s[:2]), abs=1e-8)


def test_trees_groups_and_communities(spark, monkeypatch):
    d, samples = dist_of(spark, {"a": (0, 0), "b": (0, 1), "x": (9, 0), "y": (9, 1.5)})
    merges = spectral.upgma(d, samples).orderBy("step").collect()
    assert merges[0].members_left == ["a"] and merges[0].members_right == ["b"] and merges[1].height == pytest.approx(1.5)
    assert {r.sample: r.auto_group for r in spectral.cut_tree(d, samples, 2).collect()} == {"a": "G1", "b": "G1", "x": "G2", "y": "G2"}
    rng = random.Random(4)
    far, many = dist_of(spark, {f"s{i:02d}": (rng.random(), rng.random()) for i in range(10)})
    far = far.repartition(2).cache()
    tree = lambda: [(r.step, r.members_left, r.members_right, round(r.height, 9)) for r in spectral.upgma(far, many).orderBy("step").collect()]
    one, groups, order = tree(), spectral.cut_tree(far, many, 4).collect(), spectral.leaf_order(far, many).collect()
    monkeypatch.setattr(graph, "IN_ONE_TASK", 0)  # in rounds
    assert tree() == one and sorted(spectral.cut_tree(far, many, 4).collect()) == sorted(groups) and len({r.auto_group for r in groups}) == 4
    assert sorted(spectral.leaf_order(far, many).collect()) == sorted(order)
    monkeypatch.undo()
    three = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 9.0), ("b", "c", 10.0)], "a string, b string, d double")
    tree = spectral.neighbour_joining(three, spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")).first()[0]
    assert "a:2.000000,b:3.000000" in tree
    two = edges_of(spark, [("a", "b", 1), ("b", "c", 1), ("a", "c", 1), ("c", "d", 1), ("d", "e", 1), ("e", "f", 1), ("d", "f", 1)])
    groups = {r.sample: r.community for r in spectral.communities(two).collect()}
    assert groups["a"] == groups["b"] == groups["c"] != groups["d"] == groups["e"] == groups["f"]


@given(st.integers(0, 10**6))
@settings(max_examples=40, deadline=None)
def test_nnls_meets_its_conditions(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.random((12, 4)), rng.normal(size=12)
    w = spectral.nnls(a.T @ a, a.T @ b)
    slope = a.T @ (a @ w - b)
    assert (w >= 0).all() and (slope >= -1e-8).all() and abs(slope @ w) < 1e-8


def test_deconvolution_finds_the_weights(spark):
    probs = probs_of(spark, {"a": {0: 0.5, 1: 0.5}, "b": {2: 1.0}, "pool": {0: 0.15, 1: 0.15, 2: 0.7}})
    names = lambda *x: spark.createDataFrame([(n,) for n in x], "sample string")
    got = {r.sample: (r.weight, r.residual_norm) for r in spectral.deconvolve(probs, names("pool"), names("a", "b")).collect()}
    assert got["a"][0] == pytest.approx(0.3) and got["b"] == (pytest.approx(0.7), pytest.approx(0.0, abs=1e-7))


def test_diffusion_maps(spark):
    e = edges_of(spark, [("a", "b", 1), ("b", "c", 2), ("c", "d", 1), ("a", "d", 3)])
    coords, values = spectral.diffusion_map(e)
    assert values.orderBy("axis").first().eigenvalue == pytest.approx(1.0) and coords.count() == 12
    with pytest.raises(Exception, match="length 0"):
        spectral.diffusion_map(edges_of(spark, [("a", "b", 0), ("b", "c", 0), ("c", "d", 0)]))[0].collect()


def scored(spark, rows):
    return spark.createDataFrame([(f"s{i:02d}", y, float(s)) for i, (y, s) in enumerate(rows)], "sample string, y int, score double")


def test_metrics_by_hand(spark):
    rows = [(1, 9), (0, 8), (1, 8), (0, 3), (0, 1)]
    df = scored(spark, rows)
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows if y for z, b in rows if not z]
    assert metrics.roc_auc(df).first()[0] == pytest.approx(sum(pairs) / len(pairs))
    assert metrics.roc_auc(scored(spark, [(y, -s) for y, s in rows])).first()[0] == pytest.approx(1 - sum(pairs) / len(pairs))
    assert metrics.average_precision(df).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert metrics.best_f1(df).first().threshold == 8.0
    labels = scored(spark, [(1, 20), (1, 19), (0, 18), (1, 1)] + [(0, 2 + i / 100) for i in range(14)])
    one = metrics.evaluate(labels).first()
    assert (one.n_used, one.tp, one.fp, one.fn) == (18, 2, 1, 1) and one.p_fisher_enrichment == pytest.approx(0.0563725, abs=1e-6)
    assert metrics.evaluate(scored(spark, [(1, 1), (1, 2)])).first().roc_auc is None
    assert metrics.evaluate(scored(spark, []).limit(0)).first().n_used == 0
    points = metrics.roc_points(scored(spark, [(1, 3), (1, 2), (0, 1)]), drop_intermediate=True)
    assert points.count() == 3


def test_correlations_and_p_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0), (5.0, 4.0), (None, 1.0)], "x double, y double")
    r = metrics.correlations(df, "x", "y").first()
    assert r.n == 5 and r.pearson_r == pytest.approx(0.8) and r.spearman_rho == pytest.approx(0.8)
    assert r.pearson_p == pytest.approx(0.10409, abs=1e-4)


def test_labels_priority(spark):
    info = spark.createDataFrame([("r1", "x Pool-GBS"), ("r1", "individual gbs"), ("r2", "individual GBS"), ("r3", None), ("r4", "GBS of a pool")], "Run string, Title string")
    assert {r.sample: r.ground_truth for r in metrics.pool_labels(info).collect()} == {"r1": "pool", "r2": "individual", "r3": "unknown", "r4": "pool"}


def test_zscores_flat_columns(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 2.0)], "sample string, x double")
    assert {r.x_z for r in metrics.zscores(df, ["x"]).collect()} == {r.x_z for r in metrics.zscores(df, ["x"], "zero").collect()} == {0.0}


def reads_of(spark, rows):
    return spark.createDataFrame([("s", 1, i, s, q) for i, (s, q) in enumerate(rows)], "sample string, mate int, read_idx bigint, seq string, qual string")


def test_qc_edge_cases(spark):
    one = qc.qc_reads(reads_of(spark, [("ACGN", "II!")])).first()
    assert (one.reads_used, one.sd_len, one.gc_frac, one.n_frac) == (1, 0.0, 0.5, 0.25)
    assert one.mean_phred == pytest.approx((40 + 40 + 0) / 3)
    assert spark.range(1).select(S.phred(S.F.lit(" !I")).alias("q")).first().q == [255, 0, 40]
    assert qc.length_stats(reads_of(spark, [("A", "I"), ("AC", "II"), ("ACG", "III"), ("ACGT", "IIII")])).first().median_len == 3
    trims = spark.createDataFrame([("A" * 30,)], "s string").select(S.trimmed(S.F.col("s"), 0, 35, True).alias("w"), S.trimmed(S.F.col("s"), 0, 35).alias("n"), S.tail(S.F.col("s"), 0).alias("t")).first()
    assert (len(trims.w), len(trims.n), len(trims.t)) == (25, 0, 30)


def test_kmer_rules(spark):
    df = reads_of(spark, [("ACGTN", "IIIII"), ("ACG", "III"), ("AC", "II"), ("ACRT", "IIII")])
    kept = Counter()
    for s in ("ACGTN", "ACG", "AC", "ACRT"):
        for i in range(len(s) - 2):
            if "N" not in s[i : i + 3]:
                kept[zlib.crc32(s[i : i + 3].encode()) % 64] += 1
    assert {r.bin: r.n for r in kmers.crc_counts(df, 3, 64, 1).collect()} == dict(kept)
    whole = kmers.crc_counts(df, 3, 64, 1, "read", ("sample",)).agg({"n": "sum"}).first()[0]
    assert whole == 3
    assert kmers.hashed_counts(df, 3, 64).agg({"n": "sum"}).first()[0] == 3


def mix64(x):
    m = (1 << 64) - 1
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & m
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & m
    return x ^ x >> 33


def test_finaliser_and_unsigned_modulo(spark):
    values = [0, 1, 2, 12345678901, 2**62 - 5, 2**63 - 1]
    df = S.with_fmix64(spark.createDataFrame([(v,) for v in values], "x bigint"), "x", "h").select("x", "h", S.unsigned_mod(S.F.col("h"), 1000).alias("m"), S.unsigned_mod(S.F.col("h"), 1024).alias("p"))
    for r in df.collect():
        h = mix64(r.x)
        assert (r.h % (1 << 64), r.m, r.p) == (h, h % 1000, h % 1024)


def test_mixtures_are_seeded(spark):
    one, two = (mixtures.draw_truth(spark, ["a", "b", "c", "d"], 5, seed=7).collect() for _ in range(2))
    assert one == two and all(abs(sum(r.weights) - 1) < 1e-12 and 2 <= len(set(r.parents)) <= 3 for r in one)


def test_calibration_is_monotone_and_clipped(spark):
    scores = spark.createDataFrame([("m1", 1.0), ("m2", 2.0), ("m3", 3.0), ("p", 9.0), ("q", 0.0)], "sample string, score double")
    truth = spark.createDataFrame([("m1", 0.2), ("m2", 0.6), ("m3", 0.4)], "sample string, entropy_norm double")
    pools = spark.createDataFrame([("p",), ("q",)], "sample string")
    got = {r.sample: r.entropy_calibrated for r in pipelines.calibrate(scores, truth, pools).collect()}
    assert got == {"p": pytest.approx(0.5), "q": pytest.approx(0.2)}


FASTQ = "@r1\nACGT\n+\nIIII\n@r2\n\n+\nII\n@r3\nGGGG\n+\n\n@r4\nTTTT\n+\nIIII\n"


def test_fastq_variants(spark, tmp_path):
    (tmp_path / "s_1.fastq").write_text(FASTQ)
    with gzip.open(tmp_path / "t_1.fastq.gz", "wt") as f:
        f.write(FASTQ)
    for name in ("s_1.fastq", "t_1.fastq.gz"):
        read = lambda variant, n=None: [r.seq for r in fastq.read_fastq(spark, str(tmp_path / name), variant, n).orderBy("read_idx").collect()]
        assert read("preprocess") == ["ACGT", ""]
        assert read("calibrate") == ["ACGT"]
        assert read("qc") == read("matrix") == read("matrix", 0) == ["ACGT", "GGGG", "TTTT"]
        assert read("qc", 2) == ["ACGT", "GGGG"] and read("qc", 0) == ["ACGT"]
        assert read("preprocess", 1) == read("preprocess", 0) == ["ACGT"] and read("preprocess", 9) == ["ACGT", ""]


def test_fastq_in_many_splits(spark, tmp_path):
    rows = [("".join(random.Random(i).choices("ACGT", k=50)), i) for i in range(400)]
    (tmp_path / "big_1.fastq").write_text("".join(f"@r{i}\n{s}\n+\n{'I' * 50}\n" for s, i in rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        got = fastq.read_fastq(spark, str(tmp_path / "big_1.fastq")).orderBy("read_idx").collect()
        first = fastq.read_fastq(spark, str(tmp_path / "big_1.fastq"), "calibrate", 150).orderBy("read_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.seq for r in got] == [s for s, _ in rows]
    assert [r.seq for r in first] == [s for s, _ in rows[:150]]


def read_by_hand(path, variant, most):
    """The records of a file as the four readers of single files give them."""
    key, empty, errors, zero_is_all, any_case = fastq.VARIANTS[variant]
    most = None if most is None or (zero_is_all and most == 0) else most
    name = str(path).lower() if any_case else str(path)
    out = []
    with (gzip.open if name.endswith(".gz") else open)(path, "rt", encoding="utf-8", errors=errors) as f:
        while f.readline():
            seq, _, qual = f.readline().strip(), f.readline(), f.readline().strip()
            if not (seq if key == "seq" else qual):
                if empty == "stop":
                    break
                continue
            out.append((len(out), seq, qual))
            if most is not None and len(out) >= most:
                break
    return out


@pytest.mark.parametrize("seed", (1, 4))
def test_fastq_ranges_against_single_readers(spark, tmp_path, seed):
    rng = random.Random(seed)
    ends = [b"\n", b"\r\n", b"\r"] if seed % 2 else [b"\n"]
    lines = []
    for i in range(rng.randint(1, 400)):
        part = lambda: rng.choice([b"ACGT" * rng.randint(0, 30), b"", b" ", b"\xff\xfeAC", b"\xc2\xa0", "é\u2028".encode()] if rng.random() < 0.03 * seed else [b"ACGTN" * rng.randint(1, 20)])  # noqa: E731, B023
        lines += [b"@r%d" % i, part(), b"+", part()]
    data = b"".join(x + rng.choice(ends) for x in lines[: len(lines) - rng.choice([0, 0, 1, 2, 3])])
    data = data if rng.random() < 0.5 else data.rstrip(b"\r\n")
    for name in ("a_1.fastq", "b_1.fastq.GZ", "c_1.fastq.gz"):
        (tmp_path / name).write_bytes(gzip.compress(data) if name.lower().endswith(".gz") else data)
    for size, limits in (("64", (None,)), ("300", (0, 5))):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            for variant in fastq.VARIANTS:
                for most in limits:
                    got = {}
                    for r in fastq.read_fastq(spark, str(tmp_path), variant, most).collect():
                        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.read_idx, r.seq, r.qual))
                    for name in ("a_1.fastq", "b_1.fastq.GZ", "c_1.fastq.gz"):
                        assert sorted(got.get(name, [])) == read_by_hand(tmp_path / name, variant, most), (name, variant, most, size)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_fastq_plan_and_early_stop(spark, tmp_path, monkeypatch):
    path = tmp_path / "big_1.fastq"
    path.write_bytes(b"".join(b"@r%d\n%s\n+\n%s\n" % (i, b"ACGT" * 25, b"I" * 100) for i in range(60_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000000")
    try:
        reads = fastq.read_fastq(spark, str(path), "qc")
        plan = reads._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "BatchScan" in plan and reads.rdd.getNumPartitions() == 13
        assert reads.select(S.F.count_distinct("read_idx"), S.F.max("read_idx")).first()[:] == (60_000, 59_999)
        assert fastq.read_fastq(spark, str(path), "qc", 100).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")

    class Counting:
        def __init__(self, f):
            self.f, self.n = f, 0

        def read(self, n=-1):
            data = self.f.read(n)
            self.n += len(data)
            return data

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

    file = Counting(open(path, "rb"))
    monkeypatch.setattr(fastq, "opened", lambda p: file)
    assert len(list(fastq.FastqReader([], "qc", 100).records(fastq.Range(str(path))))) == 100
    assert file.n <= fastq.CHUNK < path.stat().st_size


def test_discovery(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "x.txt").write_text("")
        fastq.find_pairs(spark, str(tmp_path))
    for name in ("SRR1_1.fastq", "srr1_2.fastq", "SRR1_2.fastq.gz"):
        (tmp_path / name).write_text(FASTQ)
    pair = fastq.find_pairs(spark, str(tmp_path)).first()
    assert pair.sample == "SRR1" and pair.r2.endswith("SRR1_2.fastq.gz")
    assert {(r.sample, r.mate) for r in fastq.discover_runs(spark, str(tmp_path)).collect()} == {("SRR1", 1), ("SRR1", 2)}
    (tmp_path / "lone_1.fastq").write_text(FASTQ)
    with pytest.raises(FileNotFoundError, match="lone"):
        fastq.find_pairs(spark, str(tmp_path))
    names = spark.createDataFrame([("/d/a.b_1.fastq.gz",), ("c-2.fq",), ("plain.fastq",)], "p string")
    assert [r[0] for r in names.select(fastq.sample_of(S.F.col("p"))).collect()] == ["a.b", "c", "plain"]


def test_tables_and_sinks(spark, tmp_path):
    d, samples = dist_of(spark, {"a": (0, 0), "b": (0, 1), "c": (3, 0)})
    sinks.write_distance_matrix(d, ["a", "b", "c"], str(tmp_path / "d"), sep=",")
    back = tables.distance_matrix(spark, str(tmp_path / "d"))
    assert {(r.a, r.b): r.d for r in back.collect()} == {(r.a, r.b): pytest.approx(r.d, abs=1e-8) for r in d.collect()}
    (tmp_path / "bad.csv").write_text("id,a\nb,1\n")
    with pytest.raises(ValueError):
        tables.distance_matrix(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "pools.txt").write_text("# pools\n\n s1 \ns2\n")
    assert tables.pools_file(spark, str(tmp_path / "pools.txt")) == ["s1", "s2"]
    counts = spark.createDataFrame([("a", 0, 3), ("b", 2, 1)], "sample string, bin int, n bigint")
    sinks.write_npz(counts, str(tmp_path / "m.npz"), 4)
    assert {(r.sample, r.bin, r.n) for r in tables.feature_matrix(spark, str(tmp_path / "m.npz")).collect()} == {("a", "0", 3.0), ("b", "2", 1.0)}
    (tmp_path / "f.tsv").write_text("sample_id\tx\ty\na\t1\t0\n")
    assert [tuple(r) for r in tables.feature_matrix(spark, str(tmp_path / "f.tsv")).collect()] == [("a", "x", 1.0)]
    assert tables.optional(spark, str(tmp_path / "none")) is None
    with pytest.raises(Exception, match="negative"):
        distance.normalised_rows(spark.createDataFrame([("a", 0, -1.0)], "sample string, bin int, n double")).collect()


def test_streamed_counts_equal_batch_counts(spark, tmp_path):
    rows = [("s", 1, i, "".join(random.Random(i).choices("ACGTN", k=60)), "I" * 60) for i in range(40)]
    reads = spark.createDataFrame(rows, "sample string, mate int, read_idx bigint, seq string, qual string")
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, reads.schema).write.mode("append").parquet(str(tmp_path / "in"))
    query = stream.count_stream(stream.read_stream(spark, str(tmp_path / "in"), 1), str(tmp_path / "out"), str(tmp_path / "cp"), 5, 256, 1)
    query.awaitTermination()
    got = {(r.bin, r.n) for r in stream.latest_counts(spark, str(tmp_path / "out")).collect()}
    assert got == {(r.bin, r.n) for r in kmers.crc_counts(reads, 5, 256, 1).collect()}
