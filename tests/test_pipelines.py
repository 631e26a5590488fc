import math
import random

import pytest

from skeinlab.functions import sequence as S
from skeinlab.plans import pipelines


def points(spark, n=7, seed=2):
    rng = random.Random(seed)
    at = {f"s{i}": (rng.random(), rng.random()) for i in range(n)}
    rows = [(a, b, math.dist(at[a], at[b])) for a in at for b in at if a < b]
    return spark.createDataFrame(rows, "a string, b string, d double"), spark.createDataFrame([(s,) for s in at], "sample string")


def test_geometry_to_final_check(spark):
    dist, samples = points(spark)
    out = pipelines.geometry(dist, samples, k=2, thresholds=3)
    ranking = out["mixture_ranking"].orderBy("rank").collect()
    assert [r["rank"] for r in ranking] == list(range(1, 8))
    assert all(r.mixture_score == pytest.approx(r.betweenness_z + r.mean_edge_length_z - r.orc_scalar_z) for r in ranking)
    assert all(abs(sum(r[f"{c}_z"] for r in ranking)) < 1e-6 for c in ("betweenness", "mean_edge_length", "orc_scalar"))
    curve = out["topology_curve"].orderBy("step").collect()
    assert len(curve) == 3 and all(r.beta1_graph == r.E - r.V + r.components for r in curve)
    edges = out["edge_metrics"].collect()
    assert len(edges) == out["edge_metrics"].select("u", "v").distinct().count() and all(r.orc_kappa <= 1 for r in edges)
    final = pipelines.final_check(out["mixture_ranking"], [f" {ranking[0].sample.upper()} "])
    assert final["top_three"].first().hits == 1 and final["top_ten"].filter("is_true_pool").count() == 1
    checked = pipelines.metadata_check(out["node_metrics"].select("sample", "mixture_score"), pools=[ranking[0].sample])
    one = checked["metrics_mixture_score"].first()
    assert (one.tp, one.roc_auc, one.precision) == (1, 1.0, 1.0)


def test_preprocess_tables(spark):
    rng = random.Random(5)
    rows = [(f"s{i}", m, j, "".join(rng.choices("ACGTN" if i % 2 else "AACGT", k=40)), "I" * 40) for i in range(6) for m in (1, 2) for j in range(8)]
    reads = spark.createDataFrame(rows, "sample string, mate int, read_idx bigint, seq string, qual string")
    manifest = spark.createDataFrame([(f"s{i}", "", "", 10, 10, 20 if i < 2 else 20000 + i) for i in range(6)], "sample string, r1 string, r2 string, r1_bytes bigint, r2_bytes bigint, total_bytes bigint")
    out = pipelines.preprocess(reads, manifest, k=5, dim=64, step=1, n_groups=2)
    assert {r.sample for r in out["qc_sampled"].filter("depth_group = 'LoDepth'").collect()} == {"s0", "s1"}
    assert out["kmer_js_distance"].count() == 15 and out["heatmap_order"].count() == 6
    weights = out["pool_weights_individual"].groupBy("pool_sample").agg(S.F.sum("weight").alias("w")).collect()
    assert {r.pool_sample for r in weights} == {"s0", "s1"} and all(r.w == pytest.approx(1) for r in weights)
    assert {r.auto_group for r in out["auto_cultivar_groups"].collect()} == {"G1", "G2"}
    assert out["network_metrics"].first().edges >= 1


def test_validation_finds_mixtures(spark):
    rng = random.Random(9)
    rows = []
    for i in range(6):
        bins = rng.sample(range(60), 20)
        rows += [(f"s{i}", b, 1 / 20) for b in bins]
    probs = spark.createDataFrame(rows, "sample string, bin int, p double")
    out = pipelines.validate(probs, probs, ["s5"], dim=60, n_synth=6, knn=2, seed=1)
    nodes = {r.sample: r.label for r in out["node_scores"].collect()}
    assert sorted(nodes.values()) == ["individual"] * 5 + ["real_pool"] + ["synthetic_pool"] * 6
    summary = out["metrics_summary"].first()
    assert (summary.n_individual, summary.n_synthetic, summary.n_real_pools) == (5, 6, 1) and 0 <= summary.roc_auc <= 1
    assert [r.sample for r in out["calibrated_pools"].collect()] == ["s5"]


def test_sweep_runs_each_cell_once(spark):
    rng = random.Random(4)
    probs = spark.createDataFrame([(f"s{i}", b, 1 / 20) for i in range(5) for b in rng.sample(range(60), 20)], "sample string, bin int, p double")
    asked = []

    def sketch(reads, k):
        asked.append((reads, k))
        return probs

    settings = dict(reads=(10, 20), ks=(5,), base_reads=20, base_k=5, n_boot=1, dim=60, n_synth=4, knn=2)
    first = pipelines.sweep(sketch, probs, [], **settings)["run_metrics_raw"]
    key = lambda df: sorted((r.kind, r.value, r.reads_per_sample, r.kmer, r.run_seed, r.roc_auc, r.f1) for r in df.collect())
    rows = key(first)
    assert asked == [(10, 5), (20, 5)] and [r[:5] for r in rows] == [("k", 5, 20, 5, 1123), ("reads", 10, 10, 5, 123), ("reads", 20, 20, 5, 123)]
    again = pipelines.sweep(sketch, probs, [], done=first.filter("value <> 10"), parallel=1, **settings)
    assert asked[2:] == [(10, 5)] and key(again["run_metrics_raw"]) == rows
    assert again["summary_reads"].count() == 2 and again["summary_k"].first().n_runs == 1
