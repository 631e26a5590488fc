"""The end-to-end analyses: preprocess, geometry, validate, sweep, metadata_check, final_check.

Each takes DataFrames and returns a dictionary of named result tables; skeinlab.sources.sinks writes them."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window, functions as F

from skeinlab.operators import curvature, distance, graph, kmers, metrics, mixtures, qc, spectral

CELL = "kind string, value int, reads_per_sample int, kmer int, run_seed int"  # what names a cell of a sweep
CELL_NAMES = [t.split()[0] for t in CELL.split(", ")]


def preprocess(reads: DataFrame, manifest: DataFrame, k: int = 21, dim: int = 16384, step: int = 4, n_groups: int = 5) -> dict[str, DataFrame]:
    """QC, histograms of both mates, distances, layouts, groups and deconvolution of the LoDepth samples."""
    samples = manifest.select("sample")
    groups = qc.depth_groups(manifest)
    probs = graph.cut(kmers.mates_combined(kmers.crc_counts(reads, k, dim, step)))
    dist = graph.cut(distance.js_log_eps(probs, samples))
    positions = qc.qc_positions(reads)
    entropy = kmers.entropy(probs).join(groups, "sample")
    network = graph.similarity_edges(dist)
    members = spectral.communities(network)
    deep = groups.filter("depth_group = 'HiDepth'").select("sample")
    inside = dist.join(deep.select(F.col("sample").alias("a")), "a", "left_semi").join(deep.select(F.col("sample").alias("b")), "b", "left_semi").select("a", "b", "d")
    auto = spectral.cut_tree(inside, deep, n_groups)
    weights = spectral.deconvolve(probs, groups.filter("depth_group = 'LoDepth'"), deep)
    return {
        "file_manifest": manifest,
        "qc_sampled": qc.both_mates(qc.qc_reads(reads)).join(groups, "sample"),
        "quality_profile": qc.group_profile(positions, groups),
        "kmer_js_distance": dist,
        "entropy": entropy,
        "qc_with_entropy": qc.both_mates(qc.qc_reads(reads)).join(entropy, "sample", "left"),
        "heatmap_order": spectral.leaf_order(dist, samples),
        "embedding_pca": spectral.pca(probs, samples).groupBy("sample").pivot("axis", [1, 2]).agg(F.first("value")).toDF("sample", "PC1", "PC2").join(groups, "sample"),
        "network_edges": network,
        "network_metrics": network.agg(F.count(F.lit(1)).alias("edges"), F.max("threshold").alias("threshold")).join(members.agg(F.count_distinct("community").alias("communities")), F.lit(True)),
        "communities": members,
        "auto_cultivar_groups": auto,
        "pool_weights_individual": weights,
        "pool_weights_group": spectral.group_weights(weights, auto),
    }


def geometry(dist: DataFrame, samples: DataFrame, k: int = 4, alpha: float = 0.0, thresholds: int = 21) -> dict[str, DataFrame]:
    """Connected nearest-neighbour graph, curvatures, centralities, diffusion map, topology curve, ranking. With
    thresholds=0 there is no topology curve, whose cliques are most of the work."""
    edges, used = graph.connected_knn_graph(dist, k)
    edges = graph.cut(edges)
    paths = graph.cut(graph.shortest_paths(edges, samples))
    orc = graph.cut(curvature.ollivier_ricci(edges, paths, alpha))
    flat = graph.forman(edges)
    nodes = samples.select("sample").distinct().join(graph.degrees(edges), "sample", "left").fillna(0, ["degree"])
    for table in (
        graph.betweenness(edges, paths),
        graph.closeness(paths),
        graph.node_means(edges, samples, "d", "mean_edge_length"),
        graph.node_means(orc, samples, "orc", "orc_scalar"),
        graph.node_means(flat, samples, "forman_F", "forman_scalar"),
    ):
        nodes = nodes.join(table, "sample", "left")
    nodes = metrics.zscores(graph.cut(nodes), ["betweenness", "mean_edge_length", "orc_scalar"])
    nodes = nodes.withColumn("mixture_score", F.col("betweenness_z") + F.col("mean_edge_length_z") - F.col("orc_scalar_z"))
    coords, spectrum = spectral.diffusion_map(edges)
    return {
        "node_metrics": nodes,
        "edge_metrics": orc.select("u", "v", F.col("d").alias("distance"), F.col("orc").alias("orc_kappa")).join(flat, ["u", "v"]),
        "mixture_ranking": nodes.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mixture_score"), "sample"))),
        "diffusion_coords": coords,
        "diffusion_eigs": spectrum,
        "run": nodes.sparkSession.createDataFrame([(k, used)], "k_asked int, k_used int"),
        **({"topology_curve": topology_curve(dist, samples, thresholds)} if thresholds else {}),
    }


def topology_curve(dist: DataFrame, samples: DataFrame, thresholds: int = 21) -> DataFrame:
    """Counts, Euler characteristic and von Neumann entropy of the graphs of pairs within each threshold."""
    cuts = graph.cut(graph.thresholds(dist, thresholds))
    entropy = spectral.von_neumann_entropy(graph.threshold_edges(dist, cuts), "step")
    return graph.topology_counts(dist, samples, thresholds).join(entropy, "step", "left").fillna(0.0, ["vn_entropy"])


def calibrate(scored: DataFrame, truth: DataFrame, pools: DataFrame) -> DataFrame:
    """sample, score, expected entropy of the real pools, by isotonic regression of the synthetics' entropy on
    their score; beyond the fitted scores the ends hold."""
    features = VectorAssembler(inputCols=["score"], outputCol="features")
    known = features.transform(scored.join(truth.select("sample", F.col("entropy_norm").alias("label")), "sample"))
    model = IsotonicRegression(isotonic=True).fit(known.select("features", "label"))
    return model.transform(features.transform(scored.join(pools.select("sample"), "sample", "left_semi"))).select("sample", "score", F.col("prediction").alias("entropy_calibrated"))


def validate(probs: DataFrame, samples: DataFrame, pools: list[str], dim: int = 16384, n_synth: int = 40, max_parents: int = 3, min_minor: float = 0.10, knn: int = 4, alpha: float = 0.5, seed: int = 42) -> dict[str, DataFrame]:
    """Mixtures of the pure samples among them and the real pools: graph, curvature, scores, and how well the
    scores find the mixtures. Calibration needs a pool."""
    spark = probs.sparkSession
    pure = samples.select("sample").distinct().filter(~F.col("sample").isin(pools) if pools else F.lit(True))
    truth = mixtures.draw_truth(spark, [r[0] for r in pure.orderBy("sample").collect()], n_synth, max_parents, min_minor, seed)
    made = mixtures.mixed(truth, probs)
    real = samples.select("sample").distinct().filter(F.col("sample").isin(pools) if pools else F.lit(False))
    labels = pure.withColumn("label", F.lit("individual")).unionByName(truth.select(F.col("name").alias("sample"), F.lit("synthetic_pool").alias("label"))).unionByName(real.withColumn("label", F.lit("real_pool")))
    everything = graph.cut(probs.join(pure.unionByName(real), "sample", "left_semi").unionByName(made))
    dist = graph.cut(distance.js_clip(everything, labels, dim))
    edges = graph.cut(graph.with_affinity(graph.knn_graph(dist, knn)))
    metric = distance.both_ways(dist).unionByName(labels.select(F.col("sample").alias("u"), F.col("sample").alias("v"), F.lit(0.0).alias("d")))
    orc = graph.cut(curvature.ollivier_ricci(edges, metric, 1.0 - min(max(alpha, 0.0), 1.0)))
    between = graph.betweenness(edges, graph.shortest_paths(edges, labels))
    nodes = graph.cut(labels.join(between, "sample", "left").join(graph.negative_incidence(orc, labels), "sample", "left"))
    nodes = metrics.zscores(nodes, ["betweenness", "neg_orc_incidence"], flat="zero")
    nodes = graph.cut(nodes.select("sample", "label", "betweenness", "neg_orc_incidence", (F.col("betweenness_z") + F.col("neg_orc_incidence_z")).alias("mixture_score_ot")))
    table = mixtures.truth_table(truth)
    judged = nodes.filter("label <> 'real_pool'").select("sample", (F.col("label") == "synthetic_pool").cast("int").alias("y"), F.col("mixture_score_ot").alias("score"))
    count = lambda x: F.count_if(F.col("label") == x)
    summary = nodes.agg(count("individual").alias("n_individual"), count("synthetic_pool").alias("n_synthetic"), count("real_pool").alias("n_real_pools"))
    for one in (metrics.roc_auc(judged), metrics.average_precision(judged), metrics.best_f1(judged).toDF("best_threshold", "best_f1")):
        summary = summary.join(one, F.lit(True))
    settings = dict(sketch=dim, knn=knn, orc_alpha=alpha, seed=seed)
    against = nodes.join(table, "sample")
    out = {
        "js_distance": dist,
        "node_scores": nodes,
        "synthetic_truth": table,
        "edge_curvature": edges.join(orc.select("u", "v", "orc"), ["u", "v"]),
        "score_vs_truth": against,
        "correlations": metrics.correlations(against, "entropy_norm", "mixture_score_ot"),
        "metrics_summary": summary.withColumns({k: F.lit(v) for k, v in settings.items()}),
        "roc_points": metrics.roc_points(judged),
        "pr_points": metrics.pr_points(judged),
        "embedding": spectral.dense_diffusion(dist, labels),
        "top_subgraph": graph.induced(edges, nodes.orderBy(F.desc("mixture_score_ot"), "sample").limit(12)),
    }
    if pools:
        out["calibrated_pools"] = calibrate(nodes.select("sample", F.col("mixture_score_ot").alias("score")), table, real)
    return out


def sweep(sketch: Callable[[int, int], DataFrame], samples: DataFrame, pools: list[str], reads: Iterable[int] = (3000, 6000, 12000), ks: Iterable[int] = (15, 17, 19, 21), base_reads: int = 6000, base_k: int = 17, n_boot: int = 5, base_seed: int = 123, done: DataFrame | None = None, parallel: int = 4, **settings) -> dict[str, DataFrame]:
    """validate() over read depths and over k, n_boot seeds each. sketch(reads, k) gives the histograms; it is
    called once for each setting, as only the mixtures depend on the seed.

    `parallel` cells run at a time, so that the small stages of one fill the gaps of another. done: the
    run_metrics_raw of an earlier sweep with the same settings; its cells are taken over, not run again."""
    cells = [("reads", r, r, base_k, base_seed + b) for r in reads for b in range(n_boot)] + [("k", k, base_reads, k, base_seed + 1000 + b) for k in ks for b in range(n_boot)]
    known = done.join(samples.sparkSession.createDataFrame(cells, CELL), CELL_NAMES, "left_semi") if done is not None else None
    ready = {tuple(r) for r in known.select(*CELL_NAMES).collect()} if known is not None else set()
    todo = [c for c in cells if c not in ready]
    made = {(r, k): graph.cut(sketch(r, k)) for r, k in dict.fromkeys(c[2:4] for c in todo)}

    def measured(cell: tuple) -> DataFrame:
        *_, r, k, seed = cell
        found = validate(made[r, k], samples, pools, seed=seed, **settings)
        row = found["metrics_summary"].join(found["correlations"], F.lit(True))
        names = [F.lit(v).cast(t.split()[1]).alias(t.split()[0]) for v, t in zip(cell, CELL.split(", "), strict=True)]
        return graph.cut(row.select(*names, "roc_auc", F.col("avg_precision").alias("ap"), F.col("best_f1").alias("f1"), "spearman_rho", "pearson_r", "spearman_p", "pearson_p"))

    with ThreadPoolExecutor(max(1, parallel)) as threads:
        found = [f.result() for f in [threads.submit(inheritable_thread_target(samples.sparkSession)(measured), c) for c in todo]]
    raw = reduce(DataFrame.unionByName, found if known is None else [known, *found])
    names = ["roc_auc", "ap", "f1", "spearman_rho", "pearson_r"]
    return {
        "run_metrics_raw": raw,
        "summary_reads": metrics.summarise(raw.filter("kind = 'reads'"), "reads_per_sample", names),
        "summary_k": metrics.summarise(raw.filter("kind = 'k'"), "kmer", names),
    }


def reindexed(scores: DataFrame, samples: DataFrame, column: str) -> DataFrame:
    """sample, column: one row for each distinct sample, null where the scores lack it; other scores go. A sample with
    several scores stops the job."""
    one = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.concat(F.lit("several scores of "), F.first("sample")))).otherwise(F.first(column))
    single = scores.groupBy(F.col("sample").cast("string").alias("sample")).agg(one.cast("double").alias(column))
    return samples.select(F.col("sample").cast("string").alias("sample")).distinct().join(single, "sample", "left").select("sample", column)


def metadata_check(node_scores: DataFrame, runinfo: DataFrame | None = None, pools: list[str] | None = None, top_k: int | None = None, entropy: DataFrame | None = None, samples: DataFrame | None = None) -> dict[str, DataFrame]:
    """Scores (sample, mixture_score) against ground truth from run info or a list of pools; k-mer entropy too,
    where given. samples: those of the distance matrix; the scores are then one to each of these, null where there is
    none, which is kept in the tables and left out of the metrics."""
    if samples is not None:
        node_scores = reindexed(node_scores, samples, "mixture_score")
        entropy = None if entropy is None else reindexed(entropy, samples, "kmer_entropy")
    labels = metrics.ground_truth(node_scores, runinfo, pools)

    def judged(scores: DataFrame, column: str) -> DataFrame:
        known = scores.join(labels, "sample").filter(F.col("ground_truth").isin("pool", "individual"))
        return known.select("sample", (F.col("ground_truth") == "pool").cast("int").alias("y"), F.col(column).cast("double").alias("score"))

    scored = judged(node_scores, "mixture_score")
    order = F.when(F.col("ground_truth") == "pool", 0).when(F.col("ground_truth") == "individual", 1).otherwise(2)
    out = {
        "ground_truth": labels,
        "label_counts": metrics.label_counts(labels),
        "metrics_mixture_score": metrics.evaluate(scored, top_k),
        "score_vs_truth": node_scores.join(labels, "sample").orderBy(order, F.desc("mixture_score")),
        "roc_points": metrics.roc_points(scored),
        "pr_points": metrics.pr_points(scored),
        "confusion": metrics.confusion(metrics.top_k(scored, top_k)),
    }
    if entropy is not None:
        out["metrics_kmer_entropy"] = metrics.evaluate(judged(entropy, "kmer_entropy"), top_k)
    return out


def final_check(ranking: DataFrame, pools: list[str]) -> dict[str, DataFrame]:
    """The ten best of a ranking with a flag for known pools, and the precision of the best three."""
    known = F.upper(F.trim("sample")).isin([p.strip().upper() for p in pools])
    return {"top_ten": ranking.orderBy("rank").limit(10).withColumn("is_true_pool", known), "top_three": metrics.top_three_precision(ranking, pools)}
