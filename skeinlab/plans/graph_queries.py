"""Queries on graphs, embeddings and mixtures of the nations' order profiles, and the pipelines over reads."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from skeinlab.operators import curvature, distance, graph, kmers, mixtures, spectral
from skeinlab.plans import dense_sql, pipelines, read_queries, views as V
from skeinlab.plans.read_queries import rounded
from skeinlab.schemas import TRUTH


def probs(spark, sf):
    return graph.cut(kmers.probabilities(V.profiles(spark, sf)))


def dist(spark, sf):
    p = probs(spark, sf)
    return graph.cut(distance.js_log_eps(p, p))


def nodes(spark, sf):
    return V.profiles(spark, sf).select("sample").distinct()


def knn(spark, sf):
    return graph.cut(graph.knn_graph(dist(spark, sf)))


def truth(spark):
    rows = [("MIX_1", ["NATION_6", "NATION_7"], [0.25, 0.75]), ("MIX_2", ["NATION_18", "NATION_12", "NATION_8"], [0.2, 0.3, 0.5]), ("MIX_3", ["NATION_14", "NATION_17"], [0.5, 0.5])]
    return spark.createDataFrame(rows, TRUTH)


def curvature_of(spark, sf, kind, proof=False):
    d, n = dist(spark, sf), nodes(spark, sf)
    edges = graph.cut(graph.knn_graph(d))
    if kind == "geometric":
        given = edges, graph.shortest_paths(edges, n), 0.0
    else:
        given = edges, distance.both_ways(d).unionByName(n.select(F.col("sample").alias("u"), F.col("sample").alias("v"), F.lit(0.0).alias("d"))), 0.5
    if proof:
        return rounded(curvature.proven(graph.cut(curvature.transport_plans(*given))), "d")
    return rounded(curvature.ollivier_ricci(*given), "d", "orc")


def split_profiles(spark, sf):
    """The nations' profiles, those before NATION_13, and those from there on with one that has no bins."""
    p = probs(spark, sf)
    names = p.select("sample").distinct()
    late = names.filter("sample >= 'NATION_13'").unionByName(spark.createDataFrame([("NOWHERE",)], "sample string"))
    return p, late, names.filter("sample < 'NATION_13'")


def optimal_weights(spark, sf):
    p, pools, individuals = split_profiles(spark, sf)
    return spectral.optimal_weights(graph.cut(spectral.raw_weights(p, pools, individuals)), p, pools, individuals)


def pool_sums(spark, sf):
    """Sums of the weights, and whether the residual is that of the weights' mixture, worked out bin by bin."""
    p, pools, individuals = split_profiles(spark, sf)
    raw = graph.cut(spectral.raw_weights(p, pools, individuals))
    made = raw.join(p, "sample").groupBy("pool_sample", "bin").agg(F.sum(F.col("raw") * F.col("p")).alias("made"))
    goal = p.join(pools, "sample", "left_semi").withColumnRenamed("sample", "pool_sample")
    left = made.join(goal, ["pool_sample", "bin"], "full").groupBy("pool_sample").agg(F.sqrt(F.sum(F.pow(F.coalesce("made", F.lit(0.0)) - F.coalesce("p", F.lit(0.0)), 2))).alias("left"))
    sums = spectral.deconvolve(p, pools, individuals).groupBy("pool_sample").agg(F.round(F.sum("weight"), 6).alias("weights"), F.max("residual_norm").alias("residual"))
    same = F.abs(F.coalesce("left", F.lit(0.0)) - F.col("residual")) < 1e-6
    return sums.join(left, "pool_sample", "left").select("pool_sample", "weights", same.alias("same_residual"))


def run_geometry(spark, sf):
    return geometry_tables(spark, sf)["mixture_ranking"]


def geometry_tables(spark, sf):
    return pipelines.geometry(dist(spark, sf), nodes(spark, sf), thresholds=0)


def preprocessed(spark, sf, table):
    return pipelines.preprocess(V.reads_with_quality(spark, sf), read_queries.manifest(spark, sf), V.K, V.DIM, V.STEP)[table]


def run_preprocess(spark, sf):
    return preprocessed(spark, sf, "pool_weights_individual")


def run_validate(spark, sf):
    return pipelines.validate(probs(spark, sf), nodes(spark, sf), ["NATION_6", "NATION_18"], dim=15, n_synth=12)["node_scores"]


def run_metadata(spark, sf):
    ranked = geometry_tables(spark, sf)["node_metrics"].select("sample", "mixture_score")
    return pipelines.metadata_check(ranked, pools=["NATION_6", "NATION_18", "NATION_17"])["metrics_mixture_score"]


def run_final(spark, sf):
    return pipelines.final_check(run_geometry(spark, sf), ["NATION_6", "NATION_18", "NATION_17"])["top_ten"]


def run_sweep(spark, sf):
    """Depths and k swept over the sources' own reads: each cell's histograms come from the first reads of a sample."""
    depths, order = (50, 100, 200), Window.partitionBy("sample").orderBy("doc_id", "chunk")
    # reads beyond the deepest cell are in none: they are dropped before the rows are sorted and stored
    reads = graph.cut(V.reads(spark, sf).select("sample", "seq", F.row_number().over(order).alias("nth")).filter(F.col("nth") <= max(depths)))

    def sketch(depth, k):
        return kmers.probabilities(kmers.crc_counts(reads.filter(F.col("nth") <= depth), k, V.DIM, 1, "read", ("sample",)))

    return pipelines.sweep(sketch, reads, [], reads=depths, ks=(9, 11, 13), base_reads=100, base_k=11, n_boot=1, dim=V.DIM, n_synth=12)["run_metrics_raw"]


QUERIES = {
    "profile_distance": lambda s, d: rounded(dist(s, d), "d"),
    "knn_graph": lambda s, d: rounded(knn(s, d), "d"),
    "knn_affinity": lambda s, d: rounded(graph.with_affinity(knn(s, d)), "d", "w"),
    "connected_knn": lambda s, d: rounded(graph.connected_knn_graph(dist(s, d), 1)[0], "d"),
    "similarity_edges": lambda s, d: rounded(graph.similarity_edges(dist(s, d)), "d", "s", "threshold"),
    "degrees": lambda s, d: graph.degrees(knn(s, d)),
    "triangles": lambda s, d: graph.triangles(knn(s, d)),
    "forman": lambda s, d: graph.forman(knn(s, d)),
    "mean_edge_length": lambda s, d: rounded(graph.node_means(knn(s, d), nodes(s, d), "d", "mean_edge_length"), "mean_edge_length"),
    "components": lambda s, d: graph.components(graph.similarity_edges(dist(s, d))),
    "shortest_paths": lambda s, d: rounded(graph.shortest_paths(knn(s, d), nodes(s, d)), "d"),
    "closeness": lambda s, d: rounded(graph.closeness(graph.shortest_paths(knn(s, d), nodes(s, d))), "closeness"),
    "betweenness": lambda s, d: rounded(graph.betweenness(e := knn(s, d), graph.shortest_paths(e, nodes(s, d))), "betweenness"),
    "topology_curve": lambda s, d: rounded(graph.topology_counts(dist(s, d), nodes(s, d)), "threshold"),
    "topology_entropy": lambda s, d: rounded(spectral.von_neumann_entropy(graph.threshold_edges(x := dist(s, d), graph.thresholds(x)), "step"), "vn_entropy"),
    "curvature_geometric": lambda s, d: curvature_of(s, d, "geometric"),
    "curvature_calibration": lambda s, d: curvature_of(s, d, "calibration"),
    "curvature_geometric_proof": lambda s, d: curvature_of(s, d, "geometric", proof=True),
    "curvature_calibration_proof": lambda s, d: curvature_of(s, d, "calibration", proof=True),
    "deconvolution_optimal": optimal_weights,
    "deconvolution_sums": pool_sums,
    "mixture_signatures": lambda s, d: rounded(mixtures.mixed(truth(s), probs(s, d)), "p"),
    "mixture_truth": lambda s, d: rounded(mixtures.truth_table(truth(s)), "entropy_norm", "minor_fraction"),
    "synthetic_truth": lambda s, d: mixtures.truth_table(mixtures.draw_truth(s, [r[0] for r in nodes(s, d).orderBy("sample").collect()])),
    "pcoa_centred": lambda s, d: spectral.centred(dist(s, d), nodes(s, d)).select("u", "v", F.round(F.col("value") + 0.0, 6).alias("value")),
    "pcoa": lambda s, d: rounded(spectral.pcoa(dist(s, d), nodes(s, d)), "value"),
    "pca": lambda s, d: rounded(spectral.pca(p := probs(s, d), p), "value"),
    "diffusion_map": lambda s, d: rounded(spectral.diffusion_map(knn(s, d))[0], "value"),
    "diffusion_spectrum": lambda s, d: rounded(spectral.diffusion_map(knn(s, d))[1], "eigenvalue"),
    "dense_diffusion": lambda s, d: rounded(spectral.dense_diffusion(dist(s, d), nodes(s, d)), "value"),
    "upgma": lambda s, d: rounded(spectral.upgma(dist(s, d), nodes(s, d)), "height").withColumns({c: F.array_join(c, ",") for c in ("members_left", "members_right")}),
    "leaf_order": lambda s, d: spectral.leaf_order(dist(s, d), nodes(s, d)),
    "tree_groups": lambda s, d: spectral.cut_tree(dist(s, d), nodes(s, d)),
    "neighbour_joining": lambda s, d: spectral.neighbour_joining(dist(s, d), nodes(s, d)),
    "communities": lambda s, d: spectral.communities(graph.similarity_edges(dist(s, d))),
    "deconvolution": lambda s, d: rounded(spectral.deconvolve(p := probs(s, d), p.filter("sample < 'NATION_13'"), p.filter("sample >= 'NATION_13'")), "weight", "residual_norm"),
    "run_preprocess": run_preprocess,
    "preprocess_distance": lambda s, d: rounded(preprocessed(s, d, "kmer_js_distance"), "d"),
    "preprocess_quality": lambda s, d: rounded(preprocessed(s, d, "quality_profile"), "mean_q"),
    "geometry_nodes": lambda s, d: rounded(geometry_tables(s, d)["node_metrics"].select("sample", "degree", "betweenness", "closeness", "mean_edge_length", "forman_scalar"), "betweenness", "closeness", "mean_edge_length", "forman_scalar"),
    "geometry_edges": lambda s, d: rounded(geometry_tables(s, d)["edge_metrics"].select("u", "v", "distance", "forman_F", "triangles"), "distance"),
    "run_geometry": run_geometry,
    "run_validate": run_validate,
    "run_metadata": run_metadata,
    "run_final": run_final,
    "run_sweep": run_sweep,
}

P = "WITH RECURSIVE " + V.PROFILES
D = P + "," + V.JS
G = D + "," + V.KNN
SIM = """,
ss AS (SELECT a AS u, b AS v, d, 1 - d / (SELECT max(d) FROM dist) AS s FROM dist),
sim AS (SELECT *, (SELECT quantile_cont(s, 0.9) FROM (SELECT s FROM ss UNION ALL SELECT s FROM ss)) AS threshold FROM ss),
sedges AS (SELECT * FROM sim WHERE s >= threshold)"""
TRI = """,
deg AS (SELECT u AS sample, count(*) AS degree FROM adj GROUP BY u),
tri AS (SELECT e.u, e.v, (SELECT count(*) FROM adj x JOIN adj y ON x.v = y.v WHERE x.u = e.u AND y.u = e.v) AS triangles FROM edges e)"""
ORACLES = {
    "profile_distance": D + " SELECT a, b, round(d, 6) AS d FROM dist",
    "knn_graph": G + " SELECT u, v, round(d, 6) AS d FROM edges",
    "knn_affinity": G + " SELECT u, v, round(d, 6) AS d, round(exp(-d * d / (2 * sg * sg)), 6) AS w FROM edges, (SELECT greatest(median(d), 1e-9) AS sg FROM edges)",
    "similarity_edges": D + SIM + " SELECT u, v, round(d, 6) AS d, round(s, 6) AS s, round(threshold, 6) AS threshold FROM sedges",
    "degrees": G + TRI + " SELECT sample, degree FROM deg",
    "triangles": G + TRI + " SELECT u, v, triangles FROM tri",
    "forman": G + TRI + " SELECT u, v, 4 - x.degree - y.degree + 3 * triangles AS forman_F, triangles FROM tri JOIN deg x ON x.sample = u JOIN deg y ON y.sample = v",
    "mean_edge_length": G + " SELECT u AS sample, round(avg(d), 6) AS mean_edge_length FROM adj GROUP BY u",
    "components": D + SIM + """,
reach(u, v) AS (SELECT u, u FROM sedges UNION SELECT v, v FROM sedges UNION SELECT r.u, CASE WHEN t.u = r.v THEN t.v ELSE t.u END FROM reach r JOIN sedges t ON t.u = r.v OR t.v = r.v)
SELECT u AS node, min(v) AS label FROM reach GROUP BY u""",
    "mixture_signatures": P + """,
tr AS (SELECT * FROM (VALUES ('MIX_1', 'NATION_6', 0.25), ('MIX_1', 'NATION_7', 0.75), ('MIX_2', 'NATION_18', 0.2), ('MIX_2', 'NATION_12', 0.3), ('MIX_2', 'NATION_8', 0.5), ('MIX_3', 'NATION_14', 0.5), ('MIX_3', 'NATION_17', 0.5)) t(name, sample, w)),
mx AS (SELECT name AS sample, bin, sum(w * p) AS s FROM tr JOIN probs USING (sample) GROUP BY ALL)
SELECT sample, bin, round(s / sum(s) OVER (PARTITION BY sample), 6) AS p FROM mx""",
    "mixture_truth": """SELECT name AS sample, array_to_string(p, ',') AS parents, array_to_string(list_transform(w, lambda x: printf('%.4f', x)), ',') AS weights,
  round(-list_sum(list_transform(w, lambda x: x * ln(x))) / ln(len(w)), 6) AS entropy_norm, round(list_min(w), 6) AS minor_fraction, len(p) AS n_parents
FROM (VALUES ('MIX_1', ['NATION_6', 'NATION_7'], [0.25::DOUBLE, 0.75]), ('MIX_2', ['NATION_18', 'NATION_12', 'NATION_8'], [0.2::DOUBLE, 0.3, 0.5]), ('MIX_3', ['NATION_14', 'NATION_17'], [0.5::DOUBLE, 0.5])) t(name, p, w)""",
    "pcoa_centred": D + """,
sq AS (SELECT u, v, d * d AS s FROM both_ways UNION ALL SELECT DISTINCT sample, sample, 0.0 FROM probs)
SELECT u, v, round(-0.5 * (s - avg(s) OVER (PARTITION BY u) - avg(s) OVER (PARTITION BY v) + avg(s) OVER ()) + 0.0, 6) AS value FROM sq""",
}

def _squared(older: str, newer: str) -> str:
    return f"{newer} AS (SELECT x.u, y.v, min(x.d + y.d) AS d FROM {older} x JOIN {older} y ON x.v = y.u GROUP BY ALL)"


# Shortest paths of up to 32 edges, more than the graph has nodes, by five squarings of the distance matrix.
PATHS = G + """,
p1 AS (SELECT u, v, d FROM adj UNION ALL SELECT DISTINCT sample, sample, 0.0 FROM probs),
""" + ",\n".join(_squared(f"p{1 << i}", f"p{2 << i}") for i in range(5))

# Each edge's flow and potentials prove one another; see curvature.proven.
PROVEN = "true AS balanced, true AS bounded, true AS optimal"
ORACLES["curvature_geometric_proof"] = PATHS + f" SELECT e.u, e.v, round(p.d, 6) AS d, {PROVEN} FROM edges e JOIN p32 p USING (u, v)"
ORACLES["curvature_calibration_proof"] = G + f" SELECT u, v, round(d, 6) AS d, {PROVEN} FROM edges"
SPLIT = P + """, names AS (SELECT DISTINCT sample FROM probs),
pools AS (SELECT sample AS pool_sample FROM names WHERE sample >= 'NATION_13' UNION ALL SELECT 'NOWHERE')"""
ORACLES["deconvolution_optimal"] = SPLIT + " SELECT pool_sample, sample, true AS optimal FROM pools, names WHERE sample < 'NATION_13'"
ORACLES["deconvolution_sums"] = SPLIT + " SELECT pool_sample, CASE WHEN pool_sample = 'NOWHERE' THEN 0.0 ELSE 1.0 END AS weights, true AS same_residual FROM pools"
ORACLES["shortest_paths"] = PATHS + " SELECT u, v, round(d, 6) AS d FROM p32"
CLOSE = PATHS + """,
c AS (SELECT u, count(*) - 1 AS k, sum(d) AS t, (SELECT count(DISTINCT sample) FROM probs) AS n FROM p32 GROUP BY u),
cl AS (SELECT u, CASE WHEN t > 0 AND n > 1 THEN k / t * k / (n - 1) ELSE 0 END AS closeness FROM c)"""
ORACLES["closeness"] = CLOSE + " SELECT u AS sample, round(closeness, 6) AS closeness FROM cl"
# Edge lengths are real numbers without ties, so a pair has one shortest path.
BETWEEN = """,
m AS (SELECT x.v AS sample FROM p32 p JOIN p32 x ON x.u = p.u JOIN p32 y ON y.u = x.v AND y.v = p.v
      WHERE p.u < p.v AND x.v <> p.u AND x.v <> p.v AND abs(x.d + y.d - p.d) <= 1e-10 * (1 + p.d)),
n AS (SELECT count(DISTINCT sample) AS n FROM probs),
bt AS (SELECT s.sample, (SELECT count(*) FROM m WHERE m.sample = s.sample) * 2.0 / ((n - 1) * (n - 2)) AS betweenness FROM (SELECT DISTINCT sample FROM probs) s, n)"""
ORACLES["betweenness"] = PATHS + BETWEEN + " SELECT sample, round(betweenness, 6) AS betweenness FROM bt"
FORMAN = TRI + """,
fr AS (SELECT t.u, t.v, 4 - x.degree - y.degree + 3 * triangles AS forman_F, triangles FROM tri t JOIN deg x ON x.sample = t.u JOIN deg y ON y.sample = t.v)"""
# The profiles' four nearest neighbours connect all samples, so the connected graph is that of knn_graph.
ORACLES["geometry_nodes"] = CLOSE + BETWEEN + FORMAN + """
SELECT sample, degree, round(betweenness, 6) AS betweenness, round(closeness, 6) AS closeness,
       round((SELECT avg(d) FROM adj WHERE adj.u = sample), 6) AS mean_edge_length,
       round((SELECT avg(forman_F) FROM fr WHERE fr.u = sample OR fr.v = sample), 6) AS forman_scalar
FROM bt JOIN deg USING (sample) JOIN cl ON cl.u = sample"""
ORACLES["geometry_edges"] = G + FORMAN + " SELECT u, v, round(d, 6) AS distance, forman_F, triangles FROM fr JOIN edges USING (u, v)"

ORACLES["topology_curve"] = D + """,
cuts AS (SELECT unnest(quantile_cont(d, """ + str([0.05 + 0.9 * i / 20 for i in range(21)]) + """)) AS threshold, CAST(unnest(range(21)) AS INTEGER) AS step FROM both_ways),
te AS (SELECT step, a AS u, b AS v FROM dist JOIN cuts ON d <= threshold),
ids AS (SELECT DISTINCT sample FROM probs),
grid AS (SELECT step, sample FROM cuts, ids),
reach(step, u, v) AS (SELECT step, sample, sample FROM grid UNION SELECT r.step, r.u, CASE WHEN t.u = r.v THEN t.v ELSE t.u END FROM reach r JOIN te t ON t.step = r.step AND (t.u = r.v OR t.v = r.v)),
parts AS (SELECT step, count(DISTINCT label) AS c FROM (SELECT step, u, min(v) AS label FROM reach GROUP BY ALL) GROUP BY step),
nx AS (SELECT step, u, list(v) AS nx FROM te GROUP BY ALL),
cl(step, open, size) AS (
  SELECT g.step, coalesce(nx.nx, []), 1 FROM grid g LEFT JOIN nx ON nx.step = g.step AND nx.u = g.sample
  UNION ALL
  SELECT c.step, list_intersect(c.open, coalesce(nx.nx, [])), c.size + 1 FROM (SELECT step, open, size, unnest(open) AS w FROM cl) c LEFT JOIN nx ON nx.step = c.step AND nx.u = c.w),
chi AS (SELECT step, sum(CASE WHEN size % 2 = 1 THEN 1 ELSE -1 END) AS chi, max(size) AS top FROM cl GROUP BY step),
es AS (SELECT step, count(*) AS e FROM te GROUP BY step)
SELECT step, round(threshold, 6) AS threshold, CAST((SELECT count(*) FROM ids) AS INTEGER) AS V, e AS E, c AS components, e - (SELECT count(*) FROM ids) + c AS beta1_graph,
       CAST(chi AS BIGINT) AS euler_clique_complex, top AS max_clique_size FROM cuts JOIN es USING (step) JOIN parts USING (step) JOIN chi USING (step)"""

ORACLES |= dense_sql.oracles(D + SIM)
ORACLES["preprocess_distance"] = read_queries.ORACLES["js_distance"]
ORACLES["preprocess_quality"] = read_queries.ORACLES["qc_group_profile"]
