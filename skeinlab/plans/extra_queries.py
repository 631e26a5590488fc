"""Queries on the smaller operators: figure data, set operations, thresholds, trimming, reader helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.functions import sequence as S
from skeinlab.operators import distance, graph, metrics
from skeinlab.plans import pipelines, read_queries, views as V
from skeinlab.plans.graph_queries import CLOSE, D, G, dist, knn, nodes
from skeinlab.plans.read_queries import rounded
from skeinlab.sources import fastq, figures

POOLS = [f"NATION_{i}" for i in (3, 6, 17, 18)]


def shifted(spark, sf):
    """The nearest-neighbour edges with a stand-in curvature that has both signs."""
    return knn(spark, sf).select("u", "v", (F.col("d") - 0.08).alias("orc"))


def induced(spark, sf):
    """The graph of the report's twelve best: of closeness here, ties by id."""
    edges = knn(spark, sf)
    best = graph.closeness(graph.shortest_paths(edges, nodes(spark, sf))).orderBy(F.round("closeness", 9).desc(), "sample").limit(12)
    return graph.induced(edges, best.select("sample")).select("u", "v")


def coords(spark, sf):
    key = F.col("s_suppkey")
    return V.table(spark, sf, "supplier").select(F.col("s_acctbal").alias("PC1"), F.col("s_nationkey").cast("double").alias("PC2"), F.when(key % 4 < 3, F.concat(F.lit("G"), (key % 4).cast("string"))).alias("cultivar"))


def trims(spark, sf):
    seq = F.col("seq")
    n = lambda c: F.sum(F.length(c)).alias
    return V.reads(spark, sf).groupBy("sample").agg(n(S.trimmed(seq, 5, 10))("plain"), n(S.trimmed(seq, 3, 60, strict_compat=True))("wrapped"), n(S.tail(seq, 20))("tails"))


def labelled_nodes(spark, sf):
    """Individuals and real pools under their labels, and the pools that are samples."""
    samples = nodes(spark, sf)
    pools = spark.createDataFrame([(p,) for p in [*POOLS, "ELSEWHERE"]], "sample string")
    pure = samples.join(pools, "sample", "left_anti").withColumn("label", F.lit("individual"))
    return pure.unionByName(samples.join(pools, "sample", "left_semi").withColumn("label", F.lit("real_pool")))


def mate_names(spark, sf):
    """Sample ids of file names made of part names."""
    p = F.col("p_partkey")
    name = F.concat(F.lit("/data/x/lib"), (p % 50).cast("string"), F.when(p % 3 == 0, "_1").when(p % 3 == 1, ".2").otherwise(""), F.when(p % 4 == 0, ".fastq.gz").when(p % 4 == 1, ".FASTQ.GZ").when(p % 4 == 2, ".Fq").otherwise(".fq"))
    return V.table(spark, sf, "part").select(fastq.sample_of(name).alias("sample")).groupBy("sample").agg(F.count(F.lit(1)).alias("files"))


def reindexed(spark, sf):
    """Degrees as scores of every third nation only, over all nations and one that has no profile."""
    scores = graph.degrees(knn(spark, sf)).join(V.table(spark, sf, "nation").filter("n_nationkey % 3 = 0").select(F.col("n_name").alias("sample")), "sample")
    samples = nodes(spark, sf).unionByName(spark.createDataFrame([("NOWHERE",)], "sample string"))
    found = pipelines.metadata_check(scores.select("sample", F.col("degree").alias("mixture_score")), pools=POOLS, samples=samples)
    return found["score_vs_truth"].select("sample", "mixture_score", "ground_truth")


QUERIES = {
    "reindexed_scores": reindexed,
    "depth_bars": lambda s, d: rounded(figures.depth_bars(read_queries.manifest(s, d)), "megabytes"),
    "node_sizes": lambda s, d: rounded(figures.node_sizes(graph.degrees(knn(s, d)), "degree"), "size"),
    "group_centroids": lambda s, d: rounded(figures.group_centroids(coords(s, d), "cultivar"), "PC1", "PC2"),
    "curvature_histogram": lambda s, d: rounded(figures.curvature_histogram(shifted(s, d), "orc"), "lo", "hi"),
    "negative_incidence": lambda s, d: rounded(graph.negative_incidence(shifted(s, d), nodes(s, d)), "neg_orc_incidence"),
    "induced_subgraph": induced,
    "thresholds": lambda s, d: rounded(graph.thresholds(dist(s, d)), "threshold"),
    "threshold_edges": lambda s, d: graph.threshold_edges(x := dist(s, d), graph.thresholds(x)).groupBy("step").agg(F.count(F.lit(1)).alias("edges")),
    "neighbour_ranks": lambda s, d: graph.neighbour_ranks(dist(s, d)).select("u", "v", "rank"),
    "js_divergence": lambda s, d: rounded(distance.js_clip(distance.normalised_rows(V.profiles(s, d)), V.profiles(s, d), 15, root=False), "d"),
    "zscores_flat": lambda s, d: rounded(metrics.zscores(graph.degrees(knn(s, d)).withColumn("flat", F.lit(2.0)), ["degree", "flat"], "zero"), "degree_z", "flat_z"),
    "trims": trims,
    "labelled_nodes": labelled_nodes,
    "mate_names": mate_names,
}

SHIFTED = G + ", sh AS (SELECT u, v, d - 0.08 AS orc FROM edges)"

ORACLES = {
    "reindexed_scores": G + f""", dg AS (SELECT u AS sample, CAST(count(*) AS DOUBLE) AS degree FROM adj JOIN nation ON n_name = u WHERE n_nationkey % 3 = 0 GROUP BY u),
al AS (SELECT DISTINCT sample FROM probs UNION ALL SELECT 'NOWHERE')
SELECT sample, degree AS mixture_score, CASE WHEN sample IN ({', '.join(repr(p) for p in POOLS)}) THEN 'pool' ELSE 'individual' END AS ground_truth FROM al LEFT JOIN dg USING (sample)""",
    "depth_bars": f"SELECT sample, round(total_bytes / 1048576, 6) AS megabytes FROM ({read_queries.MANIFEST})",
    "node_sizes": G + ", dg AS (SELECT u AS sample, count(*) AS degree FROM adj GROUP BY u) SELECT sample, degree, round((degree - min(degree) OVER ()) / (max(degree) OVER () - min(degree) OVER () + 1e-12), 6) AS size FROM dg",
    "group_centroids": "SELECT 'G' || (s_suppkey % 4) AS cultivar, round(avg(s_acctbal), 6) AS PC1, round(avg(s_nationkey), 6) AS PC2 FROM supplier WHERE s_suppkey % 4 < 3 GROUP BY 1",
    "curvature_histogram": SHIFTED + """,
b AS (SELECT min(orc) AS lo, max(orc) AS hi FROM sh)
SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS lo, round(lo + (bin + 1) * (hi - lo) / 20, 6) AS hi, n
FROM (SELECT CAST(least(floor((orc - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, lo, hi, count(*) AS n FROM sh, b GROUP BY ALL)""",
    "negative_incidence": SHIFTED + " SELECT sample, round(coalesce((SELECT sum(greatest(-orc, 0)) FROM sh WHERE u = sample OR v = sample), 0), 6) AS neg_orc_incidence FROM (SELECT DISTINCT sample FROM probs)",
    "induced_subgraph": CLOSE + ", t AS (SELECT u AS sample FROM cl ORDER BY round(closeness, 9) DESC, u LIMIT 12) SELECT u, v FROM edges WHERE u IN (SELECT sample FROM t) AND v IN (SELECT sample FROM t)",
    "thresholds": D + f" SELECT CAST(unnest(range(21)) AS INTEGER) AS step, round(unnest(quantile_cont(d, {[0.05 + 0.9 * i / 20 for i in range(21)]})), 6) AS threshold FROM both_ways",
    "threshold_edges": D + f", c AS (SELECT CAST(unnest(range(21)) AS INTEGER) AS step, unnest(quantile_cont(d, {[0.05 + 0.9 * i / 20 for i in range(21)]})) AS threshold FROM both_ways) SELECT step, count(*) AS edges FROM c JOIN dist ON d <= threshold GROUP BY step",
    "neighbour_ranks": G + " SELECT u, v, CAST(r AS INTEGER) AS rank FROM near",
    "js_divergence": read_queries.ORACLES["js_matrix"].replace("round(sqrt(greatest(", "round((greatest("),
    "zscores_flat": G + ", dg AS (SELECT u AS sample, count(*) AS degree FROM adj GROUP BY u) SELECT sample, degree, 2.0::DOUBLE AS flat, round((degree - avg(degree) OVER ()) / (SELECT stddev_pop(degree) FROM dg), 6) AS degree_z, 0.0::DOUBLE AS flat_z FROM dg",
    "trims": read_queries.R + """
SELECT sample, CAST(sum(greatest(length(seq) - 15, 0)) AS BIGINT) AS plain,
       CAST(sum(greatest(CASE WHEN length(seq) < 60 THEN greatest(2 * length(seq) - 60, 0) ELSE length(seq) - 60 END - 3, 0)) AS BIGINT) AS wrapped,
       CAST(sum(least(length(seq), 20)) AS BIGINT) AS tails FROM reads GROUP BY sample""",
    "labelled_nodes": f"WITH {V.PROFILES} SELECT DISTINCT sample, CASE WHEN sample IN ({', '.join(repr(p) for p in POOLS)}) THEN 'real_pool' ELSE 'individual' END AS label FROM probs",
    "mate_names": "SELECT 'lib' || (p_partkey % 50) AS sample, count(*) AS files FROM part GROUP BY 1",
}
