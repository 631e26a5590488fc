"""Queries on scored labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.operators import metrics as M
from skeinlab.plans import views as V
from skeinlab.plans.read_queries import rounded

W = "WITH " + V.LABELS
AT = """,
at_ AS (SELECT score, count(CASE WHEN y = 1 THEN 1 END) AS pos, count(CASE WHEN y <> 1 THEN 1 END) AS neg FROM scored GROUP BY score),
pts AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM at_ WINDOW w AS (ORDER BY score DESC))"""
TOP = """,
tk AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY score DESC, sample) <= (SELECT sum(y) FROM scored) THEN 1 ELSE 0 END AS pred FROM scored)"""
RUNINFO = """,
ri AS (SELECT CAST(c_custkey % 40 AS VARCHAR) AS run,
  lower(CASE c_custkey % 7 WHEN 0 THEN 'Plant Pool-GBS' WHEN 1 THEN 'individual gbs lane' WHEN 2 THEN 'gbs of a pool' WHEN 3 THEN 'GBS individual' ELSE 'WGS' END || ' ' || c_mktsegment) AS t FROM customer)"""


def runinfo(spark, sf):
    k = F.col("c_custkey")
    title = F.when(k % 7 == 0, "Plant Pool-GBS").when(k % 7 == 1, "individual gbs lane").when(k % 7 == 2, "gbs of a pool").when(k % 7 == 3, "GBS individual").otherwise("WGS")
    return V.table(spark, sf, "customer").select((k % 40).cast("string").alias("Run"), title.alias("Title"), F.col("c_mktsegment").alias("LibraryName"))


def lengths(spark, sf):
    """Documents with their length and number of words, as two scores to compare."""
    docs = V.table(spark, sf, "documents").filter("text IS NOT NULL")
    return docs.select(F.col("n_chars").cast("double").alias("x"), (F.length(F.col("text")) - F.length(F.translate("text", "e", ""))).cast("double").alias("y"))


def runs(spark, sf):
    """Order values as runs of a sweep over priorities."""
    return V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("reads"), (F.col("o_totalprice") / 1e6).alias("roc_auc"), (F.col("o_custkey") / 1e4).alias("f1"))


EVALUATED = ["accuracy", "precision", "recall", "f1", "roc_auc", "avg_precision", "p_fisher_enrichment", "p_hypergeom_enrichment"]

CORRELATED = ["pearson_r", "spearman_rho", "pearson_p", "spearman_p"]

QUERIES = {
    "roc_auc": lambda s, d: rounded(M.roc_auc(V.scored_labels(s, d)), "roc_auc"),
    "average_precision": lambda s, d: rounded(M.average_precision(V.scored_labels(s, d)), "avg_precision"),
    "roc_points": lambda s, d: rounded(M.roc_points(V.scored_labels(s, d)), "fpr", "tpr"),
    "pr_points": lambda s, d: rounded(M.pr_points(V.scored_labels(s, d)), "precision", "recall"),
    "best_f1": lambda s, d: rounded(M.best_f1(V.scored_labels(s, d)), "f1"),
    "evaluate_scores": lambda s, d: rounded(M.evaluate(V.scored_labels(s, d)), *EVALUATED),
    "top_k": lambda s, d: M.top_k(V.scored_labels(s, d)).select("sample", "y", "score", "pred"),
    "confusion": lambda s, d: M.confusion(M.top_k(V.scored_labels(s, d))),
    "label_counts": lambda s, d: M.label_counts(V.scored_labels(s, d)),
    "correlations": lambda s, d: rounded(M.correlations(lengths(s, d), "x", "y"), *CORRELATED),
    "correlations_weak": lambda s, d: rounded(M.correlations(V.table(s, d, "orders"), "o_totalprice", "o_custkey"), *CORRELATED),
    "roc_corners": lambda s, d: rounded(M.roc_points(V.scored_labels(s, d), drop_intermediate=True), "fpr", "tpr"),
    "sweep_summary": lambda s, d: rounded(M.summarise(runs(s, d), "reads", ["roc_auc", "f1"]), "roc_auc_mean", "roc_auc_sd", "f1_mean", "f1_sd"),
    "zscores": lambda s, d: rounded(M.zscores(V.scored_labels(s, d).select("sample", "score"), ["score"]), "score_z"),
    "pool_labels": lambda s, d: M.pool_labels(runinfo(s, d)),
    "ground_truth": lambda s, d: M.ground_truth(V.table(s, d, "supplier").select(F.col("s_suppkey").cast("string").alias("sample")), runinfo(s, d)),
    "top_three": lambda s, d: rounded(M.top_three_precision(V.table(s, d, "nation").select(F.col("n_name").alias("sample"), (F.col("n_nationkey") + 1).alias("rank")), ["NATION_1", " nation_2 "]), "precision"),
}

LABELLED = RUNINFO + """,
lab AS (SELECT run AS sample, CASE max(CASE WHEN t LIKE '%pool-gbs%' OR t LIKE '%pool gbs%' THEN 2 WHEN t LIKE '%individual-gbs%' OR t LIKE '%individual gbs%' THEN 1
  WHEN t LIKE '%pool%' AND t LIKE '%gbs%' THEN 2 WHEN t LIKE '%individual%' AND t LIKE '%gbs%' THEN 1 ELSE 0 END) WHEN 2 THEN 'pool' WHEN 1 THEN 'individual' ELSE 'unknown' END AS ground_truth FROM ri GROUP BY run)"""

AUC = "(SELECT sum(pos * (n - fp) + 0.5 * pos * neg) / max(p * n) FROM pts)"
AP = "(SELECT sum(pos / p * tp / (tp + fp)) FROM pts)"



def correlated(pairs: str) -> str:
    """Both correlations of x and y with their p: the part of the integral of cos^(n - 3) beyond the angle whose
    sine is the correlation, by Simpson's rule in steps of a thousandth of the curve's width."""
    p = """least(1, list_sum(list_transform(range(12001), lambda i: (CASE WHEN i IN (0, 12000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * greatest(cos(least(asin(abs({r})) + i * h, pi() / 2)), 0) ** (n - 3)))
         / list_sum(list_transform(range(12001), lambda i: (CASE WHEN i IN (0, 12000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * greatest(cos(least(i * h, pi() / 2)), 0) ** (n - 3))))"""
    return f"""WITH b AS ({pairs}),
r AS (SELECT *, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM b),
c AS (SELECT count(*) AS n, corr(x, y) AS pr, corr(rx, ry) AS sr, 0.001 / sqrt(count(*)) AS h FROM r)
SELECT n, round(pr, 6) AS pearson_r, round(sr, 6) AS spearman_rho, round({p.format(r="pr")}, 6) AS pearson_p, round({p.format(r="sr")}, 6) AS spearman_p FROM c"""


ORACLES = {
    "roc_auc": W + AT + f" SELECT round({AUC}, 6) AS roc_auc",
    "average_precision": W + AT + f" SELECT round({AP}, 6) AS avg_precision",
    "roc_points": W + AT + " SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM pts UNION ALL SELECT NULL, 0.0, 0.0",
    "pr_points": W + AT + " SELECT score AS threshold, round(tp / (tp + fp), 6) AS precision, round(tp / p, 6) AS recall FROM pts UNION ALL SELECT NULL, 1.0, 0.0",
    "best_f1": W + AT + " SELECT score AS threshold, round(2.0 * tp / (tp + fp + p), 6) AS f1 FROM pts ORDER BY 2.0 * tp / (tp + fp + p) DESC, score LIMIT 1",
    "evaluate_scores": W + AT + TOP + f""",
c AS (SELECT count(*) AS n_used, sum(y) AS m, sum(pred) AS k, count(CASE WHEN y = 1 AND pred = 1 THEN 1 END) AS tp, count(CASE WHEN y = 0 AND pred = 1 THEN 1 END) AS fp,
             count(CASE WHEN y = 0 AND pred = 0 THEN 1 END) AS tn, count(CASE WHEN y = 1 AND pred = 0 THEN 1 END) AS fn FROM tk),
h AS (SELECT sum(exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) + lgamma(n_used - m + 1) - lgamma(k - i + 1) - lgamma(n_used - m - k + i + 1)
             - lgamma(n_used + 1) + lgamma(k + 1) + lgamma(n_used - k + 1))) AS pv
      FROM c, (SELECT unnest(range(100001)) AS i) WHERE i >= tp AND i <= least(m, k) AND k - i <= n_used - m)
SELECT n_used, CAST(m AS BIGINT) AS n_pools, CAST(k AS BIGINT) AS topk, tp, fp, tn, fn, round((tp + tn) / n_used, 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
       round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round({AUC}, 6) AS roc_auc, round({AP}, 6) AS avg_precision,
       round(least(pv, 1), 6) AS p_fisher_enrichment, round(least(pv, 1), 6) AS p_hypergeom_enrichment FROM c, h""",
    "top_k": W + TOP + " SELECT sample, y, score, pred FROM tk",
    "confusion": W + TOP + " SELECT y AS truth, pred AS predicted, count(*) AS n FROM tk GROUP BY ALL",
    "label_counts": W + " SELECT ground_truth, count(*) AS n FROM scored GROUP BY ALL",
    "correlations": correlated("SELECT CAST(n_chars AS DOUBLE) AS x, CAST(length(text) - length(replace(text, 'e', '')) AS DOUBLE) AS y FROM documents WHERE text IS NOT NULL"),
    "correlations_weak": correlated("SELECT o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders"),
    "roc_corners": W + AT + """,
nx AS (SELECT *, lead(pos) OVER w AS pos_, lead(neg) OVER w AS neg_ FROM pts WINDOW w AS (ORDER BY score DESC))
SELECT score AS threshold, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr FROM nx WHERE coalesce(pos * neg_ <> neg * pos_, true) UNION ALL SELECT NULL, 0.0, 0.0""",
    "sweep_summary": "SELECT o_orderpriority AS reads, count(*) AS n_runs, round(avg(o_totalprice / 1e6), 6) AS roc_auc_mean, round(coalesce(stddev_samp(o_totalprice / 1e6), 0), 6) AS roc_auc_sd, round(avg(o_custkey / 1e4), 6) AS f1_mean, round(coalesce(stddev_samp(o_custkey / 1e4), 0), 6) AS f1_sd FROM orders GROUP BY 1",
    "zscores": W + " SELECT sample, score, round((score - avg(score) OVER ()) / (SELECT stddev_pop(score) FROM scored), 6) AS score_z FROM scored",
    "pool_labels": "WITH x AS (SELECT 1)" + LABELLED + " SELECT sample, ground_truth FROM lab",
    "ground_truth": "WITH x AS (SELECT 1)" + LABELLED + " SELECT CAST(s_suppkey AS VARCHAR) AS sample, coalesce(ground_truth, 'unknown') AS ground_truth FROM supplier LEFT JOIN lab ON lab.sample = CAST(s_suppkey AS VARCHAR)",
    "top_three": "SELECT count(CASE WHEN upper(trim(n_name)) IN ('NATION_1', 'NATION_2') THEN 1 END) AS hits, round(count(CASE WHEN upper(trim(n_name)) IN ('NATION_1', 'NATION_2') THEN 1 END) / 3.0, 6) AS precision FROM (SELECT * FROM nation ORDER BY n_nationkey LIMIT 3)",
}
