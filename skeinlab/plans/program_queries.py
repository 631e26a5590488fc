"""Queries on the programs over reads and matrices, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.operators import kmers, qc
from skeinlab.plans import dense_sql, programs, read_queries, views as V
from skeinlab.plans.read_queries import R, rounded

DIM = 1000  # bins of the plain hash: no power of two


def pictured(spark, sf):
    """The order profiles of the nations with their number of customers as score and their region as group."""
    nation = V.table(spark, sf, "nation")
    scores = V.table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).cast("double").alias("mixture_score"))
    scores = scores.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).filter("n_nationkey % 5 <> 4").select(F.col("n_name").alias("sample_id"), "mixture_score")
    groups = nation.filter("n_regionkey < 4").select(F.col("n_name").alias("sample_id"), F.col("n_regionkey").alias("region"))
    values = V.profiles(spark, sf)
    return programs.visualise(values, values, 15, scores=scores, groups=groups, group="region", tree=True)


def plain_hash(spark, sf):
    return kmers.hashed_counts(V.reads(spark, sf), 9, DIM, False, 2, 3)


def entropy_beside_qc(spark, sf):
    both = qc.both_mates(qc.qc_reads(V.reads_with_quality(spark, sf))).join(kmers.entropy(read_queries.combined(spark, sf)), "sample", "left")
    return rounded(both.select("sample", "R1_reads_used", "R2_reads_used", "gc_frac", "kmer_entropy"), "gc_frac", "kmer_entropy")


def weights_by_group(spark, sf):
    """Group sums of weights that are written out, as a deconvolution gives them."""
    n = V.table(spark, sf, "nation")
    weights = n.select(F.concat(F.lit("POOL_"), (F.col("n_nationkey") % 3).cast("string")).alias("pool_sample"), F.col("n_name").alias("sample"), (F.col("n_nationkey") / 300.0).alias("weight"))
    groups = n.select(F.col("n_name").alias("sample"), F.concat(F.lit("G"), F.col("n_regionkey").cast("string")).alias("auto_group"))
    from skeinlab.operators.spectral import group_weights

    return rounded(group_weights(weights, groups), "weight")


QUERIES = {
    "report_end_bases": lambda s, d: rounded(qc.end_bases(V.reads(s, d)), "pct"),
    "report_hints": lambda s, d: rounded(qc.hints(V.reads(s, d), 4, 12, 5.0), "top_prefix_pct", "top_adapter_pct", "poly_g_pct"),
    "report_first_base_entropy": lambda s, d: rounded(programs.fastq_report(V.reads(s, d), 4)["first_base_entropy"], "entropy"),
    "visualise_distance": lambda s, d: rounded(pictured(s, d)["distance"], "d"),
    "visualise_merged": lambda s, d: rounded(pictured(s, d)["merged"], "PC1", "PC2"),
    "visualise_centroids": lambda s, d: rounded(pictured(s, d)["centroids"], "PC1", "PC2"),
    "visualise_tree": lambda s, d: pictured(s, d)["tree"],
    "kmer_plain_hash": plain_hash,
    "qc_with_entropy": entropy_beside_qc,
    "group_weights": weights_by_group,
}

CLIP = read_queries.CLIP.format(dim=15, bins="SELECT DISTINCT bin FROM probs").strip().replace("round(sqrt", "(sqrt").replace(", 0)), 6) AS d", ", 0))) AS d")
ZS, SELECT = CLIP.rsplit("SELECT x.sample AS a", 1)
VIS = "WITH RECURSIVE " + V.PROFILES + "," + ZS.rstrip() + ",\ndist AS MATERIALIZED (SELECT x.sample AS a" + SELECT + "),\nboth_ways AS (SELECT a AS u, b AS v, d FROM dist UNION ALL SELECT b, a, d FROM dist)"
MERGED = VIS + dense_sql.CENTRED + ",\n" + dense_sql.eigenvectors("ev", "gram", 2) + """,
sc AS (SELECT n_name AS sample_id, CAST(count(*) AS DOUBLE) AS mixture_score FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4 GROUP BY ALL),
mg AS (SELECT p.sample AS sample_id, p.x * sqrt(p.value) + 0.0 AS PC1, q.x * sqrt(q.value) + 0.0 AS PC2, mixture_score, n_regionkey AS region
  FROM ev_1 p JOIN ev_2 q USING (sample) LEFT JOIN sc ON sc.sample_id = p.sample LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 4) n ON n.n_name = p.sample)"""

ORACLES = {
    "report_end_bases": R + """
SELECT sample, side, base, n, round(100.0 * n / sum(n) OVER (PARTITION BY sample, side), 6) AS pct FROM (
  SELECT sample, side, base, count(*) AS n FROM (
    SELECT sample, CAST(5 AS INTEGER) AS side, left(seq, 1) AS base FROM reads WHERE length(seq) > 0 UNION ALL SELECT sample, 3, right(seq, 1) FROM reads WHERE length(seq) > 0) GROUP BY ALL)""",
    "report_hints": R + f""",
tot AS (SELECT sample, count(*) AS t, count(DISTINCT length(seq)) AS unique_lengths,
        count(CASE WHEN length(right(seq, 12)) - length(replace(right(seq, 12), 'G', '')) >= greatest(8, floor(0.8 * length(right(seq, 12)))) THEN 1 END) AS g,
        greatest({', '.join(f"count(CASE WHEN contains(seq, '{m}') THEN 1 END)" for m in qc.S.ADAPTERS)}) AS ad FROM reads GROUP BY sample),
pre AS (SELECT sample, max(n) AS n FROM (SELECT sample, left(seq, 4) AS p, count(*) AS n FROM reads GROUP BY ALL) GROUP BY sample)
SELECT sample, round(100.0 * n / t, 6) AS top_prefix_pct, 100.0 * n / t > 5 AS prefix_dominates, round(100.0 * ad / t, 6) AS top_adapter_pct, 100.0 * ad / t >= 0.5 AS adapters_left,
       unique_lengths, unique_lengths > 1 AS lengths_vary, round(100.0 * g / t, 6) AS poly_g_pct FROM tot JOIN pre USING (sample)""",
    "report_first_base_entropy": read_queries.entropy_sql("left(seq, 1)"),
    "visualise_distance": VIS + " SELECT a, b, round(d, 6) AS d FROM dist",
    "visualise_merged": MERGED + " SELECT sample_id, round(PC1, 6) AS PC1, round(PC2, 6) AS PC2, mixture_score, region FROM mg",
    "visualise_centroids": MERGED + " SELECT region, round(avg(PC1), 6) AS PC1, round(avg(PC2), 6) AS PC2 FROM mg WHERE region IS NOT NULL GROUP BY region",
    "visualise_tree": VIS + dense_sql.JOINS + dense_sql.NEWICK,
    "kmer_plain_hash": R + f""",
tr AS (SELECT sample, substring(seq, 3, greatest(length(seq) - 5, 0)) AS seq FROM reads),
km AS (SELECT sample, kmer, count(*) AS n FROM (SELECT sample, substring(seq, CAST(i + 1 AS BIGINT), 9) AS kmer FROM (SELECT sample, seq, unnest(range(0, length(seq) - 8)) AS i FROM tr)) WHERE NOT contains(kmer, 'N') GROUP BY ALL),
h0 AS (SELECT sample, n, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(translate(kmer, 'ACGT', '0123'), ''), lambda c: CAST(c AS BIGINT))), lambda a, c: a * 4 + c) AS UBIGINT) AS x FROM km),
h1 AS (SELECT sample, n, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM h0),
h2 AS (SELECT sample, n, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM h1)
SELECT sample, CAST(xor(x, x >> 33) % {DIM} AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM h2 GROUP BY ALL""",
    "qc_with_entropy": read_queries.RQ + "," + read_queries.QC_SQL + "," + V.kmers_sql(V.K, V.STEP, "NOT contains(kmer, 'N')") + "," + read_queries.COMBINED + """,
ent AS (SELECT sample, round(-sum(p * ln(p + 1e-12)), 6) AS kmer_entropy FROM probs GROUP BY sample)
SELECT qc.sample, max(CASE WHEN mate = 1 THEN reads_used END) AS R1_reads_used, max(CASE WHEN mate = 2 THEN reads_used END) AS R2_reads_used,
       round(0.5 * (max(CASE WHEN mate = 1 THEN gc_frac END) + max(CASE WHEN mate = 2 THEN gc_frac END)), 6) AS gc_frac, any_value(kmer_entropy) AS kmer_entropy FROM qc LEFT JOIN ent USING (sample) GROUP BY qc.sample""",
    "group_weights": "SELECT 'POOL_' || (n_nationkey % 3) AS pool_sample, 'G' || n_regionkey AS auto_group, round(sum(n_nationkey / 300.0), 6) AS weight FROM nation GROUP BY ALL",
}
