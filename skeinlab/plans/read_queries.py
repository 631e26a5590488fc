"""Queries on reads: QC, k-mer histograms and distances."""

from __future__ import annotations

from pyspark.sql import functions as F

from skeinlab.operators import distance, kmers, qc
from skeinlab.plans import views as V

R = "WITH " + V.READS
RQ = R + "," + V.SCORES
KM = R + "," + V.kmers_sql(V.K, V.STEP, "NOT contains(kmer, 'N')")
KS = R + "," + V.kmers_sql(V.K, 1, "true", "NOT contains(seq, 'N')")
COMBINED = """
mates AS (SELECT sample, mate, bin, n / sum(n) OVER (PARTITION BY sample, mate) AS p FROM binned),
probs AS (SELECT sample, bin, s / sum(s) OVER (PARTITION BY sample) AS p FROM (SELECT sample, bin, sum(p) AS s FROM mates GROUP BY ALL))"""
SKETCH = "probs AS (SELECT sample, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY sample) AS p FROM binned GROUP BY sample, bin)"


def manifest(spark, sf):
    docs = V.table(spark, sf, "documents").filter("source IS NOT NULL")
    mate = 1 + F.col("doc_id") % 2
    size = lambda m: F.coalesce(F.sum(F.when(mate == m, F.col("n_chars"))), F.lit(0))
    return docs.groupBy(F.col("source").alias("sample")).agg(size(1).alias("r1_bytes"), size(2).alias("r2_bytes"), (size(1) + size(2)).alias("total_bytes"))


def crc(spark, sf):
    return kmers.crc_counts(V.reads(spark, sf), V.K, V.DIM, V.STEP)


def combined(spark, sf):
    return kmers.mates_combined(crc(spark, sf))


def sketch(spark, sf):
    return kmers.probabilities(kmers.crc_counts(V.reads(spark, sf), V.K, V.DIM, 1, "read", ("sample",)))


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def hashed(spark, sf):
    docs = V.reads(spark, sf)
    return kmers.hashed_counts(docs, 13, 65536, canonical=True)


def nei_zero_row(spark, sf):
    """The nations' profiles and a row of zeros, which counts as uniform."""
    zero = spark.createDataFrame([("NOWHERE", "none", 0)], "sample string, bin string, n bigint")
    rows = V.profiles(spark, sf).unionByName(zero)
    return rounded(distance.nei_like(distance.normalised_rows(rows), rows, 15), "d")


QUERIES = {
    "manifest": manifest,
    "depth_groups": lambda s, d: qc.depth_groups(manifest(s, d)),
    "qc_reads": lambda s, d: rounded(qc.qc_reads(V.reads_with_quality(s, d)), "mean_len", "sd_len", "gc_frac", "n_frac", "mean_phred", "q30_frac"),
    "qc_both_mates": lambda s, d: rounded(qc.both_mates(qc.qc_reads(V.reads_with_quality(s, d))).select("sample", "R1_reads_used", "R2_reads_used", "gc_frac", "mean_phred"), "gc_frac", "mean_phred"),
    "qc_positions": lambda s, d: rounded(qc.qc_positions(V.reads_with_quality(s, d)), "mean_q"),
    "qc_group_profile": lambda s, d: rounded(qc.group_profile(qc.qc_positions(V.reads_with_quality(s, d)), qc.depth_groups(manifest(s, d))), "mean_q"),
    "prefix_top": lambda s, d: rounded(qc.prefix_top(V.reads(s, d), 4), "pct"),
    "tail_top": lambda s, d: rounded(qc.tail_top(V.reads(s, d), 4), "pct"),
    "end_kmers": lambda s, d: rounded(qc.end_kmers(V.reads(s, d), 4), "pct"),
    "adapter_hits": lambda s, d: rounded(qc.adapter_hits(V.reads(s, d), ("ACGTA", "CGTTA", "GATC", "AATGA", "CAAGC")), "pct"),
    "poly_g_tails": lambda s, d: rounded(qc.poly_g_tails(V.reads(s, d)), "pct"),
    "length_stats": lambda s, d: rounded(qc.length_stats(V.reads(s, d)), "mean_len"),
    "base_entropy": lambda s, d: rounded(qc.entropy_bits(V.reads(s, d).select("sample", F.substring("seq", 1, 1).alias("base")), ["sample"], "base"), "entropy"),
    "prefix_entropy": lambda s, d: rounded(qc.entropy_bits(V.reads(s, d).select("sample", F.substring("seq", 1, 4).alias("prefix")), ["sample"], "prefix"), "entropy"),
    "kmer_bins": crc,
    "kmer_probabilities": lambda s, d: rounded(combined(s, d), "p"),
    "kmer_sketch": lambda s, d: rounded(sketch(s, d), "p"),
    "kmer_hashed": hashed,
    "kmer_entropy": lambda s, d: rounded(kmers.entropy(combined(s, d)), "kmer_entropy"),
    "js_distance": lambda s, d: rounded(distance.js_log_eps(p := combined(s, d), p), "d"),
    "js_distance_clip": lambda s, d: rounded(distance.js_clip(p := sketch(s, d), p, V.DIM), "d"),
    "js_matrix": lambda s, d: rounded(distance.js_clip(distance.normalised_rows(V.profiles(s, d)), V.profiles(s, d), 15), "d"),
    "cosine": lambda s, d: rounded(distance.cosine(p := kmers.probabilities(V.profiles(s, d)), p), "cos"),
    "nei_like": lambda s, d: rounded(distance.nei_like(p := kmers.probabilities(V.profiles(s, d)), p, 15), "d"),
    "nei_zero_row": nei_zero_row,
}

MANIFEST = """
SELECT source AS sample, CAST(sum(CASE WHEN doc_id % 2 = 0 THEN n_chars ELSE 0 END) AS BIGINT) AS r1_bytes,
       CAST(sum(CASE WHEN doc_id % 2 = 1 THEN n_chars ELSE 0 END) AS BIGINT) AS r2_bytes, CAST(sum(n_chars) AS BIGINT) AS total_bytes
FROM documents WHERE source IS NOT NULL GROUP BY source"""

GROUPS = f"""
man AS ({MANIFEST}),
srt AS (SELECT sample, row_number() OVER w AS i, sum(ln(1 + total_bytes)) OVER (w ROWS UNBOUNDED PRECEDING) AS s, count(*) OVER () AS n, sum(ln(1 + total_bytes)) OVER () AS t
        FROM man WINDOW w AS (ORDER BY ln(1 + total_bytes), sample)),
gains AS (SELECT *, CASE WHEN i < n THEN round(s * s / i + (t - s) * (t - s) / (n - i) - t * t / n, 9) ELSE 0 END AS gain FROM srt),
cut AS (SELECT CASE WHEN gain > 0 THEN i ELSE 0 END AS cut FROM gains ORDER BY gain DESC, i LIMIT 1),
grp AS (SELECT sample, CASE WHEN i > cut THEN 'HiDepth' ELSE 'LoDepth' END AS depth_group FROM gains, cut)"""

QC_SQL = """
per AS (SELECT sample, mate, length(seq) AS n, length(seq) - length(replace(replace(seq, 'G', ''), 'C', '')) AS gc, length(seq) - length(replace(seq, 'N', '')) AS ns,
               list_sum(q) AS qs, len(list_filter(q, lambda x: x >= 30)) AS q30 FROM scored),
qc AS (SELECT sample, mate, count(*) AS reads_used, CAST(sum(n) AS BIGINT) AS bases_used, avg(n) AS mean_len, coalesce(stddev_samp(n), 0) AS sd_len,
       sum(gc) / sum(n) AS gc_frac, sum(ns) / sum(n) AS n_frac, sum(qs) / sum(n) AS mean_phred, sum(q30) / sum(n) AS q30_frac FROM per GROUP BY ALL)"""

POS_SQL = """pos AS (SELECT sample, mate, CAST(i AS INTEGER) AS pos, avg(x) AS mean_q, count(*) AS n
  FROM (SELECT sample, mate, unnest(q) AS x, unnest(range(len(q))) AS i FROM scored) GROUP BY ALL)"""


def top_sql(expr: str, name: str, extra: str = "", where: str = "true") -> str:
    by = "sample" + (", side" if extra else "")
    return R + f"""
SELECT {by}, {name}, n, round(100.0 * n / tot, 6) AS pct, CAST(r AS INTEGER) AS rank FROM (
  SELECT {by}, {name}, n, sum(n) OVER (PARTITION BY {by}) AS tot, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, {name}) AS r FROM (
    SELECT {by}, {name}, count(*) AS n FROM ({expr}) GROUP BY ALL)) WHERE r <= 10"""


def entropy_sql(expr: str) -> str:
    return R + f"""
SELECT sample, round(-sum(p * log2(p)) + 0.0, 6) AS entropy FROM (
  SELECT sample, n / sum(n) OVER (PARTITION BY sample) AS p FROM (SELECT sample, {expr} AS x, count(*) AS n FROM reads GROUP BY ALL)) GROUP BY sample"""


CLIP = """
zs AS (SELECT sample, sum(greatest(least(p, 1), 1e-12)) + ({dim} - count(*)) * 1e-12 AS z FROM probs GROUP BY sample),
grid AS (SELECT zs.sample, g.bin, greatest(coalesce(p, 0), 1e-12) / z AS p FROM zs CROSS JOIN ({bins}) g LEFT JOIN probs ON probs.sample = zs.sample AND probs.bin = g.bin)
SELECT x.sample AS a, y.sample AS b, round(sqrt(greatest(sum(0.5 * (x.p * ln(x.p / ((x.p + y.p) / 2)) + y.p * ln(y.p / ((x.p + y.p) / 2)))), 0)), 6) AS d
FROM grid x JOIN grid y ON x.bin = y.bin AND x.sample < y.sample GROUP BY ALL"""

COSINE = "WITH " + V.PROFILES + """,
nrm AS (SELECT sample, greatest(sqrt(sum(p * p)), 1e-12) AS nrm FROM probs GROUP BY sample),
cs AS (SELECT x.sample AS a, y.sample AS b, greatest(least(coalesce((SELECT sum(p.p * q.p) FROM probs p JOIN probs q ON p.bin = q.bin WHERE p.sample = x.sample AND q.sample = y.sample), 0) / (x.nrm * y.nrm), 1), -1) AS cos
       FROM nrm x JOIN nrm y ON x.sample < y.sample)
"""

ORACLES = {
    "manifest": MANIFEST,
    "depth_groups": "WITH " + GROUPS + " SELECT sample, depth_group FROM grp",
    "qc_reads": RQ + "," + QC_SQL + " SELECT sample, mate, reads_used, bases_used, round(mean_len, 6) AS mean_len, round(sd_len, 6) AS sd_len, round(gc_frac, 6) AS gc_frac, round(n_frac, 6) AS n_frac, round(mean_phred, 6) AS mean_phred, round(q30_frac, 6) AS q30_frac FROM qc",
    "qc_both_mates": RQ + "," + QC_SQL + """
SELECT sample, max(CASE WHEN mate = 1 THEN reads_used END) AS R1_reads_used, max(CASE WHEN mate = 2 THEN reads_used END) AS R2_reads_used,
       round(0.5 * (max(CASE WHEN mate = 1 THEN gc_frac END) + max(CASE WHEN mate = 2 THEN gc_frac END)), 6) AS gc_frac,
       round(0.5 * (max(CASE WHEN mate = 1 THEN mean_phred END) + max(CASE WHEN mate = 2 THEN mean_phred END)), 6) AS mean_phred FROM qc GROUP BY sample""",
    "qc_positions": RQ + "," + POS_SQL + " SELECT sample, mate, pos, round(mean_q, 6) AS mean_q, n FROM pos",
    "qc_group_profile": RQ + "," + POS_SQL + "," + GROUPS + " SELECT depth_group, mate, pos, round(avg(mean_q), 6) AS mean_q FROM pos JOIN grp USING (sample) GROUP BY ALL",
    "prefix_top": top_sql("SELECT sample, substring(seq, 1, 4) AS prefix FROM reads", "prefix"),
    "tail_top": top_sql("SELECT sample, right(seq, 4) AS tail FROM reads", "tail"),
    "end_kmers": top_sql("SELECT sample, 5 AS side, left(seq, 4) AS kmer FROM reads WHERE length(seq) >= 4 UNION ALL SELECT sample, 3, right(seq, 4) FROM reads WHERE length(seq) >= 4", "kmer", "side"),
    "adapter_hits": R + " SELECT sample, motif, count(CASE WHEN contains(seq, motif) THEN 1 END) AS n, round(100.0 * count(CASE WHEN contains(seq, motif) THEN 1 END) / count(*), 6) AS pct FROM reads, (SELECT unnest(['ACGTA', 'CGTTA', 'GATC', 'AATGA', 'CAAGC']) AS motif) GROUP BY ALL",
    "poly_g_tails": R + """
SELECT sample, count(CASE WHEN g THEN 1 END) AS n, round(100.0 * count(CASE WHEN g THEN 1 END) / count(*), 6) AS pct
FROM (SELECT sample, length(right(seq, 12)) - length(replace(right(seq, 12), 'G', '')) >= greatest(8, floor(0.8 * length(right(seq, 12)))) AS g FROM reads) GROUP BY sample""",
    "length_stats": R + """
SELECT sample, count(*) AS reads, min(length(seq)) AS min_len, max(length(seq)) AS max_len, round(avg(length(seq)), 6) AS mean_len,
       list_sort(list(length(seq)))[1 + count(*) // 2] AS median_len, count(DISTINCT length(seq)) AS unique_lengths FROM reads GROUP BY sample""",
    "base_entropy": entropy_sql("substring(seq, 1, 1)"),
    "prefix_entropy": entropy_sql("substring(seq, 1, 4)"),
    "kmer_bins": KM + " SELECT sample, mate, bin, n FROM binned",
    "kmer_probabilities": KM + "," + COMBINED + " SELECT sample, bin, round(p, 6) AS p FROM probs",
    "kmer_sketch": KS + "," + SKETCH + " SELECT sample, bin, round(p, 6) AS p FROM probs",
    "kmer_hashed": R + """,
km AS (SELECT sample, kmer, count(*) AS n FROM (SELECT sample, substring(seq, CAST(i + 1 AS BIGINT), 13) AS kmer FROM (SELECT sample, seq, unnest(range(0, length(seq) - 12)) AS i FROM reads)) WHERE NOT contains(kmer, 'N') GROUP BY ALL),
two AS (SELECT sample, n, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(translate(kmer, 'ACGT', '0123'), ''), lambda c: CAST(c AS BIGINT))), lambda a, c: a * 4 + c) AS fw,
               list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(translate(reverse(kmer), 'ACGT', '3210'), ''), lambda c: CAST(c AS BIGINT))), lambda a, c: a * 4 + c) AS rc FROM km),
h0 AS (SELECT sample, n, CAST(least(fw, rc) AS UBIGINT) AS x FROM two),
h1 AS (SELECT sample, n, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM h0),
h2 AS (SELECT sample, n, CAST((CAST(xor(x, x >> 33) AS UHUGEINT) * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT) AS x FROM h1)
SELECT sample, CAST(xor(x, x >> 33) % 65536 AS INTEGER) AS bin, CAST(sum(n) AS BIGINT) AS n FROM h2 GROUP BY ALL""",
    "kmer_entropy": KM + "," + COMBINED + " SELECT sample, round(-sum(p * ln(p + 1e-12)), 6) AS kmer_entropy FROM probs GROUP BY sample",
    "js_distance": KM + "," + COMBINED + "," + V.JS + " SELECT a, b, round(d, 6) AS d FROM dist",
    "js_distance_clip": KS + "," + SKETCH + "," + CLIP.format(dim=V.DIM, bins=f"SELECT unnest(range({V.DIM})) AS bin"),
    "js_matrix": "WITH " + V.PROFILES + "," + CLIP.format(dim=15, bins="SELECT DISTINCT bin FROM probs"),
    "cosine": COSINE + " SELECT a, b, round(cos, 6) AS cos FROM cs",
    "nei_zero_row": COSINE + """, nm AS (SELECT sample, sqrt(sum(p * p)) AS norm FROM probs GROUP BY sample)
SELECT a, b, round(-ln(greatest(least(cos, 1), 1e-12)) + 0.0, 6) AS d FROM cs
UNION ALL SELECT sample, 'NOWHERE', round(ln(norm * sqrt(15)), 6) FROM nm""",
    "nei_like": COSINE + " SELECT a, b, round(-ln(greatest(least(cos, 1), 1e-12)) + 0.0, 6) AS d FROM cs",
}
