"""The smaller programs as functions: the matrix visualiser, the FASTQ report and the k-mer matrix of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlab.operators import distance, kmers, qc, spectral
from skeinlab.sources import fastq, figures


def visualise(values: DataFrame, samples: DataFrame, dim: int, metric: str = "jsd", axes: int = 2, scores: DataFrame | None = None, score: str = "mixture_score", groups: DataFrame | None = None, group: str | None = None, tree: bool = False) -> dict[str, DataFrame]:
    """Distances (a, b, d), pcoa (sample_id, PC1, ...), merged (with the score and group columns of the given tables,
    null where a sample lacks), centroids of the groups, and the neighbour-joining tree, of a matrix of non-negative
    features (sample, bin, n) with dim columns.

    metric: jsd (the root of the Jensen-Shannon divergence of the rows' shares) or nei (-ln of their cosine)."""
    if metric not in ("jsd", "nei"):
        raise ValueError(metric)
    shares = distance.normalised_rows(values)
    dist = distance.js_clip(shares, samples, dim) if metric == "jsd" else distance.nei_like(shares, samples, dim)
    names = [f"PC{i}" for i in range(1, axes + 1)]
    wide = spectral.pcoa(dist, samples, axes).groupBy("sample").pivot("axis", list(range(1, axes + 1))).agg(F.first("value")).toDF("sample_id", *names)
    merged = wide
    for table, column in ((scores, score), (groups, group)):
        if table is not None and column in table.columns:
            merged = merged.join(table.select(F.col("sample_id").cast("string").alias("sample_id"), column), "sample_id", "left")
    out = {"distance": dist, "pcoa": wide, "merged": merged}
    if group and group in merged.columns and axes > 1:
        out["centroids"] = figures.group_centroids(merged, group)
    if tree:
        out["tree"] = spectral.neighbour_joining(dist, samples)
    return out


def fastq_report(reads: DataFrame, prefix_len: int = 12, tail_len: int = 12, k: int = 17, top: int = 10) -> dict[str, DataFrame]:
    """The report on read ends, adapters and lengths of reads (sample, seq); a file counts as a sample."""
    first = reads.filter(F.length("seq") > 0).select("sample", F.substring("seq", 1, 1).alias("base"))
    prefixes = reads.select("sample", F.substring("seq", 1, prefix_len).alias("prefix"))
    return {
        "lengths": qc.length_stats(reads),
        "end_bases": qc.end_bases(reads),
        "first_base_entropy": qc.entropy_bits(first, ["sample"], "base"),
        "prefix_entropy": qc.entropy_bits(prefixes, ["sample"], "prefix"),
        "prefixes": qc.prefix_top(reads, prefix_len, top),
        "tails": qc.tail_top(reads, tail_len, top),
        "adapters": qc.adapter_hits(reads),
        "poly_g": qc.poly_g_tails(reads, tail_len),
        "end_kmers": qc.end_kmers(reads, k, top),
        "hints": qc.hints(reads, prefix_len, tail_len),
    }


def folder_report(spark: SparkSession, folder: str, n_reads: int = 50_000, **settings) -> dict[str, DataFrame]:
    """fastq_report on every FASTQ file below a folder, a file a sample; no file is an error."""
    found = fastq.files(spark, folder, recursive=True)
    if found.isEmpty():
        raise FileNotFoundError(f"no FASTQ file in {folder}")
    reads = fastq.read_fastq(spark, [r.path for r in found.select("path").collect()], "qc", n_reads)
    return fastq_report(reads.select(F.col("path").alias("sample"), "seq"), **settings)


def kmer_matrix(spark: SparkSession, folder: str, pattern: str = "*.fastq.gz", k: int = 17, dim: int = 262144, n_reads: int = 20_000, canonical: bool = False, trim5: int = 0, trim3: int = 0) -> DataFrame:
    """sample, bin, n of the files of a folder whose names match the pattern, mates and lanes of a sample together;
    n_reads of each file (0: all). sinks.write_npz writes it as a matrix. No file is an error."""
    found = fastq.files(spark, folder, pattern=pattern)
    if found.isEmpty():
        raise FileNotFoundError(f"no file matches {pattern} in {folder}")
    reads = fastq.read_fastq(spark, [r.path for r in found.select("path").collect()], "matrix", n_reads)
    return kmers.hashed_counts(reads.select(fastq.sample_of(F.col("path")).alias("sample"), "seq"), k, dim, canonical, trim5, trim3)
