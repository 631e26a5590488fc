"""The driver tables seen as samples and reads, in Spark and as SQL common table expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz."
BASES = "ACGTACGTACGTACGTACGTACGTACN"
READ = 100  # bases of a read
TO_BASES = bytes.maketrans((LETTERS + LETTERS.upper()).encode(), (BASES + BASES).encode())
NO_BASES = bytes(set(range(256)) - set((LETTERS + LETTERS.upper()).encode()))
K, STEP, DIM = 11, 4, 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cut(spark: SparkSession, sf_dir: str, quality: bool) -> DataFrame:
    """The reads of the documents, made in one pass over each text: a task holds a batch of texts and the reads of 256."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL AND source IS NOT NULL")
    docs = docs.select(F.col("source").alias("sample"), (1 + F.col("doc_id") % 2).cast("int").alias("mate"), "doc_id", F.col("text").cast("binary").alias("text"))
    names = ["sample", "mate", "doc_id", "chunk", "seq"] + ["qual"] * quality

    def cut(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                b = whole.slice(first, 256)
                text = [t.translate(TO_BASES, NO_BASES) for t in b.column("text").to_pylist()]
                size = np.fromiter(map(len, text), dtype=np.int64, count=len(text))
                chunks = -(-size // READ)
                row = np.repeat(np.arange(len(text)), chunks)
                chunk = np.arange(len(row)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                flat = b"".join(text)
                ends = np.append((np.cumsum(size) - size)[row] + READ * chunk, len(flat)).astype(np.int32)
                strings = lambda data: pa.StringArray.from_buffers(len(row), pa.py_buffer(ends), pa.py_buffer(data))  # noqa: B023, E731
                columns = [*(b.column(c).take(pa.array(row)) for c in names[:3]), pa.array(chunk.astype(np.int32)), strings(flat)]
                if quality:
                    base = np.frombuffer(flat, dtype=np.uint8).astype(np.int32)
                    place = np.arange(len(flat), dtype=np.int32) - np.repeat(ends[:-1], np.diff(ends))
                    columns.append(strings((33 + (base * 7 + place) % 41).astype(np.uint8)))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    return docs.mapInArrow(cut, f"sample {kinds['sample']}, mate int, doc_id {kinds['doc_id']}, chunk int, seq string" + ", qual string" * quality)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as reads: letters and full stops become bases, cut into reads of 100; a source is a sample and
    odd documents are mate 2."""
    return _cut(spark, sf_dir, False)


def reads_with_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with a quality string: score (7 ascii(base) + position) mod 41."""
    return _cut(spark, sf_dir, True)


READS = f"""
reads AS (
  SELECT source AS sample, CAST(1 + doc_id % 2 AS INTEGER) AS mate, doc_id, chunk, substring(s, CAST(1 + {READ} * chunk AS BIGINT), {READ}) AS seq
  FROM (SELECT source, doc_id, s, unnest(range(CAST(ceil(length(s) / {READ}.0) AS BIGINT))) AS chunk
        FROM (SELECT source, doc_id, translate(lower(regexp_replace(text, '[^a-zA-Z.]', '', 'g')), '{LETTERS}', '{BASES}') AS s
              FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)))"""

SCORES = """
scored AS (
  SELECT *, list_transform(range(length(seq)), lambda i: (ascii(substring(seq, i + 1, 1)) * 7 + i) % 41) AS q FROM reads)"""

CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(kmer, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0,0,0,0,0,0,0,0] AS BIGINT[])), lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END))"""


def kmers_sql(k: int, step: int, where: str, reads_where: str = "true") -> str:
    """CTEs kmers (sample, mate, kmer, n) and binned (sample, mate, bin, n)."""
    return f"""
kmers AS (
  SELECT sample, mate, kmer, count(*) AS n FROM (
    SELECT sample, mate, substring(seq, CAST(i + 1 AS BIGINT), {k}) AS kmer FROM (SELECT sample, mate, seq, unnest(range(0, length(seq) - {k} + 1, {step})) AS i FROM reads WHERE {reads_where}))
  WHERE {where} GROUP BY ALL),
crcs AS (SELECT kmer, CAST(xor({CRC}, 4294967295) % {DIM} AS INTEGER) AS bin FROM (SELECT DISTINCT kmer FROM kmers)),
binned AS (SELECT sample, mate, bin, CAST(sum(n) AS BIGINT) AS n FROM kmers JOIN crcs USING (kmer) GROUP BY ALL)"""


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, bin, n): nations by the priority and status of their customers' orders."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.concat_ws("|", "o_orderpriority", "o_orderstatus").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("sample"), "bin", "n")


PROFILES = """
prof AS (
  SELECT n_name AS sample, o_orderpriority || '|' || o_orderstatus AS bin, count(*) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
probs AS (SELECT sample, bin, n / sum(n) OVER (PARTITION BY sample) AS p FROM prof)"""

# Distances of the probabilities in the CTE `probs`, written out bin by bin.
JS = """
kl AS (
  SELECT x.sample AS s, y.sample AS t, sum(x.p * ln((x.p + 1e-12) / ((x.p + coalesce(z.p, 0)) / 2 + 1e-12))) AS v
  FROM probs x CROSS JOIN (SELECT DISTINCT sample FROM probs) y LEFT JOIN probs z ON z.sample = y.sample AND z.bin = x.bin
  WHERE x.sample <> y.sample GROUP BY ALL),
dist AS (
  SELECT p.s AS a, p.t AS b, sqrt(greatest(0.5 * p.v + 0.5 * q.v, 0)) AS d FROM kl p JOIN kl q ON p.s = q.t AND p.t = q.s WHERE p.s < p.t),
both_ways AS (SELECT a AS u, b AS v, d FROM dist UNION ALL SELECT b, a, d FROM dist)"""

KNN = """
near AS (SELECT u, v, d, row_number() OVER (PARTITION BY u ORDER BY d, v) AS r FROM both_ways),
edges AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(d) AS d FROM near WHERE r <= 4 GROUP BY ALL),
adj AS (SELECT u, v, d FROM edges UNION ALL SELECT v, u, d FROM edges)"""


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, ground_truth, y, score): labelled documents; a toxic one counts as pool, its score is n_chars
    in units of 500 characters, so that ties occur."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    y = F.col("toxic").cast("int")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("sample"), F.when(y == 1, "pool").otherwise("individual").alias("ground_truth"), y.alias("y"), F.floor(F.col("n_chars") / 500).cast("double").alias("score")
    )


LABELS = """
scored AS (
  SELECT CAST(doc_id AS VARCHAR) AS sample, CASE WHEN toxic = 1 THEN 'pool' ELSE 'individual' END AS ground_truth,
         CAST(toxic AS INTEGER) AS y, CAST(floor(n_chars / 500) AS DOUBLE) AS score
  FROM documents JOIN labels USING (doc_id))"""
