"""Hashed k-mer histograms as sparse long tables (sample, bin, n or p)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skeinlab.functions import sequence as S


CELLS = 1 << 23  # counts that a task holds at most


def numbered(batch: pa.RecordBatch, by: tuple[str, ...]) -> tuple[list[tuple], np.ndarray]:
    """The distinct values of the columns `by` in a batch and the number of each row's."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
    number = {k: i for i, k in enumerate(dict.fromkeys(keys))}
    return list(number), np.fromiter(map(number.__getitem__, keys), dtype=np.int64, count=len(keys))


def _counted(rows: DataFrame, by: tuple[str, ...], dim: int, bins: Callable[[list[bytes]], np.ndarray]) -> DataFrame:
    """by, bin, n of reads (by, seq), where `bins` gives the bins of the k-mers of some reads.

    A task holds the counts of its keys as arrays of dim, CELLS numbers at most, and passes them on at its end; the
    counts of further keys are passed on batch by batch. So a shuffle gets a row for each key and bin of a task, or of a
    batch, never a k-mer."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    rows = rows.select(*by, F.col("seq").cast("binary").alias("seq")).filter("seq IS NOT NULL")

    def count(batches):
        held, types = {}, None

        def out(key, found, n):
            values = [pa.array([v] * len(found), t) for v, t in zip(key, types, strict=True)]
            return pa.RecordBatch.from_arrays([*values, pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], names=[*by, "bin", "n"])

        for b in batches:
            types = [b.column(c).type for c in by]
            keys, number = numbered(b, by)
            order = np.argsort(number, kind="stable")
            seqs = b.column("seq").to_pylist()
            for group in np.split(order, np.flatnonzero(np.diff(number[order])) + 1):
                if not len(group):
                    continue
                key, found = keys[number[group[0]]], bins([seqs[i] for i in group.tolist()])
                if key not in held and (len(held) + 1) * dim <= CELLS:
                    held[key] = np.zeros(dim, dtype=np.int64)
                if key in held and 16 * len(found) >= dim:
                    held[key] += np.bincount(found, minlength=dim)
                    continue
                found, n = np.unique(found, return_counts=True)
                if key in held:
                    held[key][found] += n
                else:
                    yield out(key, found, n)
        for key, n in held.items():
            found = np.flatnonzero(n)
            yield out(key, found, n[found])

    kinds = ", ".join(f"{c} {kinds[c]}" for c in by)
    return rows.mapInArrow(count, f"{kinds}, bin int, n bigint").groupBy(*by, "bin").agg(F.sum("n").alias("n"))


def crc_counts(reads: DataFrame, k: int = 21, dim: int = 16384, step: int = 4, drop: str = "kmer", by: tuple[str, ...] = ("sample", "mate")) -> DataFrame:
    """by, bin, n: CRC-32 of each k-mer modulo dim. drop="kmer" leaves out the k-mers with an N, drop="read" the
    reads with one. K-mers are hashed and counted in the tasks that hold the reads; only counts are shuffled."""
    if drop not in ("kmer", "read"):
        raise ValueError(drop)
    rows = reads.select(*by, F.upper("seq").alias("seq"))
    if drop == "read":
        rows = rows.filter(~F.contains("seq", F.lit("N")))
    without = b"N" if drop == "kmer" else None
    return _counted(rows, by, dim, lambda texts: S.crc_bins(texts, k, dim, step, without))


def hashed_counts(reads: DataFrame, k: int = 17, dim: int = 262144, canonical: bool = False, trim5: int = 0, trim3: int = 0) -> DataFrame:
    """sample, bin, n of 2-bit k-mers (k <= 31) under the 64-bit mix; k-mers with other letters are left out;
    canonical takes the lesser of a k-mer and its reverse complement. All files of a sample add up. K-mers are hashed
    and counted in the tasks that hold the reads; only counts are shuffled."""
    if not 1 <= k <= 31:
        raise ValueError("k must be 1 to 31")
    if not 1 <= dim < 1 << 31:
        raise ValueError("bins are 32-bit numbers")
    rows = reads.select("sample", S.trimmed(F.upper("seq"), trim5, trim3).alias("seq"))
    return _counted(rows, ("sample",), dim, lambda texts: S.hashed_bins(b"\n".join(texts), k, dim, canonical).astype(np.int64))


def probabilities(counts: DataFrame, by: tuple[str, ...] = ("sample",), value: str = "n") -> DataFrame:
    """by, bin, p: values over their sum."""
    return counts.select(*by, "bin", (F.col(value) / F.sum(value).over(Window.partitionBy(*by))).alias("p"))


def mates_combined(counts: DataFrame) -> DataFrame:
    """sample, bin, p: each mate's probabilities with equal weight, renormalised."""
    mates = probabilities(counts, ("sample", "mate"))
    return probabilities(mates.groupBy("sample", "bin").agg(F.sum("p").alias("s")), value="s")


def entropy(probs: DataFrame, eps: float = 1e-12) -> DataFrame:
    """sample, kmer_entropy in nats."""
    return probs.groupBy("sample").agg((-F.sum(F.col("p") * F.ln(F.col("p") + eps))).alias("kmer_entropy"))
