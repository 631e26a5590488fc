"""Read QC: aggregates by sample and mate, quality by position, and the frequency reports of read ends."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skeinlab.functions import sequence as S
from skeinlab.operators.kmers import numbered


BASES = 1 << 18  # bases whose scores a task holds at a time
KEPT = 1 << 21  # sums that a task holds before it passes them on


def _pieces(batches):
    """Rows of the batches (len, ...), as many together as have about BASES bases, one at least."""
    for b in batches:
        part = np.cumsum(b.column("len").fill_null(0).to_numpy(zero_copy_only=False)) // BASES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        yield from (b.slice(first, last - first) for first, last in pairwise(cuts) if last > first)


def _scores(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Number of Phred+33 scores of each row of a batch (len, qual), and all scores: what lies below '!' wraps to
    223..255, characters beyond ASCII are dropped, and scores are cut to the length of the sequence."""
    quals = [(q or "").encode("ascii", "ignore").replace(b"\0", b"") for q in batch.column("qual").to_pylist()]
    most = batch.column("len").fill_null(0).to_numpy(zero_copy_only=False)
    size = np.minimum(np.fromiter(map(len, quals), dtype=np.int64, count=len(quals)), most)
    text = np.frombuffer(b"".join([q[:n] for q, n in zip(quals, size.tolist(), strict=True)]), dtype=np.uint8)
    return size, text - np.uint8(33)


def qc_reads(reads: DataFrame) -> DataFrame:
    """sample, mate, reads_used, bases_used, mean_len, sd_len, gc_frac, n_frac, mean_phred, q30_frac.

    Base counts are over the whole upper-case read; quality over the shorter of read and quality. One read
    has sd_len 0. A sample without reads has no row. Each task gives one row of sums for a sample and mate."""
    seq = F.upper("seq")
    names = ["n", "nn", "gc", "ns", "reads"]
    rows = reads.select("sample", "mate", F.length("seq").cast("long").alias("len"), (S.count_char(seq, "G") + S.count_char(seq, "C")).alias("gc"), S.count_char(seq, "N").alias("ns"), "qual")
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}

    def sums(batches):
        held, types = {}, None

        def out():
            values = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*values, *map(pa.array, np.array(list(held.values())).T)], names=["sample", "mate", *names, "qn", "qsum", "q30"])

        for b in _pieces(batches):
            types = [b.column(c).type for c in ("sample", "mate")]
            keys, group = numbered(b, ("sample", "mate"))
            size, q = _scores(b)
            ends = np.cumsum(size)
            of_read = lambda x: np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[np.append(0, ends)])  # noqa: B023, E731
            n, gc, ns = (b.column(c).fill_null(0).to_numpy(zero_copy_only=False) for c in ("len", "gc", "ns"))
            total = np.zeros((len(keys), 8), dtype=np.int64)
            np.add.at(total, group, np.stack([n, n * n, gc, ns, np.ones_like(n), size, of_read(q), of_read(q >= 30)], axis=1))
            for key, x in zip(keys, total, strict=True):
                held[key] = held.get(key, 0) + x
            if 8 * len(held) > KEPT:
                yield out()
                held.clear()
        if held:
            yield out()

    found = rows.mapInArrow(sums, f"sample {kinds['sample']}, mate {kinds['mate']}, " + ", ".join(f"{c} bigint" for c in [*names, "qn", "qsum", "q30"]))
    found = found.groupBy("sample", "mate").agg(*[F.sum(c).alias(c) for c in [*names, "qn", "qsum", "q30"]])
    share = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    # whole numbers up to the last division
    square = (F.col("reads") * F.col("nn") - F.col("n") * F.col("n")) / F.nullif(F.col("reads") * (F.col("reads") - 1), F.lit(0))
    return found.select(
        "sample", "mate", F.col("reads").alias("reads_used"), F.col("n").alias("bases_used"), share("n", "reads").alias("mean_len"), F.coalesce(F.sqrt(square), F.lit(0.0)).alias("sd_len"),
        share("gc", "n").alias("gc_frac"), share("ns", "n").alias("n_frac"), share("qsum", "qn").alias("mean_phred"), share("q30", "qn").alias("q30_frac"),
    )


def both_mates(qc: DataFrame) -> DataFrame:
    """One row per sample: R1_ and R2_ columns and the means of the mates' gc_frac and mean_phred."""
    names = ["reads_used", "mean_len", "gc_frac", "n_frac", "mean_phred", "q30_frac"]
    wide = qc.groupBy("sample").agg(*[F.max(F.when(F.col("mate") == m, F.col(c))).alias(f"R{m}_{c}") for m in (1, 2) for c in names])
    mean = lambda c: (0.5 * (F.col(f"R1_{c}") + F.col(f"R2_{c}"))).alias(c)
    return wide.select("*", mean("gc_frac"), mean("mean_phred"))


def qc_positions(reads: DataFrame) -> DataFrame:
    """sample, mate, pos, mean_q, n: mean quality over the reads that reach a position. Each task gives one row of
    sums for a sample, mate and position."""
    rows = reads.select("sample", "mate", F.length("seq").cast("long").alias("len"), "qual")
    kinds = {f.name: f.dataType.simpleString() for f in reads.schema.fields}

    def sums(batches):
        held, types = {}, None

        def out():
            for key, sums in held.items():
                at = np.flatnonzero(sums[0])
                values = [pa.array([v] * len(at), t) for v, t in zip(key, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*values, pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["sample", "mate", "pos", "n", "total"])

        for b in _pieces(batches):
            types = [b.column(c).type for c in ("sample", "mate")]
            keys, group = numbered(b, ("sample", "mate"))
            size, q = _scores(b)
            width = int(size.max())
            cell = np.repeat(group * width - (np.cumsum(size) - size), size) + np.arange(len(q))
            if len(keys) * width <= 4 * BASES:
                n, total = np.bincount(cell), np.bincount(cell, weights=q)
                at = np.flatnonzero(n)
                n, total = n[at], total[at]
            else:
                at, place, n = np.unique(cell, return_inverse=True, return_counts=True)
                total = np.bincount(place, weights=q)
            for i, (first, last) in enumerate(pairwise(np.searchsorted(at, np.arange(len(keys) + 1) * width).tolist())):
                if first == last:
                    continue
                pos, old = at[first:last] - i * width, held.get(keys[i], np.zeros((2, 0), dtype=np.int64))
                if old.shape[1] <= pos[-1]:
                    old = np.pad(old, ((0, 0), (0, int(pos[-1]) + 1 - old.shape[1])))
                old[0, pos] += n[first:last]
                old[1, pos] += total[first:last].astype(np.int64)
                held[keys[i]] = old
            if sum(x.size for x in held.values()) > KEPT:
                yield from out()
                held.clear()
        yield from out()

    found = rows.mapInArrow(sums, f"sample {kinds['sample']}, mate {kinds['mate']}, pos int, n bigint, total bigint")
    return found.groupBy("sample", "mate", "pos").agg((F.sum("total") / F.sum("n")).alias("mean_q"), F.sum("n").alias("n"))


def group_profile(positions: DataFrame, groups: DataFrame) -> DataFrame:
    """Unweighted mean of the samples' profiles by depth_group, mate and pos."""
    return positions.join(groups, "sample").groupBy("depth_group", "mate", "pos").agg(F.avg("mean_q").alias("mean_q"))


def depth_groups(manifest: DataFrame) -> DataFrame:
    """sample, depth_group: exact two-means of ln(1 + total_bytes) in one dimension; the upper group is HiDepth.

    Of all cuts of the sorted values the one of least squared error, by running sums; equal samples all are
    HiDepth. One row per sample goes through the unpartitioned windows."""
    rows = manifest.select("sample", F.log1p(F.col("total_bytes").cast("double")).alias("x"))
    up = Window.orderBy("x", "sample").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    s = rows.withColumns({"i": F.count(F.lit(1)).over(up), "s": F.sum("x").over(up), "n": F.count(F.lit(1)).over(whole), "t": F.sum("x").over(whole)})
    rest = F.nullif(F.col("n") - F.col("i"), F.lit(0))
    # what a cut after row i takes off the squared error of one group
    s = s.withColumn("gain", F.coalesce(F.round(F.col("s") * F.col("s") / F.col("i") + (F.col("t") - F.col("s")) * (F.col("t") - F.col("s")) / rest - F.col("t") * F.col("t") / F.col("n"), 9), F.lit(0.0)))
    best = F.max(F.struct("gain", -F.col("i"))).over(whole)
    s = s.withColumn("cut", F.when(best["gain"] > 0, -best["col2"]).otherwise(0))
    return s.select("sample", F.when(F.col("i") > F.col("cut"), "HiDepth").otherwise("LoDepth").alias("depth_group"))


def top_counts(keys: DataFrame, by: list[str], key: str, n: int) -> DataFrame:
    """The n most frequent keys of each group: by, key, n, pct of the group's rows, rank; ties by key."""
    counted = keys.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), key)
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = counted.withColumns({"pct": 100.0 * F.col("n") / total, "rank": F.row_number().over(order)})
    return ranked.filter(F.col("rank") <= n)


def prefix_top(reads: DataFrame, length: int = 12, n: int = 10) -> DataFrame:
    return top_counts(reads.select("sample", S.prefix(F.col("seq"), length).alias("prefix")), ["sample"], "prefix", n)


def tail_top(reads: DataFrame, length: int = 12, n: int = 10) -> DataFrame:
    return top_counts(reads.select("sample", S.tail(F.col("seq"), length).alias("tail")), ["sample"], "tail", n)


def end_kmers(reads: DataFrame, k: int = 8, n: int = 10) -> DataFrame:
    """The most frequent first and last k bases (side 5 or 3) of the upper-case reads of at least k."""
    # only the ends are put in upper case; a letter may become several (ß), so they are cut again
    first, last = (F.substring(F.upper(F.substring("seq", at, k)), at, k) for at in (1, -k))
    ends = reads.filter(F.length("seq") >= k).select("sample", first.alias("5"), last.alias("3"))
    found = top_counts(ends.unpivot("sample", ["5", "3"], "side", "kmer"), ["sample", "side"], "kmer", n)
    return found.withColumn("side", F.col("side").cast("int"))


def end_bases(reads: DataFrame) -> DataFrame:
    """sample, side (5 or 3), base, n, pct: first and last letters of the reads that have any, as they are."""
    sides = F.array(F.struct(F.lit(5).alias("side"), F.substring("seq", 1, 1).alias("base")), F.struct(F.lit(3).alias("side"), F.substring("seq", -1, 1).alias("base")))
    counted = reads.filter(F.length("seq") > 0).select("sample", F.inline(sides)).groupBy("sample", "side", "base").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("sample", "side")))


def hints(reads: DataFrame, prefix_len: int = 12, tail_len: int = 12, dominant: float = 20.0, adapter: float = 0.5) -> DataFrame:
    """sample, top_prefix_pct, prefix_dominates (a barcode or primer may be left: above `dominant` percent),
    top_adapter_pct, adapters_left (some motif in `adapter` percent of the reads or more), unique_lengths,
    lengths_vary, poly_g_pct."""
    up = F.upper("seq")
    motifs = {f"_motif{i}": F.count_if(up.contains(m)) for i, m in enumerate(S.ADAPTERS)}
    # one pass: counts by prefix and length are enough for all columns
    keys = ["sample", S.prefix(F.col("seq"), prefix_len).alias("prefix"), F.length("seq").alias("len")]
    counts = reads.filter("sample IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.count_if(S.poly_g(S.tail(F.col("seq"), tail_len))).alias("g"), *[n.alias(c) for c, n in motifs.items()])
    counts = counts.withColumn("same", F.sum("c").over(Window.partitionBy("sample", "prefix")))
    share = lambda n: 100.0 * n / F.sum("c")
    rows = counts.groupBy("sample").agg(
        share(F.max("same")).alias("top_prefix_pct"), F.greatest(*[share(F.sum(c)) for c in motifs]).alias("top_adapter_pct"), F.count_distinct(F.coalesce("len", F.lit(-1))).alias("unique_lengths"), share(F.sum("g")).alias("poly_g_pct")
    )
    return rows.withColumns({"prefix_dominates": F.col("top_prefix_pct") > dominant, "adapters_left": F.col("top_adapter_pct") >= adapter, "lengths_vary": F.col("unique_lengths") > 1})


def adapter_hits(reads: DataFrame, motifs: tuple[str, ...] = S.ADAPTERS) -> DataFrame:
    """sample, motif, n, pct: reads that hold a motif anywhere; a read may hold several."""
    up = F.upper("seq")
    hits = reads.groupBy("sample").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(up.contains(m)).alias(m) for m in motifs])
    return hits.unpivot(["sample", "total"], list(motifs), "motif", "n").select("sample", "motif", "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def poly_g_tails(reads: DataFrame, length: int = 12) -> DataFrame:
    n = F.count_if(S.poly_g(S.tail(F.col("seq"), length)))
    return reads.groupBy("sample").agg(n.alias("n"), (100.0 * n / F.count(F.lit(1))).alias("pct"))


def length_stats(reads: DataFrame) -> DataFrame:
    """sample, reads, min_len, max_len, mean_len, median_len (the upper one), unique_lengths.

    The median comes from the counts of lengths, not from the reads."""
    counts = reads.groupBy("sample", F.length("seq").cast("long").alias("len")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("sample").orderBy("len")
    counts = counts.withColumns({"upto": F.sum("c").over(up), "total": F.sum("c").over(Window.partitionBy("sample"))})
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("len")))
    return counts.groupBy("sample").agg(
        F.sum("c").alias("reads"), F.min("len").alias("min_len"), F.max("len").alias("max_len"), (F.sum(F.col("len") * F.col("c")) / F.sum("c")).alias("mean_len"), median.alias("median_len"), F.count(F.lit(1)).alias("unique_lengths")
    )


def entropy_bits(keys: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, entropy: Shannon entropy in bits of the key's frequencies."""
    counted = keys.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counted.withColumn("p", p).groupBy(*by).agg((-F.sum(F.col("p") * F.log2("p")) + F.lit(0.0)).alias("entropy"))
