"""The smaller programs, and rules that the driver tables don't reach."""

from collections import Counter

import pytest

from skeinlab.functions import sequence as S
from skeinlab.operators import metrics, spectral
from skeinlab.plans import programs
from skeinlab.sources import fastq, tables


def test_limbs_are_clamped_one_by_one(spark):
    dist = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 1.0), ("b", "c", 5.0)], "a string, b string, d double")
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    assert spectral.neighbour_joining(dist, ids).first()[0] == "(c:1.250000,(a:0.000000,b:2.500000):1.250000);"


def test_names_in_any_case_and_ids_without_space(spark, tmp_path):
    names = spark.createDataFrame([("x/S_1.FASTQ.GZ",), ("S.2.Fq",), ("T-1.fastq.Gz",)], "p string")
    assert [r[0] for r in names.select(fastq.sample_of(S.F.col("p"))).collect()] == ["S", "S", "T"]
    (tmp_path / "pools.txt").write_text("\ts1 \n # no\n\u00a0s2\t\n\t#no\n \n")
    assert tables.pools_file(spark, str(tmp_path / "pools.txt")) == ["s1", "s2"]
    samples = spark.createDataFrame([("s1",), ("s2",)], "sample string")
    assert {r.sample: r.ground_truth for r in metrics.ground_truth(samples, pools=[" s1\t"]).collect()} == {"s1": "pool", "s2": "individual"}


def test_enrichment_by_closed_forms(spark):
    row = spark.createDataFrame([(2, 3, 18, 3), (0, 5, 20, 4), (30, 400, 4000, 200), (4, 3, 18, 3), (1, 1, 3, 9)], "h int, p int, n int, d int")
    got = [r[0] for r in row.select(metrics.enrichment_p(*[S.F.col(c) for c in "hpnd"])).collect()]
    from math import comb

    tail = lambda h, p, n, d: sum(comb(p, i) * comb(n - p, d - i) for i in range(h, min(p, d) + 1)) / comb(n, d)
    assert got[0] == pytest.approx(0.0563725, abs=1e-7) and got[1] == pytest.approx(1) and got[2] == pytest.approx(tail(30, 400, 4000, 200), rel=1e-8)
    assert got[3] == 0 and got[4] is None


def test_running_sums_in_ranges(spark):
    rows = [(float(i * 7 % 1000), i % 5) for i in range(1000)]
    got = {r.k: r.s for r in metrics.running(spark.createDataFrame(rows, "k double, n int"), "k", {"s": "n"}, descending=True).collect()}
    total = 0
    for k, n in sorted(rows, reverse=True):
        total += n
        assert got[k] == total


def bins_by_hand(seqs, k, dim):
    def mix(x):
        for m in S.FMIX:
            x ^= x >> 33
            x = x * m % (1 << 64)
        return x ^ x >> 33

    out = Counter()
    for s in seqs:
        for i in range(len(s) - k + 1):
            if set(s[i : i + k].upper()) <= set("ACGT"):
                out[mix(int("".join(str("ACGT".index(c)) for c in s[i : i + k].upper()), 4)) % dim] += 1
    return out


def test_folder_programs(spark, tmp_path):
    reads = {"s_1.fastq": ["ACGTNACGTT", "ggggggggggggg", ""], "s_2.fastq": ["TTTACG"], "t.FASTQ": ["ACG", "AC"]}
    for name, seqs in reads.items():
        (tmp_path / name).write_text("".join(f"@r\n{s}\n+\n{'I' * len(s)}\n" for s in seqs))
    got = {(r.sample, r.bin): r.n for r in programs.kmer_matrix(spark, str(tmp_path), "*.[fF]*", 3, 50, 0).collect()}
    want = {("s", b): n for b, n in bins_by_hand(reads["s_1.fastq"] + reads["s_2.fastq"], 3, 50).items()} | {("t", b): n for b, n in bins_by_hand(reads["t.FASTQ"], 3, 50).items()}
    assert got == want
    with pytest.raises(FileNotFoundError):
        programs.kmer_matrix(spark, str(tmp_path), "*.gz")
    out = programs.folder_report(spark, str(tmp_path), prefix_len=4)
    lengths = {r["sample"].rsplit("/", 1)[1]: r for r in out["lengths"].collect()}
    assert (lengths["s_1.fastq"].reads, lengths["s_1.fastq"].max_len, lengths["t.FASTQ"].unique_lengths) == (2, 13, 2)
    assert {r["sample"].rsplit("/", 1)[1]: r.n for r in out["poly_g"].collect()}["s_1.fastq"] == 1
    assert sum(r.n for r in out["end_bases"].collect()) == 10
    assert {r["sample"].rsplit("/", 1)[1]: r.lengths_vary for r in out["hints"].collect()} == {"s_1.fastq": True, "s_2.fastq": False, "t.FASTQ": True}
