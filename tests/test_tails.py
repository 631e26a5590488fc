"""p values and tails against exact sums and closed forms, and rows that are no numbers."""

import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from skeinlab.operators import graph, metrics


def column(spark, rows, schema, out):
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in table.select("i", out.alias("out")).orderBy("i").select("out").collect()]


def test_enrichment_against_exact_sums(spark):
    def tail(h, k, n, d):
        if d > n:
            return None
        whole = math.comb(n, d)
        return float(Fraction(sum(math.comb(k, i) * math.comb(n - k, d - i) for i in range(max(h, 0, d - n + k), min(k, d) + 1)), whole))

    rows = [(h, k, n, d) for n in (1, 2, 7, 18) for k in range(n + 1) for d in range(n + 2) for h in range(min(k, d) + 2)]
    rows += [(2, 3, 18, 3), (0, 500, 2000, 300), (75, 500, 2000, 300), (76, 500, 2000, 300), (110, 500, 2000, 300), (40, 500, 2000, 300), (450, 449, 3980, 449), (70, 449, 3980, 449)]
    got = column(spark, rows, "h bigint, k bigint, n bigint, d bigint", metrics.enrichment_p(*map(F.col, "hknd")))
    for row, p in zip(rows, got):
        want = tail(*row)
        assert p is None if want is None else p == pytest.approx(want, rel=1e-9, abs=1e-14), row


def test_enrichment_of_many_positives(spark):
    n, k, d = 10**9, 10**8, 5 * 10**7
    mean, sd = k / n * d, math.sqrt(d * (k / n) * (1 - k / n) * (n - d) / (n - 1))
    rows = [(int(mean + z * sd), k, n, d) for z in (-3, -1, 0, 1, 3, 6)]
    got = column(spark, rows, "h bigint, k bigint, n bigint, d bigint", metrics.enrichment_p(*map(F.col, "hknd")))
    for (h, *_), p in zip(rows, got):
        z = (h - 0.5 - mean) / sd
        assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=2e-2)
    other = column(spark, [(h, d, n, k) for h, *_ in rows], "h bigint, k bigint, n bigint, d bigint", metrics.enrichment_p(*map(F.col, "hknd")))
    assert got == pytest.approx(other, rel=1e-9)  # positives and drawn change places


def test_p_of_a_correlation(spark):
    def exact(t, df):
        """The finite sums of the t distribution."""
        angle = math.atan2(t, math.sqrt(df))
        c, s = math.cos(angle), math.sin(angle)
        if df == 1:
            return 1 - 2 * angle / math.pi
        term, total = (1.0, 1.0) if df % 2 == 0 else (c, c)
        for i in range(2 - df % 2, df - 1, 2):
            term *= c * c * (i / (i + 1) if df % 2 else i / (i + 1))
            total += term
        return 1 - s * total if df % 2 == 0 else 1 - 2 / math.pi * (angle + s * total)

    ts = (1e-3, 0.5, 1.2, 1.3, 2.0, 3.0)
    cases = [(t, n) for n in (3, 4, 5, 6, 13, 102) for t in ts]
    # even degrees: sum of products of odd over even numbers
    def by_steps(t, df):
        r2, total, steps = t * t / (df + t * t), 0.0, 200_000
        lo = math.asin(math.sqrt(r2))
        h = (math.pi / 2 - lo) / steps
        f = lambda x: max(math.cos(x), 0.0) ** (df - 1)
        part = sum(f(lo + h * i) * (4 if i % 2 else 2) for i in range(1, steps)) + f(lo) + f(math.pi / 2)
        total = part * h / 3
        whole = math.sqrt(math.pi) * math.exp(math.lgamma(df / 2) - math.lgamma((df + 1) / 2)) / 2
        return total / whole

    r = lambda t, n: t / math.sqrt(n - 2 + t * t)
    got = column(spark, [(r(t, n), n) for t, n in cases], "r double, n bigint", metrics.t_test_p(F.col("r"), F.col("n")))
    for (t, n), p in zip(cases, got):
        assert p == pytest.approx(exact(t, 1) if n == 3 else by_steps(t, n - 2), rel=1e-9), (t, n)
    big = [(t, n) for n in (10**7, 10**8, 10**9) for t in (*ts, 6.0)]
    got = column(spark, [(r(t, n), n) for t, n in big], "r double, n bigint", metrics.t_test_p(F.col("r"), F.col("n")))
    for (t, n), p in zip(big, got):
        edge = math.exp(-t * t / 2) / math.sqrt(2 * math.pi) * t * (t * t + 1) / 2 / (n - 2)  # the first term of the way to the normal tail
        want = math.erfc(t / math.sqrt(2)) + edge
        assert abs(p - want) < 1e-9 and p == pytest.approx(want, rel=1e-7), (t, n)
    assert column(spark, [(0.0, 9), (1.0, 9), (-1.0, 9), (0.5, 2), (None, 9)], "r double, n bigint", metrics.t_test_p(F.col("r"), F.col("n"))) == [1.0, 0.0, 0.0, None, None]


def test_scores_that_are_no_numbers_are_left_out(spark):
    rows = [("a", 1, float("nan")), ("b", 1, 2.0), ("c", 0, 1.0), ("d", 0, 0.5), ("e", 1, None), ("f", None, 3.0)]
    found = metrics.evaluate(spark.createDataFrame(rows, "sample string, y int, score double")).first()
    assert (found.n_used, found.n_pools, found.tp, found.roc_auc) == (3, 1, 1, 1.0)


def test_running_sums_in_ranges(spark, monkeypatch):
    rows = [(float(i * 37 % 1000), i) for i in range(1000)]
    table = spark.createDataFrame(rows, "x double, v bigint")
    want, total = {}, 0
    for x, v in sorted(rows, reverse=True):
        total += v
        want[x] = total
    for size in (100_000, 60):
        monkeypatch.setattr(metrics, "ONE_RANGE", size)
        assert {r.x: r.s for r in metrics.running(table, "x", {"s": "v"}, descending=True).collect()} == want


def test_ties_at_the_edge_go_by_sample(spark):
    rows = [(f"s{i:04d}", int(i % 3 == 0), 1.0 if i > 20 else 2.0) for i in range(400)]
    got = metrics.top_k(spark.createDataFrame(rows, "sample string, y int, score double").repartition(5), 100).filter("pred = 1").collect()
    assert sorted(r.sample for r in got) == [f"s{i:04d}" for i in range(100)]


def test_distances_that_are_no_numbers_join_nobody(spark):
    rows = [("a", "b", 1.0), ("a", "c", 2.0), ("b", "c", 3.0), ("a", "d", None), ("b", "d", float("nan")), ("c", "d", 9.0)]
    got = graph.knn_graph(spark.createDataFrame(rows, "a string, b string, d double"), 1).collect()
    assert sorted((r.u, r.v) for r in got) == [("a", "b"), ("a", "c"), ("c", "d")]
