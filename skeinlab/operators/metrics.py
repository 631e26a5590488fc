"""Ranking, classification and enrichment metrics of scored labels (sample, y, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from skeinlab.operators.graph import cut


ONE_RANGE = 100_000  # values that are summed in one window
MOST_RANGES = 4096


def running(rows: DataFrame, key: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """rows, one for each value of the numeric column key, with running sums in the order of key ({new column: of}).

    Up to ONE_RANGE values are summed in one window. More are dealt to as many ranges as there are multiples of
    that, at approximate percentiles (found by bisection); a range is summed in its own task, on top of the sums of
    the ranges before it."""
    rows = cut(rows)
    parts = min(MOST_RANGES, rows.count() // ONE_RANGE + 1)
    order = F.desc(key) if descending else F.asc(key)
    if parts == 1:
        whole = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(*rows.columns, *[F.sum(of).over(whole).alias(new) for new, of in sums.items()])
    points = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts).alias("_points"))
    bits = [F.lit(1 << i) for i in reversed(range((parts - 1).bit_length()))]
    place = F.aggregate(F.array(*bits), F.lit(0), lambda at, bit: F.when(F.get("_points", at + bit - 1) < F.col(key), at + bit).otherwise(at))
    dealt = rows.join(F.broadcast(points), F.lit(True)).withColumn("_range", -place if descending else place).drop("_points")
    totals = dealt.groupBy("_range").agg(*[F.sum(of).alias(f"_{new}") for new, of in sums.items()])
    up = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over the ranges
    before = totals.select("_range", *[F.coalesce(F.sum(f"_{new}").over(up), F.lit(0)).alias(f"_{new}") for new in sums])
    inside = Window.partitionBy("_range").orderBy(order)
    out = dealt.join(F.broadcast(before), "_range")
    return out.select(*rows.columns, *[(F.sum(of).over(inside) + F.col(f"_{new}")).alias(new) for new, of in sums.items()])


def usable(scored: DataFrame) -> DataFrame:
    """Rows with a label and a score that is a number: null and NaN scores are left out, infinite ones are not."""
    return scored.filter("score IS NOT NULL AND NOT isnan(score) AND y IS NOT NULL")


def by_score(scored: DataFrame) -> DataFrame:
    """score, pos, neg, tp, fp, p, n: counts at each distinct score and running counts from the highest on.

    Rows are summed by score before anything is ordered; the running sums go over distinct scores, in ranges. Null
    and NaN scores and null labels are left out."""
    at = usable(scored).groupBy("score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg"))
    found = running(at, "score", {"tp": "pos", "fp": "neg"}, descending=True)
    whole = found.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return found.join(F.broadcast(whole), F.lit(True))


def _auc(points: DataFrame) -> DataFrame:
    wins = F.sum(F.col("pos") * (F.col("n") - F.col("fp")) + 0.5 * F.col("pos") * F.col("neg"))
    return points.agg((wins / F.nullif(F.max(F.col("p") * F.col("n")), F.lit(0))).alias("roc_auc"))


def _average(points: DataFrame) -> DataFrame:
    return points.agg(F.sum(F.col("pos") / F.nullif(F.col("p"), F.lit(0)) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("avg_precision"))


def roc_auc(scored: DataFrame) -> DataFrame:
    """roc_auc: pairs (positive, negative) in the right order, ties a half, over all; null with one class."""
    return _auc(by_score(scored))


def average_precision(scored: DataFrame) -> DataFrame:
    return _average(by_score(scored))


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.nullif(F.col(whole), F.lit(0))


def roc_points(scored: DataFrame, drop_intermediate: bool = False) -> DataFrame:
    """threshold, fpr, tpr at each distinct score, after the point (0, 0) whose threshold is null; with
    drop_intermediate without the points between two in line.
    A rate of a class that is not there is null."""
    points = by_score(scored)
    if drop_intermediate:
        # the next point's counts by an equi-join on the running counts, which are different at each score
        ahead = points.select((F.col("tp") - F.col("pos")).alias("tp"), (F.col("fp") - F.col("neg")).alias("fp"), F.col("pos").alias("pos_"), F.col("neg").alias("neg_"))
        points = points.join(ahead, ["tp", "fp"], "left").filter(~F.coalesce(F.col("pos") * F.col("neg_") == F.col("neg") * F.col("pos_"), F.lit(False)))
    rates = points.select(F.col("score").alias("threshold"), _share("fp", "n").alias("fpr"), _share("tp", "p").alias("tpr"))
    return rates.unionByName(scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double"))


def pr_points(scored: DataFrame) -> DataFrame:
    """threshold, precision, recall at each distinct score, and the end (1, 0) with a null threshold."""
    points = by_score(scored).select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), _share("tp", "p").alias("recall"))
    return points.unionByName(scored.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double"))


def f1_of(tp: Column, fp: Column, p: Column) -> Column:
    return F.coalesce(2.0 * tp / F.nullif(tp + fp + p, F.lit(0)), F.lit(0.0))


def best_f1(scored: DataFrame) -> DataFrame:
    """threshold, f1: predict at or above the threshold; of equal F1 the lowest threshold."""
    f1 = by_score(scored).select(F.col("score").alias("threshold"), f1_of(F.col("tp"), F.col("fp"), F.col("p")).alias("f1"))
    return f1.orderBy(F.desc("f1"), "threshold").limit(1)


def _series(x: Column) -> Column:
    """ln x! less the leading terms of Stirling's formula, for x of 15 or more."""
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * x * x)) / (x * x)) / (x * x)) / x


def _stirling_rest(n: Column) -> Column:
    """ln n! - (ln(2 pi n) / 2 + n ln n - n), for n of 1 or more; below 15 from the factorial itself."""
    small = F.ln(F.factorial(F.least(n, F.lit(15)).cast("int"))) - 0.5 * F.ln(2 * F.pi() * n) - n * F.ln(n) + n
    return F.when(n < 15, small).otherwise(_series(n))


def _off(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x, without the loss of digits near the mean."""
    e = (x - mean) / mean
    return F.when(x == 0, mean).otherwise(mean * ((1 + e) * F.log1p(e) - e))


def _binomial(x: Column, n: Column, p: Column) -> Column:
    """ln of the binomial probability, from deviances, so that large n lose no digits (0 < p < 1)."""
    inside = _stirling_rest(n) - _stirling_rest(x) - _stirling_rest(n - x) - _off(x, n * p) - _off(n - x, n * (1 - p)) + 0.5 * F.ln(n / (2 * F.pi() * x * (n - x)))
    return F.when(n == 0, 0.0).when(x == 0, n * F.log1p(-p)).when(x == n, n * F.ln(p)).otherwise(inside)


def enrichment_p(hits: Column, positives: Column, total: Column, drawn: Column) -> Column:
    """P(X >= hits) of `positives` among `total` in `drawn` draws without replacement: both the one-sided Fisher
    test and the hypergeometric tail. Null where more are drawn than there are. Integer columns.

    Summed are the terms from hits away from the mean, each from the one before by a ratio: those of the tail where
    hits are above the mean, else those below, of which the tail is the complement. Some twelve standard deviations
    of terms are gone through; what follows is less than a double can hold beside them."""
    h, k, n, d = (c.cast("double") for c in (hits, positives, total, drawn))
    low, high = F.greatest(F.lit(0.0), d - (n - k)), F.least(k, d)
    mean = d * k / n
    above = h > mean
    start = F.when(above, h).otherwise(h - 1)
    p = d / n
    first = F.exp(_binomial(start, k, p) + _binomial(d - start, n - k, p) - _binomial(d, n, p))
    spread = F.sqrt(d * (k / n) * (1 - k / n))
    terms = F.least(F.when(above, high - start).otherwise(start - low), F.ceil(12 * spread) + 60).cast("int")

    def step(acc: Column, i: Column) -> Column:
        x = F.when(above, start + i).otherwise(start - i)  # the term's place before this step is one nearer to the mean
        up = (k - (x - 1)) * (d - (x - 1)) / (x * (n - k - d + x))
        down = (x + 1) * (n - k - d + x + 1) / ((k - x) * (d - x))
        term = acc["term"] * F.when(above, up).otherwise(down)
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    steps = F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>"))
    summed = F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), step)["sum"]
    certain = (p == 1) | (k == n) | (k == 0)
    tail = F.when(hits <= low, 1.0).when(hits > high, 0.0).when(certain, 1.0).when(above, summed).otherwise(1 - summed)
    return F.when(drawn <= total, F.greatest(F.least(tail, F.lit(1.0)), F.lit(0.0)))


def _nth(rows: DataFrame, column: str, n: int):
    """The n-th value of a column in ascending order. Spark sorts the rows into ranges; only the range that holds
    it is gone through."""
    ordered = cut(rows.select(column).orderBy(column).withColumn("_part", F.spark_partition_id()))
    for part, size in sorted(map(tuple, ordered.groupBy("_part").agg(F.count(F.lit(1))).collect())):  # a row for each range
        if n <= size:
            return ordered.filter(F.col("_part") == part).orderBy(column).limit(n).agg(F.max(column)).first()[0]
        n -= size


def top_k(scored: DataFrame, k: int | None = None, counts: DataFrame | None = None) -> DataFrame:
    """sample, y, score, pred: the k best scores (ties by sample) are predicted; k is the positives by default.

    The k-th score comes from the running counts of distinct scores (`counts`, those of by_score, where they are
    known); only rows that tie there are put in order."""
    known = usable(scored)
    if k is None:
        k = known.agg(F.sum("y")).first()[0] or 0
    if k <= 0:
        return known.withColumn("pred", F.lit(0))
    counts = (by_score(known) if counts is None else counts).withColumn("upto", F.col("tp") + F.col("fp"))
    last = counts.filter(F.col("upto") >= k).agg(F.max(F.struct("score", "upto", (F.col("pos") + F.col("neg")).alias("at")))).first()[0]
    if last is None:
        return known.withColumn("pred", F.lit(1))
    wanted = k - (last.upto - last["at"])
    edge = _nth(known.filter(F.col("score") == F.lit(last.score)), "sample", wanted) if wanted < last["at"] else None
    tied = F.lit(True) if edge is None else F.col("sample") <= F.lit(edge)
    return known.withColumn("pred", ((F.col("score") > F.lit(last.score)) | ((F.col("score") == F.lit(last.score)) & tied)).cast("int"))


def confusion(predicted: DataFrame) -> DataFrame:
    """truth, predicted, n over the four cells (1 and 0)."""
    return predicted.groupBy(F.col("y").alias("truth"), F.col("pred").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def evaluate(scored: DataFrame, k: int | None = None) -> DataFrame:
    """One row: n_used, n_pools, topk, tp, fp, tn, fn, accuracy, precision, recall, f1, roc_auc, avg_precision and
    the enrichment p (p_fisher_enrichment, p_hypergeom_enrichment). All but n_used are null with one class."""
    points = cut(by_score(scored))
    predicted = top_k(scored, k, points)
    y, pred = F.col("y"), F.col("pred")
    cells = predicted.agg(
        F.count(F.lit(1)).alias("n_used"),
        F.coalesce(F.sum("y"), F.lit(0)).alias("n_pools"),
        F.coalesce(F.sum("pred"), F.lit(0)).cast("long").alias("topk"),
        *[F.count_if((y == a) & (pred == b)).alias(name) for name, a, b in (("tp", 1, 1), ("fp", 0, 1), ("tn", 0, 0), ("fn", 1, 0))],
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    p = enrichment_p(tp, F.col("n_pools"), F.col("n_used"), F.col("topk"))
    cells = cells.select(
        "*",
        ratio(tp + tn, F.col("n_used")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"),
    )
    out = cells.join(_auc(points), F.lit(True)).join(_average(points), F.lit(True)).select("*", p.alias("p_fisher_enrichment"), p.alias("p_hypergeom_enrichment"))
    both = (F.col("n_pools") > 0) & (F.col("n_pools") < F.col("n_used"))
    return out.select("n_used", *[F.when(both, F.col(c)).alias(c) for c in out.columns if c != "n_used"])


def mid_ranks(rows: DataFrame, column: str, out: str) -> DataFrame:
    """rows with the mid-rank of a column, from counts by value; nulls have none."""
    counts = rows.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_c")).filter("_v IS NOT NULL")
    ranks = running(counts, "_v", {"_upto": "_c"}).select("_v", (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out))
    return rows.join(ranks, F.col(column) == F.col("_v"), "left").drop("_v")


def correlations(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n, pearson_r, spearman_rho over the rows that have both, and two-sided p values by the t distribution."""
    both = rows.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    ranked = mid_ranks(mid_ranks(both, "x", "rx"), "y", "ry")
    out = ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("x", "y").alias("pearson_r"), F.corr("rx", "ry").alias("spearman_rho"))
    return out.select("*", t_test_p(F.col("pearson_r"), F.col("n")).alias("pearson_p"), t_test_p(F.col("spearman_rho"), F.col("n")).alias("spearman_p"))


def _beta_fraction(x: Column, a: Column, b: Column, steps: int = 80) -> Column:
    """The continued fraction of the incomplete beta function I_x(a, b), by Lentz's recurrence. It settles within
    some forty steps where x is below (a + 1) / (a + b + 2)."""
    whole = lambda d: F.when(F.abs(d) < 1e-300, 1e-300).otherwise(d)

    def step(acc: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / whole(1 + even * acc["d"]), whole(1 + even / acc["c"])
        half = F.struct(c1.alias("c"), d1.alias("d"), (acc["h"] * c1 * d1).alias("h"))
        return F.aggregate(F.array(odd), half, lambda y, o: _lentz(y, o, whole))

    d = 1 / whole(1 - (a + b) * x / (a + 1))
    first = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.array(*[F.lit(float(i)) for i in range(1, steps + 1)]), first, step)["h"]


def _lentz(acc: Column, part: Column, whole) -> Column:
    d, c = 1 / whole(1 + part * acc["d"]), whole(1 + part / acc["c"])
    return F.struct(c.alias("c"), d.alias("d"), (acc["h"] * c * d).alias("h"))


def _log_beta_half(a: Column) -> Column:
    """ln B(a, 1/2): the series of ln(gamma(x) / gamma(x + 1/2)) at x = a + 10, brought back by the factors between."""
    x = a + 10
    q = 1 / (x * x)
    out = -0.5 * F.ln(x) + (1 / 8 - (1 / 192 - (1 / 640 - q * 17 / 14336) * q) * q) / x
    for i in range(10):
        out = out + F.log1p(0.5 / (a + i))
    return out + 0.5 * F.ln(F.pi())


def t_test_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation r of n rows: I_x((n - 2) / 2, 1/2) at x = 1 - r^2, the tail of the t distribution.
    Null below three rows."""
    a, half, y = (n.cast("double") - 2) / 2, F.lit(0.5), F.least(r * r, F.lit(1.0))
    lead = F.exp(a * F.log1p(-y) + 0.5 * F.ln(y) - _log_beta_half(a))
    near = 1 - 2 * lead * _beta_fraction(y, half, a)
    far = lead * _beta_fraction(1 - y, a, half) / a
    p = F.when(y == 0, 1.0).when(y == 1, 0.0).when(y < F.greatest(1.5 / (a + 2.5), F.least(F.lit(0.1), 8 / (a + 2.5))), near).otherwise(far)
    return F.when((n > 2) & r.isNotNull(), F.greatest(F.least(p, F.lit(1.0)), F.lit(0.0)))


def summarise(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """by, n_runs, mean and sample SD (0 for one run) of each value."""
    parts = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{v}_sd"))]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_runs"), *parts)


def zscores(rows: DataFrame, columns: list[str], flat: str = "one") -> DataFrame:
    """rows with <column>_z by the population SD, nulls skipped. Where the SD is 0 it counts as 1 (flat="one"),
    or, at 1e-12 or less, all scores are 0 (flat="zero")."""
    stats = rows.agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
    z = {}
    for c in columns:
        m, s = F.col(f"{c}_m"), F.col(f"{c}_s")
        z[f"{c}_z"] = (F.col(c) - m) / F.when(s > 0, s).otherwise(1.0) if flat == "one" else F.when(s <= 1e-12, 0.0).otherwise((F.col(c) - m) / s)
    return rows.join(stats, F.lit(True)).withColumns(z).drop(*[f"{c}_{x}" for c in columns for x in "ms"])


def top_three_precision(ranked: DataFrame, pools: list[str]) -> DataFrame:
    """hits, precision of the three best ranks; the denominator is always three."""
    hit = F.upper(F.trim("sample")).isin([p.strip().upper() for p in pools])
    return ranked.orderBy("rank").limit(3).agg(F.count_if(hit).alias("hits"), (F.count_if(hit) / F.lit(3.0)).alias("precision"))


# The run-info columns that are searched.
TEXT_COLUMNS = ("Title", "Experiment", "SampleName", "LibraryName", "LibraryStrategy", "LibrarySelection")


def pool_labels(runinfo: DataFrame) -> DataFrame:
    """sample, ground_truth (pool, individual, unknown) by words in the run's text columns (all columns, where it
    has none of the usual ones). A run on several rows is a pool if any says so, else individual if any does."""
    names = [c for c in TEXT_COLUMNS if c in runinfo.columns] or runinfo.columns
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in names]))
    has = lambda *words: F.greatest(*[text.contains(w) for w in words]) if len(words) > 1 else text.contains(words[0])
    label = (
        F.when(has("pool-gbs", "pool gbs"), 2)
        .when(has("individual-gbs", "individual gbs"), 1)
        .when(has("pool") & has("gbs"), 2)
        .when(has("individual") & has("gbs"), 1)
        .otherwise(0)
    )
    best = runinfo.groupBy(F.col("Run").cast("string").alias("sample")).agg(F.max(label).alias("best"))
    return best.select("sample", F.when(F.col("best") == 2, "pool").when(F.col("best") == 1, "individual").otherwise("unknown").alias("ground_truth"))


def ground_truth(samples: DataFrame, runinfo: DataFrame | None = None, pools: list[str] | None = None) -> DataFrame:
    """sample, ground_truth: from run info where given, else pools and all others individuals, else unknown."""
    if runinfo is not None:
        found = samples.select("sample").join(pool_labels(runinfo), "sample", "left")
        return found.select("sample", F.coalesce("ground_truth", F.lit("unknown")).alias("ground_truth"))
    if pools:
        pools = [p.strip() for p in pools]
        return samples.select("sample", F.when(F.col("sample").isin(pools), "pool").otherwise("individual").alias("ground_truth"))
    return samples.select("sample", F.lit("unknown").alias("ground_truth"))


def label_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("ground_truth").agg(F.count(F.lit(1)).alias("n"))
