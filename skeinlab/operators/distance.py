"""All-pairs distances between the rows of sparse tables (sample, bin, p).

Every pair of samples is in the result, so it grows with the square of the samples (tens to thousands); the
work on bins is an equi-join on bin, whose groups hold one row for each sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-12


def sample_pairs(samples: DataFrame) -> DataFrame:
    """(a, b), a < b, of the distinct samples. The list of samples is sent to all tasks; each makes the pairs of its
    own samples. The result has n (n - 1) / 2 rows, so n, the samples, is thousands at most."""
    ids = samples.select("sample").distinct()
    n = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ids.select(F.col("sample").alias("a")).repartition(n, "a").join(F.broadcast(ids.select(F.col("sample").alias("b"))), F.col("a") < F.col("b"))


def _sides(probs: DataFrame) -> tuple[DataFrame, DataFrame]:
    return probs.select(F.col("sample").alias("a"), "bin", F.col("p").alias("pa")), probs.select(F.col("sample").alias("b"), "bin", F.col("p").alias("pb"))


def _shared(probs: DataFrame, term: Column) -> DataFrame:
    """(a, b, s): sum of the term over the bins that both samples have."""
    left, right = _sides(probs)
    return left.join(right, "bin").filter("a < b").groupBy("a", "b").agg(F.sum(term).alias("s"))


def js_log_eps(probs: DataFrame, samples: DataFrame, eps: float = EPS) -> DataFrame:
    """a, b, d: Jensen-Shannon distance with eps inside the logarithms. A sample without bins is the zero vector.

    With f(x, m) = x ln((x + eps) / (m + eps)) a bin of one sample alone adds f(x, x / 2), so sums of these by
    sample and a correction on shared bins are the whole divergence."""
    f = lambda x, m: x * F.ln((x + eps) / (m + eps))
    alone = probs.groupBy("sample").agg(F.sum(f(F.col("p"), F.col("p") / 2)).alias("u"))
    alone = samples.select("sample").distinct().join(alone, "sample", "left").select("sample", F.coalesce("u", F.lit(0.0)).alias("u"))
    pa, pb = F.col("pa"), F.col("pb")
    m = (pa + pb) / 2
    shared = _shared(probs, f(pa, m) - f(pa, pa / 2) + f(pb, m) - f(pb, pb / 2))
    pairs = sample_pairs(samples).join(alone.select(F.col("sample").alias("a"), F.col("u").alias("ua")), "a").join(alone.select(F.col("sample").alias("b"), F.col("u").alias("ub")), "b")
    js = 0.5 * (F.col("ua") + F.col("ub") + F.coalesce("s", F.lit(0.0)))
    return pairs.join(shared, ["a", "b"], "left").select("a", "b", F.sqrt(F.greatest(js, F.lit(0.0))).alias("d"))


def js_clip(probs: DataFrame, samples: DataFrame, dim: int, eps: float = EPS, root: bool = True) -> DataFrame:
    """a, b, d: values clipped to [eps, 1] and renormalised over dim bins, then the plain divergence. A sample
    without bins is uniform. root=False gives the divergence.

    A bin of one sample alone depends on the other only through its norm: these terms are summed by pair in the
    tasks that hold the sample's bins, before anything is shuffled, as if no bin were shared. The equi-join on bin
    corrects them for shared bins; bins that neither has enter in closed form."""
    clip = lambda c: F.greatest(F.least(c, F.lit(1.0)), F.lit(eps))

    def term(x: Column, y: Column) -> Column:
        m = (x + y) / 2
        return 0.5 * (x * F.ln(x / m) + y * F.ln(y / m))

    mass = probs.groupBy("sample").agg(F.sum(clip(F.col("p"))).alias("z"), F.count(F.lit(1)).alias("k"))
    mass = samples.select("sample").distinct().join(mass, "sample", "left").select("sample", F.coalesce("k", F.lit(0)).alias("k"), (F.coalesce("z", F.lit(0.0)) + (dim - F.coalesce("k", F.lit(0))) * eps).alias("z"))
    of = lambda s: mass.select(F.col("sample").alias(s), F.col("z").alias(f"z{s}"), F.col("k").alias(f"k{s}"))
    n = int(probs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bins = probs.select(F.col("sample").alias("s"), "bin", "p").join(F.broadcast(of("s")), "s").select("s", "bin", (clip(F.col("p")) / F.col("zs")).alias("x"), "zs")
    others = F.broadcast(mass.select(F.col("sample").alias("t"), F.col("z").alias("zt")))
    alone = bins.repartition(n, "s").join(others, F.col("s") != F.col("t")).groupBy("s", "t").agg(F.sum(term(F.col("x"), eps / F.col("zt"))).alias("one"))
    left, right = bins.toDF("a", "bin", "x", "za"), bins.toDF("b", "bin", "y", "zb")
    x, y, za, zb = (F.col(c) for c in ("x", "y", "za", "zb"))
    met = left.join(right, "bin").filter("a < b").groupBy("a", "b").agg(F.sum(term(x, y) - term(x, eps / zb) - term(eps / za, y)).alias("met"), F.count(F.lit(1)).alias("shared"))
    pairs = sample_pairs(samples).join(F.broadcast(of("a")), "a").join(F.broadcast(of("b")), "b")
    rows = pairs.join(met, ["a", "b"], "left").join(alone.toDF("a", "b", "sa"), ["a", "b"], "left").join(alone.toDF("b", "a", "sb"), ["a", "b"], "left")
    known = lambda c: F.coalesce(c, F.lit(0))
    rest = (dim - F.col("ka") - F.col("kb") + known("shared")) * term(eps / za, eps / zb)
    js = F.greatest(known("sa") + known("sb") + known("met") + rest, F.lit(0.0))
    return rows.select("a", "b", (F.sqrt(js) if root else js).alias("d"))


def normalised_rows(values: DataFrame) -> DataFrame:
    """(sample, bin, p) of non-negative (sample, bin, n): over their sum; a row of zeros has no bins left, which
    js_clip takes as uniform. Negative values stop the job."""
    total = F.sum("n").over(Window.partitionBy("sample"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("negative feature"))).otherwise(F.col("n"))
    return values.select("sample", "bin", checked.alias("n"), total.alias("t")).filter("t > 0").select("sample", "bin", (F.col("n") / F.col("t")).alias("p"))


def cosine(values: DataFrame, samples: DataFrame) -> DataFrame:
    """a, b, cos in [-1, 1]; norms are at least 1e-12."""
    norm = values.groupBy("sample").agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("norm"))
    norm = samples.select("sample").distinct().join(norm, "sample", "left").select("sample", F.greatest(F.coalesce("norm", F.lit(0.0)), F.lit(1e-12)).alias("norm"))
    pairs = sample_pairs(samples).join(norm.select(F.col("sample").alias("a"), F.col("norm").alias("na")), "a").join(norm.select(F.col("sample").alias("b"), F.col("norm").alias("nb")), "b")
    dot = _shared(values, F.col("pa") * F.col("pb"))
    cos = F.coalesce("s", F.lit(0.0)) / (F.col("na") * F.col("nb"))
    return pairs.join(dot, ["a", "b"], "left").select("a", "b", F.greatest(F.least(cos, F.lit(1.0)), F.lit(-1.0)).alias("cos"))


def nei_like(shares: DataFrame, samples: DataFrame, dim: int, eps: float = EPS) -> DataFrame:
    """a, b, d = -ln of the cosine, kept above eps, of shares that are clipped to [eps, 1] and renormalised over dim
    bins, as in js_clip: a sample without bins is uniform. Bins that a sample lacks count eps each: what they add to the
    products follows from the samples' sums and numbers of bins, so no bin is filled in."""
    clip = F.greatest(F.least("p", F.lit(1.0)), F.lit(eps))
    parts = shares.select("sample", "bin", clip.alias("p"))
    own = parts.groupBy("sample").agg(F.count(F.lit(1)).alias("k"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    own = samples.select("sample").distinct().join(own, "sample", "left").select("sample", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("k", "s", "q")])
    square = lambda k, q: q + (dim - k) * eps * eps
    of = lambda x: own.select(F.col("sample").alias(x), *[F.col(c).alias(f"{c}{x}") for c in ("k", "s", "q")])
    met = _shared(parts, (F.col("pa") - eps) * (F.col("pb") - eps))
    rows = sample_pairs(samples).join(of("a"), "a").join(of("b"), "b").join(met, ["a", "b"], "left")
    # sum of x y = sum of (x - eps)(y - eps) over shared bins + eps (sum x + sum y) - dim eps^2, sums over all bins
    whole = lambda x: F.col(f"s{x}") + (dim - F.col(f"k{x}")) * eps
    dot = F.coalesce("s", F.lit(0.0)) + eps * (whole("a") + whole("b")) - dim * eps * eps
    cos = dot / F.sqrt(square(F.col("ka"), F.col("qa")) * square(F.col("kb"), F.col("qb")))
    return rows.select("a", "b", (-F.ln(F.greatest(F.least(cos, F.lit(1.0)), F.lit(eps))) + F.lit(0.0)).alias("d"))


def both_ways(dist: DataFrame) -> DataFrame:
    """(u, v, d) in both orders, without the diagonal."""
    return dist.select(F.col("a").alias("u"), F.col("b").alias("v"), "d").unionByName(dist.select(F.col("b").alias("u"), F.col("a").alias("v"), "d"))


def to_square(dist: DataFrame, samples: list[str]) -> DataFrame:
    """The square matrix, one row and column per sample, for sinks."""
    cells = both_ways(dist).unionByName(dist.sparkSession.createDataFrame([(s, s, 0.0) for s in samples], "u string, v string, d double"))
    return cells.groupBy(F.col("u").alias("sample")).pivot("v", samples).agg(F.first("d")).orderBy("sample")
