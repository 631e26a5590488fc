"""Synthetic mixtures of samples: seeded truth tables and the signatures they imply."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from skeinlab.operators.kmers import probabilities
from skeinlab.schemas import TRUTH


def draw_truth(spark: SparkSession, names: Sequence[str], n_synth: int = 40, max_parents: int = 3, min_minor: float = 0.10, seed: int = 42) -> DataFrame:
    """name, parents, weights of n_synth mixtures. For each, in this order: the number of parents, the parents
    without repeats, then even Dirichlet weights until the least is min_minor or more, 1,000 times at most (the
    last draw stays). A truth table has n_synth rows, whatever the data."""
    draw = np.random.default_rng(seed)
    rows = []
    for number in range(1, n_synth + 1):
        k = int(draw.integers(2, max_parents + 1))
        parents = [str(x) for x in draw.choice(list(names), size=k, replace=False)]
        weights, tries = draw.dirichlet(np.ones(k)), 1
        while weights.min() < min_minor and tries < 1000:
            weights, tries = draw.dirichlet(np.ones(k)), tries + 1
        rows.append((f"SYNTH_{number:03d}", parents, (weights / weights.sum()).tolist()))
    return spark.createDataFrame(rows, TRUTH)


def mixed(truth: DataFrame, probs: DataFrame) -> DataFrame:
    """sample, bin, p: each mixture's weighted sum of its parents' bins, renormalised."""
    parts = truth.select("name", F.explode(F.arrays_zip("parents", "weights")).alias("part")).select("name", F.col("part.parents").alias("sample"), F.col("part.weights").alias("w"))
    summed = parts.join(probs, "sample").groupBy(F.col("name").alias("sample"), "bin").agg(F.sum(F.col("w") * F.col("p")).alias("s"))
    return probabilities(summed, value="s")


def truth_table(truth: DataFrame) -> DataFrame:
    """sample, parents and weights as text (four decimals), entropy_norm in 0..1, minor_fraction, n_parents."""
    clipped = F.transform("weights", lambda w: F.greatest(w, F.lit(1e-12)))
    rows = truth.withColumn("c", clipped).withColumn("t", F.aggregate("c", F.lit(0.0), lambda a, x: a + x))
    entropy = F.aggregate("c", F.lit(0.0), lambda a, x: a - x / F.col("t") * F.ln(x / F.col("t")))
    return rows.select(
        F.col("name").alias("sample"),
        F.array_join("parents", ",").alias("parents"),
        F.array_join(F.transform("weights", lambda w: F.format_string("%.4f", w)), ",").alias("weights"),
        F.when(F.size("weights") > 1, entropy / F.ln(F.size("weights").cast("double"))).otherwise(0.0).alias("entropy_norm"),
        F.array_min("weights").alias("minor_fraction"),
        F.size("parents").alias("n_parents"),
    )
