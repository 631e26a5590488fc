"""The data behind figures, as tables; drawing is the caller's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def curvature_histogram(edges: DataFrame, column: str = "orc_kappa", bins: int = 20) -> DataFrame:
    """bin, lo, hi, n of an edge column in equal bins between its least and greatest value."""
    ends = edges.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.least(F.when(width > 0, F.floor((F.col(column) - F.col("lo")) / width)).otherwise(0), F.lit(bins - 1))
    counted = edges.join(ends, F.lit(True)).groupBy(place.cast("int").alias("bin"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("lo"), (F.col("lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def depth_bars(manifest: DataFrame) -> DataFrame:
    return manifest.select("sample", (F.col("total_bytes") / 1048576).alias("megabytes"))


def node_sizes(nodes: DataFrame, column: str = "mixture_score") -> DataFrame:
    """nodes with size, the column scaled to 0..1 over all."""
    whole = Window.partitionBy()
    lo, hi = F.min(column).over(whole), F.max(column).over(whole)
    return nodes.withColumn("size", (F.col(column) - lo) / (hi - lo + 1e-12))


def group_centroids(coords: DataFrame, group: str, axes: tuple[str, ...] = ("PC1", "PC2")) -> DataFrame:
    return coords.dropna(subset=[group]).groupBy(group).agg(*[F.avg(a).alias(a) for a in axes])
