"""Connected components of an edge table, by alternating stars in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skeinlab.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of an edge (a bigint, b bigint); label is the least node of its component.

    Each round hangs all larger neighbours of a node on its least one, then all smaller ones; rounds go on
    until the edges stay as they are, about log(nodes) of them. Minima are partial aggregates. A hub's edges stay
    where they are when its least neighbour is joined to them. Lineage is cut in the shared folder. Edges may
    repeat; loops are passed over; no edges give no rows."""
    now = common.stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    mark = _mark(now)
    while True:
        now = common.stored(_stars(now, mark[0]), "edges")
        last, mark = mark, _mark(now)
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """n edges (u > v) to the same components with u hung on smaller nodes; at rest all are stars."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("degree"))
    large = common.join_groups(both, least, ["u"], "degree", 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # a node's smaller neighbours are the least ones of others: few, as a hub's neighbours share it
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    hung = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(down.select("u", F.col("m").alias("v"))).distinct()
