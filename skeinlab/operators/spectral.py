"""Embeddings, trees and other dense problems of n x n matrices, n the samples.

Spark computes the matrices from the sparse tables; what is left is n x n, n at most MOST, and is solved in one
task for each matrix (`cell`), so that sweeps run their matrices in parallel."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skeinlab.operators import graph
from skeinlab.operators.distance import both_ways, sample_pairs
from skeinlab.operators.graph import cut

MOST = 2048  # samples of a matrix; more stop the job


def per_matrix(cells: DataFrame, solve: Callable[[list, np.ndarray], pd.DataFrame], schema: str, by: str | None = None, fill: float = 0.0) -> DataFrame:
    """solve(samples, matrix) on the square matrix of the rows (u, v, value), for each value of `by`."""
    key = F.col(by) if by else F.lit(0)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ids = sorted(set(rows.u) | set(rows.v))
        if len(ids) > MOST:
            raise ValueError(f"{len(ids)} samples in a dense matrix; at most {MOST} are solved in one task")
        place = {s: i for i, s in enumerate(ids)}
        matrix = np.full((len(ids), len(ids)), fill)
        matrix[rows.u.map(place), rows.v.map(place)] = rows.value
        out = solve(ids, matrix)
        if by:
            out.insert(0, by, key[0])
        return out

    head = f"{by} {dict(cells.dtypes)[by]}, " if by else ""
    return cells.withColumn("_cell", key).groupBy("_cell").applyInPandas(run, head + schema)


def square(dist: DataFrame, samples: DataFrame) -> DataFrame:
    """(u, v, value) in both orders with the diagonal."""
    zero = samples.select("sample").distinct().select(F.col("sample").alias("u"), F.col("sample").alias("v"), F.lit(0.0).alias("value"))
    return both_ways(dist).select("u", "v", F.col("d").alias("value")).unionByName(zero)


def fixed_signs(vectors: np.ndarray) -> np.ndarray:
    """Columns with their largest entry by size (the first of equals) positive."""
    top = np.abs(np.round(vectors, 12)).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def _long(ids: list, coords: np.ndarray) -> pd.DataFrame:
    n, k = coords.shape
    return pd.DataFrame({"sample": np.repeat(np.array(ids, dtype=object), k), "axis": np.tile(np.arange(1, k + 1, dtype=np.int32), n), "value": coords.ravel()})


COORDS = "sample string, axis int, value double"


def centred(dist: DataFrame, samples: DataFrame) -> DataFrame:
    """u, v, value: -1/2 J D^2 J by row, column and overall means."""
    sq = square(dist, samples).withColumn("s", F.col("value") * F.col("value"))
    means = [F.avg("s").over(Window.partitionBy(*c)) for c in (("u",), ("v",), ())]
    return sq.select("u", "v", (-0.5 * (F.col("s") - means[0] - means[1] + means[2])).alias("value"))


def _eigen_coords(ids: list, gram: np.ndarray, axes: int) -> pd.DataFrame:
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    order = [i for i in np.argsort(-values) if values[i] > 1e-12][:axes]
    return _long(ids, fixed_signs(vectors[:, order]) * np.sqrt(values[order]) if order else np.zeros((len(ids), 0)))


def pcoa(dist: DataFrame, samples: DataFrame, axes: int = 2) -> DataFrame:
    """sample, axis, value: principal coordinates of the eigenvalues above 1e-12, largest first."""
    return per_matrix(centred(dist, samples), lambda ids, m: _eigen_coords(ids, m, axes), COORDS)


def pca(probs: DataFrame, samples: DataFrame, axes: int = 2) -> DataFrame:
    """sample, axis, value: principal components of the standardised bins (population SD; constant bins are left
    out), from the n x n Gram matrix. Its cells are sums over shared bins by an equi-join on bin, and scalars."""
    n = samples.select("sample").distinct().count()
    stats = probs.groupBy("bin").agg(F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    stats = stats.select("bin", (F.col("s") / n).alias("mean"), (F.col("q") / n - F.col("s") * F.col("s") / (n * n)).alias("var")).filter("var > 1e-24")
    weighted = probs.join(stats, "bin").select("sample", "bin", "p", "mean", (1 / F.col("var")).alias("w"))
    shared = weighted.select(F.col("sample").alias("u"), "bin", "p", "w").join(probs.select(F.col("sample").alias("v"), "bin", F.col("p").alias("q")), "bin").groupBy("u", "v").agg(F.sum(F.col("w") * F.col("p") * F.col("q")).alias("dot"))
    alone = samples.select("sample").distinct().join(weighted.groupBy("sample").agg(F.sum(F.col("w") * F.col("mean") * F.col("p")).alias("m")), "sample", "left").select("sample", F.coalesce("m", F.lit(0.0)).alias("m"))
    whole = stats.agg(F.coalesce(F.sum(F.col("mean") * F.col("mean") / F.col("var")), F.lit(0.0)).alias("c"))
    pairs = sample_pairs(samples)
    pairs = pairs.toDF("u", "v").unionByName(pairs.toDF("v", "u")).unionByName(alone.select(F.col("sample").alias("u"), F.col("sample").alias("v")))
    cells = pairs.join(shared, ["u", "v"], "left").join(alone.toDF("u", "mu"), "u").join(alone.toDF("v", "mv"), "v").join(whole, F.lit(True))
    gram = cells.select("u", "v", (F.coalesce("dot", F.lit(0.0)) - F.col("mu") - F.col("mv") + F.col("c")).alias("value"))
    return per_matrix(gram, lambda ids, m: _eigen_coords(ids, m, axes), COORDS)


def diffusion_map(edges: DataFrame, t: int = 1) -> tuple[DataFrame, DataFrame]:
    """Coordinates 1 to 3 (sample, axis, value) and eigenvalues 0 to 3 (axis, eigenvalue) of the random walk whose
    weights are exp(-d^2 / (2 sigma^2)), sigma the median edge length (the mean, where it is 0): left eigenvectors
    times eigenvalue^t. Needs four nodes; edges of no length at all stop the job."""
    sigma = edges.agg(F.when(F.median("d") > 0, F.median("d")).otherwise(F.avg("d")).alias("sigma"))
    w = edges.join(sigma, F.lit(True)).select("u", "v", F.exp(-F.col("d") * F.col("d") / (2 * F.nullif(F.col("sigma") * F.col("sigma"), F.lit(0.0)))).alias("value"))
    w = w.select("u", "v", F.when(F.col("value").isNull(), F.raise_error(F.lit("all edges have length 0"))).otherwise(F.col("value")).alias("value"))
    cells = w.unionByName(w.select(F.col("v").alias("u"), F.col("u").alias("v"), "value"))

    def parts(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(m) < 4:
            raise ValueError("a diffusion map needs four nodes")
        root = np.sqrt(m.sum(axis=1))
        values, vectors = np.linalg.eigh(m / np.outer(root, root))
        order = np.argsort(-values)[:4]
        left = vectors[:, order] * root[:, None]
        return values[order], fixed_signs(left / np.linalg.norm(left, axis=0))

    def coords(ids: list, m: np.ndarray) -> pd.DataFrame:
        values, left = parts(m)
        return _long(ids, left[:, 1:] * values[1:] ** t)

    def spectrum(ids: list, m: np.ndarray) -> pd.DataFrame:
        values, _ = parts(m)
        return pd.DataFrame({"axis": np.arange(4, dtype=np.int32), "eigenvalue": values})

    return per_matrix(cells, coords, COORDS), per_matrix(cells, spectrum, "axis int, eigenvalue double")


def dense_diffusion(dist: DataFrame, samples: DataFrame, axes: int = 2) -> DataFrame:
    """sample, axis, value: right eigenvectors after the first of the kernel exp(-d^2 / sigma^2) over all pairs, sigma
    the median off-diagonal distance (at least 1e-9), not scaled by eigenvalues."""

    def solve(ids: list, m: np.ndarray) -> pd.DataFrame:
        off = m[~np.eye(len(m), dtype=bool)]
        sigma = max(float(np.median(off)) if len(off) else 0.0, 1e-9)
        k = np.exp(-(m**2) / sigma**2)
        root = np.sqrt(k.sum(axis=1))
        values, vectors = np.linalg.eigh(k / np.outer(root, root))
        order = np.argsort(-values)[1 : axes + 1]
        return _long(ids, fixed_signs(vectors[:, order] / root[:, None]))

    return per_matrix(square(dist, samples), solve, COORDS)


def von_neumann_entropy(edges: DataFrame, by: str) -> DataFrame:
    """by, vn_entropy of each graph: of the eigenvalues above 1e-12 of its Laplacian over its trace (isolated nodes
    add none); graphs without edges are left to the caller, at 0."""

    def solve(ids: list, m: np.ndarray) -> pd.DataFrame:
        laplacian = np.diag(m.sum(axis=1)) - m
        total = np.trace(laplacian)
        values = np.linalg.eigvalsh(laplacian / total) if total > 0 else np.zeros(0)
        values = values[values > 1e-12]
        return pd.DataFrame({"vn_entropy": [float(-(values * np.log(values)).sum()) + 0.0]})

    one = edges.select(by, "u", "v", F.lit(1.0).alias("value"))
    return per_matrix(one.unionByName(one.select(by, F.col("v").alias("u"), F.col("u").alias("v"), "value")), solve, "vn_entropy double", by)


def _upgma(ids: list, m: np.ndarray) -> list[tuple[list, list, float]]:
    """Merges of the two groups of least average distance (ties by their first members): (left, right, height)."""
    groups = [[i] for i in range(len(ids))]
    d, merges = m.astype(float).copy(), []
    np.fill_diagonal(d, np.inf)
    while len(groups) > 1:
        i, j = divmod(int(np.round(d, 12).argmin()), len(groups))
        i, j = min(i, j), max(i, j)
        a, b = groups[i], groups[j]
        merges.append(([ids[x] for x in a], [ids[x] for x in b], float(d[i, j])))
        d[i] = d[:, i] = (len(a) * d[i] + len(b) * d[j]) / (len(a) + len(b))
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        groups[i] = a + b
        del groups[j]
    return merges


MERGES = "members_left array<string>, members_right array<string>, height double"


def linkage(dist: DataFrame, samples: DataFrame) -> DataFrame:
    """members_left, members_right, height: the merges of average linkage, in any order. The side with the least member
    is the left one.

    Up to IN_ONE_TASK distances are merged in one task. Beyond, a round merges all pairs of groups that are each
    other's nearest (by the average to twelve decimals, then by their least members): a merged group is never
    nearer to a third than the nearer of its parts was, so these are the merges that one at a time would find, if no
    distances tie. Groups keep the sums of their distances, which add up where groups merge."""
    pairs = cut(dist.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("d").alias("s")))
    if pairs.count() <= graph.IN_ONE_TASK:
        return per_matrix(square(dist, samples), lambda ids, m: pd.DataFrame(_upgma(ids, m), columns=["members_left", "members_right", "height"]), MERGES)
    groups = cut(samples.select("sample").distinct().select(F.col("sample").alias("label"), F.lit(1).alias("size"), F.array("sample").alias("members")))
    found = None
    while not pairs.isEmpty():
        of = lambda x: groups.select(F.col("label").alias(x), F.col("size").alias(f"{x}_size"))
        average = F.col("s") / (F.col("u_size") * F.col("v_size"))
        near = pairs.join(of("u"), "u").join(of("v"), "v").select(F.struct(F.round(average, 12).alias("to"), "u", "v", average.alias("height")).alias("pair"))
        best = near.select(F.explode(F.array("pair.u", "pair.v")).alias("label"), "pair").groupBy("label").agg(F.min("pair").alias("pair"))
        mutual = best.groupBy("pair").agg(F.count(F.lit(1)).alias("sides")).filter("sides = 2").select("pair.*")
        left, right = (groups.select(F.col("label").alias(x), F.col("size").alias(f"{x}_size"), F.col("members").alias(side)) for x, side in (("u", "members_left"), ("v", "members_right")))
        merged = cut(mutual.join(left, "u").join(right, "v"))
        more = merged.select("members_left", "members_right", "height")
        found = more if found is None else found.unionByName(more)
        whole = merged.select(F.col("u").alias("label"), (F.col("u_size") + F.col("v_size")).alias("size"), F.concat("members_left", "members_right").alias("members"))
        gone = merged.select(F.explode(F.array("u", "v")).alias("label"))
        groups = cut(groups.join(gone, "label", "left_anti").unionByName(whole))
        to = merged.select(F.col("v").alias("old"), F.col("u").alias("new"))
        for x in ("u", "v"):
            pairs = pairs.join(to, F.col(x) == F.col("old"), "left").withColumn(x, F.coalesce("new", x)).drop("old", "new")
        pairs = cut(pairs.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum("s").alias("s")))
    return dist.sparkSession.createDataFrame([], MERGES) if found is None else found


def upgma(dist: DataFrame, samples: DataFrame) -> DataFrame:
    """step, members_left, members_right, height: average-linkage merges in order of height, then of their members (one
    window over the merges, one less than the samples)."""
    order = Window.orderBy(F.round("height", 12), F.size("members_left") + F.size("members_right"), F.get("members_left", F.lit(0)))
    return linkage(dist, samples).select(F.row_number().over(order).alias("step"), "members_left", "members_right", "height")


def leaf_order(dist: DataFrame, samples: DataFrame) -> DataFrame:
    """sample, place: leaves of the average-linkage tree from left to right."""
    members = F.concat("members_left", "members_right")
    top = linkage(dist, samples).agg(F.max_by(members, F.size(members)).alias("order"))
    alone = samples.select("sample").distinct().agg(F.array_sort(F.collect_list("sample")).alias("alone"))  # where nothing merges
    whole = top.join(alone.filter(F.size("alone") < 2), F.lit(True), "left").select(F.coalesce("order", "alone").alias("order"))
    return whole.select(F.posexplode("order").alias("place", "sample")).select("sample", "place")


def cut_tree(dist: DataFrame, samples: DataFrame, n_groups: int = 5) -> DataFrame:
    """sample, auto_group: the average-linkage tree cut into n_groups (2 to n), named G1, G2, ... by their least
    members. Fewer than three samples give no rows. Groups are the components of the merges below the cut."""
    ids = cut(samples.select("sample").distinct())
    n = ids.count()
    if n < 3:
        return ids.select("sample", F.lit("").alias("auto_group")).limit(0)
    merges = upgma(dist, samples).filter(F.col("step") <= n - max(2, min(n_groups, n)))
    first = lambda c: F.get(c, F.lit(0))
    labels = graph.components(merges.select(first("members_left").alias("u"), first("members_right").alias("v")))
    rows = ids.join(labels.select(F.col("node").alias("sample"), "label"), "sample", "left").select("sample", F.coalesce("label", "sample").alias("label"))
    names = rows.select("label").distinct().select("label", F.concat(F.lit("G"), F.row_number().over(Window.orderBy("label"))).alias("auto_group"))
    return rows.join(F.broadcast(names), "label").select("sample", "auto_group")


def neighbour_joining(dist: DataFrame, samples: DataFrame) -> DataFrame:
    """newick: the neighbour-joining tree; of equal criteria (to twelve decimals) the first pair in row order,
    limbs at least 0, six decimals, the last edge split in half. Needs two samples."""

    def solve(ids: list, m: np.ndarray) -> pd.DataFrame:
        if len(ids) < 2:
            raise ValueError("a tree needs two samples")
        names, d = [str(s) for s in ids], m.astype(float).copy()
        while (n := len(names)) > 2:
            total = d.sum(axis=1)
            q = (n - 2) * d - total[:, None] - total[None, :]
            np.fill_diagonal(q, np.inf)
            i, j = sorted(divmod(int(q.round(12).argmin()), n))
            raw = 0.5 * d[i, j] + (total[i] - total[j]) / (2 * (n - 2))
            limb, other = max(0.0, raw), max(0.0, d[i, j] - raw)
            joined = 0.5 * (d[i] + d[j] - d[i, j])
            rest = [k for k in range(n) if k not in (i, j)]
            names = [names[k] for k in rest] + [f"({names[i]}:{limb:.6f},{names[j]}:{other:.6f})"]
            grown = np.zeros((n - 1, n - 1))
            grown[:-1, :-1] = d[np.ix_(rest, rest)]
            grown[-1, :-1] = grown[:-1, -1] = joined[rest]
            d = grown
        half = max(0.0, d[0, 1] / 2)
        return pd.DataFrame({"newick": [f"({names[0]}:{half:.6f},{names[1]}:{half:.6f});"]})

    return per_matrix(square(dist, samples), solve, "newick string")


def communities(edges: DataFrame) -> DataFrame:
    """sample, community: greedy unweighted modularity. The pair of linked communities of the largest gain (ties by
    their least members) merges while the gain is positive; communities are numbered by size, then least member."""

    def solve(ids: list, m: np.ndarray) -> pd.DataFrame:
        e = m / m.sum()
        members = [[s] for s in ids]
        while len(members) > 1:
            a = e.sum(axis=1)
            gain = np.where(e > 0, 2 * (e - np.outer(a, a)), -np.inf)
            np.fill_diagonal(gain, -np.inf)
            i, j = sorted(divmod(int(np.round(gain, 12).argmax()), len(members)))
            if not gain[i, j] > 1e-12:
                break
            e[i] += e[j]
            e[:, i] += e[:, j]
            e = np.delete(np.delete(e, j, 0), j, 1)
            members[i] = sorted(members[i] + members.pop(j))
        members.sort(key=lambda x: (-len(x), x[0]))
        rows = [(s, k + 1) for k, x in enumerate(members) for s in x]
        return pd.DataFrame(rows, columns=["sample", "community"]).astype({"community": "int32"})

    one = edges.select("u", "v", F.lit(1.0).alias("value"))
    return per_matrix(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "value")), solve, "sample string, community int")


def nnls(gram: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Least squares with w >= 0 from the normal equations, by Lawson and Hanson's active sets."""
    n = len(target)
    w, passive = np.zeros(n), np.zeros(n, dtype=bool)
    for _ in range(30 * n):
        slope = target - gram @ w
        free = np.where(passive, -np.inf, slope)
        if free.max(initial=-np.inf) <= 1e-12:
            break
        passive[int(free.argmax())] = True
        while True:
            at = np.flatnonzero(passive)
            s = np.zeros(n)
            s[at] = np.linalg.lstsq(gram[np.ix_(at, at)], target[at], rcond=None)[0]
            if s[at].min(initial=1.0) > 0:
                w = s
                break
            falls = at[s[at] <= 0]
            step = np.min(w[falls] / np.maximum(w[falls] - s[falls], 1e-300))
            w = w + step * (s - w)
            passive &= w > 1e-15
            w[~passive] = 0.0
    return w


def shared_bins(probs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """u, v, value: dot products of the samples of left with those of right that have a bin in common."""
    side = lambda names, one, p: probs.join(names.select("sample").distinct(), "sample", "left_semi").select(F.col("sample").alias(one), "bin", F.col("p").alias(p))
    return side(left, "u", "x").join(side(right, "v", "y"), "bin").groupBy("u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("value"))


def raw_weights(probs: DataFrame, pools: DataFrame, individuals: DataFrame) -> DataFrame:
    """pool_sample, sample, raw, residual_norm: the non-negative weights that bring the individuals nearest to each
    pool, a row for every pair. Pools and individuals without a bin in common, or without any, have weight 0.

    Dot products come from joins on bin. The individuals' own, at most MOST squared, are sent to all tasks once;
    each pool's problem is then a row with its products."""
    spark = probs.sparkSession
    ids = sorted(r[0] for r in individuals.select("sample").distinct().limit(MOST + 1).collect())
    if len(ids) > MOST:
        raise ValueError(f"more than {MOST} individuals")
    place = {s: i for i, s in enumerate(ids)}
    gram = np.zeros((len(ids), len(ids)))
    for r in shared_bins(probs, individuals, individuals).toLocalIterator():
        gram[place[r.u], place[r.v]] = r.value
    shared = spark.sparkContext.broadcast(gram)
    own = probs.groupBy("sample").agg(F.sum(F.col("p") * F.col("p")).alias("own"))
    aims = shared_bins(probs, pools, individuals).groupBy(F.col("u").alias("sample")).agg(F.collect_list(F.struct("v", "value")).alias("aims"))
    rows = pools.select("sample").distinct().join(own, "sample", "left").join(aims, "sample", "left")

    def solve(batches):
        for b in batches:
            for pool_sample, own, aims in zip(b["sample"], b.own, b.aims, strict=True):
                t = np.zeros(len(ids))
                for c in aims if aims is not None else ():
                    t[place[c["v"]]] = c["value"]
                w = nnls(shared.value, t)
                size = 0.0 if pd.isna(own) else own
                residual = float(np.sqrt(max(size - 2 * w @ t + w @ shared.value @ w, 0.0)))
                yield pd.DataFrame({"pool_sample": pool_sample, "sample": ids, "raw": w, "residual_norm": residual})

    kind = dict(probs.dtypes)["sample"]
    return rows.mapInPandas(solve, f"pool_sample {kind}, sample {kind}, raw double, residual_norm double")


def deconvolve(probs: DataFrame, pools: DataFrame, individuals: DataFrame) -> DataFrame:
    """pool_sample, sample, weight, residual_norm: the raw weights over their sum (zeros stay zeros); the residual is
    that of the raw ones. See raw_weights."""
    raw = raw_weights(probs, pools, individuals)
    total = F.sum("raw").over(Window.partitionBy("pool_sample"))
    return raw.select("pool_sample", "sample", F.when(total > 0, F.col("raw") / total).otherwise(0.0).alias("weight"), "residual_norm")


def optimal_weights(raw: DataFrame, probs: DataFrame, pools: DataFrame, individuals: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """pool_sample, sample, optimal: whether raw weights meet the conditions of the least squares (Karush, Kuhn and
    Tucker): none is negative, and the error falls along none, or along none that is 0. Worked out by joins."""
    aims = shared_bins(probs, pools, individuals).select(F.col("u").alias("pool_sample"), F.col("v").alias("sample"), F.col("value").alias("aim"))
    gram = shared_bins(probs, individuals, individuals).select(F.col("u").alias("other"), F.col("v").alias("sample"), "value")
    held = raw.select("pool_sample", F.col("sample").alias("other"), "raw").join(gram, "other").groupBy("pool_sample", "sample").agg(F.sum(F.col("raw") * F.col("value")).alias("held"))
    slope = F.coalesce("aim", F.lit(0.0)) - F.coalesce("held", F.lit(0.0))
    rows = raw.join(aims, ["pool_sample", "sample"], "left").join(held, ["pool_sample", "sample"], "left")
    good = (F.col("raw") >= 0) & (slope <= tolerance) & ((F.col("raw") == 0) | (slope >= -tolerance))
    return rows.select("pool_sample", "sample", good.alias("optimal"))


def group_weights(weights: DataFrame, groups: DataFrame) -> DataFrame:
    """pool_sample, auto_group, weight: the individuals' weights summed by their groups."""
    return weights.join(groups, "sample").groupBy("pool_sample", "auto_group").agg(F.sum("weight").alias("weight"))
