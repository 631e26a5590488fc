"""Optimal-transport (Ollivier-Ricci) curvature of edges: one small transport problem for each edge, in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skeinlab.operators.graph import adjacency


def transport(mu: np.ndarray, nu: np.ndarray, cost: np.ndarray, eps: float = 1e-13) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flow, a, b): the cheapest way to move the masses mu to nu (equal sums), by shortest augmenting paths, and its
    proof: potentials with b[j] - a[i] <= cost[i, j] everywhere and equal where mass flows, so that nu b - mu a, which
    no plan can undercut, is what the flow costs."""
    flow, supply, demand = np.zeros_like(cost), mu.astype(float).copy(), nu.astype(float).copy()
    while supply.max(initial=0) > eps and demand.max(initial=0) > eps:
        du, dv = np.where(supply > eps, 0.0, np.inf), np.full(len(demand), np.inf)
        pu, pv = np.full(len(du), -1), np.full(len(dv), -1)
        for _ in range(len(du) + len(dv)):
            through = du[:, None] + cost
            best = through.argmin(axis=0)
            better = through[best, np.arange(len(dv))] < dv - 1e-15
            dv[better], pv[better] = through[best, np.arange(len(dv))][better], best[better]
            back = np.where(flow > eps, dv[None, :] - cost, np.inf)
            best = back.argmin(axis=1)
            lower = back[np.arange(len(du)), best] < du - 1e-15
            du[lower], pu[lower] = back[np.arange(len(du)), best][lower], best[lower]
            if not (better.any() or lower.any()):
                break
        j = int(np.where(demand > eps, dv, np.inf).argmin())
        path, end, i = [], j, int(pv[j])
        path.append((i, j, 1))
        while pu[i] >= 0:
            j = int(pu[i])
            path.append((i, j, -1))
            i = int(pv[j])
            path.append((i, j, 1))
        amount = min([supply[i], demand[end], *[flow[a, b] for a, b, s in path if s < 0]])
        for a, b, s in path:
            flow[a, b] += s * amount
        supply[i] -= amount
        demand[end] -= amount
    return flow, *_potentials(flow, cost, eps)


def _potentials(flow: np.ndarray, cost: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Shortest distances in what the flow leaves open: every cell forwards, cells in use backwards."""
    a = np.zeros(len(cost))
    for _ in range(sum(cost.shape) + 1):
        b = (a[:, None] + cost).min(axis=0)
        lower = np.minimum(a, np.where(flow > eps, b[None, :] - cost, np.inf).min(axis=1))
        if not (lower < a - 1e-15).any():
            break
        a = lower
    return a, b


def transport_plans(edges: DataFrame, metric: DataFrame, idleness: float = 0.0) -> DataFrame:
    """u, v, length, x, y, mx, my, cost, flow, a, b for each edge and pair of places that it moves mass between.

    Each end keeps the mass `idleness` (clipped to 0..1) and spreads the rest evenly over its neighbours; metric
    (u, v, d; all ordered pairs, u = v at 0) is the ground cost and the edge's length. An edge's problem has
    (deg u + 1)(deg v + 1) cells, gathered by equi-joins; its flow and potentials (a of x, b of y) come from
    transport."""
    keep = min(max(idleness, 0.0), 1.0)
    adj = adjacency(edges)
    deg = adj.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    spread = adj.join(deg, "u").select("u", F.col("v").alias("x"), ((1 - keep) / F.col("k")).alias("mass"))
    masses = spread.unionByName(deg.select("u", F.col("u").alias("x"), F.lit(keep).alias("mass"))).filter("mass > 0")
    left = masses.select("u", "x", F.col("mass").alias("mx"))
    right = masses.select(F.col("u").alias("v"), F.col("x").alias("y"), F.col("mass").alias("my"))
    cost = metric.select(F.col("u").alias("x"), F.col("v").alias("y"), F.col("d").alias("cost"))
    own = metric.select("u", "v", F.col("d").alias("length"))
    cells = edges.select("u", "v").join(own, ["u", "v"]).join(left, "u").join(right, "v").join(cost, ["x", "y"]).select("u", "v", "length", "x", "y", "mx", "my", "cost")

    def solve(cells: pd.DataFrame) -> pd.DataFrame:
        wide = cells.pivot(index="x", columns="y", values="cost").sort_index()
        mu = cells.drop_duplicates("x").set_index("x").mx.reindex(wide.index).to_numpy()
        nu = cells.drop_duplicates("y").set_index("y").my.reindex(wide.columns).to_numpy()
        flow, a, b = transport(mu, nu, wide.to_numpy())
        i, j = wide.index.get_indexer(cells.x), wide.columns.get_indexer(cells.y)
        return cells.assign(flow=flow[i, j], a=a[i], b=b[j])

    kinds = ", ".join(f"{c} {t}" for c, t in cells.dtypes)
    return cells.groupBy("u", "v").applyInPandas(solve, f"{kinds}, flow double, a double, b double")


def ollivier_ricci(edges: DataFrame, metric: DataFrame, idleness: float = 0.0) -> DataFrame:
    """u, v, d, orc for each edge: 1 - W1 / d, W1 the cost of its transport plan (see transport_plans). At d = 0 it is 0.
    Shortest paths as metric and idleness 0 give the geometric variant; sample distances and idleness 1 - alpha the
    calibration's."""
    moved = transport_plans(edges, metric, idleness).groupBy("u", "v").agg(F.first("length").alias("d"), F.sum(F.col("flow") * F.col("cost")).alias("w1"))
    return moved.select("u", "v", "d", F.when(F.col("d") == 0, 0.0).otherwise(1.0 - F.col("w1") / F.col("d")).alias("orc"))


def proven(plans: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """u, v, d, balanced, bounded, optimal for each edge of transport_plans: the flow is nowhere negative and moves both
    masses in full; the potentials undercut every cost; and what they promise is what the flow costs. All three
    together prove the least cost, whatever found it."""
    key = ["u", "v"]

    def off(end: str, mass: str) -> DataFrame:
        sums = plans.groupBy(*key, end).agg(F.sum("flow").alias("out"), F.first(mass).alias("m"), F.first("a" if end == "x" else "b").alias("potential"))
        worst = F.max(F.abs(F.col("out") - F.col("m")))
        return sums.groupBy(*key).agg(worst.alias(f"off_{end}"), F.sum(F.col("m") * F.col("potential")).alias(f"worth_{end}"))

    cells = plans.groupBy(*key).agg(
        F.first("length").alias("d"), F.min("flow").alias("least"), F.max(F.col("b") - F.col("a") - F.col("cost")).alias("over"), F.sum(F.col("flow") * F.col("cost")).alias("w1")
    )
    rows = cells.join(off("x", "mx"), key).join(off("y", "my"), key)
    balanced = (F.col("least") >= 0) & (F.greatest("off_x", "off_y") <= tolerance)
    gap = F.abs(F.col("worth_y") - F.col("worth_x") - F.col("w1"))
    return rows.select(*key, "d", balanced.alias("balanced"), (F.col("over") <= tolerance).alias("bounded"), (gap <= tolerance).alias("optimal"))
