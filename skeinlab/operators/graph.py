"""Graphs as edge tables (u, v, d) with u < v: neighbours, thresholds, curvature by counting, paths, centralities.

Loops run a number of rounds that grows with the graph's diameter, not with its size, and cut lineage by
checkpoints in the shared folder."""

from __future__ import annotations

import tempfile

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from skeinlab.operators.distance import both_ways


def cut(df: DataFrame) -> DataFrame:
    """df after a reliable checkpoint in the folder of spark.checkpoint.dir. Where that is unset, a local session
    takes a temporary one; on a cluster it must be named, as all machines share it."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint(eager=True)


IN_ONE_TASK = 50_000  # edges of all graphs together, up to which components and trees are found in a task to a graph


def _find(parent: dict, x):
    while parent[x] != x:
        parent[x] = x = parent[parent[x]]
    return x


def _kruskal(rows: pd.DataFrame) -> tuple[dict, list[bool]]:
    """Parents of all nodes after the rows (u, v) have been joined in turn, and which rows joined two trees."""
    parent: dict = {x: x for x in (*rows.u, *rows.v)}
    joined = []
    for u, v in zip(rows.u, rows.v, strict=True):
        a, b = sorted((_find(parent, u), _find(parent, v)))
        joined.append(a != b)
        parent[b] = a
    return parent, joined


def neighbour_ranks(dist: DataFrame) -> DataFrame:
    """u, v, d, rank: of each sample its others by distance, ties by id. Distances that are null or no finite number
    join nobody."""
    finite = dist.filter(F.col("d").isNotNull() & ~F.isnan("d") & (F.abs("d") < float("inf")))
    return both_ways(finite).withColumn("rank", F.row_number().over(Window.partitionBy("u").orderBy("d", "v")))


def canonical(directed: DataFrame) -> DataFrame:
    """Undirected edges of (u, v, d) rows in either order, each once."""
    return directed.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("d").alias("d"))


def knn_graph(dist: DataFrame, k: int = 4) -> DataFrame:
    """u, v, d: edges to the k nearest of either end."""
    return canonical(neighbour_ranks(dist).filter(F.col("rank") <= k))


def connected_knn_graph(dist: DataFrame, k: int = 4) -> tuple[DataFrame, int]:
    """The k-nearest graph of the least k, from the given one up, that is connected, and that k.

    A pair is in the graph from the lesser of its two ranks on, so the k at which all are connected is the largest
    rank in a spanning tree of least ranks. With one sample k stays; what finite distances never connect has
    all of them."""
    ranks = cut(neighbour_ranks(dist))
    n = both_ways(dist).select("u").distinct().count()
    least = ranks.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("rank").cast("double").alias("w"))
    found = spanning_forest(least).agg(F.count(F.lit(1)), F.max("w")).first() if n > 1 else (0, None)
    whole = found[0] == n - 1
    k = k if n < 2 else max(min(k, n - 1), int(found[1])) if whole else n - 1
    return canonical(ranks.filter(F.col("rank") <= k)), k


def with_affinity(edges: DataFrame) -> DataFrame:
    """edges with w = exp(-d^2 / (2 sigma^2)); sigma is the median edge length, at least 1e-9."""
    sigma = edges.agg(F.greatest(F.median("d"), F.lit(1e-9)).alias("sigma"))
    return edges.join(sigma, F.lit(True)).select("u", "v", "d", F.exp(-F.col("d") * F.col("d") / (2 * F.col("sigma") * F.col("sigma"))).alias("w"))


def similarity_edges(dist: DataFrame, q: float = 0.90) -> DataFrame:
    """u, v, d, s, threshold: pairs whose similarity 1 - d / max d reaches the q-quantile of all off-diagonal ones
    (both triangles; linear interpolation). With no distance above 0 the maximum counts as 1."""
    top = dist.agg(F.when(F.max("d") > 0, F.max("d")).otherwise(1.0).alias("top"))
    s = dist.join(top, F.lit(True)).select(F.col("a").alias("u"), F.col("b").alias("v"), "d", (1 - F.col("d") / F.col("top")).alias("s"))
    threshold = s.unionAll(s).agg(F.percentile("s", q).alias("threshold"))
    return s.join(threshold, F.lit(True)).filter("s >= threshold")


def adjacency(edges: DataFrame, *keep: str) -> DataFrame:
    """Both directions of each edge."""
    return edges.select("u", "v", *keep).unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *keep))


def degrees(edges: DataFrame) -> DataFrame:
    return adjacency(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree")).withColumnRenamed("u", "sample")


def triangles(edges: DataFrame) -> DataFrame:
    """u, v, triangles: common neighbours of each edge's ends. Wedges start at the end of lesser degree, so that a
    hub's pairs of neighbours are never spelled out."""
    adj = adjacency(edges)
    deg = adj.groupBy("u").agg(F.count(F.lit(1)).alias("k"))
    sized = edges.select("u", "v").join(deg.select("u", F.col("k").alias("ku")), "u").join(deg.select(F.col("u").alias("v"), F.col("k").alias("kv")), "v")
    low = F.col("ku") <= F.col("kv")
    hung = sized.select("u", "v", F.when(low, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedges = hung.join(adj.select(F.col("u").alias("x"), F.col("v").alias("w")), "x").filter("w <> y")
    closed = wedges.join(adj.select(F.col("u").alias("y"), F.col("v").alias("w")), ["y", "w"]).groupBy("u", "v").agg(F.count(F.lit(1)).alias("triangles"))
    return edges.select("u", "v").join(closed, ["u", "v"], "left").select("u", "v", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def forman(edges: DataFrame) -> DataFrame:
    """u, v, forman_F = 4 - degrees of both ends + 3 triangles, with the triangles."""
    deg = degrees(edges)
    rows = triangles(edges).join(deg.select(F.col("sample").alias("u"), F.col("degree").alias("du")), "u").join(deg.select(F.col("sample").alias("v"), F.col("degree").alias("dv")), "v")
    return rows.select("u", "v", (4 - F.col("du") - F.col("dv") + 3 * F.col("triangles")).alias("forman_F"), "triangles")


def node_means(edges: DataFrame, samples: DataFrame, column: str, out: str) -> DataFrame:
    """sample, out: mean of an edge column over the edges of each node; null for an isolated one."""
    mean = adjacency(edges, column).groupBy(F.col("u").alias("sample")).agg(F.avg(column).alias(out))
    return samples.select("sample").distinct().join(mean, "sample", "left")


def negative_incidence(edges: DataFrame, samples: DataFrame, column: str = "orc") -> DataFrame:
    """sample, neg_orc_incidence: sum of the negative parts of an edge column over each node's edges."""
    part = F.sum(F.when(F.col(column) < 0, -F.col(column)).otherwise(0.0))
    found = adjacency(edges, column).filter(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(F.col("u").alias("sample")).agg(part.alias("neg"))
    return samples.select("sample").distinct().join(found, "sample", "left").select("sample", F.coalesce("neg", F.lit(0.0)).alias("neg_orc_incidence"))


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, node, label for every end of an edge (u, v), separately for each value of `by`; label is the least node.

    Up to IN_ONE_TASK edges are joined in a task for each value of `by`. Beyond, labels fall to the least of a
    node's neighbours and then to their own label's label, which halves the way to it, until none changes."""
    edges = cut(edges.select(*by, "u", "v"))
    keys = list(by)
    if edges.count() <= IN_ONE_TASK:

        def joined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            parent, _ = _kruskal(rows)
            out = pd.DataFrame({"node": list(parent), "label": [_find(parent, x) for x in parent]})
            for at, c in enumerate(keys):
                out.insert(at, c, key[at])
            return out

        kinds = dict(edges.dtypes)
        schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), f"node {kinds['u']}, label {kinds['u']}"])
        return edges.withColumn("_all", F.lit(0)).groupBy(*(keys or ["_all"])).applyInPandas(joined, schema)
    adj = cut(adjacency(edges, *by))
    now = cut(adj.select(*keys, F.col("u").alias("node"), F.col("u").alias("label")).distinct())
    while True:
        heard = adj.join(now.select(*keys, F.col("node").alias("v"), F.col("label").alias("other")), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("other").alias("other"))
        low = now.join(heard, [*keys, "node"]).select(*keys, "node", "label", F.least("label", "other").alias("new"))
        up = now.select(*keys, F.col("node").alias("new"), F.col("label").alias("jump"))
        new = cut(low.join(up, [*keys, "new"]).select(*keys, "node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("label")).alias("moved")))
        now = new.drop("moved")
        if new.filter("moved").isEmpty():
            return now


def spanning_forest(edges: DataFrame) -> DataFrame:
    """u, v, w: a spanning tree of least weight for each component of the edges (u, v, w), by Boruvka's rounds.

    In a round every component takes its least edge to another (ties by the ends' ids, so that no cycle closes)
    and joins what it leads to; the number of components at least halves. Edges inside a component go. Up to
    IN_ONE_TASK edges are gone through by weight in one task."""
    edges = cut(edges.select("u", "v", "w"))
    if edges.count() <= IN_ONE_TASK:

        def tree(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["w", "u", "v"])
            return rows.loc[_kruskal(rows)[1], ["u", "v", "w"]]

        return edges.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(tree, edges.schema)
    now = cut(edges.filter("u <> v").select("u", "v", "w", F.col("u").alias("a"), F.col("v").alias("b")))
    tree = None
    while not now.isEmpty():
        order = F.struct("w", F.least("u", "v").alias("lo"), F.greatest("u", "v").alias("hi"), "u", "v", "a", "b")
        ends = now.select(F.col("a").alias("c"), order.alias("e")).unionByName(now.select(F.col("b").alias("c"), order.alias("e")))
        taken = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct())
        more = taken.select("u", "v", "w")
        tree = more if tree is None else tree.unionByName(more)
        label = components(taken.select(F.col("a").alias("u"), F.col("b").alias("v")))
        of = lambda c: label.select(F.col("node").alias(c), F.col("label").alias(f"to_{c}"))
        now = cut(now.join(of("a"), "a").join(of("b"), "b").filter("to_a <> to_b").select("u", "v", "w", F.col("to_a").alias("a"), F.col("to_b").alias("b")))
    return edges.select("u", "v", "w").limit(0) if tree is None else tree


def shortest_paths(edges: DataFrame, samples: DataFrame) -> DataFrame:
    """u, v, d: least path length between all connected pairs (u = v: 0), with non-negative edge lengths.

    Each round joins the pairs that got shorter with the edges, so the rounds are the most edges of a path."""
    adj = cut(adjacency(edges, "d").select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("d").alias("step")))
    now = cut(samples.select(F.col("sample").alias("u"), F.col("sample").alias("v"), F.lit(0.0).alias("d")).distinct())
    fresh = now
    while not fresh.isEmpty():
        tried = fresh.join(adj, F.col("v") == F.col("m")).groupBy("u", F.col("w").alias("v")).agg(F.min(F.col("d") + F.col("step")).alias("t"))
        merged = cut(now.join(tried, ["u", "v"], "full").select("u", "v", "d", "t"))
        fresh = merged.filter("t IS NOT NULL AND (d IS NULL OR t < d)").select("u", "v", F.col("t").alias("d"))
        now = merged.select("u", "v", F.least("d", "t").alias("d"))
    return now


def closeness(paths: DataFrame) -> DataFrame:
    """sample, closeness: (reached - 1) / total length, scaled by (reached - 1) / (n - 1); 0 for a lone node."""
    n = paths.select("u").distinct().agg(F.count(F.lit(1)).alias("n"))
    per = paths.groupBy(F.col("u").alias("sample")).agg((F.count(F.lit(1)) - 1).alias("k"), F.sum("d").alias("t")).join(n, F.lit(True))
    value = F.when((F.col("t") > 0) & (F.col("n") > 1), F.col("k") / F.col("t") * F.col("k") / (F.col("n") - 1)).otherwise(0.0)
    return per.select("sample", value.alias("closeness"))


def betweenness(edges: DataFrame, paths: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """sample, betweenness: share of the shortest paths between other nodes that pass a node, over all pairs.

    Edge (m, w) lies on a shortest path from s if d(s, m) + its length = d(s, w), up to a relative tolerance. The
    numbers of paths are summed along these edges away from s round by round; then every node sends one unit back,
    split among its predecessors by their numbers of paths, and what passes a node is its share of the paths from s.
    The joins hold a row for each start and edge."""
    paths = cut(paths)
    adj = adjacency(edges, "d").select(F.col("u").alias("m"), F.col("v").alias("w"), F.col("d").alias("step"))
    near = lambda a, b: F.abs(a - b) <= tolerance * (1 + F.abs(b))
    p, q = paths.select(F.col("u").alias("s"), F.col("v").alias("m"), F.col("d").alias("dm")), paths.select(F.col("u").alias("s"), F.col("v").alias("w"), F.col("d").alias("dw"))
    tight = cut(p.join(adj, "m").join(q, ["s", "w"]).filter(near(F.col("dm") + F.col("step"), F.col("dw"))).filter("step > 0").select("s", "m", "w"))
    origin = paths.filter("u = v").select(F.col("u").alias("s"), F.col("v").alias("m"), F.lit(1.0).alias("c"))
    count = wave = cut(origin)
    while True:  # wave: the paths of just so many edges
        wave = cut(wave.join(tight, ["s", "m"]).groupBy("s", F.col("w").alias("m")).agg(F.sum("c").alias("c")))
        if wave.isEmpty():
            break
        count = cut(count.unionByName(wave).groupBy("s", "m").agg(F.sum("c").alias("c")))
    share = cut(tight.join(count, ["s", "m"]).join(count.toDF("s", "w", "cw"), ["s", "w"]).select("s", "m", "w", (F.col("c") / F.col("cw")).alias("part")))
    wave = count.select("s", F.col("m").alias("w"), F.lit(1.0).alias("f"))
    total = None
    while True:  # wave: what has come back over just so many edges
        wave = cut(wave.join(share, ["s", "w"]).filter("m <> s").groupBy("s", F.col("m").alias("w")).agg(F.sum(F.col("f") * F.col("part")).alias("f")))
        if wave.isEmpty():
            break
        more = wave.groupBy(F.col("w").alias("sample")).agg(F.sum("f").alias("b"))
        total = cut(more if total is None else total.unionByName(more).groupBy("sample").agg(F.sum("b").alias("b")))
    nodes = paths.select(F.col("u").alias("sample")).distinct()
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    found = nodes.withColumn("b", F.lit(0.0)) if total is None else nodes.join(total, "sample", "left")
    # each pair was met from both of its ends
    scale = F.when(F.col("n") > 2, 1.0 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.5)
    return found.join(n, F.lit(True)).select("sample", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def thresholds(dist: DataFrame, count: int = 21) -> DataFrame:
    """threshold: quantiles of the off-diagonal distances (both triangles) at `count` even steps from 0.05 to 0.95."""
    steps = [0.05 + 0.9 * i / max(1, count - 1) for i in range(count)]
    values = both_ways(dist).agg(F.percentile("d", steps).alias("t"))
    return values.select(F.posexplode("t").alias("step", "threshold"))


def threshold_edges(dist: DataFrame, cuts: DataFrame) -> DataFrame:
    """step, u, v, d: for each threshold the pairs within it. The edge sets are nested, each step's is whole."""
    return dist.join(F.broadcast(cuts), F.col("d") <= F.col("threshold")).select("step", F.col("a").alias("u"), F.col("b").alias("v"), "d")


def cliques(edges: DataFrame, most: int = 20_000_000) -> DataFrame:
    """size, birth, n: the cliques of two nodes or more of the graph (u, v, d) by their longest edge.

    Each clique is met once: it grows by a later node that all its nodes know, and keeps with each such node the
    longest edge to it. Up to IN_ONE_TASK edges, the edges are sent to all tasks and each grows the cliques of its own
    (the two least nodes of a clique say whose it is); beyond, all grow level by level in joins. More than
    `most` cliques in a task or level stop the job rather than being cut."""
    both = cut(canonical(edges))
    if both.count() <= IN_ONE_TASK:
        return _cliques_in_tasks(both, most)
    later = cut(both.groupBy("u").agg(F.array_sort(F.collect_list(F.struct("v", "d"))).alias("next")))
    level = cut(both.join(later, "u").select(F.col("v").alias("last"), F.col("d").alias("birth"), F.filter("next", lambda x: x["v"] > F.col("v")).alias("open")))
    found, size = None, 2
    while rows := level.count():
        if rows > most:
            raise ValueError(f"{rows} cliques of {size} nodes; at most {most} are listed")
        births = level.groupBy(F.lit(size).alias("size"), "birth").agg(F.count(F.lit(1)).alias("n"))
        found = births if found is None else found.unionByName(births)
        # what all of a clique's nodes and its last one know, with the longer of the edges to it
        grown = level.filter(F.size("open") > 0).join(later.select(F.col("u").alias("last"), "next"), "last")
        known = F.transform("next", lambda x: x["v"])
        met = F.filter("open", lambda x: F.array_position(known, x["v"]) > 0)
        grown = grown.select("birth", F.transform(met, lambda x: F.struct(x["v"].alias("v"), F.greatest(x["d"], F.get("next", (F.array_position(known, x["v"]) - 1).cast("int"))["d"]).alias("d"))).alias("open"))
        each = grown.select("birth", "open", F.posexplode("open").alias("at", "to"))
        level = cut(each.select(F.col("to.v").alias("last"), F.greatest("birth", "to.d").alias("birth"), F.slice("open", F.col("at") + 2, F.size("open")).alias("open")))
        size += 1
    empty = edges.sparkSession.createDataFrame([], "size int, birth double, n bigint")
    return empty if found is None else found


def _cliques_in_tasks(edges: DataFrame, most: int) -> DataFrame:
    spark = edges.sparkSession
    known: dict = {}
    for u, v, d in edges.collect():  # IN_ONE_TASK rows at most
        known.setdefault(u, {})[v] = d
    shared = spark.sparkContext.broadcast(known)

    def grow(batches):
        later = shared.value
        counts: dict[tuple[int, float], int] = {}
        seen = 0
        for b in batches:
            for u, v, d in zip(b.u, b.v, b.d, strict=True):
                mine, other = later[u], later.get(v, {})
                held = [(2, d, [(x, max(mine[x], e)) for x, e in other.items() if x in mine])]
                while held:
                    size, birth, open_ = held.pop()
                    counts[size, birth] = counts.get((size, birth), 0) + 1
                    seen += 1
                    if seen > most:
                        raise ValueError(f"more than {most} cliques in a task")
                    for w, reach in open_:
                        near = later.get(w, {})
                        held.append((size + 1, max(birth, reach), [(x, max(r, near[x])) for x, r in open_ if x in near]))
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["size", "birth", "n"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = edges.repartition(n, "u", "v").mapInPandas(grow, "size int, birth double, n bigint")
    return counts.groupBy("size", "birth").agg(F.sum("n").alias("n"))


def topology_counts(dist: DataFrame, samples: DataFrame, count: int = 21) -> DataFrame:
    """threshold, V, E, components, beta1_graph, euler_clique_complex, max_clique_size at each threshold.

    A filtration: an edge is born at its length, a clique at its longest edge, and two components merge at an edge
    of the least spanning tree; every threshold counts what is born by then."""
    cuts = cut(thresholds(dist, count))
    top = cuts.agg(F.max("threshold")).first()[0]
    edges = cut(dist.filter(F.col("d") <= F.lit(top)).select(F.col("a").alias("u"), F.col("b").alias("v"), "d"))
    v = samples.select("sample").distinct().count()
    merges = spanning_forest(edges.select("u", "v", F.col("d").alias("w"))).groupBy(F.col("w").alias("birth")).agg(F.count(F.lit(1)).alias("n"))
    born = merges.select(F.lit(0).alias("size"), "birth", "n").unionByName(cliques(edges))
    # births are summed in the first threshold that reaches them, then over the thresholds
    first = F.broadcast(cuts.agg(F.array_sort(F.collect_list(F.struct("threshold", "step"))).alias("cuts")))
    step = F.get(F.filter("cuts", lambda c: c["threshold"] >= F.col("birth")), F.lit(0))["step"]
    sums = born.join(first, F.lit(True)).groupBy(step.alias("at"), "size").agg(F.sum("n").alias("n"))
    sums = cut(sums)
    upto = cuts.join(F.broadcast(sums), F.col("at") <= F.col("step"), "left").groupBy("step", "threshold")
    size, n = F.col("size"), F.col("n")
    total = lambda value: F.coalesce(F.sum(value), F.lit(0))
    rows = upto.agg(
        total(F.when(size == 0, n)).alias("merged"),
        total(F.when(size == 2, n)).alias("E"),
        total(F.when(size >= 2, n * F.when(size % 2 == 1, 1).otherwise(-1))).alias("chi"),
        F.greatest(F.coalesce(F.max("size"), F.lit(0)), F.lit(min(v, 1))).alias("top"),
    )
    c = F.lit(v) - F.col("merged")
    return rows.select(
        "step", "threshold", F.lit(v).alias("V"), "E", c.alias("components"), (F.col("E") - v + c).alias("beta1_graph"), (F.col("chi") + v).alias("euler_clique_complex"), F.col("top").alias("max_clique_size")
    )


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    return edges.join(nodes.select(F.col("sample").alias("u")), "u", "left_semi").join(nodes.select(F.col("sample").alias("v")), "v", "left_semi")

