"""Density clustering on tables: mutual reachability, spanning forest, condensed tree, selection.

The hierarchy follows from the forest. Components under min_cluster points are joined first:
two that are each other's first neighbours are exactly what single linkage joins next, so
all such pairs join at once, in at most min_cluster rounds. Where a join reaches min_cluster
points, a core is born. What stays small hangs on a core, and the tree contracts to the
cores, of which there are at most rows / min_cluster. Only this contraction of a group, and
later its clusters with their sums, are seen by one task; points find their cluster by joins.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators.forest import first_edges, mutual, renamed, roots, spanning_forest
from loamwork.operators.neighbours import knn, knn_within
from loamwork.plans.workspace import settled

#: Neighbours of each point in the graph, beyond those that core distances need.
MORE_NEIGHBOURS = 10
#: Stabilities count as equal within this share of what they are differences of.
EPS = 1e-9
_NODES = "node long, parent long, start struct<w:double,x:long,y:long>, core long, ups array<struct<node:long,start:struct<w:double,x:long,y:long>>>"


def auto_params(n: int) -> tuple[int, int]:
    """M9: (min_cluster_size, min_samples) for n points."""
    return max(5, min(50, n // 500)), max(2, min(20, n // 100))


def core_distances(rows: DataFrame, min_samples: int, search: Callable[..., DataFrame] = knn) -> DataFrame:
    """M8: contig_id, core: the distance of the min_samples-th neighbour; the point itself is the first."""
    v = rows.select("contig_id", "vec")
    return search(v, v, max(1, min_samples - 1)).groupBy("query_id").agg(F.max("distance").alias("core")).withColumnRenamed("query_id", "contig_id")


def reachability(neighbours: DataFrame, cores: DataFrame) -> DataFrame:
    """M8: neighbour edges by mutual reachability: the greatest of both core distances and the distance."""
    a, b = (cores.select(F.col("contig_id").alias(k), F.col("core").alias(f"core_{k}")) for k in ("query_id", "ref_id"))
    return neighbours.join(a, "query_id").join(b, "ref_id").select("query_id", "ref_id", F.greatest("distance", "core_query_id", "core_ref_id").alias("reach"))


def reach_graph(rows: DataFrame, key: str, min_samples: int, neighbours: int = 0, search: Callable[..., DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """M8: (points with their core distance, edges x < y with w by mutual reachability) of the nearest neighbours inside each group.

    neighbours is how many each point brings, min_samples + MORE_NEIGHBOURS unless given.
    search(queries, refs, k) finds them where there is one group only.
    """
    x = settled(rows.select(F.col(key).alias("key"), "contig_id", "vec"))
    k = neighbours or min_samples + MORE_NEIGHBOURS
    near = settled(search(x, x, k) if search else knn_within(x, "key", k))
    cores = near.where(F.col("rank") < max(2, min_samples)).groupBy("query_id").agg(F.max("distance").alias("core")).withColumnRenamed("query_id", "contig_id")
    cores = settled(x.select("contig_id").join(cores, "contig_id", "left").select("contig_id", F.coalesce("core", F.lit(0.0)).alias("core") if min_samples > 1 else F.lit(0.0).alias("core")))
    reach = reachability(near, cores)
    edges = reach.select(F.least("query_id", "ref_id").alias("x"), F.greatest("query_id", "ref_id").alias("y"), F.col("reach").alias("w")).groupBy("x", "y").agg(F.min("w").alias("w"))
    return settled(x.join(cores, "contig_id")), settled(edges)


def _grown(forest: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Joins of components below least points: (comp, parent) of those that stay below, (comp, core, w, x, y) of those that reach it, and the edges left."""
    left = settled(forest.select(F.col("x").alias("a"), F.col("y").alias("b"), "w", "x", "y"))
    sizes = settled(left.select(F.col("a").alias("comp"), F.lit(1).alias("n")).limit(0))  # of components with more than one point
    links, births = sizes.select("comp", F.col("comp").alias("parent")), left.select(F.col("a").alias("comp"), F.col("b").alias("core"), "w", "x", "y").limit(0)
    while True:
        best = first_edges(left).join(sizes, "comp", "left").withColumn("n", F.coalesce("n", F.lit(1)))
        best = settled(best.where(F.col("n") < least))
        other = best.select(F.col("comp").alias("other"), F.col("n").alias("m"))
        pairs = settled(mutual(best).join(best.select("comp", "n"), "comp").join(other, "other").select("comp", "other", "w", "x", "y", (F.col("n") + F.col("m")).cast("int").alias("n")))
        if pairs.isEmpty():
            return settled(links), settled(births), left
        born = pairs.where(F.col("n") >= least)
        links = links.unionByName(pairs.where(F.col("n") < least).select(F.col("other").alias("comp"), F.col("comp").alias("parent")))
        births = births.unionByName(born.select(F.explode(F.array("comp", "other")).alias("comp"), F.col("comp").alias("core"), "w", "x", "y"))
        joined = pairs.select(F.explode(F.array("comp", "other")).alias("comp"))
        sizes = settled(sizes.join(joined, "comp", "left_anti").unionByName(pairs.select("comp", "n")))
        left = settled(renamed(left, pairs.select(F.col("other").alias("comp"), F.col("comp").alias("root"))))


def _tree(cores: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The clusters of one group: a leaf a core, and a cluster for each edge between cores, in order of edges. ups are a cluster's ancestors 1, 2, 4 ... above."""
    names = np.sort(cores["core"].to_numpy())
    start = cores.sort_values("core")[["w", "x", "y"]].to_dict("records")
    parent, top = [-1] * len(names), list(range(len(names)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    for e in edges.sort_values(["w", "x", "y"]).itertuples():
        new = len(parent)
        for end in (e.a, e.b):
            old = find(int(np.searchsorted(names, end)))
            parent[old] = top[old] = new
        parent.append(-1)
        top.append(new)
        start.append({"w": e.w, "x": e.x, "y": e.y})
    ups: list[list[int]] = [[] for _ in parent]
    for i in range(len(parent) - 1, -1, -1):  # ancestors have higher numbers
        at, k = parent[i], 0
        while at >= 0:
            ups[i].append(at)
            at, k = (ups[at][k] if k < len(ups[at]) else -1), k + 1
    n = len(names)
    return pd.DataFrame({"node": range(len(parent)), "parent": parent, "start": start, "core": [*names.tolist(), *[-1] * (len(parent) - n)], "ups": [[{"node": u, "start": start[u]} for u in x] for x in ups]})


def _fallen(falls: DataFrame, nodes: DataFrame) -> DataFrame:
    """Where each component falls out: from the leaf of its core up to the last cluster that had started by then. Steps halve."""
    at = falls.join(nodes.where("core >= 0").select("key", "core", "node"), "core")
    steps = nodes.agg(F.max(F.size("ups"))).first()[0] or 0
    for k in reversed(range(steps)):
        up = nodes.where(F.size("ups") > k).select("key", "node", F.col("ups")[k].alias("up"))
        at = at.join(up, ["key", "node"], "left")
        at = at.withColumn("node", F.when(F.col("up.start") <= F.struct("w", "x", "y"), F.col("up.node")).otherwise(F.col("node"))).drop("up")
    return at


def select_clusters(parent: np.ndarray, rate: np.ndarray, count: np.ndarray, total: np.ndarray, method: str = "eom", epsilon: float = 0.0, max_cluster: int = 0) -> np.ndarray:
    """M8: the number of the chosen cluster that each cluster of a tree belongs to, or -1.

    Children come before parents; the last is the root, which is never chosen. rate is the
    density at which a cluster starts to be one, count and total the number and the summed
    densities of the points that fall out of it.
    """
    n = len(parent)
    birth = np.append(rate[parent[:-1]], 0.0)
    size, own, below, kids = count.astype(float), total - birth * count, np.zeros(n), np.zeros(n, int)
    stability, chosen = np.zeros(n), np.zeros(n, bool)
    for c in range(n):
        leaf, fits = not kids[c], not max_cluster or size[c] <= max_cluster
        chosen[c] = c < n - 1 and (leaf or (method == "eom" and own[c] >= below[c] - EPS * (abs(below[c]) + birth[c] * size[c]) and fits))
        stability[c] = own[c] if chosen[c] else below[c]
        if c < n - 1:
            up = parent[c]
            size[up] += size[c]
            own[up] += (birth[c] - birth[up]) * size[c]
            below[up] += stability[c]
            kids[up] += 1
    free = np.ones(n, bool)  # no ancestor is chosen
    for c in range(n - 2, -1, -1):
        free[c] = free[parent[c]] and not chosen[parent[c]]
    final = set(np.flatnonzero(chosen & free).tolist())
    if epsilon > 0:
        moved = set()
        for c in final:
            while parent[c] != n - 1 and birth[c] > 1 / epsilon:
                c = int(parent[c])
            moved.add(c)
        final = moved
    part, name = np.full(n, -1), {}
    for c in range(n - 2, -1, -1):
        part[c] = part[parent[c]]
        if part[c] < 0 and c in final:
            part[c] = name[c] = len(name)
    return part


def cluster(rows: DataFrame, key: str, min_cluster: int, min_samples: int, method: str = "leaf", epsilon: float = 0.0, max_cluster: int = 0, neighbours: int = 0, search: Callable[..., DataFrame] | None = None) -> DataFrame:
    """M8: contig_id, part, prob: density clusters inside each group of rows (key, contig_id, vec); -1 is noise.

    method 'eom' keeps the most stable clusters, 'leaf' the finest. With max_cluster, larger
    clusters give way to those below them; with epsilon, a chosen cluster born below that
    distance gives way to its first ancestor born above it. The forest is the one of
    reach_graph, so with as many neighbours as a group has rows it is exact, and with fewer
    only distances between far points can be missed. No task sees a whole group: the most is
    its clusters' cores, at most rows / min_cluster.
    """
    least = max(2, min_cluster)
    points, edges = reach_graph(rows, key, min_samples, neighbours, search)
    links, births, left = _grown(spanning_forest(points, edges), least)
    cores = settled(births.where("comp = core").join(points.select(F.col("contig_id").alias("core"), "key"), "core").select("key", "core", "w", "x", "y"))
    hang = settled(first_edges(left).join(cores.select(F.col("core").alias("comp")), "comp", "left_anti"))
    names = roots(hang.select("comp", F.col("other").alias("parent")))
    falls = births.unionByName(hang.join(names, "comp").select("comp", F.col("root").alias("core"), "w", "x", "y"))
    between = settled(renamed(left, names).join(cores.select(F.col("core").alias("a"), "key"), "a").select("key", "a", "b", "w", "x", "y"))
    nodes = settled(cores.groupBy("key").cogroup(between.groupBy("key")).applyInPandas(lambda k, c, e: _tree(c, e).assign(key=k[0]), f"key {dict(points.dtypes)['key']}, {_NODES}"))
    at = settled(_fallen(falls, nodes).select("comp", "key", "node", F.when(F.col("w") > 0, 1 / F.col("w")).otherwise(F.lit(float("inf"))).alias("rate")))
    small = roots(links).select(F.col("comp").alias("contig_id"), F.col("root").alias("comp"))
    fell = points.select("contig_id").join(small, "contig_id", "left").withColumn("comp", F.coalesce("comp", "contig_id")).join(at, "comp")
    highest = at.where(F.col("rate") < float("inf")).groupBy("key").agg(F.max("rate").alias("top"))
    fell = settled(fell.join(highest, "key", "left").select("key", "contig_id", "node", F.least("rate", F.coalesce("top", F.lit(1.0))).alias("rate"), F.coalesce("top", F.lit(1.0)).alias("top")))
    sums = fell.groupBy("key", "node").agg(F.count("*").alias("count"), F.sum("rate").alias("total"))
    tops = fell.groupBy("key").agg(F.first("top").alias("top"))

    def chosen(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        part = select_clusters(*(pdf[c].to_numpy() for c in ("parent", "rate", "count", "total")), method, epsilon, max_cluster)
        return pd.DataFrame({"key": k[0], "node": pdf["node"], "part": part})

    rate = F.least(F.when(F.col("start.w") > 0, 1 / F.col("start.w")).otherwise(F.lit(float("inf"))), F.col("top"))
    known = nodes.join(tops, "key").join(sums, ["key", "node"], "left").select("key", "node", "parent", rate.alias("rate"), F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("total", F.lit(0.0)).alias("total"))
    parts = known.groupBy("key").applyInPandas(chosen, f"key {dict(points.dtypes)['key']}, node long, part long")
    found = settled(fell.join(parts.where("part >= 0"), ["key", "node"]).select("key", "contig_id", "part", "rate"))
    most = found.groupBy("key", "part").agg(F.max("rate").alias("most"))
    found = found.join(most, ["key", "part"]).select("contig_id", "part", (F.col("rate") / F.col("most")).alias("prob"))
    return settled(points.select("contig_id").join(found, "contig_id", "left").select("contig_id", F.coalesce("part", F.lit(-1)).alias("part"), F.coalesce("prob", F.lit(0.0)).alias("prob")))
