"""Minimum spanning forests over neighbour graphs, as rounds on edge tables.

Edges are ordered by (weight, lower end, higher end), so no two are equal and the forest is
the only one. A round takes every component's first outgoing edge, joins what these connect
and keeps one edge between two components; the tables shrink by half or more a round. Where
the graph falls apart, components other than their group's largest are tied to the nearest
point outside, found in blocks of points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.operators.neighbours import BLOCK
from loamwork.plans.workspace import few, settled


def roots(links: DataFrame) -> DataFrame:
    """comp, root of a table of (comp, parent) without cycles, but for roots that are their own parents or have no row; paths halve with every join."""
    now = settled(links.select("comp", "parent"))
    while True:
        up = now.select(F.col("comp").alias("parent"), F.col("parent").alias("higher"))
        higher = F.coalesce("higher", "parent")
        moved = settled(now.join(up, "parent", "left").select("comp", higher.alias("parent"), (higher != F.col("parent")).alias("moved")))
        if moved.where("moved").isEmpty():
            return moved.select("comp", F.col("parent").alias("root"))
        now = moved.drop("moved")


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges (a, b, w, x, y) with ends a and b replaced by their root in names (comp, root), where they have one; what lies inside one component goes."""
    for end in "ab":
        other = names.select(F.col("comp").alias(end), F.col("root").alias("new"))
        edges = edges.join(other, end, "left").withColumn(end, F.coalesce("new", end)).drop("new")
    return edges.where("a <> b")


def both_ways(edges: DataFrame) -> DataFrame:
    """comp, other, w, x, y: each edge from both of its ends."""
    return edges.select(F.col("a").alias("comp"), F.col("b").alias("other"), "w", "x", "y").unionByName(edges.select(F.col("b").alias("comp"), F.col("a").alias("other"), "w", "x", "y"))


def first_edges(edges: DataFrame) -> DataFrame:
    """comp, other, w, x, y: the first edge of every component."""
    best = both_ways(edges).groupBy("comp").agg(F.min(F.struct("w", "x", "y", "other")).alias("e"))
    return best.select("comp", "e.other", "e.w", "e.x", "e.y")


def mutual(best: DataFrame) -> DataFrame:
    """Pairs of components whose first edge is the same: comp < other, w, x, y."""
    back = best.select(F.col("comp").alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return best.join(back, "other").where("comp < other AND x = bx AND y = by").select("comp", "other", "w", "x", "y")


def components(pairs: DataFrame) -> DataFrame:
    """Node, component (its lowest node) of everything that pairs (a, b) link.

    A round hangs every component on its lowest neighbour, if that is lower, and contracts.
    """
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    where = settled(nodes.select("node", F.col("node").alias("comp")))
    left = settled(pairs.where("a <> b").select("a", "b").distinct())
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("parent")).where("parent < a").select(F.col("a").alias("comp"), "parent")
        names = roots(lowest)
        where = settled(where.join(names, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp")))
        left = renamed(left, names)
        left = settled(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    return where.withColumnRenamed("comp", "component")


def spanning_forest(points: DataFrame, edges: DataFrame) -> DataFrame:
    """M8: x, y, w of one tree a group. points: key, contig_id, vec, core. edges: x, y, w within groups, x < y, each once."""
    where = points.select("contig_id", F.col("contig_id").alias("comp"))
    left = settled(edges.select(F.col("x").alias("a"), F.col("y").alias("b"), "w", "x", "y"))
    tree: list[DataFrame] = []
    while True:
        best = settled(first_edges(left))
        if best.isEmpty():
            best = settled(_tied(points, where))
            if best.isEmpty():
                break
        tree.append(best.select("x", "y", "w").distinct())
        # one of two components that chose each other is the root
        top = mutual(best).select("comp", F.lit(True).alias("top"))
        parents = best.join(top, "comp", "left").select("comp", F.when(F.col("top"), F.col("comp")).otherwise(F.col("other")).alias("parent"))
        names = roots(parents)
        where = settled(where.join(names, "comp", "left").select("contig_id", F.coalesce("root", "comp").alias("comp")))
        left = renamed(left, names).withColumns({"a": F.least("a", "b"), "b": F.greatest("a", "b")})
        left = settled(left.groupBy("a", "b").agg(F.min(F.struct("w", "x", "y")).alias("e")).select("a", "b", "e.*"))
    out = tree[0] if tree else settled(edges.limit(0)).select("x", "y", "w")
    for more in tree[1:]:
        out = out.unionByName(more)
    return settled(out)


def _tied(points: DataFrame, where: DataFrame) -> DataFrame:
    """comp, other, w, x, y: the edge by mutual reachability to the nearest point outside, for all components but the largest of each group."""
    sizes = points.select("key", "contig_id").join(where, "contig_id").groupBy("key", "comp").agg(F.count("*").alias("n"))
    groups = settled(sizes.groupBy("key").agg(F.max(F.struct("n", (-F.col("comp")).alias("low"))).alias("m"), F.count("*").alias("of"), F.sum("n").alias("n")).where("of > 1").select("key", (-F.col("m.low")).alias("main"), F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    if groups.isEmpty():
        return where.select("comp", F.col("comp").alias("other"), F.lit(0.0).alias("w"), F.col("comp").alias("x"), F.col("comp").alias("y")).limit(0)
    placed = points.join(F.broadcast(groups) if few(groups) else groups, "key").join(where, "contig_id")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("contig_id"), "blocks").cast("int"))
    cell = lambda rows, name: rows.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct("contig_id", "comp", "core", "vec")).alias(name))  # noqa: E731  about BLOCK rows
    refs = cell(placed, "r").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = cell(placed.where("comp <> main"), "q").join(refs.select("key", "block", "r"), ["key", "block"]).select("q", "r")
    found = met.mapInArrow(_outside, "comp long, other long, w double, x long, y long")
    return found.groupBy("comp").agg(F.min(F.struct("w", "x", "y", "other")).alias("e")).select("comp", "e.other", "e.w", "e.x", "e.y")


def _outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each component of a block of points, its edge to the nearest point of another component in the other block."""

    def parts(cell: pa.Array) -> tuple[np.ndarray, ...]:
        rows = cell.values
        ids, comp, core, vec = (rows.field(c) for c in ("contig_id", "comp", "core", "vec"))
        return ids.to_numpy(), comp.to_numpy(), core.to_numpy(), vec.values.to_numpy().reshape(len(ids), -1)

    for batch in batches:
        for at in range(batch.num_rows):
            (qi, qc, qk, q), (ri, rc, rk, r) = (parts(pa.array([batch.column(c)[at].as_py()], batch.schema.field(c).type)) for c in ("q", "r"))
            rows = []
            for i in range(0, len(qi), 512):
                some = slice(i, i + 512)
                d = np.sqrt(np.maximum((q[some] ** 2).sum(1)[:, None] + (r**2).sum(1)[None] - 2 * q[some] @ r.T, 0))
                d = np.maximum(np.maximum(d, qk[some][:, None]), rk[None])
                d[qc[some][:, None] == rc[None]] = np.inf
                low = d.min(1)
                for j in np.flatnonzero(np.isfinite(low)):
                    near = np.flatnonzero(d[j] <= low[j] * (1 + 1e-6) + 1e-6)  # exactly now, so that both ends agree on what is nearest
                    w = np.maximum(np.sqrt(((r[near] - q[i + j]) ** 2).sum(1)), np.maximum(rk[near], qk[i + j]))
                    x, y = np.minimum(ri[near], qi[i + j]), np.maximum(ri[near], qi[i + j])
                    k = np.lexsort((y, x, w))[0]
                    rows.append((qc[i + j], rc[near[k]], w[k], x[k], y[k]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["comp", "other", "w", "x", "y"])
