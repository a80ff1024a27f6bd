"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import arrow_schema, materialize, tidy

_EDGE = "a long, b long"


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces a partition's edges by stars around the smallest node of each part: same components, shorter paths."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent.setdefault(up, up)
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 100_000):
        some = nodes[at : at + 100_000]
        yield pa.RecordBatch.from_pydict({"a": [root(x) for x in some], "b": some}, schema=arrow_schema(_EDGE))


def _step(edges: DataFrame) -> DataFrame:
    """Large-star, then small-star, on edges (a, b) with a < b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    large = both.join(lowest, "a").where("b > a").select(F.col("low").alias("a"), "b").where("a < b").distinct()
    low = large.groupBy("b").agg(F.min("a").alias("low"))
    small = large.join(low, "b").select("a", "b", "low")
    return small.select(F.col("low").alias("a"), "b").union(small.select(F.col("low").alias("a"), F.col("a").alias("b"))).where("a < b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Are these edges stars: is each node a root, or the child of one root? Counted map-side first, in one small shuffle."""
    children = edges.select(F.col("b").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
    ends = children.union(edges.select(F.col("a").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    nodes = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return not nodes.where("child > 1 or (child > 0 and parent > 0)").limit(1).count()


def components(links: DataFrame, limit: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node in links (a, b); loops and repeats do no harm.

    Each round writes its edges to the shared folder, so lineage stays short.
    """
    edges = links.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).where("a < b")
    edges = materialize(edges.mapInArrow(tidy(_stars), _EDGE), "links")
    for _ in range(limit):
        if _settled(edges):
            return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        edges = materialize(_step(edges), "links")
    raise RuntimeError(f"components need more than {limit} rounds")

