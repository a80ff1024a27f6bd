"""A Merkle manifest of a table: every row's hash, a tree a group, a tree over the groups' roots, and proofs.

Row hashes are made by Spark's own functions and written. They are then sorted into ranges
of (group, id) as an RDD. One job counts the rows that the groups at each range's ends have
in it; these counts, a row a range, are all that the driver sees and give the place of every
row in its group. A range builds all subtrees that it holds completely; the ragged nodes at
its ends go to their parent's coordinate (group, level, index), where the upper levels are
finished. The groups' roots are the leaves of one more such tree. Last, each range gets the
nodes beside its ends and its groups' upper paths, and makes the proofs of its rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import groupby

from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm.common import check_columns, materialize, parts

#: Children of a node at most.
FAN = 16
#: The columns that a row's hash covers, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "grp binary, level int, idx long, width long, digest string"
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, source string, n_levels int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    """Lower-case hex sha256."""
    return sha256(text.encode()).hexdigest()


def row_hash(*columns) -> F.Column:
    """The hash of columns: `-` for null, else the length in bytes, `:` and the value."""
    as_text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in as_text)), 256)


def climb(nodes: list[str], first: int, width: int) -> list[tuple[int, list[str], int]]:
    """Level by level, (first index, nodes, the level's whole width): the complete parents of a run of nodes, up to the root if it gets there."""
    levels = [(first, nodes, width)]
    while width > 1:
        end, wider = first + len(nodes), width
        width = -(-width // FAN)
        low, high = -(-first // FAN), width if end == wider else end // FAN
        nodes = [digest("".join(nodes[FAN * k - first : FAN * (k + 1) - first])) for k in range(low, high)]
        first = low
        levels.append((first, nodes, width))
    return levels


def _segments(rows: Iterable[tuple], ends: dict[bytes, tuple[int, int]]) -> Iterator[tuple[bytes, int, int, list[tuple]]]:
    """(group, place of its first row here, rows of the whole group, rows here); ends has the groups that reach into other ranges."""
    for grp, members in groupby(rows, lambda row: row[0][0]):
        held = list(members)
        yield grp, *ends.get(grp, (0, len(held))), held


class Forest:
    """One tree a group over the rows of a sorted RDD of ((group, ...), (digest, payload))."""

    def __init__(self, spark: SparkSession, rows: RDD, n_parts: int):
        self.spark, self.sorted = spark, rows.sortByKey(numPartitions=n_parts)
        counts = self.sorted.mapPartitionsWithIndex(_end_counts).collect()
        total, seen = Counter(), Counter()
        for _, ends in counts:
            total.update(ends)
        self.ends: dict[int, dict[bytes, tuple[int, int]]] = {}
        self.reach: list[tuple[int, bytes, int, int, int]] = []
        for part, ends in sorted(counts):
            split = {g: n for g, n in ends.items() if total[g] > n}
            self.ends[part] = {g: (seen[g], total[g]) for g in split}
            self.reach += [(part, g, seen[g], n, total[g]) for g, n in split.items()]
            seen.update(split)
        shared = spark.sparkContext.broadcast(self.ends)  # two groups a range at most
        self._of = lambda part: shared.value.get(part, {})
        self.nodes = self._finished(max((total[g] for _, g, *_ in self.reach), default=1))

    def _finished(self, longest: int) -> DataFrame:
        """Nodes whose parent lies in no single range, all above them, and all roots (width 1)."""
        of = self._of

        def ragged(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
            for grp, first, width, held in _segments(rows, of(part)):
                levels = climb([d for _, (d, _) in held], first, width)
                for n, (begin, nodes, wide) in enumerate(levels):
                    inside = range(levels[n + 1][0], levels[n + 1][0] + len(levels[n + 1][1])) if wide > 1 else ()
                    yield from ((bytearray(grp), n, k, wide, d) for k, d in enumerate(nodes, begin) if k // FAN not in inside)

        known = materialize(self.spark.createDataFrame(self.sorted.mapPartitionsWithIndex(ragged), _NODES), "merkle_nodes", keep=True)
        level, out = known.where("level = 0"), known
        for n in range(math.ceil(math.log(longest, FAN)) + 1 if longest > 1 else 0):
            children = F.array_sort(F.collect_list(F.struct("idx", "digest")))
            made = level.where("width > 1").groupBy("grp", F.expr(f"idx div {FAN}").alias("up")).agg(children.alias("c"), F.max("width").alias("wide"))
            made = made.select("grp", F.lit(n + 1).alias("level"), F.col("up").alias("idx"), F.expr(f"(wide + {FAN - 1}) div {FAN}").alias("width"), F.sha2(F.array_join("c.digest", ""), 256).alias("digest"))
            out, level = out.unionByName(made), made.unionByName(known.where(f"level = {n + 1}"))
        return materialize(out, "merkle_upper", keep=True) if longest > 1 else out

    def roots(self) -> DataFrame:
        """grp and root of every group."""
        return self.nodes.where("width = 1").select("grp", F.col("digest").alias("subroot"))

    def proven(self, upper: DataFrame, make) -> RDD:
        """make(key, digest, payload, path, upper row) of every row, path being the (left, right) siblings level by level.

        upper has a row a group: grp, and what make is to know of it.
        """
        of, n_parts = self._of, self.sorted.getNumPartitions()
        sides = self.spark.sparkContext.parallelize(self.reach, max(1, len(self.reach) // 1000)).flatMap(_runs)
        asked = self.spark.createDataFrame(sides, "part int, grp binary, level int, run long").distinct()
        nodes = self.nodes.where("width > 1").withColumn("run", F.expr(f"idx div {FAN}"))
        beside = asked.join(nodes, ["grp", "level", "run"]).select("part", "grp", "level", "idx", "digest")
        groups = self.sorted.mapPartitionsWithIndex(lambda p, rows: ((p, bytearray(g)) for g, _ in groupby(rows, lambda row: row[0][0])))
        above = self.spark.createDataFrame(groups, "part int, grp binary").join(upper, "grp")
        told = beside.rdd.map(lambda r: (r[0], (bytes(r[1]), (r[2], r[3]), r[4]))).union(above.rdd.map(lambda r: (r["part"], (bytes(r["grp"]), None, r))))

        def finish(part: int, pairs: Iterator[tuple]) -> Iterator[tuple]:
            for rows, facts in pairs:
                other: dict[bytes, dict] = {}
                for grp, place, value in facts:
                    other.setdefault(grp, {})[place] = value
                for grp, first, width, held in _segments(rows, of(part)):
                    paths = _Paths(climb([d for _, (d, _) in held], first, width), other[grp])
                    for k, (key, (d, payload)) in enumerate(held, first):
                        yield make(key, d, payload, paths.of(0, k), other[grp][None])

        # each range of rows meets what it is told: one list on either side
        told = told.partitionBy(n_parts, int).mapPartitions(lambda it: [[v for _, v in it]])
        return self.sorted.mapPartitions(lambda it: [list(it)]).zip(told).mapPartitionsWithIndex(finish)


class _Paths:
    """Siblings of a range's nodes on all levels; those above the rows are kept, as many rows share them."""

    def __init__(self, levels: list[tuple[int, list[str], int]], other: dict):
        self.levels, self.other, self.known = levels, other, {}

    def of(self, level: int, k: int) -> tuple[tuple[str, str], ...]:
        first, nodes, width = self.levels[level]
        if width == 1:
            return ()
        if (level, k) in self.known:
            return self.known[level, k]
        begin = k - k % FAN
        run = [nodes[i - first] if 0 <= i - first < len(nodes) else self.other[level, i] for i in range(begin, min(begin + FAN, width)) if i != k]
        path = (("".join(run[: k - begin]), "".join(run[k - begin :])), *self.of(level + 1, k // FAN))
        if level:
            self.known[level, k] = path
        return path


def _end_counts(part: int, rows: Iterator[tuple]) -> Iterator[tuple[int, dict[bytes, int]]]:
    """The range's number and the rows of its first and of its last group."""
    first = last = None
    n_first = n_last = 0
    for key, _ in rows:
        if key[0] != last:
            last, n_last = key[0], 0
        first = last if first is None else first
        n_last += 1
        n_first += last == first
    if first is not None:
        yield part, {first: n_first, last: n_last}


def _runs(reach: tuple) -> Iterator[tuple]:
    """The runs, on all levels, that a group's first and last row of a range belong to."""
    part, grp, first, n, width = reach
    ends, level = (first, first + n - 1), 0
    while width > 1:
        ends, width = (ends[0] // FAN, ends[1] // FAN), -(-width // FAN)
        yield from ((part, bytearray(grp), level, run) for run in set(ends))
        level += 1


def fold(start: str, path: Iterable[tuple[str, str]]) -> str:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        start = digest(left + start + right)
    return start


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, grp (bytes that order sources, null first), leaf and the leaf after tampering, of every row; written."""
    check_columns(docs, *COLUMNS)
    cols = {c: F.col(c) for c in COLUMNS} | {"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")}
    struck = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    forged = row_hash(*(cols | {"text": F.translate("text", _UPPER, _LOWER)}).values())
    grp = F.when(F.col("source").isNull(), F.unhex(F.lit("00"))).otherwise(F.concat(F.unhex(F.lit("01")), F.encode("source", "utf-8")))
    out = docs.select(cols["doc_id"].alias("doc_id"), "source", grp.alias("grp"), row_hash(*cols.values()).alias("leaf"), F.when(struck, forged).alias("forged"))
    return materialize(out, "merkle_leaves", keep=True)


def _keyed(index: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows under their place in the order; equal rows are told apart by where they were read, so they needn't meet in one range."""
    for n, (doc, source, grp, leaf, forged) in enumerate(rows):
        yield (bytes(grp), doc is not None, doc or 0, leaf, index, n), (leaf, (doc, source, forged))


def _upper(key: tuple, leaf: str, payload: None, path: tuple, above: tuple) -> tuple:
    return bytearray(key[1]), leaf, above["subroot"], [list(p) for p in path]


def _verified(key: tuple, leaf: str, payload: tuple, path: tuple, above: tuple) -> tuple:
    doc, source, forged = payload
    path = (*path, *map(tuple, above["path"]))
    root = fold(forged or leaf, path)
    return doc, leaf, above["subroot"], above["root"], digest("".join(x + y for x, y in path)), root, root == above["root"], source, len(path)


def manifest(docs: DataFrame) -> DataFrame:
    """The leaf of every row, its group's and the table's root, and the check of a proof against a tampered row.

    A row's group is its source; leaves stand in order of doc_id (null first, then equal ids
    by leaf), groups in order of their source's bytes (null first). Rows whose id's crc32 is
    a multiple of 5 are tampered with: their text's A-Z become lower case, which changes
    nothing in a text without them or a null. folded_root is made from the tampered, else
    the own leaf and the siblings in proof_sha256; verified tells whether it is the root.
    Repeated rows are leaves of their own. A null doc_id is never tampered with. A table of
    one row has its leaf as the root and an empty proof; an empty table gives no rows. Other
    columns are ignored; n_levels is the number of siblings' runs.
    """
    spark = docs.sparkSession
    held = leaves(docs)
    if held.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    n_parts = max(parts(docs), int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = Forest(spark, held.rdd.mapPartitionsWithIndex(_keyed), n_parts)
    roots = rows.roots()
    groups = Forest(spark, roots.rdd.map(lambda r: ((b"", bytes(r[0])), (r[1], None))), parts(roots))
    paths = spark.createDataFrame(groups.proven(groups.roots(), _upper), "grp binary, subroot string, root string, path array<array<string>>")
    return spark.createDataFrame(rows.proven(materialize(paths, "merkle_groups", keep=True), _verified), SCHEMA)
