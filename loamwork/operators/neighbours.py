"""Nearest neighbours: exact in blocks, approximate by hashing, and votes on them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamwork.plans.workspace import settled

#: Vectors in a block, and how many a block of queries has at least where that makes enough tasks.
BLOCK, LEAST = 4096, 256
#: Blocks of references that a task keeps to hand to its blocks of queries.
HELD = 16
#: Queries of a block that meet a block of references at a time, and pairs whose exact distances are made at a time.
STRIP, PAIRS = 512, 1 << 16
_ROWS = "query_id long, ref_id long, distance double"
_LISTS = "q_no long, q_ids binary, near binary, far binary"


def _blocks(rows: DataFrame, name: str, size: int, most: int | None = None) -> DataFrame:
    """Rows packed where they lie into blocks of at most size rows, one row each: ids and a matrix as bytes. Of equal vectors a block keeps at most the most lowest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append((b.column("contig_id").to_numpy(), b.column("vec").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows, -1)))
            n += b.num_rows
            if n >= size:
                ids, mat = (np.concatenate(x) for x in zip(*held, strict=True))
                for at in range(0, n - n % size, size):
                    yield packed(ids[at : at + size], mat[at : at + size])
                held, n = ([(ids[-(n % size) :], mat[-(n % size) :])], n % size) if n % size else ([], 0)
        if n:
            yield packed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def packed(ids: np.ndarray, mat: np.ndarray) -> pa.RecordBatch:
        ids, mat = _few_copies(ids, mat, most) if most else (ids, mat)
        return pa.RecordBatch.from_pydict({f"{name}_ids": [ids.astype("<i8").tobytes()], f"{name}_mat": [mat.tobytes()]}, schema=pa.schema([(f"{name}_ids", pa.binary()), (f"{name}_mat", pa.binary())]))

    return rows.select("contig_id", "vec").mapInArrow(run, f"{name}_ids binary, {name}_mat binary")


class _Nearest:
    """The k nearest references that a block of queries has met so far, by distance, then by id."""

    def __init__(self, ids: np.ndarray, mat: np.ndarray, k: int, drop_self: bool):
        self.ids, self.x, self.k, self.drop = ids, mat, k, drop_self
        self.near, self.far = np.full((len(ids), k), -1, np.int64), np.full((len(ids), k), np.inf)

    def meet(self, refs: np.ndarray, y: np.ndarray, thinned: bool = False) -> None:
        y2 = (y**2).sum(1)
        for at in range(0, len(self.ids), STRIP):
            ids, x, far = self.ids[at : at + STRIP], self.x[at : at + STRIP], self.far[at : at + STRIP, -1]
            x2 = (x**2).sum(1)
            d = x @ y.T
            d *= -2
            d += x2[:, None]
            d += y2[None]
            if self.drop:
                own = np.flatnonzero(np.isin(ids, refs))
                d[own] = np.where(ids[own, None] == refs[None], np.inf, d[own])
            slack = 1e-12 * (x2 + y2.max())  # what rounding can do to d
            limit = np.minimum(far, 1e150) ** 2
            new = np.flatnonzero(np.isinf(far))
            if len(new) and len(refs) > self.k:
                limit[new] = np.minimum(np.partition(d[new], self.k - 1, axis=1)[:, self.k - 1], 1e300) + slack[new]
            row, col = np.nonzero(d <= (limit + slack)[:, None])
            if not at and not thinned and len(row) > 4 * self.k * len(ids):
                return self.meet(*_few_copies(refs, y, self.k + 1), True)
            if len(row):
                exact = np.concatenate([np.sqrt(((x[row[i : i + PAIRS]] - y[col[i : i + PAIRS]]) ** 2).sum(1)) for i in range(0, len(row), PAIRS)])
                self.take(at + row, refs[col], exact)

    def take(self, row: np.ndarray, refs: np.ndarray, far: np.ndarray) -> None:
        """Sets the best of what a query has and of what it gets."""
        some = np.unique(row)
        row = np.concatenate([np.repeat(some, self.k), row])
        refs, far = np.concatenate([self.near[some].reshape(-1), refs]), np.concatenate([self.far[some].reshape(-1), far])
        order = np.lexsort((refs, far, row))
        first = np.searchsorted(row[order], some)
        best = order[(first[:, None] + np.arange(self.k)).reshape(-1)]
        self.near[some], self.far[some] = refs[best].reshape(-1, self.k), far[best].reshape(-1, self.k)

    def rows(self) -> pa.RecordBatch:
        good = np.isfinite(self.far)
        return pa.RecordBatch.from_pydict({"query_id": np.repeat(self.ids, good.sum(1)), "ref_id": self.near[good], "distance": self.far[good], "rank": (np.nonzero(good)[1] + 1).astype(np.int32)})

    def lists(self, number: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"q_no": [number], "q_ids": [self.ids.tobytes()], "near": [self.near.tobytes()], "far": [self.far.tobytes()]})


def _few_copies(refs: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal vectors those with the lowest ids, most of them: no query can need more."""
    whole = np.ascontiguousarray(y + 0.0).view(np.dtype((np.void, y.shape[1] * 8))).reshape(-1)  # + 0.0: one zero
    kind = np.unique(whole, return_inverse=True)[1]
    if np.bincount(kind).max() <= most:
        return refs, y
    order = np.lexsort((refs, kind))
    first = np.searchsorted(kind[order], kind[order])
    keep = order[np.arange(len(order)) - first < most]
    return refs[keep], y[keep]


def _array(column: pa.Array, at: int, kind: str) -> np.ndarray:
    return np.frombuffer(column[at].as_buffer(), kind)


def _met(batches: Iterator[pa.RecordBatch], k: int, drop_self: bool) -> Iterator[tuple[int, _Nearest]]:
    """The number and the nearest references of each run of meetings of the same block of queries."""
    number, best = None, None
    for b in batches:
        for at in range(b.num_rows):
            if (now := b.column("q_no")[at].as_py()) != number:
                if best is not None:
                    yield number, best
                ids = _array(b.column("q_ids"), at, "<i8").copy()
                number, best = now, _Nearest(ids, _array(b.column("q_mat"), at, "<f8").reshape(len(ids), -1).copy(), k, drop_self)
            refs = _array(b.column("r_ids"), at, "<i8")
            best.meet(refs, _array(b.column("r_mat"), at, "<f8").reshape(len(refs), -1))
    if best is not None:
        yield number, best


def knn(queries: DataFrame, refs: DataFrame, k: int, drop_self: bool = True, query_blocks: int | None = None, ref_blocks: int | None = None) -> DataFrame:
    """query_id, ref_id, distance, rank of the exact k nearest (lower ref_id first on ties).

    Both sides (contig_id long, vec) are counted and packed into blocks. A task meets some
    blocks of queries with HELD blocks of references and keeps the best k of each query, so
    that what tasks hold doesn't depend on the table and what they write is k rows a query
    and HELD blocks. Work is queries x references, as exact search needs.
    """
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nq, nr = queries.count(), refs.count()
    size = -(-nq // query_blocks) if query_blocks else min(max(-(-nq // parts), LEAST), BLOCK)
    wide = -(-nr // ref_blocks) if ref_blocks else BLOCK
    many, lots = max(1, -(-nq // max(1, size))), max(1, -(-nr // max(1, wide)))
    groups = max(-(-lots // HELD), min(lots, parts // many))
    q = _blocks(queries, "q", max(1, size)).withColumn("q_no", F.monotonically_increasing_id()).repartition(many)
    r = _blocks(refs, "r", max(1, wide), k + 1).repartition(groups)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, best in _met(batches, k, drop_self):
            yield best.lists(number) if groups > 1 else best.rows()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best = None, None
        for b in batches:
            for at in range(b.num_rows):
                ids = _array(b.column("q_ids"), at, "<i8")
                if (now := b.column("q_no")[at].as_py()) != number:
                    if best is not None:
                        yield best.rows()
                    number, best = now, _Nearest(ids.copy(), np.empty((len(ids), 0)), k, drop_self)
                best.take(np.repeat(np.arange(len(ids)), k), _array(b.column("near"), at, "<i8"), _array(b.column("far"), at, "<f8"))
        if best is not None:
            yield best.rows()

    met = q.hint("shuffle_replicate_nl").crossJoin(r).select("q_no", "q_ids", "q_mat", "r_ids", "r_mat")
    if groups == 1:
        return met.mapInArrow(nearest, _ROWS + ", rank int")
    return met.mapInArrow(nearest, _LISTS).repartition(min(many, parts), "q_no").sortWithinPartitions("q_no").mapInArrow(merged, _ROWS + ", rank int")


def knn_distinct(rows: DataFrame, k: int) -> DataFrame:
    """knn() of a table with itself where many rows have the same vector: work is distinct vectors x distinct vectors.

    Of equal vectors the k + 1 lowest ids can be anyone's neighbours; each distinct vector
    finds its k + 1 nearest of those, and every row takes them without itself.
    """
    lowest = Window.partitionBy("vec").orderBy("contig_id")
    refs = settled(rows.select("contig_id", "vec").withColumn("k", F.row_number().over(lowest)).where(F.col("k") <= k + 1))
    first = refs.where("k = 1").select("contig_id", "vec")
    lists = knn(first, refs.select("contig_id", "vec"), k + 1, drop_self=False).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "ref_id", "distance"))).alias("near"))
    known = first.withColumnRenamed("contig_id", "query_id").join(lists, "query_id").select("vec", "near")
    others = F.slice(F.filter("near", lambda x: x["ref_id"] != F.col("contig_id")), 1, k)
    x = rows.join(known, "vec").select(F.col("contig_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return x.select("query_id", "x.ref_id", "x.distance", (F.col("at") + 1).alias("rank"))


def _listed(rows: DataFrame, key: str, blocks: DataFrame, name: str) -> DataFrame:
    """Rows (key, contig_id, vec) in their group's blocks, packed: key, blocks, block, ids and matrix as bytes."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                block, ids, vecs = (b.column(c)[at].as_py() for c in ("block", "ids", "vecs"))
                yield pa.RecordBatch.from_pydict({key: b.column(key).slice(at, 1), "blocks": b.column("blocks").slice(at, 1), "block": [block], f"{name}_ids": [np.array(ids, "<i8").tobytes()], f"{name}_mat": [np.array(vecs, "<f8").tobytes()]})

    placed = rows.select(key, "contig_id", "vec").join(blocks, key).withColumn("block", F.pmod(F.xxhash64("contig_id"), "blocks"))
    lists = placed.groupBy(key, "blocks", "block").agg(F.collect_list(F.struct("contig_id", "vec")).alias("l"))  # about BLOCK rows
    return lists.select(key, "blocks", "block", F.col("l.contig_id").alias("ids"), F.col("l.vec").alias("vecs")).mapInArrow(run, f"{key} {kind}, blocks long, block long, {name}_ids binary, {name}_mat binary")


def knn_within(refs: DataFrame, key: str, k: int, queries: DataFrame | None = None) -> DataFrame:
    """K2: query_id, ref_id, distance, rank of the exact k nearest other rows in the same group; queries are refs unless given. Both: key, contig_id, vec.

    A group is dealt into blocks of about BLOCK rows, and each block of queries meets each
    block of its group's references.
    """
    asked = refs if queries is None else queries
    sizes = lambda rows: rows.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    q = _listed(asked, key, sizes(asked), "q").withColumn("q_no", F.monotonically_increasing_id())
    wide = sizes(asked).withColumnRenamed("blocks", "wide")
    r = _listed(refs, key, sizes(refs), "r").join(wide, key).select(key, "r_ids", "r_mat", F.explode(F.sequence(F.lit(0), F.col("wide") - 1)).alias("block"))
    return _best(q.join(r, [key, "block"]).select("q_no", "q_ids", "q_mat", "r_ids", "r_mat"), k, True)


def _best(meetings: DataFrame, k: int, drop_self: bool) -> DataFrame:
    """query_id, ref_id, distance, rank of the k nearest over all meetings of blocks; a run of meetings of the same block q_no sends at most k rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, best in _met(batches, k, drop_self):
            yield best.rows().select(["query_id", "ref_id", "distance"])

    found = meetings.mapInArrow(run, _ROWS)
    best = Window.partitionBy("query_id").orderBy("distance", "ref_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


#: Rows that an index is fitted on: FIT_ROWS, or FIT_PER_CELL a cell where that is more, those with the lowest hashes; every row is indexed.
FIT_ROWS, FIT_PER_CELL = 20_000, 32
#: Rows whose exact neighbours calibrate how many cells a search visits.
CALIBRATION_ROWS = 200
CELLS = 4096
#: Vectors that a task sends to cells at a time; a query counts once for each cell that it visits.
PLACED = 8192


class Cells:
    """An inverted file: centroids of cells, and how many of them a search visits.

    Fitted on a bounded sample, by Lloyd's steps; visits is the least number of cells with
    which calibration rows find at least target of their exact neighbours within the sample.
    """

    def __init__(self, sample: np.ndarray, k: int, target: float = 0.95, cells: int | None = None, steps: int = 8, seed: int = 0):
        rnd = np.random.default_rng(seed)
        n = min(len(sample), cells or int(np.clip(np.sqrt(len(sample)), 1, CELLS)))
        self.centres = sample[rnd.permutation(len(sample))[:n]].astype(np.float64)
        for _ in range(steps):
            own = self.nearest(sample, 1)[:, 0]
            total = np.zeros_like(self.centres)
            np.add.at(total, own, sample)
            size = np.bincount(own, minlength=len(self.centres))
            self.centres[size > 0] = total[size > 0] / size[size > 0, None]
        self.visits = self._calibrated(sample, k, target)

    def nearest(self, x: np.ndarray, m: int) -> np.ndarray:
        """The m nearest cells of each row, the nearest first."""
        out = np.empty((len(x), m), np.int64)
        for at in range(0, len(x), 2048):
            some = x[at : at + 2048]
            d = (self.centres**2).sum(1)[None] - 2 * some @ self.centres.T
            near = np.argpartition(d, m - 1, axis=1)[:, :m] if m < d.shape[1] else np.tile(np.arange(m), (len(some), 1))
            out[at : at + 2048] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
        return out

    def _calibrated(self, sample: np.ndarray, k: int, target: float) -> int:
        asked = sample[:CALIBRATION_ROWS]
        d = (asked**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * asked @ sample.T
        d[np.arange(len(asked)), np.arange(len(asked))] = np.inf
        k = max(1, min(k, len(sample) - 1))
        exact = np.argpartition(d, k - 1, axis=1)[:, :k]
        place = np.empty((len(asked), len(self.centres)), np.int64)
        np.put_along_axis(place, self.nearest(asked, len(self.centres)), np.arange(len(self.centres))[None], 1)
        needed = np.take_along_axis(place, self.nearest(sample, 1)[:, 0][exact], 1)  # the visit that finds each neighbour
        found = np.array([(needed < m).mean() for m in range(1, len(self.centres) + 1)])
        return int(np.argmax(found >= target)) + 1


def fit_cells(refs: DataFrame, k: int, target: float = 0.95, cells: int | None = None) -> Cells:
    """Cells for refs (contig_id, vec): as many as the square root of their number, CELLS at most, fitted on a sample that grows with them."""
    cells = cells or int(np.clip(np.sqrt(refs.count()), 1, CELLS))
    rows = refs.select("contig_id", "vec").orderBy(F.xxhash64("contig_id"), "contig_id").limit(max(FIT_ROWS, FIT_PER_CELL * cells)).toArrow()
    return Cells(np.array(rows.column("vec").to_pylist(), np.float64).reshape(rows.num_rows, -1), k, target, cells)


def knn_indexed(queries: DataFrame, refs: DataFrame, k: int, index: Cells | None = None, drop_self: bool = True) -> DataFrame:
    """K1: knn() by an index: each query meets only the references in the cells that it visits. Distances are exact.

    A cell's references and its queries are packed as far as PLACED rows bring them, so that
    a crowded cell is many small meetings. index is fitted on refs unless given.
    """
    index = index or fit_cells(refs, k)
    shared = queries.sparkSession.sparkContext.broadcast(index)  # CELLS centres at most

    def placed(rows: DataFrame, name: str, visits: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, step := max(1, PLACED // visits)):
                    some = b.slice(at, step)
                    ids, x = some.column("contig_id").to_numpy(), some.column("vec").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(some.num_rows, -1)
                    cell = shared.value.nearest(x, visits).reshape(-1)
                    row = np.repeat(np.arange(len(ids)), visits)
                    order = np.argsort(cell, kind="stable")
                    heads = np.flatnonzero(np.diff(cell[order], prepend=-1))
                    groups = np.split(order, heads[1:])
                    yield pa.RecordBatch.from_pydict({"cell": cell[order][heads], f"{name}_ids": [ids[row[g]].astype("<i8").tobytes() for g in groups], f"{name}_mat": [x[row[g]].astype("<f8").tobytes() for g in groups]})

        return rows.select("contig_id", "vec").mapInArrow(run, f"cell long, {name}_ids binary, {name}_mat binary")

    q = placed(queries, "q", index.visits).withColumn("q_no", F.monotonically_increasing_id())
    meetings = q.join(placed(refs, "r", 1), "cell")
    return _best(meetings.select("q_no", "q_ids", "q_mat", "r_ids", "r_mat"), k, drop_self)


def knn_by_size(exact_pairs: float) -> Callable[..., DataFrame]:
    """K1: knn() where queries x references, both counted, are at most exact_pairs; knn_indexed() beyond."""

    def search(queries: DataFrame, refs: DataFrame, k: int) -> DataFrame:
        return (knn if queries.count() * refs.count() <= exact_pairs else knn_indexed)(queries, refs, k)

    return search


def votes(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """query_id, support, winner (the lowest of equals), agree: how the neighbours' labels vote."""
    by = neighbours.join(labels.select(F.col("contig_id").alias("ref_id"), F.col("label").alias("vote")), "ref_id").groupBy("query_id", "vote").agg(F.count("*").alias("n"))
    best = by.groupBy("query_id").agg(F.sum("n").alias("support"), F.max(F.struct("n", (-F.col("vote")).alias("low"))).alias("best"))
    return best.select("query_id", "support", (-F.col("best.low")).alias("winner"), F.col("best.n").alias("agree"))
