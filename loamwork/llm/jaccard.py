"""N-gram Jaccard join by grouped prefixes.

Words become 5-word shingles, shingles 64-bit tokens in one global order: rare first, by
counts of all documents in a sketch of bounded size. Sets that are Jaccard-similar share
a token of their prefixes. Documents with equal sets form a class; classes with equal
prefix and size form a group, which is indexed once. Runs of groups that share a token
are candidates. Rounds pair a few classes of each run with all others; what they leave
apart is then verified in full, so that no link between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import arrow_schema, check_columns, few, map_slices, materialize, parts, scratch, slices, texts_of, tidy
from loamwork.llm.components import components

WORDS = 5
#: Similarity as a fraction of whole numbers.
SHARE = (75, 100)
#: The sketch has a slot for every SLOT_SHINGLES shingles, within these bits; a slot is a byte in the broadcast.
SKETCH_BITS = (16, 24)
SLOT_SHINGLES = 32
#: Classes of a run that each round pairs with the others; the last round leaves no pair out.
PIVOTS = (8, 32, 64, None)
#: Classes of a run that stay in one row; a longer run is dealt into chunks of about so many.
CHUNK = 4096
#: Tokens or pairs that a task holds before it sends them.
FLUSH = 500_000
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_PREFIXES = "doc_id long, h long, n int, class binary, grp long, bits binary, bucket int, grps binary, sizes binary, counts binary, tokens binary"
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
_SETS = "class_id long, n int, tokens binary"


class Shingles(dict):
    """64-bit hashes of words; bounded by starting afresh."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def of(self, text: str) -> np.ndarray:
        """The distinct shingles of a text, sorted. bytes.lower() changes A-Z alone, bytes.split() parts at x20 and x09-x0d."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        n = min(WORDS, len(words))
        total = np.full(len(words) - n + 1, n, np.uint64)
        for i in range(n):
            total = (total ^ total >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + h[i : len(h) - n + 1 + i] * _MULTIPLIERS[i]
        total ^= total >> np.uint64(29)
        return np.unique(total * np.uint64(0x94D049BB133111EB))


def required(n: int) -> int:
    """The least overlap of a set of size n with any similar one."""
    return -(-n * SHARE[0] // SHARE[1])


def similar(common: int, n: int, m: int) -> bool:
    return SHARE[1] * common >= SHARE[0] * (n + m - common)


def sketch_bits(docs: DataFrame) -> int:
    """Bits of the sketch for these documents: shingles are about as many as words, words about six characters."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(max(int(np.ceil(np.log2(chars / 6 / SLOT_SHINGLES + 1))), SKETCH_BITS[0]), SKETCH_BITS[1])


def ranks(docs: DataFrame) -> np.ndarray:
    """For each slot of the sketch the binary logarithm of how many documents hold its shingles.

    A task counts up to 255 in a slot, which is enough to order shingles.
    """
    bits, part_bits = sketch_bits(docs), 16

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(), np.zeros(1 << bits, np.uint8)
        for part in slices(batches):
            slots = (np.concatenate([shingles.of(t) for t in texts_of(part)]) >> np.uint64(64 - bits)).astype(np.int64)
            slots, counts = np.unique(slots, return_counts=True)
            total[slots] = np.minimum(total[slots].astype(np.int64) + counts, 255)
        for k, x in enumerate(total.reshape(-1, 1 << part_bits)):
            if x.any():
                yield pa.RecordBatch.from_pydict({"part": [k], "counts": [x.tobytes()]}, schema=arrow_schema("part int, counts binary"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[k] = total.get(k, np.uint32(0)) + np.frombuffer(raw, np.uint8).astype(np.uint32)
        logs = [np.log2(np.maximum(x, 1)).astype(np.uint8).tobytes() for x in total.values()]
        yield pa.RecordBatch.from_pydict({"part": list(total), "counts": logs}, schema=arrow_schema("part int, counts binary"))

    out = np.zeros(1 << bits, np.uint8)
    sent = docs.select("text").mapInArrow(tidy(local), "part int, counts binary").repartition(1 << bits - part_bits, "part")
    summed = sent.mapInArrow(tidy(add), "part int, counts binary").toArrow()  # a byte a slot: at most 1 << SKETCH_BITS[1] bytes
    for k, raw in zip(summed.column("part").to_pylist(), summed.column("counts").to_pylist(), strict=True):
        out[k << part_bits : (k + 1) << part_bits] = np.frombuffer(raw, np.uint8)
    return out


def ordered(shingle_set: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Tokens in global order: the rank in the highest bits, the hash below."""
    high = rank[(shingle_set >> np.uint64(64 - (len(rank).bit_length() - 1))).astype(np.int64)].astype(np.uint64)
    return np.sort(high << np.uint64(58) | shingle_set >> np.uint64(6))


def bitmap(shingle_set: np.ndarray) -> bytes:
    """A set's bits: two or more a shingle, a power of two in number."""
    width = max(64, 1 << (2 * len(shingle_set) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[(shingle_set & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows) with fewer bytes; a bit is set where any that falls on it was."""
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def possible(bits: list[bytes], n: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
    """Those of others that could be similar to i: a set lacks every shingle whose bit it lacks, which bounds the overlap."""
    out = []
    widths = np.array([len(bits[j]) for j in others.tolist()])
    for width in np.unique(widths).tolist():
        some = others[widths == width]
        rows = np.frombuffer(b"".join([bits[j] for j in some.tolist()]), np.uint8).reshape(len(some), width)
        mine = np.frombuffer(bits[i], np.uint8).reshape(1, -1)
        both = min(width, mine.shape[1])
        rows, mine = folded(rows, both), folded(mine, both)
        most = np.minimum(n[i] - np.bitwise_count(mine & ~rows).sum(1, dtype=np.int64), n[some] - np.bitwise_count(rows & ~mine).sum(1, dtype=np.int64))
        out.append(some[SHARE[1] * most >= SHARE[0] * (n[i] + n[some] - most)])
    return np.concatenate(out) if out else others[:0]


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that occurs, with the places where it does."""
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    return zip(names.tolist(), np.split(order, at[1:]), strict=True) if len(names) else iter(())


def prefixes(docs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """Rows of documents (doc_id, h, n, class, grp, bits) and rows of prefix tokens by bucket, in one table; h is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, rank, schema = Shingles(), shared.value, arrow_schema(_PREFIXES)
        sent: set[int] = set()
        held: list[tuple[int, int, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(p) for _, _, p in held]
            token = np.concatenate([p for _, _, p in held])
            owner = np.repeat(np.arange(len(held)), lengths)
            grp, n = np.array([g for g, _, _ in held], "<i8"), np.array([m for _, m, _ in held], "<u4")
            mixed = (token & np.uint64((1 << 58) - 1)) * np.uint64(0x9E3779B97F4A7C15)
            bucket = (mixed >> np.uint64(40)) % np.uint64(buckets)
            rows = []
            for k, mine in _dealt(bucket):
                who, counts = np.unique(owner[mine], return_counts=True)
                rows.append((k, grp[who].tobytes(), n[who].tobytes(), counts.astype("<u4").tobytes(), np.ascontiguousarray(mixed[mine].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()))
            cells = dict(zip(schema.names[6:], zip(*rows, strict=True), strict=True))
            return pa.RecordBatch.from_pydict({c: cells.get(c) or [None] * len(rows) for c in schema.names}, schema=schema)

        for part in slices(batches):
            out: dict[str, list] = {c: [] for c in schema.names}
            for doc, h, text in zip(part.column("doc_id").to_pylist(), part.column("h").to_pylist(), texts_of(part), strict=True):
                shingle_set = shingles.of(text)
                tokens = ordered(shingle_set, rank)
                n = len(tokens)
                lead = tokens[: n - required(n) + 1] if n else tokens
                grp = int.from_bytes(hashlib.blake2b(lead.tobytes() + n.to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                if n and grp not in sent:
                    if len(sent) > 2_000_000:
                        sent.clear()
                    sent.add(grp)
                    held.append((grp, n, lead))
                    size += len(lead)
                for c, v in zip(schema.names, (doc, h, n, hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), grp, bitmap(shingle_set), *[None] * 5), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return _named(docs).mapInArrow(tidy(run), _PREFIXES)


def _named(docs: DataFrame) -> DataFrame:
    """doc_id, h and text: a row is known by its doc_id and the hash of its text, so a repeated doc_id may have several texts."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("doc_id is not null")


def runs(postings: DataFrame, buckets: int) -> DataFrame:
    """Lists of groups that share a prefix token, ordered by size; equal lists of a bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, grp, size = [], [], []
        for part in slices(batches):
            for k, g, n, c, t in zip(*(part.column(x).to_pylist() for x in ("bucket", "grps", "sizes", "counts", "tokens")), strict=True):
                counts = np.frombuffer(c, "<u4")
                wide = np.zeros((len(t) // 5, 8), np.uint8)
                wide[:, :5] = np.frombuffer(t, np.uint8).reshape(-1, 5)
                token.append(wide.view("<u8").reshape(-1) | np.uint64(k << 40))
                grp.append(np.repeat(np.frombuffer(g, "<i8"), counts))
                size.append(np.repeat(np.frombuffer(n, "<u4"), counts))
        if not token:
            return
        token, grp, size = np.concatenate(token), np.concatenate(grp), np.concatenate(size)
        order = np.lexsort((grp, size, token))
        token, grp, size = token[order], grp[order], size[order]
        fresh = np.ones(len(token), bool)
        fresh[1:] = (token[1:] != token[:-1]) | (grp[1:] != grp[:-1])
        token, grp, size = token[fresh], grp[fresh], size[fresh]
        starts = np.flatnonzero(np.diff(token, prepend=token[:1] ^ np.uint64(1)) != 0)
        ends = np.append(starts[1:], len(token))
        seen: set[bytes] = set()
        for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            # sizes are sorted: cut the list where even neighbours are too different to be similar
            far = np.flatnonzero(SHARE[1] * size[a : b - 1].astype(np.int64) < SHARE[0] * size[a + 1 : b].astype(np.int64)) + a + 1
            for x, y in zip([a, *far.tolist()], [*far.tolist(), b], strict=True):
                if y - x > 1:
                    seen.add(grp[x:y].astype("<i8").tobytes())
        found = list(seen)
        for at in range(0, len(found), 4096):
            yield pa.RecordBatch.from_pydict({"grps": found[at : at + 4096]}, schema=arrow_schema("grps binary"))

    lists = postings.repartition(buckets, "bucket").mapInArrow(tidy(run), "grps binary")
    return lists.distinct()


def _members(lists: DataFrame) -> DataFrame:
    """run (a digest of the list), grp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            for raw in part.column("grps").to_pylist():
                g = np.frombuffer(raw, "<i8")
                name = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)
                yield pa.RecordBatch.from_pydict({"run": np.full(len(g), name), "grp": g}, schema=arrow_schema("run long, grp long"))

    return lists.mapInArrow(tidy(run), "run long, grp long")


def _sets(docs: DataFrame, ids: DataFrame, classes: DataFrame) -> DataFrame:
    """Shingle sets (eight bytes a shingle) of the classes with these ids, from one row of each; the rows' names are broadcast only if few."""
    wanted = ids.distinct().join(classes.select("class_id", "of_id", "of_h"), "class_id")
    rows = _named(docs).join(F.broadcast(wanted) if few(wanted) else wanted, (F.col("doc_id") == F.col("of_id")) & (F.col("h") == F.col("of_h")))

    def make():
        shingles = Shingles()

        def apply(part):
            sets = [shingles.of(t) for t in texts_of(part)]
            return {"class_id": part.column("class_id"), "n": list(map(len, sets)), "tokens": [x.astype("<u8").tobytes() for x in sets]}

        return apply

    return map_slices(rows.select("class_id", "text"), make, _SETS)


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class ids whose sets are similar: intersections of whole sets of 64-bit hashes are counted.

    Two different shingles of a pair of sets share a hash with odds of n * m / 2**64, some 1e-10 for sets of 40,000.
    """
    ids = pairs.select(F.col("a").alias("class_id")).union(pairs.select(F.col("b").alias("class_id")))
    sets = materialize(_sets(docs, ids, classes).dropDuplicates(["class_id"]), "sets")
    left, right = (sets.select(F.col("class_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"tokens_{x}")) for x in "ab")
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            keep = []
            for a, b, n, m, x, y in zip(*(c.to_pylist() for c in part.columns), strict=True):
                both = np.sort(np.frombuffer(x + y, "<u8"))
                if similar(int(np.count_nonzero(both[1:] == both[:-1])), n, m):
                    keep.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": [k[0] for k in keep], "b": [k[1] for k in keep]}, schema=arrow_schema("a long, b long"))

    return materialize(joined.mapInArrow(tidy(run), "a long, b long"), "similar")


def _all_members(lists: DataFrame, classes: DataFrame) -> DataFrame:
    """run, class_id, n, bits: the classes of each run, and of each group with several classes."""
    inside = classes.select(F.col("grp").alias("run"), "class_id", "n", "bits")
    return _members(lists).join(classes.select("grp", "class_id", "n", "bits"), "grp").select("run", "class_id", "n", "bits").union(inside)


_ITEM = ["class_id", "n", "bits", "component"]


def _with_component(members: DataFrame, homes: DataFrame | None) -> DataFrame:
    if homes is None:
        return members.withColumn("component", F.col("class_id"))
    return members.join(homes, members.class_id == homes.node, "left").withColumn("component", F.coalesce("component", "class_id")).drop("node")


def _cells(grouped: DataFrame, homes: DataFrame | None) -> DataFrame:
    """m, p: the runs with classes of several components, one row a run; each class has its component. p is empty."""
    members = _with_component(grouped.select("run", F.inline("m")), homes)
    found = members.groupBy("run").agg(F.collect_list(F.struct(*_ITEM)).alias("m"), F.min("component").alias("low"), F.max("component").alias("high"))
    # runs of one cluster mostly meet in a few tasks, which then see their common pairs once
    return found.where("low < high").select("low", F.pmod("run", F.lit(4)).alias("salt"), "m").repartition("low", "salt").select("m", F.lit(None).cast(found.schema["m"].dataType).alias("p"))


def _chunked_cells(big: DataFrame, homes: DataFrame | None, pivots: int | None) -> DataFrame:
    """m, p: runs that are too long for a row, as chunks m that each meet the run's pivots p.

    About pivots classes of a run are chosen by hash; without pivots, all classes outside
    the run's largest component are, in chunks of their own.
    """
    x = _with_component(big, homes)
    chunk = F.pmod(F.xxhash64("class_id"), F.ceil(F.col("size") / CHUNK))
    if pivots:
        lead = x.where(F.pmod(F.xxhash64("class_id", F.lit(pivots)), "size") < pivots).withColumn("chunk", F.lit(0))
    else:
        sizes = x.groupBy("run", "component").agg(F.count("*").alias("k"))
        lead = x.join(sizes.groupBy("run").agg(F.max_by("component", F.struct("k", "component")).alias("top")), "run").where("component <> top").withColumn("chunk", chunk)
    leads = lead.groupBy("run", "chunk").agg(F.collect_list(F.struct(*_ITEM)).alias("p")).select("run", "p")
    return x.withColumn("chunk", chunk).groupBy("run", "chunk").agg(F.collect_list(F.struct(*_ITEM)).alias("m")).join(leads, "run").select("m", "p")


def _candidates(cells: DataFrame, pivots: int | None, buckets: int) -> DataFrame:
    """Pairs (a, b) of classes in a common run, of fitting size and of different components.

    With pivots, only the classes of a run with the lowest hashes are paired with the
    others: runs of one near-copy cluster then choose the same few. Without, all pairs
    come, for each class outside the run's largest component. A cell with p has its pivots there.
    """
    seed = np.uint64(2 * (pivots or 0) + 0x9E3779B97F4A7C15)

    def sent(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found))
        bucket = ((pairs["a"] * 31 + pairs["b"]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
        rows = [(k, pairs[mine].tobytes()) for k, mine in _dealt(bucket)]
        return pa.RecordBatch.from_pydict({"bucket": [k for k, _ in rows], "pairs": [x for _, x in rows]}, schema=arrow_schema("bucket int, pairs binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for part in slices(batches, 64):
            for m, p in zip(part.column("m"), part.column("p"), strict=True):
                both = [x.values for x in (p, m) if x.is_valid]
                c, n, group = (np.concatenate([x.field(name).to_numpy(zero_copy_only=False).astype(np.int64) for x in both]) for name in ("class_id", "n", "component"))
                bits = [b for x in both for b in x.field("bits").to_pylist()]
                if p.is_valid:
                    chosen = np.arange(len(p.values))
                elif pivots:
                    mixed = (c.astype(np.uint64) + np.uint64(1)) * seed
                    chosen = np.argsort(mixed ^ mixed >> np.uint64(32), kind="stable")[:pivots]
                else:
                    own, counts = np.unique(group, return_counts=True)
                    chosen = np.flatnonzero(group != own[counts.argmax()])
                for i in chosen.tolist():
                    fits = (group != group[i]) & (SHARE[1] * np.minimum(n, n[i]) >= SHARE[0] * np.maximum(n, n[i]))
                    other = c[possible(bits, n, i, np.flatnonzero(fits))]
                    if len(other):
                        pairs = np.empty(len(other), _PAIR)
                        pairs["a"], pairs["b"] = np.minimum(other, c[i]), np.maximum(other, c[i])
                        found.append(pairs)
                        size += len(other)
                    if size >= FLUSH:
                        yield sent(found)
                        found, size = [], 0
        if found:
            yield sent(found)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [np.frombuffer(x, _PAIR) for b in batches for x in b.column("pairs").to_pylist()]
        if raw:
            pairs = np.unique(np.concatenate(raw))
            for at in range(0, len(pairs), 65536):
                some = pairs[at : at + 65536]
                yield pa.RecordBatch.from_pydict({"a": np.ascontiguousarray(some["a"]), "b": np.ascontiguousarray(some["b"])}, schema=arrow_schema("a long, b long"))

    return cells.mapInArrow(tidy(run), "bucket int, pairs binary").repartition(buckets, "bucket").mapInArrow(tidy(once), "a long, b long")


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row.

    Null, empty and blank texts have no shingles and stay alone. Repeated rows are equal
    documents. Rows that repeat a doc_id with other texts are one node, linked with all
    that any of its texts is linked with; each row has its own n_shingles. A row without
    a doc_id has no place in a result of ids and is left out. Other columns are ignored;
    an empty table gives no rows.
    """
    check_columns(docs, "doc_id", "text")
    with scratch(docs.sparkSession):
        return materialize(_joined(docs), "joined", keep=True)


def _pairs_of(grouped: DataFrame, big: DataFrame | None, homes: DataFrame | None, pivots: int | None, buckets: int) -> DataFrame | None:
    """A round's candidate pairs; None where no run spans two components."""
    cells = _cells(grouped, homes)
    if big is not None:
        cells = cells.union(_chunked_cells(big, homes, pivots))
    cells = materialize(cells, "cells")
    return materialize(_candidates(cells, pivots, buckets), "candidates") if cells.limit(1).count() else None


def _joined(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    buckets = parts(docs)
    shared = spark.sparkContext.broadcast(ranks(docs))
    table = materialize(prefixes(docs, shared, buckets), "prefixes")
    rows = table.where("doc_id is not null").select("doc_id", "h", "n", "class", "grp", "bits")
    one = F.min(F.struct("doc_id", "h")).alias("of")
    classes = rows.where("n > 0").groupBy("class").agg(one, F.min("n").alias("n"), F.min("grp").alias("grp"), F.min("bits").alias("bits"))
    # a class's number is fixed by the table that is written
    classes = materialize(classes.select("class", F.monotonically_increasing_id().alias("class_id"), F.col("of.doc_id").alias("of_id"), F.col("of.h").alias("of_h"), "n", "grp", "bits"), "classes")
    lists = materialize(runs(table.where("bucket is not null").select("bucket", "grps", "sizes", "counts", "tokens"), buckets), "runs")
    links = _same_id(rows, classes)
    members = _all_members(lists, classes)
    long = materialize(members.groupBy("run").agg(F.count("*").alias("size")).where(F.col("size") > CHUNK), "long")
    big = None
    if long.limit(1).count():
        names = F.broadcast(long) if few(long) else long
        big = materialize(members.join(names, "run"), "long-runs")
        members = members.join(names, "run", "left_anti")
    grouped = materialize(members.groupBy("run").agg(F.collect_list(F.struct("class_id", "n", "bits")).alias("m")).where(F.size("m") > 1), "grouped")
    tried = _pairs_of(grouped, big, None, PIVOTS[0], buckets)
    if tried is not None:
        links = links.union(_verified(docs, classes, tried))
    homes = materialize(components(links), "components")
    for before, pivots in zip(PIVOTS, PIVOTS[1:], strict=False):
        pairs = _pairs_of(grouped.where(F.size("m") > before + 1), big, homes, pivots, buckets)  # the others have been paired in full
        if pairs is None:
            break
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti"), "candidates")
        if pairs.limit(1).count():
            tried = tried.union(pairs)
            known = homes.select(F.col("component").alias("a"), F.col("node").alias("b"))  # joins what the earlier links join
            homes = materialize(components(known.union(_verified(docs, classes, pairs))), "components")
    inside = classes.join(homes, classes.class_id == homes.node)
    low = inside.groupBy("component").agg(F.min("of_id").alias("low"))
    linked = inside.join(low, "component").select("class_id", "low")
    placed = classes.join(linked, "class_id", "left").select("class", F.coalesce("low", "of_id").alias("component_id"))
    out = rows.select("doc_id", "n", "class").join(placed, "class", "left")
    out = out.join(_blank_homes(rows, placed), "doc_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "blank_home", "doc_id").alias("component_id"))


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of a doc_id that has several; mostly there are none."""
    several = rows.where("n > 0").select("doc_id", F.xxhash64("class").alias("c")).groupBy("doc_id").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("doc_id")
    several = materialize(several, "several")
    own = rows.where("n > 0").select("doc_id", "class").join(F.broadcast(several) if few(several) else several, "doc_id", "left_semi").join(classes.select("class", "class_id"), "class").distinct()
    least = own.groupBy("doc_id").agg(F.min("class_id").alias("a"))
    return materialize(own.join(least, "doc_id").where("class_id <> a").select("a", F.col("class_id").alias("b")), "same-id")


def _blank_homes(rows: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, blank_home: the component of a doc_id that has a text without shingles besides one with some."""
    kinds = rows.groupBy("doc_id").agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least = 0 and most > 0").select("doc_id")
    mixed = materialize(kinds, "blank-ids")
    own = rows.where("n > 0").select("doc_id", "class").join(F.broadcast(mixed) if few(mixed) else mixed, "doc_id", "left_semi").join(placed, "class")
    homes = own.groupBy("doc_id").agg(F.min("component_id").alias("blank_home"))
    return F.broadcast(homes) if few(mixed) else homes


def representatives(docs: DataFrame) -> DataFrame:
    """docs without all but the smallest doc_id of each component; columns stay.

    Rows that repeat a surviving doc_id are that document and all stay; rows without a doc_id stay too.
    """
    found = join(docs)
    dropped = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(F.broadcast(dropped) if few(dropped) else dropped, "doc_id", "left_anti").select(*docs.columns)
