"""Token-id files: canonical length-limited Huffman codes from global counts.

A file is a table of blocks in ascending doc_id order. Each block decodes alone: it
has the documents that it holds, their numbers of ids, the packed bits, and the bit
offset of every CHECKPOINT-th id, so that a block's stretches decode side by side. One row
before the blocks has the code's lengths, from which a canonical code follows, so a file
needs nothing else to be read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import arrow_schema, check_columns, kept, map_slices, materialize, parts, scratch, slices, texts_of, tidy
from loamwork.llm.tokenize import TOGETHER, ChunkMemo, LibraryEncoder

#: Longest code in bits, unless more distinct ids than its codes ask for longer ones.
MAX_BITS = 18
#: A block closes at the first document end beyond so many ids.
BLOCK_IDS = 1 << 18
CHECKPOINT = 128
#: Chunks and words that a worker's memo keeps before it starts afresh.
MEMO_CHUNKS, MEMO_WORDS = 1_000_000, 500_000
#: The part of the row with the code's lengths.
HEAD = -1
FILE_SCHEMA = "part int, block int, doc_ids binary, sizes binary, payload binary, checkpoints binary"


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most limit bits (package-merge); 0 for ids that never occur."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    limit = max(limit, (len(used) - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    levels, items = [], weight
    leaf = np.ones(len(weight), bool)
    for _ in range(limit):
        levels.append(leaf)
        pairs = items[: len(items) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weight, pairs])
        rank = np.argsort(both, kind="stable")
        items, leaf = both[rank], rank < len(weight)
    take, depth = 2 * len(order) - 2, np.zeros(len(order), np.int64)
    for leaf in reversed(levels):
        chosen = int(leaf[:take].sum())
        depth[:chosen] += 1
        take = 2 * (min(take, len(leaf)) - chosen)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in canonical order: by length, then by id."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for n in range(1, int(lengths.max(initial=0)) + 1):
        same = order[lengths[order] == n]
        code <<= n - last
        codes[same] = code + np.arange(len(same), dtype=np.uint32)
        code, last = code + len(same), n
    return codes


class Coder:
    """Packs ids into bits and, by one table over all bit strings as long as the longest code, ids back."""

    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths, canonical_codes(lengths)
        self.width = int(lengths.max(initial=1))
        self.table: np.ndarray | None = None

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(bits from the highest down, bit offset of every CHECKPOINT-th id)."""
        return self.encode_many([ids])[0]

    def encode_many(self, lists: list[np.ndarray]) -> list[tuple[bytes, np.ndarray]]:
        """encode() of several lists at once; each begins at a byte of its own."""
        count = np.array([len(x) for x in lists], np.int64)
        ids = np.concatenate([*lists, np.zeros(0, np.uint32)]).astype(np.int64)
        size = self.lengths[ids].astype(np.int64)
        ends = np.append(0, np.cumsum(size))
        last = np.cumsum(count)
        bits = ends[last] - ends[last - count]
        width = (bits + 7) >> 3
        begin = np.cumsum(width) - width
        starts = ends[:-1] + np.repeat(8 * begin - ends[last - count], count)
        out = np.zeros(int(width.sum()) // 4 + 3, np.uint32)
        if len(ids):
            word, within = starts >> 5, (starts & 31).astype(np.uint64)
            wide = self.codes[ids].astype(np.uint64) << (np.uint64(64) - size.astype(np.uint64) - within)
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            out[word[heads]] += np.add.reduceat(wide >> np.uint64(32), heads).astype(np.uint32)
            out[word[heads] + 1] += np.add.reduceat(wide & np.uint64(0xFFFFFFFF), heads).astype(np.uint32)
        raw = out.astype(">u4").tobytes()
        return [(raw[b : b + w], (starts[e - n : e : CHECKPOINT] - 8 * b).astype("<u8")) for b, w, n, e in zip(begin.tolist(), width.tolist(), count.tolist(), last.tolist(), strict=True)]

    def _decoding_table(self) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << self.width, np.uint32)
            for i in np.flatnonzero(self.lengths):
                n = int(self.lengths[i])
                at = int(self.codes[i]) << (self.width - n)
                self.table[at : at + (1 << (self.width - n))] = i << 5 | n
        return self.table

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block; all its stretches advance together, an id a step."""
        if not n:
            return np.zeros(0, np.uint32)
        table = self._decoding_table()
        b = np.frombuffer(payload + bytes(4), np.uint8).astype(np.uint32)
        windows = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at = checkpoints.astype(np.int64)
        out = np.empty((len(at), CHECKPOINT), np.uint32)
        last = len(windows) - 1
        for k in range(CHECKPOINT):
            entry = table[(windows[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - self.width)]
            out[:, k] = entry >> 5
            at += entry & 31
        return out.reshape(-1)[:n]


def token_table(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (two bytes an id where all fit, else four) of every document."""
    check_columns(docs, "doc_id", "text")

    key = ("library", tokenizer_path)

    def make():
        memo = kept(key, lambda: ChunkMemo(LibraryEncoder(tokenizer_path, MEMO_WORDS), MEMO_CHUNKS))
        end = np.uint32(end_id).tobytes()

        def apply(part):
            ids = [x + end for x in memo.encode(texts_of(part))]
            flat = np.frombuffer(b"".join(ids), "<u4")
            if flat.max(initial=0) < 65536:
                narrow = flat.astype("<u2").tobytes()
                ends = np.cumsum([len(x) // 2 for x in ids]).tolist()
                short = [narrow[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            else:
                short = ids
            return {"doc_id": part.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": short}

        return apply

    return map_slices(docs.select("doc_id", "text").where("doc_id is not null"), make, "doc_id long, n_tokens long, ids binary", TOGETHER, key)


def wide_ids(ids: bytes, n: int) -> np.ndarray:
    """uint32 ids of a token table's cell, which has two or four bytes an id."""
    return np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype(np.uint32)


def global_counts(tokens: DataFrame) -> np.ndarray:
    """How often each id occurs in all documents: summed by task, then by id; the vocabulary bounds the result."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for part in slices(batches):
            some = np.concatenate([wide_ids(ids, n) for n, ids in zip(part.column("n_tokens").to_pylist(), part.column("ids").to_pylist(), strict=True)])
            counts = np.bincount(some, minlength=len(total))
            counts[: len(total)] += total
            total = counts
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"id": seen, "n": total[seen]}, schema=arrow_schema("id long, n long"))

    rows = tokens.select("n_tokens", "ids").mapInArrow(tidy(run), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids = rows.column("id").to_numpy()
    counts = np.zeros(int(ids.max(initial=-1)) + 1, np.int64)
    counts[ids] = rows.column("n").to_numpy()
    return counts


def part_bounds(tokens: DataFrame, n: int) -> np.ndarray:
    """Upper doc_ids of all parts but the last; approximate shares suffice, since bounds only balance the parts."""
    if n < 2:
        return np.zeros(0, np.int64)
    at = tokens.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 10 * n))).first()[0]
    return np.unique(np.array(at or [], np.int64))


def encode_file(tokens: DataFrame, lengths: np.ndarray) -> DataFrame:
    """Codes each document, brings the codes (not the ids) into doc_id order and fills blocks.

    A part of the file holds a range of doc_ids, in order; bounds come from the ids alone.
    """
    n_parts = parts(tokens)
    shared = tokens.sparkSession.sparkContext.broadcast((lengths, part_bounds(tokens, n_parts)))

    def make():
        coder, bounds = Coder(shared.value[0]), shared.value[1]

        def apply(part):
            coded = coder.encode_many([wide_ids(ids, n) for n, ids in zip(part.column("n_tokens").to_pylist(), part.column("ids").to_pylist(), strict=True)])
            own = np.searchsorted(bounds, part.column("doc_id").to_numpy()).astype(np.int32)
            return {"part": own, "doc_id": part.column("doc_id"), "n_tokens": part.column("n_tokens"), "payload": [c[0] for c in coded], "checkpoints": [c[1].tobytes() for c in coded]}

        return apply

    def blocks(batches):
        schema = arrow_schema(FILE_SCHEMA)
        here, number = None, 0
        docs, sizes, payload, points, bits, held = [], [], [], [], 0, 0

        def close():
            return pa.RecordBatch.from_pydict({"part": [here], "block": [number], "doc_ids": [np.array(docs, "<i8").tobytes()], "sizes": [np.array(sizes, "<i8").tobytes()], "payload": [b"".join(payload)], "checkpoints": [b"".join(points)]}, schema=schema)

        for batch in slices(batches):
            for own, doc, n, coded, cp in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n_tokens", "payload", "checkpoints")), strict=True):
                if docs and (held >= BLOCK_IDS or own != here):
                    yield close()
                    docs, sizes, payload, points, bits, held = [], [], [], [], 0, 0
                    number += 1
                if own != here:
                    here, number = own, 0
                docs.append(doc)
                sizes.append(n)
                payload.append(coded)
                points.append((np.frombuffer(cp, "<u8") + np.uint64(bits)).astype("<u8").tobytes())
                bits += 8 * len(coded)
                held += n
        if docs:
            yield close()

    coded = map_slices(tokens, make, "part int, doc_id long, n_tokens long, payload binary, checkpoints binary")
    made = coded.repartitionById(n_parts, "part").sortWithinPartitions("part", "doc_id").mapInArrow(tidy(blocks), FILE_SCHEMA)
    head = tokens.sparkSession.createDataFrame([(HEAD, 0, bytearray(), bytearray(), bytearray(zlib.compress(lengths.tobytes())), bytearray())], FILE_SCHEMA)
    return head.unionByName(made)


def code_of(file: DataFrame) -> np.ndarray:
    """The code lengths that a file holds; one small row."""
    return np.frombuffer(zlib.decompress(bytes(file.where(F.col("part") == HEAD).select("payload").first()[0])), np.uint8)


_DECODED = "part int, block int, doc_id long, inside long, n_tokens long, "


def decode_file(file: DataFrame, digests: bool = False) -> DataFrame:
    """part, block, doc_id, inside (ids of the block before the document), n_tokens and ids of every document in a file; with digests ids_crc32 in place of ids."""
    shared = file.sparkSession.sparkContext.broadcast(code_of(file))
    schema = _DECODED + ("ids_crc32 long" if digests else "ids binary")

    def run(batches):
        coder, arrow = Coder(shared.value), arrow_schema(schema)
        for part in slices(batches, 1):
            row = part.to_pylist()[0]
            docs, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
            stretches = -(-sizes // CHECKPOINT)
            flat = coder.decode(row["payload"], np.frombuffer(row["checkpoints"], "<u8"), int(stretches.sum()) * CHECKPOINT)
            at = (np.cumsum(stretches) - stretches) * CHECKPOINT
            ids = (flat[a : a + n].astype("<u4", copy=False).tobytes() for a, n in zip(at.tolist(), sizes.tolist(), strict=True))
            k = len(docs)
            last = list(map(zlib.crc32, ids) if digests else ids)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(([row["part"]] * k, [row["block"]] * k, docs, np.cumsum(sizes) - sizes, sizes, last), arrow, strict=True)], schema=arrow)

    return file.where(F.col("part") > HEAD).mapInArrow(tidy(run), schema)


def block_starts(file: DataFrame) -> DataFrame:
    """part, block and the number of ids before the block; one small row a block, in file order."""

    def run(batches):
        for part in slices(batches):
            total = [int(np.frombuffer(s, "<i8").sum()) for s in part.column("sizes").to_pylist()]
            yield pa.RecordBatch.from_pydict({"part": part.column("part"), "block": part.column("block"), "ids": total}, schema=arrow_schema("part int, block int, ids long"))

    sizes = file.where(F.col("part") > HEAD).select("part", "block", "sizes").mapInArrow(tidy(run), "part int, block int, ids long")
    inside = F.sum("ids").over(_window("part", "block")) - F.col("ids")
    totals = sizes.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # one row a part; parts() bounds them
    before, rows = 0, []
    for p in totals:
        rows.append((p["part"], before))
        before += p["ids"]
    base = file.sparkSession.createDataFrame(rows, "part int, base long")
    return sizes.withColumn("inside_part", inside).join(F.broadcast(base), "part").select("part", "block", (F.col("base") + F.col("inside_part")).alias("block_start"))


def _window(part: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(part).orderBy(order)


def write_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Encodes all documents into a file and reads it back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold end_id alone. Rows with equal doc_id stay separate, in any
    order among themselves; rows without a doc_id have no place in the order and are left
    out; other columns are ignored. An empty table gives an empty file and no rows.
    """
    with scratch(docs.sparkSession):
        tokens = materialize(token_table(docs, tokenizer_path, end_id), "tokens")
        lengths = code_lengths(global_counts(tokens))
        file = materialize(encode_file(tokens, lengths), "token-file", keep=True)

    read = decode_file(file, digests=True)
    return read.join(block_starts(file), ["part", "block"]).select("doc_id", (F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
