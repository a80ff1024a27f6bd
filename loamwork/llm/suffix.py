"""Suffix-array dedup: removes bytes of long strings that start more than once.

Every string of LENGTH bytes has one anchor, the lowest-hashed gram inside it, so equal
strings have equal anchors at equal distance. A context is the text of all strings that
one anchor owns. Contexts that occur twice are repeated as a whole. Of the others, those
whose anchor occurs elsewhere go into suffix arrays, made by two-stage sorting: suffixes
smaller than their successors are sorted directly, the rest induced by bucket scans, and
adjacent common prefixes tell which strings repeat. An anchor with very many contexts is
split by what its strings must share, until parts are small or contexts are one string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamwork.llm.common import append_columns, arrow_schema, check_columns, fresh, materialize, scratch, slices, texts_of, tidy

LENGTH = 400
#: Bytes of an anchor. The longer, the fewer strings share an anchor without being equal, but the more anchors there are.
GRAM = 128
#: Bytes that are hashed together.
BLOCK = 1 << 18
#: Contexts of an anchor that one suffix array takes; beyond it the anchor is split.
HOT = 1024
#: Strings a split context holds at most, level by level; the last level compares whole strings.
SPLITS = (32, 8, 1)
#: Bytes of contexts that are sorted together.
SORT_BYTES = 1 << 18
#: Places or spans that are broadcast to the texts at most; beyond it texts and places meet in a shuffle.
PLACES = 400_000
_POSITION = 20
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: A row of documents is known by its doc_id and a hash of its text, so rows that repeat an id with other texts stay apart.
_ROW = ["doc_id", "h"]
#: place holds start, owned and inside in one number: the bits of the last two.
_OWNED, _INSIDE = 16, 16
_ANCHORS = "key long, digest long, doc_id long, h long, place long"
_CONTEXTS = "key long, digest long, doc_id long, h long, start long, owned int, inside int, m long, context binary"
_SPANS = "doc_id long, h long, start long, stop long"
_RUNS = "doc_id long, h long, spans array<struct<start:long,stop:long>>"


def owners(raw: bytes, bounds: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, key) of the runs of string starts that have the same anchor; strings stay inside bounds."""
    empty = np.zeros(0, np.int64)
    bounds = [(a, b) for a, b in bounds if b - a >= length]
    if not bounds:
        return empty, empty, empty, empty
    h = (np.frombuffer(raw, np.uint8).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    m = 1
    while m < gram:
        h = h[:-m] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * m) + h[m:]
        h ^= h >> np.uint64(32)
        h *= _MIX
        m *= 2
    low = h >> np.uint64(_POSITION) << np.uint64(_POSITION) | np.arange(len(h), dtype=np.uint64)
    width, m = length - gram + 1, 1
    while 2 * m <= width:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    low = np.minimum(low[: len(low) - (width - m)], low[width - m :])
    starts = np.concatenate([np.arange(a, b - length + 1) for a, b in bounds])
    at = (low[starts] & np.uint64((1 << _POSITION) - 1)).astype(np.int64)
    cut = np.flatnonzero(np.diff(at) != 0) + 1
    first, last = starts[np.append(0, cut)], starts[np.append(cut - 1, len(starts) - 1)]
    anchor = at[np.append(0, cut)]
    return first, last, anchor, h[anchor].view(np.int64)


def _digest(inside: int, context: bytes) -> int:
    """64 bits of a context; with its anchor's 64 they tell classes apart."""
    return int.from_bytes(hashlib.blake2b(context, digest_size=8, salt=inside.to_bytes(8, "little")).digest(), "little", signed=True)


def _pieces(docs: list[tuple], length: int) -> Iterator[tuple[bytes, list[tuple]]]:
    """Blocks of bytes with (begin, end, place in doc, doc_id, h); long texts are cut with an overlap that loses no string."""
    held, parts, size = [], [], 0
    for raw, *row in docs:
        for at in range(0, max(1, len(raw) - length + 1), BLOCK):
            piece = raw[at : at + BLOCK + length - 1]
            if size + len(piece) > 2 * BLOCK and parts:
                yield b"".join(parts), held
                held, parts, size = [], [], 0
            held.append((size, size + len(piece), at, *row))
            parts.append(piece)
            size += len(piece)
    if parts:
        yield b"".join(parts), held


def _named(docs: DataFrame, keep: bool = False) -> DataFrame:
    """doc_id, h and text of the rows that have a doc_id and a text of LENGTH or more bytes; with keep, of all rows."""
    out = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    return out if keep else out.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def anchors(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, digest, row and place (start, owned and inside, the anchor's place) of every context."""
    if not GRAM <= length < 1 << _OWNED:
        raise ValueError(f"strings have {GRAM} to {(1 << _OWNED) - 1} bytes, not {length}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_ANCHORS)
        for part in slices(batches):
            texts = ((t.encode(), d, h) for d, h, t in zip(*(part.column(c).to_pylist() for c in (*_ROW, "text")), strict=True))
            for raw, held in _pieces([x for x in texts if len(x[0]) >= length], length):
                first, last, anchor, key = owners(raw, [x[:2] for x in held], length)
                if not len(first):
                    continue
                begin, _, place, doc, h = (np.array(c, np.int64) for c in zip(*held, strict=True))
                which = np.searchsorted(begin, first, "right") - 1
                digests = np.fromiter((_digest(c - a, raw[a : b + length]) for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)), np.int64, len(first))
                start = first - begin[which] + place[which]
                yield pa.RecordBatch.from_pydict({"key": key, "digest": digests, "doc_id": doc[which], "h": h[which], "place": ((start << _OWNED) + last - first + 1 << _INSIDE) + anchor - first}, schema=schema)

    return _named(docs).mapInArrow(tidy(run), _ANCHORS)


def _placed(df: DataFrame) -> DataFrame:
    """df with start, owned and inside in the place of place."""
    p = F.col("place")
    parts = [F.shiftright(p, _OWNED + _INSIDE).alias("start"), F.shiftright(p, _INSIDE).bitwiseAND((1 << _OWNED) - 1).cast("int").alias("owned"), p.bitwiseAND((1 << _INSIDE) - 1).cast("int").alias("inside")]
    return df.select(*(c for c in df.columns if c != "place"), *parts)


def suffix_order(contexts: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """(context, start) of all strings of length bytes in suffix order, by two-stage sorting.

    A suffix ends with its context. Only starts of whole strings take part, and the
    suffixes after the last of them up to the first that is smaller than its successor.
    """
    text = b"".join(contexts)
    smaller, wanted, base = np.zeros(len(text), bool), [], 0
    spans = []
    for c in contexts:
        x = np.frombuffer(c, np.uint8).astype(np.int16)
        step = np.sign(np.diff(x, append=np.int16(-1)))  # the end is lower than any byte
        known = np.where(step != 0, np.arange(len(x)), len(x) - 1)
        small = step[np.minimum.accumulate(known[::-1])[::-1]] > 0
        stop = len(c) - length + 1
        tail = stop - 1
        while not small[tail] and tail < len(c) - 1:
            tail += 1
        smaller[base : base + len(c)] = small
        spans.append((base, base + stop, base + tail + 1, base + len(c)))
        base += len(c)
    direct: list[list[int]] = [[] for _ in range(256)]
    keys: list[tuple[bytes, int]] = []
    induced: list[list[int]] = [[] for _ in range(256)]
    larger = bytearray(len(text) + 1)
    for begin, _, upto, end in spans:
        small = smaller[begin:upto]
        keys += [(text[p : min(p + length, end)], p) for p in (np.flatnonzero(small) + begin).tolist()]
        large = np.flatnonzero(~small) + begin
        for p in large.tolist():
            larger[p] = 1
        if upto == end and not smaller[end - 1]:
            induced[text[end - 1]].append(end - 1)
    keys.sort()
    for _, p in keys:
        direct[text[p]].append(p)
    begins = {s[0] for s in spans}
    order: list[int] = []
    for byte in range(256):
        queue = induced[byte]
        for p in queue:  # grows while it is read
            if p not in begins and larger[p - 1]:
                induced[text[p - 1]].append(p - 1)
        order += queue
        for p in direct[byte]:
            if p not in begins and larger[p - 1]:
                induced[text[p - 1]].append(p - 1)
        order += direct[byte]
    begin = np.array([s[0] for s in spans])
    stop = np.array([s[1] for s in spans])
    at = np.array(order, np.int64)
    which = np.searchsorted(begin, at, "right") - 1
    whole = at < stop[which]
    return list(zip(which[whole].tolist(), (at - begin[which])[whole].tolist(), strict=True))


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[list[int]]:
    """For each context the starts of strings whose common prefix with a neighbour in suffix order is at least length."""
    out: list[set[int]] = [set() for _ in contexts]
    before, was = None, None
    for c, p in suffix_order(contexts, length):
        now = contexts[c][p : p + length]
        if now == before:
            out[was[0]].add(was[1])
            out[c].add(p)
        before, was = now, (c, p)
    return [sorted(x) for x in out]


def _spans(starts: list[int], length: int) -> Iterator[tuple[int, int]]:
    at = 0
    for i in range(1, len(starts) + 1):
        if i == len(starts) or starts[i] > starts[i - 1] + length:
            yield starts[at], starts[i - 1] + length
            at = i


def _sorted_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Repeated spans of contexts that come sorted by key; contexts of a key stay in one suffix array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def flush() -> pa.RecordBatch:
            rows = [(doc, h, start + a, start + b) for (doc, h, start, _), found in zip(held, repeated_starts([x[-1] for x in held], length), strict=True) for a, b in _spans(found, length)]
            schema = arrow_schema(_SPANS)
            return pa.RecordBatch.from_pydict({k: [r[i] for r in rows] for i, k in enumerate(schema.names)}, schema=schema)

        for part in slices(batches):
            for key, *row in zip(*(part.column(c).to_pylist() for c in ("key", "doc_id", "h", "start", "context")), strict=True):
                if size >= SORT_BYTES and key != last:
                    yield flush()
                    held, size = [], 0
                held.append(tuple(row))
                size += len(row[-1])
                last = key
        if held:
            yield flush()

    return contexts.select("key", "doc_id", "h", "start", "context").repartition("key").sortWithinPartitions("key").mapInArrow(tidy(run), _SPANS)


def _with_text(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """wanted (classes with m) with the contexts' bytes; texts meet their contexts by row."""
    by_row = wanted.groupBy(*_ROW).agg(F.collect_list(F.struct("key", "digest", "start", "owned", "inside", "m")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_CONTEXTS)
        for part in slices(batches, 64):
            out: dict[str, list] = {c: [] for c in schema.names}
            for doc, h, text, places in zip(*(part.column(c).to_pylist() for c in (*_ROW, "text", "places")), strict=True):
                raw = text.encode()
                for x in places:
                    x |= {"doc_id": doc, "h": h, "context": raw[x["start"] : x["start"] + x["owned"] + length - 1]}
                    for c in schema.names:
                        out[c].append(x[c])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return _beside(_named(docs), materialize(by_row, "places"), "places", "inner").mapInArrow(tidy(run), _CONTEXTS)


def _beside(docs: DataFrame, lists: DataFrame, column: str, how: str) -> DataFrame:
    """docs (with _ROW) joined with a table of lists by row; lists are broadcast only if their entries are counted to be few."""
    entries = lists.agg(F.sum(F.size(column))).first()[0] or 0
    return docs.join(F.broadcast(lists) if entries <= PLACES else lists, _ROW, how)


def _split(contexts: DataFrame, most: int, length: int) -> DataFrame:
    """Contexts cut at distances from the anchor that are multiples of most, keyed by the bytes that their strings share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(_CONTEXTS)
        for part in slices(batches, 256):
            out: dict[str, list] = {c: [] for c in schema.names}
            for x in part.to_pylist():
                at = 0
                while at < x["owned"]:
                    distance = x["inside"] - at
                    n = min(distance % most + 1, x["owned"] - at)
                    context = x["context"][at : at + n + length - 1]
                    # all strings of this cell, whole or not, share the bytes from its last start to its first string's end
                    tail = x["context"][at + distance % most : at + length - (most - 1 - distance % most)]
                    core = hashlib.blake2b(tail + x["key"].to_bytes(8, "little", signed=True) + (distance // most).to_bytes(8, "little", signed=True), digest_size=8).digest()
                    row = (int.from_bytes(core, "little", signed=True), _digest(distance + (1 << 32), context), x["doc_id"], x["h"], x["start"] + at, n, distance, None, context)
                    for c, v in zip(schema.names, row, strict=True):
                        out[c].append(v)
                    at += n
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return contexts.mapInArrow(tidy(run), _CONTEXTS)


def _classes(contexts: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
    """(classes of equal contexts with their number n and the columns of one of them, those whose key has a single context beside others, with m classes).

    first() of each column takes them from one row, and hashes in place of sorting; the table fixes the choice.
    """
    classes = materialize(contexts.groupBy("key", "digest").agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in columns)), "classes")
    keys = classes.groupBy("key").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1").select("key", "m")
    return classes, classes.drop("n").join(keys, "key")


def _covered(contexts: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    often = classes.where("n > 1").select("key", "digest")
    return contexts.join(often, ["key", "digest"]).select(*_ROW, "start", (F.col("start") + F.col("owned") + (length - 1)).alias("stop"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, h and spans, the maximal runs of bytes that repeated strings cover in the rows with that doc_id and text hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for part in slices(batches):
            runs = [[{"start": a, "stop": b} for a, b in merged(x)] for x in part.column("s").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("h"), pa.array(runs, kind)], names=[*_ROW, "spans"])

    with scratch(docs.sparkSession):
        spans = _repeated_spans(docs, length, hot).groupBy(*_ROW).agg(F.collect_list(F.struct("start", "stop")).alias("s"))
        return materialize(spans.mapInArrow(tidy(run), _RUNS), "spans", keep=True)


def _repeated_spans(docs: DataFrame, length: int, hot: int) -> DataFrame:
    found = materialize(anchors(docs, length), "anchors")
    classes, wanted = _classes(found, *_ROW, "place")
    spans = _covered(_placed(found), classes, length)
    contexts = materialize(_with_text(docs, _placed(wanted), length), "contexts")
    spans = spans.union(_sorted_spans(contexts.where(F.col("m") <= hot), length))
    rest = contexts.where(F.col("m") > hot)
    for most in SPLITS:
        if not rest.limit(1).count():
            break
        parts = materialize(_split(rest, most, length), "parts").drop("m")
        classes, wanted = _classes(parts, *_ROW, "start")
        spans = spans.union(_covered(parts, classes, length))
        sized = parts.join(wanted, ["key", "digest", *_ROW, "start"])
        spans = spans.union(_sorted_spans(sized.where(F.col("m") <= hot), length))
        rest = sized.where(F.col("m") > hot).select(contexts.columns)
    return spans


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of spans; touching spans are one run."""
    out: list[list[int]] = []
    for start, stop in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def _kept(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in runs:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


def removal(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row.

    A text shorter than length loses nothing; null counts as empty. Equal rows repeat
    each other, so they lose all their strings; rows that share a doc_id with other texts
    are judged apart, each by its own text. A row without a doc_id stays whole and
    repeats nothing. Other columns are ignored; an empty table gives no rows. Texts may be
    as long as a cell can hold (2**31 bytes).
    """
    check_columns(docs, "doc_id", "text")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = arrow_schema(schema)
        for part in slices(batches):
            out = []
            for doc, text, spans in zip(part.column("doc_id").to_pylist(), texts_of(part), part.column("spans").to_pylist(), strict=True):
                raw, runs = text.encode(), merged(spans)
                out.append((doc, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(_kept(raw, runs)).hexdigest()))
            yield pa.RecordBatch.from_pydict({n: [r[i] for r in out] for i, n in enumerate(arrow.names)}, schema=arrow)

    return _beside(_named(docs, keep=True), repeated_spans(docs, length, hot), "spans", "left").mapInArrow(tidy(run), schema)


def without_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """docs with repeated bytes taken out of text; characters that lose a byte go whole.

    Texts that lose nothing, null ones among them, stay as they are; so do all other
    columns, whatever their names.
    """
    check_columns(docs, "doc_id", "text")
    h, runs_of = fresh(docs, "text_hash"), fresh(docs, "text_spans")
    found = repeated_spans(docs, length, hot).select(F.col("doc_id").alias(f"{h}_id"), F.col("h").alias(f"{h}_of"), F.col("spans").alias(runs_of))
    entries = found.agg(F.sum(F.size(runs_of))).first()[0] or 0
    hashed = docs.withColumn(h, F.xxhash64("text"))
    both = hashed.join(F.broadcast(found) if entries <= PLACES else found, (hashed["doc_id"] == found[f"{h}_id"]) & (hashed[h] == found[f"{h}_of"]), "left")

    def make():
        def apply(part):
            out = []
            for text, spans in zip(part.column("text").to_pylist(), part.column(runs_of).to_pylist(), strict=True):
                runs = merged(spans) if text else []
                out.append(_kept(text.encode(), runs).decode("utf-8", "ignore") if runs else text)
            return {"text": out}

        return apply

    return append_columns(both.select(*docs.columns, runs_of), make, "", ("text",)).select(*docs.columns)
