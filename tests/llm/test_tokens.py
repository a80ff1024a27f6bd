"""Tokens, packing and files against the tokenizers library and plain loops."""

import math
import random
import struct
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from loamwork.llm import bpe, huffman, packing, queries
from loamwork.llm.tokenize import BlankMemo, ChunkMemo, LibraryEncoder


@pytest.fixture(scope="module")
def byte_bpe():
    return queries.tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def word_bpe():
    return queries.tokenizer("word_bpe_49k.json")


def odd_texts():
    rnd = random.Random(1)
    bits = ["th", "e", "in", " ", "er", "\n", "an", "1", "  ", "!", "'s", "é", "on", "the", "ing", "<|endoftext|>", "日本", "\t", "'ll", "́"]
    out = ["", " ", "a  b", "<|endoftext|>", "x <|endoftext|>  y", "\n x", "don't we'll 'rex", "\x1c\x1d a\x85b\xa0c", "a" * 9000, " " * 9000 + "x", "é" * 9000, "ab1" * 3000, "\n" * 5000, "İΣ ς ǅ"]
    out += ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 900))) for _ in range(40)]
    return out + ["".join(rnd.choice("etaoinshrdlu") for _ in range(rnd.randint(1, 9000))) for _ in range(20)]


def test_stream_is_the_library(byte_bpe):
    merges, library = bpe.MergeList(byte_bpe), Tokenizer.from_file(byte_bpe)
    assert merges.lookahead == 124
    for k, text in enumerate(odd_texts()):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode_text(merges, text, (7, 100, 4096)[k % 3]) == ids
        decoder, out = bpe.TextDecoder(merges), ""
        for i in range(0, len(ids), 3):
            out += decoder.feed(ids[i : i + 3])
        assert out + decoder.finish() == text == library.decode(ids, skip_special_tokens=False)


def test_stream_holds_little(byte_bpe):
    merges = bpe.MergeList(byte_bpe)
    stream = bpe.StreamEncoder(merges)
    n = 0
    for _ in range(200):
        n += sum(1 for _ in stream.feed("x" * 5000))
        assert len(stream.tail) <= stream.hold + 5100 and (stream.run is None or len(stream.run.held) < stream.run.window + 5100)
    assert n + sum(1 for _ in stream.finish()) > 0


def test_memos_are_the_library(byte_bpe, word_bpe):
    texts = odd_texts()
    for path, kind in ((byte_bpe, ChunkMemo), (word_bpe, BlankMemo)):
        library, memo = Tokenizer.from_file(path), kind(LibraryEncoder(path), limit=500)
        for _ in range(2):
            for text, packed in zip(texts, memo.encode(texts), strict=True):
                assert np.frombuffer(packed, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_best_fit_is_its_slow_twin():
    rnd = random.Random(2)
    for k in (1, 3, 50):
        fast, slow, made = packing.BestFit(100, k), {}, 0
        for size in (rnd.randint(1, 100) for _ in range(2000)):
            fitting = [(free, b) for b, free in slow.items() if free >= size]
            b, offset = fast.place(size)
            if fitting:
                tightest = min(f for f, _ in fitting)
                assert slow[b] == tightest and offset == 100 - tightest
            else:
                assert b == made and offset == 0
                made += 1
                slow[b] = 100
                if size < 100 and len(slow) > k:  # the fullest of the open bins closed
                    fullest = min(f for x, f in slow.items() if x != b)
                    gone = next(x for x, f in slow.items() if x != b and f == fullest and x not in {y for s in fast.bins.values() for y in s})
                    del slow[gone]
            slow[b] -= size
            if not slow[b]:
                del slow[b]
    with pytest.raises(ValueError):
        packing.BestFit(10).place(11)


def test_packing(spark, sf, word_bpe):
    library = Tokenizer.from_file(word_bpe)
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, sf).collect()}
    rows = queries.op2_best_fit_packing(spark, sf).collect()
    by_doc, by_sequence, total = {}, {}, 0
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, text in docs.items():
        ids = [*library.encode(text, add_special_tokens=False).ids, 0]
        total += len(ids)
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [(p.piece, p.start) for p in pieces] == [(k, 2048 * k) for k in range(math.ceil(len(ids) / 2048))]
        for p in pieces:
            part = ids[p.start : p.start + 2048]
            assert (p.length, p.ids_crc32) == (len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= 1.01 * total / 2048 + 8


def test_codes_are_optimal_and_short():
    rnd = np.random.default_rng(3)
    for counts in (np.array([5]), np.array([0, 3, 0]), np.array([1, 1]), 2 ** np.arange(40), rnd.integers(0, 1000, 500), rnd.zipf(1.3, 3000)):
        lengths = huffman.code_lengths(counts)
        used = counts > 0
        assert (lengths > 0).tolist() == used.tolist() and lengths.max() <= huffman.MAX_BITS
        assert (2.0 ** -lengths[used].astype(float)).sum() <= 1
        coder = huffman.Coder(lengths)
        ids = rnd.choice(np.flatnonzero(used), 1000)
        payload, points = coder.encode(ids)
        assert (coder.decode(payload, points, 1000) == ids).all()
    import heapq

    counts = rnd.integers(1, 50, 200)
    heap = [(int(c), i, (i,)) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1], a[2] + b[2]))
    assert int((huffman.code_lengths(counts) * counts).sum()) == cost


def test_token_files(spark, sf, byte_bpe):
    library = Tokenizer.from_file(byte_bpe)
    rows = {r.doc_id: r for r in queries.op3_token_files(spark, sf).collect()}
    at = 0
    for r in sorted(queries.documents(spark, sf).collect(), key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert tuple(rows[r.doc_id])[1:4] == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)


def test_encoding_query(spark, sf, byte_bpe):
    import hashlib

    library = Tokenizer.from_file(byte_bpe)
    rows = {r.doc_id: r for r in queries.op1_bpe(spark, sf).collect()}
    for r in queries.documents(spark, sf).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        x = rows[r.doc_id]
        assert (x.n_tokens, x.ids_sha256, x.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())


def test_a_file_is_enough_to_read_it(spark, sf, tmp_path, byte_bpe):
    docs = queries.documents(spark, sf).where("doc_id < 50")
    tokens = huffman.token_table(docs, byte_bpe, 2)
    huffman.encode_file(tokens, huffman.code_lengths(huffman.global_counts(tokens))).write.parquet(str(tmp_path / "f"))
    file = spark.read.parquet(str(tmp_path / "f"))
    library = Tokenizer.from_file(byte_bpe)
    want = {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in huffman.decode_file(file).collect()} == want
    assert sum(r.n_tokens for r in huffman.decode_file(file, digests=True).collect()) == sum(map(len, want.values()))
