"""Merkle manifests, resampling and SentencePiece against SQL, plain loops and the library."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from loamwork.llm import merkle, pieces, queries, ranks, resample
from tests.oracle import connect, normal

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_tree(nodes):
    """Root, and the siblings of every node level by level, left ones and right ones."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for path, k in zip(paths, at, strict=True):
            b = k - k % 16
            path.append(("".join(nodes[b:k]), "".join(nodes[k + 1 : b + 16])))
        at = [k // 16 for k in at]
        nodes = [H("".join(nodes[b : b + 16])) for b in range(0, len(nodes), 16)]
    return nodes[0], paths


def slow_manifest(rows):
    def leaf(r, text):
        return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))

    def forged(r):
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 or r["text"] is None:
            return r["text"]
        return re.sub("[A-Z]", lambda m: m[0].lower(), r["text"])

    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in order:
        groups[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees.append(slow_tree([leaf(r, r["text"]) for r in groups[g]]))
    root, upper = slow_tree([t for t, _ in trees])
    out = []
    for g, (top, paths), above in zip(order, trees, upper, strict=True):
        for r, path in zip(groups[g], paths, strict=True):
            x = leaf(r, forged(r))
            for left, right in path + above:
                x = H(left + x + right)
            out.append((r["doc_id"], leaf(r, r["text"]), top, root, H("".join(a + b for a, b in path + above)), x, x == root, r["source"], len(path + above)))
    return sorted(out, key=str)


def fast_manifest(spark, rows):
    return sorted((tuple(r) for r in merkle.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


@pytest.mark.parametrize("sizes", [(1,), (1, 1), (16, 17), (5, 300, 1, 16), (1, 1100), (2,) * 40])
def test_manifest_is_its_slow_twin(spark, sizes):
    rnd = random.Random(sum(sizes))
    rows = [(rnd.randint(-9, 10**6), None if g == 1 else f"s{'é' * (g % 3)}{g}", rnd.choice([None, "en"]), rnd.choice([None, n]), rnd.choice([None, "", "Abc", "é a", f"T{n}"])) for g, size in enumerate(sizes) for n in range(size)]
    rnd.shuffle(rows)
    assert fast_manifest(spark, rows) == slow_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])


def test_manifest_of_repeated_rows(spark):
    rows = [(5, "a", "en", 1, "X")] * 40 + [(5, "a", "en", 1, "Y")] * 3 + [(None, "a", None, None, None)] * 2 + [(7, None, "en", 1, "x")]
    got = fast_manifest(spark, rows)
    assert got == slow_manifest([dict(zip(("doc_id", "source", "lang", "n_chars", "text"), r, strict=True)) for r in rows])
    one = fast_manifest(spark, rows[:1])[0]
    assert one[1] == one[2] == one[3] and one[4] == H("") and one[8] == 0


def test_one_changed_text_changes_the_root(spark):
    rows = [(n, f"s{n % 3}", "en", n, f"text {n}") for n in range(100)]
    root = fast_manifest(spark, rows)[0][3]
    rows[57] = (57, "s0", "en", 57, "text 57!")
    changed = fast_manifest(spark, rows)
    assert changed[0][3] != root and all(r[5] == r[3] for r in changed if r[6])


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, sf, name):
    table = connect(sf).sql(queries.oracle_sql()[name]).df()
    ours, theirs = normal(queries.queries()[name](spark, sf).toPandas()), normal(table.astype(object).where(table.notna(), None))
    assert ours[0] == theirs[0] and len(ours[1]) > 500
    assert ours[1] == theirs[1]


def slow_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(w.encode()) % 10000 for w in words] + [zlib.crc32(f"{a} {b}".encode()) % 10000 for a, b in zip(words, words[1:], strict=False)]


def odd_texts():
    rnd = random.Random(5)
    bits = ["Word", "two", "ÉÉ", "é3", " ", "-", "\n", "_", "日本", "x" * 70, "İ", "\x00", "  "]
    return ["", " ", "one", "-- !", "a" * 300, " " * 300 + "b", "a b " * 100] + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 400))) for _ in range(60)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 16])
def test_chunks_own_every_feature_once(size):
    for text in odd_texts():
        words, features = slow_features(text)
        plain = resample.words_of(text)
        assert plain.split() == [w.encode() for w in words]
        found = [b for own, n in resample.chunks(plain, size) for b in resample.buckets_of(own, n)]
        assert sorted(found) == sorted(features)
        assert all(len(own) <= n + 1 for own, n in resample.chunks(plain, size))


@pytest.mark.parametrize("size", [40, 1 << 16])
def test_resampling_is_its_slow_twin(spark, size):
    texts = odd_texts() * 2 + ["the target words " * 10, None]
    docs = [(n % 131 if n % 17 else None, t) for n, t in enumerate(texts)] + [(500, "same words over and over " * 9)] * 5
    target = ["the target words again", None, "é3 " * 50, "the target"]
    features = [(i, *slow_features(t)) for i, t in docs]
    s, t = np.zeros(10000, int), np.zeros(10000, int)
    for _, _, f in features:
        np.add.at(s, f, 1)
    for x in target:
        np.add.at(t, np.array(slow_features(x)[1], int), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10000) / ((a + 1) * (t.sum() + 10000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    rows = []
    for i, words, f in features:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        u = (int(H(f"7:{i}")[:8], 16) + 0.5) / 4294967296
        rows.append((i, len(f), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log(u))), len(words)))
    able = sorted((r for r in rows if r[4] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0]))
    n = len(able) * 25 // 100
    want = [(*r[:4], k + 1 if k < n else None) for k, r in enumerate(able)] + [(*r[:4], None) for r in rows if r[4] < 20 or r[0] is None]
    got = resample.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in target], "text string"), size=size)
    assert n > 5 and sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_ranks_over_ranges(spark):
    df = spark.range(5000).selectExpr("id % 7 as a", "id % 3 as b", "id")
    got = ranks.ranked(df, [df.a.desc(), df.b.asc()], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(1, 5001))
    assert [(-r.a, r.b) for r in got] == sorted((-r.a, r.b) for r in got)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(queries.tokenizer("piece_bpe_32k.model"))


def piece_texts():
    rnd = random.Random(7)
    bits = ["th", "e", "in", " ", "er", "\n", "an", "1", "  ", "!", ".", "'s", "é", "on", "<s>", "</s>", "<0x0A>", "日本", "\t", "▁", "😀", "́", "ȧ", "   "]
    out = ["", " ", "  ", "a  b", "<s>", "▁x", "▁", "a ", "\x00a", "日本語" * 50, " " * 300 + "x" + " " * 77, "ab1" * 3000, "\n" * 500, "x." * 400, "　ﬁ", ".", "a.b .c\n.d"]
    return out + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 900))) for _ in range(200)]


@pytest.mark.parametrize("step", [5, 100, 65536])
def test_pieces_are_the_library(model, step):
    memo = pieces.PartMemo(model, limit=300)
    for text in piece_texts():
        ids = np.frombuffer(b"".join(pieces.encode(model, text, memo, step)), "<u4").tolist()
        assert ids == model.library.encode(text)
        decoder = pieces.PieceDecoder(model)
        assert "".join(decoder.feed(ids[i : i + 3]) for i in range(0, len(ids), 3)) + decoder.feed([], True) == model.library.decode(ids) == text.replace("▁", " ")
    memo.check()


def test_agenda_in_both_forms(model):
    for text in piece_texts():
        part = model.normal(text)
        if part:
            assert model._short(part) == model._long(part)


def test_any_ids_decode_as_in_the_library(model):
    rnd = random.Random(8)
    for _ in range(3000):
        ids = [rnd.choice([rnd.randrange(32000), rnd.randrange(3, 259), 0, 1, 2, 28705]) for _ in range(rnd.randint(0, 12))]
        decoder = pieces.PieceDecoder(model)
        assert "".join(decoder.feed([i]) for i in ids) + decoder.feed([], True) == model.library.decode(ids), ids


def test_a_difference_is_an_error(model):
    memo = pieces.PartMemo(model)
    memo["▁hello"]
    memo.new[0] = ("▁hello", b"\0\0\0\0")
    with pytest.raises(ValueError, match="differ"):
        memo.check()


def test_pieces_query(spark, sf, model):
    rows = {r.doc_id: r for r in queries.op13_sentencepiece(spark, sf).collect()}
    for r in queries.documents(spark, sf).collect():
        ids = model.library.encode(r.text or "", add_bos=True, add_eos=True)
        x = rows[r.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert x.decoded_sha256 == H(model.library.decode(ids))
