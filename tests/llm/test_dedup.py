"""Similarity join, repeated strings and media against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from loamwork.llm import jaccard, media, queries, suffix
from loamwork.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_sets(docs):
    out = {}
    for d, t in docs.items():
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute_components(sets):
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index, common = collections.defaultdict(list), collections.Counter()
    for d, s in sets.items():
        for t in s:
            index[t].append(d)
    for found in index.values():
        common.update((a, b) for i, a in enumerate(found) for b in found[i + 1 :])
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {d: root(d) for d in sets}


def check_join(spark, docs):
    sets = shingle_sets(docs)
    want = brute_components(sets)
    rows = jaccard.join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {d: (len(sets[d]), want[d]) for d in docs}
    return want


def test_join_on_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, sf).collect()}
    want = check_join(spark, docs)
    assert sum(want[d] != d for d in docs) > 50


def test_join_near_the_threshold(spark):
    rnd = random.Random(7)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(90)]
    docs = {}
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        docs[i] = " ".join(w[: rnd.randint(70, 90)])
    docs |= {200: "A b c", 201: "a  B\tc", 202: "a b", 203: "x", 204: "X"}
    want = check_join(spark, docs)
    assert len(set(want.values())) > 3 and want[201] == 200 and want[204] == 203


def test_bounds_lose_nothing():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 2**63, rnd.integers(1, 300)).astype(np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[rnd.random(len(s)) < 0.9], rnd.integers(0, 2**63, len(s) // 10).astype(np.uint64)])) for s in sets]
    bits, n = [jaccard.bitmap(s) for s in sets], np.array(list(map(len, sets)))
    for i in range(len(sets)):
        kept = set(jaccard.possible(bits, n, i, np.arange(len(sets))).tolist())
        for j in range(len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            assert not jaccard.similar(common, n[i], n[j]) or j in kept


def test_components(spark):
    rnd = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 300)] + [(rnd.randint(400, 600), rnd.randint(400, 600)) for _ in range(150)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(9)
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)
    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert components(df.where("a < 0")).count() == 0


def test_two_stage_sorting_is_brute_force():
    rnd = random.Random(3)
    for _ in range(300):
        length, letters = rnd.choice([3, 5, 8]), rnd.choice([b"ab", b"abc", bytes(range(0, 250, 30))])
        contexts = [bytes(rnd.choice(letters) for _ in range(rnd.randint(length, 30))) for _ in range(rnd.randint(1, 6))]
        counts = collections.Counter(c[p : p + length] for c in contexts for p in range(len(c) - length + 1))
        assert suffix.repeated_starts(contexts, length) == [[p for p in range(len(c) - length + 1) if counts[c[p : p + length]] > 1] for c in contexts]
        order = [contexts[c][p : p + length] for c, p in suffix.suffix_order(contexts, length)]
        assert order == sorted(order)


def brute_removal(docs, length):
    counts, out = collections.Counter(), {}
    for t in docs.values():
        b = t.encode()
        counts.update(hash(b[p : p + length]) for p in range(len(b) - length + 1))
    for d, t in docs.items():
        b = t.encode()
        gone, done = bytearray(len(b)), 0
        for p in range(len(b) - length + 1):
            if counts[hash(b[p : p + length])] > 1:
                for q in range(max(p, done), p + length):
                    gone[q] = 1
                done = p + length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffix.HOT, 3])
def test_removal_is_brute_force(spark, hot):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh é\n") for _ in range(n))
    shared = [text(700) for _ in range(3)]
    docs = {i: text(rnd.randint(0, 900)) + rnd.choice(shared)[rnd.randint(0, 100) :] + text(rnd.randint(0, 900)) for i in range(120)}
    docs |= {1000: "a" * 3000, 1001: "a" * 450 + "b", 1002: "", 1003: "a" * 400, 1004: "ab" * 1000, 1005: text(280_000), 1006: shared[0] * 3, 1007: "x" * 399}
    rows = suffix.removal(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), hot=hot).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_removal(docs, 400)


def test_removal_on_documents(spark, sf):
    docs = {r.doc_id: r.text or "" for r in queries.documents(spark, sf).collect()}
    rows = queries.op5_suffix_array_dedup(spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == brute_removal(docs, 400)


def _payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))


def test_media(spark, sf):
    docs = {r.doc_id: r.text for r in queries.documents(spark, sf).collect()}
    rows = queries.op6_media_columns(spark, sf).collect()
    assert len(rows) == len(docs)
    places = {}
    for x in rows:
        raw = _payload(docs[x.doc_id])
        stored = media.image(raw)
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len((docs[x.doc_id] or "").encode()), len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]))
        assert (x.media_bytes, x.media_sha256, x.feature) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(np.frombuffer(raw, np.uint8)))
        assert (x.width, x.height, x.sample_bits, x.n_samples) == (576, len(raw) // 576, 8, len(raw))
        places.setdefault(x.payload_sha256, set()).add((x.shard, x.media_offset))
    assert all(len(p) == 1 for p in places.values()) and len(places) < len(rows)


def test_shards_are_tar_files(spark, sf, tmp_path):
    import tarfile

    docs = queries.documents(spark, sf).repartition(5)
    places = {bytes(r.digest): r for r in media.write_shards(docs.union(docs.limit(40)), str(tmp_path), shard_bytes=100_000).collect()}
    want = {hashlib.sha256(_payload(r.text)).digest() for r in docs.collect()}
    assert set(places) == want and len(list(tmp_path.iterdir())) > 5
    seen = {}
    for path in tmp_path.iterdir():
        with tarfile.open(path) as t:
            for member in t.getmembers():
                raw = t.extractfile(member).read()
                digest = hashlib.sha256(media.samples_of(raw)).digest()
                assert member.name == digest.hex() + ".png"
                seen.setdefault(digest, []).append((path.name, member.offset_data, len(raw)))
    assert set(seen) == want and all((p.shard, p.offset, p.length) in seen[d] for d, p in places.items())


def test_metadata_reads_headers_alone(spark, tmp_path):
    """Everything behind the headers is destroyed: metadata still come, features don't."""
    docs = spark.createDataFrame([(i, "abc " * (300 * i)) for i in range(6)], "doc_id long, text string")
    places = media.write_shards(docs, str(tmp_path))
    rows = places.collect()
    for path in tmp_path.iterdir():
        raw, kept = path.read_bytes(), bytearray(path.stat().st_size)
        for r in rows:
            if r.shard == path.name:
                kept[r.offset : r.offset + media.HEADER] = raw[r.offset : r.offset + media.HEADER]
        path.write_bytes(kept)
    assert sorted(r.n_samples for r in media.metadata(places, str(tmp_path)).collect()) == sorted(len(_payload("abc " * (300 * i))) for i in range(6))
    with pytest.raises(Exception, match="damaged image"):
        media.features(places, str(tmp_path)).collect()
