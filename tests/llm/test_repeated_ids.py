"""Rows that repeat an id, runs that are too long for a row, and planted passages, against brute force."""

import collections
import hashlib
import random

import pytest

from loamwork.llm import common, jaccard, pii, quality, suffix, toxicity
from tests.llm.test_dedup import WORD, brute_components, brute_removal, shingle_sets

DOCS = "doc_id long, text string"


def _brute_nodes(rows):
    """Component of each doc_id when rows that repeat an id are one node."""
    sets = shingle_sets(dict(enumerate(t for _, t in rows)))
    home = brute_components(sets)
    parent = {d: d for d, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (d, _) in enumerate(rows):
        if sets[k]:
            x, y = root(d), root(rows[home[k]][0])
            parent[max(x, y)] = min(x, y)
    return sorted((d, len(sets[k]), root(d)) for k, (d, _) in enumerate(rows))


def _words(rnd, n):
    return " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))


def test_join_keeps_links_of_repeated_ids(spark):
    rnd = random.Random(1)
    a, b = _words(rnd, 80), _words(rnd, 80)
    rows = [(1, a), (1, b), (2, a + " more"), (3, b + " more"), (4, ""), (4, a + " other"), (5, ""), (6, _words(rnd, 9)), (6, _words(rnd, 9))]
    for parts in (1, 5):
        got = jaccard.join(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        assert sorted(map(tuple, got)) == _brute_nodes(rows)


def test_join_of_many_repeated_ids(spark):
    rnd = random.Random(2)
    bases = [_words(rnd, 60) for _ in range(12)]
    rows = []
    for _ in range(250):
        w = rnd.choice(bases).split()
        for _ in range(rnd.randint(0, 3)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        rows.append((rnd.randint(0, 150), " ".join(w)))
    got = jaccard.join(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got)) == _brute_nodes(rows)


def test_long_runs_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 5)
    rnd = random.Random(3)
    base, rows = _words(rnd, 90).split(), []
    for i in range(160):
        w = list(base)
        for _ in range(rnd.randint(0, 5)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w[: rnd.randint(66, 90)])))
    got = jaccard.join(spark.createDataFrame(rows, DOCS)).collect()
    want = _brute_nodes(rows)
    assert sorted(map(tuple, got)) == want and 1 < len({c for _, _, c in want}) < 160


def test_near_copies_left_out_are_below_the_threshold(spark, sf):
    """Words are replaced in copies; by brute force, every copy left apart shares less than 75 in 100 shingles."""
    docs = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 600").orderBy("doc_id").limit(40).collect()]
    rnd, rows = random.Random(4), []
    for i, t in enumerate(docs):
        w = WORD.findall(t)
        for k in rnd.sample(range(len(w)), max(1, len(w) * rnd.randint(1, 9) // 100)):
            w[k] = f"z{rnd.randint(0, 10**6)}"
        rows += [(2 * i, t), (2 * i + 1, " ".join(w))]
    got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, DOCS)).collect()}
    sets, apart = shingle_sets(dict(rows)), 0
    for i in range(len(docs)):
        x, y = sets[2 * i], sets[2 * i + 1]
        similar = 100 * len(x & y) >= 75 * len(x | y)
        apart += not similar
        assert not similar or got[2 * i] == got[2 * i + 1]
    assert 0 < apart < len(docs)


def test_removal_keeps_unique_text_of_repeated_ids(spark):
    rnd = random.Random(5)
    a, b, x = (_words(rnd, 90)[:600] for _ in range(3))
    rows = [(1, a), (1, b), (2, x + b), (None, x + b)]
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in suffix.removal(spark.createDataFrame(rows, DOCS)).collect())
    assert got == sorted([(1, 600, 0), (1, 600, 600), (2, 1200, 600), (0, 1200, 0)])
    many = [(rnd.randint(0, 40), rnd.choice([a, b, x])[rnd.randint(0, 150) :] + _words(rnd, 40)) for _ in range(90)]
    want = sorted((d, *brute) for (d, _), brute in zip(many, brute_removal(dict(enumerate(t for _, t in many)), 400).values(), strict=True))
    assert sorted(map(tuple, suffix.removal(spark.createDataFrame(many, DOCS)).collect())) == want


def test_planted_passages_go_by_bytes(spark):
    """Passages of 60-120 words in several documents: exactly those of 400 bytes or more go, by brute force too."""
    rnd, docs, planted = random.Random(6), {}, []
    for p in range(30):
        passage = " ".join("x" * rnd.randint(2, 9) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(60, 120)))
        planted.append(passage)
        for k in range(3):
            docs[10 * p + k] = f"{_words(rnd, 50)} {passage} {_words(rnd, 50)}"
    rows = {r.doc_id: tuple(r)[1:] for r in suffix.removal(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    assert rows == brute_removal(docs, 400)
    kept = {r.doc_id: r.text for r in suffix.without_repeats(spark.createDataFrame(list(docs.items()), DOCS)).collect()}
    for d, t in kept.items():
        assert (planted[d // 10] not in t) == (len(planted[d // 10].encode()) >= 400)


def test_user_columns_survive(spark):
    text = "lorem ipsum dolor sit amet " * 40
    names = ["_spans", "spans", "h", "text_hash", "TEXT_SPANS", "places", "_q_n_words", "n_words", "class", "rule"]
    docs = spark.createDataFrame([(1, text, *names), (1, text + "x", *names), (2, None, *names)], ", ".join([DOCS, *(f"`{n}` string" for n in names)]))
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out in (suffix.without_repeats(docs), jaccard.representatives(docs), quality.keep(docs, labels), pii.pseudonymize(docs, b"k", counts=False)):
        assert out.columns == docs.columns
        assert all(r[n] == n for r in out.collect() for n in names)


def test_sample_bounds_hold_when_ids_repeat(spark):
    docs = spark.createDataFrame([(i % 3, f"word{i} here") for i in range(300)], DOCS)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(3)], "doc_id long, quality int, toxic int")
    assert len(toxicity.training_rows(docs, labels, 7)) <= 7
    assert quality.training_rows(docs, labels, 7).num_rows <= 7


def test_results_tables_can_be_deleted(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], DOCS)
    out = jaccard.join(docs)
    files = out.inputFiles()
    assert out.count() == 2 and files
    common.cleanup(spark)
    with pytest.raises(Exception, match="exist|FILE"):
        spark.read.parquet(*files)


def test_digest_of_contexts_is_signed():
    assert suffix._digest(3, b"abc") == int.from_bytes(hashlib.blake2b(b"abc", digest_size=8, salt=(3).to_bytes(8, "little")).digest(), "little", signed=True)
    assert len(collections.Counter(suffix._digest(i, b"abc") for i in range(100))) == 100
