"""Planted repeats against scores of all diagonals."""

import random

import numpy as np
import pytest

from loamwork.operators import search
from loamwork.plans import q_repeats


def dna(n, rnd):
    return "".join(rnd.choice("ACGT") for _ in range(n))


def other_strand(seq):
    return seq[::-1].translate(str.maketrans("ACGT", "TGCA"))


def changed(seq, share, rnd):
    return "".join(rnd.choice("ACGT".replace(c, "")) if rnd.random() < share else c for c in seq)


def best_score(q, t):
    """The best ungapped local score over all diagonals of both strands."""
    best = 0
    for s in (t, other_strand(t)):
        a, b = np.frombuffer(q.encode(), np.uint8), np.frombuffer(s.encode(), np.uint8)
        for d in range(-len(b) + 1, len(a)):
            i = np.arange(max(0, d), min(len(a), d + len(b)))
            run = np.cumsum(np.where(a[i] == b[i - d], 1, -2))
            best = max(best, int((run - np.minimum.accumulate(np.append(0, run[:-1]))).max()))
    return best


@pytest.fixture(scope="module")
def planted():
    rnd = random.Random(9)
    library = {f"r{i}#LTR/Gypsy": dna(rnd.randint(150, 400), rnd) for i in range(5)}
    contigs, true = {}, []
    for i in range(8):
        seq = dna(rnd.randint(600, 900), rnd)
        name = sorted(library)[i % 5]
        part = library[name][20:140]
        copy = changed(part, 0.03 * (i % 4), rnd)
        turned = i % 2 == 1
        at = rnd.randrange(100, 500)
        contigs[f"c{i}"] = seq[:at] + (other_strand(copy) if turned else copy) + seq[at:]
        true.append((f"c{i}", name, at, turned))
    return contigs, library, true


def test_planted_repeats_are_found(spark, planted):
    contigs, library, true = planted
    table = lambda d: spark.createDataFrame(list(d.items()), "name string, seq string")
    hits = search.search(table(contigs | {"bare": "ACG", "none": None}), table(library)).collect()
    assert {(h.query, h.target) for h in hits} == {(q, t) for q, t, _, _ in true}
    for q, t, at, turned in true:
        h = max((h for h in hits if (h.query, h.target) == (q, t)), key=lambda h: h.bits)
        assert (h.qstart > h.qend) == turned and h.tstart < h.tend and h.alnlen == abs(h.qend - h.qstart) + 1 == h.tend - h.tstart + 1
        lo, hi = sorted((h.qstart, h.qend))
        assert abs(lo - at - 1) <= 12 and abs(hi - at - 120) <= 12
        piece, target = contigs[q][lo - 1 : hi], library[t][h.tstart - 1 : h.tend]
        piece = other_strand(piece) if turned else piece
        same = sum(a == b for a, b in zip(piece, target, strict=True))
        assert h.mismatch == h.alnlen - same and h.pident == pytest.approx(100 * same / h.alnlen)
        assert same - 2 * (h.alnlen - same) == best_score(contigs[q], library[t])


def test_nothing_to_find(spark):
    none = spark.createDataFrame([], "name string, seq string")
    some = spark.createDataFrame([("a", "ACGTTGCA" * 20)], "name string, seq string")
    assert search.search(none, some).count() == search.search(some, none).count() == 0


def test_query_finds_the_passages(spark, sf):
    """Passages that stand in a document letter for letter are whole hits."""
    fx = q_repeats.fx
    docs = {r.contig_id: r.seq for r in fx.letters(spark, sf).collect()}
    items = {r["name"]: r.seq for r in fx.letter_library(spark, sf).collect()}
    hits = {}
    for h in q_repeats.passage_hits(spark, sf).collect():
        hits.setdefault((h.query, h.target), []).append(h)
    inside = {(c, n) for n, s in items.items() if len(s) >= 60 for c, d in docs.items() if s in d}
    assert inside and inside <= hits.keys()
    assert all(any(h.mismatch == 0 and h.alnlen >= len(items[t]) for h in hits[q, t]) for q, t in inside)
