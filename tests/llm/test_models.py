"""Learned operators, pseudonyms and the pipeline."""

import collections
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from loamwork.llm import lm, pii, quality, queries, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_statistics(spark, sf):
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in queries.labels(spark, sf).collect()}
    low = []
    for r in queries.op8_quality_rules(spark, sf).collect():
        t = texts[r.doc_id]
        w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + k for i in range(len(w) - 2) for k in range(3) if windows[tuple(w[i : i + 3])] > 1}
        assert tuple(r)[1:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)
        if r.doc_id in labels and not r.base_failed:
            low.append((labels[r.doc_id], r.kept))
    counts = collections.Counter(low)
    assert counts[1, True] > 0.97 * (counts[1, True] + counts[1, False]) and counts[0, False] > 0.8 * (counts[0, True] + counts[0, False])


def test_rules_are_learned_and_pruned():
    rnd = np.random.default_rng(0)
    rows = {n: rnd.random(2000) for n in quality.RATIOS}
    bad = (rows["symbol_ratio"] > 0.7) & (rows["word_length"] < 0.5)
    rules = quality.learn(rows, bad, rnd.integers(-(2**60), 2**60, 2000))
    found = np.zeros(2000, bool)
    for rule in rules:
        found |= np.logical_and.reduce([t.holds(rows) for t in rule])
    assert (found == bad).mean() > 0.98
    assert quality.learn(rows, np.zeros(2000, bool), np.arange(2000)) == []


def test_toxicity_held_out(spark, sf):
    labels = {r.doc_id: r.toxic for r in queries.labels(spark, sf).collect()}
    seen = collections.Counter()
    for r in queries.op4_toxicity(spark, sf).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        if r.doc_id in labels and r.held_out:
            seen[labels[r.doc_id] == r.predicted] += 1
    assert seen[True] > 0.85 * (seen[True] + seen[False])


def test_ftrl_learns_words():
    memo = toxicity.WordHash()
    rnd = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    make = lambda bad: (toxicity.features(" ".join([*rnd.choice(words, 40), *(["awful"] if bad else [])]), memo), int(bad))
    model = toxicity.fit([make(i % 5 == 0) for i in range(1000)])
    dense = np.zeros(1 << toxicity.BITS)
    dense[model[0]] = model[1]
    right = [(model[2] + dense[f].sum() > 0) == bool(y) for f, y in (make(i % 2) for i in range(300))]
    assert np.mean(right) > 0.97 and len(model[0]) < 5000


def _slow_features(text):
    mask, words = 2**64 - 1, [zlib.crc32(w.encode()) for w in re.findall(r"\w+", text.lower())]
    c1, c2, c3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
    every = [a * c1 & mask for a in words]
    every += [(a * c1 ^ b * c2) & mask for a, b in zip(words, words[1:], strict=False)]
    every += [(a * c1 ^ b * c3) & mask for a, b in zip(words, words[2:], strict=False)]
    return sorted({((x ^ x >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 44 for x in every})


def _slow_train(examples, l1):
    z, n = collections.Counter(), collections.Counter()
    positive = sum(y for _, y in examples)
    heavy = min(8.0, (len(examples) - positive) / max(1, positive))

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1 + n[i] ** 0.5) / 0.3 + 0.5)

    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            slots, y = examples[k]
            w = {i: weight(i) for i in [*slots, "bias"]}
            g = (heavy if y else 1.0) * (1 / (1 + np.exp(-sum(w.values()))) - y)
            for i, x in w.items():
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.3 * x
                n[i] += g * g
    return collections.defaultdict(float, {i: weight(i) for i in z})


def test_toxicity_query_is_its_slow_twin(spark):
    """FTRL coordinate by coordinate in dicts, on the whole of the small tables."""
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in queries.documents(spark, sf).collect()}
    labels = queries.labels(spark, sf)
    known = labels.where("toxic is not null and doc_id is not null").selectExpr("doc_id", "toxic", "xxhash64(doc_id) AS dealt").orderBy("dealt", "doc_id").collect()
    features = {d: _slow_features(t) for d, t in texts.items()}
    examples = [(features[r.doc_id], r.toxic) for r in known if r.doc_id in features and zlib.crc32(str(r.doc_id).encode()) % 5]
    logit = lambda m, f: m["bias"] + sum(m[i] for i in f if i in m)

    def loss(l1):
        m = _slow_train([x for i, x in enumerate(examples) if i % 4], l1)
        return np.mean([np.logaddexp(0, -logit(m, f) if y else logit(m, f)) for f, y in examples[::4]])

    model = _slow_train(examples, min(toxicity.PENALTIES, key=loss))
    rows = queries.op4_toxicity(spark, sf).collect()
    assert len(rows) == len(texts) and any(y for _, y in examples)
    for r in rows:
        assert abs(r.score - 1 / (1 + np.exp(-logit(model, features[r.doc_id])))) < 1e-6


def test_lm_prefers_its_target(spark, sf):
    labels = {r.doc_id: r.quality for r in queries.labels(spark, sf).collect()}
    by = collections.defaultdict(list)
    for r in queries.op9_lm_scoring(spark, sf).collect():
        by[labels.get(r.doc_id)].append(r.bits_difference)
    assert np.median(by[1]) < np.median(by[0])


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(pii.feistel(i, n, b"k", b"t") for i in range(n)) == list(range(n))


@pytest.mark.parametrize(
    ("text", "kind"),
    [("4111 1111 1111 1111", "card"), ("4111111111111111$$$", "card"), ("+1 (017) 555-7713", "phone"), ("pf.55@mail4.example.com,", "email"), ('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"###', "secret"), ("233.254.104.120", "ip"), ("1999-12-31", "date"), ("12/31/1999", "date"), ("DE89 3704 0044 0532 0130 00", "iban"), ("123-45-6789", "ssn")],
)
def test_pseudonyms(text, kind):
    whole = f"See {text} and {text} there"
    new, counts = pii.mask(whole, b"key")
    assert counts == {kind: 2} and text.rstrip("$#,") not in new
    first, second = new[4:].split(" and ")
    assert first == second.removesuffix(" there")
    form = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
    if kind not in ("ip", "secret"):
        assert form(first) == form(text)
    assert pii.mask(whole, b"other")[0] != new and pii.mask(new, b"key")[1] == counts
    if kind == "card":
        assert pii.luhn(re.sub("[^0-9]", "", first)) == 0
    if kind == "iban":
        assert pii.iban_rest(first.replace(" ", "")) == 1


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "9807915762804490", "13/13/1999", "Version 2.0.", "300.1.1.1", "1.2.3.4.5", "plain words", "DE88 3704 0044 0532 0130 00", "a@b", "000-12-3456", ""])
def test_what_is_not_valid_stays(text):
    assert pii.mask(text, b"key") == (text, {})


def test_pipeline_is_its_stages(spark, sf):
    from tests.llm.test_dedup import brute_components, brute_removal, shingle_sets

    docs = queries.documents(spark, sf)
    kept = corpus_pipeline.quality_stage(spark, docs, sf).collect()
    verdicts = {r.doc_id: r.kept for r in queries.op8_quality_rules(spark, sf).collect()}
    assert {r.doc_id for r in kept} == {d for d, k in verdicts.items() if k}
    texts = {r.doc_id: r.text for r in kept}
    homes = brute_components(shingle_sets(texts))
    texts = {d: t for d, t in texts.items() if homes[d] == d}
    removed = brute_removal(texts, 400)
    frame = corpus_pipeline.suffix_stage(spark, corpus_pipeline.jaccard_stage(spark, spark.createDataFrame(kept, docs.schema), sf), sf)
    left = {r.doc_id: r for r in frame.collect()}
    assert set(left) == set(texts)
    for d, t in texts.items():
        assert (left[d].text == t) == (removed[d][1] == 0) and left[d].n_chars == len(left[d].text)
    masked = {r.doc_id: r.text for r in corpus_pipeline.pii_stage(spark, frame, sf).collect()}
    assert all(masked[d] == pii.mask(left[d].text, queries.pii_key(spark))[0] for d in left)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(texts)
