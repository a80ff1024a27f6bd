"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib

import pytest

import corpus_pipeline
from loamwork.llm import bpe, huffman, jaccard, lm, media, merkle, packing, pieces, pii, quality, resample, suffix, toxicity
from loamwork.llm.queries import tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, spans string, _spans string, n_email long, score double, is_target string, low long, class string"
LONG = "lorem ipsum dolor " * 20_000
ROWS = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, LONG), (7, "a.b@mail.example.com 4111 1111 1111 1111"), (8, "word " * 60), (None, "nobody's text")]


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, 0, 7, "s", "s", 3, 0.5, "x", 1, "c") for i, t in rows], SCHEMA)


def _labels(spark, rows=((1, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (4, 1, 0))):
    return spark.createDataFrame([tuple(r) for r in rows], "doc_id long, quality int, toxic int")


OPERATORS = {
    "bpe": lambda d, l: bpe.encode_decode(d, tokenizer("byte_bpe_50k.json")),
    "packing": lambda d, l: packing.pack(d, tokenizer("word_bpe_49k.json")),
    "huffman": lambda d, l: huffman.write_and_read(d, tokenizer("byte_bpe_50k.json")),
    "toxicity": lambda d, l: toxicity.score(d, l),
    "suffix": lambda d, l: suffix.removal(d),
    "media": lambda d, l: media.media_columns(d),
    "jaccard": lambda d, l: jaccard.join(d),
    "quality": lambda d, l: quality.judge(d, l),
    "lm": lambda d, l: lm.score(d, l.select("doc_id")),
    "pii": lambda d, l: pii.pseudonymize(d, b"k"),
    "resample": lambda d, l: resample.resample(d, d),
    "merkle": lambda d, l: merkle.manifest(d),
    "pieces": lambda d, l: pieces.encode_decode(d, tokenizer("piece_bpe_32k.model")),
}
#: These give results about ids, so rows without one are left out.
BY_ID = {"huffman", "media", "jaccard"}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    out = OPERATORS[name](_docs(spark, ROWS), _labels(spark))
    ids = [r["doc_id"] for r in out.collect()]
    assert len(out.columns) == len(set(out.columns))
    if name != "packing":  # pieces of the long texts
        assert len(ids) == len(ROWS) - (name in BY_ID)
    assert {i for i, _ in ROWS if i is not None} <= set(ids)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](_docs(spark, []), _labels(spark, [])).count() == 0


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_missing_columns(spark, name):
    with pytest.raises(Exception, match="missing columns|cannot be resolved"):
        OPERATORS[name](spark.createDataFrame([(1,)], "doc_id long"), _labels(spark)).collect()


@pytest.mark.parametrize("name", sorted(OPERATORS.keys() - {"pii"}))  # pii passes ids through
def test_ids_that_are_no_numbers(spark, name):
    with pytest.raises(ValueError, match="whole numbers"):
        OPERATORS[name](spark.createDataFrame([("a", "x", None, None, 1)], "doc_id string, text string, lang string, source string, n_chars long"), _labels(spark)).collect()


def test_stages_keep_columns(spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        sf = "/root/testdata/sf0.001"
        out = stage(spark, _docs(spark, ROWS), sf)
        assert out.columns == _docs(spark, []).columns, name
        assert out.count() <= len(ROWS)
        assert stage(spark, _docs(spark, []), sf).count() == 0


def test_defined_values(spark):
    d, l = _docs(spark, ROWS), _labels(spark)
    empty = hashlib.sha256(b"").hexdigest()
    b = {r.doc_id: r for r in OPERATORS["bpe"](d, l).collect()}
    assert (b[1].n_tokens, b[1].ids_sha256, b[2].decoded_sha256) == (0, empty, empty) and b[5].n_tokens > 60_000
    s = {r.doc_id: r for r in OPERATORS["suffix"](d, l).collect()}
    assert s[5].n_removed == len(LONG) and s[4].n_removed == 0 and s[1].n_bytes == 0
    j = {r.doc_id: r for r in OPERATORS["jaccard"](d, l).collect()}
    assert (j[1].n_shingles, j[1].component_id, j[3].component_id) == (0, 1, 3) and j[6].component_id == 5 and j[4].n_shingles == 1
    q = {r.doc_id: r for r in OPERATORS["quality"](d, l).collect()}
    assert q[1].base_failed and q[8].base_failed and not q[5].kept
    m = {r.doc_id: r for r in OPERATORS["media"](d, l).collect()}
    assert m[1].payload_bytes == 576 and m[1].payload_sha256 == m[2].payload_sha256 == hashlib.sha256(b"\xff" * 576).hexdigest() and m[5].media_sha256 == m[6].media_sha256
    p = {r.doc_id: r for r in OPERATORS["pii"](d, l).collect()}
    assert p[1].text is None and p[2].text == "" and (p[7].n_email, p[7].n_card) == (1, 1) and p[8].text == "word " * 60
    w = OPERATORS["lm"](d, l).where("doc_id = 1").first()
    assert (w.n_tokens, w.bits_difference) == (0, 0.0)
