"""New words of many texts are encoded together, with the ids that each has alone."""

import random

import numpy as np
import public_tokenizers
import pytest

from loamwork.llm import bpe


@pytest.fixture(scope="module")
def merges():
    return bpe.MergeList(public_tokenizers.path("byte_bpe_50k.json"))


def _texts(n):
    rnd = random.Random(3)
    letters = ["abcdefghijklmnopqrstuvwxyz", "äöüßéèçñ", "日本語中文字", "0123456789", ".,!?-'<>", "aaaaab", "\x00\x01"]
    word = lambda: "".join(rnd.choice(rnd.choice(letters)) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 30, 70])))
    return [rnd.choice([" ", "\n", "  "]).join(word() for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_words_merged_together_get_the_ids_that_each_has_alone(merges):
    words = [w.encode() for t in _texts(80) for w in bpe._SPLIT.findall(t)] + [b"ab" * 60, "ä".encode() * 40]
    assert len(words) > 2 * bpe.ROWS
    assert [np.frombuffer(x, "<u4").tolist() for x in merges.merge_many(words)] == [merges.merge(w) for w in words]
    assert merges.merge_many([]) == [] and merges.merge_many([b"a"]) == [np.array(merges.merge(b"a"), "<u4").tobytes()]


def test_short_words_of_texts_are_never_merged_one_by_one(merges, monkeypatch):
    """F op1: a word a merge in Python took most of the time."""
    texts = [*_texts(200), "x" * 10, "ab cd " * 40]
    want = [bpe.encode_text(merges, t) for t in texts]
    alone = []
    monkeypatch.setattr(bpe.MergeList, "merge", lambda self, data, f=bpe.MergeList.merge: alone.append(data) or f(self, data))
    memo = bpe.WordMemo(merges, 500)
    for step in (bpe.STEP, 150):
        got = [np.frombuffer(b"".join(blocks), "<u4").tolist() for blocks in bpe.streams(merges, texts, memo, step)]
        assert got == want
        if step == bpe.STEP:
            assert not [w for w in alone if len(w) <= bpe.ROW_BYTES]


@pytest.mark.parametrize("words", [1, 100_000])
def test_chunks_sent_together_get_the_librarys_ids(words):
    from tokenizers import Tokenizer

    from loamwork.llm import tokenize

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    odd = ["", " ", ".", ". start", "a.", "a. b", "a.\nb", "a...\nb.. c, d", "end?. next", "a . b , c", "x.y, z", "² . ³. ¼, x", "_. a_, b", "'s. it's, ok", "\n. a", "one <|endoftext|> two. <|endoftext|>\nthree",
           "a᠎. b᠎\nc ᠎d", "a . b", "a\x1c. b", "日本. 中文, 字。 x", "\x00. a\x00, b", "a.  b", "a. ", ".\n,\n.", "́. é, x", "﻿. a ​, b", "\U0001f600. x \U0001f600, y"]
    texts = odd + _texts(150) + [". ".join(odd), ",\n".join(odd)]
    memo = tokenize.ChunkMemo(tokenize.LibraryEncoder(path, words), 300)
    got = [np.frombuffer(x, "<u4").tolist() for x in memo.encode(texts)]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [memo.encode([t]) for t in odd] == [[x] for x in memo.encode(odd)]


def test_a_word_with_a_mark_is_no_new_chunk():
    """F op3: a word went to the memo, and to the library where it was new, once a mark behind it."""
    from loamwork.llm import tokenize

    seen = []
    encoder = tokenize.LibraryEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    memo = tokenize.ChunkMemo(lambda chunks: seen.extend(chunks) or encoder(chunks))
    memo.encode(["so it goes. so it goes, so it\ngoes. it goes"])
    assert sorted(seen) == sorted(["so", " so", " it", "goes", " goes", ".", ",", "\n"])
