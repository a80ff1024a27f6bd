"""Whole-text tokenising with a bounded memo of text chunks.

A text is cut only where every pre-tokenizer in use has a boundary anyway: before a
blank that a non-white character follows, and around a line end between non-white
characters. Chunks repeat a lot, so each worker keeps
their ids as little-endian uint32 bytes and looks most of them up.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are tokenised together: the more, the fewer different chunks to look up.
TOGETHER = 2048
#: Chunks kept by a worker before its memo starts afresh.
MEMO_CHUNKS = 500_000
#: Plain words kept by a worker's encoder besides.
MEMO_WORDS = 250_000
#: Longer chunks are encoded each time and never kept.
MEMO_CHARS = 64
#: Characters that are split and put together at once.
BATCH_CHARS = 4 << 20
#: Marks a key that stands at the start of a text or line.
FIRST = "\0"
_LINE_END = f" \n {FIRST}"
#: A full stop or comma that ends a chunk, right after a letter or number: a pre-token of its own.
_MARK = re.compile(r"([.,])(?<=[^\W_].)(?=[ \n])")
_CUT_MARK = rf" {FIRST}\1"
_OTHER_WHITE = re.compile(r"[^\S \n]")
_BOUNDARY = re.compile(r"(?= \S)")


def plain(text: str) -> bool:
    """Is every white character a lone blank or line end, and the last one no blank?"""
    return not ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1:] == " " or _OTHER_WHITE.search(text))


class _Memo:
    """ids of chunks as little-endian uint32 bytes, by key; encode_many maps chunks to such bytes.

    Arrow splits texts into keys and numbers the different ones; only those are looked up,
    and numpy puts every text's ids together.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[bytes]], limit: int = MEMO_CHUNKS):
        self.encode_many, self.limit = encode_many, limit
        self.memo: dict[str, bytes] = {}

    def _chunks(self, keys: list[str]) -> list[str]:
        """The texts that keys stand for."""
        return keys

    def _known(self, keys: list[str]) -> list[bytes]:
        if len(self.memo) > self.limit:
            self.memo = {}
        memo = self.memo
        found = list(map(memo.get, keys))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = [keys[i] for i in missing]
            made = self.encode_many(self._chunks(new))
            for i, ids in zip(missing, made, strict=True):
                found[i] = ids
            memo.update(zip(new, made, strict=True) if max(map(len, new)) <= MEMO_CHARS else ((k, x) for k, x in zip(new, made, strict=True) if len(k) <= MEMO_CHARS))
        return found

    def _joined(self, prepared: list[str]) -> list[bytes]:
        """The ids of texts whose keys stand between blanks."""
        out: list[bytes] = []
        at = 0
        while at < len(prepared):
            upto, size = at, 0
            while upto < len(prepared) and (upto == at or size + len(prepared[upto]) <= BATCH_CHARS):
                size += len(prepared[upto])
                upto += 1
            parts = pc.split_pattern(pa.array(prepared[at:upto], pa.large_string()), " ")
            words = pc.list_flatten(parts).dictionary_encode()
            ids = self._known(words.dictionary.to_pylist())
            flat = np.frombuffer(b"".join(ids), "<u4")
            size_of = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            begin_of = np.cumsum(size_of) - size_of
            which = words.indices.to_numpy()
            sizes = size_of[which]
            ends = np.cumsum(sizes)
            narrow = np.int32 if max(len(flat), int(sizes.sum())) < 1 << 31 else np.int64
            where = np.repeat((begin_of[which] - (ends - sizes)).astype(narrow), sizes)
            where += np.arange(len(where), dtype=narrow)
            raw = memoryview(flat[where].tobytes())
            bounds = np.append(0, ends)[np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy()))] * 4
            out += [bytes(raw[x:y]) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            at = upto
        return out


class ChunkMemo(_Memo):
    """For tokenizers that keep white space. A key is a chunk after a blank, or one without, at a line's start or a mark, with FIRST before it."""

    def _chunks(self, keys: list[str]) -> list[str]:
        return [k[1:] if k[:1] == FIRST else k if k == "\n" else " " + k for k in keys]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        fine = [i for i, t in enumerate(texts) if plain(t) and FIRST not in t]
        out: list[bytes] = [b""] * len(texts)
        for i, ids in zip(fine, self._joined([FIRST + _MARK.sub(_CUT_MARK, texts[i]).replace("\n", _LINE_END) for i in fine]), strict=True):
            out[i] = ids
        for i in sorted(set(range(len(texts))) - set(fine)):
            chunks = _BOUNDARY.split(texts[i])
            out[i] = b"".join(self._known([FIRST + c for c in chunks]))
        return out


class BlankMemo(_Memo):
    """For tokenizers that drop white space: chunks between blanks or line ends stand alone."""

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        return self._joined([t.replace("\n", " ") for t in texts])


class LibraryEncoder:
    """encode_many of the tokenizers library: chunks to ids as bytes, four an id.

    No truncation, padding or added special tokens. New words go to the library many at a
    time, since its ids show where each word begins or ends. Where tokens keep their blank,
    so do whole chunks; else a chunk that is one word, maybe with a full stop or comma, is
    put together from its parts.
    """

    def __init__(self, path: str, words: int = MEMO_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.suffix = next((s for s in ("</w>",) if f"a{s}" in vocab), "")
        self.lead = "" if self.suffix else " "
        edge = np.zeros(max(vocab.values()) + 1, bool)
        edge[[i for s, i in vocab.items() if (s.endswith(self.suffix) if self.suffix else s.startswith("\u0120"))]] = True
        self.edge, self.limit, self.words = edge, words, {}
        self.tails = {t: self._library([t])[0] for t in ".,"}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.line = np.frombuffer(self._library(["\n"])[0], "<u4")

    def _library(self, chunks: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _learn(self, words: list[str], step: int = 4096) -> None:
        """Encodes plain words, all in one text; self.edge tells them apart again."""
        for k in range(0, len(words), step):
            some = words[k : k + step]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.edge[ids]) + 1
            if len(ends) != len(some):  # a word that isn't one word to the library
                self.words.update(zip(some, self._library(some), strict=True))
                continue
            raw, begin = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist(), strict=True):
                self.words[word] = raw[begin:end]
                begin = end

    def _together(self, chunks: list[str], between: str, step: int = 1024) -> list[bytes]:
        """Chunks that are each a blank and printable characters (between is empty), or such characters alone (a line end), many in one text."""
        out: list[bytes] = []
        for k in range(0, len(chunks), step):
            some = chunks[k : k + step]
            text = between.join(some)
            if any(t in text for t in self.added):
                out += self._library(some)
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            if between:  # a line end is a token of its own
                stop = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
                start = np.append(0, stop[:-1] + 1)
            else:
                start = np.flatnonzero(self.edge[ids])
                stop = np.append(start[1:], len(ids))
            if len(start) != len(some):  # a chunk that the library cuts or joins
                out += self._library(some)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip((4 * start).tolist(), (4 * stop).tolist(), strict=True)]
        return out

    def _kept_blanks(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks that keep their blank; printable characters include no white one but the blank."""
        out: list[bytes] = [b""] * len(chunks)
        blanks = [c.rfind(" ") if c.isprintable() else 1 for c in chunks]
        led = [i for i, at in enumerate(blanks) if at == 0]
        bare = [i for i, at in enumerate(blanks) if at < 0 and chunks[i]] if len(self.line) == 1 else []
        for which, between in ((led, ""), (bare, "\n")):
            for i, ids in zip(which, self._together([chunks[i] for i in which], between), strict=True):
                out[i] = ids
        known = {*led, *bare}
        rest = [i for i in range(len(chunks)) if i not in known]
        for i, ids in zip(rest, self._library([chunks[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def __call__(self, chunks: list[str]) -> list[bytes]:
        if self.lead:
            return self._kept_blanks(chunks)
        if len(self.words) > self.limit:
            self.words = {}
        words = self.words
        cores = [w.lower() if w.isascii() else w for w in chunks]
        # plain words at once; then those with one tail mark; the library has the rest
        plain = {w for w in cores if w.isalpha()}
        marked = {w: (w[:-1], w[-1]) for w in cores if w[-1:] in self.tails and w[:-1].isalpha()}
        plain.update(w for w, _ in marked.values())
        self._learn(list(plain - words.keys()))
        marks = {w: words[core] + self.tails[tail] for w, (core, tail) in marked.items()}
        known = [words.get(w) or marks.get(w) for w in cores]
        odd = [i for i, ids in enumerate(known) if ids is None]
        for i, ids in zip(odd, self._library([chunks[i] for i in odd]), strict=True):
            known[i] = ids
        return known
