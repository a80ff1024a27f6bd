"""SentencePiece encoding and decoding for vocabularies of scored merges.

A text's symbols start as its characters. An agenda holds the adjacent pairs whose join is
a piece, the best score first and the leftmost of equals; taking a pair from it joins two
symbols and enters the pairs with the new neighbours. What is left are pieces; a character
that is none becomes its UTF-8 bytes.

Pieces say where a text falls apart: if no piece has a blank's mark after another
character, nothing joins across such a place, so the parts between are encoded alone and
those that recur come from a bounded memo. The parts that an Arrow slice brings anew are
encoded by the sentencepiece library too, in one call, and must come out alike.
"""

from __future__ import annotations

import codecs
import heapq
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loamwork.llm.common import check_columns, kept, map_slices, texts_of

#: Stands for a blank inside pieces.
MARK = "▁"
#: Parts whose ids a worker keeps, and the characters that they have at most.
MEMO_PARTS, PART_CHARS = 800_000, 64
#: Parts of up to so many characters have their agenda in a list by place, others in a heap.
SHORT = 24
#: Characters that are encoded, decoded and checked together.
STEP = 65536
#: Normalised by the library and by us when a model is opened; they must agree.
_PROBE = ("", " ", "  a  b ", "a\tb\n\nc", "　ﬁ Å", MARK)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_byte_tokens long"

_NEVER = float("inf")
codecs.register_error("every_byte", lambda e: ("�" * (e.end - e.start), e.end))


class PieceModel:
    """The pieces of a model file, their scores, and the library that reads the file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.control = control = {i for i in range(n) if lib.is_control(i)}
        self.bos, self.eos, unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.byte_of = {i: int(names[i][3:5], 16) for i in range(n) if lib.is_byte(i)}
        if len(self.byte_of) != 256 or self.bos < 0 or self.eos < 0 or any(lib.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: needs all byte pieces, begin and end ids, and no unused pieces")
        normal = [i for i in range(n) if i not in control and i not in self.byte_of and i != unknown]
        self.piece = {names[i]: i for i in normal}
        self.cost = {names[i]: -lib.get_score(i) for i in normal}
        self.byte_id = [i for i, _ in sorted(self.byte_of.items(), key=lambda x: x[1])]
        self.bytes_of = [names[i].encode() for i in range(n)]
        for i in control:
            self.bytes_of[i] = b""
        for i, b in self.byte_of.items():
            self.bytes_of[i] = bytes([b])
        self.bytes_of[unknown] = lib.decode([unknown]).encode()
        self.parts = self._parts().findall
        if any(lib.normalize(x) != self.normal(x) for x in _PROBE):
            raise ValueError(f"{path}: only models that change nothing but blanks are known")

    def _parts(self) -> re.Pattern:
        """What finds the parts of a text: neighbours that occur in no piece stand in different ones.

        There is a cut before each mark that follows another character; and, if the pieces
        allow it, on both sides of a line end and between a letter or digit and a stop.
        """
        near = {p[i : i + 2] for p in self.piece for i in range(len(p) - 1)}
        if any(y == MARK != x for x, y in near):
            return re.compile("(?s:.+)")
        if any("\n" in pair for pair in near):
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        stops = "".join(y for y in ".,;:!?" if not any(p[0].isalnum() and p[1] == y for p in near))
        word, stop = f"{MARK}*[^\\W_]+(?=[{stops}\\n{MARK}]|\\Z)", f"[{stops}][^{MARK}\\n]*"
        return re.compile(f"{word}|\\n|{stop}|{MARK}*[^{MARK}\\n]+|{MARK}+" if stops else f"\\n|{MARK}*[^{MARK}\\n]+|{MARK}+")

    @staticmethod
    def normal(text: str) -> str:
        """The text with marks for blanks and one before it."""
        return (MARK + text).replace(" ", MARK) if text else ""

    def merge(self, part: str) -> list[int]:
        """The ids of a part by the agenda."""
        symbols = self._short(part) if len(part) <= SHORT else self._long(part)
        out: list[int] = []
        for s in symbols:
            known = self.piece.get(s)
            if known is not None:
                out.append(known)
            else:
                out += [self.byte_id[b] for b in s.encode()]
        return out

    def _short(self, part: str) -> list[str]:
        """The symbols in the end; the agenda is a list with the score of each symbol and its right neighbour."""
        cost = self.cost.get
        symbols = list(part)
        agenda = [cost(a + b, _NEVER) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := min(agenda)) < _NEVER:
            i = agenda.index(best)
            joined = symbols[i] = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + joined, _NEVER)
            if i < len(agenda):
                agenda[i] = cost(joined + symbols[i + 1], _NEVER)
        return symbols

    def _long(self, part: str) -> list[str]:
        """The symbols in the end. Joined symbols stay at the left one's place; right and left lead to the neighbours.

        An entry of the agenda is stale if either symbol has changed since: then their
        lengths don't add up to the entry's.
        """
        cost = self.cost.get
        symbols: list[str] = list(part)
        n = len(symbols)
        right, left = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        agenda = [(c, i, 2) for i in range(n - 1) if (c := cost(part[i : i + 2])) is not None]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = right[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j], right[i] = "", right[j]
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (c := cost(joined := symbols[a] + symbols[b])) is not None:
                    heapq.heappush(agenda, (c, a, len(joined)))
        return [s for s in symbols if s]


class PartMemo(dict):
    """Ids of parts as little-endian uint32 bytes; bounded by starting afresh. Parts over PART_CHARS characters aren't kept."""

    def __init__(self, model: PieceModel, limit: int = MEMO_PARTS):
        super().__init__()
        self.model, self.limit = model, limit
        self.new: list[tuple[str, bytes]] = []
        self.lead = array("I", [*model.merge(MARK), *model.merge("\n")]).tobytes()

    def __missing__(self, part: str) -> bytes:
        ids = array("I", self.model.merge(part)).tobytes()
        if len(part) <= PART_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        self.new.append((part, ids))
        return ids

    def check(self) -> None:
        """Has the library encode the parts that came since the last call. One without a mark before it stands after a line end, which joins with nothing."""
        new, self.new = self.new, []
        theirs = self.model.library.encode([p[1:] if p[0] == MARK else "\n" + p for p, _ in new], num_threads=1)
        for (part, ids), x in zip(new, theirs, strict=True):
            if array("I", x).tobytes() != (ids if part[0] == MARK else self.lead + ids) and part != MARK:
                raise ValueError(f"{part!r}: {np.frombuffer(ids, '<u4').tolist()} differ from the sentencepiece library's {x}")


def blocks(text: str, step: int = STEP) -> Iterator[str]:
    """A text in blocks of about step characters, cut at a blank between two other characters that aren't blanks.

    The blank itself goes: the mark before every block's start takes its place.
    """
    at = 0
    while len(text) - at > step:
        cut = at + step
        while (cut := text.find(" ", cut)) >= 0 and not (cut + 1 < len(text) and text[cut - 1] not in (" ", MARK) and text[cut + 1] not in (" ", MARK)):
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def encode(model: PieceModel, text: str, memo: PartMemo | None = None, step: int = STEP) -> Iterator[bytes]:
    """A text's ids without begin and end, block after block, as little-endian uint32 bytes."""
    memo = PartMemo(model) if memo is None else memo
    for block in blocks(text, step):
        yield b"".join(map(memo.__getitem__, model.parts(model.normal(block))))


class PieceDecoder:
    """Ids to text, in parts: bytes wait until their character is whole, a byte that belongs to none becomes U+FFFD.

    The mark that encoding put before the text goes again.
    """

    def __init__(self, model: PieceModel):
        self.control, self.bytes_of, self.state, self.begun = model.control, model.bytes_of.__getitem__, codecs.getincrementaldecoder("utf-8")("every_byte"), False

    def feed(self, ids: list[int], final: bool = False) -> str:
        if self.control.isdisjoint(ids):
            text = self.state.decode(b"".join(map(self.bytes_of, ids)), final)
        else:  # bytes on its two sides don't make a character together
            text = "".join(self.state.decode(self.bytes_of(i), i in self.control) for i in ids) + self.state.decode(b"", final)
        if text and not self.begun:
            self.begun, text = True, text.removeprefix(MARK)
        return text.replace(MARK, " ")


def encode_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """Encodes each whole text between begin and end ids, decodes the ids and returns counts and digests of both.

    ids_sha256 is of the ids as little-endian uint32; n_byte_tokens counts ids of lone
    bytes. A part that comes out otherwise than the library's is an error. A null or empty text has the
    begin and end ids only. Rows are handled one by one, so repeated rows and ids give
    repeated results; other columns are ignored; an empty table gives no rows. Texts pass
    in blocks of STEP characters cut at blanks; a run without any blank is one block, and
    its memory grows with its length (about 0.3 KB a character).
    """
    check_columns(docs, "doc_id", "text")
    key = ("pieces", model_path)

    def make():
        model, memo = kept(key, lambda: (m := PieceModel(model_path), PartMemo(m)))
        edge = {i: np.array([i], "<u4").tobytes() for i in (model.bos, model.eos)}
        is_byte = np.zeros(len(model.bytes_of), bool)
        is_byte[list(model.byte_of)] = True

        def one(text: str) -> tuple[int, str, str, int]:
            ids_sha, text_sha, decoder, n, n_bytes = sha256(edge[model.bos]), sha256(), PieceDecoder(model), 2, 0
            for packed in encode(model, text, memo):
                ids = np.frombuffer(packed, "<u4")
                ids_sha.update(packed)
                text_sha.update(decoder.feed(ids.tolist()).encode())
                n += len(ids)
                n_bytes += int(is_byte[ids].sum())
            ids_sha.update(edge[model.eos])
            text_sha.update(decoder.feed([], True).encode())
            return n, ids_sha.hexdigest(), text_sha.hexdigest(), n_bytes

        def apply(part: pa.RecordBatch) -> dict:
            n, ids_sha, text_sha, n_bytes = zip(*map(one, texts_of(part)), strict=True) if part.num_rows else ((),) * 4
            memo.check()
            return {"doc_id": part.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha, "n_byte_tokens": n_bytes}

        return apply

    return map_slices(docs.select("doc_id", "text"), make, SCHEMA, key=key)
