"""BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Merges apply in rank order, so whether a token boundary stands depends on a bounded
number of bytes after it. That number follows from the merge list alone (see
``MergeList.lookahead``): the encoder keeps a window, merges inside it and emits every
token that ends at least that far before the window's end. A token boundary splits the
text into parts that merge independently, so the window may then start afresh there.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
from array import array
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame

from loamwork.llm.common import check_columns, kept, map_slices, texts_of

#: Fixed value: the pre-tokenizer's published pattern.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SPLIT = regex.compile(SPLIT)
_RUNS = tuple(regex.compile(p) for p in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))
#: Characters that may still change a match which ends before them.
_MARGIN = 4
#: Characters that enter the transducer together.
STEP = 65536
#: Pre-tokens whose ids a worker keeps, and the characters that they have at most.
MEMO_WORDS, WORD_CHARS = 200_000, 64
#: Characters of texts whose new pre-tokens are merged together.
TOGETHER = 1 << 20
#: Pre-tokens that are merged side by side, and the bytes that they have at most.
ROWS, ROW_BYTES = 4096, 64
_NONE, _ID = 1 << 60, (1 << 30) - 1
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeList:
    """Vocabulary and ranked merges, with the lookahead that they need."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text = {i: bytes(letters[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.text |= {i: s.encode() for s, i in self.special.items()}
        self.texts = [self.text.get(i, b"") for i in range(max(self.text) + 1)]
        self.byte = [vocab[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.rule = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.order = {pair: rank << 30 | new for pair, (rank, new) in self.rule.items()}
        self.lookahead = self._lookahead()
        self.byte_ids = np.array(self.byte, np.int64)
        pair = np.array(sorted(self.rule), np.int64).reshape(-1, 2)
        # the last key is above all pairs, so that a search always ends at one
        self.keys = np.append(pair[:, 0] << 32 | pair[:, 1], np.int64(1) << 62)
        self.orders = np.array([*(self.order[a, b] for a, b in pair.tolist()), _NONE], np.int64)
        self.first = self.order_of(np.repeat(self.byte_ids, 256), np.tile(self.byte_ids, 256)).reshape(256, 256)

    def order_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """rank << 30 | new id of each pair, _NONE where no rule merges it."""
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.orders[at], _NONE)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """merge() of many short pre-tokens, as little-endian uint32 bytes; words of like lengths take their steps side by side."""
        out = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        by_size = np.argsort(size, kind="stable")
        for k in range(0, len(words), ROWS):
            some = by_size[k : k + ROWS]
            ids, count = self._side_by_side([words[i] for i in some.tolist()], size[some])
            ends = np.cumsum(count)
            raw = ids[np.arange(ids.shape[1]) < count[:, None]].astype("<u4").tobytes()
            for i, a, b in zip(some.tolist(), (4 * (ends - count)).tolist(), (4 * ends).tolist(), strict=True):
                out[i] = raw[a:b]
        return out

    def _side_by_side(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, a row a word, and how many of a row count). A step merges one pair of every word that still has one, so rows get shorter together."""
        width = int(size.max())
        raw = np.frombuffer(b"".join([w.ljust(width, b"\0") for w in words]), np.uint8).reshape(-1, width)
        ids = self.byte_ids[raw]
        order = np.where(np.arange(1, width) < size[:, None], self.first[raw[:, :-1], raw[:, 1:]], _NONE)
        done, count, row = ids.copy(), size.copy(), np.arange(len(words))
        while width > 1:
            at = order.argmin(1)
            best = order[np.arange(len(row)), at]
            on = best != _NONE
            if not on.all():
                over = row[~on]
                done[over, :width] = ids[~on]
                row, ids, order, at, best = row[on], ids[on], order[on], at[on], best[on]
            if not len(row):
                return done, count
            width -= 1
            count[row] -= 1
            every, place = np.arange(len(row)), np.arange(width)
            new = best & _ID
            ids = np.where(place > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[every, at] = new
            if width > 1:
                order = np.where(place[:-1] >= at[:, None], order[:, 1:], order[:, :-1])
                has = np.flatnonzero(at > 0)
                order[has, at[has] - 1] = self.order_of(ids[has, at[has] - 1], new[has])
                has = np.flatnonzero(at + 1 < count[row])
                order[has, at[has]] = self.order_of(new[has], ids[has, at[has] + 1])
        done[row, :width] = ids
        return done, count

    def _lookahead(self) -> int:
        """Bytes after a token's end that can still decide whether it stands.

        reach[t] is that number for the merge which forms t, given only merges of lower
        rank. It is carried by a rival merge to the right (its right part, and what in
        turn decides it), by a rival to the left, or by the forming of either part.
        """
        reach: dict[int, int] = {}
        right: dict[int, int] = {}
        left: dict[int, int] = {}
        for (a, b), (_, ab) in self.rule.items():
            n = len(self.text[b])
            f = max(0, right.get(b, 0), left.get(a, 0) - n, reach.get(b, 0), reach.get(a, 0) - n)
            reach[ab] = max(f, reach.get(ab, 0))
            right[a] = max(right.get(a, 0), n + f)
            left[b] = max(left.get(b, 0), f)
        return max([1, *reach.values(), *right.values(), *left.values()])

    def merge(self, data: bytes) -> list[int]:
        """The ids of data as one pre-token: the lowest rank first, the leftmost of equals."""
        ids, rule = [self.byte[b] for b in data], self.rule
        if len(ids) > 24:
            return self._merge_long(ids)
        get = self.order.get
        ranks = [get(p, _NONE) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == _NONE:
                break
            i = ranks.index(best)
            ids[i : i + 2] = (new := best & _ID,)
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], new), _NONE)
            if i < len(ranks):
                ranks[i] = get((new, ids[i + 1]), _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        n, rule = len(ids), self.rule
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r[0], i, r[1], ids[i], ids[i + 1]) for i in range(n - 1) if (r := rule.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = new, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if r := rule.get((new, ids[after[j]])):
                    heapq.heappush(heap, (r[0], i, r[1], new, ids[after[j]]))
            if before[i] >= 0 and (r := rule.get((ids[before[i]], new))):
                heapq.heappush(heap, (r[0], before[i], r[1], ids[before[i]], new))
        return [x for x, keep in zip(ids, alive, strict=True) if keep]


class RunEncoder:
    """The transducer over one pre-token's bytes: emits ids once they are stable."""

    def __init__(self, merges: MergeList):
        self.merges, self.window, self.held = merges, max(2048, 4 * merges.lookahead), b""

    def feed(self, data: bytes) -> Iterator[int]:
        self.held += data
        at, held = 0, self.held
        while len(held) - at >= self.window:
            end = at + self.window
            limit = end - self.merges.lookahead
            for t in self.merges.merge(held[at:end]):
                n = len(self.merges.text[t])
                if at + n > limit:
                    break
                yield t
                at += n
        self.held = held[at:]

    def finish(self) -> Iterator[int]:
        held, self.held = self.held, b""
        yield from self.merges.merge(held)


class WordMemo(dict):
    """What the transducer emits for a pre-token, as little-endian uint32 bytes; bounded by starting afresh.

    Only pre-tokens of up to WORD_CHARS characters are kept.
    """

    def __init__(self, merges: MergeList, limit: int = MEMO_WORDS):
        super().__init__()
        self.merges, self.limit = merges, limit

    def learn(self, words: set[str]) -> None:
        """Merges the short ones of words that aren't known, all together: none fills a transducer's window."""
        new = words - self.keys()
        if len(self) + len(new) > self.limit:
            self.clear()
            new = words
        short = {w: raw for w in new if len(w) <= WORD_CHARS and len(raw := w.encode()) <= ROW_BYTES}
        self.update(zip(short, self.merges.merge_many(list(short.values())), strict=True))

    def ids(self, pieces: list[bytes | list[str]]) -> bytes:
        """The ids of pieces: ids already, or pre-tokens."""
        return b"".join([p if isinstance(p, bytes) else b"".join(map(self.__getitem__, p)) for p in pieces])

    def __missing__(self, word: str) -> bytes:
        run = RunEncoder(self.merges)
        ids = array("I", run.feed(word.encode()))
        ids.extend(run.finish())
        if len(word) <= WORD_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[word] = ids.tobytes()
        return ids.tobytes()


class StreamEncoder:
    """Encodes a text that arrives in parts; holds a bounded tail, however long a pre-token gets.

    feed and finish give the ids that have become stable, as little-endian uint32 bytes.
    """

    def __init__(self, merges: MergeList, hold: int = 4096, memo: WordMemo | None = None):
        self.merges, self.hold, self.tail = merges, hold, ""
        self.memo = WordMemo(merges) if memo is None else memo
        self.split = _SPLIT
        self.specials = regex.compile("|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True)))) if merges.special else None
        self.widest = max([0, *map(len, merges.special)])
        self.run, self.kind = None, None

    def feed(self, text: str) -> bytes:
        return self._ids(self.pieces(text, final=False))

    def finish(self, text: str = "") -> bytes:
        return self._ids(self.pieces(text, final=True))

    def _ids(self, pieces: list[bytes | list[str]]) -> bytes:
        self.memo.learn(pre_tokens(pieces))
        return self.memo.ids(pieces)

    def pieces(self, text: str, final: bool) -> list[bytes | list[str]]:
        """What has become stable with text: runs of pre-tokens, and ids of what isn't looked up."""
        self.tail += text
        out: list[bytes | list[str]] = []
        while self.specials and (m := self.specials.search(self.tail)):
            rest, self.tail = self.tail[m.end() :], self.tail[: m.start()]
            self._segment(len(self.tail), True, out)
            out.append(array("I", [self.merges.special[m[0]]]).tobytes())
            self.tail = rest
        self._segment(len(self.tail) if final else max(0, len(self.tail) - self.widest), final, out)
        return out

    def _segment(self, upto: int, final: bool, out: list[bytes | list[str]]) -> None:
        """Encodes tail[:upto]; unless final, what may still change stays."""
        head, keep = self.tail[:upto], self.tail[upto:]
        at = self._extend(head, 0, final, out) if self.run is not None else 0
        if self.run is None:
            words, end = self.split.findall(head, at), len(head)  # pre-tokens leave no gaps
            while words and not final and end > upto - _MARGIN:
                end -= len(words.pop())
            out.append(words)
            at = end
            if not final and len(head) - at > self.hold:
                lead = at + (head[at] == " " and not head[at + 1].isspace())
                self.kind = next(k for k in _RUNS if k.match(head, lead))
                self.run = RunEncoder(self.merges)
                self._emit(head[at:lead], out)
                at = self._extend(head, lead, final, out)
        self.tail = head[at:] + keep

    def _emit(self, text: str, out: list[bytes]) -> None:
        out.append(array("I", self.run.feed(text.encode())).tobytes())

    def _extend(self, head: str, at: int, final: bool, out: list[bytes]) -> int:
        m = self.kind.match(head, at)
        end = m.end() if m else at
        closed = final or end < len(head)
        if self.kind is _RUNS[3]:  # the last white character may belong to what follows
            end -= not final or end < len(head)
            end = max(at, end)
        self._emit(head[at:end], out)
        if closed:
            out.append(array("I", self.run.finish()).tobytes())
            self.run = self.kind = None
        return end


class TextDecoder:
    """Byte-to-text state machine: takes ids in parts and gives text as soon as characters are whole."""

    def __init__(self, merges: MergeList):
        self.bytes_of, self.state = merges.texts.__getitem__, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: list[int]) -> str:
        return self.state.decode(b"".join(map(self.bytes_of, ids)))

    def finish(self) -> str:
        return self.state.decode(b"", True)


def stream(merges: MergeList, text: str, memo: WordMemo | None = None, step: int = STEP) -> Iterator[bytes]:
    """The ids of a text, block after block, as little-endian uint32 bytes."""
    encoder = StreamEncoder(merges, memo=memo)
    for at in range(0, max(1, len(text)), step):
        yield encoder.finish(text[at:]) if at + step >= len(text) else encoder.feed(text[at : at + step])


def pre_tokens(pieces: list[bytes | list[str]]) -> set[str]:
    """The different pre-tokens of pieces."""
    return set().union(*(p for p in pieces if isinstance(p, list)))


def streams(merges: MergeList, texts: list[str], memo: WordMemo, step: int = STEP) -> Iterator[Iterator[bytes]]:
    """stream() of each text in turn; texts of one block have their new pre-tokens merged together, about TOGETHER characters at a time."""
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= TOGETHER):
            size += len(texts[upto])
            upto += 1
        some = texts[at:upto]
        pieces = [StreamEncoder(merges, memo=memo).pieces(t, final=True) if len(t) <= step else None for t in some]
        memo.learn(set().union(*map(pre_tokens, filter(None, pieces))))
        for text, known in zip(some, pieces, strict=True):
            yield stream(merges, text, memo, step) if known is None else iter([memo.ids(known)])
        at = upto


def encode_text(merges: MergeList, text: str, step: int = STEP) -> list[int]:
    """All ids of one text, streamed."""
    return np.frombuffer(b"".join(stream(merges, text, step=step)), "<u4").tolist()


def encode_decode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encodes each whole text, decodes the ids again and returns counts and digests of both.

    A text goes through the transducer, its ids into the digest and the decoder, block by
    block: neither all ids nor the decoded text of a document are ever held. A null or
    empty text has no ids and digests of the empty string. Rows are handled one by one, so
    repeated rows and ids give repeated results; other columns are ignored.
    """
    check_columns(docs, "doc_id", "text")
    key = ("bpe", tokenizer_path)

    def make():
        merges, memo = kept(key, lambda: (m := MergeList(tokenizer_path), WordMemo(m)))
        decimal = np.array([b",%d" % i for i in range(len(merges.texts))])  # padded with zero bytes

        def one(blocks: Iterator[bytes]) -> tuple[int, str, str]:
            n, a, b, decoder = 0, hashlib.sha256(), hashlib.sha256(), TextDecoder(merges)
            for packed in blocks:
                if packed:
                    ids = np.frombuffer(packed, "<u4")
                    joined = decimal[ids].tobytes().translate(None, b"\0")
                    a.update(joined if n else memoryview(joined)[1:])
                    b.update(decoder.feed(ids.tolist()).encode())
                    n += len(ids)
            b.update(decoder.finish().encode())
            return n, a.hexdigest(), b.hexdigest()

        def apply(part):
            n, ids_sha, text_sha = zip(*map(one, streams(merges, texts_of(part), memo)), strict=True) if part.num_rows else ((),) * 3
            return {"doc_id": part.column("doc_id"), "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

        return apply

    return map_slices(docs.select("doc_id", "text"), make, SCHEMA, key=key)
