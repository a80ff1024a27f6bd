"""Bounded-space online best-fit packing of documents into fixed-size sequences.

Pieces are placed as they stream by, in the task that tokenises them: nothing is
shuffled. A fixed number of bins stays open. A bitset over free space finds the
tightest bin that fits; when all bins are in use and none fits, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loamwork.llm.common import check_columns, kept, map_slices, texts_of
from loamwork.llm.tokenize import TOGETHER, BlankMemo, LibraryEncoder

CAPACITY = 2048
OPEN_BINS = 1024
SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class BestFit:
    """Open bins by free space. levels has bit f set while a bin with f free places is open."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, first_bin: int = 0):
        self.capacity, self.open_bins, self.next_bin = capacity, open_bins, first_bin
        self.levels, self.count = 0, 0
        self.bins: dict[int, list[int]] = {}

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        bin_id = stack.pop()
        if not stack:
            self.levels ^= 1 << free
        self.count -= 1
        return bin_id

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of that size; 1 <= size <= capacity."""
        if not 1 <= size <= self.capacity:
            raise ValueError(f"a piece has {size} ids; bins hold {self.capacity}")
        fits = self.levels >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.next_bin
            self.next_bin += 1
        left = free - size
        if left:
            if self.count == self.open_bins:  # the fullest closes first
                self._take((self.levels & -self.levels).bit_length() - 1)
            self.bins.setdefault(left, []).append(bin_id)
            self.levels |= 1 << left
            self.count += 1
        return bin_id, self.capacity - free


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0, encoder: Callable[[str], Callable] = LibraryEncoder) -> DataFrame:
    """Packs the ids of all documents, each followed by end_id, into sequences of at most capacity ids.

    Only longer documents are cut, into pieces of capacity ids. A null or empty text is
    one piece that holds end_id alone. Repeated rows are packed once each; other columns
    are ignored; an empty table gives no rows. Sequence ids number bins within a task.
    The pieces of up to TOGETHER documents at a time are placed longest first, of equal
    ones in the order they came; of bins that fit equally well the last one used is taken.
    """
    check_columns(docs, "doc_id", "text")

    key = ("blank", tokenizer_path, encoder)

    def make():
        memo = kept(key, lambda: BlankMemo(encoder(tokenizer_path)))
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        end = np.uint32(end_id).tobytes()
        width = 4 * capacity

        def apply(part):
            rows = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), memo.encode(texts_of(part)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    piece = ids[at : at + width]
                    rows.append((len(piece) // 4, doc, k, at // 4, zlib.crc32(piece)))
            rows.sort(key=lambda r: -r[0])
            placed = [bins.place(r[0]) for r in rows]
            size, doc, piece, start, crc = zip(*rows, strict=True) if rows else ((),) * 5
            return {"doc_id": doc, "piece": piece, "start": start, "length": size, "ids_crc32": crc, "sequence_id": [p[0] for p in placed], "offset": [p[1] for p in placed]}

        return apply

    return map_slices(docs.select("doc_id", "text"), make, SCHEMA, TOGETHER, key)
