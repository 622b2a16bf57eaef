"""Packing token sequences by minimum bin slack.

Each document is encoded and cut: whole sequences go out as they are, the rest of fewer than `capacity` tokens waits in
a window. For each sequence the longest waiting rest is laid in, and a subset-sum dynamic program over the bits of an
integer finds the multiset of the other waiting lengths that comes closest to filling it; the counts by length are read
back from the program's steps. What little is missing is cut from another rest. What is left at a partition's end
is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.common import batches, column, rows_of, tidy, tune
from pointlake.llm.token_cache import REMEMBERED, forget, library_encoder

CAPACITY = 2048
#: Rests that wait at a time: enough for an exact filling almost always, few enough that a step of the program is short.
WINDOW = 128

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """From lengths with their counts, the counts of a multiset of the greatest sum up to capacity.

    Bit s of an integer says that sum s can be reached; a length is taken in powers of two of its count, and steps are
    walked back to find how often each is in the sum."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length if length else 0), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    at, found = reach.bit_length() - 1, defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            found[length] += take
            at -= length * take
    return dict(found)


class Packer:
    """Takes documents' ids and gives pieces; sequence ids count up from `first`."""

    def __init__(self, first: int, capacity: int = CAPACITY, window: int = WINDOW):
        self.sequence, self.capacity, self.window = first, capacity, window
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.number, self.out = 0, {f.name: [] for f in PIECE}

    def _lay(self, piece: tuple, offset: int) -> int:
        doc, start, ids, whole = piece
        row = (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), whole, self.sequence, offset)
        for name, value in zip(self.out, row, strict=True):
            self.out[name].append(value)
        return offset + len(ids)

    def _take(self, length: int) -> tuple:
        self.number -= 1
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        return piece

    def _wait(self, piece: tuple) -> None:
        if len(piece[2]):
            self.waiting[len(piece[2])].append(piece)
            self.number += 1

    @staticmethod
    def _cut(piece: tuple, length: int) -> tuple[tuple, tuple]:
        doc, start, ids, whole = piece
        return (doc, start, ids[:length], whole), (doc, start + length, ids[length:], whole)

    def _fill(self) -> None:
        """One sequence of exactly the capacity, from rests that together hold as much."""
        at = self._lay(self._take(max(self.waiting)), 0)
        if at < self.capacity:
            found = fullest({k: len(v) for k, v in self.waiting.items()}, self.capacity - at)
            for length, times in found.items():
                for _ in range(times):
                    at = self._lay(self._take(length), at)
        while at < self.capacity:
            head, tail = self._cut(self._take(max(self.waiting)), self.capacity - at)
            at = self._lay(head, at)
            self._wait(tail)
        self.sequence += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        whole = len(ids)
        for start in range(0, whole - self.capacity + 1, self.capacity):
            self._lay((doc, start, ids[start : start + self.capacity], whole), 0)
            self.sequence += 1
        start = whole - whole % self.capacity
        self._wait((doc, start, ids[start:].copy(), whole))
        while self.number >= self.window:
            if self._held() < self.capacity:
                break
            self._fill()

    def _held(self) -> int:
        return sum(k * len(v) for k, v in self.waiting.items())

    def end(self) -> None:
        while (held := self._held()) >= self.capacity:
            self._fill()
        while held:
            room = 1 << held.bit_length() - 1
            held -= room
            at = 0
            while at < room:
                piece = self._take(max(self.waiting))
                if len(piece[2]) > room - at:
                    piece, tail = self._cut(piece, room - at)
                    self._wait(tail)
                at = self._lay(piece, at)
            self.sequence += 1

    def taken(self) -> pa.RecordBatch:
        out, self.out = batches(self.out, PIECE), {f.name: [] for f in PIECE}
        return out


def pack(docs: DataFrame, file: str, end_id: int = 1, capacity: int = CAPACITY, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED, keep: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are encoded by the tokenizers file, with end_id after each; null and empty texts are that id alone.
    Every partition packs its own rows, so nothing is shuffled; a sequence's id holds the partition's number in its
    upper bits. remembered: pieces of text a worker keeps encoded; keep: for its next task
    too, so that a worker that waits holds them as well. Repeated rows are packed as often, a null id stays null; other columns of docs don't matter."""
    tune(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = library_encoder(file, remembered)
        end = np.array([end_id], kind).tobytes()
        packer = Packer(TaskContext.get().partitionId() << 40, capacity, window)
        for b in rows_of(it):
            for doc, ids in zip(column(b, "doc_id").to_pylist(), encoder.encode_column(column(b, "text")), strict=True):
                packer.add(doc, np.frombuffer(ids + end, kind))
            yield packer.taken()
        packer.end()
        yield packer.taken()
        if not keep:
            del encoder
            forget(file)
        tidy()

    kinds = ", ".join(f"`{f.name}` long" for f in PIECE)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, kinds)
