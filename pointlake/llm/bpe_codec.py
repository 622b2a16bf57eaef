"""Byte-level BPE encoding and decoding by ranks, with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary's byte strings resolves a pre-token that is a token as a whole;
the token found is compared byte by byte. Tier two: other pre-tokens start as linked single bytes, a heap holds the
ranks of neighbouring pairs, and the least is merged until none is left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.bytetext import prefix_sums, span_hash
from pointlake.llm.common import batches, column, rows_of, texts, tune
from pointlake.llm.mphf import MinimalPerfectHash
from pointlake.llm.token_cache import PieceEncoder, byte_level_parts


def read_ranks(file: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank a line."""
    with open(file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _hashes(strings: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))
    start = np.concatenate([[0], end[:-1]]).astype(np.int64)
    return span_hash(prefix_sums(data, fold=False), start, end)


class Vocabulary:
    """Tokens by rank, with the minimal perfect hash over their bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.kind = np.dtype("<u2" if max(ranks.values()) < 1 << 16 else "<u4")
        tokens = list(ranks)
        keys = _hashes(tokens)
        self.mph = MinimalPerfectHash.build(keys)
        self.slots: list[bytes] = [b""] * len(tokens)
        for slot, token in zip(self.mph.lookup(keys).tolist(), tokens, strict=True):
            self.slots[slot] = token
        self.by_id = {rank: token for token, rank in ranks.items()}

    def whole(self, words: list[bytes]) -> list[int | None]:
        """The rank of each word that is a token."""
        slots = self.mph.lookup(_hashes(words)).tolist() if words else []
        return [self.ranks[w] if s >= 0 and self.slots[s] == w else None for w, s in zip(words, slots, strict=True)]

    def merge(self, word: bytes) -> list[int]:
        """Ranks of a word that isn't a token: lowest pair first, of equal ones the leftmost."""
        ranks, n = self.ranks, len(word)
        part = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair: list[int | None] = [ranks.get(word[i : i + 2]) for i in range(n - 1)] + [None]
        heap = [(rank, i) for i, rank in enumerate(pair) if rank is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            if pair[i] != rank:
                continue
            j = after[i]
            part[i] += part[j]
            part[j], pair[j] = b"", None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                pair[i] = ranks.get(part[i] + part[k])
                if pair[i] is not None:
                    heappush(heap, (pair[i], i))
            else:
                pair[i] = None
            h = before[i]
            if h >= 0:
                pair[h] = ranks.get(part[h] + part[i])
                if pair[h] is not None:
                    heappush(heap, (pair[h], h))
        return [ranks[p] for p in part if p]

    def encode_many(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        found = self.whole(raw)
        return [np.array(self.merge(w) if rank is None else [rank], self.kind).tobytes() for w, rank in zip(raw, found, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.tolist()))


_open: dict[str, tuple[Vocabulary, PieceEncoder]] = {}


def codec(file: str) -> tuple[Vocabulary, PieceEncoder]:
    """The vocabulary of a rank file and an encoder with the byte-level pre-token pattern; kept by a worker."""
    if file not in _open:
        vocabulary = Vocabulary(read_ranks(file))
        _open[file] = vocabulary, PieceEncoder(byte_level_parts, vocabulary.encode_many)
    return _open[file]


def encode(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): each row's ids as little-endian unsigned 32-bit integers, without special tokens. A null text
    counts as empty and has no ids; repeated rows and null ids come back as they are."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = codec(file)
        for b in rows_of(it):
            ids = [np.frombuffer(x, vocabulary.kind).astype("<u4").tobytes() for x in encoder.encode(texts(b))]
            yield batches({"doc_id": column(b, "doc_id"), "ids": ids}, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, file: str) -> DataFrame:
    """(doc_id, data): the bytes that encode()'s ids stand for."""
    tune(encoded.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("data", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, _ = codec(file)
        for b in rows_of(it):
            data = [None if x is None else vocabulary.decode(np.frombuffer(x, "<u4")) for x in column(b, "ids").to_pylist()]
            yield batches({"doc_id": column(b, "doc_id"), "data": data}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode() and decode() in one pass over the texts, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder = codec(file)
        for b in rows_of(it):
            packed = [np.frombuffer(x, vocabulary.kind) for x in encoder.encode(texts(b))]
            yield batches(
                {
                    "doc_id": column(b, "doc_id"),
                    "n_tokens": [len(x) for x in packed],
                    "ids_sha256": [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in packed],
                    "decoded_sha256": [hashlib.sha256(vocabulary.decode(x)).hexdigest() for x in packed],
                },
                schema,
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
