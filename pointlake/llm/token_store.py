"""Token ids in binary shards with a minimal perfect hash index from document keys to offsets.

A store is a folder of shards, each with documents of a range of ids in ascending order (null first, equal ids by
their token ids):

- shard-00007.bin: the ids of its documents one after the other, little-endian, nothing else;
- shard-00007.idx: an npz file of the minimal perfect hash of its distinct document ids with 16-bit fingerprints, and,
  by hash number, the first entry and the number of entries of a document id; entry offsets, in ids; the number of
  entries without an id, which come first.

A lookup hashes a key, compares the stored fingerprint and reads the ids between two offsets: constant time.
Files are written aside and renamed, so a task that runs again replaces what it wrote.
"""

from __future__ import annotations

import io
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointlake.llm.bytetext import mix
from pointlake.llm.common import batches, column, range_number, rows_of, shared_dir, tune
from pointlake.llm.mphf import MinimalPerfectHash
from pointlake.llm.token_cache import library_encoder

#: Documents a shard holds, about, once there are more than the session's shuffle partitions times as many.
SHARD_ROWS = 100_000


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _replace(store: fs.FileSystem, name: str, write) -> None:
    aside = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(aside) as out:
        write(out)
    store.move(aside, name)


def encode_documents(docs: DataFrame, file: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): packed ids of every row's text, null as empty, with end_id at the end."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, kind = library_encoder(file)
        end = np.array([end_id], kind).tobytes()
        for b in rows_of(it):
            yield batches({"doc_id": column(b, "doc_id"), "ids": [x + end for x in encoder.encode_column(column(b, "text"))]}, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


class ShardIndex:
    """Offsets of a shard's documents; see the module."""

    def __init__(self, mph: MinimalPerfectHash, first: np.ndarray, number: np.ndarray, offsets: np.ndarray, nulls: int):
        self.mph, self.first, self.number, self.offsets, self.nulls = mph, first, number, offsets, nulls

    @classmethod
    def build(cls, keys: np.ndarray, nulls: int, lengths: np.ndarray) -> ShardIndex:
        """keys: ascending, after `nulls` entries without one; lengths: of all entries, in ids."""
        distinct, at, number = np.unique(keys, return_index=True, return_counts=True)
        mph = MinimalPerfectHash.build(mix(distinct.view(np.uint64)))
        slot = mph.lookup(mix(distinct.view(np.uint64)))
        first, count = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        first[slot], count[slot] = at + nulls, number
        return cls(mph, first, count, np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), nulls)

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry and number of entries of each key; none for unknown keys."""
        slot = self.mph.lookup(mix(keys.astype(np.int64).view(np.uint64)))
        if not len(self.first):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        return self.first[slot], np.where(slot >= 0, self.number[slot], 0)

    def dumps(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, mph=np.frombuffer(self.mph.dumps(), np.uint8), first=self.first, number=self.number, offsets=self.offsets, nulls=self.nulls)
        return out.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> ShardIndex:
        x = np.load(io.BytesIO(data))
        return cls(MinimalPerfectHash.loads(x["mph"].tobytes()), x["first"], x["number"], x["offsets"], int(x["nulls"]))


class TokenStore:
    """A written store. bounds: the least doc_id of each shard after the first; totals: ids in each shard."""

    def __init__(self, path: str, kind: np.dtype, bounds: list[int], totals: list[int]):
        self.path, self.kind, self.bounds, self.totals = path, np.dtype(kind), bounds, totals

    def shard(self, id_col: str = "doc_id") -> Column:
        return range_number(self.bounds, id_col)

    def read(self, keys: DataFrame, id_col: str = "doc_id") -> DataFrame:
        """For each distinct id of keys, a row per stored document with it: doc_id, start (ids of all documents
        before it in the whole store), n_tokens, ids_crc32 (of its ids as little-endian unsigned 32-bit integers).
        Ids that the store doesn't have give no row, but for fingerprints that happen to agree."""
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        path, kind = self.path, self.kind
        base = np.concatenate([[0], np.cumsum(self.totals)]).astype(np.int64)

        def rows(shard: int, wanted: list[int | None]) -> pa.RecordBatch:
            store, folder = _folder(path)
            with store.open_input_stream(f"{folder}/shard-{shard:05d}.idx") as f:
                index = ShardIndex.loads(f.read())
            known = np.array([x for x in wanted if x is not None], np.int64)
            first, number = index.entries(known)
            spans = [(None, e) for e in range(index.nulls)] if len(known) < len(wanted) else []
            spans += [(k, e) for k, a, n in zip(known.tolist(), first.tolist(), number.tolist(), strict=True) for e in range(a, a + n)]
            out = {f.name: [] for f in schema}
            with store.open_input_file(f"{folder}/shard-{shard:05d}.bin") as f:
                for key, e in sorted(spans, key=lambda x: x[1]):
                    a, b = int(index.offsets[e]), int(index.offsets[e + 1])
                    ids = np.frombuffer(f.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)
                    for name, value in zip(out, (key, int(base[shard]) + a, b - a, zlib.crc32(ids.astype("<u4").tobytes())), strict=True):
                        out[name].append(value)
            return batches(out, schema)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, wanted = None, []
            for b in rows_of(it):
                for shard, key in zip(column(b, "shard").to_pylist(), column(b, "doc_id").to_pylist(), strict=True):
                    if shard != now and wanted:
                        yield rows(now, wanted)
                        wanted = []
                    now = shard
                    wanted.append(key)
                    if len(wanted) >= SHARD_ROWS:
                        yield rows(now, wanted)
                        wanted = []
            if wanted:
                yield rows(now, wanted)

        distinct = keys.select(F.col(id_col).cast("long").alias("doc_id")).distinct().withColumn("shard", self.shard())
        placed = distinct.repartitionById(len(self.totals), F.col("shard")).sortWithinPartitions("shard", "doc_id")
        return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_store(docs: DataFrame, file: str, end_id: int = 2, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> TokenStore:
    """Encode docs and write the store to `path` (by default a new folder in the shared one).

    Shard bounds are quantiles of the ids alone, so that texts are encoded once; ids go through one shuffle, packed.
    An empty table gives a store of one empty shard. Null ids count as the least, null texts as empty; rows with equal
    ids are kept, ordered by their token ids. Other columns of docs don't matter."""
    spark: SparkSession = docs.sparkSession
    tune(spark)
    path = path or shared_dir(spark)
    kind = library_encoder(file)[1]
    keys = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    rows = keys.count()
    shards = max(1, min(rows // 32, int(spark.conf.get("spark.sql.shuffle.partitions"))), rows // SHARD_ROWS)
    found = keys.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.1 / shards) if shards > 1 else []
    bounds = sorted({int(x) for x in found})
    store, folder = _folder(path)
    store.create_dir(folder, recursive=True)
    schema = pa.schema([("shard", pa.int32()), ("tokens", pa.int64())])

    def write(shard: int, entries: Iterator[tuple[int | None, bytes]]) -> pa.RecordBatch:
        out, root = _folder(path)
        known, lengths, nulls = [], [], 0

        def payload(stream) -> None:
            nonlocal nulls
            for key, ids in entries:
                stream.write(ids)
                lengths.append(len(ids) // kind.itemsize)
                if key is None:
                    nulls += 1
                else:
                    known.append(key)

        _replace(out, f"{root}/shard-{shard:05d}.bin", payload)
        index = ShardIndex.build(np.array(known, np.int64), nulls, np.array(lengths, np.int64))
        _replace(out, f"{root}/shard-{shard:05d}.idx", lambda stream: stream.write(index.dumps()))
        return batches({"shard": [shard], "tokens": [int(index.offsets[-1])]}, schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        entries = ((s, k, x) for b in rows_of(it) for s, k, x in zip(column(b, "shard").to_pylist(), column(b, "doc_id").to_pylist(), column(b, "ids").to_pylist(), strict=True))
        for shard, group in groupby(entries, key=lambda x: x[0]):
            yield write(shard, ((k, x) for _, k, x in group))

    encoded = encode_documents(docs, file, end_id, id_col, text_col).withColumn("shard", range_number(bounds, "doc_id"))
    placed = encoded.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")
    totals = dict(placed.mapInArrow(run, "shard int, tokens long").collect())  # a row per shard
    for shard in set(range(len(bounds) + 1)) - set(totals):
        write(shard, iter(()))
    return TokenStore(path, kind, bounds, [totals.get(s, 0) for s in range(len(bounds) + 1)])
