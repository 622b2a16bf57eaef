"""SimHash near-duplicates: fingerprints, candidate buckets, pivot distance tables, components.

Two fingerprints with at most 3 differing bits agree on at least two of five blocks of bits, so each of the ten pairs
of blocks is a bucket key. In a bucket the table of Hamming distances to fixed reference fingerprints ("pivots")
discards pairs: by the triangle inequality linked fingerprints differ by at most 3 in every coordinate. Survivors are
verified by counting bits. Equal fingerprints are one node throughout, so copies cost nothing; buckets of more than
CELL rows are dealt by their first pivot distances, with the boundaries replicated, and by tiles beyond that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.bytetext import mix
from pointlake.llm.common import batches, column, discard, materialise, rows_of, text_blocks, tidy, tune
from pointlake.llm.components import connected_components, forest
from pointlake.llm.member_filter import MemberFilter
from pointlake.llm.simhash_bits import votes

SHINGLE, SEED, RADIUS = 3, 42, 3
#: (lowest bit, bits) of the blocks; RADIUS + 2 of them.
BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
TABLES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))
#: Reference fingerprints whose distances make up the pivot table.
PIVOTS = mix(np.arange(1, 25, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
#: Rows of a bucket that are compared together.
CELL = 2048


def shingle_digests(raw: bytes, size: int = SHINGLE) -> tuple[bytes, int]:
    """XXH64 digests (big-endian) of a text's word shingles, and their number. bytes.lower() and bytes.split() know
    exactly A-Z and the six ASCII separators."""
    words = raw.lower().split()
    if not words:
        return b"", 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_digest(joined, SEED), 1
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length) - 1
    start = end - length + 1
    digest, seed = xxhash.xxh64_digest, SEED
    found = [digest(joined[a:b], seed) for a, b in zip(start[: 1 - size].tolist(), end[size - 1 :].tolist(), strict=True)]
    return b"".join(found), len(found)


def fingerprint_arrays(text: pa.Array) -> np.ndarray:
    """The unsigned 64-bit fingerprint of every text; null and wordless texts have 0."""
    out = [np.zeros(0, np.uint64)]
    for low, high, data, offsets in text_blocks(text):
        raw = data.tobytes()
        found = [shingle_digests(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        number = np.array([n for _, n in found], np.int64)
        rows = np.frombuffer(b"".join(d for d, _ in found), np.uint8).reshape(-1, 8)
        bits = 2 * votes(rows, number) > number[:, None]
        out.append(np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp): xxhash64 of each row's text and its fingerprint as a signed long; a row for every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(it):
            yield batches({"doc_id": column(b, "doc_id"), "text_key": column(b, "text_key"), "fp": fingerprint_arrays(column(b, "text")).view(np.int64)}, schema)
        tidy()

    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(run, "doc_id long, text_key long, fp long")


def pivot_table(fp: np.ndarray, pivots: np.ndarray = PIVOTS) -> np.ndarray:
    """Hamming distances (fingerprints, pivots)."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)


def linked_pairs(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) within equal groups (ascending) whose fingerprints differ in 1 to `radius` bits.

    The first coordinate orders each group, so candidates are a run after each row; they are made in bounded portions,
    cut by the other coordinates one after the other, and verified."""
    table = pivot_table(fp)
    order = np.lexsort((table[:, 0], group))
    sorted_key = group[order].astype(np.int64) * 128 + table[order, 0]
    last = np.searchsorted(sorted_key, sorted_key + radius, "right")
    ahead = last - np.arange(len(fp)) - 1
    out_a, out_b, row = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    total = np.cumsum(ahead)
    while row < len(fp):
        base = total[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(total, base + (1 << 21), "right")))
        n = ahead[row:end]
        i = np.repeat(np.arange(row, end), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        for k in range(1, table.shape[1]):
            keep = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[keep], j[keep]
        far = np.bitwise_count(fp[i] ^ fp[j])
        keep = (far <= radius) & (far > 0)
        out_a.append(i[keep])
        out_b.append(j[keep])
        row = end
    return np.concatenate(out_a), np.concatenate(out_b)


def _tile_links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, fp) sorted by cell; yields links that span what is linked within each cell."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    held_cell, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def links(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.concatenate([[0], cell[1:] != cell[:-1]]))
        i, j = linked_pairs(fp, group)
        root = forest(i, j, len(fp))
        own = np.flatnonzero(root != np.arange(len(fp)))
        return batches({"a": fp[own].view(np.int64), "b": fp[root[own]].view(np.int64)}, schema)

    for b in it:
        held_cell = np.concatenate([held_cell, column(b, "cell").to_numpy()])
        held_fp = np.concatenate([held_fp, column(b, "fp").to_numpy().view(np.uint64)])
        if len(held_cell) > 1 << 16 and held_cell[0] != held_cell[-1]:
            cut = int(np.searchsorted(held_cell, held_cell[-1]))
            yield links(held_cell[:cut], held_fp[:cut])
            held_cell, held_fp = held_cell[cut:], held_fp[cut:]
    if len(held_cell):
        yield links(held_cell, held_fp)


def _distance(pivot: int):
    value = int(PIVOTS[pivot])
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(value - (1 << 64) if value >= 1 << 63 else value)))


def fingerprint_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) spanning the graph over distinct fingerprints (column fp) that joins those RADIUS or fewer bits
    apart. Every such pair shares a bucket; within a cell only links that span its components are returned."""
    keys = []
    for t, blocks in enumerate(TABLES):
        key = F.lit(t).cast("long")
        for k in blocks:
            low, bits = BLOCKS[k]
            key = F.shiftleft(key, bits).bitwiseOR(F.shiftrightunsigned(F.col("fp"), low).bitwiseAND(F.lit((1 << bits) - 1)))
        keys.append(key)
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    shared = rows.join(sizes, "bucket")
    small = shared.where(F.col("m") <= CELL).select(F.xxhash64("bucket").alias("cell"), F.col("bucket"), F.lit(0).alias("d"), F.lit(0).alias("e"), "fp")
    # A large bucket: cells by the distances to two pivots. A pair at most RADIUS apart in both meets where the cell
    # is that of the greater first distance, with the second distances cut in strips twice as wide as RADIUS.
    wide = 4 * (RADIUS + 1)
    large = (
        shared.where(F.col("m") > CELL)
        .withColumn("d", _distance(0))
        .withColumn("e", _distance(1))
        .withColumn("d", F.explode(F.expr(f"array_distinct(array(floor(d / {wide}), floor((d + {RADIUS}) / {wide})))")))
        .withColumn("e", F.explode(F.expr(f"array_distinct(array(floor(e / {wide}), floor((e + {RADIUS}) / {wide})))")))
        .withColumn("cell", F.xxhash64("bucket", "d", "e"))
        .select("cell", "bucket", F.col("d").cast("int"), F.col("e").cast("int"), "fp")
    )
    sized = large.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(CELL)).cast("int").alias("chunks"))
    tiles = (
        large.join(sized, "cell")
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(F.xxhash64("cell", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    )
    cells = small.select("cell", "fp").unionByName(tiles)
    return cells.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(_tile_links, "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, list[str]]:
    """((doc_id, text_key, fp) of every row, (fp, root, component_id) of every fingerprint, folders to discard). root: a
    fingerprint that names the component, component_id: its smallest doc_id, or null."""
    tune(docs.sparkSession)
    prints, prints_path = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    distinct, path = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    member = connected_components(fingerprint_links(distinct.select("fp")))
    labelled = distinct.join(member, distinct.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    class_of, class_path = materialise(labelled.join(roots, "root").select("fp", "root", "component_id"), "components")
    discard(docs.sparkSession, path)
    return prints, class_of, [prints_path, class_path]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs.

    component_id: the smallest id reachable over links between fingerprints RADIUS or fewer bits apart. Null and empty
    texts have fingerprint 0 and link like others; repeated rows come back as often; a null id has the component of its
    fingerprint (null if nothing else is in it). Other columns of docs don't matter."""
    prints, class_of, _ = classes(docs, id_col, text_col)
    return prints.join(class_of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near_duplicates(), with its columns as they are: that with the smallest id, and of
    several rows with that id the one whose text has the least hash. Components without an id keep one row too. Null and
    empty texts are one component, repeated rows one row, an empty table stays empty, other columns don't matter.

    Texts are hashed once. Rows alone in their component, most of them, are passed on without a shuffle."""
    spark = docs.sparkSession
    prints, class_of, paths = classes(docs, id_col, text_col)
    rows = prints.join(class_of.select("fp", "root"), "fp").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    best = rows.groupBy("root").agg(F.min(first).alias("kept"), F.sum("n").alias("all"), F.min_by("n", first).alias("n")).where("all > 1")
    # Of rows that are not alone: those to keep. Ids of all of them, to tell rows apart where they lie.
    best, best_path = materialise(best.select("root", "kept.doc_id", "kept.text_key", "n"), "kept")
    shared, shared_path = materialise(rows.join(best.select("root"), "root", "left_semi").select(F.coalesce("doc_id", F.lit(0)).alias("id")).distinct(), "shared")
    tuned = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    marked = tuned.withColumn("perhaps", MemberFilter.build(shared, "id").perhaps(F.coalesce("doc_id", F.lit(0))))
    text = F.col("row").getField(text_col).cast("string")
    few = marked.where("perhaps").select("row", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(text).alias("text_key"))
    # A row of few is judged by its id and text: kept if these are a component's best or if it is alone.
    lost = rows.join(best.select("root"), "root", "left_semi").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key").withColumn("fate", F.lit(0))
    won = best.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), "text_key", F.when(F.col("n") > 1, 2).otherwise(1).alias("fate"))
    fate, fate_path = materialise(lost.unionByName(won).groupBy("id", "no_id", "text_key").agg(F.max("fate").alias("fate")), "fate")
    judged = few.join(fate, ["id", "no_id", "text_key"], "left")
    several = judged.where("fate = 2").groupBy("id", "no_id", "text_key").agg(F.first("row").alias("row"))
    whole = marked.where("not perhaps").select("row").unionByName(judged.where("fate is null or fate = 1").select("row")).unionByName(several.select("row"))
    for path in [*paths, best_path, shared_path]:
        discard(spark, path)
    return whole.select([F.col("row").getField(k).alias(k) for k in docs.columns])
