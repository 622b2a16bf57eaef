"""Document fingerprints: SimHash over weighted terms, and permuted block tables that search them.

Terms are runs of three words (of a shorter text: all its words), A-Z lower-cased. Each occurrence votes on 128 signed
bits with a weight from 1 to 4 that grows with the term's length in bytes, as short terms are the common ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.llm.bytetext import mix, shingles, words
from pointlake.llm.common import batches, column, range_number, rows_of, text_blocks, tune
from pointlake.llm.simhash_bits import votes

TERM_WORDS, BITS, HEAVIEST = 3, 128, 4
#: Bytes of a term for each step of its weight.
WEIGHT_STEP = 8
#: Blocks a fingerprint is cut in; fingerprints closer than this share a block.
BLOCKS = 4


def fingerprint_arrays(text: pa.Array) -> np.ndarray:
    """uint8 of shape (texts, BITS / 8); null and wordless texts have zeros."""
    out = [np.zeros((0, BITS // 8), np.uint8)]
    for _, _, data, offsets in text_blocks(text):
        w = words(data, offsets)
        value, _, number = shingles(w, TERM_WORDS)
        first = np.cumsum(w.count) - w.count
        at = np.arange(len(value)) + np.repeat(first - (np.cumsum(number) - number), number)
        last = np.repeat(first + w.count, number) - 1
        length = w.end[np.minimum(at + TERM_WORDS - 1, last)] - w.start[at]
        weight = np.clip(length // WEIGHT_STEP, 1, HEAVIEST)
        rows = np.stack([mix(value + np.uint64(k + 1)) for k in range(BITS // 64)], axis=1)
        rows = rows.view(np.uint8).reshape(-1, BITS // 8)
        total = np.bincount(np.repeat(np.arange(len(number)), number), weights=weight, minlength=len(number)).astype(np.int64)
        bits = 2 * votes(rows, number, weight, HEAVIEST) > total[:, None]
        out.append(np.packbits(bits, axis=1))
    return np.concatenate(out)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1: the cosine that the share of differing bits stands for; 1 for equal fingerprints."""
    far = np.bitwise_count(a ^ b).sum(axis=1)
    return np.clip(np.cos(np.pi * far / BITS), 0.0, 1.0)


def _hex(rows: np.ndarray) -> list[str]:
    return [x.tobytes().hex() for x in rows]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint): a row for every row of docs; null texts count as empty and have a zero fingerprint."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(it):
            yield batches({"doc_id": column(b, "doc_id"), "fingerprint": _hex(fingerprint_arrays(column(b, "text")))}, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def permuted_tables(prints: DataFrame, fingerprint_col: str = "fingerprint", blocks: int = BLOCKS) -> DataFrame:
    """Each fingerprint once per table: (table, block, ...); the block that leads the permutation is the key."""
    width = BITS // 4 // blocks
    lead = F.array(*[F.struct(F.lit(k).alias("table"), F.substring(fingerprint_col, 1 + k * width, width).alias("block")) for k in range(blocks)])
    return prints.withColumn("__lead", F.explode(lead)).select("__lead.table", "__lead.block", *[c for c in prints.columns])


def _distance(a: str, b: str):
    parts = [F.bit_count(F.conv(F.substring(a, 1 + k * 8, 8), 16, 10).cast("long").bitwiseXOR(F.conv(F.substring(b, 1 + k * 8, 8), 16, 10).cast("long"))) for k in range(BITS // 32)]
    return sum(parts[1:], parts[0])


def search(queries: DataFrame, prints: DataFrame, radius: int = BLOCKS - 1) -> DataFrame:
    """(query, fingerprint, distance): the distinct fingerprints of `prints` at most `radius` bits from each distinct
    one of `queries`, itself included if it is there. With radius < BLOCKS one block at least is equal, so the tables
    find all; a greater radius raises ValueError. Both have a column `fingerprint`; null ones find nothing. Documents
    with equal fingerprints are one entry: join them back by fingerprint."""
    if radius >= BLOCKS:
        raise ValueError(f"radius must be below {BLOCKS}, the number of blocks")
    left = permuted_tables(queries.select(F.col("fingerprint").alias("query")).dropna().distinct(), "query")
    right = permuted_tables(prints.select("fingerprint").dropna().distinct())
    near = left.join(right, ["table", "block"]).withColumn("distance", _distance("query", "fingerprint"))
    return near.where(F.col("distance") <= radius).select("query", "fingerprint", "distance").distinct()


def next_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(place, doc_id, text, last): docs dealt into runs of ids, to be read in the order of (doc_id, text, last) within
    a `place`. Where a run ends, the first row of the next run (of the last run: of the first) follows with last =
    true, so that every row's successor is beside it. Null ids come first; empty runs are left out."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keys = rows.select("doc_id")
    number = keys.count()
    runs = max(1, min(number // 64, max(int(spark.conf.get("spark.sql.shuffle.partitions")), number // 50_000)))
    bounds = sorted({int(x) for x in keys.approxQuantile("doc_id", [k / runs for k in range(1, runs)], 0.1 / runs)}) if runs > 1 else []
    placed = rows.withColumn("place", range_number(bounds, "doc_id"))
    # A row per run, of which there are as many as bounds: the least id of each, nulls as null.
    least = placed.groupBy("place").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("x")).select("place", "x.doc_id").orderBy("place").collect()
    if not least:
        return placed.withColumn("last", F.lit(False)).limit(0)
    before = {r.place: least[k - 1].place for k, r in enumerate(least)}
    wanted = {r.doc_id: before[r.place] for r in least}
    ids = [x for x in wanted if x is not None]
    is_first = F.col("doc_id").isin(ids) | (F.col("doc_id").isNull() if None in wanted else F.lit(False))
    first_text = placed.where(is_first).groupBy("place", "doc_id").agg(F.min("text").alias("text"))
    previous = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("place"))
    follow = first_text.select("doc_id", "text", previous.alias("place"), F.lit(True).alias("last"))
    both = placed.withColumn("last", F.lit(False)).unionByName(follow)
    return both.repartitionById(len(bounds) + 1, F.col("place")).sortWithinPartitions("place", "last", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every row of docs: doc_id, n_chars (code points), edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The edited text is the row's with its last floor(n_chars / 4) code points replaced by as many first ones (or all)
    of the next row's in the order of (doc_id, text), null ids first and null texts as empty; after the last row comes
    the first. A single row follows itself. near_*: likeness() of the fingerprint to the edited and the next text's."""
    tune(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def portion(ids: list, text: list[str], prints: np.ndarray) -> pa.RecordBatch:
        """All rows but the last, which is the successor of the one before."""
        cut = [len(x) // 4 for x in text[:-1]]
        edited = [x[: len(x) - n] + y[:n] for x, y, n in zip(text, text[1:], cut, strict=False)]
        of_edited = fingerprint_arrays(pa.array(edited, pa.string()))
        return batches(
            {
                "doc_id": ids[:-1],
                "n_chars": [len(x) for x in text[:-1]],
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in edited],
                "fingerprint": _hex(prints[:-1]),
                "edited_fingerprint": _hex(of_edited),
                "near_edited": likeness(prints[:-1], of_edited),
                "near_next": likeness(prints[:-1], prints[1:]),
            },
            schema,
        )

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, text, prints = [], [], np.zeros((0, BITS // 8), np.uint8)
        for b in rows_of(it):
            last = column(b, "last").to_pylist()
            ids += column(b, "doc_id").to_pylist()
            text += column(b, "text").to_pylist()
            prints = np.concatenate([prints, fingerprint_arrays(column(b, "text"))])
            ended = [len(ids) - len(last) + k for k, x in enumerate(last) if x]
            begin = 0
            for end in ended:  # one run of ids after the other
                yield portion(ids[begin : end + 1], text[begin : end + 1], prints[begin : end + 1])
                begin = end + 1
            ids, text, prints = ids[begin:], text[begin:], prints[begin:]
            if len(ids) > 1:
                yield portion(ids, text, prints)
                ids, text, prints = ids[-1:], text[-1:], prints[-1:]

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return next_texts(docs, id_col, text_col).mapInArrow(run, kinds)
