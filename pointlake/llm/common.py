"""Shared folders, table materialisation and Arrow helpers of the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Text handed to numpy at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: An Arrow batch on its way to Python ends where it is beyond so many bytes.
BATCH_BYTES = 1 << 20


def tune(spark: SparkSession) -> None:
    """Keep the Arrow batches that reach Python small, as texts can be very long, and give executors this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    _ship(spark)


def _ship(spark: SparkSession) -> None:
    """Send the package's source to the executors once per application, in the way of --py-files."""
    context = spark.sparkContext
    if getattr(context, "_pointlake_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp(prefix="pointlake-")  # the driver's file server reads it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(name := os.path.join(folder, "pointlake.zip"), "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(name)
    context._pointlake_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the one that driver and executors share (spark.checkpoint.dir)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='pointlake-')}"  # one process, as in tests: its folder is shared
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/pointlake-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df once below the shared folder and read it back: later steps neither recompute it nor hang on its
    executors. Returns the table and its folder, to be removed with discard(); what a result still reads is removed
    when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    if not _written:
        atexit.register(_discard_all)
    _written[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Folders of materialise() that are still there.
_written: dict[str, SparkSession] = {}


def _discard_all() -> None:
    for path, spark in list(_written.items()):
        try:
            discard(spark, path)
        except Exception:  # noqa: BLE001  the session is gone, and no one is left to tell
            return


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder made by materialise(), and the folder made for it."""
    _written.pop(path, None)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getParent()
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets


def text_blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0) for runs of rows of at most `most` bytes, or one row."""
    raw, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def tidy() -> None:
    """Give freed memory back to the system at the end of a task: the worker stays for the next ones."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def input_bytes(df: DataFrame) -> int:
    """About how many bytes df's plan reads, by Catalyst's statistics; at most 2**50, where these know nothing."""
    plan = df._jdf.queryExecution().optimizedPlan()
    sizes, todo = 0, [plan]
    while todo:
        now = todo.pop()
        children = now.children()
        if children.isEmpty():
            sizes += min(1 << 50, int(str(now.stats().sizeInBytes())))
        else:
            todo += [children.apply(k) for k in range(children.size())]
    return min(1 << 50, sizes)


def batches(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A string column as Python strings; null counts as empty."""
    return ["" if x is None else x for x in column(batch, name).to_pylist()]


def rows_of(iterator: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows."""
    return (b for b in iterator if b.num_rows)


def least_hashed(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, those with the least hash of a key. Rows that can't be among them by far are left out where
    they lie, so that few meet in the task that takes the least."""
    number = rows.count()
    if number > 2 * most:
        share = F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
        rows = rows.where(share < 1.5 * most / number + 64 / number)
    return rows.orderBy(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)), key).limit(most)


def range_number(bounds: list[int], id_col: str) -> Column:
    """How many of the ascending bounds an id has reached: the number of its range. Null: 0."""
    if not bounds:
        return F.lit(0)
    limits = np.array(bounds, np.int64)

    @arrow_udf("int")
    def reached(ids: pa.Array) -> pa.Array:
        known = pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(limits, known, "right").astype(np.int32))

    return reached(F.col(id_col).cast("long"))
