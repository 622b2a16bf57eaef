"""Binary little-endian PLY point files as a Spark data source.

spark.dataSource.register(PlyDataSource); spark.read.format("ply").load(folder) has a row per vertex, with the columns
of the first file's header; spark.read.format("ply").option("every", 4) takes every fourth vertex.
df.write.format("ply").save(folder) writes a file per partition, aside first and renamed when all tasks are done.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, ShortType, StructField, StructType

#: The format's names of number types.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8"}
#: Vertices handed on at once.
ROWS = 1 << 16


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _spark_type(kind: str) -> DataType:
    return {"i1": ByteType(), "u1": ShortType(), "<i2": ShortType(), "<u2": IntegerType(), "<i4": IntegerType(), "<u4": IntegerType(), "<f4": FloatType(), "<f8": DoubleType()}[kind]


def read_header(stream) -> tuple[np.dtype, int, int, list[str]]:
    """(type of a vertex, vertices, bytes of the header, comments); other elements must follow the vertices."""
    head = b""
    while b"end_header\n" not in head:
        more = stream.read(1)
        if not more or len(head) > 1 << 16:
            raise ValueError("not a PLY file: its header has no end")
        head += more
    lines = head.decode("ascii", "replace").splitlines()
    if lines[0].strip() != "ply" or not any(x.startswith("format binary_little_endian") for x in lines):
        raise ValueError("only binary little-endian PLY files can be read")
    fields, count, element = [], 0, None
    for words in map(str.split, lines):
        if words[:1] == ["element"]:
            element = words[1]
            count = int(words[2]) if element == "vertex" else count
        elif words[:1] == ["property"] and element == "vertex":
            fields.append((words[2], PLY_TYPES[words[1]]))
    return np.dtype(fields), count, len(head), [x[8:] for x in lines if x.startswith("comment ")]


class PlyPartition(InputPartition):
    def __init__(self, name: str, first: int, rows: int):
        super().__init__((name, first, rows))
        self.name, self.first, self.rows = name, first, rows


#: Points that a task holds before it writes a file.
FILE_ROWS = 1 << 20


class PlyReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, every: int):
        self.path, self.schema, self.every = path, schema, every

    def partitions(self) -> list[InputPartition]:
        out = []
        for name in _files(self.path):
            store, at = _open(name)
            with store.open_input_stream(at) as f:
                _, count, _, _ = read_header(f)
            out += [PlyPartition(name, k, min(1 << 20, count - k)) for k in range(0, count, 1 << 20)]
        return out or [PlyPartition("", 0, 0)]

    def read(self, partition: PlyPartition) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        store, at = _open(partition.name)
        with store.open_input_stream(at) as f:
            kind, _, head, _ = read_header(f)
        with store.open_input_file(at) as f:
            for first in range(partition.first, partition.first + partition.rows, ROWS):
                n = min(ROWS, partition.first + partition.rows - first)
                rows = np.frombuffer(f.read_at(n * kind.itemsize, head + first * kind.itemsize), kind)
                rows = rows[(-first) % self.every :: self.every]
                if len(rows):
                    arrow = [pa.array(rows[c.name].astype(_numpy(c.dataType))) if c.name in kind.names else pa.nulls(len(rows), _arrow(c.dataType)) for c in self.schema]
                    yield pa.RecordBatch.from_arrays(arrow, names=[c.name for c in self.schema])


def _numpy(kind: DataType) -> str:
    return {ByteType(): "i1", ShortType(): "<i2", IntegerType(): "<i4", FloatType(): "<f4", DoubleType(): "<f8"}[kind]


def _arrow(kind: DataType) -> pa.DataType:
    return {ByteType(): pa.int8(), ShortType(): pa.int16(), IntegerType(): pa.int32(), FloatType(): pa.float32(), DoubleType(): pa.float64()}[kind]


def _files(path: str) -> list[str]:
    store, at = _open(path)
    info = store.get_file_info(at)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    return sorted(prefix + x.path for x in store.get_file_info(fs.FileSelector(at)) if x.path.endswith(".ply"))


class PlyWriter(DataSourceArrowWriter):
    """A task writes files of at most FILE_ROWS points, named by job, task and number. They get their names when all
    tasks are done; files of earlier jobs stay (append) or go just before that (overwrite)."""

    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite, self.job = path, schema, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """Shares r, g, b from 0 to 1 become bytes red, green, blue, cut off; other columns keep their type."""
        from pyspark import TaskContext

        kind, names = [], {"r": "red", "g": "green", "b": "blue"}
        for c in self.schema:
            byte = c.name in names and isinstance(c.dataType, (FloatType, DoubleType))
            kind.append((names[c.name] if byte else c.name, "u1" if byte else _numpy(c.dataType)))
        store, root = _open(self.path)
        store.create_dir(root, recursive=True)
        task, done = TaskContext.get(), _Written([])

        def flush(parts: list[np.ndarray]) -> None:
            name = f"{root}/part-{self.job}-{task.partitionId():05d}-{len(done.files):05d}.ply"
            aside = f"{name}.{task.taskAttemptId()}"
            back = {v: k for k, v in PLY_TYPES.items()}
            head = "ply\nformat binary_little_endian 1.0\nelement vertex %d\n%send_header\n" % (sum(map(len, parts)), "".join(f"property {back[t]} {n}\n" for n, t in kind))
            with store.open_output_stream(aside) as out:
                out.write(head.encode())
                for rows in parts:
                    out.write(rows.tobytes())
            done.files.append((aside, name))

        held: list[np.ndarray] = []
        for whole in iterator:
            for first in range(0, whole.num_rows, FILE_ROWS):
                b = whole.slice(first, FILE_ROWS)
                if held and sum(map(len, held)) + b.num_rows > FILE_ROWS:
                    flush(held)
                    held = []
                rows = np.zeros(b.num_rows, np.dtype(kind))
                for c, (name, to) in zip(self.schema, kind, strict=True):
                    value = b.column(b.schema.get_field_index(c.name)).to_numpy(zero_copy_only=False)
                    rows[name] = np.clip(value * 255, 0, 255).astype("u1") if to == "u1" else value
                held.append(rows)
        if held or not done.files:  # a task without rows leaves the columns' names
            flush(held)
        return done

    def commit(self, messages: list) -> None:
        store, root = _open(self.path)
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root)):
                if x.path.endswith(".ply"):
                    store.delete_file(x.path)
        for m in messages:
            for aside, name in m.files if m is not None else []:
                store.move(aside, name)

    def abort(self, messages: list) -> None:
        store, _ = _open(self.path)
        for m in messages:
            for aside, _ in m.files if m is not None else []:
                store.delete_file(aside)


class _Written(WriterCommitMessage):
    """(where a file lies, what it will be called) for each of a task's files."""

    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class PlyDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> StructType:
        names = _files(self.options["path"])
        if not names:
            return StructType([])
        store, at = _open(names[0])
        with store.open_input_stream(at) as f:
            kind, _, _, _ = read_header(f)
        return StructType([StructField(n, _spark_type(kind[n].str.replace("|", "")), True) for n in kind.names])

    def reader(self, schema: StructType) -> DataSourceReader:
        return PlyReader(self.options["path"], schema, int(self.options.get("every", "1")))

    def writer(self, schema: StructType, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], schema, overwrite)
