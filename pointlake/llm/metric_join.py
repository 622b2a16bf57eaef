"""Embedding near-duplicates: an exact metric range join by pivots.

Unit vectors go to the cell of their nearest pivot. Angles are a metric: if y (nearest pivot j) is within angle a of
some x of cell i, then angle(y, p_i) <= angle(x, p_i) + a <= angle(x, p_j) + a <= angle(y, p_j) + 2a, and angle(y, p_i)
is at most the cell's radius plus a. Where both hold y is replicated to cell i, if i comes before its own cell, so
every pair meets in one cell. Cells are cut in tiles of bounded size that are joined independently; a tile gives
counts of links and links that span its components, never its pairs. Equal vectors are one entry with a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from pointlake.llm.common import batches, column, least_hashed, materialise, rows_of, tune
from pointlake.llm.components import connected_components, forest

COSINE = 0.9
#: Vectors for each pivot, pivots at most, and rows of a tile on the side of the cell's own vectors and on the other.
PIVOT_ROWS, PIVOTS, OWN_ROWS, OTHER_ROWS = 4096, 256, 4096, 16384
#: Pivots at least, however small the table.
FEW_PIVOTS = 16
_BLOCK = 2048


def _unpack(column: pa.Array, kind: str) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(np.float64) if rows else np.zeros((0, 0))


def _binary(data: bytes, size: np.ndarray) -> pa.Array:
    """Binary values of `size` bytes each, one after the other in data."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])


def packed_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """((vec_id, v) of every row, numpy type of the packed v). v is null for vectors that can't link: null, empty, zero
    or with null or non-finite components (in double precision their norm must be finite too)."""
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows_of(it):
            lists, n = column(b, "v"), b.num_rows
            of = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
            parts = lists.flatten()
            value = pc.fill_null(parts, 0.0).to_numpy(zero_copy_only=False).astype(kind)
            with np.errstate(over="ignore", invalid="ignore"):
                wide = value.astype(np.float64)
                size = np.bincount(of, wide * wide, n)
                wrong = np.bincount(of, ~np.isfinite(wide) | parts.is_null().to_numpy(zero_copy_only=False), n)
                fit = (wrong == 0) & np.isfinite(size) & (size > 0)
            length = np.bincount(of, minlength=n)[fit] * value.itemsize
            packed = _binary(value[fit[of]].tobytes(), length)
            at = np.where(fit, np.cumsum(fit) - 1, 0)
            yield pa.RecordBatch.from_arrays([column(b, "vec_id"), packed.take(pa.array(at, mask=~fit))], schema=schema)

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, v binary"), kind


def tile_links(own: np.ndarray, other: np.ndarray, own_count: np.ndarray, other_count: np.ndarray, same: bool, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each own row, of each other row, root of each of own then other): vectors as float64 rows; `same`:
    both sides are the same rows, whose pairs count once and not with themselves."""
    a = own / np.linalg.norm(own, axis=1, keepdims=True)
    b = a if same else other / np.linalg.norm(other, axis=1, keepdims=True)
    a4, margin = a.astype(np.float32), 1e-6 + 4e-7 * own.shape[1]
    left, right, root = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), np.arange(len(a) + len(b))
    for low in range(0, len(b), _BLOCK):
        part = b[low : low + _BLOCK]
        s = a4 @ part.T.astype(np.float32)
        near = s >= cosine + margin
        i, j = np.nonzero((s >= cosine - margin) & ~near)
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000], j[at : at + 100_000]
            u, v = own[x], (own if same else other)[low + y]
            near[x, y] = np.einsum("ij,ij->i", u, v) / np.sqrt(np.einsum("ij,ij->i", u, u) * np.einsum("ij,ij->i", v, v)) >= cosine
        if same:
            near &= np.arange(len(a))[:, None] < low + np.arange(len(part))[None, :]
        i, j = np.nonzero(near)
        if not len(i):
            continue
        j = j + low
        left += np.bincount(i, other_count[j], len(a)).astype(np.int64)
        right += np.bincount(j, own_count[i], len(b)).astype(np.int64)
        label = forest(root[i], root[j if same else len(a) + j], len(root))
        root = label[root]
    return left, right, root


def choose_pivots(classes: DataFrame, kind: str, pivot_rows: int = PIVOT_ROWS) -> list[np.ndarray]:
    """Unit vectors of classes (node, v): one for every pivot_rows of them, but FEW_PIVOTS at least and PIVOTS at most."""
    number = max(min(FEW_PIVOTS, PIVOTS), -(-classes.count() // pivot_rows))
    found = [np.frombuffer(r.v, kind).astype(np.float64) for r in least_hashed(classes, "node", min(PIVOTS, number)).select("v").collect()]
    return [p / np.linalg.norm(p) for p in found]


def placement(classes: DataFrame, kind: str, chosen: list[np.ndarray], cosine: float = COSINE, own_rows: int = OWN_ROWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every vector in its home cell, a row for each cell, the vectors replicated to cells before their own)."""
    angle = float(np.arccos(cosine))
    schema = pa.schema([("node", pa.int64()), ("v", pa.binary()), ("m", pa.int64()), ("size", pa.int32()), ("cell", pa.int32()), ("radius", pa.float64()), ("reach", pa.list_(pa.float64()))])

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Home cell, angle to its pivot, and the angles to earlier pivots within reach (else null). Vectors whose
        length no pivot has share cell -1 of their length."""
        for b in rows_of(it):
            sizes = pc.binary_length(column(b, "v")).to_numpy()
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                x = _unpack(column(part, "v"), kind)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                fit = np.array([k for k, p in enumerate(chosen) if len(p) == x.shape[1]], np.int64)
                n = len(x)
                cell, radius, home = np.full(n, -1, np.int32), np.zeros(n), np.zeros(n, np.int64)
                far = np.zeros((n, 0))
                if len(fit):
                    far = np.arccos(np.clip(x @ np.stack([chosen[k] for k in fit]).T, -1, 1))
                    home = far.argmin(axis=1)
                    cell, radius = fit[home].astype(np.int32), far.min(axis=1)
                earlier = np.arange(far.shape[1]) < home[:, None]
                flat = far[earlier]
                beyond = flat > np.repeat(radius + 2 * angle + 1e-7, home)
                reach = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(home)]).astype(np.int32)), pa.array(flat, mask=beyond))
                yield pa.RecordBatch.from_arrays([column(part, "node"), column(part, "v"), column(part, "m"), pa.array(np.full(n, size, np.int32)), pa.array(cell), pa.array(radius), reach], schema=schema)

    placed, _ = materialise(classes.select("node", "v", "m").mapInArrow(place, "node long, v binary, m long, size int, cell int, radius double, reach array<double>"), "placed")
    # A row per cell: its radius and how many it has of its own; then how many are replicated to it.
    cells = placed.groupBy("size", "cell").agg(F.max("radius").alias("wide"), F.ceil(F.count("*") / F.lit(own_rows)).cast("int").alias("chunks"))
    positions: dict[int, list[int]] = {}
    for k, p in enumerate(chosen):
        positions.setdefault(len(p) * np.dtype(kind).itemsize, []).append(k)
    order = F.create_map(*[F.lit(x) for length, ks in positions.items() for x in (length, F.array(*[F.lit(k) for k in ks]))]) if chosen else F.create_map(F.lit(0), F.array(F.lit(0)))
    guests = (
        placed.select("node", "v", "m", "size", F.posexplode("reach").alias("k", "far"))
        .where(F.col("far").isNotNull())
        .withColumn("cell", F.element_at(F.element_at(order, F.col("size")), F.col("k") + 1))
        .join(F.broadcast(cells), ["size", "cell"])
        .where(F.col("far") <= F.col("wide") + F.lit(angle + 1e-7))
        .select("node", "v", "m", "size", "cell", "chunks")
    )
    return placed, cells, guests


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, own_rows: int = OWN_ROWS, other_rows: int = OTHER_ROWS, pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (least vec_id reachable), kept (vec_id is it) for
    every row. Vectors that can't link, see packed_vectors(), have 0 links and are their own component, and vectors of
    different lengths don't link. Repeated rows count as others; a null id has its component's least id, if any."""
    spark = vectors.sparkSession
    tune(spark)
    packed, kind = packed_vectors(vectors, id_col, vector_col)
    keyed, _ = materialise(packed.withColumn("node", F.xxhash64("v")), "vectors")
    classes, _ = materialise(keyed.where("v is not null").groupBy("node", "v").agg(F.count("*").alias("m"), F.min("vec_id").alias("least")), "classes")
    chosen = choose_pivots(classes, kind, pivot_rows)
    placed, cells, guests = placement(classes, kind, chosen, cosine, own_rows)
    counts = guests.groupBy("size", "cell").agg(F.ceil(F.count("*") / F.lit(other_rows)).cast("int").alias("parts"))
    own = placed.join(F.broadcast(cells.select("size", "cell", "chunks")), ["size", "cell"]).join(F.broadcast(counts), ["size", "cell"], "left")
    chunk = F.pmod(F.xxhash64(F.lit(1), F.col("node")), F.col("chunks")).cast("int")
    first = own.withColumn("c", chunk).withColumn("parts", F.coalesce("parts", F.lit(0)))
    # Tiles (kind, own chunk, other chunk): kind 0 pairs chunks of the cell's own vectors, kind 1 own with replicated.
    inner = first.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("node", "v", "m", F.struct("size", "cell", F.lit(0).alias("t"), F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).alias("tile"), (F.col("c") <= F.col("d")).alias("mine"))
    outer = first.where("parts > 0").withColumn("d", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("node", "v", "m", F.struct("size", "cell", F.lit(1).alias("t"), F.col("c").alias("a"), F.col("d").alias("b")).alias("tile"), F.lit(True).alias("mine"))
    visiting = (
        guests.join(F.broadcast(counts), ["size", "cell"])
        .withColumn("d", F.pmod(F.xxhash64(F.lit(2), F.col("node")), F.col("parts")).cast("int"))
        .withColumn("c", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("node", "v", "m", F.struct("size", "cell", F.lit(1).alias("t"), F.col("c").alias("a"), F.col("d").alias("b")).alias("tile"), F.lit(False).alias("mine"))
    )
    tiles = inner.unionByName(outer).unionByName(visiting)
    found_schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def join(key: tuple, table: pa.Table) -> pa.Table:
        tile = key[0].as_py()
        same = tile["t"] == 0 and tile["a"] == tile["b"]
        mine = table["mine"].to_numpy()
        node, m = table["node"].to_numpy(), table["m"].to_numpy()
        v = _unpack(table["v"], kind)
        left, right, root = tile_links(v[mine], v[~mine], m[mine], m[mine] if same else m[~mine], same, cosine)
        if same:
            nodes, links = node[mine], left + right
            root = root[: len(nodes)]
        else:
            nodes, links = np.concatenate([node[mine], node[~mine]]), np.concatenate([left, right])
        some = np.flatnonzero(links > 0)
        return pa.table({"node": nodes[some], "links": links[some], "root": nodes[root[some]]}, schema=found_schema)

    found, _ = materialise(tiles.groupBy("tile").applyInArrow(join, "node long, links long, root long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    member = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labelled = classes.select("node", "m", "least").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    roots = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = labelled.join(roots, "component").join(links, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component_id")
    of_row = keyed.where("v is not null").select("vec_id", "node").join(of_class, "node").select("vec_id", "n_links", "component_id")
    alone = keyed.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return of_row.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
