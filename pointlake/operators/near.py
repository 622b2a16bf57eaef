"""The k nearest rows without a row for every pair within the radius.

In a dense cloud a radius holds a large share of all points, so pairs grow with the square of the table. Here distinct
places of both sides are laid along a Z curve; the right side's places in a row make blocks of at most 256, and each
left place gets a bound from the right places about it on the curve: no nearest row sought is beyond it. Places
are then compared only with blocks whose box is within the bound, by arrays, and each such pair gives no more rows than
can be among the k. A place counts as often as it has rows (k at most), so copies don't multiply. The result is exact
for any distribution; order along the curve only decides how much is compared. Blocks hold the right rows' columns too,
so rows found are moved once, to their left place; what is summed up over them is best summed up there, by place.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from pointlake.plans.steps import written

#: Places in a block of the right side. Their boxes, one row each, are sent to all tasks.
BLOCK = 256


def _kernels(d: int, k: int):
    """Functions of the tasks, made here so that they travel with the closures."""

    def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all rows of a from all of b, by the steps of spatial.distance."""
        total = (a[:, None, 0] - b[None, :, 0]) ** 2
        for c in range(1, d):
            total += (a[:, None, c] - b[None, :, c]) ** 2
        return np.sqrt(total)

    def bound(far: np.ndarray, n: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For each row the distance at which k rows of the right side are reached, or most if that is less."""
        m = min(k, far.shape[1])
        if not m:
            return most
        some = np.argpartition(far, m - 1, axis=1)[:, :m] if m < far.shape[1] else np.broadcast_to(np.arange(m), (len(far), m))
        near = np.take_along_axis(far, some, 1)
        order = np.argsort(near, axis=1)
        near, times = np.take_along_axis(near, order, 1), np.cumsum(n[np.take_along_axis(some, order, 1)], axis=1)
        enough = times >= k
        at = np.take_along_axis(near, enough.argmax(1)[:, None], 1)[:, 0]
        return np.where(enough.any(1), np.minimum(at, most), most)

    def box_range(low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distances between boxes (low, high) and boxes (lo, hi); no pair's distance is beyond."""
        least = most = 0.0
        for c in range(d):
            gap = np.maximum(np.maximum(lo[None, :, c] - high[:, None, c], low[:, None, c] - hi[None, :, c]), 0.0)
            span = np.maximum(high[:, None, c] - lo[None, :, c], hi[None, :, c] - low[:, None, c])
            least, most = least + gap**2, most + span**2
        return np.sqrt(least), np.sqrt(most)

    return apart, bound, box_range


def _packing(d: int):
    """Left places as compressed bytes on their way to a block, several times smaller than as rows."""

    def packed(ids: np.ndarray, at: np.ndarray, u: np.ndarray) -> bytes:
        """ids ascend. Bytes of equal weight lie together, as most are alike; bounds, which may be wider but not beyond
        the widest, are rounded up to a single's bits."""
        short = u.astype(np.float32)
        short = np.where(short < u, np.nextafter(short, np.float32(np.inf)), short)
        lanes = [np.diff(ids, prepend=0), *at.T, np.minimum(short.astype(float), u.max())]
        raw = np.concatenate([np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8).T.ravel() for x in lanes])
        return pa.compress(raw.tobytes(), codec="zstd", asbytes=True)

    def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = np.frombuffer(pa.decompress(data, n * 8 * (d + 2), codec="zstd", asbytes=True), np.uint8).reshape(d + 2, 8, n)
        ids, *at, u = (np.ascontiguousarray(x.T).view(np.int64 if not i else float).ravel() for i, x in enumerate(raw))
        return np.cumsum(ids), np.stack(at, axis=1), u

    return packed, unpacked


def _placed(left: DataFrame, right: DataFrame, cs: Sequence[str], k: int, radius: float, tasks: int) -> DataFrame:
    """Both sides' places in the order of a Z curve, written: side (0 left, 1 right), id, coordinates, n, the block of a
    right place and the bound of a left one."""
    d = len(cs)
    bits = min(20, 60 // d)
    ends = right.agg(*[F.percentile_approx(c, [0.01, 0.99], 100).alias(c) for c in cs]).first()
    both = left.select(*cs, F.lit(0).alias("side"), F.lit(1).cast("long").alias("n")).unionByName(right.select(*cs, F.lit(1).alias("side"), "n"))
    z = F.lit(0).cast("long")
    for i, c in enumerate(cs):
        low, high = ends[c] or (0.0, 0.0)
        span = (high - low) or 1.0
        scaled = (F.col(c) - F.lit(low - span)) * F.lit((1 << bits) / (3 * span))  # the few beyond lie at the ends
        both = both.withColumn(f"__q{i}", F.least(F.greatest(scaled, F.lit(0.0)), F.lit(float((1 << bits) - 1))).cast("long"))
        for b in range(bits):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(f"__q{i}", b).bitwiseAND(F.lit(1).cast("long")), b * d + i))
    ordered = both.select(*cs, "side", "n", z.alias("z")).repartitionByRange(tasks, "z").sortWithinPartitions("z")
    apart, bound, _ = _kernels(d, k)
    block = BLOCK

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        rows = rights = 0
        seen, times = np.empty((0, d)), np.empty(0, np.int64)
        for b in it:
            at = np.stack([b.column(i).to_numpy() for i in range(d)], axis=1)
            side, n = b.column(d).to_numpy(), b.column(d + 1).to_numpy()
            u = np.full(len(side), float(radius))
            is_right, old = side == 1, len(seen)
            seen, times = np.concatenate([seen, at[is_right]]), np.concatenate([times, n[is_right]])
            so_far = old + np.cumsum(is_right)
            for s in range(0, len(side), block):
                part = slice(s, s + block)
                asks = np.flatnonzero(~is_right[part]) + s
                about = slice(max(0, so_far[s] - block), so_far[part][-1] + block)  # of this batch and the last one's end
                if len(asks):
                    u[asks] = bound(apart(at[asks], seen[about]), times[about], u[asks])
            seen, times = seen[-block:], times[-block:]
            places = rights + np.cumsum(side) - side
            ids = first + rows + np.arange(len(side))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (side, ids, *at.T, n, first + places // block, u)], names=["side", "id", *cs, "n", "block", "u"])
            rows, rights = rows + len(side), rights + int(side.sum())

    kinds = ", ".join(f"{c} double" for c in cs)
    return written(ordered.drop("z").mapInArrow(run, f"side int, id long, {kinds}, n long, block long, u double"))


def _pairs(placed: DataFrame, cs: Sequence[str], k: int, tasks: int, rows: DataFrame | None = None) -> DataFrame:
    """__l, columns of rows, distance: for each left place every row that can be among the k nearest. rows: block, id and
    coordinates of a right place, for how many it counts (n) and what columns more are wanted; else it is the place's id,
    as __r."""
    d = len(cs)
    apart, bound, box_range = _kernels(d, k)
    packed, unpacked = _packing(d)
    rights = placed.where("side = 1")
    boxes = rights.groupBy("block").agg(*[F.min(c) for c in cs], *[F.max(c) for c in cs], F.sum("n")).collect()
    names = np.array([b[0] for b in boxes], np.int64)
    table = np.array([list(b[1:]) for b in boxes], float).reshape(len(boxes), 2 * d + 1)
    lo, hi, full = table[:, :d], table[:, d : 2 * d], table[:, 2 * d] >= k
    rows = rights.select("block", "id", *cs, "n", F.col("id").alias("__r")) if rows is None else rows
    wanted = [f for f in rows.schema if f.name not in ("block", "id", *cs, "n")]
    names_out = ["__l", *[f.name for f in wanted], "distance"]

    def ask(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The left places that each block has to be compared with, 512 at a time."""
        for b in it:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                at, u = np.stack([part.column(i + 1).to_numpy() for i in range(d)], axis=1), part.column(d + 1).to_numpy()
                least, most = box_range(at.min(0)[None], at.max(0)[None], lo, hi)
                u = np.minimum(u, most[0][full].min(initial=np.inf))
                close = np.flatnonzero(least[0] <= u.max())
                least, most = box_range(at, at, lo[close], hi[close])
                u = np.minimum(u, most[:, full[close]].min(axis=1, initial=np.inf))
                box, row = np.nonzero((least <= u[:, None]).T)
                if not len(box):
                    continue
                used, first, count = np.unique(box, return_index=True, return_counts=True)
                ids = part.column(0).to_numpy()
                asks = [packed(ids[r], at[r], u[r]) for r in np.split(row, first[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(names[close[used]]), pa.array(count.astype(np.int32)), pa.array(asks, pa.binary())], names=["block", "m", "asks"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def opened(column):
            flat = column.values.flatten()
            return column.offsets.to_numpy(), [f.to_numpy() for f in flat[: d + 2]], flat[d + 2 :]

        def closed(out, more):
            left, at, far = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(left), *[x.take(pa.array(at)) for x in more], pa.array(far)], names=names_out)

        for b in it:
            b_at, (b_id, *b_xs, b_n), more = opened(b.column(2))
            out, held = [], 0
            for i in range(b.num_rows):
                (ids, at, u), q = unpacked(b.column(1)[i].as_py(), b.column(0)[i].as_py()), slice(b_at[i], b_at[i + 1])
                order = np.argsort(b_id[q], kind="stable")  # the rows of a place together
                _, start, count = np.unique(b_id[q][order], return_index=True, return_counts=True)
                far = apart(at, np.stack([x[q][order][start] for x in b_xs], axis=1))
                row, col = np.nonzero(far <= bound(far, np.add.reduceat(b_n[q][order], start), u)[:, None])
                times = count[col]
                of = np.repeat(start[col] + times - np.cumsum(times), times) + np.arange(times.sum())
                out.append((ids[row].repeat(times), b_at[i] + order[of], far[row, col].repeat(times)))
                held += len(of)
                if held > 100000:
                    yield closed(out, more)
                    out, held = [], 0
            if out:
                yield closed(out, more)

    asks = placed.where("side = 0").select("id", *cs, "u").mapInArrow(ask, "block long, m int, asks binary").repartition(tasks, "block")
    held = rows.groupBy("block").agg(F.collect_list(F.struct("id", *cs, "n", *[f.name for f in wanted])).alias("has"))
    kinds = StructType([StructField("__l", LongType()), *wanted, StructField("distance", DoubleType())])
    return asks.join(held, "block").select("m", "asks", "has").mapInArrow(compare, kinds)


def _sides(left: DataFrame, right: DataFrame, coords: Sequence[str], suffix: str) -> tuple[list[str], DataFrame, DataFrame, str]:
    """Names of the coordinates as doubles, left and right (with the suffix) with them, and what finds rows with a place."""
    cs = [f"__c{i}" for i in range(len(coords))]
    own = left.withColumns({n: F.col(c).cast("double") for n, c in zip(cs, coords, strict=True)})
    other = right.select(*[F.col(c).alias(f"{c}{suffix}") for c in right.columns], *[F.col(c).cast("double").alias(n) for n, c in zip(cs, coords, strict=True)])
    return cs, own, other, " AND ".join(f"abs({c}) < double('infinity')" for c in cs)


def _with_place(own: DataFrame, placed: DataFrame, cs: Sequence[str]) -> DataFrame:
    return own.join(placed.where("side = 0").select(F.col("id").alias("__l"), *cs), cs, "left").drop(*cs)


def kth_distance(left: DataFrame, right: DataFrame, coords: Sequence[str], k: int, radius: float) -> DataFrame:
    """Rows of left that have a place, with the distance of their k-th nearest row of right as `kth`, null if that is not
    within radius. Only distances and counts are moved, no rows of right."""
    cs, own, other, finite = _sides(left, right, coords, "_r")
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    there = other.where(finite).groupBy(*cs).agg(F.least(F.count("*"), F.lit(k).cast("long")).alias("n"))
    placed = _placed(own.where(finite).select(*cs).distinct(), there, cs, k, radius, tasks)
    far = _pairs(placed, cs, k, tasks, placed.where("side = 1").select("block", "id", *cs, "n", F.col("n").cast("int").alias("times")))
    reached = far.withColumn("times", F.sum("times").over(Window.partitionBy("__l").orderBy("distance")))
    return _with_place(own.where(finite), placed, cs).join(reached.where(F.col("times") >= k).groupBy("__l").agg(F.min("distance").alias("kth")), "__l", "left").drop("__l")


def ranked(left: DataFrame, right: DataFrame, coords: Sequence[str], k: int, radius: float, ties: Sequence[str], suffix: str = "_r") -> tuple[DataFrame, DataFrame]:
    """left with the id `__l` of each row's place (null without one), and the rows of right (with the suffix) that are the
    k nearest of each place within radius: __l, right's columns, distance, rank from 1. Equally near ones are ordered by
    `ties`; rows with a null or non-finite coordinate match nothing."""
    cs, own, other, finite = _sides(left, right, coords, suffix)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"{t}{suffix}" for t in ties]
    least = other.where(finite).withColumn("__k", F.row_number().over(Window.partitionBy(*cs).orderBy(*names))).where(F.col("__k") <= k).drop("__k")
    placed = _placed(own.where(finite).select(*cs).distinct(), least.groupBy(*cs).agg(F.count("*").alias("n")), cs, k, radius, tasks)
    rows = least.withColumn("n", F.lit(1).cast("long")).join(placed.where("side = 1").select("block", "id", *cs), cs)
    near = _pairs(placed, cs, k, tasks, rows)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("__l").orderBy("distance", *names))).where(F.col("rank") <= k)
    return _with_place(own, placed, cs), best.select("__l", *[f"{c}{suffix}" for c in right.columns], "distance", "rank")
