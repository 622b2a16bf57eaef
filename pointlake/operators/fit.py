"""Fits by group: poses, scales, planes, normals, shifts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from pointlake.operators import near


def rigid(source: np.ndarray, target: np.ndarray, weight: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """The rotation and move that take scaled source places closest to targets, by weighted least squares."""
    w = weight / weight.sum()
    a, b = w @ source * scale, w @ target
    u, _, vt = np.linalg.svd(((source * scale - a) * w[:, None]).T @ (target - b))
    turn = np.diag([1.0] * (source.shape[1] - 1) + [np.sign(np.linalg.det(vt.T @ u.T)) or 1.0])
    rotation = vt.T @ turn @ u.T
    return rotation, b - rotation @ a


def similarity_scale(source: np.ndarray, target: np.ndarray) -> float | None:
    """The scale between two sets of places, null where the source has no extent."""
    a, b = source - source.mean(0), target - target.mean(0)
    spread = (a * a).sum()
    if spread == 0:
        return None
    u, s, vt = np.linalg.svd(a.T @ b)
    s[-1] *= np.sign(np.linalg.det(vt.T @ u.T)) or 1.0
    return float(s.sum() / spread)


def piece_transforms(pairs: DataFrame, piece: str = "piece", scales: tuple[float, float] = (0.9, 1.8), default: float = 1.3, least_span: float = 8.0) -> DataFrame:
    """For each piece the similarity that takes its camera places (x, y, z) to their targets (tx, ty, tz): piece, scale,
    rotation (9), move (3), residual. A piece's own scale counts if its cameras span enough and it is in range, else the
    median of those that do, else the default."""
    inner = "piece string, scale double"

    def own_scale(pdf):
        s, t = pdf[["x", "z"]].to_numpy(float), pdf[["tx", "tz"]].to_numpy(float)
        span = np.linalg.norm(t.max(0) - t.min(0))
        found = similarity_scale(s, t) if len(s) > 1 and span >= least_span else None
        ok = found is not None and scales[0] <= found <= scales[1]
        return pd.DataFrame({"piece": [str(pdf["piece"].iloc[0])], "scale": [found if ok else np.nan]})

    named = pairs.withColumn("piece", F.col(piece).cast("string"))
    own = named.groupBy("piece").applyInPandas(own_scale, inner).withColumn("scale", F.nanvl("scale", F.lit(None).cast("double")))
    usual = own.agg(F.coalesce(F.median("scale"), F.lit(default)).alias("usual"))
    chosen = own.crossJoin(F.broadcast(usual)).select("piece", F.coalesce("scale", "usual").alias("scale"))  # one row

    def solve(pdf):
        s, t = pdf[["x", "y", "z"]].to_numpy(float), pdf[["tx", "ty", "tz"]].to_numpy(float)
        scale = float(pdf["scale"].iloc[0])
        w = pdf["weight"].to_numpy(float) if "weight" in pdf else np.ones(len(s))
        r, m = rigid(s, t, w, scale)
        rest = np.linalg.norm((scale * s @ r.T + m) - t, axis=1)
        return pd.DataFrame({"piece": [pdf["piece"].iloc[0]], "scale": [scale], "rotation": [r.ravel().tolist()], "move": [m.tolist()], "residual": [float(rest.mean())]})

    return named.join(chosen, "piece").groupBy("piece").applyInPandas(solve, "piece string, scale double, rotation array<double>, move array<double>, residual double")


def normals(neighbours: DataFrame, key: Sequence[str], coords: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """The normal of each point from its neighbours' spread: the direction they vary least in. Sums are aggregated in
    part; only 3 x 3 matrices reach Python."""
    pairs = [(a, b) for i, a in enumerate(coords) for b in coords[i:]]
    moments = neighbours.groupBy(*key).agg(*[F.covar_pop(f"{a}_r", f"{b}_r").alias(f"m{k}") for k, (a, b) in enumerate(pairs)], F.count("*").alias("n"))

    @pandas_udf("array<double>")
    def least(m: pd.DataFrame) -> pd.Series:
        v = m.to_numpy(float)
        full = np.stack([v[:, [0, 1, 2]], v[:, [1, 3, 4]], v[:, [2, 4, 5]]], axis=1)
        return pd.Series(list(np.linalg.eigh(full)[1][:, :, 0]))

    return moments.where("n >= 3").select(*key, least(F.struct(*[f"m{k}" for k in range(6)])).alias("normal"))


def point_normals(points: DataFrame, key: Sequence[str], coords: Sequence[str], k: int, radius: float, ties: Sequence[str]) -> DataFrame:
    """The normal of each point (unique by key) from its k nearest within radius, fitted once for each place."""
    own, best = near.ranked(points, points, coords, k, radius, ties)
    return own.select(*key, "__l").join(normals(best, ["__l"], coords), "__l").drop("__l")


def line_fit(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def straight_share(rows: DataFrame, by: Sequence[str], x: str, y: str, tolerance: float) -> DataFrame:
    """The share of each group's rows within a tolerance of its fitted line, for telling poles."""
    fitted = rows.join(line_fit(rows, by, x, y), list(by))
    return fitted.groupBy(*by).agg(F.avg((F.abs(F.col(y) - F.col("slope") * F.col(x) - F.col("intercept")) <= tolerance).cast("double")).alias("straight"), (F.max(y) - F.min(y)).alias("width"), (F.max(x) - F.min(x)).alias("height"))


def heading(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The turn (radians), scale and centres of a flat similarity from (x, y) to (tx, ty), in closed form from sums."""
    s = lambda e: F.sum(e)
    x, y, u, v = F.col("x"), F.col("y"), F.col("tx"), F.col("ty")
    sums = pairs.groupBy(*by).agg(F.count("*").alias("n"), s(x).alias("sx"), s(y).alias("sy"), s(u).alias("su"), s(v).alias("sv"), s(x * u + y * v).alias("dot"), s(x * v - y * u).alias("cross"), s(x * x + y * y).alias("xx"))
    n = F.col("n")
    dot, cross = F.col("dot") - (F.col("sx") * F.col("su") + F.col("sy") * F.col("sv")) / n, F.col("cross") - (F.col("sx") * F.col("sv") - F.col("sy") * F.col("su")) / n
    spread = F.col("xx") - (F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy")) / n
    return sums.select(*by, F.atan2(cross, dot).alias("turn"), (F.hypot(dot, cross) / F.nullif(spread, F.lit(0.0))).alias("scale"), (F.col("su") / n).alias("cx"), (F.col("sv") / n).alias("cy"))


def bounded_shifts(steps: DataFrame, most: float = 0.4, stay: float = 1.0) -> DataFrame:
    """(piece, shift) of pieces whose heights differ by steps (piece_a, piece_b, step, cells): least squares with a pull
    to stay and shifts within +-most, by projected sweeps over pieces. Pieces of one scene are few; scenes (column
    scene) run in parallel."""

    def solve(pdf):
        names = sorted(set(pdf.piece_a) | set(pdf.piece_b))
        at = {n: k for k, n in enumerate(names)}
        a, b = pdf.piece_a.map(at).to_numpy(), pdf.piece_b.map(at).to_numpy()
        w, d, x = pdf.cells.to_numpy(float), pdf.step.to_numpy(float), np.zeros(len(names))
        w = w / w.max()
        for _ in range(500):
            before = x.copy()
            for k in range(len(names)):
                i, j = a == k, b == k
                pull = (w[i] * (x[b[i]] + d[i])).sum() + (w[j] * (x[a[j]] - d[j])).sum()
                x[k] = np.clip(pull / (w[i].sum() + w[j].sum() + stay * 0.01), -most, most)
            if np.abs(x - before).max() < 1e-10:
                break
        return pd.DataFrame({"scene": [str(pdf.scene.iloc[0])] * len(names), "piece": [str(n) for n in names], "shift": x})

    return steps.withColumn("scene", F.col("scene").cast("string")).groupBy("scene").applyInPandas(solve, "scene string, piece string, shift double")
