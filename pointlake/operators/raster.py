"""Rasters as tables of cells: sampling, smoothing, filling, sight."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bilinear(points: DataFrame, raster: DataFrame, x: str, y: str, value: str, name: str) -> DataFrame:
    """A raster's value (px, py, value) at places in pixels, from the four pixels around; missing ones don't count."""
    u, v = F.col(x) - 0.5, F.col(y) - 0.5
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    named = points.withColumn("__id", F.monotonically_increasing_id()).withColumn("__i", F.floor(u)).withColumn("__j", F.floor(v)).withColumn("__u", u - F.floor(u)).withColumn("__v", v - F.floor(v))
    share = lambda f, c: F.when(c == 1, f).otherwise(1 - f)
    wide = named.withColumn("c", F.explode(corners)).withColumn("__w", share(F.col("__u"), F.col("c.a")) * share(F.col("__v"), F.col("c.b"))).withColumn("px", F.col("__i") + F.col("c.a")).withColumn("py", F.col("__j") + F.col("c.b"))
    met = wide.join(raster.where(F.col(value).isNotNull() & ~F.isnan(value)).select("px", "py", F.col(value).alias("__value")), ["px", "py"], "left")
    known = F.when(F.col("__value").isNotNull(), F.col("__w"))
    summed = met.groupBy("__id", *points.columns).agg(F.when(F.sum(known) > 0, F.sum(known * F.col("__value")) / F.sum(known)).alias(name))
    return summed.drop("__id")


def smoothed(cells: DataFrame, value: str, sigma: float, name: str, only_known: bool = True) -> DataFrame:
    """Gaussian smoothing of a sparse raster (i, j, value), normalised by the weight of the cells there are; with
    only_known false also cells without a value but near one. The kernel is a product, so one pass goes along i and one
    along j: a cell has rows in proportion to its reach, not to the square of it."""
    reach = int(4 * sigma + 0.5)
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(math.exp(-a * a / (2 * sigma * sigma))).alias("w")) for a in range(-reach, reach + 1)])
    sums = cells.where(F.col(value).isNotNull()).select("i", "j", F.col(value).cast("double").alias("__v"), F.lit(1.0).alias("__n"))
    for axis in ("i", "j"):
        spread = sums.withColumn("o", F.explode(offsets)).withColumn(axis, F.col(axis) + F.col("o.a"))
        sums = spread.groupBy("i", "j").agg(*[F.sum(F.col("o.w") * F.col(k)).alias(k) for k in ("__v", "__n")])
    out = sums.select("i", "j", (F.col("__v") / F.col("__n")).alias(name))
    return cells.join(out, ["i", "j"], "left" if only_known else "outer")


def filled(cells: DataFrame, wanted: DataFrame, value: str, sigmas: Sequence[float] = (1, 2, 4, 8)) -> DataFrame:
    """Wanted cells (i, j) with their value, else that smoothed over the least sigma that reaches them."""
    out = wanted.join(cells.select("i", "j", value), ["i", "j"], "left")
    for k, sigma in enumerate(sigmas):
        spread = smoothed(cells.select("i", "j", value), value, sigma, f"__s{k}", only_known=False).select("i", "j", f"__s{k}")
        out = out.join(spread, ["i", "j"], "left")
    return out.withColumn(value, F.coalesce(value, *[f"__s{k}" for k in range(len(sigmas))])).select(*wanted.columns, value)


def dilated(cells: DataFrame, steps: int = 1) -> DataFrame:
    """Cells (i, j) and all that touch them, so many times over."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1)])
    return cells.withColumn("o", F.explode(offsets)).select((F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j")).distinct()


def eroded(cells: DataFrame, steps: int = 1) -> DataFrame:
    """Cells all of whose neighbours so far are there."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-steps, steps + 1) for b in range(-steps, steps + 1)])
    near = cells.select("i", "j").distinct().withColumn("o", F.explode(offsets)).groupBy((F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j")).count()
    return near.where(F.col("count") == (2 * steps + 1) ** 2).select("i", "j")


def closed(cells: DataFrame, steps: int = 1) -> DataFrame:
    """Gaps up to twice as many cells wide are closed."""
    return eroded(dilated(cells, steps), steps)


def subdivided(cells: DataFrame, parts: int, size: float) -> DataFrame:
    """Centres (x, y) of parts x parts places in every cell of a size."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda k: (k + 0.5) / parts)
    return cells.withColumn("__a", F.explode(steps)).withColumn("__b", F.explode(steps)).withColumn("x", (F.col("i") + F.col("__a")) * size).withColumn("y", (F.col("j") + F.col("__b")) * size).drop("__a", "__b")


def distance_to(cells: DataFrame, targets: DataFrame, most: float) -> DataFrame:
    """Each cell (i, j) with the distance, in cells, to the nearest target cell within `most`, else null."""
    from pointlake.operators.spatial import nearest

    at = lambda df: df.withColumns({"x": F.col("i").cast("double"), "y": F.col("j").cast("double")})
    return nearest(at(cells), at(targets.select("i", "j")), ["i", "j"], ["x", "y"], most, ["i", "j"]).drop("x", "y")


def depth_buffer(points: DataFrame, camera: str, px: str, py: str, far: str, width: int, height: int) -> DataFrame:
    """Least range for each camera's pixel, each point covering its 3 x 3 pixels; columns wrap, rows end."""
    offsets = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    wide = points.withColumn("o", F.explode(offsets)).withColumn("__x", F.pmod(F.col(px) + F.col("o.a"), F.lit(width))).withColumn("__y", F.col(py) + F.col("o.b")).where(F.col("__y").between(0, height - 1))
    return wide.groupBy(camera, F.col("__x").alias(px), F.col("__y").alias(py)).agg(F.min(far).alias("depth"))


def visible(points: DataFrame, buffer: DataFrame, camera: str, px: str, py: str, far: str, slack: float = 0.1, most: float = 25.0, below: str | None = None, nadir: float = 70.0) -> DataFrame:
    """Points that no nearer point hides, within `most` and not under the camera."""
    out = points.join(buffer, [camera, px, py]).where((F.col(far) <= F.col("depth") + slack) & (F.col(far) < most))
    return out.where(F.col(below) < nadir) if below else out


def painted(seen: DataFrame, point: Sequence[str], camera: str, far: str, colours: Sequence[str], least: float = 0.01, fade: float = 2.0) -> DataFrame:
    """Colours of points from the cameras that see them, by exp(-(d - nearest) / fade) where that is over `least`;
    painter: the nearest camera, of equals the least."""
    near = seen.groupBy(*point).agg(F.min(far).alias("__near"))
    weighed = seen.join(near, list(point)).withColumn("__w", F.exp(-(F.col(far) - F.col("__near")) / F.lit(fade))).where(F.col("__w") > least)
    return weighed.groupBy(*point).agg(*[(F.sum(F.col("__w") * F.col(c)) / F.sum("__w")).alias(c) for c in colours], F.min(F.when(F.col(far) == F.col("__near"), F.col(camera))).alias("painter"))


def sight(points: DataFrame, camera: str, azimuth: str, elevation: str, far: str, step: float = 1.5) -> DataFrame:
    """Least range in each direction of a camera, and the share of the 3 x 3 directions around that have one; azimuths
    wrap."""
    around = int(round(360 / step))
    cells = points.groupBy(camera, F.pmod(F.floor(F.col(azimuth) / step), F.lit(around)).alias("a"), F.floor(F.col(elevation) / step).alias("e")).agg(F.min(far).alias(far))
    offsets = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x in (-1, 0, 1) for y in (-1, 0, 1)])
    near = cells.withColumn("o", F.explode(offsets)).groupBy(camera, F.pmod(F.col("a") + F.col("o.x"), F.lit(around)).alias("a"), (F.col("e") + F.col("o.y")).alias("e")).agg((F.count("*") / 9).alias("occupied"))
    return cells.join(near, [camera, "a", "e"])


def mask_of_classes(pixels: DataFrame, classes: Sequence[int], known: Sequence[int]) -> DataFrame:
    """Pixels of the classes; a class that doesn't exist raises ValueError."""
    if strange := sorted(set(classes) - set(known)):
        raise ValueError(f"unknown classes: {strange}")
    return pixels.where(F.col("class_id").isin(list(classes)))
