"""Rows from shapes: points on quads, walls, roads and boxes. All are sequences and explodes over one shape a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _steps(length: Column, gap: Column | float) -> Column:
    """Middles of equal parts of at most `gap`, as shares of a length."""
    n = F.greatest(F.ceil(length / (gap if isinstance(gap, Column) else F.lit(gap))), F.lit(1))
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: (k + 0.5) / n)


def on_quads(quads: DataFrame, gap: float) -> DataFrame:
    """Points about `gap` apart on quads given by a corner (x, y, z) and two sides (ux, uy, uz), (vx, vy, vz)."""
    size = lambda p: F.sqrt(F.pow(F.col(f"{p}x"), 2) + F.pow(F.col(f"{p}y"), 2) + F.pow(F.col(f"{p}z"), 2))
    wide = quads.withColumn("u", F.explode(_steps(size("u"), gap))).withColumn("v", F.explode(_steps(size("v"), gap)))
    place = {f"p{c}": F.col(c) + F.col(f"u{c}") * F.col("u") + F.col(f"v{c}") * F.col("v") for c in "xyz"}
    return wide.withColumns(place)


def walls(outlines: DataFrame, ident: str, ring: str = "ring", base: str = "base_m", height: str = "height_m") -> DataFrame:
    """The walls of outlines as quads: a row for each side, with its number and outward normal."""
    n = F.size(ring)
    sides = outlines.where(n > 1).select(ident, F.col(base), F.col(height), F.posexplode(F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("edge", "s"))
    dx, dy = F.col("s.b.x") - F.col("s.a.x"), F.col("s.b.y") - F.col("s.a.y")
    long = F.hypot(dx, dy)
    return sides.where(long > 0).select(ident, "edge", F.col("s.a.x").alias("x"), F.col("s.a.y").alias("y"), F.col(base).alias("z"), dx.alias("ux"), dy.alias("uy"), F.lit(0.0).alias("uz"), F.lit(0.0).alias("vx"), F.lit(0.0).alias("vy"), (F.col(height) - F.col(base)).alias("vz"), (dy / long).alias("nx"), (-dx / long).alias("ny"))


def wall_points(outlines: DataFrame, ident: str, gap: float, **names: str) -> DataFrame:
    """Points on the walls of outlines."""
    return on_quads(walls(outlines, ident, **names), gap).select(ident, "edge", F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"), "nx", "ny", "u", "v")


def roof_points(outlines: DataFrame, ident: str, gap: float, shape: str = "roof", ring: str = "ring", height: str = "height_m", roof_m: str = "roof_m") -> DataFrame:
    """Points on roofs: a grid over each outline's box, kept inside it, raised by the roof's shape across its box."""
    from pointlake.functions.shapes import inside_ring, roof_rise

    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    boxed = outlines.withColumns({"x0": F.array_min(xs), "x1": F.array_max(xs), "y0": F.array_min(ys), "y1": F.array_max(ys)})
    grid = boxed.withColumn("__u", F.explode(_steps(F.col("x1") - F.col("x0"), gap))).withColumn("__v", F.explode(_steps(F.col("y1") - F.col("y0"), gap)))
    placed = grid.withColumn("x", F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("__u")).withColumn("y", F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("__v")).where(inside_ring(F.col("x"), F.col("y"), F.col(ring)))
    inward = 1 - F.greatest(F.abs(2 * F.col("__u") - 1), F.abs(2 * F.col("__v") - 1))
    rise = roof_rise(F.col(shape), 2 * F.col("__v") - 1, inward, F.col("__v"))
    return placed.select(ident, "x", "y", (F.col(height) - F.col(roof_m) * (1 - rise)).alias("z"))


def road_points(stretches: DataFrame, ident: str, gap: float) -> DataFrame:
    """Points on straight stretches (x0, y0, x1, y1, width): across from kerb to kerb, with the place across in metres."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = F.hypot(dx, dy)
    wide = stretches.where(long > 0).withColumn("u", F.explode(_steps(long, gap))).withColumn("v", F.explode(_steps(F.col("width"), gap)))
    off = (F.col("v") - 0.5) * F.col("width")
    return wide.select(ident, (F.col("x0") + dx * F.col("u") - dy / long * off).alias("x"), (F.col("y0") + dy * F.col("u") + dx / long * off).alias("y"), off.alias("across"))


def lane_marks(stretches: DataFrame, ident: str, lanes: str = "lanes", dash: float = 3.0, space: float = 6.0) -> DataFrame:
    """Dashes between the lanes of straight stretches: a row each, by its two ends."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    long = F.hypot(dx, dy)
    marked = stretches.where((F.col(lanes) > 1) & (long >= dash)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col(lanes).cast("int") - 1))).withColumn("n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((long - dash) / (dash + space))))).withColumn("at", F.col("n") * (dash + space))
    off = (F.col("k") / F.col(lanes) - 0.5) * F.col("width")
    end = lambda t, c: (F.col("x0") + dx / long * t - dy / long * off) if c == "x" else (F.col("y0") + dy / long * t + dx / long * off)
    return marked.select(ident, "k", *[end(F.col("at") + (dash if e else 0.0), c).alias(f"{c}{e}") for e in (0, 1) for c in "xy"])


def pavements(stretches: DataFrame, ident: str, tags: str = "tags", width: float = 2.5, lift: float = 0.15) -> DataFrame:
    """Strips beside stretches whose tags say there is a pavement: side (left, right), offset and height."""
    tag = F.lower(F.coalesce(F.element_at(tags, "sidewalk"), F.lit("no")))
    sides = F.when(tag.isin("both", "yes"), F.array(F.lit("left"), F.lit("right"))).when(tag.isin("left", "right"), F.array(tag)).otherwise(F.array().cast("array<string>"))
    off = (F.col("width") + width) / 2
    return stretches.withColumn("side", F.explode(sides)).withColumn("offset", F.when(F.col("side") == "left", off).otherwise(-off)).withColumn("lift", F.lit(lift)).select(ident, "side", "offset", "lift", F.lit(width).alias("strip_m"), "x0", "y0", "x1", "y1")


def boxes(places: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The six faces of boxes (x, y, z, sx, sy, sz) as quads."""
    face = lambda o, u, v: F.struct(*[F.lit(float(a)).alias(f"{n}{c}") for n, t in (("o", o), ("u", u), ("v", v)) for c, a in zip("xyz", t, strict=True)])
    faces = [((0, 0, 0), (1, 0, 0), (0, 1, 0)), ((0, 0, 1), (1, 0, 0), (0, 1, 0)), ((0, 0, 0), (1, 0, 0), (0, 0, 1)), ((0, 1, 0), (1, 0, 0), (0, 0, 1)), ((0, 0, 0), (0, 1, 0), (0, 0, 1)), ((1, 0, 0), (0, 1, 0), (0, 0, 1))]
    wide = places.select("*", F.posexplode(F.array(*[face(*f) for f in faces])).alias("face", "f"))
    return wide.select(*keep, "face", *[(F.col(c) + F.col(f"f.o{c}") * F.col(f"s{c}")).alias(c) for c in "xyz"], *[(F.col(f"f.{n}{c}") * F.col(f"s{c}")).alias(f"{n}{c}") for n in "uv" for c in "xyz"])


def lattice_points(cameras: DataFrame, levels: Sequence[tuple[float, float]]) -> DataFrame:
    """Places round cameras (camera, x, y) on nested grids: (reach, gap) from near to far, each without the nearer ones'
    squares, jittered by a hash and so the same every time."""
    from pointlake.functions.shade import mixed

    out, inner = None, 0.0
    for k, (reach, gap) in enumerate(levels):
        n = int(reach / gap)
        grid = cameras.withColumn("i", F.explode(F.sequence(F.lit(-n), F.lit(n)))).withColumn("j", F.explode(F.sequence(F.lit(-n), F.lit(n)))).where(F.greatest(F.abs("i"), F.abs("j")) * gap >= inner)
        moved = grid.select("camera", F.lit(k).alias("level"), (F.col("x") + (F.col("i") + (mixed(F.col("i"), F.col("j")) - 0.5) * 0.5) * gap).alias("x"), (F.col("y") + (F.col("j") + (mixed(F.col("j"), F.col("i") + 7919) - 0.5) * 0.5) * gap).alias("y"))
        out = moved if out is None else out.unionByName(moved)
        inner = reach
    return out
