"""Rings, roofs, cameras and matrices as column expressions over arrays of structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def segments(ring: Column) -> Column:
    """A ring's sides, as structs a and b of neighbouring corners."""
    n = F.size(ring)
    return F.when(n > 1, F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).otherwise(F.array().cast("array<struct<a:struct<x:double,y:double>,b:struct<x:double,y:double>>>"))


def twice_area(ring: Column) -> Column:
    """Signed: above 0 counter-clockwise."""
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])


def perimeter(ring: Column) -> Column:
    return F.aggregate(segments(ring), F.lit(0.0), lambda s, e: s + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray from a place crosses a closed ring's sides an odd number of times."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.nullif(e["b"]["y"] - e["a"]["y"], F.lit(0.0)) + e["a"]["x"])
    return F.aggregate(segments(ring), F.lit(False), lambda s, e: s != F.coalesce(crosses(e), F.lit(False)))


def circle(x: Column, y: Column, radius: Column, corners: int) -> Column:
    """A closed ring of so many corners."""
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), lambda k: F.struct((x + radius * F.cos(2 * F.pi() * (k % corners) / corners)).alias("x"), (y + radius * F.sin(2 * F.pi() * (k % corners) / corners)).alias("y")))


def rectangle(x: Column, y: Column, along: Column, across: Column, angle: Column) -> Column:
    """A closed ring: a rectangle about its centre, turned by an angle."""
    corner = lambda u, v: F.struct((x + along * u * F.cos(angle) - across * v * F.sin(angle)).alias("x"), (y + along * u * F.sin(angle) + across * v * F.cos(angle)).alias("y"))
    return F.array(*[corner(u, v) for u, v in ((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5))])


def affine(matrix: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """A place under a 4 x 4 transform, given as 16 numbers row by row."""
    row = lambda k: F.get(matrix, 4 * k) * x + F.get(matrix, 4 * k + 1) * y + F.get(matrix, 4 * k + 2) * z + F.get(matrix, 4 * k + 3)
    return row(0), row(1), row(2)


def look(rotation: Column, dx: Column, dy: Column, dz: Column) -> tuple[Column, Column, Column, Column]:
    """(u, v, range, degrees below the horizon) at which a panorama sees a place so far from it: u and v are shares
    of its width and height. rotation: 9 numbers row by row, from world to panorama; y points down."""
    row = lambda k: F.get(rotation, 3 * k) * dx + F.get(rotation, 3 * k + 1) * dy + F.get(rotation, 3 * k + 2) * dz
    x, y, z = row(0), row(1), row(2)
    far = F.sqrt(x * x + y * y + z * z)
    below = F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), y / F.greatest(far, F.lit(1e-9))))))
    return F.pmod(F.atan2(x, z) / (2 * F.pi()) + 0.5, F.lit(1.0)), 0.5 + below / 180, far, below


def pixel(u: Column, v: Column, width: int, height: int) -> tuple[Column, Column]:
    """The pixel at shares of an image's width, which wraps, and height, which doesn't."""
    return F.pmod(F.floor(u * width).cast("int"), F.lit(width)), F.least(F.greatest(F.floor(v * height).cast("int"), F.lit(0)), F.lit(height - 1))


def roof_rise(shape: Column, across: Column, inward: Column, up: Column) -> Column:
    """The share of a roof's height at a place. across: from -1 to 1 over the roof's width; inward: from 0 at the
    outline to 1 at the centre; up: from 0 to 1 down a lean-to's slope."""
    arch = F.sin(F.least(F.greatest(inward, F.lit(0.0)), F.lit(1.0)) * F.pi() / 2)
    return (
        F.when(shape.isin("gabled", "saltbox"), 1 - F.abs(across))
        .when(shape == "skillion", up)
        .when(shape.isin("pyramidal", "cone", "hipped"), inward)
        .when(shape.isin("dome", "round"), arch)
        .when(shape == "onion", inward)
        .otherwise(F.lit(0.0))
    )
