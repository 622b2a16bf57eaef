"""Blends, sizes, colours and noise as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def smoothstep(t: Column) -> Column:
    """0 below 0, 1 above 1, smooth between."""
    u = clip(t, 0.0, 1.0)
    return u * u * (3 - 2 * u)


def tint(own: Column, near: Column, distance: Column, start_m: float, band_m: float, strength: float) -> Column:
    """A colour mixed with a near one: by `strength` up to start_m, less and less over band_m; unchanged without one."""
    share = F.lit(strength) * (1 - smoothstep((distance - start_m) / band_m))
    return F.when(near.isNull() | F.isnan(near), own).otherwise(own * (1 - share) + near * share)


def meet(height: Column, ground: Column, distance: Column, band_m: float, most_m: float = float("inf")) -> Column:
    """A height drawn to the ground's at distance 0 and not at all from band_m on, unless they differ by more than
    most_m or there is no ground."""
    share = 1 - smoothstep(distance / band_m)
    return F.when(ground.isNull() | F.isnan(ground) | (F.abs(ground - height) > most_m), height).otherwise(height + (ground - height) * share)


def beneath(height: Column, ground: Column, inside: Column, under_m: float = 0.1, overlap_m: float = 1.0) -> tuple[Column, Column]:
    """(height, whether to keep it) of map ground that other ground lies over: under it near its edge, gone deeper in."""
    return F.when(inside > 0, F.least(height, ground - under_m)).otherwise(height), inside <= overlap_m


def point_size(distance: Column) -> Column:
    """Metres across of a map point so far from the scene's points; spacing is that by 2.2."""
    return 0.17 + 0.0154 * F.greatest(distance, F.lit(0.0))


def point_spacing(distance: Column) -> Column:
    return point_size(distance) / 2.2


def view_gap(distance: Column) -> Column:
    """Spacing of points that a viewer at this distance needs."""
    return 0.05 + 0.018 * distance


def gap_level(gap: Column) -> Column:
    """The least step 0.05 * 1.25 ** k that is not below a gap."""
    k = F.ceil(F.log(gap / 0.05) / F.log(F.lit(1.25)) - 1e-9)
    return 0.05 * F.pow(F.lit(1.25), F.greatest(k, F.lit(0)))


def closeness(distance: Column, nearest: Column) -> Column:
    """A weight that falls off with the distance beyond the nearest one's; 0 for what was not found."""
    return F.when(distance.isNull() | (distance == float("inf")), F.lit(0.0)).otherwise(F.exp(-(distance - nearest) / 2))


# sRGB to XYZ, row by row, and the D65 white.
_XYZ = [[0.4124, 0.3576, 0.1805], [0.2126, 0.7152, 0.0722], [0.0193, 0.1192, 0.9505]]
_WHITE = [0.9505, 1.0, 1.089]


def to_lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """sRGB shares to CIE Lab."""
    linear = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4)) for c in (clip(x, 0.0, 1.0) for x in (r, g, b))]
    f = []
    for row, white in zip(_XYZ, _WHITE, strict=True):
        t = (linear[0] * row[0] + linear[1] * row[1] + linear[2] * row[2]) / white
        f.append(F.when(t > 0.008856, F.pow(t, 1.0 / 3)).otherwise(7.787 * t + 16.0 / 116))
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _inverse(m: list[list[float]]) -> list[list[float]]:
    """Of a 3 x 3 matrix, by cofactors."""
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    whole = sum(m[0][j] * minor(0, j) for j in range(3))
    return [[minor(j, i) / whole for j in range(3)] for i in range(3)]


def from_lab(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE Lab to sRGB shares, clipped."""
    fy = (lightness + 16) / 116
    xyz = [F.when(f > 0.2069, F.pow(f, 3.0)).otherwise((f - 16.0 / 116) / 7.787) * w for f, w in zip((fy + a / 500, fy, fy - b / 200), _WHITE, strict=True)]
    out = []
    for row in _inverse(_XYZ):
        c = xyz[0] * row[0] + xyz[1] * row[1] + xyz[2] * row[2]
        out.append(clip(F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), 1 / 2.4) - 0.055), 0.0, 1.0))
    return tuple(out)


def noise(x: Column, y: Column) -> Column:
    """The same number from 0 to 1 for the same place, without a random state."""
    n = F.sin(x * 12.9898 + y * 78.233) * 43758.5453
    return n - F.floor(n)


def mixed(x: Column, y: Column) -> Column:
    """A number from 0 to 1 from two integers, by mixing bits."""
    return F.pmod(F.xxhash64(x.cast("long"), y.cast("long")), F.lit(1 << 20)) / float(1 << 20)


def hash_cell(i: Column, j: Column) -> Column:
    """A 64-bit key of a cell whose coordinates are within 2**20 of 0."""
    return F.shiftleft((i + (1 << 20)).cast("long"), 21).bitwiseOR((j + (1 << 20)).cast("long"))


def wave(t: Column, steps: list[tuple[float, float, float]]) -> Column:
    """A smooth line: a sum of (height, frequency, phase) sines."""
    parts = [F.lit(h) * F.sin(t * f + p) for h, f, p in steps]
    return sum(parts[1:], parts[0])


def terrarium_m(r: Column, g: Column, b: Column) -> Column:
    """Metres that an elevation tile's colour bytes stand for."""
    return r * 256 + g + b / 256.0 - 32768


def wetness(alpha: Column, red: Column) -> Column:
    """How often a place is under water, from a map's pixel; 0 where the map has nothing."""
    return F.when(alpha > 0, 1 - red / 255.0).otherwise(F.lit(0.0))


def is_water(wet: Column, height: Column) -> Column:
    return F.coalesce(wet >= 0.5, F.lit(False)) | F.coalesce(height <= 0.5, F.lit(False))


def parse_colour(text: Column) -> Column:
    """[r, g, b] shares of "#rgb", "#rrggbb" or a name, else null."""
    t = F.lower(F.trim(text))
    six = F.when(t.rlike("^#[0-9a-f]{6}$"), F.substring(t, 2, 6)).when(t.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(F.substring(t, 2, 3), "(.)", "$1$1"))
    part = lambda k: F.conv(F.substring(six, k, 2), 16, 10).cast("double") / 255
    named = F.element_at(F.create_map(*[x for k, v in NAMED_COLOURS.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))]), t)
    return F.when(six.isNotNull(), F.array(part(1), part(3), part(5))).otherwise(named)


#: Colours by name.
NAMED_COLOURS = {
    "white": (0.95, 0.95, 0.93),
    "grey": (0.6, 0.6, 0.6),
    "gray": (0.6, 0.6, 0.6),
    "black": (0.2, 0.2, 0.2),
    "red": (0.75, 0.3, 0.25),
    "brown": (0.55, 0.38, 0.26),
    "beige": (0.88, 0.8, 0.65),
    "yellow": (0.93, 0.83, 0.45),
    "orange": (0.9, 0.6, 0.3),
    "blue": (0.45, 0.6, 0.8),
    "green": (0.5, 0.7, 0.5),
    "pink": (0.93, 0.72, 0.75),
    "cream": (0.95, 0.9, 0.78),
    "tan": (0.82, 0.7, 0.55),
}
