"""Distances, local metres, tiles, dates and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The earth's radius, and metres in a degree of latitude.
EARTH_M, DEGREE_M = 6371000.0, 111320.0
#: Fixed value: the date of a panorama without one.
UNKNOWN_DATE = "unknown date"


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres."""
    half = lambda x, y: F.pow(F.sin(F.radians(y - x) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def local_m(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(east, north) metres from an origin on a flat earth."""
    return (lon - lon0) * DEGREE_M * F.cos(F.radians(lat0)), (lat - lat0) * DEGREE_M


def from_local_m(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(lat, lon) of metres from an origin; undoes local_m()."""
    return lat0 + north / DEGREE_M, lon0 + east / (DEGREE_M * F.cos(F.radians(lat0)))


def parse_latlon(text: Column) -> tuple[Column, Column]:
    """(lat, lon) of a map address with /@lat,lon or of "lat,lon" alone, else nulls."""
    number = r"(-?\d+(?:\.\d+)?)"
    in_url, alone = f"@{number},{number}", f"^{number}\\s*,\\s*{number}$"
    found = lambda k: F.coalesce(F.nullif(F.regexp_extract(F.trim(text), in_url, k), F.lit("")), F.nullif(F.regexp_extract(F.trim(text), alone, k), F.lit("")))
    return found(1).cast("double"), found(2).cast("double")


def tile_xy(lat: Column, lon: Column, zoom: int | Column) -> tuple[Column, Column]:
    """Web-mercator tile coordinates with fractions."""
    n = F.pow(F.lit(2.0), zoom if isinstance(zoom, Column) else F.lit(float(zoom)))
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2 * n


def tile_latlon(x: Column, y: Column, zoom: int) -> tuple[Column, Column]:
    """(lat, lon) of fractional tile coordinates."""
    n = float(2**zoom)
    return F.degrees(F.atan(F.sinh(F.pi() * (1 - 2 * y / n)))), x / n * 360 - 180


def image_zoom(lat: Column, spacing: Column) -> Column:
    """The zoom whose pixels are about `spacing` metres: 11 to 18."""
    return F.least(F.greatest(F.floor(F.log2(156543.03 * F.cos(F.radians(lat)) / spacing)), F.lit(11)), F.lit(18)).cast("int")


def capture_date(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD, YYYY-MM without a day, and the unknown date without year or month."""
    month_text = F.format_string("%04d-%02d", year.cast("int"), month.cast("int"))
    return F.when(year.isNull() | month.isNull(), F.lit(UNKNOWN_DATE)).when(day.isNull(), month_text).otherwise(F.format_string("%s-%02d", month_text, day.cast("int")))


def recency(date: Column) -> Column:
    """Sorts as dates do, with the unknown date as the oldest."""
    return F.when(date == UNKNOWN_DATE, F.lit("")).otherwise(date)


def pano_key(source: Column, ident: Column) -> Column:
    return F.concat_ws(":", source, ident)


def key_parts(key: Column) -> tuple[Column, Column]:
    """(source, id); the id keeps colons of its own."""
    parts = F.split(key, ":", 2)
    return F.get(parts, 0), F.get(parts, 1)


#: Fixed values: (name, least and greatest latitude, least and greatest longitude); the first that holds counts.
REGIONS = [
    ("korea", 33.0, 38.7, 124.5, 129.6),
    ("japan", 24.0, 46.0, 122.9, 146.0),
    ("southeast_asia", -11.0, 21.5, 92.0, 141.0),
    ("south_asia", 5.0, 35.0, 60.0, 89.0),
    ("east_asia", 18.0, 54.0, 89.0, 135.0),
    ("europe_south", 34.0, 45.5, -10.0, 30.0),
    ("europe_north", 45.5, 72.0, -25.0, 45.0),
    ("middle_east", 12.0, 42.0, -18.0, 60.0),
    ("north_america", 24.0, 72.0, -170.0, -50.0),
    ("latin_america", -56.0, 24.0, -118.0, -34.0),
]


def region(lat: Column, lon: Column) -> Column:
    """The name of the region a place is in, or "other"."""
    inside = [F.when(lat.between(a, b) & lon.between(c, d), F.lit(name)) for name, a, b, c, d in REGIONS]
    return F.coalesce(*inside, F.lit("other"))


#: Codes of countries that drive on the left.
DRIVE_LEFT = (
    "GB IE IM JE GG MT CY JP SG MY BN HK MO TH ID TL IN LK BD BT NP PK MV AU NZ PG FJ WS TO SB KI TV NR CK NU ZA NA BW ZW ZM MW MZ TZ KE UG LS SZ MU "
    "SC JM TT BB BS GY SR AG DM GD KN LC VC VG VI KY BM FK AI MS TC SH"
).split()


def driving_side(country: Column) -> Column:
    return F.when(F.coalesce(country.isin(DRIVE_LEFT), F.lit(False)), F.lit("left")).otherwise(F.lit("right"))


def relative_path(path: Column) -> Column:
    """Whether a path stays inside its folder: not empty or absolute, no "..", backslash or colon."""
    return F.coalesce((F.length(path) > 0) & ~path.startswith("/") & ~path.rlike(r"[\\:]") & ~path.rlike(r"(^|/)\.\.(/|$)"), F.lit(False))


def expected_seconds(spots: Column, effort: str) -> Column:
    """Computing time of a reconstruction: a fixed part and so much for each spot."""
    per_spot = {"quick": 4, "normal": 8, "thorough": 14}[effort]
    return 5 + spots * per_spot + 10


def expected_other_seconds(spots: Column) -> Column:
    return 90 + 4 * spots


def positive_number(text: Column) -> Column:
    """A typed number above zero, else null."""
    value = text.try_cast("double")
    return F.when((value > 0) & (value < F.lit(float("inf"))), value)
