"""Map features' tags (map<string,string>) as sizes and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A storey's height, a lane's width, the width of roads of other kinds, the height of other buildings.
LEVEL_M, LANE_M, NARROW_M, DEFAULT_BUILDING_M, MIN_BUILDING_M = 3.2, 3.2, 2.0, 12.0, 2.5
#: Heights of buildings by kind.
BUILDING_M = {"house": 7, "detached": 7, "semidetached_house": 7, "terrace": 7, "bungalow": 5, "roof": 4, "shed": 3, "garage": 3, "garages": 3, "carport": 3, "hut": 3, "kiosk": 3}
#: Widths of roads by kind.
ROAD_M = {
    "motorway": 14, "trunk": 12, "primary": 10, "secondary": 9, "tertiary": 8, "motorway_link": 6, "trunk_link": 6, "primary_link": 6, "secondary_link": 6,
    "tertiary_link": 6, "residential": 6, "unclassified": 6, "living_street": 5, "service": 4, "pedestrian": 4, "track": 3,
}
#: Kinds of ways that are paths, and the sixteen directions of the compass.
PATHS = ["footway", "path", "pedestrian", "steps", "cycleway", "bridleway"]
COMPASS = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()


def _lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))]), key)


def number(tags: Column, key: str) -> Column:
    """A tag's leading number, with a point or a comma, else null."""
    first = F.get(F.split(F.trim(F.element_at(tags, key)), r"\s+"), 0)
    return F.replace(first, F.lit(","), F.lit(".")).try_cast("double")


def not_negative(tags: Column, key: str) -> Column:
    value = number(tags, key)
    return F.when(value >= 0, value)


def positive(tags: Column, key: str) -> Column:
    value = number(tags, key)
    return F.when(value > 0, value)


def building_kind(tags: Column) -> Column:
    return F.coalesce(F.element_at(tags, "building"), F.element_at(tags, "building:part"), F.lit("yes"))


def building_height(tags: Column) -> tuple[Column, Column]:
    """(metres, whether they are a guess): the height, else storeys, else the kind's."""
    levels = (positive(tags, "building:levels") + F.coalesce(positive(tags, "roof:levels"), F.lit(0.0))) * LEVEL_M
    known = F.coalesce(positive(tags, "height"), levels)
    return F.coalesce(known, _lookup(BUILDING_M, building_kind(tags)), F.lit(DEFAULT_BUILDING_M)), known.isNull()


def building_base(tags: Column, height: Column) -> Column:
    """Metres above ground at which a part begins; never so high that less than the least height is left."""
    base = F.coalesce(not_negative(tags, "min_height"), F.coalesce(not_negative(tags, "building:min_level"), F.lit(0.0)) * LEVEL_M)
    return F.least(base, F.greatest(height - MIN_BUILDING_M, F.lit(0.0)))


def roof_height(tags: Column, height: Column, base: Column) -> Column:
    """Metres of roof that tags give, null if none; no more than there is of the building."""
    given = F.coalesce(not_negative(tags, "roof:height"), positive(tags, "roof:levels") * LEVEL_M)
    return F.least(given, height - base)


def road_width(tags: Column) -> Column:
    return F.coalesce(positive(tags, "width"), positive(tags, "lanes") * LANE_M, _lookup(ROAD_M, F.element_at(tags, "highway")), F.lit(NARROW_M))


def layer(tags: Column) -> Column:
    """The layer of a way; of several the first, 0 if there is none, null if it is no number."""
    return F.get(F.split(F.coalesce(F.element_at(tags, "layer"), F.lit("0")), ";"), 0).try_cast("double")


def on_open_ground(tags: Column) -> Column:
    """Whether a way is no tunnel, bridge or indoor way and on layer 0; layers that can't be read don't count."""
    plain = [F.coalesce(F.element_at(tags, k), F.lit("no")) == "no" for k in ("tunnel", "bridge", "indoor")]
    return plain[0] & plain[1] & plain[2] & F.coalesce(layer(tags) == 0, F.lit(True))


def is_area(tags: Column, geometry: Column) -> Column:
    """Whether a way is a square: tagged so, and closed with three corners at least."""
    closed = (F.size(geometry) >= 4) & (F.get(geometry, 0) == F.element_at(geometry, -1))
    return F.coalesce((F.element_at(tags, "area") == "yes") & closed, F.lit(False))


def is_path(tags: Column) -> Column:
    return F.coalesce(F.element_at(tags, "highway").isin(PATHS), F.lit(False))


def roof_direction(text: Column) -> Column:
    """Degrees from north of a compass point or a number, else null."""
    t = F.upper(F.trim(text))
    named = F.element_at(F.create_map(*[F.lit(x) for k, name in enumerate(COMPASS) for x in (name, 22.5 * k)]), t)
    return F.coalesce(named, F.pmod(t.try_cast("double"), F.lit(360.0)))


def built_before(tags: Column, year: int = 1945) -> Column:
    """Whether the first year in a building's start date is before `year`; null without one."""
    found = F.regexp_extract(F.element_at(tags, "start_date"), r"(\d{4})", 1)
    return F.nullif(found, F.lit("")).try_cast("int") < year


def place_name(tags: Column, groups: list[list[str]]) -> Column:
    """The first tag there is of each group of keys, without repeats, joined by commas."""
    found = F.array(*[F.coalesce(*[F.element_at(tags, k) for k in keys]) for keys in groups])
    return F.array_join(F.array_distinct(F.array_compact(found)), ", ")
