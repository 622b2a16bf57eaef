"""Choosing panoramas along a corridor: dots, capture dates, candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointlake.functions.geo import UNKNOWN_DATE, haversine_m
from pointlake.operators import graph, ranking
from pointlake.plans.steps import written


@dataclass(frozen=True)
class CorridorSettings:
    """Dates kept, candidates a dot, how near a start and a goal must be."""

    dates: int = 5
    candidates: int = 3
    start_m: float = 5.0
    goal_m: float = 15.0


def buckets(captures: DataFrame) -> DataFrame:
    """One row for each dot, date and panorama of captures (dot, date, id, ...); a capture's own pose counts, else its
    panorama's (columns pano_heading, pano_pitch, pano_roll)."""
    posed = captures.withColumns({k: F.coalesce(k, f"pano_{k}") for k in ("heading", "pitch", "roll")})
    return ranking.first_seen(posed, ["dot", "date", "id"], ["heading", "lat", "lon"])


def elevations(captures: DataFrame) -> DataFrame:
    """Each dot's first known elevation, in the order of its captures."""
    return captures.where("elevation is not null").groupBy("dot").agg(F.min_by("elevation", F.struct("seq", "id")).alias("elevation"))


def date_coverage(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("date").agg(F.countDistinct("dot").alias("dots"))


def rank_dates(candidates: DataFrame) -> list[str]:
    """All dates: most dots that no earlier one covers, then most dots, then newest; the unknown date is oldest."""
    return graph.greedy_order(candidates, "date", "dot", lambda d: "" if d == UNKNOWN_DATE else d)


def nearest_candidates(candidates: DataFrame, dots: DataFrame, k: int) -> DataFrame:
    """Each dot's k closest candidates of each date, with their rank."""
    far = haversine_m(F.col("dot_lat"), F.col("dot_lon"), F.col("lat"), F.col("lon"))
    placed = candidates.join(dots.select(F.col("node").alias("dot"), F.col("lat").alias("dot_lat"), F.col("lon").alias("dot_lon")), "dot").withColumn("far", far)
    return ranking.top_by(placed, ["dot", "date"], [F.col("far"), F.col("id")], k)


def date_graphs(candidates: DataFrame, dots: DataFrame, edges: DataFrame, start: tuple[float, float], goals: DataFrame, settings: CorridorSettings = CorridorSettings()) -> DataFrame:
    """Candidates of the best dates that lead from the start to a goal, with the date's place. ValueError without goals
    or if no date connects."""
    if goals.isEmpty():
        raise ValueError("no goals")
    near = written(nearest_candidates(candidates, dots, settings.candidates))
    kept = []
    for date in rank_dates(near):
        if graph.connects(dots, edges, near.where(F.col("date") == date).select(F.col("dot").alias("node")), start, goals, settings.start_m, settings.goal_m):
            kept.append(date)
        if len(kept) == settings.dates:
            break
    if not kept:
        raise ValueError("no date leads from the start to a goal")
    place = F.array_position(F.array(*[F.lit(d) for d in kept]), F.col("date"))
    return near.where(F.col("date").isin(kept)).withColumn("place", place)


def downloaded(chosen: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates whose file is there (key, path); dots and dates without any vanish."""
    return chosen.join(files.where("path is not null").select("key", "path"), "key")


def assemble(segments: DataFrame, clouds: DataFrame, voxel_m: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """(node of each dot, thinned clouds): the biggest piece has a dot (segments: piece, dot, key, size), and its cloud
    (key, x, y, z, r, g, b) is thinned to voxels."""
    from pointlake.operators.cells import voxel_mean

    owners = ranking.biggest_piece(segments, "dot", "piece", "size")
    kept = clouds.join(owners.select("key").distinct(), "key", "left_semi")
    return owners, voxel_mean(kept, ["x", "y", "z"], ["r", "g", "b"], voxel_m, by=["key"])


def grow(panos: DataFrame, links: DataFrame, start: str, inside: DataFrame, most: int = 2000) -> DataFrame:
    """Panoramas that a walk from a start reaches over links within an area (ids), in waves, up to a number."""
    reached = graph.reached(panos.where(F.col("node") == start).select("node"), links, inside)
    return reached.orderBy("hops", "node").limit(most)


def nearby(panos: DataFrame, links: DataFrame, lat: float, lon: float, radius: float = 350.0, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of the closest panoramas round a place; links have both ends among them, once each."""
    from pointlake.operators.spatial import both_ends, undirected

    far = haversine_m(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    nodes = panos.withColumn("far", far).where(F.col("far") <= radius).orderBy("far", "node").limit(most)
    return nodes, both_ends(undirected(links, "a", "b"), nodes, "node").orderBy("a", "b")


def good_patches(dots: DataFrame, edges: DataFrame, good: DataFrame, least: int = 4) -> DataFrame:
    """Dots that no piece of `least` dots or more has, and those next to them. good: (piece, node)."""
    big = good.groupBy("piece").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    covered = good.join(big, "piece", "left_semi").select("node").distinct()
    left = dots.select("node").join(covered, "node", "left_anti")
    return graph.reached(left, edges, most_rounds=1).select("node")
