"""Ground, clouds and water composed from the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.operators import cells, raster, spatial


def scene_ground(points: DataFrame, size: float = 0.5) -> DataFrame:
    """Height (up), colour and road share of each cell of painted ground (x, y down, z, r, g, b, road)."""
    keys = [cells.cell("x", size).alias("i"), cells.cell("z", size).alias("j")]
    return points.groupBy(*keys).agg(F.avg(-F.col("y")).alias("height"), *[F.avg(c).alias(c) for c in "rgb"], F.avg(F.col("road").cast("double")).alias("road"), F.count("*").alias("n"))


def covers(ground: DataFrame, places: DataFrame, size: float = 0.5) -> DataFrame:
    """Places (x, z) with the ground's cell under them, null where it has none."""
    return places.withColumn("i", cells.cell("x", size)).withColumn("j", cells.cell("z", size)).join(ground.select("i", "j", "height", "road"), ["i", "j"], "left")


def one_ground(points: DataFrame, size: float = 0.5, sigma: float = 1.0) -> DataFrame:
    """Ground of many clouds (cloud, x, z, height, far): medians by cell and cloud, blended to the nearest cloud's,
    smoothed."""
    named = points.withColumn("i", cells.cell("x", size)).withColumn("j", cells.cell("z", size))
    blended = cells.weighted_blend(named, ["i", "j"], "cloud", "height", "far")
    return raster.smoothed(blended, "height", sigma, "smooth")


def drop_blobs(points: DataFrame, cameras: DataFrame, voxel: float = 0.1, link: float = 0.25, least: int = 300, far_m: float = 25.0, sure_m: float = 12.0) -> DataFrame:
    """Points (cloud, id, x, y, z) without those in loose bits: kept are points near their camera or confirmed by another
    cloud, and those whose voxels hang together with `least` voxels."""
    from pointlake.operators.graph import components

    coords = ["x", "y", "z"]
    own = points.join(cameras.select("cloud", *[F.col(c).alias(f"c{c}") for c in coords]), "cloud")
    far = own.withColumn("far", spatial.distance([F.col(c) for c in coords], [F.col(f"c{c}") for c in coords])).drop(*[f"c{c}" for c in coords])
    agreed = spatial.confirmed(points, cameras).select("cloud", "id").withColumn("agreed", F.lit(True))
    named = far.join(agreed, ["cloud", "id"], "left").withColumn("sure", (F.col("far") <= sure_m) | ((F.col("far") <= far_m) & F.coalesce("agreed", F.lit(False))))
    boxes = points.select("cloud", *[cells.cell(c, voxel).alias(f"v{c}") for c in coords]).distinct().withColumn("node", F.xxhash64("cloud", "vx", "vy", "vz"))
    centres = boxes.select("cloud", "node", *[(F.col(f"v{c}") * voxel).alias(c) for c in coords])
    links = spatial.within(centres, centres, coords, link).where((F.col("cloud") == F.col("cloud_r")) & (F.col("node") < F.col("node_r"))).select(F.col("node").alias("a"), F.col("node_r").alias("b"))
    group = components(centres, "node", links)
    big = group.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    firm = group.join(big, "component", "left_semi").select("node").withColumn("firm", F.lit(True))
    keyed = named.withColumn("node", F.xxhash64("cloud", *[cells.cell(c, voxel) for c in coords])).join(firm, "node", "left")
    return keyed.where(F.col("sure") | F.coalesce("firm", F.lit(False))).select(*points.columns)


def thinned_elevations(panos: DataFrame, cell_m: float = 25.0, near_m: float = 80.0, outlier_m: float = 2.5) -> DataFrame:
    """Panorama elevations (x, y, z) by cell, mean place and median height, without those far off their neighbours'
    median."""
    keys = [cells.cell("x", cell_m).alias("i"), cells.cell("y", cell_m).alias("j")]
    each = panos.where("z is not null").groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.median("z").alias("z"))
    near = spatial.within(each, each, ["x", "y"], near_m).where("i != i_r or j != j_r").groupBy("i", "j").agg(F.median("z_r").alias("usual"))
    return each.join(near, ["i", "j"], "left").where(F.coalesce(F.abs(F.col("z") - F.col("usual")) <= outlier_m, F.lit(True))).drop("usual")


def exclusive(points: DataFrame, layers: list[tuple[str, Column]], key: list[str]) -> DataFrame:
    """Each point in the first layer that has it, in the order given; points in none are left out."""
    place = F.coalesce(*[F.when(test, F.lit(name)) for name, test in layers])
    return points.withColumn("layer", place).where("layer is not null").select(*key, "layer")


def water_cells(samples: DataFrame, wet: str = "wet", height: str = "height", least: int = 16) -> DataFrame:
    """Bodies of water: wet cells (i, j) joined over their sides, with enough cells each, and their level."""
    from pointlake.functions.shade import is_water
    from pointlake.operators.graph import components

    under = samples.where(is_water(F.col(wet), F.col(height))).select("i", "j", F.col(height).alias("h")).withColumn("node", F.xxhash64("i", "j"))
    right = under.select("node", (F.col("i") + 1).alias("i"), "j").union(under.select("node", "i", (F.col("j") + 1).alias("j")))
    links = right.select(F.col("node").alias("a"), "i", "j").join(under.select(F.col("node").alias("b"), "i", "j"), ["i", "j"])
    group = components(under, "node", links)
    named = under.join(group, "node")
    size = named.groupBy("component").agg(F.count("*").alias("cells"), F.round(F.greatest(F.percentile("h", F.lit(0.05)), F.lit(0.0)), 2).alias("level")).where(F.col("cells") >= least)
    return named.join(size, "component").select("i", "j", "component", "cells", "level")
