"""Aggregations by voxel or grid cell, and by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cell(x: Column | str, size: float) -> Column:
    """The number of the cell of this size that a coordinate is in."""
    return F.floor((F.col(x) if isinstance(x, str) else x) / F.lit(size)).cast("long")


def voxel_mean(points: DataFrame, coords: Sequence[str], values: Sequence[str], size: float, by: Sequence[str] = ()) -> DataFrame:
    """One row for each voxel: the mean of coordinates and values, and the number of points. Aggregates in part before
    the shuffle, so a dense voxel is no hot key. Points with a null coordinate are left out."""
    known = points.dropna(subset=list(coords))
    keys = [cell(c, size).alias(f"cell_{c}") for c in coords]
    return known.groupBy(*by, *keys).agg(*[F.avg(c).alias(c) for c in (*coords, *values)], F.count("*").alias("n"))


def cell_median(points: DataFrame, x: str, y: str, value: str, size: float, by: Sequence[str] = ()) -> DataFrame:
    return points.groupBy(*by, cell(x, size).alias("i"), cell(y, size).alias("j")).agg(F.median(value).alias(value), F.count("*").alias("n"))


def lowest_band(points: DataFrame, x: str, y: str, height: str, size: float, band: float) -> DataFrame:
    """Points no more than `band` above the lowest of their cell. The lowest are joined back, so that a dense cell is
    neither sorted nor gathered."""
    named = points.withColumn("i", cell(x, size)).withColumn("j", cell(y, size))
    low = named.groupBy("i", "j").agg(F.min(height).alias("lowest"))
    return named.join(low, ["i", "j"]).where(F.col(height) <= F.col("lowest") + F.lit(band))


def kth_share(points: DataFrame, x: str, y: str, value: str, size: float, share: float, ties: Sequence[str] = ()) -> DataFrame:
    """For each cell the value that this share of its points lies below: the one at place int(count * share), from 0."""
    keys = [cell(x, size).alias("i"), cell(y, size).alias("j")]
    named = points.select("*", *keys)
    w = Window.partitionBy("i", "j")
    ranked = named.withColumn("k", F.row_number().over(w.orderBy(value, *ties))).withColumn("n", F.count("*").over(w))
    return ranked.where(F.col("k") - 1 == F.least((F.col("n") * F.lit(share)).cast("int"), F.col("n") - 1)).select("i", "j", value, "n")


def weighted_blend(points: DataFrame, keys: Sequence[str], source: str, value: str, distance: str, fade: float = 2.0) -> DataFrame:
    """Each source's median value and least distance by key, blended over sources by exp(-(d - nearest) / fade); owner:
    the nearest source, of equals the least."""
    each = points.groupBy(*keys, source).agg(F.median(value).alias("__m"), F.min(distance).alias("__d"))
    near = each.groupBy(*keys).agg(F.min("__d").alias("__near"))
    weighed = each.join(near, list(keys)).withColumn("__w", F.exp(-(F.col("__d") - F.col("__near")) / F.lit(fade)))
    blended = (F.sum(F.col("__w") * F.col("__m")) / F.sum("__w")).alias(value)
    return weighed.groupBy(*keys).agg(blended, F.min(F.when(F.col("__d") == F.col("__near"), F.col(source))).alias("owner"))


def histogram_mode(rows: DataFrame, by: Sequence[str], value: str, width: float, least: int) -> DataFrame:
    """The lower edge of the fullest bin of each group with `least` rows or more; of equal bins the lowest."""
    bins = rows.where(F.col(value).isNotNull()).groupBy(*by, cell(value, width).alias("bin")).agg(F.count("*").alias("n"))
    top = bins.groupBy(*by).agg(F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("bin")).alias("low"))).alias("top"))
    return top.where(F.col("n") >= least).select(*by, (-F.col("top.low") * F.lit(width)).alias("mode"), F.col("top.n").alias("in_bin"), "n")


def group_median(rows: DataFrame, by: Sequence[str], values: Sequence[str], least: int) -> DataFrame:
    """Medians of groups with `least` rows or more."""
    return rows.groupBy(*by).agg(*[F.median(v).alias(v) for v in values], F.count("*").alias("n")).where(F.col("n") >= least)


def level(rows: DataFrame, by: Sequence[str], value: str, share: float, shift: float, cap: str | None = None, clear: float = 0.5) -> DataFrame:
    """A low percentile and a shift, not below 0, at most the cap less `clear`, to two places."""
    aggs = [(F.percentile(value, F.lit(share)) + F.lit(shift)).alias("__l")] + ([F.min(cap).alias("__cap")] if cap else [])
    out = F.greatest(F.col("__l"), F.lit(0.0))
    if cap:
        out = F.least(out, F.col("__cap") - F.lit(clear))
    return rows.groupBy(*by).agg(*aggs).select(*by, F.round(out, 2).alias("level"))


def nearest_by_direction(points: DataFrame, by: Sequence[str], azimuth: str, distance: str, step: float) -> DataFrame:
    """The least distance in each step of degrees round a camera."""
    return points.groupBy(*by, cell(F.pmod(F.col(azimuth), F.lit(360.0)), step).alias("direction")).agg(F.min(distance).alias(distance))


def spread(rows: DataFrame, values: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation of each value."""
    return rows.groupBy(*by).agg(*[f for v in values for f in (F.avg(v).alias(f"{v}_mean"), F.stddev_pop(v).alias(f"{v}_dev"))])


def junctions(ways: DataFrame, way: str, nodes: str) -> DataFrame:
    """Nodes where more than two arms of ways meet; a way's end is one arm and a node within it two."""
    arms = ways.select(way, F.size(nodes).alias("n"), F.posexplode(nodes).alias("k", "node"))
    ends = F.when((F.col("k") == 0) | (F.col("k") == F.col("n") - 1), 1).otherwise(2)
    return arms.groupBy("node").agg(F.sum(ends).alias("arms")).where("arms > 2")


def slice_ratio(rows: DataFrame, direction: str, own: str, other: str, step: float, least: int, low: float, high: float) -> DataFrame:
    """The median ratio of two distances by slice of direction, for slices with enough rows, kept in a range."""
    ratios = rows.where(F.col(own) > 0).groupBy(cell(direction, step).alias("slice")).agg(F.median(F.col(other) / F.col(own)).alias("ratio"), F.count("*").alias("n"))
    return ratios.where(F.col("n") >= least).withColumn("ratio", F.least(F.greatest("ratio", F.lit(low)), F.lit(high)))


def date_scores(rates: DataFrame, date: str = "date", dot: str = "dot", rate: str = "rate") -> DataFrame:
    """The median keep rate of a date's samples by the number of dots it covers."""
    return rates.groupBy(date).agg((F.median(rate) * F.countDistinct(dot)).alias("score"), F.countDistinct(dot).alias("dots"))


def summary(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"), F.median(value).alias("middle"))


def palette(pixels: DataFrame, colours: Sequence[str], k: int = 8, seed: int = 1) -> DataFrame:
    """k colours by k-means and the share of pixels that each stands for."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    wide = VectorAssembler(inputCols=list(colours), outputCol="__v").transform(pixels.dropna(subset=list(colours)))
    model = KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(wide)
    total = wide.count()
    shares = model.transform(wide).groupBy("cluster").agg(*[F.avg(c).alias(c) for c in colours], (F.count("*") / F.lit(total)).alias("share"))
    return shares
