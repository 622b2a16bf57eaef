"""Ordered rows: lengths along lines, runs, resampling, smoothing and limits.

All work by window functions partitioned by `by`, so different lines run in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _line(by: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*by).orderBy(*order)


def arc_length(points: DataFrame, by: Sequence[str], order: Sequence[str], coords: Sequence[str], name: str = "along") -> DataFrame:
    """Length along the line up to each point."""
    w = _line(by, order)
    step = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in coords[1:]), F.pow(F.col(coords[0]) - F.lag(coords[0]).over(w), 2)))
    return points.withColumn("__step", F.coalesce(step, F.lit(0.0))).withColumn(name, F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__step")


def runs(rows: DataFrame, by: Sequence[str], order: Sequence[str], flag: Column, along: str, least_rows: int = 2, least_length: float = 20.0) -> DataFrame:
    """Longest stretches of rows with the flag, of enough rows and length: first, last, n, length."""
    w = _line(by, order)
    named = rows.withColumn("__k", F.row_number().over(w)).where(flag)
    group = named.withColumn("__g", F.col("__k") - F.row_number().over(w))
    out = group.groupBy(*by, "__g").agg(F.min("__k").alias("first"), F.max("__k").alias("last"), F.count("*").alias("n"), (F.max(along) - F.min(along)).alias("length"))
    return out.where((F.col("n") >= least_rows) & (F.col("length") >= F.lit(least_length))).drop("__g")


def split_at_gaps(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, gap: float, name: str = "stretch") -> DataFrame:
    """rows with the number, from 0, of the stretch they are in; a step of `gap` or more begins another."""
    w = _line(by, order)
    begins = F.when(F.col(value) - F.lag(value).over(w) >= F.lit(gap), 1).otherwise(0)
    return rows.withColumn("__b", begins).withColumn(name, F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__b")


def moving_average(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of a row and its neighbours; at an end the end itself counts in place of the missing one."""
    w = _line(by, order)
    return rows.withColumn(name, (F.coalesce(F.lag(value).over(w), F.col(value)) + F.col(value) + F.coalesce(F.lead(value).over(w), F.col(value))) / 3)


def slope_limit(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, along: str, grade: float, name: str) -> DataFrame:
    """Heights lowered until none rises by more than `grade` a metre, either way: the least over all rows of their
    height plus grade by the distance, found in one pass each way."""
    w = _line(by, order)
    up, down = F.col(value) - F.lit(grade) * F.col(along), F.col(value) + F.lit(grade) * F.col(along)
    before = F.min(up).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(grade) * F.col(along)
    after = F.min(down).over(w.rowsBetween(0, Window.unboundedFollowing)) - F.lit(grade) * F.col(along)
    return rows.withColumn(name, F.least(before, after))


def tangents(rows: DataFrame, by: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Central differences, one-sided at the ends: columns d_<value>."""
    w = _line(by, order)
    for v in values:
        before, after = F.lag(v).over(w), F.lead(v).over(w)
        rows = rows.withColumn(f"d_{v}", F.when(before.isNull() & after.isNull(), F.lit(0.0)).when(before.isNull(), after - F.col(v)).when(after.isNull(), F.col(v) - before).otherwise((after - before) / 2))
    return rows


def smooth(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, sigma: float, name: str, closed: bool = False) -> DataFrame:
    """Gaussian smoothing over neighbours up to 4 sigma, renormalised at the ends, or round a closed line."""
    reach = int(4 * sigma + 0.5)
    w = _line(by, order)
    named = rows.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    steps = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(2.718281828459045 ** (-0.5 * (s / sigma) ** 2)).alias("w")) for s in range(-reach, reach + 1)])
    to = F.col("__k") + F.col("o.s")
    given = named.select(*by, "__n", "__k", F.col(value).alias("__v"), F.explode(steps).alias("o")).withColumn("__k", F.pmod(to - 1, F.col("__n")) + 1 if closed else to)
    summed = given.groupBy(*by, "__k").agg((F.sum(F.col("o.w") * F.col("__v")) / F.sum("o.w")).alias(name))
    return named.join(summed, [*by, "__k"]).drop("__k", "__n")


def pick_by_share(rows: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, shares: Sequence[float]) -> DataFrame:
    """For each share of the total weight the first row whose running sum reaches it."""
    w = _line(by, order)
    running = rows.withColumn("__s", F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__t", F.sum(weight).over(Window.partitionBy(*by)))
    wanted = running.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    reached = wanted.where((F.col("__s") >= F.col("share") * F.col("__t")) & (F.col("__s") - F.col(weight) < F.col("share") * F.col("__t")))
    return reached.drop("__s", "__t")


def resample(points: DataFrame, by: Sequence[str], order: Sequence[str], coords: Sequence[str], step: float) -> DataFrame:
    """Places every `step` along each line, and its end: by, at, coordinates. Each side makes its own places, so a long
    line is split over tasks after the window."""
    w = _line(by, order)
    sides = arc_length(points, by, order, coords).withColumn("__next", F.lead("along").over(w))
    for c in coords:
        sides = sides.withColumn(f"__{c}", F.lead(c).over(w))
    first, last = F.ceil(F.col("along") / F.lit(step)), F.ceil(F.col("__next") / F.lit(step)) - 1
    inner = sides.where("__next > along").withColumn("__k", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))).withColumn("at", F.col("__k") * F.lit(step))
    share = (F.col("at") - F.col("along")) / (F.col("__next") - F.col("along"))
    made = inner.select(*by, "at", *[(F.col(c) + (F.col(f"__{c}") - F.col(c)) * share).alias(c) for c in coords])
    ends = sides.where(F.col("__next").isNull()).select(*by, F.col("along").alias("at"), *coords)
    return made.unionByName(ends)


def interpolate(queries: DataFrame, lines: DataFrame, by: Sequence[str], at: str, x: str, value: str, reached: str | None = None) -> DataFrame:
    """Values of piecewise linear lines at places; beyond a line's ends its end values. Queries meet only the one side
    that holds them, by a running maximum over both, not by a join on a range. Where a line jumps, `reached` is the column
    of the value it comes to a place with, and `value` the one it has there and goes on with."""
    w = Window.partitionBy(*by).orderBy("__x", "__q")
    both = queries.withColumn("__x", F.col(at)).withColumn("__q", F.lit(1)).unionByName(lines.select(*by, F.col(x).alias("__x"), F.col(value).alias("__v"), F.col(reached or value).alias("__r"), F.lit(0).alias("__q")), allowMissingColumns=True)
    known = F.when(F.col("__q") == 0, F.struct("__x", "__v", "__r"))
    placed = both.withColumn("__a", F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    a, b = F.col("__a"), F.col("__b")
    between = a["__v"] + (b["__r"] - a["__v"]) * (F.col("__x") - a["__x"]) / (b["__x"] - a["__x"])
    out = F.when(a.isNull(), b["__r"]).when(b.isNull() | (a["__x"] == F.col("__x")), a["__v"]).otherwise(between)
    return placed.where("__q = 1").select(*queries.columns, out.alias(value))


def range_text(rows: DataFrame, by: Sequence[str], number: str, name: str = "ranges") -> DataFrame:
    """Whole numbers as text: "0-6, 11-12"."""
    w = Window.partitionBy(*by).orderBy(number)
    islands = rows.select(*by, F.col(number).cast("long").alias(number)).distinct().withColumn("__g", F.col(number) - F.row_number().over(w))
    spans = islands.groupBy(*by, "__g").agg(F.min(number).alias("__a"), F.max(number).alias("__b"))
    text = F.when(F.col("__a") == F.col("__b"), F.col("__a").cast("string")).otherwise(F.concat_ws("-", "__a", "__b"))
    listed = spans.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__a", text.alias("t")))).alias("__l"))
    return listed.select(*by, F.array_join(F.transform("__l", lambda s: s["t"]), ", ").alias(name))


def every_kth(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """The first row of each group and every k-th after it."""
    return rows.withColumn("__k", F.row_number().over(_line(by, order))).where((F.col("__k") - 1) % k == 0).drop("__k")


def spread_evenly(rows: DataFrame, by: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows spread evenly over each group, both ends among them; places are rounded half to even."""
    named = rows.withColumn("__k", F.row_number().over(_line(by, order)) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    place = lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(float(max(k - 1, 1))))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), place)
    return named.where((F.col("__n") <= k) | F.array_contains(wanted, F.col("__k").cast("double"))).drop("__k", "__n")
