"""Graphs: components, reach, growth, covers. Rounds are joins; every round is written, so plans stay short."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointlake.plans.steps import written


def components(nodes: DataFrame, node: str, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node: the least node it reaches. Every node points to its least neighbour, further
    links hang on between parents, and pointers are doubled, so rounds grow with the logarithm of a chain's length."""
    now = written(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct().withColumn("more", F.lit(1)))
    while True:
        parent = now.groupBy("a").agg(F.min("b").alias("p"))
        across = now.join(parent, "a").where("b != p").select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"), F.lit(1).alias("more"))
        up = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        doubled = parent.join(up, "p", "left").select("a", F.coalesce("q", "p").alias("b"), F.col("q").isNotNull().cast("int").alias("more"))
        now = written(doubled.unionByName(across).groupBy("a", "b").agg(F.max("more").alias("more")))
        if not now.agg(F.max("more")).first()[0]:
            break
    return nodes.select(F.col(node).alias("node")).distinct().join(now.select(F.col("a").alias("node"), F.col("b").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def pieces(nodes: DataFrame, edges: DataFrame, posed: Column, node: str = "node") -> DataFrame:
    """Components of the nodes that have a pose, by edges between such; a lone node is a piece, one without a pose in
    none."""
    from pointlake.operators.spatial import both_ends

    placed = nodes.where(posed)
    return components(placed, node, both_ends(edges, placed, node))


def reached(starts: DataFrame, edges: DataFrame, allowed: DataFrame | None = None, most_rounds: int | None = None) -> DataFrame:
    """(node, hops) of all nodes that are reached from starts (column node) along undirected edges (a, b), through
    allowed nodes only."""
    links = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    if allowed is not None:
        links = links.join(allowed.select(F.col("node").alias("b")), "b", "left_semi")
        starts = starts.join(allowed.select("node"), "node", "left_semi")
    seen = written(starts.select("node").distinct().withColumn("hops", F.lit(0)))
    rounds = 0
    while most_rounds is None or rounds < most_rounds:
        rounds += 1
        edge = seen.where(F.col("hops") == rounds - 1).join(links, F.col("node") == F.col("a")).select(F.col("b").alias("node")).distinct()
        new = written(edge.join(seen, "node", "left_anti").withColumn("hops", F.lit(rounds)))
        if new.isEmpty():
            break
        seen = written(seen.unionByName(new))
    return seen


def connects(dots: DataFrame, edges: DataFrame, candidates: DataFrame, start: tuple[float, float], goals: DataFrame, near_m: float = 5.0, goal_m: float = 15.0) -> bool:
    """Whether dots (node, lat, lon) with candidates lead from the start to a goal (lat, lon). Every component is tried
    from its dots within near_m of the start, or else from its closest."""
    from pointlake.functions.geo import haversine_m

    filled = dots.join(candidates.select("node").distinct(), "node", "left_semi")
    group = components(dots, "node", edges)
    far = haversine_m(F.col("lat"), F.col("lon"), F.lit(start[0]), F.lit(start[1]))
    placed = written(filled.join(group, "node").withColumn("far", far))
    closest = placed.groupBy("component").agg(F.min("far").alias("closest"))
    first = placed.join(closest, "component").where((F.col("far") <= near_m) | ((F.col("closest") > near_m) & (F.col("far") == F.col("closest"))))
    there = reached(first, edges, placed).join(placed, "node")
    wanted = goals.select(F.col("lat").alias("goal_lat"), F.col("lon").alias("goal_lon"))
    # Goals are the few places a user typed: every reached dot is tried against each.
    hit = there.join(F.broadcast(wanted), haversine_m(F.col("lat"), F.col("lon"), F.col("goal_lat"), F.col("goal_lon")) <= goal_m, "left_semi")
    return not hit.isEmpty()


def greedy_order(covers: DataFrame, name: str, item: str, order: Callable[[str], object] = lambda x: x, most: int | None = None) -> list[str]:
    """Names in the order that covers most: each next has the most items not covered yet, then the most items, then is
    the greatest by `order`. The driver holds the names and their counts; items stay in tables."""
    left = written(covers.select(name, item).distinct())
    whole = {r[0]: r[1] for r in left.groupBy(name).count().collect()}
    out: list[str] = []
    while whole and (most is None or len(out) < most):
        new = {r[0]: r[1] for r in left.groupBy(name).count().collect()}
        pick = max(whole, key=lambda n: (new.get(n, 0), whole[n], order(n)))
        out.append(pick)
        whole.pop(pick)
        left = written(left.where(F.col(name) != pick).join(left.where(F.col(name) == pick).select(item), item, "left_anti"))
        if left.isEmpty():
            out += sorted(whole, key=lambda n: (whole[n], order(n)), reverse=True)
            return out[:most]
    return out


def set_cover(covers: DataFrame, name: str, item: str, rating: str) -> list[str]:
    """The fewest names that a greedy choice needs to cover all items: the most new items first, of equals the best mean
    rating over the new ones, then the least name."""
    left = written(covers.groupBy(name, item).agg(F.max(rating).alias(rating)))
    out: list[str] = []
    while True:
        best = left.groupBy(name).agg(F.count("*").alias("n"), F.avg(rating).alias("r")).orderBy(F.desc("n"), F.desc("r"), name).limit(1).collect()
        if not best:
            return out
        out.append(best[0][0])
        left = written(left.where(F.col(name) != best[0][0]).join(left.where(F.col(name) == best[0][0]).select(item), item, "left_anti"))


def bridges(dots: DataFrame, edges: DataFrame, coords: list[str], most_m: float = 15.0) -> DataFrame:
    """Links (a, b, distance) that join components no more than most_m apart, the shortest first and one for each
    merge: in every round each component takes its shortest link (ties by name), so components at least halve."""
    from pointlake.operators.spatial import within

    added = None
    links = edges.select("a", "b")
    while True:
        group = components(dots, "node", links)
        named = written(dots.join(group, "node"))
        near = within(named, named, coords, most_m).where("component < component_r").select(F.least("node", "node_r").alias("a"), F.greatest("node", "node_r").alias("b"), "distance", "component", "component_r")
        ends = near.select("*", F.explode(F.array("component", "component_r")).alias("own"))
        pick = ends.groupBy("own").agg(F.min(F.struct("distance", "a", "b")).alias("l")).select("l.*").distinct()
        new = written(pick)
        if new.isEmpty():
            return added if added is not None else new.select("a", "b", "distance")
        added = new.select("a", "b", "distance") if added is None else added.unionByName(new.select("a", "b", "distance"))
        links = links.unionByName(new.select("a", "b"))


def fold_in_order(points: DataFrame, order: str, coords: tuple[str, str] = ("x", "y"), radius: float = 8.0) -> DataFrame:
    """Each point's dot: the first dot in order within the radius (inclusive), else itself as a new one. The order makes
    it sequential along a corridor; corridors (column `corridor`) are apart and run in parallel."""
    schema = points.select("corridor", order, *coords).schema.add("dot", "long")

    def run(pdf):
        import numpy as np

        pdf = pdf.sort_values(order)
        xy, dots, out = pdf[list(coords)].to_numpy(float), [], []
        for p, k in zip(xy, pdf[order], strict=True):
            far = [np.hypot(*(p - q)) for q, _ in dots]
            near = next((i for i, d in enumerate(far) if d <= radius), None)
            if near is None:
                dots.append((p, k))
                out.append(k)
            else:
                out.append(dots[near][1])
        return pdf.assign(dot=out)[["corridor", order, *coords, "dot"]]

    return points.select("corridor", order, *coords).groupBy("corridor").applyInPandas(run, schema)


def flood(cells: DataFrame, seeds: DataFrame, step: float = 0.35) -> DataFrame:
    """Cells (cloud, i, j, height) that are reached from seeds (cloud, i, j) over the eight neighbours, with less than
    `step` between heights. Clouds run in parallel, each by a walk over its own cells."""

    def run(key, pdf, start):
        import pandas as pd

        height = {(i, j): h for i, j, h in zip(pdf.i, pdf.j, pdf.height, strict=True)}
        stack = [(i, j) for i, j in zip(start.i, start.j, strict=True) if (i, j) in height]
        seen = set(stack)
        while stack:
            i, j = stack.pop()
            for u in (i - 1, i, i + 1):
                for v in (j - 1, j, j + 1):
                    if (u, v) in height and (u, v) not in seen and abs(height[u, v] - height[i, j]) < step:
                        seen.add((u, v))
                        stack.append((u, v))
        rows = sorted(seen)
        return pd.DataFrame({"cloud": [key[0]] * len(rows), "i": [r[0] for r in rows], "j": [r[1] for r in rows], "height": [height[r] for r in rows]})

    kinds = f"cloud {cells.schema['cloud'].dataType.simpleString()}, i long, j long, height double"
    return cells.groupBy("cloud").cogroup(seeds.groupBy("cloud")).applyInPandas(run, kinds)


def best_shift(own: DataFrame, other: DataFrame, steps: tuple[float, ...] = (1.0, 0.3, 0.1), reach: float = 0.3) -> tuple[float, float, float]:
    """The move (x, y, z) of own points that brings most of them within `reach` of an other one: from coarse to fine, 343
    moves each time. Points meet by cells; moves are a table of their own."""
    from itertools import product

    from pointlake.operators.spatial import near_any

    spark, at = own.sparkSession, (0.0, 0.0, 0.0)
    for step in steps:
        moves = [(k, *(a + step * d for a, d in zip(at, m, strict=True))) for k, m in enumerate(product(range(-3, 4), repeat=3))]
        table = spark.createDataFrame(moves, "move int, mx double, my double, mz double")
        moved = own.select("x", "y", "z").join(F.broadcast(table)).select("move", (F.col("x") + F.col("mx")).alias("x"), (F.col("y") + F.col("my")).alias("y"), (F.col("z") + F.col("mz")).alias("z"))
        hits = near_any(moved, other.select("x", "y", "z"), ["x", "y", "z"], reach).groupBy("move").count()
        size = F.col("mx") * F.col("mx") + F.col("my") * F.col("my") + F.col("mz") * F.col("mz")
        top = hits.join(table, "move").orderBy(F.desc("count"), size, "move").limit(1).collect()
        if top:
            at = (top[0].mx, top[0].my, top[0].mz)
    return at
