"""Ranking, limits and set operations with explicit ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_by(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group. Spark limits groups within tasks before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def best(rows: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """The least row of each group by an order that has no ties, with all its columns."""
    return rows.groupBy(*by).agg(F.min_by(F.struct(*rows.columns), order).alias("__r")).select("__r.*")


def biggest_piece(rows: DataFrame, dot: str, piece: str, size: str) -> DataFrame:
    """Of pieces that claim a place the biggest has it; of equals the least by name."""
    return best(rows, [dot], F.struct((-F.col(size)).alias("s"), F.col(piece).alias("p")))


def union_rebased(tables: Sequence[DataFrame], index: str) -> DataFrame:
    """All rows of several tables whose indexes from 0 are moved behind those of the tables before. Sizes are counted
    where they are; no row is numbered anew."""
    out, offset = None, F.lit(0).cast("long")
    sized = None
    for k, t in enumerate(tables):
        part = t.withColumn("__table", F.lit(k))
        out = part if out is None else out.unionByName(part)
        size = t.agg((F.coalesce(F.max(index), F.lit(-1)) + 1).cast("long").alias("__size")).withColumn("__table", F.lit(k))
        sized = size if sized is None else sized.unionByName(size)
    later = sized.select(F.col("__table").alias("__before"), "__size")
    moved = sized.select("__table").join(F.broadcast(later), F.col("__before") < F.col("__table"), "left").groupBy("__table").agg(F.coalesce(F.sum("__size"), offset).alias("__offset"))
    return out.join(F.broadcast(moved), "__table").withColumn(index, F.col(index) + F.col("__offset")).drop("__table", "__offset")


def first_seen(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first by an order that has no ties."""
    return best(rows, key, F.struct(*order))


def dense_index(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """rows with the number, from 0, of their key among the sorted distinct keys. Keys are numbered by range: each
    partition counts its own, so no window spans the table."""
    keys = rows.select(*key).distinct()
    placed = keys.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__p", F.spark_partition_id()).withColumn("__m", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    from pointlake.plans.steps import written

    placed = written(placed)  # a partition's number must not change between the two uses
    sizes = placed.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__p").alias("__q"), F.col("__n").alias("__k"))
    offsets = sizes.join(F.broadcast(before), F.col("__q") < F.col("__p"), "left").groupBy("__p").agg(F.coalesce(F.sum("__k"), F.lit(0)).alias("__o"))
    numbered = placed.join(F.broadcast(offsets), "__p").select(*key, (F.col("__o") + F.col("__m")).alias(name))
    return rows.join(numbered, list(key))


def uncovered(all_rows: DataFrame, covered: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct keys of all rows that no covered row has."""
    return all_rows.select(*key).distinct().join(covered.select(*key).distinct(), list(key), "left_anti")
