"""Scenes: one JSON document each, as tables of nodes, edges and adjacency, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The document's fields and types.
SCENE = (
    "center array<double>, nodes array<struct<pano:struct<source:string,id:string,lat:double,lon:double,date:string,elevation:double,heading:double,pitch:double,roll:double>,"
    "ply:string,position:array<double>,rotation:array<array<double>>,transform:array<array<double>>>>, edges array<struct<a:bigint,b:bigint,keep_a:array<bigint>,keep_b:array<bigint>>>, "
    "adjacency map<string,array<bigint>>"
)


def read_scenes(spark: SparkSession, path: str) -> DataFrame:
    """A row per scene file, with its name; fields that a file lacks are null."""
    return spark.read.schema(SCENE).option("multiLine", True).json(path).withColumn("scene", F.col("_metadata.file_path"))


def nodes(scenes: DataFrame) -> DataFrame:
    return scenes.select("scene", F.posexplode("nodes").alias("node", "n")).select("scene", "node", "n.*")


def edges(scenes: DataFrame) -> DataFrame:
    return scenes.select("scene", F.explode("edges").alias("e")).select("scene", "e.*")


def adjacency(scenes: DataFrame) -> DataFrame:
    return scenes.select("scene", F.explode("adjacency").alias("src", "to")).select("scene", F.col("src").cast("long"), F.explode("to").alias("dst"))


def write_scenes(scenes: DataFrame, path: str) -> None:
    """One JSON line a scene, compact, without its file name."""
    scenes.select(*[c for c in scenes.columns if c != "scene"]).write.option("ignoreNullFields", False).json(path)


def placed(node_table: DataFrame) -> DataFrame:
    """Nodes that have a cloud and a place."""
    return node_table.where(F.col("ply").isNotNull() & F.col("transform").isNotNull())


def panoramas(looked_up: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(panorama, neighbour, date) tables of looked-up documents: id, lat, lon, date, elevation, heading, pitch, roll,
    links, neighbors, historical. Neighbours are the links if there are any and have a place; dates are the panorama's
    own and its earlier ones."""
    one = looked_up.select("id", "lat", "lon", "date", "elevation", "heading", "pitch", "roll")
    near = looked_up.select("id", F.explode(F.when(F.size("links") > 0, F.col("links")).otherwise(F.col("neighbors"))).alias("n")).where("n.lat is not null").select("id", F.col("n.id").alias("neighbour"), "n.lat", "n.lon")
    dates = looked_up.select("id", F.explode(F.array_union(F.array(F.struct(F.col("id").alias("id"), F.col("date").alias("date"))), F.coalesce("historical", F.array().cast("array<struct<id:string,date:string>>")))).alias("d")).select("id", F.col("d.id").alias("capture"), "d.date").distinct()
    return one, near, dates
