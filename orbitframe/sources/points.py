"""Points of interest from files of several kinds, and one schema for them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from ..schemas import NAME_KEYS


def load_poi_csv(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def load_poi_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def load_poi_geojson(spark: SparkSession, path: str) -> DataFrame:
    """One row per feature: its properties, and the point's ``lon`` and ``lat``."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return features.select("f.properties.*", at[0].cast("double").alias("lon"), at[1].cast("double").alias("lat"))


def load_poi_xml(spark: SparkSession, path: str, row_tag: str = "row") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


def load_poi_kml(spark: SparkSession, path: str) -> DataFrame:
    marks = spark.read.format("xml").option("rowTag", "Placemark").load(path)
    at = F.split(F.trim("Point.coordinates"), ",")
    return marks.select(*[c for c in marks.columns if c != "Point"], at[0].cast("double").alias("lon"), at[1].cast("double").alias("lat"))


READERS = {".csv": load_poi_csv, ".json": load_poi_json, ".geojson": load_poi_geojson, ".xml": load_poi_xml, ".kml": load_poi_kml}


def load_poi(spark: SparkSession, path: str) -> DataFrame:
    """Read by the file's extension; an unknown one raises ValueError, a missing file fails as Spark's readers do."""
    kind = os.path.splitext(path)[1].lower()
    if kind not in READERS:
        raise ValueError(f"unknown file type: {kind or path}")
    return READERS[kind](spark, path)


def normalise_poi(df: DataFrame, name_prefix: str | None = None, order_by: str | None = None) -> DataFrame:
    """Points with ``lon``, ``lat`` and ``name``.

    Coordinates come from lon/lat, longitude/latitude, or a WKT ``geometry``. With ``name_prefix`` names are PREFIX-1,
    PREFIX-2, ... in the order of ``order_by`` (the first column if none is given), rows that are equal there by a hash of all
    columns. Otherwise one of the name keys must be there; the
    first of poi_id, poi_name, id, name serves."""
    if {"lon", "lat"} <= set(df.columns):
        out = df
    elif {"longitude", "latitude"} <= set(df.columns):
        out = df.withColumnsRenamed({"longitude": "lon", "latitude": "lat"})
    elif "geometry" in df.columns:
        number = r"POINT\s*\(\s*(-?[0-9.eE+-]+)\s+(-?[0-9.eE+-]+)\s*\)"
        out = df.withColumns({"lon": F.regexp_extract("geometry", number, 1).cast("double"), "lat": F.regexp_extract("geometry", number, 2).cast("double")})
    else:
        raise ValueError("no coordinates: lon/lat, longitude/latitude or geometry")
    if name_prefix is not None:
        return numbered(out, "name", order_by or out.columns[0]).withColumn("name", F.concat_ws("-", F.lit(name_prefix), F.col("name")))
    key = next((k for k in NAME_KEYS if k in out.columns), None)
    if key is None:
        raise ValueError(f"no name column: one of {', '.join(NAME_KEYS)}")
    return out.withColumn("name", F.col(key).cast("string"))


def write_points_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_points_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return load_poi_csv(spark, path, schema)
