"""Queries that write a table's rows to files and read them back through the library's readers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..sources import files, points
from . import adapters as A
from .registry import query


def scratch(spark, name: str) -> str:
    """A fresh path below the folder that spark.checkpoint.dir names; a temporary one where that is unset and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or f'file://{tempfile.mkdtemp()}').rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


def _points(s, d):
    return A.point(s, d).selectExpr("point_id", "lon", "lat", "concat('p, \"', point_id, '\"') AS description")


POINTS = "SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat, concat('p, \"', point_id, '\"') AS description FROM point"


def _rounded(df):
    return df.select(F.col("point_id").cast("long").alias("point_id"), F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "description")


@query("s01_load_poi_csv", "point", POINTS)
def s01(s, d):
    path = scratch(s, "poi")
    points.write_points_csv(_points(s, d), path)
    return _rounded(points.load_poi_csv(s, path))


def _documents(s, d, row, whole):
    """One JSON document a file: ``row`` of all points of the file, in ``whole``."""
    df = _points(s, d).withColumn("part", F.pmod(F.xxhash64("point_id"), F.lit(8)))
    return df.groupBy("part").agg(whole(F.collect_list(row)).alias("value"))


@query("s02_load_poi_json", "point", POINTS)
def s02(s, d):
    path = scratch(s, "json")
    row = F.struct("point_id", "lon", "lat", "description")
    _documents(s, d, row, F.to_json).write.partitionBy("part").text(path)
    return _rounded(points.load_poi_json(s, path))


@query("s03_load_poi_geojson", "point", POINTS)
def s03(s, d):
    path = scratch(s, "geojson")
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry")
    row = F.struct(F.lit("Feature").alias("type"), geometry, F.struct("point_id", "description").alias("properties"))
    _documents(s, d, row, lambda rows: F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), rows.alias("features")))).write.partitionBy("part").text(path)
    return _rounded(points.load_poi_geojson(s, path))


@query("s05_load_poi_kml", "point", POINTS)
def s05(s, d):
    path = scratch(s, "kml")
    marks = _points(s, d).select("point_id", "description", F.struct(F.concat_ws(",", "lon", "lat", F.lit(0)).alias("coordinates")).alias("Point"))
    marks.write.format("xml").option("rootTag", "Document").option("rowTag", "Placemark").save(path)
    return _rounded(points.load_poi_kml(s, path))


@query("s06_load_poi", "point", POINTS)
def s06(s, d):
    """The reader is chosen by the extension."""
    path = scratch(s, "poi") + ".csv"
    points.write_points_csv(_points(s, d), path)
    return _rounded(points.load_poi(s, path))


@query("s04_load_poi_xml", "point", POINTS)
def s04(s, d):
    path = scratch(s, "xml")
    _points(s, d).write.format("xml").option("rowTag", "row").save(path)
    return _rounded(points.load_poi_xml(s, path, "row"))


@query("s08_points_csv", "point", POINTS)
def s08(s, d):
    path = scratch(s, "points")
    points.write_points_csv(_points(s, d), path)
    return _rounded(points.read_points_csv(s, path, "point_id long, lon double, lat double, description string"))


@query("s12_write_by_collection", "ord", "SELECT order_id, collection, status, sqkm FROM ord")
def s12(s, d):
    path = scratch(s, "orders")
    files.write_by_collection(A.order(s, d).select("order_id", "collection", "status", "sqkm"), path)
    out = s.read.schema("order_id long, status string, sqkm double, collection long").option("header", True).csv(path)
    return out.select("order_id", "collection", "status", "sqkm")


@query("s16_write_chips", "pixel", "SELECT aoi, 'lr' AS role, revisit::INTEGER AS revisit, (y * 8 + x)::INTEGER AS pos, dn AS v FROM pixel")
def s16(s, d):
    path = scratch(s, "chips")
    files.write_chips(A.chip(s, d), path)
    return s.read.parquet(path).select("aoi", "role", "revisit", F.posexplode("pixels").alias("pos", "v"))
