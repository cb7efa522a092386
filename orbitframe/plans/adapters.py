"""Domain tables derived from the test tables by integer arithmetic: a Spark function and the same rows as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators.classes import LCCS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(value: Column, digits: int) -> Column:
    """Rounded as the SQL does it: the double times a power of ten, halves away from zero. ``F.round`` looks at the double's
    decimal digits instead, which differs where a quotient lies on a half or next to it."""
    return F.round(value * 10.0**digits) / 10.0**digits


def _place(key: str) -> tuple[str, str]:
    return f"({key} * 7919 % 35000) / 100 - 175", f"({key} * 104729 % 14000) / 100 - 70"


def box(lon: str, lat: str, half: float):
    x, y = F.col(lon), F.col(lat)
    return geo.bounds(x - half, y - half, x + half, y + half)


def aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _place("s_suppkey")
    out = table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS aoi_index", "concat('POI-', s_suppkey) AS name", f"{lon} AS lon", f"{lat} AS lat", "cast(2.5 AS double) AS area", "date_add(date '1996-01-01', cast(s_suppkey * 37 % 1500 AS int)) AS target_date", "s_suppkey * 7 % 4 AS cls")
    ipcc = F.element_at(F.array(*map(F.lit, ("Forest", "Settlement", "Water", "Other"))), (F.col("cls") + 1).cast("int"))
    return out.withColumns({"bounds": box("lon", "lat", 0.01), "IPCC": ipcc, "SMOD": F.concat(F.lit("smod-"), F.col("cls")), "LCCS": F.concat(F.lit("lccs-"), F.col("cls"))}).drop("cls")


AOI_SQL = """aoi AS (SELECT s_suppkey AS aoi_index, concat('POI-', s_suppkey) AS name, (s_suppkey * 7919 % 35000) / 100 - 175 AS lon,
 (s_suppkey * 104729 % 14000) / 100 - 70 AS lat, CAST(2.5 AS DOUBLE) AS area, DATE '1996-01-01' + CAST(s_suppkey * 37 % 1500 AS INTEGER) AS target_date,
 (s_suppkey * 7919 % 35000) / 100 - 175 - CAST(0.01 AS DOUBLE) AS lon_min, (s_suppkey * 104729 % 14000) / 100 - 70 - CAST(0.01 AS DOUBLE) AS lat_min,
 (s_suppkey * 7919 % 35000) / 100 - 175 + CAST(0.01 AS DOUBLE) AS lon_max, (s_suppkey * 104729 % 14000) / 100 - 70 + CAST(0.01 AS DOUBLE) AS lat_max,
 ['Forest', 'Settlement', 'Water', 'Other'][s_suppkey * 7 % 4 + 1] AS IPCC, concat('smod-', s_suppkey * 7 % 4) AS SMOD, concat('lccs-', s_suppkey * 7 % 4) AS LCCS FROM supplier)"""


def revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _place("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey AS aoi_index", "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyy-MM-dd')) AS product_id", "l_shipdate AS datetime",
        "round(l_discount * 100) * 10 AS cloud_cover", "round(l_tax * 100) * 10 AS incidence", f"{lon} + (l_quantity - 25) / 10000 AS fx", f"{lat} + (l_quantity - 25) / 10000 AS fy",
    )
    return rows.withColumn("footprint", box("fx", "fy", 0.01)).drop("fx", "fy")


REVISIT_SQL = """revisit AS (SELECT *, fx - CAST(0.01 AS DOUBLE) AS f_lon_min, fy - CAST(0.01 AS DOUBLE) AS f_lat_min, fx + CAST(0.01 AS DOUBLE) AS f_lon_max, fy + CAST(0.01 AS DOUBLE) AS f_lat_max FROM (
 SELECT l_suppkey AS aoi_index, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y-%m-%d')) AS product_id, l_shipdate AS datetime,
 round(l_discount * 100) * 10 AS cloud_cover, round(l_tax * 100) * 10 AS incidence, (l_suppkey * 7919 % 35000) / 100 - 175 + (l_quantity - 25) / 10000 AS fx,
 (l_suppkey * 104729 % 14000) / 100 - 70 + (l_quantity - 25) / 10000 AS fy FROM lineitem))"""

#: Area of the common part of an area of interest and a footprint.
OVERLAP_SQL = """CASE WHEN least(lon_max, f_lon_max) > greatest(lon_min, f_lon_min) AND least(lat_max, f_lat_max) > greatest(lat_min, f_lat_min) THEN
 round(radians(least(lon_max, f_lon_max) - greatest(lon_min, f_lon_min)) * (zone(least(lat_max, f_lat_max)) - zone(greatest(lat_min, f_lat_min))) / 1000000, 2) ELSE 0 END"""


def zone_sql(text: str) -> str:
    """Write out zone(x), the ellipsoidal area from the equator to latitude x per radian."""
    e, b = repr(geo.ECCENTRICITY), repr(geo.MINOR)
    while "zone(" in text:
        start = text.index("zone(")
        at, depth = start + 5, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(text[at], 0)
            at += 1
        s = f"sin(radians({text[start + 5 : at - 1]}))"
        text = text[:start] + f"(CAST({b} AS DOUBLE) * CAST({b} AS DOUBLE) / 2 * ({s} / (1 - power(CAST({e} AS DOUBLE) * {s}, 2)) + ln((1 + CAST({e} AS DOUBLE) * {s}) / (1 - CAST({e} AS DOUBLE) * {s})) / (2 * CAST({e} AS DOUBLE))))" + text[at:]
    return text


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _place("c_custkey")
    ids = ", ".join(map(str, sorted(LCCS)[1:]))
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS point_id", f"{lon} AS lon", f"{lat} AS lat",
        "CASE WHEN c_custkey % 100 < 40 THEN 'Forest' WHEN c_custkey % 100 < 65 THEN 'Agriculture' WHEN c_custkey % 100 < 80 THEN 'Grassland' WHEN c_custkey % 100 < 90 THEN 'Other' WHEN c_custkey % 100 < 97 THEN 'Settlement' ELSE 'Wetland' END AS IPCC",
        "concat('smod-', c_nationkey % 8) AS SMOD", f"element_at(array({ids}), cast(c_custkey % 36 AS int) + 1) AS landcover_id", "cast(c_custkey % 37 AS int) AS row", "cast(c_custkey * 3 % 50 AS int) AS col",
    )


POINT_SQL = f"""point AS (SELECT c_custkey AS point_id, (c_custkey * 7919 % 35000) / 100 - 175 AS lon, (c_custkey * 104729 % 14000) / 100 - 70 AS lat,
 CASE WHEN c_custkey % 100 < 40 THEN 'Forest' WHEN c_custkey % 100 < 65 THEN 'Agriculture' WHEN c_custkey % 100 < 80 THEN 'Grassland' WHEN c_custkey % 100 < 90 THEN 'Other' WHEN c_custkey % 100 < 97 THEN 'Settlement' ELSE 'Wetland' END AS IPCC,
 concat('smod-', c_nationkey % 8) AS SMOD, [{", ".join(map(str, sorted(LCCS)[1:]))}][c_custkey % 36 + 1] AS landcover_id, c_custkey % 37 AS row, c_custkey * 3 % 50 AS col FROM customer)"""


def raster_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell of a small class raster of 50 columns; cell (row, col) has the class ids in turn."""
    ids = ", ".join(map(str, sorted(LCCS)))
    return table(spark, sf_dir, "part").selectExpr("cast(p_partkey div 50 AS int) AS row", "cast(p_partkey % 50 AS int) AS col", f"element_at(array({ids}), cast(p_size % 37 AS int) + 1) AS value")


RASTER_SQL = f"""raster_cell AS (SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, [{", ".join(map(str, sorted(LCCS)))}][p_size % 37 + 1] AS value FROM part)"""


def pixel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").selectExpr("vec_id div 8 AS aoi", "cast(vec_id % 8 + 1 AS int) AS revisit", "posexplode(embedding) AS (pos, v)")
    return rows.selectExpr("aoi", "revisit", "1 AS band", "cast(pos div 8 AS int) AS y", "cast(pos % 8 AS int) AS x", "cast(round(cast(v AS double) * 10000) AS int) AS dn", "cast(abs(cast(round(cast(v AS double) * 10000) AS int)) % 12 AS int) AS scl")


PIXEL_SQL = """pixel AS (SELECT aoi, revisit, 1 AS band, CAST(pos // 8 AS INTEGER) AS y, CAST(pos % 8 AS INTEGER) AS x, CAST(round(CAST(v AS DOUBLE) * 10000) AS INTEGER) AS dn,
 abs(CAST(round(CAST(v AS DOUBLE) * 10000) AS INTEGER)) % 12 AS scl FROM (SELECT vec_id // 8 AS aoi, vec_id % 8 + 1 AS revisit, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings))"""


def chip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pixels as arrays: one 8 by 8 band per row."""
    dn = F.transform("embedding", lambda v: F.round(v.cast("double") * 10000).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select((F.expr("vec_id div 8")).alias("aoi"), (F.col("vec_id") % 8 + 1).cast("int").alias("revisit"), dn.alias("pixels"))
    return rows.select("aoi", F.lit("lr").alias("role"), "revisit", F.lit(1).alias("band"), F.lit(8).alias("h"), F.lit(8).alias("w"), "pixels", F.transform("pixels", lambda p: F.abs(p) % 12).alias("mask"))


def order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_orderkey AS order_id", "o_custkey % 5 AS collection", "CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'CREATED' ELSE 'RUNNING' END AS status", "CASE WHEN o_orderkey % 4 = 0 THEN cast(22.5 AS double) ELSE cast(2.5 AS double) END AS sqkm", "o_custkey AS poi_index", "o_orderdate AS created")


ORDER_SQL = """ord AS (SELECT o_orderkey AS order_id, o_custkey % 5 AS collection, CASE o_orderstatus WHEN 'F' THEN 'DONE' WHEN 'O' THEN 'CREATED' ELSE 'RUNNING' END AS status,
 CASE WHEN o_orderkey % 4 = 0 THEN CAST(22.5 AS DOUBLE) ELSE CAST(2.5 AS DOUBLE) END AS sqkm, o_custkey AS poi_index, o_orderdate AS created FROM orders)"""


def tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr("concat(l_orderkey, '/tile_', l_linenumber, '.tif') AS path", "CASE l_linestatus WHEN 'F' THEN 'DONE' ELSE 'RUNNING' END AS status", "l_shipdate AS created")


TILE_SQL = """tile AS (SELECT concat(l_orderkey, '/tile_', l_linenumber, '.tif') AS path, CASE l_linestatus WHEN 'F' THEN 'DONE' ELSE 'RUNNING' END AS status, l_shipdate AS created FROM lineitem)"""


def scene(spark: SparkSession, sf_dir: str) -> DataFrame:
    lon, lat = _place("user_id")
    rows = table(spark, sf_dir, "events").selectExpr("event_id AS scene_id", "ts AS datetime", "cast(get_json_object(props, '$.k') AS double) AS cloud_cover", f"{lon} + ((event_id * 31 % 201) - 100) / 1000 AS fx", f"{lat} + ((event_id * 57 % 201) - 100) / 1000 AS fy")
    return rows.withColumn("footprint", box("fx", "fy", 0.05)).drop("fx", "fy")


SCENE_SQL = """scene AS (SELECT *, fx - CAST(0.05 AS DOUBLE) AS f_lon_min, fy - CAST(0.05 AS DOUBLE) AS f_lat_min, fx + CAST(0.05 AS DOUBLE) AS f_lon_max, fy + CAST(0.05 AS DOUBLE) AS f_lat_max FROM (
 SELECT event_id AS scene_id, ts AS datetime, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS cloud_cover, (user_id * 7919 % 35000) / 100 - 175 + ((event_id * 31 % 201) - 100) / 1000 AS fx,
 (user_id * 104729 % 14000) / 100 - 70 + ((event_id * 57 % 201) - 100) / 1000 AS fy FROM events))"""


def file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("root/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")


def split_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS aoi", "CASE WHEN s_suppkey % 10 < 8 THEN 'train' WHEN s_suppkey % 10 = 8 THEN 'val' ELSE 'test' END AS split")


SPLIT_SQL = "split_list AS (SELECT s_suppkey AS aoi, CASE WHEN s_suppkey % 10 < 8 THEN 'train' WHEN s_suppkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM supplier)"

CTES = {"aoi": AOI_SQL, "revisit": REVISIT_SQL, "point": POINT_SQL, "raster_cell": RASTER_SQL, "pixel": PIXEL_SQL, "ord": ORDER_SQL, "tile": TILE_SQL, "scene": SCENE_SQL, "split_list": SPLIT_SQL}


def with_tables(names: str, body: str) -> str:
    """``WITH`` the named adapters before ``body``, which starts with SELECT or with further ``name AS (...),`` parts."""
    parts = [CTES[n] for n in names.split()]
    head = "WITH " + ", ".join(parts) if parts else ""
    if not body.lstrip().upper().startswith("SELECT"):
        head += ", " if parts else "WITH "
    return zone_sql(f"{head} {body}")
