"""Points on the globe, areas of interest, tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..schemas import require


def unit_hash(key: Column, salt: int) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5 digest: the same on every engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}-"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def sphere_point(u: Column, v: Column) -> tuple[Column, Column]:
    return 360 * (u - 0.5), F.degrees(F.acos(1 - 2 * v)) - 90


def sample_sphere(spark: SparkSession, n: int, seed: int = 42, start: int = 0) -> DataFrame:
    """``(point_id, lon, lat)``: ``n`` points uniform on the sphere, drawn by a hash of their number."""
    ids = spark.range(start, start + n).withColumnRenamed("id", "point_id")
    lon, lat = sphere_point(unit_hash(F.col("point_id"), seed), unit_hash(F.col("point_id"), seed + 1))
    return ids.select("point_id", lon.alias("lon"), lat.alias("lat"))


def sample_land(spark: SparkSession, n: int, on_land, seed: int = 42, land_share: float = 0.25, rounds: int = 12) -> DataFrame:
    """The first ``n`` points of the sequence of ``sample_sphere`` that ``on_land`` (DataFrame -> DataFrame) keeps: uniform on
    land, exactly ``n``. Draws about ``n / land_share`` points and, where that falls short, twice as many; after ``rounds`` draws
    RuntimeError says that the land is smaller than that."""
    step = max(16, math.ceil(n / land_share))
    for k in range(1, rounds + 1):
        kept = on_land(sample_sphere(spark, step << (k - 1), seed))
        if kept.count() >= n:
            return kept.orderBy("point_id").limit(n)
    raise RuntimeError(f"fewer than {n} points on land among {step << (rounds - 1)}")


def aoi_bounds(points: DataFrame, area_sqkm: float = 2.5) -> DataFrame:
    """Add ``bounds`` around each point, unless there are some, and ``area``."""
    around = geo.bounds_around(F.col("lon"), F.col("lat"), area_sqkm)
    if "bounds" in require(points, "lon", "lat").columns:
        around = F.coalesce(F.col("bounds"), around)
    return points.withColumn("bounds", around).withColumn("area", F.lit(float(area_sqkm)))


def bounds_axis_swap(df: DataFrame) -> DataFrame:
    """``bounds`` in latitude, longitude order."""
    b = F.col("bounds")
    return df.withColumn("bounds", F.struct(b["lat_min"].alias("lat_min"), b["lon_min"].alias("lon_min"), b["lat_max"].alias("lat_max"), b["lon_max"].alias("lon_max")))


def split_bounds(df: DataFrame, n_tiles: int, target_area: float | None = None) -> DataFrame:
    """A k by k grid of boxes for every area of interest, x outer and y inner, named ``name-x-y`` from 1."""
    k = math.isqrt(n_tiles)
    if k * k != n_tiles or not k:
        raise ValueError("n_tiles must be a perfect square")
    b = F.col("bounds")
    wide, high = (b["lon_max"] - b["lon_min"]) / k, (b["lat_max"] - b["lat_min"]) / k
    x, y = F.col("tile_x"), F.col("tile_y")
    steps = F.sequence(F.lit(1), F.lit(k))
    tiles = df.withColumn("tile_x", F.explode(steps)).withColumn("tile_y", F.explode(steps))
    box = geo.bounds(b["lon_min"] + (x - 1) * wide, b["lat_min"] + (y - 1) * high, b["lon_min"] + x * wide, b["lat_min"] + y * high)
    area = F.lit(float(target_area)) if target_area is not None else F.col("area") / n_tiles
    return tiles.withColumns({"bounds": box, "area": area, "name": F.concat_ws("-", "name", x, y)})


def tile_if_large(df: DataFrame, small_area: float = 2.5, n_tiles: int = 9) -> DataFrame:
    """Areas of ``small_area`` stay; all others become tiles of that area."""
    small = df.filter(F.col("area") == small_area).withColumns({"tile_x": F.lit(1), "tile_y": F.lit(1)})
    return small.unionByName(split_bounds(df.filter(F.col("area") != small_area), n_tiles, small_area))
