"""Image files by name, side tables, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File name endings and the products they name.
PRODUCTS = ("L2A_data", "L1C_data", "CLM", "CLP", "dataMask", "viewZenithMean", "viewAzimuthMean", "sunAzimuthAngles", "sunZenithAngles")


def parse_paths(df: DataFrame, path: Column) -> DataFrame:
    """``(aoi, level, n, product)`` out of ``.../{aoi}/{level}/{aoi}-{n}-{product}.tiff`` and, for high resolution,
    ``.../{aoi}/{aoi}_{ps|pan|rgb}.tiff``; null where a part is missing."""
    low = r"([^/]+)/(L1C|L2A)/\1-(\d+)-([A-Za-z0-9_]+)\.tiff$"
    high = r"([^/]+)/\1_(ps|pan|rgb)\.tiff$"

    def part(pattern: str, i: int) -> Column:
        found = F.regexp_extract(path, pattern, i)
        return F.when(found != "", found)

    return df.withColumns({"aoi": F.coalesce(part(low, 1), part(high, 1)), "level": part(low, 2), "n": part(low, 3).cast("int"), "product": F.coalesce(part(low, 4), part(high, 2))})


def image_inventory(spark: SparkSession, root: str, pattern: str = "*.tiff") -> DataFrame:
    """Files below ``root``: path, length and what their names say. The contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return parse_paths(files.select("path", "length"), F.col("path"))


def attach_metadata(df: DataFrame, metadata: DataFrame, order_by: str, key: str = "aoi") -> DataFrame:
    """Left join with the first metadata row of each area, in the order of a column."""
    first = metadata.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order_by))).filter("_r = 1").drop("_r")
    return df.join(first, key, "left")


def write_by_collection(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("collection").option("header", True).csv(path)


def write_chips(df: DataFrame, path: str, mode: str = "error") -> None:
    """Chips as Parquet, a folder per role, sorted by area within files."""
    df.repartition("role", "aoi").sortWithinPartitions("role", "aoi").write.mode(mode).partitionBy("role").parquet(path)
