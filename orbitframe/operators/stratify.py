"""Class names and class distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import classes, raster


def _named(df: DataFrame, id_col: str, table: dict[int, str], name: str) -> DataFrame:
    """Join a fixed table of at most 40 names; an unknown id gives null."""
    names = df.sparkSession.createDataFrame(sorted(table.items()), f"_id int, `{name}` string")
    return df.join(F.broadcast(names), F.col(id_col) == F.col("_id"), "left").drop("_id")


def lccs_name(df: DataFrame, id_col: str = "landcover_id") -> DataFrame:
    return _named(df, id_col, classes.LCCS, "LCCS")


def ipcc_name(df: DataFrame, id_col: str = "landcover_id") -> DataFrame:
    return _named(df, id_col, classes.IPCC, "IPCC")


def smod_name(df: DataFrame, id_col: str = "SMOD_id") -> DataFrame:
    """A null id is class None."""
    out = _named(df, id_col, classes.SMOD, "SMOD")
    return out.withColumn("SMOD", F.when(F.col(id_col).isNull(), F.lit("None")).otherwise(F.col("SMOD")))


def stratify(points: DataFrame, landcover: DataFrame, landcover_affine, smod: DataFrame, smod_affine, size: int = 256, smod_mollweide: bool = True) -> DataFrame:
    """Add landcover_id, LCCS, IPCC, SMOD_id and SMOD to points of ``lon`` and ``lat``. Land cover outside the raster is null,
    settlement is 0."""
    lon, lat = F.col("lon"), F.col("lat")
    x, y = geo.to_mollweide(lon, lat) if smod_mollweide else (lon, lat)
    out = raster.raster_lookup(points, landcover, landcover_affine, lon, lat, "landcover_id", size)
    out = raster.raster_lookup(out, smod, smod_affine, x, y, "SMOD_id", size, missing=0)
    return smod_name(ipcc_name(lccs_name(out)))


def class_distribution(df: DataFrame, class_col: str) -> DataFrame:
    return df.groupBy(class_col).count()


def class_distributions(df: DataFrame, class_cols: list[str]) -> DataFrame:
    """``(kind, class, count)`` of several class columns in one pass."""
    found = df.groupingSets([[F.col(c)] for c in class_cols], *[F.col(c) for c in class_cols]).agg(F.count(F.lit(1)).alias("count"), F.grouping_id().alias("g"))
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(class_cols):
        own = F.col("g") == ((1 << len(class_cols)) - 1) ^ (1 << (len(class_cols) - 1 - i))
        kind, value = F.when(own, F.lit(c)).otherwise(kind), F.when(own, F.col(c).cast("string")).otherwise(value)
    return found.select(kind.alias("kind"), value.alias("class"), "count")


def conditional_distribution(df: DataFrame, given: str, cls: str) -> DataFrame:
    return df.groupBy(given, cls).count()


def conditional_pivot(df: DataFrame, given: str, cls: str, values: list) -> DataFrame:
    """One row per value of ``given``, one count column per listed class, 0 where there is none."""
    return df.groupBy(given).pivot(cls, values).count().na.fill(0)


def subclass_distribution(df: DataFrame, selected: str, value, cls: str) -> DataFrame:
    return class_distribution(df.filter(F.col(selected) == value), cls)
