"""Scene catalogues: range join, normalising, joins with areas of interest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import cells

S2_DOC = "struct<id:string,properties:struct<datetime:string,`eo:cloud_cover`:double>,geometry:struct<type:string,coordinates:array<array<array<array<double>>>>>>"
SPOT_DOC = "struct<geometry:struct<type:string,coordinates:array<array<array<double>>>>,properties:struct<id:string,acquisitionDate:string,cloudCover:double,incidenceAngle:double,azimuthAngle:double,illuminationAzimuthAngle:double,illuminationElevationAngle:double,resolution:double>,_links:struct<quicklook:struct<href:string>,thumbnail:struct<href:string>>>"


def search_catalogue(aois: DataFrame, scenes: DataFrame, start: str = "2017-01-01", end: str | None = None, max_cloud: float | None = None, inclusive: bool = False, max_incidence: float | None = None, cell: float = 1.0) -> DataFrame:
    """Scenes whose ``footprint`` box meets the ``bounds`` of an area: the scene's columns and ``aoi_index``.

    Time, cloud and incidence limits are plain predicates on the scenes, so they reach the scan. The overlap is an
    equi-join on grid cells of ``cell`` degrees that both boxes cover; each pair counts in one cell only, the one
    that holds the south-west corner of the common part, so no distinct follows. Boxes that touch meet. Where rows are dense,
    cells are quartered down to the size of the boxes, and what is still too full is dealt in shares (``cells.plan_grid``). Boxes
    may pass 180 degrees, by an end beyond it or by a west end east of the east end."""
    cloud = F.col("cloud_cover")
    kept = scenes.filter(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end is not None:
        kept = kept.filter(F.col("datetime") <= F.lit(end).cast("timestamp"))
    if max_cloud is not None:
        kept = kept.filter(cloud <= max_cloud if inclusive else cloud < max_cloud)
    if max_incidence is not None:
        kept = kept.filter(F.col("incidence") <= max_incidence)

    # The scene's columns go by number through the join, so that none meets the names used there.
    names = [f"c{i}" for i in range(len(scenes.columns))]
    left = cells.parts(aois.select("aoi_index", F.col("bounds").alias("_a")), "_a", "_a")
    right = cells.parts(kept.toDF(*names), names[scenes.columns.index("footprint")], "_b")
    grid = cells.plan_grid(left, right, ("_a", "_b"), cell, cells.sizes(aois, scenes))
    met = cells.covered(left, "_a", grid, 0).drop("_level", "_x", "_y").join(cells.covered(right, "_b", grid, 1), cells.KEY)
    found = met.filter(cells.counts_here("_a", "_b", cell))
    return found.select("aoi_index", *[F.col(n).alias(c) for n, c in zip(names, scenes.columns, strict=True) if c != "aoi_index"])


def _ring(points: Column) -> Column:
    return F.transform(points, lambda p: F.struct(F.get(p, 0).alias("lon"), F.get(p, 1).alias("lat")))


def normalise_s2(df: DataFrame, json_col: str = "doc") -> DataFrame:
    """``(product_id, source, datetime, coordinates, cloud_cover)`` of low-resolution scene documents: the outer ring of
    the first polygon."""
    d = F.from_json(F.col(json_col), S2_DOC)
    out = df.withColumn("d", d)
    return out.select(
        F.col("d.id").alias("product_id"),
        F.lit("Sentinel2").alias("source"),
        F.to_timestamp("d.properties.datetime").alias("datetime"),
        _ring(F.get(F.get(F.col("d.geometry.coordinates"), 0), 0)).alias("coordinates"),
        F.col("d.properties.`eo:cloud_cover`").alias("cloud_cover"),
    )


def _anchor(href: Column) -> Column:
    return F.when(href.isNotNull(), F.format_string('<a href="%s">link</a>', href))


def normalise_spot(df: DataFrame, json_col: str = "doc") -> DataFrame:
    """The fourteen columns of high-resolution scene documents; the resolution is carried over."""
    p = F.col("d.properties")
    quick, thumb = F.col("d._links.quicklook.href"), F.col("d._links.thumbnail.href")
    return df.withColumn("d", F.from_json(F.col(json_col), SPOT_DOC)).select(
        p["id"].alias("product_id"),
        F.lit("SPOT").alias("source"),
        F.to_timestamp(p["acquisitionDate"]).alias("datetime"),
        _ring(F.get(F.col("d.geometry.coordinates"), 0)).alias("coordinates"),
        p["cloudCover"].alias("cloud_cover"),
        p["incidenceAngle"].alias("incidence"),
        p["resolution"].alias("resolution"),
        p["azimuthAngle"].alias("view_azimuth"),
        p["illuminationAzimuthAngle"].alias("sun_azimuth"),
        p["illuminationElevationAngle"].alias("sun_elevation"),
        quick.alias("quicklook_href"),
        _anchor(quick).alias("quicklook_link"),
        thumb.alias("thumbnail_href"),
        _anchor(thumb).alias("thumbnail_link"),
    )


def dedupe_revisits(revisits: DataFrame) -> DataFrame:
    """One row per area and time, the smallest product id."""
    w = Window.partitionBy("aoi_index", "datetime").orderBy("product_id")
    return revisits.withColumn("first", F.row_number().over(w)).filter("first = 1").drop("first")


def coverage(aois: DataFrame, revisits: DataFrame) -> DataFrame:
    return aois.join(revisits, "aoi_index")


def with_overlap_area(revisits: DataFrame, aois: DataFrame) -> DataFrame:
    """Add ``area``: what the footprint box and the area's bounds have in common, km2 to two decimals."""
    boxes = aois.select("aoi_index", F.col("bounds").alias("aoi_bounds"))
    return revisits.join(boxes, "aoi_index").withColumn("area", geo.box_overlap_km2(F.col("footprint"), F.col("aoi_bounds"))).drop("aoi_bounds")


def filter_full_overlap(revisits: DataFrame, aoi_area: float) -> DataFrame:
    return revisits.filter(F.col("area") > 0.999 * aoi_area)


DATE_FORMATS = ("yyyy-MM-dd", "dd-MM-yyyy", "yyyy/MM/dd", "dd/MM/yyyy")


def parse_date(text: Column) -> Column:
    """The first of DATE_FORMATS that fits; null if none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in DATE_FORMATS])


def resolve_target_date(aois: DataFrame, target: str | None = None) -> DataFrame:
    """``target_date`` from the column that ``target`` names, else from a column of that name, else from ``target`` as a date."""
    source = target if target in aois.columns else "target_date" if "target_date" in aois.columns else None
    if source is None and target is None:
        raise ValueError("no target date")
    value = F.lit(target) if source is None else F.col(source)
    known = source is not None and dict(aois.dtypes)[source] in ("date", "timestamp")
    return aois.withColumn("target_date", value.cast("date") if known else parse_date(value.cast("string")))


def delta_days(revisits: DataFrame, aois: DataFrame) -> DataFrame:
    """Add ``delta``: signed days from the area's target date to the revisit."""
    dates = aois.select("aoi_index", "target_date")
    return revisits.join(dates, "aoi_index").withColumn("delta", F.datediff(F.to_date("datetime"), "target_date")).drop("target_date")


def with_classes(selected: DataFrame, aois: DataFrame) -> DataFrame:
    return selected.join(aois.select("aoi_index", "IPCC", "SMOD", "LCCS"), "aoi_index", "left")


def histogram(df: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """``(bin, low, high, count)``: equal widths between the extremes, the last bin closed; bins without a row are absent."""
    edges = df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.when(width > 0, F.least(F.floor((F.col(column) - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    placed = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).withColumn("bin", place.cast("int"))
    counted = placed.groupBy("bin", "lo", "hi").count()
    return counted.select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), "count")


def merge_download_list(aois: DataFrame, selected: DataFrame) -> DataFrame:
    """Join for downloads: ``area`` from the area of interest; name, bounds and target date from the selected revisit."""
    own = [c for c in aois.columns if c not in ("name", "bounds", "target_date")]
    rest = [c for c in selected.columns if c not in own]
    return aois.select(*own).join(selected.select("aoi_index", *rest), "aoi_index")
