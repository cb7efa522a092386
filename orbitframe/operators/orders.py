"""Order, tile and quota tables, download manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bands by product level, metadata products, and the order document's constants.
BANDS = {
    "L2A": ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B11", "B12"],
    "L1C": ["B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B09", "B10", "B11", "B12"],
}
METADATA = ["dataMask", "CLM", "CLP", "viewZenithMean", "viewAzimuthMean", "sunAzimuthAngles", "sunZenithAngles"]
PROVIDER, CONSTELLATION, CRS = "AIRBUS", "SPOT", "http://www.opengis.net/def/crs/EPSG/0/4326"

ORDER_PAGE = "struct<data:array<struct<id:string,name:string,status:string,collectionId:string,created:string,sqkm:double,input:struct<provider:string,bounds:struct<bbox:array<double>>>>>>"


def revisit_sidecar_json(df: DataFrame) -> DataFrame:
    """Add ``sidecar``: the revisit's metadata as JSON, dates and delta as text."""
    day = F.date_format("datetime", "yyyy-MM-dd'T'HH:mm:ss")
    return df.withColumn("sidecar", F.to_json(F.struct("cloud_cover", F.col("target_date").cast("string").alias("target_date"), F.concat("delta", F.lit(" days")).alias("delta"), "area", day.alias("datetime"))))


def band_plan(df: DataFrame, levels: list[str] = ("L2A", "L1C"), bands: str | list | dict = "ALL", metadata: str | list = "ALL") -> DataFrame:
    """Rows times levels times what is read of each: ``level``, ``item``, ``kind`` (band or metadata). ``bands`` is ALL, one list
    for all levels, or a list per level."""
    chosen = {v: BANDS[v] if isinstance(bands, str) and bands == "ALL" else bands[v] if isinstance(bands, dict) else list(bands) for v in levels}
    extra = METADATA if isinstance(metadata, str) and metadata == "ALL" else list(metadata)
    if unknown := set(extra) - set(METADATA):
        raise ValueError(f"unknown metadata: {', '.join(sorted(unknown))}")
    rows = [(v, b, "band") for v in levels for b in chosen[v]] + [(v, m, "metadata") for v in levels for m in extra]
    items = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(i).alias("item"), F.lit(k).alias("kind")) for v, i, k in rows])
    return df.select("*", F.inline(items))


def download_manifest(revisits: DataFrame, levels: list[str] = ("L1C", "L2A"), products: list[str] = METADATA) -> DataFrame:
    """The files of every revisit: per level one of each metadata product, the data, and a JSON sidecar. A suffix of the
    name is dropped from file names."""
    stem = F.regexp_replace(F.concat_ws("-", "name", "n"), r"\.[^./]+$", "")
    files = F.array(*[F.struct(F.lit(v).alias("level"), F.lit(p).alias("product"), F.lit(e).alias("ending")) for v in levels for p, e in [*[(p, "tiff") for p in products], (f"{v}_data", "tiff"), ("metadata", "json")]])
    wide = revisits.select("name", "n", stem.alias("stem"), F.inline(files))
    return wide.select("name", "n", "level", "product", F.format_string("%s/%s/%s-%s.%s", "name", "level", "stem", "product", "ending").alias("path"))


def order_manifest(selected: DataFrame, collection: str) -> DataFrame:
    """Add ``payload``: the nested order document of each revisit."""
    b = F.col("bounds")
    bbox = F.array(b["lon_min"], b["lat_min"], b["lon_max"], b["lat_max"])
    data = F.array(F.struct(F.lit(CONSTELLATION).alias("constellation"), F.array(F.struct(F.col("product_id").alias("id"))).alias("products")))
    area = F.struct(bbox.alias("bbox"), F.struct(F.lit(CRS).alias("crs")).alias("properties"))
    body = F.struct(F.col("name"), F.lit(collection).alias("collectionId"), F.struct(F.lit(PROVIDER).alias("provider"), area.alias("bounds"), data.alias("data")).alias("input"))
    return selected.withColumn("payload", F.to_json(body))


def parse_orders(pages: DataFrame, json_col: str = "doc") -> DataFrame:
    """One row per order of all pages, nesting kept."""
    return pages.select(F.explode(F.from_json(json_col, ORDER_PAGE)["data"]).alias("o")).select("o.*")


def filter_orders(orders: DataFrame, status: str) -> DataFrame:
    return orders.filter(F.col("status") == status)


def order_errors(df: DataFrame, json_col: str = "doc") -> DataFrame:
    """Add ``code`` and ``message``; the message is a JSON document inside the document, or plain text."""
    text = F.get_json_object(json_col, "$.error.message")
    inner = F.get_json_object(text, "$.message")
    return df.withColumns({"code": F.get_json_object(json_col, "$.error.status").cast("int"), "message": F.coalesce(inner, text)})


def check_created(orders: DataFrame) -> None:
    """Raise unless every order is in status CREATED; looks at one order that isn't at most."""
    if not orders.filter(~F.col("status").eqNullSafe(F.lit("CREATED"))).isEmpty():
        raise ValueError("not all orders are CREATED")


def order_progress(orders: DataFrame) -> DataFrame:
    """Per collection the number of orders in each status and whether none is RUNNING or CREATED."""
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status.lower())

    return orders.groupBy("collection").agg(count("CREATED"), count("RUNNING"), count("DONE"), F.bool_and(~F.col("status").isin("RUNNING", "CREATED")).alias("complete"))


def quota_report(quotas: DataFrame, orders: DataFrame) -> DataFrame:
    """``quotas(collection, quota)``: used, total and what remains, km2 to two decimals."""
    used = orders.groupBy("collection").agg(F.sum("sqkm").alias("used"))
    spent = F.coalesce("used", F.lit(0.0))
    return quotas.join(used, "collection", "left").select("collection", F.round(spent, 2).alias("used"), F.round("quota", 2).alias("total"), F.round(F.col("quota") - spent, 2).alias("remaining"))


def orders_with_revisits(orders: DataFrame, revisits: DataFrame) -> DataFrame:
    return orders.join(revisits, "poi_index")


def collection_metadata(orders: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles with their orders: the part of a tile's path before the first slash is the order's id. All collections at once."""
    own = orders.withColumnsRenamed({"created": "order_created", "status": "order_status"}).withColumn("order_id", F.col("order_id").cast("string"))
    part = tiles.withColumnsRenamed({"created": "tile_created", "status": "tile_status"}).withColumn("order_id", F.split_part("path", F.lit("/"), F.lit(1)))
    return own.join(part, "order_id")
