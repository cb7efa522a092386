"""Queries on files, manifests, orders and integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import integrity, orders, selection
from ..sources import files
from . import adapters as A
from .q_catalogue import BEST, LIMITED, MEASURED, RANKED, best
from .registry import query

PICKED = f"{MEASURED}, {LIMITED}, {RANKED % 'l'}, {BEST}"


def chosen(s, d):
    return selection.attach_aoi(best(s, d), A.aoi(s, d))


@query("s10_image_inventory", "tile", "SELECT concat('root/POI-', l_suppkey, '/L2A/POI-', l_suppkey, '-', l_linenumber, '-CLM.tiff') AS path, concat('POI-', l_suppkey) AS aoi, 'L2A' AS level, CAST(l_linenumber AS INTEGER) AS n, 'CLM' AS product FROM lineitem")
def s10(s, d):
    named = A.table(s, d, "lineitem").selectExpr("concat('root/POI-', l_suppkey, '/L2A/POI-', l_suppkey, '-', l_linenumber, '-CLM.tiff') AS path")
    return files.parse_paths(named, F.col("path"))


@query("s11_attach_metadata", "aoi revisit", "f AS (SELECT aoi_index, arg_min(cloud_cover, product_id) AS first_cloud FROM revisit WHERE aoi_index % 2 = 0 GROUP BY aoi_index) SELECT aoi_index, name, first_cloud FROM aoi LEFT JOIN f USING (aoi_index)")
def s11(s, d):
    meta = A.revisit(s, d).filter("aoi_index % 2 = 0").select("aoi_index", "product_id", F.col("cloud_cover").alias("first_cloud"))
    return files.attach_metadata(A.aoi(s, d).select("aoi_index", "name"), meta, "product_id", "aoi_index").select("aoi_index", "name", "first_cloud")


@query("s13_revisit_sidecar", "aoi revisit", PICKED + """ SELECT product_id, cloud_cover, strftime(target_date, '%Y-%m-%d') AS target_date, concat(delta, ' days') AS delta, area, strftime(datetime, '%Y-%m-%dT%H:%M:%S') AS datetime FROM b""")
def s13(s, d):
    doc = "struct<cloud_cover:double,target_date:string,delta:string,area:double,datetime:string>"
    out = orders.revisit_sidecar_json(chosen(s, d))
    return out.select("product_id", F.from_json("sidecar", doc).alias("j")).select("product_id", "j.*")


PRODUCT_ROWS = ", ".join(f"('{m}', 'tiff')" for m in orders.METADATA)


@query("s14_download_manifest", "aoi revisit", f"{PICKED}, lv(level) AS (VALUES ('L1C'), ('L2A')), pr AS (SELECT level, product, ending FROM lv, (VALUES {PRODUCT_ROWS}, ('metadata', 'json')) v(product, ending) UNION ALL SELECT level, concat(level, '_data'), 'tiff' FROM lv) SELECT level, product, concat(name, '/', level, '/', name, '-', n, '-', product, '.', ending) AS path FROM b, pr")
def s14(s, d):
    return orders.download_manifest(chosen(s, d)).select("level", "product", "path")


BAND_ROWS = ", ".join(f"('{v}', '{b}', 'band')" for v, bs in orders.BANDS.items() for b in bs) + ", " + ", ".join(f"('{v}', '{m}', 'metadata')" for v in orders.BANDS for m in orders.METADATA)


@query("s15_band_plan", "aoi", f"SELECT name, level, item, kind FROM aoi, (VALUES {BAND_ROWS}) v(level, item, kind)")
def s15(s, d):
    return orders.band_plan(A.aoi(s, d).select("name"))


@query("o01_order_manifest", "aoi revisit", PICKED + """ SELECT product_id, name, 'c-1' AS collection, 'AIRBUS' AS provider, round(lon_min, 6) AS lon_min, round(lat_max, 6) AS lat_max, 'http://www.opengis.net/def/crs/EPSG/0/4326' AS crs FROM b""")
def o01(s, d):
    p = F.col("payload")
    out = orders.order_manifest(chosen(s, d), "c-1")

    def at(path):
        return F.get_json_object(p, path)

    return out.select(at("$.input.data[0].products[0].id").alias("product_id"), at("$.name").alias("name"), at("$.collectionId").alias("collection"), at("$.input.provider").alias("provider"), F.round(at("$.input.bounds.bbox[0]").cast("double"), 6).alias("lon_min"), F.round(at("$.input.bounds.bbox[3]").cast("double"), 6).alias("lat_max"), at("$.input.bounds.properties.crs").alias("crs"))


def _pages(s, d):
    doc = F.struct(F.col("order_id").cast("string").alias("id"), F.concat(F.lit("order-"), "order_id").alias("name"), "status", F.col("collection").cast("string").alias("collectionId"), "sqkm")
    pages = A.order(s, d).groupBy(F.expr("order_id div 50").alias("page")).agg(F.collect_list(doc).alias("data"))
    return pages.select(F.to_json(F.struct("data")).alias("doc"))


@query("o02_parse_orders", "ord", "SELECT order_id::VARCHAR AS id, concat('order-', order_id) AS name, status, collection::VARCHAR AS collectionId, sqkm FROM ord")
def o02(s, d):
    return orders.parse_orders(_pages(s, d)).select("id", "name", "status", "collectionId", "sqkm")


@query("o03_filter_orders", "ord", "SELECT order_id, collection FROM ord WHERE status = 'DONE'")
def o03(s, d):
    return orders.filter_orders(A.order(s, d), "DONE").select("order_id", "collection")


@query("o04_order_errors", "ord", "SELECT order_id, CAST(400 + order_id % 5 AS INTEGER) AS code, concat('bad order ', order_id) AS message FROM ord")
def o04(s, d):
    inner = F.to_json(F.struct(F.concat(F.lit("bad order "), "order_id").alias("message")))
    doc = F.to_json(F.struct(F.struct((400 + F.col("order_id") % 5).alias("status"), inner.alias("message")).alias("error")))
    return orders.order_errors(A.order(s, d).select("order_id", doc.alias("doc"))).select("order_id", "code", "message")


@query("o05_check_created", "ord", "SELECT collection, bool_and(status = 'CREATED') AS created FROM ord GROUP BY collection")
def o05(s, d):
    out = orders.order_progress(A.order(s, d))
    return out.select("collection", ((F.col("running") == 0) & (F.col("done") == 0)).alias("created"))


@query("o06_order_progress", "ord", "SELECT collection, count(*) FILTER (status = 'CREATED') AS created, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'DONE') AS done, bool_and(status NOT IN ('RUNNING', 'CREATED')) AS complete FROM ord GROUP BY collection")
def o06(s, d):
    return orders.order_progress(A.order(s, d))


@query("o07_quota_report", "ord", "SELECT c.collection, round(coalesce(sum(sqkm), 0), 2) AS used, 500000::DOUBLE AS total, round(500000 - coalesce(sum(sqkm), 0), 2) AS remaining FROM (SELECT DISTINCT collection FROM ord) c LEFT JOIN (SELECT * FROM ord WHERE collection > 0) o USING (collection) GROUP BY c.collection")
def o07(s, d):
    o = A.order(s, d)
    return orders.quota_report(o.select("collection", F.lit(500000.0).alias("quota")).distinct(), o.filter("collection > 0"))


@query("o08_orders_with_revisits", "ord point", "SELECT order_id, IPCC, status FROM ord JOIN point ON poi_index = point_id")
def o08(s, d):
    return orders.orders_with_revisits(A.order(s, d), A.point(s, d).withColumnRenamed("point_id", "poi_index")).select("order_id", "IPCC", "status")


@query("o09_collection_metadata", "ord tile", "SELECT path, collection, o.status AS order_status, t.status AS tile_status, strftime(o.created, '%Y-%m-%d') AS order_day, strftime(t.created, '%Y-%m-%d') AS tile_day FROM ord o JOIN tile t ON o.order_id::VARCHAR = split_part(path, '/', 1) WHERE collection = 3")
def o09(s, d):
    out = orders.collection_metadata(A.order(s, d).filter("collection = 3"), A.tile(s, d))
    return out.select("path", "collection", "order_status", "tile_status", F.date_format("order_created", "yyyy-MM-dd").alias("order_day"), F.date_format("tile_created", "yyyy-MM-dd").alias("tile_day"))


@query("o10_all_collections_metadata", "ord tile", "SELECT collection, o.status AS order_status, t.status AS tile_status, count(*) AS n FROM ord o JOIN tile t ON o.order_id::VARCHAR = split_part(path, '/', 1) GROUP BY ALL")
def o10(s, d):
    return orders.collection_metadata(A.order(s, d), A.tile(s, d)).groupBy("collection", "order_status", "tile_status").agg(F.count(F.lit(1)).alias("n"))


@query("u01_checksums", "", "SELECT concat('root/', doc_id, '.txt') AS path, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def u01(s, d):
    return integrity.checksums(A.file(s, d))


def _expected(s, d):
    f = A.file(s, d)
    wanted = integrity.checksums(f).join(f.select("path", "doc_id"), "path")
    return wanted.select("path", F.when(F.col("doc_id") % 3 == 0, F.lit("altered")).otherwise(F.col("sha256")).alias("sha256"))


@query("u02_verify_checksums", "", "SELECT concat('root/', doc_id, '.txt') AS path, doc_id % 3 > 0 AND doc_id % 7 > 0 AS matches FROM documents")
def u02(s, d):
    return integrity.verify_checksums(A.file(s, d).filter("doc_id % 7 > 0"), _expected(s, d))


@query("u03_verify_structure", "aoi", "SELECT 'hr' AS part, aoi_index AS aoi FROM aoi WHERE aoi_index % 4 = 0 UNION ALL SELECT 'L1C', aoi_index FROM aoi WHERE aoi_index % 5 = 0 UNION ALL SELECT 'L2A', aoi_index FROM aoi WHERE aoi_index % 6 = 0")
def u03(s, d):
    a = A.aoi(s, d).select(F.col("aoi_index").alias("aoi"))
    return integrity.verify_structure(a, {"hr": a.filter("aoi % 4 > 0"), "L1C": a.filter("aoi % 5 > 0"), "L2A": a.filter("aoi % 6 > 0")})


def _present(s, d):
    manifest = orders.download_manifest(chosen(s, d))
    return manifest, manifest.filter("n % 3 > 0 OR product = 'CLM'")


@query("u04_verify_downloads", "aoi revisit", PICKED + ", lv(level) AS (VALUES ('L1C'), ('L2A')) SELECT name, level, count(*) * 9 AS expected, sum(CASE WHEN n % 3 > 0 THEN 9 ELSE 1 END)::BIGINT AS found, sum(CASE WHEN n % 3 > 0 THEN 0 ELSE 8 END)::BIGINT AS missing FROM b, lv GROUP BY name, level")
def u04(s, d):
    return integrity.verify_downloads(*_present(s, d))


@query("u05_pending_downloads", "aoi revisit", PICKED + ", lv(level) AS (VALUES ('L1C'), ('L2A')) SELECT name, level, count(*) * 8 AS pending FROM b, lv WHERE n % 3 = 0 GROUP BY name, level")
def u05(s, d):
    return integrity.pending_downloads(*_present(s, d)).groupBy("name", "level").agg(F.count(F.lit(1)).alias("pending"))
