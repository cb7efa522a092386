"""Queries on geometry, catalogues and revisit selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import catalogue, sampling, selection
from ..sources import points
from . import adapters as A
from .adapters import OVERLAP_SQL
from .registry import query

DAYS, CLOUD, N = 200, 60.0, 8


def _flat(df: DataFrame, column: str, *keep: str, digits: int = 6) -> DataFrame:
    names = df.select(f"{column}.*").columns
    return df.select(*keep, *[F.round(F.col(f"{column}.{n}"), digits).alias(n) for n in names])


def _day(column: str = "datetime"):
    return F.date_format(column, "yyyy-MM-dd").alias("day")


def measured(s, d) -> DataFrame:
    """Revisits with area and delta."""
    aois = A.aoi(s, d)
    return catalogue.delta_days(catalogue.with_overlap_area(A.revisit(s, d), aois), aois)


MEASURED = f"""m AS (SELECT r.aoi_index, product_id, datetime, cloud_cover, incidence, name, lon_min, lat_min, lon_max, lat_max, target_date,
 {OVERLAP_SQL} AS area, date_diff('day', target_date, CAST(datetime AS DATE)) AS delta FROM revisit r JOIN aoi a ON r.aoi_index = a.aoi_index)"""
LIMITED = f"l AS (SELECT * FROM m WHERE abs(delta) <= {DAYS} AND cloud_cover <= {CLOUD})"
RANKED = """k AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY aoi_index) = 1 THEN 1.0::DOUBLE ELSE
 rank() OVER (PARTITION BY aoi_index ORDER BY abs(delta)) + (count(*) OVER (PARTITION BY aoi_index, abs(delta)) - 1) / 2 +
 rank() OVER (PARTITION BY aoi_index ORDER BY cloud_cover) + (count(*) OVER (PARTITION BY aoi_index, cloud_cover) - 1) / 2 END AS rank FROM %s)"""
BEST = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi_index ORDER BY rank, abs(delta), cloud_cover, product_id) AS n FROM k) WHERE n <= 8)"


def limited(s, d) -> DataFrame:
    return selection.limit_cloud(selection.limit_delta(measured(s, d), DAYS), CLOUD)


def best(s, d) -> DataFrame:
    return selection.select_best(selection.rank_revisits(limited(s, d)), N)


@query("s07_normalise_poi", "point", "SELECT concat('P-', row_number() OVER (ORDER BY point_id)) AS name, round(lon, 6) AS lon, round(lat, 6) AS lat FROM point")
def s07(s, d):
    raw = A.point(s, d).selectExpr("point_id", "lon AS longitude", "lat AS latitude")
    out = points.normalise_poi(raw, name_prefix="P", order_by="point_id")
    return out.select("name", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query("g01_sample_sphere", "", """SELECT c_custkey AS point_id, round(360 * (('0x' || substr(md5('42-' || c_custkey), 1, 8))::BIGINT / 4294967296 - 0.5), 6) AS lon,
 round(degrees(acos(1 - 2 * (('0x' || substr(md5('43-' || c_custkey), 1, 8))::BIGINT / 4294967296))) - 90, 6) AS lat FROM customer""")
def g01(s, d):
    ids = A.table(s, d, "customer").select(F.col("c_custkey").alias("point_id"))
    lon, lat = sampling.sphere_point(sampling.unit_hash(F.col("point_id"), 42), sampling.unit_hash(F.col("point_id"), 43))
    return ids.select("point_id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


#: Radii of curvature give the same offsets to a part in ten million over a kilometre.
@query("g03_aoi_bounds", "aoi", f"""r AS (SELECT *, 1 - {geo.ECCENTRICITY_2!r}::DOUBLE * power(sin(radians(lat)), 2) AS w FROM aoi),
 q AS (SELECT *, degrees(sqrt(2.5::DOUBLE) / 2 * 1000 * w * sqrt(w) / ({geo.MAJOR!r}::DOUBLE * (1 - {geo.ECCENTRICITY_2!r}::DOUBLE))) AS dlat, degrees(sqrt(2.5::DOUBLE) / 2 * 1000 * sqrt(w) / ({geo.MAJOR!r}::DOUBLE * cos(radians(lat)))) AS dlon FROM r)
 SELECT aoi_index, round(lon - dlon, 5) AS lon_min, round(lat - dlat, 5) AS lat_min, round(lon + dlon, 5) AS lon_max, round(lat + dlat, 5) AS lat_max, 2.5::DOUBLE AS area FROM q""")
def g03(s, d):
    made = sampling.aoi_bounds(A.aoi(s, d).drop("bounds", "area"), 2.5)
    return _flat(made, "bounds", "aoi_index", "area", digits=5)


@query("g04_bounds_axis_swap", "aoi", "SELECT aoi_index, concat_ws(' ', round(lat_min, 4)::DECIMAL(9,4), round(lon_min, 4)::DECIMAL(9,4), round(lat_max, 4)::DECIMAL(9,4), round(lon_max, 4)::DECIMAL(9,4)) AS corners FROM aoi")
def g04(s, d):
    swapped = sampling.bounds_axis_swap(A.aoi(s, d))
    names = swapped.select("bounds.*").columns
    return swapped.select("aoi_index", F.concat_ws(" ", *[F.round(f"bounds.{n}", 4).cast("decimal(9,4)").cast("string") for n in names]).alias("corners"))


@query("g05_bounds_to_ring", "aoi", """SELECT aoi_index, p.pos::INTEGER AS pos, round(p.lon, 6) AS lon, round(p.lat, 6) AS lat FROM (SELECT aoi_index, unnest([
 {'pos': 0, 'lon': lon_min, 'lat': lat_min}, {'pos': 1, 'lon': lon_min, 'lat': lat_max}, {'pos': 2, 'lon': lon_max, 'lat': lat_max}, {'pos': 3, 'lon': lon_max, 'lat': lat_min}, {'pos': 4, 'lon': lon_min, 'lat': lat_min}]) AS p FROM aoi)""")
def g05(s, d):
    out = A.aoi(s, d).select("aoi_index", F.posexplode(geo.ring(F.col("bounds"), closed=True)).alias("pos", "p"))
    return out.select("aoi_index", "pos", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("g06_bounds_center", "aoi", "SELECT aoi_index, round(lon, 6) AS lon, round(lat, 6) AS lat FROM aoi")
def g06(s, d):
    return _flat(A.aoi(s, d).select("aoi_index", geo.center(F.col("bounds")).alias("c")), "c", "aoi_index")


def _newton(n: int) -> str:
    text = "t0 AS (SELECT point_id, lon, radians(lat) AS phi, radians(lat) AS t FROM point)"
    for i in range(1, n + 1):
        text += f", t{i} AS (SELECT point_id, lon, phi, t - (2 * t + sin(2 * t) - pi() * sin(phi)) / (2 + 2 * cos(2 * t) + 1e-15) AS t FROM t{i - 1})"
    return text


@query("g07_to_mollweide", "point", _newton(12) + " SELECT point_id, round(6378137 * 2 * sqrt(2) / pi() * radians(lon) * cos(t), 3) AS x, round(6378137 * sqrt(2) * sin(t), 3) AS y FROM t12")
def g07(s, d):
    x, y = geo.to_mollweide(F.col("lon"), F.col("lat"))
    return A.point(s, d).select("point_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@query("g08_footprint_overlap", "aoi revisit", f"SELECT product_id, {OVERLAP_SQL} AS area FROM revisit r JOIN aoi a ON r.aoi_index = a.aoi_index")
def g08(s, d):
    return catalogue.with_overlap_area(A.revisit(s, d), A.aoi(s, d)).select("product_id", "area")


@query("g09_split_bounds", "aoi", """SELECT concat_ws('-', name, x, y) AS name, round(lon_min + (x - 1) * (lon_max - lon_min) / 3, 6) AS lon_min, round(lat_min + (y - 1) * (lat_max - lat_min) / 3, 6) AS lat_min,
 round(lon_min + x * (lon_max - lon_min) / 3, 6) AS lon_max, round(lat_min + y * (lat_max - lat_min) / 3, 6) AS lat_max, round(area / 9, 6) AS area FROM aoi, range(1, 4) a(x), range(1, 4) b(y)""")
def g09(s, d):
    tiles = sampling.split_bounds(A.aoi(s, d), 9).withColumn("area", F.round("area", 6))
    return _flat(tiles, "bounds", "name", "area")


@query("g10_tile_if_large", "aoi", """z AS (SELECT *, CASE WHEN aoi_index % 4 = 0 THEN 22.5 ELSE 2.5 END AS sz FROM aoi)
 SELECT name, 2.5::DOUBLE AS area, round(lon_min, 6) AS lon_min FROM z WHERE sz = 2.5 UNION ALL
 SELECT concat_ws('-', name, x, y), 2.5::DOUBLE, round(lon_min + (x - 1) * (lon_max - lon_min) / 3, 6) FROM z, range(1, 4) a(x), range(1, 4) b(y) WHERE sz = 22.5""")
def g10(s, d):
    sized = A.aoi(s, d).withColumn("area", F.when(F.col("aoi_index") % 4 == 0, F.lit(22.5)).otherwise(F.lit(2.5)))
    return sampling.tile_if_large(sized).select("name", "area", F.round("bounds.lon_min", 6).alias("lon_min"))


@query("g11_pixel_dims", "ord", "SELECT order_id, CAST(trunc(1000 * sqrt(sqkm) / 6) AS INTEGER) AS low, CAST(trunc(1000 * sqrt(sqkm) / 1.5) AS INTEGER) AS high FROM ord")
def g11(s, d):
    low, high = geo.pixel_dims(F.col("sqkm"))
    return A.order(s, d).select("order_id", low.alias("low"), high.alias("high"))


@query("k01_search_catalogue", "aoi scene", "SELECT aoi_index, scene_id, cloud_cover FROM aoi JOIN scene ON lon_min <= f_lon_max AND f_lon_min <= lon_max AND lat_min <= f_lat_max AND f_lat_min <= lat_max WHERE cloud_cover < 70 AND datetime >= TIMESTAMP '2017-01-01'")
def k01(s, d):
    return catalogue.search_catalogue(A.aoi(s, d), A.scene(s, d), max_cloud=70).select("aoi_index", "scene_id", "cloud_cover")


@query("k02_normalise_s2", "scene", "SELECT concat('S2-', scene_id) AS product_id, 'Sentinel2' AS source, strftime(datetime, '%Y-%m-%d %H:%M') AS minute, cloud_cover, 3 AS corners, round(fx, 6) AS lon, round(fy, 6) AS lat FROM scene")
def k02(s, d):
    docs = A.scene(s, d).selectExpr("""concat('{"id":"S2-', scene_id, '","properties":{"datetime":"', date_format(datetime, "yyyy-MM-dd'T'HH:mm:ss'Z'"), '","eo:cloud_cover":', cloud_cover, '},"geometry":{"type":"MultiPolygon","coordinates":[[[[',
     footprint.lon_min + 0.05, ',', footprint.lat_min + 0.05, '],[1,2],[3,4]]]]}}') AS doc""")
    out = catalogue.normalise_s2(docs)
    return out.select("product_id", "source", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("minute"), "cloud_cover", F.size("coordinates").alias("corners"), F.round(F.col("coordinates")[0]["lon"], 6).alias("lon"), F.round(F.col("coordinates")[0]["lat"], 6).alias("lat"))


@query("k03_normalise_spot", "scene", """SELECT concat('SP-', scene_id) AS product_id, 'SPOT' AS source, strftime(datetime, '%Y-%m-%d %H:%M') AS minute, cloud_cover, (scene_id % 30)::DOUBLE AS incidence, 1.5::DOUBLE AS resolution,
 concat('<a href="http://q/', scene_id, '">link</a>') AS quicklook_link, CAST(NULL AS VARCHAR) AS thumbnail_link FROM scene""")
def k03(s, d):
    docs = A.scene(s, d).selectExpr("""concat('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[0,1],[1,2]]]},"properties":{"id":"SP-', scene_id, '","acquisitionDate":"', date_format(datetime, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
     '","cloudCover":', cloud_cover, ',"incidenceAngle":', scene_id % 30, ',"resolution":1.5},"_links":{"quicklook":{"href":"http://q/', scene_id, '"}}}') AS doc""")
    out = catalogue.normalise_spot(docs)
    return out.select("product_id", "source", F.date_format("datetime", "yyyy-MM-dd HH:mm").alias("minute"), "cloud_cover", "incidence", "resolution", "quicklook_link", "thumbnail_link")


@query("k04_dedupe_revisits", "revisit", "SELECT aoi_index, strftime(datetime, '%Y-%m-%d') AS day, min(product_id) AS product_id FROM revisit GROUP BY aoi_index, datetime")
def k04(s, d):
    return catalogue.dedupe_revisits(A.revisit(s, d)).select("aoi_index", _day(), "product_id")


@query("k05_coverage", "aoi revisit", "SELECT name, product_id, cloud_cover FROM aoi JOIN revisit USING (aoi_index)")
def k05(s, d):
    return catalogue.coverage(A.aoi(s, d), A.revisit(s, d)).select("name", "product_id", "cloud_cover")


@query("k06_with_overlap_area", "aoi revisit", MEASURED + " SELECT aoi_index, count(*) AS n, round(sum(area), 2) AS area FROM m GROUP BY aoi_index")
def k06(s, d):
    out = catalogue.with_overlap_area(A.revisit(s, d), A.aoi(s, d))
    return out.groupBy("aoi_index").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("area"), 2).alias("area"))


@query("k07_filter_full_overlap", "aoi revisit", MEASURED + " SELECT product_id, area FROM m WHERE area > 0.999 * 1.2::DOUBLE")
def k07(s, d):
    return catalogue.filter_full_overlap(measured(s, d), 1.2).select("product_id", "area")


@query("k08_resolve_target_date", "aoi", "SELECT aoi_index, strftime(target_date, '%Y-%m-%d') AS by_column, strftime(target_date + 1, '%Y-%m-%d') AS by_name, '2022-03-22' AS by_text FROM aoi")
def k08(s, d):
    aois = A.aoi(s, d).withColumn("day_after", F.date_format(F.date_add("target_date", 1), "dd-MM-yyyy"))
    named = catalogue.resolve_target_date(aois, "day_after").select("aoi_index", F.col("target_date").alias("t2"))
    text = catalogue.resolve_target_date(aois.drop("target_date"), "22-03-2022").select("aoi_index", F.col("target_date").alias("t3"))
    out = catalogue.resolve_target_date(aois).join(named, "aoi_index").join(text, "aoi_index")
    return out.select("aoi_index", F.col("target_date").cast("string").alias("by_column"), F.col("t2").cast("string").alias("by_name"), F.col("t3").cast("string").alias("by_text"))


@query("k09_delta_days", "aoi revisit", MEASURED + " SELECT product_id, CAST(delta AS INTEGER) AS delta FROM m")
def k09(s, d):
    return catalogue.delta_days(A.revisit(s, d), A.aoi(s, d)).select("product_id", "delta")


@query("k10_limits", "aoi revisit", f"{MEASURED}, {LIMITED} SELECT product_id, CAST(delta AS INTEGER) AS delta, cloud_cover FROM l")
def k10(s, d):
    return limited(s, d).select("product_id", "delta", "cloud_cover")


@query("k11_rank_revisits", "aoi revisit", f"{MEASURED}, {LIMITED}, {RANKED % 'l'} SELECT product_id, rank FROM k")
def k11(s, d):
    return selection.rank_revisits(limited(s, d)).select("product_id", "rank")


@query("k12_select_best", "aoi revisit", f"{MEASURED}, {LIMITED}, {RANKED % 'l'}, {BEST} SELECT aoi_index, product_id, rank FROM b")
def k12(s, d):
    return best(s, d).select("aoi_index", "product_id", "rank")


@query("k13_number_selected", "aoi revisit", f"{MEASURED}, {LIMITED}, {RANKED % 'l'}, {BEST} SELECT product_id, CAST(n AS INTEGER) AS n FROM b")
def k13(s, d):
    return selection.number_selected(best(s, d).drop("n")).select("product_id", "n")


@query("k14_attach_aoi", "aoi revisit", f"{MEASURED}, {LIMITED}, {RANKED % 'l'}, {BEST} SELECT product_id, name, strftime(target_date, '%Y-%m-%d') AS target_date, round(lon_min, 6) AS lon_min FROM b")
def k14(s, d):
    out = selection.attach_aoi(best(s, d), A.aoi(s, d))
    return out.select("product_id", "name", F.col("target_date").cast("string").alias("target_date"), F.round("bounds.lon_min", 6).alias("lon_min"))


K15 = f"""{MEASURED}, u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY aoi_index, datetime ORDER BY product_id) AS f FROM m) WHERE f = 1 AND abs(delta) <= {DAYS} AND cloud_cover <= {CLOUD}),
 {RANKED % 'u'}, {BEST} SELECT aoi_index, name, product_id, strftime(datetime, '%Y-%m-%d') AS day, cloud_cover, area, CAST(delta AS INTEGER) AS delta, rank, CAST(n AS INTEGER) AS n FROM b"""


@query("k15_select_revisits", "aoi revisit", K15)
def k15(s, d, spread=False):
    out = selection.select_revisits(A.aoi(s, d), A.revisit(s, d), N, DAYS, CLOUD, spread=spread)
    return out.select("aoi_index", "name", "product_id", _day(), "cloud_cover", "area", "delta", "rank", "n")


@query("k15_select_revisits_spread", "aoi revisit", K15)
def k15_spread(s, d):
    return k15(s, d, spread=True)


@query("k16_shortage_report", "aoi revisit", MEASURED + ", t AS (SELECT aoi_index, count(*) AS c FROM m WHERE abs(delta) <= 10 AND cloud_cover <= 30 GROUP BY aoi_index) SELECT aoi_index, coalesce(c, 0) AS found FROM aoi LEFT JOIN t USING (aoi_index) WHERE coalesce(c, 0) < 3")
def k16(s, d):
    few = selection.limit_cloud(selection.limit_delta(measured(s, d), 10), 30.0)
    return selection.shortage_report(A.aoi(s, d), few, 3)


NTH = "SELECT aoi_index, max(v) AS need, count(*) AS seen FROM (SELECT aoi_index, {v} AS v, row_number() OVER (PARTITION BY aoi_index ORDER BY {v}) AS p FROM m {w}) WHERE p <= {n} GROUP BY aoi_index"
NEED_D, NEED_C = NTH.format(v="abs(delta)", w="", n=40), NTH.format(v="cloud_cover", w="", n=250)
BOTH_D, BOTH_C = NTH.format(v="abs(delta)", w="WHERE cloud_cover <= 20", n=8), NTH.format(v="cloud_cover", w="WHERE abs(delta) <= 40", n=8)
COMBINED = f"""cd AS ({BOTH_D}), cc AS ({BOTH_C}), cb AS (SELECT a.aoi_index, CASE WHEN coalesce(cd.seen, 0) >= 8 AND coalesce(cc.seen, 0) >= 8 THEN CAST(cd.need AS INTEGER) END AS delta_within_cloud,
 CASE WHEN coalesce(cd.seen, 0) >= 8 AND coalesce(cc.seen, 0) >= 8 THEN cc.need END AS cloud_within_delta FROM (SELECT DISTINCT aoi_index FROM m) a LEFT JOIN cd USING (aoi_index) LEFT JOIN cc USING (aoi_index))"""


@query("k17_required_delta", "aoi revisit", f"{MEASURED} SELECT aoi_index, CASE WHEN need > 60 THEN CAST(need AS INTEGER) END AS required_delta FROM ({NEED_D})")
def k17(s, d):
    return selection.required_delta(measured(s, d), 40, 60)


@query("k18_required_cloud", "aoi revisit", f"{MEASURED} SELECT aoi_index, CASE WHEN need > 40 THEN need END AS required_cloud FROM ({NEED_C})")
def k18(s, d):
    return selection.required_cloud(measured(s, d), 250, 40.0)


@query("k19_required_combination", "aoi revisit", f"{MEASURED}, {COMBINED} SELECT * FROM cb")
def k19(s, d):
    return selection.required_combination(measured(s, d), 8, 40, 20.0)


@query("k20_recommend_parameters", "aoi revisit", f"""{MEASURED}, {COMBINED}, nd AS ({NTH.format(v='abs(delta)', w='', n=8)}), nc AS ({NTH.format(v='cloud_cover', w='', n=8)})
 SELECT aoi_index, CAST(CASE WHEN nd.need > 40 THEN nd.need ELSE 40 END AS INTEGER) AS delta, CASE WHEN nc.need > 20 THEN nc.need ELSE 20.0::DOUBLE END AS cloud, delta_within_cloud, cloud_within_delta FROM nd JOIN nc USING (aoi_index) JOIN cb USING (aoi_index)""")
def k20(s, d):
    return selection.recommend_parameters(measured(s, d), 8, 40, 20.0)


@query("k21_filter_days", "revisit", "SELECT product_id, strftime(datetime, '%Y-%m-%d') AS day FROM revisit WHERE datetime >= DATE '1996-03-01' AND datetime < DATE '1996-03-31'")
def k21(s, d):
    return selection.filter_days(A.revisit(s, d), "1996-03-01", 30).select("product_id", _day())


@query("k22_filter_cloud", "aoi revisit", "c AS (SELECT * FROM revisit WHERE incidence = 80 AND cloud_cover <= 0) SELECT aoi_index, 'kept' AS kind FROM c UNION ALL SELECT aoi_index, 'lost' FROM (SELECT DISTINCT aoi_index FROM revisit WHERE incidence = 80 AND aoi_index NOT IN (SELECT aoi_index FROM c))")
def k22(s, d):
    kept, lost = selection.filter_cloud(A.revisit(s, d).filter("incidence = 80"), 0.0)
    return kept.select("aoi_index", F.lit("kept").alias("kind")).unionByName(lost.select("aoi_index", F.lit("lost").alias("kind")))


@query("k23_filter_column", "revisit", "SELECT product_id FROM revisit WHERE incidence >= 50 AND cloud_cover < 30")
def k23(s, d):
    return selection.filter_column(selection.filter_column(A.revisit(s, d), "incidence", 50, ">="), "cloud_cover", 30, "less").select("product_id")


@query("k24_filter_overlap", "aoi revisit", MEASURED + """, c AS (SELECT * FROM m WHERE area >= 4.6) SELECT aoi_index, 'kept' AS kind, count(*) AS n FROM c GROUP BY aoi_index UNION ALL
 SELECT aoi_index, 'few', count(*) FROM c GROUP BY aoi_index HAVING count(*) < 250 UNION ALL SELECT DISTINCT aoi_index, 'lost', 0 FROM m WHERE aoi_index NOT IN (SELECT aoi_index FROM c)""")
def k24(s, d):
    kept, lost, few = selection.filter_overlap(measured(s, d), 4.6, 250)
    counted = kept.groupBy("aoi_index").agg(F.count(F.lit(1)).alias("n")).select("aoi_index", F.lit("kept").alias("kind"), "n")
    return counted.unionByName(few.select("aoi_index", F.lit("few").alias("kind"), F.col("found").alias("n"))).unionByName(lost.select("aoi_index", F.lit("lost").alias("kind"), F.lit(0).cast("long").alias("n")))


@query("k25_verify_overlap", "aoi revisit", MEASURED + " SELECT bool_and(area >= 1.2) AS all_covered FROM m")
def k25(s, d):
    return selection.verify_overlap(measured(s, d), 1.2)


@query("k26_with_classes", "aoi revisit", f"{MEASURED}, {LIMITED}, {RANKED % 'l'}, {BEST} SELECT product_id, IPCC, SMOD, LCCS FROM b LEFT JOIN (SELECT aoi_index, IPCC, SMOD, LCCS FROM aoi WHERE aoi_index % 3 > 0) USING (aoi_index)")
def k26(s, d):
    return catalogue.with_classes(best(s, d), A.aoi(s, d).filter("aoi_index % 3 > 0")).select("product_id", "IPCC", "SMOD", "LCCS")


HISTOGRAM = """, e AS (SELECT min({c})::DOUBLE AS lo, max({c})::DOUBLE AS hi FROM m) SELECT bin, round(lo + bin * (hi - lo) / 10, 6) AS low, round(lo + (bin + 1) * (hi - lo) / 10, 6) AS high, count(*) AS count
 FROM (SELECT CAST(least(floor(({c} - lo) / ((hi - lo) / 10)), 9) AS INTEGER) AS bin, lo, hi FROM m, e) GROUP BY bin, lo, hi"""


def _rounded(h: DataFrame) -> DataFrame:
    return h.select("bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "count")


@query("k27_delta_histogram", "aoi revisit", MEASURED + HISTOGRAM.format(c="delta"))
def k27(s, d):
    return _rounded(catalogue.histogram(measured(s, d), "delta"))


@query("k28_cloud_histogram", "aoi revisit", MEASURED + HISTOGRAM.format(c="cloud_cover"))
def k28(s, d):
    return _rounded(catalogue.histogram(measured(s, d), "cloud_cover"))


@query("k29_merge_download_list", "aoi revisit", f"{MEASURED}, {LIMITED}, {RANKED % 'l'}, {BEST} SELECT b.product_id, b.name, a.area, CAST(b.n AS INTEGER) AS n, a.IPCC FROM b JOIN aoi a USING (aoi_index)")
def k29(s, d):
    aois = A.aoi(s, d)
    chosen = selection.attach_aoi(best(s, d), aois)
    return catalogue.merge_download_list(aois, chosen).select("product_id", "name", "area", "n", "IPCC")
