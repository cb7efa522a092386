"""Queries on rasters, classes, distributions and stratified samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes, raster, rebalance, sampling, stratify
from ..sources import rasters
from . import adapters as A
from .q_files import scratch
from .registry import query

AFFINE = (-180.0, 90.0, 7.2, 4.5)
SIZE = 16
TARGET = 100


def _cell(x: str, y: str) -> str:
    return f"CAST(ceil((90 - {y}) / 4.5::DOUBLE) AS INTEGER) AS r, CAST(ceil(({x} + 180) / 7.2::DOUBLE) AS INTEGER) AS c"


def _values(table: dict[int, str], name: str) -> str:
    rows = ", ".join(f"({k}, '{v}')" for k, v in sorted(table.items()))
    return f"{name} (id, name) AS (VALUES {rows})"


#: Cells of blocks that exist at all, 0 where the table has none.
BLOCKED = f"blk AS (SELECT DISTINCT row // {SIZE} AS br, col // {SIZE} AS bc FROM raster_cell), cell AS (SELECT row, col, min(value) AS value FROM raster_cell GROUP BY row, col)"
LOOKED = f"""{BLOCKED}, placed AS (SELECT point_id, lon, lat, landcover_id AS given, IPCC AS point_ipcc, {_cell('lon', 'lat')} FROM point),
 looked AS (SELECT point_id, lon, lat, r, c, CAST(CASE WHEN br IS NOT NULL THEN coalesce(value, 0) END AS INTEGER) AS id FROM placed LEFT JOIN blk ON br = r // {SIZE} AND bc = c // {SIZE} LEFT JOIN cell ON row = r AND col = c)"""


def blocks(s, d):
    return raster.raster_blocks(A.raster_cell(s, d), SIZE)


BLOCK_ROWS = BLOCKED + f""", full_ AS (SELECT br, bc, y, x, coalesce(value, 0) AS v FROM blk, range(0, {SIZE}) a(y), range(0, {SIZE}) b(x) LEFT JOIN cell ON row = br * {SIZE} + y AND col = bc * {SIZE} + x)
 SELECT CAST(br AS INTEGER) AS block_row, CAST(bc AS INTEGER) AS block_col, string_agg(lpad(upper(to_hex(v)), 2, '0'), '' ORDER BY y, x) AS cells FROM full_ GROUP BY br, bc"""


@query("s09_raster_blocks", "raster_cell", BLOCK_ROWS)
def s09(s, d):
    return blocks(s, d).withColumn("cells", F.hex("cells"))


def raster_folder(s, d):
    """The blocks as raster files; the path."""
    path = scratch(s, "raster")
    rasters.write_raster_blocks(blocks(s, d), path, AFFINE, SIZE)
    return path


@query("s09_raster_files", "raster_cell", BLOCK_ROWS)
def s09_files(s, d):
    """The same blocks, written as raster files and read back by path. Files know no rows left of or above them: their first block is 0."""
    first = blocks(s, d).agg(F.min("block_row"), F.min("block_col")).first()
    out = rasters.load_raster_blocks(s, raster_folder(s, d), SIZE)
    return out.select((F.col("block_row") + first[0]).alias("block_row"), (F.col("block_col") + first[1]).alias("block_col"), F.hex("cells").alias("cells"))


LOOKUP = LOOKED + " SELECT point_id, id AS landcover_id, coalesce(id, 0) AS smod_id FROM looked"


@query("c01_raster_file_lookup", "point raster_cell", LOOKUP)
def c01_files(s, d):
    p = A.point(s, d).select("point_id", "lon", "lat")
    path = raster_folder(s, d)
    out = raster.raster_file_lookup(p, path, F.col("lon"), F.col("lat"), "landcover_id")
    return raster.raster_file_lookup(out, path, F.col("lon"), F.col("lat"), "smod_id", missing=0).select("point_id", "landcover_id", "smod_id")


@query("c01_raster_lookup", "point raster_cell", LOOKUP)
def c01(s, d):
    p = A.point(s, d).select("point_id", "lon", "lat")
    out = raster.raster_lookup(p, blocks(s, d), AFFINE, F.col("lon"), F.col("lat"), "landcover_id", SIZE)
    return raster.raster_lookup(out, blocks(s, d), AFFINE, F.col("lon"), F.col("lat"), "smod_id", SIZE, missing=0).select("point_id", "landcover_id", "smod_id")


def _some_ids(s, d):
    return A.point(s, d).select("point_id", F.expr("CASE WHEN point_id % 41 = 0 THEN 151 WHEN point_id % 43 = 0 THEN NULL ELSE landcover_id END").alias("landcover_id"))


SOME = "sids AS (SELECT point_id, CASE WHEN point_id % 41 = 0 THEN 151 WHEN point_id % 43 = 0 THEN NULL ELSE landcover_id END AS landcover_id FROM point)"


@query("c02_lccs_name", "point", f"{SOME}, {_values(classes.LCCS, 'n')} SELECT point_id, name AS LCCS FROM sids LEFT JOIN n ON landcover_id = id")
def c02(s, d):
    return stratify.lccs_name(_some_ids(s, d)).select("point_id", "LCCS")


@query("c03_ipcc_name", "point", f"{SOME}, {_values(classes.IPCC, 'n')} SELECT point_id, name AS IPCC FROM sids LEFT JOIN n ON landcover_id = id")
def c03(s, d):
    return stratify.ipcc_name(_some_ids(s, d)).select("point_id", "IPCC")


@query("c04_smod_name", "point", f"m AS (SELECT point_id, CASE WHEN point_id % 9 = 0 THEN NULL WHEN point_id % 9 = 1 THEN -200 ELSE point_id % 31 END AS i FROM point), {_values(classes.SMOD, 'n')} SELECT point_id, CASE WHEN i IS NULL THEN 'None' ELSE name END AS SMOD FROM m LEFT JOIN n ON i = id")
def c04(s, d):
    ids = A.point(s, d).select("point_id", F.expr("cast(CASE WHEN point_id % 9 = 0 THEN NULL WHEN point_id % 9 = 1 THEN -200 ELSE point_id % 31 END AS int)").alias("SMOD_id"))
    return stratify.smod_name(ids).select("point_id", "SMOD")


@query("c05_stratify", "point raster_cell", f"{LOOKED}, {_values(classes.LCCS, 'nl')}, {_values(classes.IPCC, 'ni')}, {_values(classes.SMOD, 'ns')} SELECT point_id, looked.id AS landcover_id, nl.name AS LCCS, ni.name AS IPCC, coalesce(looked.id, 0) AS SMOD_id, ns.name AS SMOD FROM looked LEFT JOIN nl ON looked.id = nl.id LEFT JOIN ni ON looked.id = ni.id LEFT JOIN ns ON coalesce(looked.id, 0) = ns.id")
def c05(s, d):
    p = A.point(s, d).select("point_id", "lon", "lat")
    return stratify.stratify(p, blocks(s, d), AFFINE, blocks(s, d), AFFINE, SIZE, smod_mollweide=False).select("point_id", "landcover_id", "LCCS", "IPCC", "SMOD_id", "SMOD")


@query("c06_class_distribution", "point", "SELECT 'IPCC' AS kind, IPCC AS class, count(*) AS count FROM point GROUP BY 2 UNION ALL SELECT 'SMOD', SMOD, count(*) FROM point GROUP BY 2 UNION ALL SELECT 'landcover_id', landcover_id::VARCHAR, count(*) FROM point GROUP BY 2")
def c06(s, d):
    return stratify.class_distributions(A.point(s, d), ["IPCC", "SMOD", "landcover_id"])


@query("c07_conditional_distribution", "point", "SELECT IPCC, SMOD, count(*) AS count FROM point GROUP BY ALL")
def c07(s, d):
    return stratify.conditional_distribution(A.point(s, d), "IPCC", "SMOD")


@query("c08_subclass_distribution", "point", "SELECT SMOD, count(*) AS count FROM point WHERE IPCC = 'Settlement' GROUP BY SMOD")
def c08(s, d):
    return stratify.subclass_distribution(A.point(s, d), "IPCC", "Settlement", "SMOD")


SHARES = "sh AS (SELECT IPCC, count(*) AS count, {f} / sum({f}) OVER () AS share FROM point {w} GROUP BY IPCC)"


@query("c09_rebalance", "point", "h AS (SELECT IPCC, count(*) AS n FROM point GROUP BY IPCC) SELECT IPCC, n AS count, round(sqrt(n) / sum(sqrt(n)) OVER (), 8) AS root, round(cbrt(n) / sum(cbrt(n)) OVER (), 8) AS cube FROM h")
def c09(s, d):
    h = stratify.class_distribution(A.point(s, d), "IPCC")
    root = rebalance.rebalance(h, F.sqrt).withColumnRenamed("share", "root")
    return rebalance.rebalance(root, F.cbrt).select("IPCC", "count", F.round("root", 8).alias("root"), F.round("share", 8).alias("cube"))


ALLOCATE = """g AS (SELECT *, sqrt(n) / sum(sqrt(n)) OVER () AS share FROM h), st AS (SELECT *, round(share, 2) * {t} AS start FROM g),
 sh AS (SELECT *, greatest(ceil({t} - sum(start) OVER ()), 0)::BIGINT AS short, count(*) OVER () AS k, row_number() OVER (ORDER BY (share * 100) % 1 DESC, {c}) - 1 AS r FROM st),
 al AS (SELECT *, CAST(trunc(start + short // k + CASE WHEN r < short % k THEN 1 ELSE 0 END) AS INTEGER) AS number_of_pois FROM sh)"""
IPCC_H = "h AS (SELECT IPCC, count(*) AS n FROM point GROUP BY IPCC)"
ALLOCATED = f"{IPCC_H}, {ALLOCATE.format(t=TARGET, c='IPCC')}"


def allocated(s, d, target=TARGET):
    return rebalance.allocate_counts(rebalance.rebalance(stratify.class_distribution(A.point(s, d), "IPCC")), target, "IPCC")


@query("c10_allocate_counts", "point", f"{ALLOCATED} SELECT IPCC, number_of_pois FROM al")
def c10(s, d):
    return allocated(s, d).select("IPCC", "number_of_pois")


@query("c11_rebalance_within", "point", f"h AS (SELECT SMOD, count(*) AS n FROM point WHERE IPCC = 'Settlement' GROUP BY SMOD), {ALLOCATE.format(t=37, c='SMOD')} SELECT SMOD, number_of_pois, 'IPCC_Settlement_SMOD' AS name FROM al")
def c11(s, d):
    return rebalance.rebalance_within(A.point(s, d), "IPCC", "Settlement", "SMOD", 37).select("SMOD", "number_of_pois", "name")


@query("c12_allocation_check", "point", f"{ALLOCATED} SELECT sum(number_of_pois)::BIGINT AS total, sum(number_of_pois) = {TARGET} AS matches FROM al")
def c12(s, d):
    return rebalance.allocation_check(allocated(s, d), TARGET)


SAMPLE = f"{ALLOCATED}, sm AS (SELECT * FROM (SELECT point_id, p.IPCC, number_of_pois, row_number() OVER (PARTITION BY p.IPCC ORDER BY md5('42-' || point_id), point_id) AS r FROM point p JOIN al ON p.IPCC = al.IPCC) WHERE r <= number_of_pois)"


@query("c13_stratified_sample", "point", f"{SAMPLE} SELECT point_id, IPCC FROM sm")
def c13(s, d):
    return rebalance.stratified_sample(A.point(s, d), allocated(s, d), "IPCC").select("point_id", "IPCC")


@query("c13_top_up", "point", "h AS (SELECT IPCC, floor(count(*) * 3 / 5) AS k FROM point GROUP BY IPCC) SELECT point_id, IPCC FROM (SELECT point_id, IPCC, k, row_number() OVER (PARTITION BY IPCC ORDER BY md5('42-' || point_id), point_id) AS r FROM point JOIN h USING (IPCC)) WHERE r <= k")
def c13_top_up(s, d):
    """Three fifths of every class from growing draws of an eighth, a quarter, half and all of the points: the last is needed."""
    p = A.point(s, d)
    wanted = stratify.class_distribution(p, "IPCC").select("IPCC", F.floor(F.col("count") * 3 / 5).cast("int").alias("number_of_pois"))
    return rebalance.sample_with_top_up(lambda a, b: p.filter((F.col("point_id") > a) & (F.col("point_id") <= b)), wanted, "IPCC", -(-p.count() // 8)).select("point_id", "IPCC")


@query("c14_sampled_distribution", "point", f"{SAMPLE} SELECT al.IPCC, count(sm.point_id) AS sampled, any_value(al.number_of_pois) AS wanted FROM al LEFT JOIN sm USING (IPCC) GROUP BY al.IPCC")
def c14(s, d):
    a = allocated(s, d)
    return rebalance.sampled_distribution(rebalance.stratified_sample(A.point(s, d), a, "IPCC"), a, "IPCC")


@query("g02_sample_land", "raster_cell", f"""{BLOCKED}, u AS (SELECT i AS point_id, 360 * (('0x' || substr(md5('42-' || i), 1, 8))::BIGINT / 4294967296 - 0.5) AS lon, degrees(acos(1 - 2 * (('0x' || substr(md5('43-' || i), 1, 8))::BIGINT / 4294967296))) - 90 AS lat FROM range(0, 1638400) t(i)),
 placed AS (SELECT point_id, lon, lat, {_cell('lon', 'lat')} FROM u) SELECT point_id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM placed JOIN cell ON row = r AND col = c WHERE value NOT IN (0, 210) ORDER BY point_id LIMIT 200""")
def g02(s, d):
    mask = blocks(s, d)

    def on_land(points):
        looked = raster.raster_lookup(points, mask, AFFINE, F.col("lon"), F.col("lat"), "id", SIZE)
        return looked.filter("id IS NOT NULL AND id NOT IN (0, 210)").drop("id")

    out = sampling.sample_land(s, 200, on_land)
    return out.select("point_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
