"""Golden values, properties, edge cases and plans."""

import math
import time

import numpy as np
import pytest
import reference_kernels as kernels
from pyspark.sql import functions as F

from orbitframe.functions import geo
from orbitframe.operators import catalogue, cells, chips, images, integrity, metrics, orders, raster, rebalance, sampling, selection, stratify
from orbitframe.plans import adapters as A
from orbitframe.plans import queries
from orbitframe.sources import files, points

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pixel_dims(spark):
    low, high = geo.pixel_dims(F.lit(2.5))
    assert tuple(spark.range(1).select(low, high).first()) == (263, 1054)


@pytest.mark.parametrize("lat", [0.0, 45.0, -60.0, 85.0])
def test_bounds_have_the_area(spark, lat):
    p = spark.createDataFrame([(10.0, lat)], "lon double, lat double")
    b = F.col("bounds")
    got = sampling.aoi_bounds(p, 2.5).select(geo.box_area_km2(b["lon_min"], b["lat_min"], b["lon_max"], b["lat_max"])).first()[0]
    assert abs(got / 2.5 - 1) < 1e-3


def test_direct_against_a_published_line(spark):
    end = spark.range(1).select(geo.direct(F.lit(0.0), F.lit(0.0), 90, F.lit(111319.490793)).alias("e")).select("e.*").first()
    assert abs(end.lon - 1) < 1e-7 and abs(end.lat) < 1e-9


def test_existing_bounds_stay(spark):
    p = A.aoi(spark, DATA)
    made = sampling.aoi_bounds(p, 2.5)
    assert made.join(p.withColumnRenamed("bounds", "old"), "aoi_index").filter("bounds.lon_min != old.lon_min").count() == 0


def test_mollweide_poles_and_inverse(spark):
    x, y = geo.to_mollweide(F.col("lon"), F.col("lat"))
    rows = spark.createDataFrame([(0.0, 90.0), (180.0, 0.0), (30.0, 40.0)], "lon double, lat double").select("lon", "lat", x.alias("x"), y.alias("y")).collect()
    assert abs(rows[0].y - geo.MOLLWEIDE_RADIUS * math.sqrt(2)) < 1e-3
    assert abs(rows[1].x - geo.MOLLWEIDE_RADIUS * 2 * math.sqrt(2)) < 1e-3
    theta = math.asin(rows[2].y / geo.MOLLWEIDE_RADIUS / math.sqrt(2))
    assert abs(math.degrees(math.asin((2 * theta + math.sin(2 * theta)) / math.pi)) - 40) < 1e-9


def test_range_join_has_no_nested_loop(spark):
    found = catalogue.search_catalogue(A.aoi(spark, DATA), A.scene(spark, DATA))
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)


def test_flagship_shuffles_on_the_area_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    text = plan(selection.select_revisits(A.aoi(spark, DATA), A.revisit(spark, DATA), 8, 200, 60.0))
    assert text.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in text and "Python" not in text


def test_average_rank(spark):
    rows = [(1, "a", 3, 10.0), (1, "b", -3, 20.0), (1, "c", 5, None), (2, "d", 9, 50.0)]
    df = spark.createDataFrame(rows, "aoi_index long, product_id string, delta int, cloud_cover double")
    got = {r.product_id: r["rank"] for r in selection.rank_revisits(df).collect()}
    assert got == {"a": 2.5, "b": 3.5, "c": None, "d": 1.0}


def test_operators_by_name(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert [selection.filter_column(df, "x", 2, op).count() for op in (">", "<", ">=", "<=", "=")] == [1, 1, 2, 2, 1]
    with pytest.raises(ValueError):
        selection.filter_column(df, "x", 2, "like")


def test_target_dates(spark):
    df = spark.createDataFrame([(1,)], "aoi_index long")
    assert str(catalogue.resolve_target_date(df, "22-03-2022").first().target_date) == "2022-03-22"
    with pytest.raises(ValueError):
        catalogue.resolve_target_date(df)


@pytest.mark.parametrize("counts,target", [([5, 3, 2], 10), ([1, 1, 1], 100), ([97, 2, 1], 7), ([10] * 7, 1000)])
def test_allocation_matches_the_loop(spark, counts, target):
    df = spark.createDataFrame([(f"c{i}", n) for i, n in enumerate(counts)], "cls string, count long")
    got = {r.cls: r.number_of_pois for r in rebalance.allocate_counts(rebalance.rebalance(df, lambda c: c), target, "cls").collect()}
    share = {f"c{i}": n / sum(counts) for i, n in enumerate(counts)}
    want = {c: math.floor(s * 100 + 0.5) / 100 * target for c, s in share.items()}
    order = sorted(share, key=lambda c: (-((share[c] * 100) % 1), c))
    for i in range(max(0, math.ceil(target - sum(want.values()) - 1e-9))):
        want[order[i % len(order)]] += 1
    assert got == {c: int(v + 1e-9) for c, v in want.items()}


def test_stratified_sample_counts_and_top_up(spark):
    allocated = spark.createDataFrame([("a", 3), ("b", 5)], "cls string, number_of_pois int")

    def draw(a, b):
        return spark.range(a, b).selectExpr("id AS point_id", "CASE WHEN id % 4 = 0 THEN 'b' ELSE 'a' END AS cls")

    sample = rebalance.sample_with_top_up(draw, allocated, "cls", 8)
    assert {r.cls: r["count"] for r in sample.groupBy("cls").count().collect()} == {"a": 3, "b": 5}
    assert sorted(map(tuple, sample.collect())) == sorted(map(tuple, rebalance.stratified_sample(draw(0, 32), allocated, "cls").collect()))
    with pytest.raises(RuntimeError, match="b after 1"):
        rebalance.sample_with_top_up(draw, allocated, "cls", 8, rounds=1)


def test_raster_rounding(spark):
    cells = spark.createDataFrame([(r, c, 10 * r + c) for r in range(6) for c in range(6)], "row int, col int, value int")
    blocks = raster.raster_blocks(cells, 4)
    p = spark.createDataFrame([(1.5, -1.5), (50.0, 50.0)], "x double, y double")

    def look(rounding):
        return [r.v for r in raster.raster_lookup(p, blocks, (0.0, 0.0, 1.0, 1.0), F.col("x"), F.col("y"), "v", 4, rounding=rounding).orderBy("x").collect()]

    assert look("ceil") == [22, None] and look("floor") == [11, None]


def test_class_names_of_unknown_ids(spark):
    df = spark.createDataFrame([(151,), (None,), (7,)], "landcover_id int")
    rows = stratify.ipcc_name(stratify.lccs_name(df)).collect()
    assert sorted((r.landcover_id or 0, r.LCCS, r.IPCC) for r in rows) == [(0, None, None), (7, None, None), (151, None, "Other")]


def test_points_from_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('poi_id,source,id_within_source,lat,lon,geometry,description\n1,S,"x, y",51.5,-0.1,POINT (-0.1 51.5),"a, b"\n2,S,z,1,2,POINT (2 1),\n')
    (tmp_path / "a.json").write_text('[{"id": 1, "longitude": 2.0, "latitude": 3.0}]')
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Point","coordinates":[2.0,3.0]},"properties":{"name":"n"}}]}')
    (tmp_path / "a.xml").write_text("<rows><row><id>1</id><lon>2.0</lon><lat>3.0</lat></row></rows>")
    (tmp_path / "a.kml").write_text('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>n</name><Point><coordinates>2.0,3.0,0</coordinates></Point></Placemark></Document></kml>')
    named = points.normalise_poi(points.load_poi(spark, str(tmp_path / "a.csv")))
    assert [r.name for r in named.orderBy("poi_id").collect()] == ["1", "2"] and named.first().id_within_source == "x, y"
    for kind in ("json", "geojson", "xml", "kml"):
        row = points.normalise_poi(points.load_poi(spark, str(tmp_path / f"a.{kind}"))).first()
        assert (row.lon, row.lat) == (2.0, 3.0)
    with pytest.raises(ValueError):
        points.load_poi(spark, "a.txt")
    with pytest.raises(ValueError):
        points.normalise_poi(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"))
    wkt = points.normalise_poi(spark.createDataFrame([("p", "POINT (-0.1 51.5)")], "name string, geometry string")).first()
    assert (wkt.lon, wkt.lat) == (-0.1, 51.5)
    points.write_points_csv(named.select("name", "lon", "lat"), str(tmp_path / "out"))
    assert points.read_points_csv(spark, str(tmp_path / "out"), "name string, lon double, lat double").count() == 2


def test_inventory_and_writers(spark, tmp_path):
    for n in (2, 10):
        folder = tmp_path / "A1" / "L2A"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"A1-{n}-L2A_data.tiff").write_bytes(b"x")
    (tmp_path / "A1" / "A1_ps.tiff").write_bytes(b"xyz")
    inv = files.image_inventory(spark, str(tmp_path)).collect()
    assert {(r.aoi, r.level, r.n, r.product) for r in inv} == {("A1", "L2A", 2, "L2A_data"), ("A1", "L2A", 10, "L2A_data"), ("A1", None, None, "ps")}
    files.write_chips(A.chip(spark, DATA), str(tmp_path / "chips"))
    assert spark.read.parquet(str(tmp_path / "chips")).count() == A.chip(spark, DATA).count()
    files.write_by_collection(A.order(spark, DATA), str(tmp_path / "orders"))
    assert spark.read.option("header", True).csv(str(tmp_path / "orders")).select("collection").distinct().count() == 5


def test_orders_must_be_created(spark):
    orders.check_created(spark.createDataFrame([("CREATED",)], "status string"))
    with pytest.raises(ValueError):
        orders.check_created(spark.createDataFrame([("CREATED",), (None,)], "status string"))
    with pytest.raises(ValueError):
        orders.band_plan(spark.range(1), metadata=["nope"])


def test_split_list_must_be_complete(spark):
    c = A.chip(spark, DATA)
    with pytest.raises(ValueError):
        images.split_from_list(c, A.split_list(spark, DATA).filter("split != 'val'"))
    split = images.split_scenes(c)
    assert split.groupBy("aoi").agg(F.countDistinct("split").alias("n")).filter("n > 1").count() == 0


def test_chips_partition_the_image(spark):
    c = A.chip(spark, DATA).limit(3)
    cut = images.chip_images(c, 8, 8, 4, 4)
    total = F.sum(F.aggregate("pixels", F.lit(0).cast("long"), lambda a, v: a + v))
    assert cut.count() == 12 and cut.agg(total).first()[0] == c.agg(total).first()[0]
    with pytest.raises(ValueError):
        images.chip_grid(8, 8, 9, 9)


def test_registration_finds_the_shift(spark):
    a = np.random.default_rng(0).random((12, 12))
    df = spark.createDataFrame([(1, 1, 12, 12, a.reshape(-1).tolist())], "aoi int, band int, h int, w int, pixels array<double>")
    moved = chips.shift_image(df, -1, 2)
    pair = metrics.pairs(df, moved, ["aoi"])
    got = metrics.registered_loss(pair, ["aoi"], 2).first()
    assert (got.dx, got.dy) == (1, -2) and got.loss < 1e-12


def test_lanczos_whole_and_half_shifts():
    a = np.add.outer(np.arange(16.0), 2 * np.arange(16.0))
    assert np.allclose(kernels.lanczos_shift(a, 0, 0), a, atol=0.02)
    inner = (slice(4, -4), slice(4, -4))
    assert np.allclose(kernels.lanczos_shift(a, 1, 0)[inner], (a - 2)[inner], atol=0.02)
    assert np.allclose(kernels.lanczos_shift(a, 0.5, -0.5)[inner], (a - 1 + 0.5)[inner], atol=0.05)


def test_resize_keeps_constants_and_means():
    assert np.allclose(kernels.resize(np.full((7, 5), 3.0), 11, 13, "bicubic"), 3)
    a = np.random.default_rng(1).random((8, 8))
    assert abs(kernels.resize(a, 4, 4, "bilinear").mean() - a.mean()) < 0.02
    assert np.allclose(kernels.resize(a, 8, 8, "bilinear"), a)


def test_ssim_of_equal_images_is_zero():
    a = np.random.default_rng(2).random((9, 9))
    assert kernels.ssim_loss(a, a) < 1e-9 < kernels.ssim_loss(a, 1 - a)


def test_ring_overlap_equals_the_box_form(spark):
    aois = A.aoi(spark, DATA).select("aoi_index", "bounds")
    joined = A.revisit(spark, DATA).limit(200).join(aois, "aoi_index").withColumn("coordinates", geo.ring(F.col("footprint"), closed=True))
    both = metrics.overlap_area_rings(joined).withColumn("box", geo.box_overlap_km2(F.col("footprint"), F.col("bounds")))
    assert both.filter("abs(area - box) > 0.011").count() == 0


def test_pad_revisits_and_empty_tables(spark):
    c = A.chip(spark, DATA)
    assert chips.pad_revisits(c.filter("revisit <= 3")).groupBy("aoi").count().filter("count != 4").count() == 0
    assert catalogue.histogram(A.revisit(spark, DATA).limit(0), "cloud_cover").count() == 0
    assert images.band_stats(c.limit(0)).count() == 0
    assert integrity.all_match(spark.createDataFrame([], "path string, matches boolean")).first().all_match


def test_weighted_loss_weights(spark):
    log = spark.createDataFrame([(0.5, 0.25, 1.0)], "MSE double, MAE double, TV double")
    assert metrics.weighted_loss(log, 0.5, 0.5, tv=1.0).first().loss == 1.375
    with pytest.raises(ValueError):
        metrics.weighted_loss(log, 0.5)


def as_chips(spark, images):
    rows = [(k, 1, *a.shape, a.reshape(-1).tolist()) for k, a in enumerate(images)]
    return spark.createDataFrame(rows, "aoi int, band int, h int, w int, pixels array<double>")


def arrays(df):
    return {r.aoi: np.array(r.pixels).reshape(r.h, r.w) for r in df.collect()}


@pytest.mark.parametrize("mode", ["bilinear", "bicubic"])
@pytest.mark.parametrize("size", [(12, 12), (3, 5), (7, 16), (8, 6), (1, 1)])
def test_resize_equals_the_matrix_form(spark, mode, size):
    rng = np.random.default_rng(4)
    images_ = [rng.random((8, 6)), rng.random((5, 9)), rng.random((8, 6)), np.full((2, 2), 3.0)]
    got = arrays(chips.resize(as_chips(spark, images_), *size, mode))
    assert all(np.allclose(got[k], kernels.resize(a, *size, mode)) for k, a in enumerate(images_))


def test_resize_of_unknown_kind_and_of_nothing(spark):
    with pytest.raises(ValueError):
        chips.resize(as_chips(spark, [np.ones((2, 2))]), 3, 3, "cubic")
    assert chips.resize(as_chips(spark, [np.ones((2, 2))]).limit(0), 3, 3).count() == 0


@pytest.mark.parametrize("dx,dy", [(0, 0), (0.5, -0.25), (1.75, 2), (-2.5, 0.4)])
def test_lanczos_shift_equals_the_padded_form(spark, dx, dy):
    rng = np.random.default_rng(6)
    images_ = [rng.random((9, 7)), rng.random((6, 11))]
    got = arrays(chips.lanczos_shift(as_chips(spark, images_), dx, dy))
    assert all(np.allclose(got[k], kernels.lanczos_shift(a, dx, dy)) for k, a in enumerate(images_))


def test_subpixel_registration_equals_resampling_and_finds_a_half_pixel(spark):
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:20, 0:18]

    def scene(dx, dy):
        return np.sin((x - dx) / 3) + np.cos((y - dy) / 2.5) + 0.3 * np.sin((x - dx + y - dy) / 4)

    noise = rng.random((2, 20, 18))
    pred, truth = as_chips(spark, [scene(0, 0), noise[0]]), as_chips(spark, [scene(0.5, -1), noise[1]])
    found = {r.aoi: r for r in metrics.subpixel_loss(metrics.pairs(pred, truth, ["aoi"]), ["aoi"], 2).collect()}
    assert (found[0].dx, found[0].dy) == (-0.5, 1.0) and found[0].loss < 1e-3

    def tap(o, d):
        v = o - d + 1e-3
        return 3 * math.sin(math.pi * v) * math.sin(math.pi * v / 3) / (math.pi * v) ** 2 if abs(v) < 3 else 0.0

    best = None
    for dy, dx in [(a / 2, b / 2) for a in range(-4, 5) for b in range(-4, 5)]:
        ky, kx = (np.array([tap(o, d) for o in range(-5, 6)]) for d in (dy, dx))
        moved = sum(ky[i] / ky.sum() * kx[j] / kx.sum() * noise[1][10 - i : 20 - i, 10 - j : 18 - j] for i in range(11) for j in range(11))
        best = min(best or (9, 0, 0), (((noise[0][5:15, 5:13] - moved) ** 2).mean(), dy, dx))
    assert np.allclose((found[1].loss, found[1].dy, found[1].dx), best)


def test_subpixel_registration_of_small_images_has_no_row(spark):
    pair = metrics.pairs(*[as_chips(spark, [np.ones((10, 10))])] * 2, ["aoi"])
    assert metrics.subpixel_loss(pair, ["aoi"], 2).count() == 0


def test_ssim_of_mixed_sizes(spark):
    rng = np.random.default_rng(8)
    a, b = ([rng.random((6, 9)), rng.random((5, 5)), rng.random((6, 9))] for _ in range(2))
    got = {r.aoi: r for r in metrics.ssim_log(metrics.pairs(as_chips(spark, a), as_chips(spark, b), ["aoi"]), ["aoi"]).collect()}
    plain = {r.aoi: r for r in metrics.metric_log(metrics.pairs(as_chips(spark, a), as_chips(spark, b), ["aoi"]), ["aoi"]).collect()}
    for k in range(3):
        assert abs(got[k].SSIM_loss - kernels.ssim_loss(a[k], b[k])) < 1e-9
        assert all(abs(got[k][m] - plain[k][m]) < 1e-9 for m in ("MSE", "MAE", "TV", "PSNR"))


def test_concave_and_odd_rings(spark):
    box = (10.0, 20.0, 12.0, 21.0)
    rings = [
        [(9, 19), (9, 22), (11, 20.5), (13, 22), (13, 19)], [(9, 20.2), (13, 20.2), (13, 20.4), (9.5, 20.4), (9.5, 20.6), (13, 20.6), (13, 20.8), (9, 20.8)],
        [(11, 19), (13, 20.5), (11, 22), (9, 20.5), (11, 19)], [(10.5, 20.2), (10.5, 20.8), (11.5, 20.8)], [(0, 0), (1, 0), (1, 1)], [(11, 20.5)], [], [(10, 20), (10, 21), (12, 21), (12, 20)],
    ]
    rows = [(i, [(float(x), float(y)) for x, y in r], box) for i, r in enumerate(rings)] + [(99, None, box)]
    df = spark.createDataFrame(rows, f"k int, coordinates {geo.RING}, bounds struct<lon_min:double,lat_min:double,lon_max:double,lat_max:double>")
    got = {r.k: r.area for r in metrics.overlap_area_rings(df).collect()}
    assert got.pop(99) == 0
    assert all(abs(got[i] - round(kernels.ring_area_km2(kernels.ring_overlap(r, box)), 2)) < 0.011 for i, r in enumerate(rings))


def test_map_chips_to_any_number_of_rows(spark):
    df = as_chips(spark, [np.array([[1.0, 2.0], [3.0, 4.0]]), np.zeros((1, 1)), np.ones((3, 1))])
    out = chips.map_chips(df, lambda a: [(int(i), float(v)) for i, v in enumerate(a.sum(axis=1)) if v], "line int, total double", keep=("aoi",))
    assert out.columns == ["aoi", "line", "total"] and sorted(map(tuple, out.collect())) == [(0, 0, 3.0), (0, 1, 7.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    assert chips.map_chips(df, lambda a: [], "line int").count() == 0
    turned = arrays(chips.map_chips(df, lambda a: a.T))
    assert turned[2].shape == (1, 3)


def test_image_queries_need_no_python_workers(spark):
    for name in ("p07_pansharpen_resized", "p10_resize_bicubic", "p15_lanczos_shift", "p19_baseline_upscale", "m07_subpixel_loss", "g08_ring_overlap"):
        text = plan(queries.QUERIES[name](spark, DATA))
        assert "Python" not in text and "InArrow" not in text, name


BOX = "struct<lon_min:double,lat_min:double,lon_max:double,lat_max:double>"


def spans(box):
    west, _, east, _ = box
    if east - west >= 360:
        return [(-180, 180)]
    west, east = (west - 360, east - 360) if west > 180 else (west + 360, east + 360) if east < -180 else (west, east)
    if east > 180 or west > east:
        return [(west, 180), (-180, east - 360 if east > 180 else east)]
    return [(west + 360, 180), (-180, east)] if west < -180 else [(west, east)]


def brute_pairs(aois, scenes):
    return sorted((i, k) for i, a in aois for k, b in scenes if a[1] <= b[3] and b[1] <= a[3] and any(p[0] <= q[1] and q[0] <= p[1] for p in spans(a) for q in spans(b)))


def searched(spark, aois, scenes):
    left = spark.createDataFrame(aois, f"aoi_index int, bounds {BOX}")
    right = spark.createDataFrame(scenes, f"scene_id int, footprint {BOX}").withColumns({"datetime": F.lit("2020-01-01").cast("timestamp"), "cloud_cover": F.lit(1.0), "x": F.lit("kept"), "_cell": F.lit(1), "_a": F.lit(2), "level": F.lit(3)})
    return catalogue.search_catalogue(left, right)


def test_boxes_over_the_date_line(spark):
    aois = [(0, (179.5, 0.0, 180.5, 1.0)), (1, (179.5, 0.0, -179.5, 1.0)), (2, (-180.5, 0.0, -179.5, 1.0)), (3, (-179.8, 0.2, -179.7, 0.3)), (4, (179.7, 0.2, 179.8, 0.3)), (5, (-180.0, -1.0, 180.0, 1.0)), (6, (10.0, 0.0, 11.0, 1.0)), (7, (-180.0, 0.0, -179.9, 1.0)), (8, (180.2, 0.0, 180.4, 1.0)), (9, (-200.0, -1.0, 200.0, 1.0))]
    scenes = [(k, b) for k, b in aois] + [(100, (179.9, 0.5, 181.0, 0.6)), (100, (179.9, 0.5, 181.0, 0.6)), (101, (175.0, 5.0, -175.0, 6.0)), (102, (-179.9, 0.9, -179.6, 2.0))]
    found = searched(spark, aois, scenes)
    assert set(found.select("x").distinct().first()) == {"kept"}
    assert sorted((r.aoi_index, r.scene_id) for r in found.collect()) == brute_pairs(aois, scenes)


@pytest.mark.parametrize("spread", [0.3, 0.01])
def test_a_crowded_city_is_dealt_over_many_tasks(spark, monkeypatch, spread):
    monkeypatch.setattr(cells, "MOST", 50)
    rng = np.random.default_rng(9)

    def boxes(n, half):
        at = rng.normal([2.35, 48.85], spread, (n, 2))
        return [(i, (float(x - half), float(y - half), float(x + half), float(y + half))) for i, (x, y) in enumerate(at)]

    aois, scenes = boxes(300, 0.01), boxes(2000, 0.02)
    found = searched(spark, aois, scenes)
    assert sorted((r.aoi_index, r.scene_id) for r in found.collect()) == brute_pairs(aois, scenes)
    right = cells.parts(spark.createDataFrame(scenes, f"scene_id int, footprint {BOX}"), "footprint", "_b")
    left = cells.parts(spark.createDataFrame(aois, f"aoi_index int, bounds {BOX}"), "bounds", "_a")
    grid = cells.plan_grid(left, right, ("_a", "_b"), 1.0, (300, 2000))
    sizes = [r["count"] for r in cells.covered(right, "_b", grid, 1).groupBy(*cells.KEY).count().collect()]
    assert max(sizes) <= 4 * 50 and sum(sizes) < 60 * 2000
    plain = cells.covered(right, "_b", cells.Grid(1.0), 1).groupBy(*cells.KEY).count().agg(F.max("count")).first()[0]
    assert plain > 500


def test_medians_of_many_revisits_in_short_stretches(spark, monkeypatch):
    monkeypatch.setattr(chips, "STACKED", 700)
    rng = np.random.default_rng(10)
    stack = rng.integers(0, 50, (200, 11))
    rows = [(1, i, 1, stack[i].tolist(), [int(i % 3 == 0)] * 11) for i in range(200)] + [(2, 1, 1, [4, 5], [1, 1]), (2, 2, 1, [3, 9], [1, 1]), (3, 1, 1, [], [])]
    df = spark.createDataFrame(rows, "aoi int, revisit int, band int, pixels array<int>, mask array<int>")
    got = {r.aoi: r.pixels for r in chips.reference_frame(df).collect()}
    assert got == {1: np.sort(stack, axis=0)[99].tolist(), 2: [3, 5], 3: []}
    good = np.sort(stack[[i for i in range(200) if i % 3]], axis=0)
    mended = {(r.aoi, r.revisit): r.pixels for r in chips.filter_bad_median(df.filter("aoi < 3"), [1], 0.5).collect()}
    assert mended[(1, 3)] == good[(len(good) - 1) // 2].tolist() and mended[(1, 1)] == stack[1].tolist() and mended[(2, 2)] == [3, 5]


def test_sketched_band_stats(spark):
    rng = np.random.default_rng(11)
    values = rng.normal(5, 2, (40, 1000))
    df = spark.createDataFrame([(1, v.tolist()) for v in values], "band int, pixels array<double>")
    row = images.band_stats(df, 1000).first()
    assert row.n == 40_000 and abs((values < row.median).mean() - 0.5) <= 0.001 and abs(row["std"] - math.sqrt(((values - row.median) ** 2).mean())) < 1e-6


def test_a_huge_area_is_ranked_alike_in_parts(spark):
    rng = np.random.default_rng(12)
    rows = [(1 if i % 3 else i, f"p{i:05}", int(rng.integers(-40, 40)) if i % 50 else None, float(rng.integers(0, 9)) if i % 41 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "aoi_index long, product_id string, delta int, cloud_cover double")
    plain, spread = (selection.select_best(selection.rank_revisits(df, 1.0, 0.5, spread=s), 7, spread=s) for s in (False, True))
    columns = ["aoi_index", "product_id", "delta", "cloud_cover", "rank", "n"]
    assert sorted(map(str, plain.select(*columns).collect())) == sorted(map(str, spread.select(*columns).collect()))


def test_numbers_of_equal_values_and_odd_columns(spark):
    from orbitframe.operators import numbering

    rows = [("s", i % 5, {"k": i}, i) for i in range(2000)] + [(None, 1, {}, -1)]
    df = spark.createDataFrame(rows, "source string, second int, m map<string,int>, id int").withColumns({"_range": F.lit("kept"), "_place": F.lit(1), "_start": F.lit(2), "_hash": F.col("id")})
    got = numbering.numbered(df, "no", "source", "second").orderBy("no").collect()
    assert [r.no for r in got] == list(range(1, 2002)) and got[0].source is None and {r._range for r in got} == {"kept"} and all(r._hash == r.id for r in got)
    assert [r.second for r in got[1:]] == sorted(r.second for r in got[1:])
    one = numbering.ranges(df, "source", "second")
    assert one.groupBy("_range_").count().agg(F.max("count")).first()[0] < 200


def test_overlap_without_clipping_is_the_area_of_the_clipped_ring(spark):
    """Rings of 3 to 7 points, some with a level or upright side or points on the box, within, across and outside of it. No ring is
    clipped, which takes less than three quarters of the time."""
    draw = np.random.default_rng(31)
    rows = [(k, [(float(draw.integers(-4, 5)) / 2, float(draw.integers(-4, 5)) / 2 + 40) if k % 2 else (float(draw.uniform(-2, 2)), float(draw.uniform(38, 42))) for _ in range(3 + k % 5)]) for k in range(600)]
    rows += [(600, []), (601, None), (602, [(0.0, 40.0)])]
    df = spark.createDataFrame(rows, "k long, ring array<struct<lon:double,lat:double>>").withColumn("box", geo.bounds(*map(F.lit, (-1.0, 39.5, 1.25, 41.0)))).cache()
    old, new = F.round(geo.ring_area_km2(geo.clip_ring(F.col("ring"), F.col("box"))), 2), geo.ring_overlap_km2(F.col("ring"), F.col("box"))
    got = df.select("k", old.alias("old"), new.alias("new")).collect()
    assert len(got) == 603 and sum(r.new > 0 for r in got) > 300
    assert all(abs(r.old - r.new) < 0.011 for r in got), [r for r in got if abs(r.old - r.new) >= 0.011][:5]
    many = df.crossJoin(spark.range(60)).repartition(4).cache()
    many.count()
    took = {}
    for name, area in (("old", old), ("new", new)):
        for turn in range(2):
            begin = time.time()
            many.select(F.sum(area)).collect()
            took[name] = time.time() - begin
    assert took["new"] < 0.75 * took["old"], took
