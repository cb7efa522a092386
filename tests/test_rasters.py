"""Class rasters by path: layouts of files, conditions, reads of touched blocks only."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbitframe.operators import raster
from orbitframe.sources import rasters


def classic_strips(cells: np.ndarray, rows_per_strip: int, order: str = ">", compression: int = 1) -> bytes:
    """A classic file in strips, written by hand."""
    high, wide = cells.shape
    strips = [cells[r : r + rows_per_strip].tobytes() for r in range(0, high, rows_per_strip)]
    n, at = 10, 8 + 2 + 10 * 12 + 4
    lists = at + 8 * len(strips) + 24 + 48
    offsets = [lists + sum(map(len, strips[:i])) for i in range(len(strips))]
    tail = struct.pack(f"{order}{len(strips)}I", *offsets) + struct.pack(f"{order}{len(strips)}I", *map(len, strips))
    scale = at + len(tail)
    tail += struct.pack(order + "3d", 0.5, 0.25, 0.0) + struct.pack(order + "6d", 0, 0, 0, 10.0, 50.0, 0)
    short = lambda c, v: struct.pack(order + "HHIHH", c, 3, 1, v, 0)
    long = lambda c, k, m, v: struct.pack(order + "HHII", c, k, m, v)
    # A list of one number stands in the entry itself.
    first, second = (at, at + 4 * len(strips)) if len(strips) > 1 else (offsets[0], len(strips[0]))
    entries = [long(256, 4, 1, wide), long(257, 4, 1, high), short(258, 8), short(259, compression), short(262, 1), long(273, 4, len(strips), first), long(278, 4, 1, rows_per_strip), long(279, 4, len(strips), second), long(33550, 12, 3, scale), long(33922, 12, 6, scale + 24)]
    magic = b"MM" if order == ">" else b"II"
    return magic + struct.pack(order + "HI", 42, 8) + struct.pack(order + "H", n) + b"".join(entries) + bytes(4) + tail + b"".join(strips)


def whole(df, size: int) -> np.ndarray:
    rows = df.collect()
    out = np.zeros(((max(r.block_row for r in rows) + 1) * size, (max(r.block_col for r in rows) + 1) * size), np.uint8)
    for r in rows:
        out[r.block_row * size :, r.block_col * size :][:size, :size] = np.frombuffer(r.cells, np.uint8).reshape(size, size)
    return out


@pytest.mark.parametrize(("rows_per_strip", "order"), [(1, ">"), (7, "<"), (50, ">")])
def test_strips(spark, tmp_path, rows_per_strip, order):
    cells = np.random.default_rng(1).integers(0, 256, (50, 37), dtype=np.uint8)
    (tmp_path / "a.tif").write_bytes(classic_strips(cells, rows_per_strip, order))
    got = whole(rasters.load_raster_blocks(spark, str(tmp_path / "a.tif"), 16, blocks_per_task=3), 16)
    assert np.array_equal(got[:50, :37], cells) and not got[50:].any() and not got[:, 37:].any()
    assert rasters.read_mosaic(str(tmp_path / "a.tif"), 16).affine == (10.0, 50.0, 0.5, 0.25)


def test_compressed_and_other_files_are_refused(tmp_path):
    (tmp_path / "a.tif").write_bytes(classic_strips(np.zeros((4, 4), np.uint8), 4, compression=5))
    (tmp_path / "b.tif").write_bytes(b"no raster at all")
    for name in "ab":
        with pytest.raises(ValueError):
            rasters.read_header(str(tmp_path / f"{name}.tif"))


def blocks_of(spark, places, size=16):
    rows = [(r, c, ((np.arange(size * size) + 31 * r + c) % 256).astype(np.uint8).tobytes()) for r, c in places]
    return spark.createDataFrame([(r, c, bytearray(b)) for r, c, b in rows], rasters.SCHEMA)


def test_round_trip_with_holes_and_several_files(spark, tmp_path):
    places = [(r, c) for r in range(9) for c in range(11) if (r * 11 + c) % 4 or (r, c) == (0, 0)]
    blocks, path = blocks_of(spark, places), str(tmp_path / "r")
    rasters.write_raster_blocks(blocks, path, (-180.0, 90.0, 0.5, 0.25), 16, file_blocks=5)
    assert len(rasters.files_of(path)) >= len(places) // 5
    assert not list((tmp_path / "r").glob("_temporary*"))
    back = rasters.load_raster_blocks(spark, path)
    key = lambda df: sorted((r.block_row, r.block_col, bytes(r.cells)) for r in df.collect())
    assert key(back) == key(blocks)
    rasters.write_raster_blocks(blocks_of(spark, [(0, 0)]), path, (-180.0, 90.0, 0.5, 0.25), 16, mode="overwrite")
    assert rasters.load_raster_blocks(spark, path).count() == 1


def test_conditions_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    rasters.write_raster_blocks(blocks_of(spark, [(r, c) for r in range(8) for c in range(8)]), path, (0.0, 0.0, 1.0, 1.0), 16)
    df = rasters.load_raster_blocks(spark, path).filter("block_row >= 2 AND block_row < 5 AND block_col IN (1, 6) AND length(cells) > 0")
    assert sorted((r.block_row, r.block_col) for r in df.select("block_row", "block_col").collect()) == [(r, c) for r in (2, 3, 4) for c in (1, 6)]
    reader = rasters.RasterReader({"path": path})
    from pyspark.sql.datasource import EqualTo, In, StringContains

    assert [type(f) for f in reader.pushFilters([EqualTo(("block_row",), 3), In(("block_col",), (1, None)), StringContains(("cells",), "x")])] == [StringContains]
    assert sum(len(p.numbers) for p in reader.partitions()) == 1


def test_lookup_reads_touched_blocks_only(spark, tmp_path):
    path, affine = str(tmp_path / "r"), (-32.0, 32.0, 1.0, 1.0)
    blocks = blocks_of(spark, [(r, c) for r in range(4) for c in range(4) if (r, c) != (3, 3)])
    rasters.write_raster_blocks(blocks, path, affine, 16)
    # Two points of one block, one outside of the raster, one in the hole, one without a place.
    points = spark.createDataFrame([(1, -20.3, 20.7), (2, -19.3, 20.7), (3, 500.0, 0.0), (4, 31.5, -31.5), (5, None, 1.0)], "id long, x double, y double")
    x, y = F.col("x"), F.col("y")
    mosaic = rasters.read_mosaic(path)
    bits = raster.touched_blocks(points, mosaic, x, y, "floor")
    assert np.unpackbits(np.frombuffer(bits, np.uint8)).sum() == 2
    assert rasters.load_raster_blocks(spark, path, blocks=bits).count() == 1
    for rounding in ("floor", "ceil"):
        got = raster.raster_file_lookup(points, path, x, y, "v", -1, rounding).orderBy("id").collect()
        want = raster.raster_lookup(points, blocks, affine, x, y, "v", 16, -1, rounding).orderBy("id").collect()
        assert got == want


def test_empty_folder_and_no_points(spark, tmp_path):
    (tmp_path / "e").mkdir()
    assert rasters.load_raster_blocks(spark, str(tmp_path / "e")).count() == 0
    points = spark.createDataFrame([(1, 0.0, 0.0)], "id long, x double, y double")
    assert raster.raster_file_lookup(points, str(tmp_path / "e"), F.col("x"), F.col("y"), "v").first().v is None
    assert raster.raster_file_lookup(points.limit(0), str(tmp_path / "e"), F.col("x"), F.col("y"), "v").count() == 0
