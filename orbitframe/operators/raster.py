"""Class rasters as tables of square blocks, and point lookups in them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import rasters


def raster_blocks(cells: DataFrame, size: int = 256) -> DataFrame:
    """``(block_row, block_col, cells)`` from rows ``(row, col, value)``: a byte per cell in row-major order, 0 where none is.
    Of several values of one cell the smallest counts."""
    at = cells.select(
        F.floor(F.col("row") / size).cast("int").alias("block_row"), F.floor(F.col("col") / size).cast("int").alias("block_col"),
        (F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))).cast("int").alias("at"), F.col("value").cast("int").alias("value"),
    )
    one = at.groupBy("block_row", "block_col", "at").agg(F.min("value").alias("value"))
    held = one.groupBy("block_row", "block_col").agg(F.array_sort(F.collect_list(F.struct("at", "value"))).alias("m"))
    # Every cell brings the empty ones between it and the one before.
    byte = F.transform("m", lambda c, i: F.concat(F.repeat(F.lit("00"), (c["at"] - F.coalesce(F.get("m", i - 1)["at"], F.lit(-1)) - 1).cast("int")), F.lpad(F.hex(c["value"].cast("long")), 2, "0")))
    rest = F.repeat(F.lit("00"), (F.lit(size * size - 1) - F.element_at("m", -1)["at"]).cast("int"))
    return held.select("block_row", "block_col", F.unhex(F.concat(F.array_join(byte, ""), rest)).alias("cells"))


def cell_of(x: Column, y: Column, affine: tuple[float, float, float, float], rounding: str = "ceil") -> tuple[Column, Column]:
    """Row and column for ``affine`` = (left, top, cell width, cell height). ``ceil`` takes the cell below and right of the one
    that holds the point, as the stratification does; ``floor`` takes the one that holds it."""
    left, top, wide, high = affine
    snap = {"ceil": F.ceil, "floor": F.floor}[rounding]
    return snap((F.lit(top) - y) / high).cast("int"), snap((x - left) / wide).cast("int")


def raster_lookup(points: DataFrame, blocks: DataFrame, affine: tuple[float, float, float, float], x: Column, y: Column, name: str, size: int = 256, missing: int | None = None, rounding: str = "ceil") -> DataFrame:
    """Add ``name``, the raster's value at each point; ``missing`` outside of all blocks.

    Points meet blocks by an equi-join on the block; the byte is cut from the block, which is never unpacked."""
    row, col = cell_of(x, y, affine, rounding)
    placed = points.withColumns({"_r": row, "_c": col})
    placed = placed.withColumns({"block_row": F.floor(F.col("_r") / size).cast("int"), "block_col": F.floor(F.col("_c") / size).cast("int")})
    offset = F.pmod("_r", F.lit(size)) * size + F.pmod("_c", F.lit(size))
    joined = placed.join(blocks, ["block_row", "block_col"], "left")
    byte = F.conv(F.hex(F.substring(F.col("cells"), offset + 1, F.lit(1))), 16, 10).cast("int")
    value = F.when(F.col("cells").isNotNull(), byte)
    out = value if missing is None else F.coalesce(value, F.lit(missing))
    return joined.withColumn(name, out).drop("_r", "_c", "block_row", "block_col", "cells")


def touched_blocks(points: DataFrame, mosaic: rasters.Mosaic, x: Column, y: Column, rounding: str = "ceil") -> bytes:
    """A bit for each block of the raster, row by row, 1 where a point lies. The driver gets one number for each touched
    block, so no more than the raster has."""
    row, col = cell_of(x, y, mosaic.affine, rounding)
    at = points.select(F.floor(row / mosaic.size).alias("r"), F.floor(col / mosaic.size).alias("c"))
    inside = at.filter((F.col("r") >= 0) & (F.col("r") < mosaic.rows) & (F.col("c") >= 0) & (F.col("c") < mosaic.cols))
    numbers = inside.select((F.col("r") * mosaic.cols + F.col("c")).alias("k")).distinct().toPandas()["k"].to_numpy(np.int64)
    bits = np.zeros(mosaic.rows * mosaic.cols, np.uint8)
    bits[numbers] = 1
    return np.packbits(bits).tobytes()


def raster_file_lookup(points: DataFrame, path: str, x: Column, y: Column, name: str, missing: int | None = None, rounding: str = "ceil", size: int = 256) -> DataFrame:
    """``raster_lookup`` in a raster file or a folder of them, whose own place and cell size count. Only blocks that points touch are
    read; ``points`` is read twice."""
    mosaic = rasters.read_mosaic(path, size)
    blocks = rasters.load_raster_blocks(points.sparkSession, path, size, touched_blocks(points, mosaic, x, y, rounding))
    return raster_lookup(points, blocks, mosaic.affine, x, y, name, mosaic.size, missing, rounding)
