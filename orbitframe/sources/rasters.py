"""Class rasters by path: a Spark data source over uncompressed 8-bit TIFF files, of one file or a folder of them.

Planning reads headers only. A task has a range of a file's blocks and reads these windows by offset; conditions on
``block_row`` and ``block_col`` and a set of wanted blocks take away blocks before anything is read. Paths are those that
``pyarrow.fs`` opens, on the driver and on executors."""

from __future__ import annotations

import base64
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

SCHEMA = "block_row int, block_col int, cells binary"
FORMAT = "class_raster"

#: Tags of the TIFF format, and the codes and widths of its number types.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, PIXEL_SCALE, TIE_POINT = 322, 323, 324, 325, 33550, 33922
TYPES = {1: "B", 3: "H", 4: "I", 12: "d", 16: "Q"}
DEFAULTS = {BITS: 1, COMPRESSION: 1, SAMPLES: 1}


def _open(path: str):
    fs, at = pa.fs.FileSystem.from_uri(path)
    return fs, at


@dataclass(frozen=True)
class Raster:
    """What a file's header says: size in cells, place of its offsets (element type, position), tile side (0: strips)."""

    path: str
    width: int
    height: int
    tile: int
    rows_per_strip: int
    offsets: tuple[str, int]
    affine: tuple[float, float, float, float]

    def size(self, size: int) -> int:
        return self.tile or size


def read_header(path: str) -> Raster:
    """The header of one file. Compressed, multi-band or wider than 8-bit files, and tiles that aren't square, raise ``ValueError``."""
    fs, at = _open(path)
    with fs.open_input_file(at) as f:
        order = {b"II": "<", b"MM": ">"}.get(f.read_at(2, 0))
        magic = struct.unpack(order + "H", f.read_at(2, 2))[0] if order else None
        if magic not in (42, 43):
            raise ValueError(f"{path} is no TIFF file")
        wide = magic == 43
        word, step, count = ("Q", 20, "Q") if wide else ("I", 12, "H")
        start = struct.unpack(order + word, f.read_at(struct.calcsize(word), 8 if wide else 4))[0]
        held = struct.calcsize(order + count)
        n = struct.unpack(order + count, f.read_at(held, start))[0]
        entries = f.read_at(n * step, start + held)
        tags = dict(DEFAULTS)
        places: dict[int, tuple[str, int]] = {}
        for i in range(n):
            tag, kind, items = struct.unpack_from(order + "HH" + word, entries, i * step)
            if kind not in TYPES:
                continue
            letter, room = TYPES[kind], struct.calcsize(word)
            inside = start + held + i * step + step - room
            long = struct.calcsize(order + letter) * items
            where = inside if long <= room else struct.unpack(order + word, f.read_at(room, inside))[0]
            if tag in (STRIP_OFFSETS, TILE_OFFSETS):
                places[tag] = (order + letter, where)
            elif tag in (PIXEL_SCALE, TIE_POINT):
                tags[tag] = struct.unpack(f"{order}{items}{letter}", f.read_at(long, where))
            elif items == 1:
                tags[tag] = struct.unpack(order + letter, f.read_at(long, where))[0]
    if tags[COMPRESSION] != 1 or tags[BITS] != 8 or tags[SAMPLES] != 1:
        raise ValueError(f"{path}: only uncompressed rasters of one 8-bit band are read")
    if tags.get(TILE_WIDTH, 0) != tags.get(TILE_HEIGHT, 0):
        raise ValueError(f"{path}: tiles must be square")
    wide_cell, high_cell = tags.get(PIXEL_SCALE, (1.0, 1.0))[:2]
    i, j, _, x, y, _ = tags.get(TIE_POINT, (0.0,) * 6)[:6]
    tile = tags.get(TILE_WIDTH, 0)
    affine = (x - i * wide_cell, y + j * high_cell, wide_cell, high_cell)
    return Raster(path, tags[WIDTH], tags[HEIGHT], tile, tags.get(ROWS_PER_STRIP, tags[HEIGHT]), places[TILE_OFFSETS if tile else STRIP_OFFSETS], affine)


def files_of(path: str) -> list[str]:
    """The path itself, or the ``.tif`` and ``.tiff`` files right below it."""
    fs, at = _open(path)
    if fs.get_file_info(at).type != pa.fs.FileType.Directory:
        return [path]
    names = [f.base_name for f in fs.get_file_info(pa.fs.FileSelector(at)) if f.is_file and f.base_name.lower().endswith((".tif", ".tiff"))]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(names)]


@dataclass(frozen=True)
class Mosaic:
    """Files on one grid of blocks. ``first`` has the block row and column of each file's upper left corner."""

    files: tuple[Raster, ...]
    first: tuple[tuple[int, int], ...]
    affine: tuple[float, float, float, float]
    size: int
    rows: int
    cols: int


def read_mosaic(path: str, size: int = 256) -> Mosaic:
    """Files of a path as one raster; its corner is the least ``x`` and the largest ``y``. Files must share cell and block sizes, and
    lie whole blocks apart. Rasters in strips are read in blocks of ``size``, tiled ones in tiles."""
    files = tuple(read_header(p) for p in files_of(path))
    if not files:
        return Mosaic((), (), (0.0, 0.0, 1.0, 1.0), size, 0, 0)
    left, top = min(f.affine[0] for f in files), max(f.affine[1] for f in files)
    wide, high = files[0].affine[2:]
    size, first = files[0].size(size), []
    for f in files:
        row, col = round((top - f.affine[1]) / high), round((f.affine[0] - left) / wide)
        if f.size(size) != size or max(abs(f.affine[2] - wide) / wide, abs(f.affine[3] - high) / high) > 1e-9 or row % size or col % size:
            raise ValueError(f"{f.path} isn't on the grid of the other files")
        first.append((row // size, col // size))
    rows = max(r + -(-f.height // size) for f, (r, _) in zip(files, first, strict=True))
    cols = max(c + -(-f.width // size) for f, (_, c) in zip(files, first, strict=True))
    return Mosaic(files, tuple(first), (left, top, wide, high), size, rows, cols)


@dataclass
class Blocks(InputPartition):
    """Blocks ``numbers`` (row-major in the file) of a file whose corner is at block ``first``."""

    raster: Raster
    first: tuple[int, int]
    numbers: list[int]


def _windows(raster: Raster, size: int, numbers: list[int]):
    """``(number, bytes)`` of each block; tiles that a sparse file doesn't hold are left out."""
    fs, at = _open(raster.path)
    letter, where = raster.offsets
    item, across = struct.calcsize(letter), -(-raster.width // size)
    with fs.open_input_file(at) as f:
        for k in numbers:
            row, col = divmod(k, across)
            if raster.tile:
                offset = struct.unpack(letter, f.read_at(item, where + k * item))[0]
                if offset:
                    yield k, f.read_at(size * size, offset)
                continue
            high, wide = min(size, raster.height - row * size), min(size, raster.width - col * size)
            block = np.zeros((size, size), np.uint8)
            for r in range(high):
                strip, inside = divmod(row * size + r, raster.rows_per_strip)
                offset = struct.unpack(letter, f.read_at(item, where + strip * item))[0]
                if offset:
                    block[r, :wide] = np.frombuffer(f.read_at(wide, offset + inside * raster.width + col * size), np.uint8)
            yield k, block.tobytes()


class RasterReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.size = options["path"], int(options.get("size", 256))
        self.per_task = int(options.get("blocks_per_task", 256))
        self.wanted = base64.b64decode(options["blocks"]) if "blocks" in options else None
        self.tests: list = []

    def pushFilters(self, filters):
        """Comparisons of ``block_row`` and ``block_col`` with numbers are answered here; the rest stays with Spark."""
        compare = {EqualTo: np.equal, GreaterThan: np.greater, GreaterThanOrEqual: np.greater_equal, LessThan: np.less, LessThanOrEqual: np.less_equal, In: np.isin}
        for f in filters:
            name = f.attribute[0] if f.attribute in (("block_row",), ("block_col",)) else None
            if name and type(f) in compare:
                value = [v for v in f.value if v is not None] if isinstance(f, In) else f.value
                if value is None:
                    yield f
                    continue
                self.tests.append((name, compare[type(f)], value))
            elif not (name and isinstance(f, IsNotNull)):
                yield f

    def partitions(self):
        mosaic = read_mosaic(self.path, self.size)
        wanted = None if self.wanted is None else np.unpackbits(np.frombuffer(self.wanted, np.uint8)).astype(bool)
        out = []
        for raster, first in zip(mosaic.files, mosaic.first, strict=True):
            down, across = -(-raster.height // mosaic.size), -(-raster.width // mosaic.size)
            number = np.arange(down * across)
            at = {"block_row": number // across + first[0], "block_col": number % across + first[1]}
            keep = np.ones(len(number), bool) if wanted is None else wanted[at["block_row"] * mosaic.cols + at["block_col"]]
            for name, compare, value in self.tests:
                keep &= compare(at[name], value)
            number = number[keep].tolist()
            out += [Blocks(raster, first, number[a : a + self.per_task]) for a in range(0, len(number), self.per_task)]
        return out or [Blocks(None, (0, 0), [])]

    def read(self, partition):
        if partition.raster is None:
            return
        size = partition.raster.size(self.size)
        across = -(-partition.raster.width // size)
        for k, cells in _windows(partition.raster, size, partition.numbers):
            yield k // across + partition.first[0], k % across + partition.first[1], cells


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def tiled_tiff(tiles: dict[tuple[int, int], bytes], size: int, affine: tuple[float, float, float, float]) -> bytes:
    """A sparse tiled file of the given blocks of a raster; its tie point places them."""
    r0, c0 = min(r for r, _ in tiles), min(c for _, c in tiles)
    down, across = max(r for r, _ in tiles) - r0 + 1, max(c for _, c in tiles) - c0 + 1
    left, top, wide, high = affine
    offsets, lengths, body, at = [0] * (down * across), [0] * (down * across), [], 16
    for (r, c), cells in sorted(tiles.items()):
        k = (r - r0) * across + c - c0
        offsets[k], lengths[k] = at, size * size
        body.append(cells)
        at += size * size
    entries, extra = [], b""

    def tag(code: int, kind: int, *values) -> None:
        nonlocal extra
        packed = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(packed) > 8:
            entries.append((code, kind, len(values), struct.pack("<Q", at + len(extra))))
            extra += packed + bytes(-len(packed) % 8)
        else:
            entries.append((code, kind, len(values), packed.ljust(8, b"\0")))

    for code, value in ((WIDTH, across * size), (HEIGHT, down * size)):
        tag(code, 4, value)
    for code, value in ((BITS, 8), (COMPRESSION, 1), (PHOTOMETRIC, 1), (SAMPLES, 1), (TILE_WIDTH, size), (TILE_HEIGHT, size)):
        tag(code, 3, value)
    tag(TILE_OFFSETS, 16, *offsets)
    tag(TILE_BYTES, 16, *lengths)
    tag(PIXEL_SCALE, 12, wide, high, 0.0)
    tag(TIE_POINT, 12, 0.0, 0.0, 0.0, left + c0 * size * wide, top - r0 * size * high, 0.0)
    listed = struct.pack("<Q", len(entries)) + b"".join(struct.pack("<HHQ", c, k, n) + v for c, k, n, v in entries) + bytes(8)
    return b"".join([struct.pack("<2sHHHQ", b"II", 43, 8, 0, at + len(extra)), *body, extra, listed])


class RasterWriter(DataSourceWriter):
    """Tasks write files aside, ``file_blocks`` blocks each at most; the commit moves those of the attempts that count into the folder."""

    def __init__(self, options, overwrite: bool):
        self.path, self.size, self.overwrite = options["path"].rstrip("/"), int(options["size"]), overwrite
        self.file_blocks = int(options.get("file_blocks", 1024))
        self.affine = tuple(float(v) for v in options["affine"].split(","))
        self.aside = f"{self.path}/_temporary-{uuid.uuid4().hex}"

    def _flush(self, tiles) -> str:
        name = f"blocks-{uuid.uuid4().hex}.tif"
        fs, at = _open(self.aside)
        fs.create_dir(at)
        with fs.open_output_stream(f"{at}/{name}") as f:
            f.write(tiled_tiff(tiles, self.size, self.affine))
        return name

    def write(self, iterator):
        tiles, names = {}, []
        for row in iterator:
            if len(row.cells) != self.size**2:
                raise ValueError(f"block {row.block_row}, {row.block_col} hasn't {self.size} x {self.size} cells")
            tiles[row.block_row, row.block_col] = bytes(row.cells)
            if len(tiles) == self.file_blocks:
                names.append(self._flush(tiles))
                tiles = {}
        if tiles:
            names.append(self._flush(tiles))
        return Written(names)

    def commit(self, messages):
        fs, at = _open(self.path)
        fs.create_dir(at)
        if self.overwrite:
            for old in files_of(self.path):
                fs.delete_file(_open(old)[1])
        aside = _open(self.aside)[1]
        for m in messages:
            for name in m.files if m else ():
                fs.move(f"{aside}/{name}", f"{at}/{name}")
        self.abort(messages)

    def abort(self, messages):
        fs, at = _open(self.aside)
        if fs.get_file_info(at).type == pa.fs.FileType.Directory:
            fs.delete_dir(at)


class RasterSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RasterReader(self.options)

    def writer(self, schema, overwrite):
        return RasterWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format ``class_raster`` known to the session, and let it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)


def load_raster_blocks(spark: SparkSession, path: str, size: int = 256, blocks: bytes | None = None, blocks_per_task: int = 256) -> DataFrame:
    """``(block_row, block_col, cells)`` of a raster file or a folder of them, as ``raster_blocks`` gives them. ``blocks`` has a bit for
    each block of the raster, row by row; those of a bit 0 aren't read. Blocks that a sparse file doesn't hold give no row."""
    register(spark)
    reader = spark.read.format(FORMAT).option("size", size).option("blocks_per_task", blocks_per_task)
    if blocks is not None:
        reader = reader.option("blocks", base64.b64encode(blocks).decode())
    return reader.load(path)


def write_raster_blocks(blocks: DataFrame, path: str, affine: tuple[float, float, float, float], size: int = 256, file_blocks: int = 1024, mode: str = "append") -> None:
    """Blocks as a folder of sparse tiled files, neighbours together. ``size`` must be a multiple of 16, as the format asks."""
    if size % 16:
        raise ValueError("the side of a tile must be a multiple of 16")
    register(blocks.sparkSession)
    near = blocks.select("block_row", "block_col", "cells").repartitionByRange("block_row", "block_col").sortWithinPartitions("block_row", "block_col")
    near.write.format(FORMAT).mode(mode).option("size", size).option("file_blocks", file_blocks).option("affine", ",".join(map(repr, affine))).save(path)
