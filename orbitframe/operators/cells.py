"""Grid cells for joins of boxes: a quadtree where rows are dense, parts of cells that boxes fill, boxes over the date line."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a cell may hold before it is split, rows that a table's density is taken from, and levels below the grid.
MOST, SAMPLED, DEEPEST = 250_000, 20_000, 10
#: A table's hot cells are at most this many a level: where it has more rows, cells may hold more.
HOT = 512

#: Names of added columns; callers' columns must have others.
KEY = ["_cell", "_part_a", "_part_b"]


def parts(df: DataFrame, box: str, name: str) -> DataFrame:
    """A row for each part of ``box`` in longitude, with ``name``: struct of the part's number, its box and the other part's ends.
    Boxes that pass 180 degrees, by an end beyond it or by a west end east of the east end, have two."""
    w, e = f"cast({box}.lon_min AS double)", f"cast({box}.lon_max AS double)"

    plain, full = f"{w} >= -180 AND {e} <= 180 AND {w} <= {e}", f"{e} - {w} >= 360"
    east, west = f"{w} > 180 AND {e} > 180", f"{w} < -180 AND {e} < -180"
    two = f"NOT ({plain}) AND NOT ({full}) AND NOT ({east}) AND NOT ({west})"
    first = f"CASE WHEN {plain} THEN {w} WHEN {full} THEN -180D WHEN {east} THEN {w} - 360 WHEN {w} < -180 THEN {w} + 360 ELSE {w} END"
    first_end = f"CASE WHEN {plain} THEN {e} WHEN {full} THEN 180D WHEN {east} THEN {e} - 360 WHEN {west} THEN {e} + 360 ELSE 180D END"
    second_end = f"if({e} > 180, {e} - 360, {e})"
    out = df.select("*", F.expr(f"explode(CASE WHEN {two} THEN array(0, 1) WHEN {w} IS NOT NULL AND {e} IS NOT NULL THEN array(0) END) AS _at"))
    part = f"""named_struct('at', _at, 'lon_min', if(_at = 0, {first}, -180D), 'lon_max', if(_at = 0, {first_end}, {second_end}), 'lat_min', cast({box}.lat_min AS double), 'lat_max', cast({box}.lat_max AS double),
     'other_min', CASE WHEN {two} THEN if(_at = 0, -180D, {first}) END, 'other_max', CASE WHEN {two} THEN if(_at = 0, {second_end}, 180D) END)"""
    return out.withColumn(name, F.expr(part)).drop("_at")


@dataclass
class Grid:
    """Cells of ``size`` degrees; by level, the cells that are split in four; and the shares that the rows of a full cell are dealt in."""

    size: float
    splits: list[list[int]] = field(default_factory=list)
    shares: dict[int, tuple[int, int]] = field(default_factory=dict)


def code(level: str, x: str, y: str) -> str:
    """One number for a cell, as SQL: 4 bits of level, 30 of each coordinate."""
    return f"(({level}) * {2**30}L + ({x}) + {2**29}L) * {2**30}L + ({y}) + {2**29}L"


def number(level: int, x: int, y: int) -> int:
    return (level * 2**30 + x + 2**29) * 2**30 + y + 2**29


def sizes(left: DataFrame, right: DataFrame) -> tuple[int, int]:
    """Rows of both tables, from one job that reads no column."""
    tags = left.select(F.lit(0).alias("k")).unionByName(right.select(F.lit(1).alias("k")))
    return tuple(int(n or 0) for n in tags.agg(F.count_if(F.col("k") == 0), F.count_if(F.col("k") == 1)).first())


def _sampled(df: DataFrame, name: str, share: float):
    rows = df.select(*[F.col(f"{name}.{c}") for c in ("lon_min", "lat_min", "lon_max", "lat_max")]).dropna()
    return rows.sample(share, 7).limit(2 * SAMPLED).toPandas().to_numpy(float), 1 / share


def plan_grid(left: DataFrame, right: DataFrame, names: tuple[str, str], size: float, counts: tuple[int, int]) -> Grid:
    """A grid for two tables with ``parts``, of ``counts`` rows at most. A cell that holds too many rows of either is split while its
    quarters aren't smaller than most boxes of that table; what is still too full is dealt in shares. Of large tables some
    ``SAMPLED`` rows come to the driver. The sample decides how work is dealt, not what is found."""
    most = [max(MOST, n // HOT) for n in counts]
    grid = Grid(size)
    if all(n <= m for n, m in zip(counts, most, strict=True)):
        return grid
    held = [_sampled(df, name, min(1.0, SAMPLED / max(1, n))) for df, name, n in zip((left, right), names, counts, strict=True)]
    usual = [float(np.median(np.maximum(b[:, 2] - b[:, 0], b[:, 3] - b[:, 1]))) if len(b) else 0.0 for b, _ in held]

    def touching(boxes: np.ndarray, x: int, y: int, step: float) -> np.ndarray:
        return boxes[(boxes[:, 0] < (x + 1) * step) & (boxes[:, 2] >= x * step) & (boxes[:, 1] < (y + 1) * step) & (boxes[:, 3] >= y * step)]

    def grow(level: int, x: int, y: int, boxes: list[np.ndarray]) -> None:
        full = [len(b) * scale / m for b, (_, scale), m in zip(boxes, held, most, strict=True)]
        if max(full) <= 1:
            return
        half = size / 2 ** (level + 1)
        if level < DEEPEST and any(f > 1 and half >= u for f, u in zip(full, usual, strict=True)):
            while len(grid.splits) <= level:
                grid.splits.append([])
            grid.splits[level].append(number(level, x, y))
            for cx, cy in ((2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)):
                grow(level + 1, cx, cy, [touching(b, cx, cy, half) for b in boxes])
        else:
            grid.shares[number(level, x, y)] = tuple(max(1, int(np.ceil(f))) for f in full)

    corners = {tuple(c) for b, _ in held for c in np.floor(b[:, :2] / size).astype(int).tolist()}
    for x, y in sorted(corners):
        grow(0, x, y, [touching(b, x, y, size) for b, _ in held])
    return grid


def covered(df: DataFrame, name: str, grid: Grid, side: int) -> DataFrame:
    """A row for each cell that the part covers, with the columns of KEY and ``_level``, ``_x`` and ``_y``. ``side`` is 0 or 1: the rows of a
    full cell go to one of their own shares each, and to all shares of the other side."""
    p = F.col(name)

    def cell(level, x, y):
        return F.struct(F.lit(level).alias("level"), x.cast("long").alias("x"), y.cast("long").alias("y"))

    out = df
    for k, c in (("lon", "x"), ("lat", "y")):
        out = out.withColumn(f"_{c}", F.expr(f"explode(sequence(floor({name}.{k}_min / {grid.size}D), floor({name}.{k}_max / {grid.size}D)))"))
    out = out.withColumn("_level", F.lit(0))
    found = F.array(cell(0, F.col("_x"), F.col("_y")))
    for level, split in enumerate(grid.splits):
        half = grid.size / 2 ** (level + 1)

        def inside(c):
            return (c["x"] * half <= p["lon_max"]) & ((c["x"] + 1) * half > p["lon_min"]) & (c["y"] * half <= p["lat_max"]) & ((c["y"] + 1) * half > p["lat_min"])

        def quartered(c):
            quarters = F.array(*[cell(level + 1, 2 * c["x"] + i, 2 * c["y"] + j) for i in (0, 1) for j in (0, 1)])
            hot = (c["level"] == level) & F.array_contains(F.array(*map(F.lit, split)), (F.lit(level * 2**30 + 2**29) + c["x"]) * 2**30 + c["y"] + 2**29)
            return F.when(hot, F.filter(quarters, inside)).otherwise(F.array(c))

        found = F.flatten(F.transform(found, quartered))
    if grid.splits:
        out = out.select("*", F.explode(found).alias("_found")).withColumns({f"_{c}": F.col(f"_found.{c}") for c in ("level", "x", "y")}).drop("_found")
    out = out.withColumn("_cell", F.expr(code("cast(_level AS long)", "_x", "_y")))
    if not grid.shares:
        return out.withColumns({k: F.lit(0) for k in KEY[1:]})
    table = F.create_map(*[v for k, s in grid.shares.items() for v in (F.lit(k), F.array(*map(F.lit, s)))])
    shares = F.coalesce(F.try_element_at(table, F.col("_cell")), F.array(F.lit(1), F.lit(1)))
    own, other = KEY[1 + side], KEY[2 - side]
    out = out.withColumn("_shares", shares).withColumn(own, F.pmod(F.xxhash64(*df.columns), F.get("_shares", side)).cast("int"))
    return out.withColumn(other, F.explode(F.sequence(F.lit(0), F.get("_shares", 1 - side) - 1))).drop("_shares")


def counts_here(a: str, b: str, size: float) -> Column:
    """Whether two parts in one cell meet, and this is where their pair counts: in the cell of their common part's south-west corner and,
    where boxes have two parts, in the first two that meet. Boxes that touch meet."""
    meets = f"{a}.lon_min <= {b}.lon_max AND {b}.lon_min <= {a}.lon_max AND {a}.lat_min <= {b}.lat_max AND {b}.lat_min <= {a}.lat_max"
    corner = " AND ".join(f"floor(greatest({a}.{k}_min, {b}.{k}_min) * power(2D, _level) / {size}D) = _{c}" for k, c in (("lon", "x"), ("lat", "y")))
    first, second = (f"array(named_struct('a', {p}.lon_min, 'z', {p}.lon_max), named_struct('a', {p}.other_min, 'z', {p}.other_max))" for p in (a, b))
    ordered = [f"CASE WHEN {p}.at = 0 THEN {both} ELSE reverse({both}) END" for p, both in ((a, first), (b, second))]
    places = f"flatten(transform({ordered[0]}, (s, i) -> transform({ordered[1]}, (t, j) -> CASE WHEN s.a <= t.z AND t.a <= s.z THEN i * 2 + j END)))"
    return F.expr(f"{meets} AND {corner} AND CASE WHEN {a}.other_min IS NULL AND {b}.other_min IS NULL THEN true ELSE array_min({places}) = {a}.at * 2 + {b}.at END")
