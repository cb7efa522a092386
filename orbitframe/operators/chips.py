"""Operations on chips: masks, radiometry, composites, geometry, augmentation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import let
from . import weights
from .images import COMPOSITES, DEPTH, crop, digest

KEY = ["aoi", "revisit"]

# Colours of the scene classes 0 to 11.
PALETTE = [
    [0.0, 0.0, 0.0], [1.0, 0.0, 0.016], [0.525, 0.525, 0.525], [0.467, 0.298, 0.043], [0.063, 0.827, 0.176], [1.0, 1.0, 0.325],
    [0.0, 0.0, 1.0], [0.506, 0.506, 0.506], [0.753, 0.753, 0.753], [0.949, 0.949, 0.949], [0.733, 0.773, 0.925], [0.325, 1.0, 0.98],
]


def bad_fraction(df: DataFrame, values: list[int], mask: str = "mask") -> DataFrame:
    """Add ``bad``: the share of mask pixels of the listed classes."""
    hit = F.size(F.filter(mask, lambda m: m.isin(values)))
    return df.withColumn("bad", hit / F.size(mask))


def filter_bad_zero(df: DataFrame, values: list[int], threshold: float = 0.4) -> DataFrame:
    """Image and mask of a revisit become zero where its bad share reaches the threshold."""
    out = bad_fraction(df, values)
    black = F.col("bad") >= threshold
    return out.withColumns({c: F.when(black, F.transform(c, lambda v: v * 0)).otherwise(F.col(c)) for c in ("pixels", "mask")}).drop("bad")


def lower_median(stack: Column) -> Column:
    """Pixel-wise lower median of an array of equally long arrays."""
    n = F.size(stack)
    middle = ((n - 1) / 2).cast("int")
    places = F.slice(F.sequence(F.lit(0), F.size(F.get(stack, 0))), 1, F.size(F.get(stack, 0)))
    return F.transform(places, lambda i: F.get(F.array_sort(F.transform(stack, lambda p: F.get(p, i))), middle))


#: Values that one task stacks for a median: revisits times pixels.
STACKED = 4_000_000


def _medians(df: DataFrame) -> DataFrame:
    """``(aoi, band, pixels)``: pixel-wise lower medians. Images are stacked in stretches of pixels, the shorter the more revisits an
    area has, so that a stack's size doesn't grow with their number; a first pass over the keys counts them."""
    most = df.groupBy("aoi", "band").count().agg(F.max("count")).first()[0] or 1
    step = max(1, STACKED // most)
    cuts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size("pixels"), F.lit(1)) - 1) / step).cast("int")), lambda k: F.slice("pixels", k * step + 1, step))
    stretches = df.select("aoi", "band", F.posexplode(cuts).alias("_k", "_part")).groupBy("aoi", "band", "_k").agg(F.collect_list("_part").alias("_stack"))
    medians = stretches.select("aoi", "band", F.struct("_k", lower_median(F.col("_stack")).alias("v")).alias("_m"))
    return medians.groupBy("aoi", "band").agg(F.array_sort(F.collect_list("_m")).alias("_m")).select("aoi", "band", F.flatten("_m.v").alias("pixels"))


def reference_frame(df: DataFrame) -> DataFrame:
    """``(aoi, band, pixels)``: pixel-wise lower median over an area's revisits, of any number."""
    return _medians(df)


def filter_bad_median(df: DataFrame, values: list[int], threshold: float = 0.4) -> DataFrame:
    """Bad revisits take the lower median of the good ones, or of all where none is good."""
    out = bad_fraction(df, values)
    good = out.filter(F.col("bad") < threshold)
    lost = out.join(good.select("aoi", "band").distinct(), ["aoi", "band"], "left_anti")
    medians = _medians(good.unionByName(lost)).withColumnRenamed("pixels", "median")
    joined = out.join(medians, ["aoi", "band"])
    return joined.withColumn("pixels", F.when(F.col("bad") >= threshold, F.col("median")).otherwise(F.col("pixels"))).drop("median", "bad")


def mask_one_hot(df: DataFrame, classes: int = 12, mask: str = "mask") -> DataFrame:
    """A row per class: ``cls`` and the 0/1 indicator in ``pixels``."""
    wide = df.withColumn("cls", F.explode(F.sequence(F.lit(0), F.lit(classes - 1))))
    return wide.withColumn("pixels", F.transform(mask, lambda m: (m == F.col("cls")).cast("int")))


def mask_to_rgb(df: DataFrame, mask: str = "mask") -> DataFrame:
    """Arrays r, g and b of the classes' colours."""
    def channel(i: int) -> Column:
        table = F.array(*[F.lit(c[i]) for c in PALETTE])
        return F.transform(mask, lambda m: F.element_at(table, m.cast("int") + 1))

    return df.withColumns({"r": channel(0), "g": channel(1), "b": channel(2)})


def pansharpen(df: DataFrame, rgb: tuple[str, str, str] = ("r", "g", "b"), pan: str = "pan") -> DataFrame:
    """Replace the value of hue, saturation, value by the panchromatic pixel. That scales a colour by pan over its largest
    part, and turns black to grey."""
    def replaced(own: str) -> Column:
        top = F.transform(F.arrays_zip(*rgb), lambda p: F.greatest(*[p[c] for c in rgb]))
        zipped = F.arrays_zip(F.col(own).alias("v"), top.alias("top"), F.col(pan).alias("pan"))
        return F.transform(zipped, lambda p: F.when(p["top"] > 0, p["v"] / p["top"] * p["pan"]).otherwise(p["pan"]))

    return df.withColumns({c: replaced(c) for c in rgb})


def to_8bit(df: DataFrame, depth: int = 12) -> DataFrame:
    return df.withColumn("pixels", F.transform("pixels", lambda v: F.floor(F.least(F.greatest(v / DEPTH[depth], F.lit(0.0)), F.lit(1.0)) * 255).cast("int")))


def preview_stretch(df: DataFrame, bands: list[int], reverse: bool = True) -> DataFrame:
    """Three bands as bytes of the largest value among them; ``channel`` counts from the last band if ``reverse``."""
    order = list(reversed(bands)) if reverse else list(bands)
    picked = df.filter(F.col("band").isin(order)).withColumn("channel", F.array_position(F.array(*map(F.lit, order)), F.col("band")).cast("int"))
    top = F.max(F.array_max("pixels")).over(Window.partitionBy(*KEY))
    bright = picked.withColumn("_top", top)
    return bright.withColumn("pixels", F.transform("pixels", lambda v: F.when(F.col("_top") > 0, F.floor(F.greatest(v, F.lit(0)) / F.col("_top") * 255)).otherwise(F.lit(0)).cast("int"))).drop("_top")


def gathered(pixels: Column, n: Column, source: Callable[[Column], Column]) -> Column:
    """Pixels in a new order: place i takes the pixel at ``source(i)``."""
    return let(pixels, lambda p: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(p, source(i).cast("int"))))


def resize_nearest(df: DataFrame, h: int, w: int) -> DataFrame:
    """Nearest source pixel by truncation, as for masks."""
    def source(i):
        y, x = F.floor(i / w), i % w
        return F.floor(y * F.col("h") / h) * F.col("w") + F.floor(x * F.col("w") / w)

    return df.withColumn("pixels", gathered(F.col("pixels"), F.lit(h * w), source)).withColumns({"h": F.lit(h), "w": F.lit(w)})


def map_chips(df: DataFrame, fn: Callable, schema: str | None = None, column: str = "pixels", keep: tuple[str, ...] = ()) -> DataFrame:
    """Apply a function to the array, height by width, of every chip, in Arrow batches.

    Without ``schema``, ``fn`` gives an array, and the chip takes it and its size. With ``schema``, such as ``"y int, total double"``,
    ``fn`` gives any number of rows, as tuples in the order of the schema; each goes with the chip's columns ``keep``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    if schema is None:
        kinds |= {column: "array<double>", "h": "int", "w": "int"}
    fixed = [c for c in df.columns if c not in (column, "h", "w")] if schema is None else list(keep)
    out = ", ".join([*[f"`{c}` {kinds[c]}" for c in (df.columns if schema is None else fixed)], *filter(None, [schema])])
    made = to_arrow_schema(df.sparkSession.createDataFrame([], out).schema)

    def run(batches):
        for batch in batches:
            images = [np.asarray(p, float).reshape(h, w) for p, h, w in zip(*(batch.column(c).to_pylist() for c in (column, "h", "w")), strict=True)]
            results = [fn(image) for image in images]
            if schema is None:
                changed = {column: [r.reshape(-1).tolist() for r in results], "h": [r.shape[0] for r in results], "w": [r.shape[1] for r in results]}
                arrays = [pa.array(changed[f.name], f.type) if f.name in changed else batch.column(f.name) for f in made]
            else:
                rows = [list(r) for r in results]
                origin = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
                flat = [row for r in rows for row in r]
                arrays = [batch.column(f.name).take(origin) if i < len(fixed) else pa.array([row[i - len(fixed)] for row in flat], f.type) for i, f in enumerate(made)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, made, strict=True)], schema=made)

    return df.mapInArrow(run, out)


def resize(df: DataFrame, h: int, w: int, mode: str = "bilinear") -> DataFrame:
    """Chips of ``h`` by ``w`` pixels: ``nearest`` for masks, ``bilinear`` or ``bicubic`` for images, the kernel widened when shrinking."""
    return resize_nearest(df, h, w) if mode == "nearest" else weights.resized(df, h, w, mode)


def lanczos_shift(df: DataFrame, dx: float, dy: float, a: int = 3) -> DataFrame:
    """Move the content by (dx, dy) pixels, right and down for positive ones: a separable Lanczos kernel for the part below a
    pixel, then whole pixels; borders reflected. Chips are larger than ``a`` and than the move."""
    whole_x, whole_y = round(dx), round(dy)
    across, down = (weights.lanczos(d, a, a) for d in (dx - whole_x, dy - whole_y))
    moved = df.withColumn("pixels", weights.convolved(F.col("pixels"), F.col("h"), F.col("w"), across, down))
    return shift_image(moved, whole_x, whole_y) if whole_x or whole_y else moved


def rotate_flip(df: DataFrame, seed: int = 42) -> DataFrame:
    """One of four quarter turns and perhaps a vertical flip, drawn per area, so that all roles of a scene share it. Square chips."""
    draw = F.conv(F.substring(digest(seed, "aoi"), 1, 2), 16, 10).cast("int")
    turned = df.withColumns({"_turn": draw % 4, "_flip": F.floor(draw / 4) % 2 == 1})
    n = F.col("w")

    def source(i):
        y, x = F.floor(i / n), i % n
        y = F.when(F.col("_flip"), n - 1 - y).otherwise(y)
        t = F.col("_turn")
        return F.when(t == 0, y * n + x).when(t == 1, x * n + (n - 1 - y)).when(t == 2, (n - 1 - y) * n + (n - 1 - x)).otherwise((n - 1 - x) * n + y)

    return turned.withColumn("pixels", gathered(F.col("pixels"), F.col("h") * n, source)).drop("_turn", "_flip")


def random_crop(df: DataFrame, size: int, source: int, seed: int = 42) -> DataFrame:
    """A random ``size`` square of a ``source`` square, drawn per area, scaled and rounded for images of another size."""
    def corner(at: int) -> Column:
        return F.conv(F.substring(digest(seed, "aoi"), at, 6), 16, 10).cast("int") % (source - size + 1)

    f = F.col("w") / source
    x, y, n = F.round(corner(1) * f).cast("int"), F.round(corner(7) * f).cast("int"), F.round(size * f).cast("int")
    out = df.withColumns({"crop_x": corner(1), "crop_y": corner(7), "_n": n, "pixels": crop(F.col("pixels"), F.col("w"), x, y, n, n)})
    return out.withColumns({"w": F.col("_n"), "h": F.col("_n")}).drop("_n")


def shuffle_revisits(df: DataFrame, seed: int = 42, fixed: tuple[str, ...] = ("hr",)) -> DataFrame:
    """The same permutation of an area's revisits in every role but the ``fixed`` ones."""
    order = df.filter(~F.col("role").isin(*fixed)).select(*KEY).distinct()
    order = order.withColumn("_to", F.row_number().over(Window.partitionBy("aoi").orderBy(digest(seed, "aoi", "revisit"))))
    joined = df.join(order, KEY, "left")
    return joined.withColumn("revisit", F.when(F.col("role").isin(*fixed), F.col("revisit")).otherwise(F.col("_to"))).drop("_to")


def shift_image(df: DataFrame, dx: int, dy: int) -> DataFrame:
    """Move by whole pixels, borders reflected: place (y, x) takes (y - dy, x - dx)."""
    def source(i):
        y, x = F.floor(i / F.col("w")), i % F.col("w")
        return weights.reflected(y - dy, F.col("h")) * F.col("w") + weights.reflected(x - dx, F.col("w"))

    return df.withColumn("pixels", gathered(F.col("pixels"), F.col("h") * F.col("w"), source))


def pad_revisits(df: DataFrame) -> DataFrame:
    """Black revisits up to the next power of two, numbered after the last."""
    sized = df.groupBy("aoi", "role", "band", "h", "w").agg(F.max("revisit").alias("n"))
    full = F.pow(F.lit(2), F.ceil(F.log2(F.col("n")))).cast("int")
    extra = sized.withColumn("full", full).filter("full > n").withColumn("revisit", F.explode(F.sequence(F.col("n") + 1, F.col("full"))))
    kind = df.schema["pixels"].dataType.elementType
    black = extra.withColumn("pixels", F.array_repeat(F.lit(0).cast(kind), F.col("h") * F.col("w")))
    return df.unionByName(black.select(*[c for c in df.columns if c in black.columns]), allowMissingColumns=True)


def append_masks(df: DataFrame, masks: DataFrame, bands: int) -> DataFrame:
    """Masks as further bands, numbered after ``bands``."""
    return df.unionByName(masks.withColumn("band", (F.col("band") + bands).cast("int")), allowMissingColumns=True)


def baseline_upscale(df: DataFrame, stats: DataFrame, size: int, compat: bool = False) -> DataFrame:
    """The first revisit's true-colour bands, denormalised, divided by their largest value, clamped and resized bicubically.
    ``compat`` takes (v + mean) * std for the inverse."""
    picked = df.filter((F.col("revisit") == 1) & F.col("band").isin(COMPOSITES["true_color"])).join(stats, "band")

    def back(v):
        return (v + F.col("mean")) * F.col("std") if compat else v * F.col("std") + F.col("mean")

    lit = picked.withColumn("pixels", F.transform("pixels", back)).drop("mean", "std")
    lit = lit.withColumn("_top", F.max(F.array_max("pixels")).over(Window.partitionBy("aoi")))
    lit = lit.withColumn("pixels", F.transform("pixels", lambda v: F.least(F.greatest(v / F.col("_top"), F.lit(0.0)), F.lit(1.0)))).drop("_top")
    return weights.resized(lit, size, size, "bicubic")


def pansharpen_resized(rgb: DataFrame, pan: DataFrame, size: int) -> DataFrame:
    """``rgb(aoi, h, w, r, g, b)`` resized bilinearly to the ``size`` of ``pan(aoi, pan)`` and sharpened; values in [0, 1]."""
    wide = weights.resized(rgb.select("aoi", "h", "w", "r", "g", "b"), size, size, "bilinear", ("r", "g", "b"))
    return pansharpen(wide.select("aoi", "r", "g", "b").join(pan, "aoi"))
