"""Interpolation, shifts and windows as sparse products of pixels and small tables of weights.

A resize is two products, one along each axis, with a table (n, out, at, weight): for an axis of n pixels, which pixels a new
one is made of. Shifts and windows have one short list of taps for every pixel, known when the plan is made."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import let

#: Reach of the kernels in source pixels, or in target pixels when shrinking.
REACH = {"bilinear": 1, "bicubic": 2}


def kernel(t: Column, mode: str, sharp: Column) -> Column:
    """The interpolation kernel at a distance ``t``; ``sharp`` is the cubic's slope parameter."""
    if mode == "bilinear":
        return F.greatest(F.lit(0.0), 1 - t)
    near = ((sharp + 2) * t - (sharp + 3)) * t * t + 1
    far = ((sharp * t - 5 * sharp) * t + 8 * sharp) * t - 4 * sharp
    return F.when(t <= 1, near).when(t < 2, far).otherwise(0.0)


def resample_table(sizes: DataFrame, m: int, mode: str) -> DataFrame:
    """``(n, out, at, weight)`` for every ``n`` of ``sizes`` and ``m`` new pixels: half-pixel centres, the kernel widened when
    shrinking, pixels beyond a border counting for the one at it; weights of a new pixel sum to 1."""
    if mode not in REACH:
        raise ValueError(f"unknown interpolation: {mode}")
    scale = F.col("n") / F.lit(float(m))
    wide = F.greatest(scale, F.lit(1.0))
    new = sizes.select("n", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("out"))
    new = new.select("n", "out", wide.alias("wide"), ((F.col("out") + 0.5) * scale - 0.5).alias("centre"))
    reach = REACH[mode] * F.col("wide")
    taps = new.withColumn("j", F.explode(F.sequence(F.floor(F.col("centre") - reach), F.ceil(F.col("centre") + reach))))
    # The cubic's slope when enlarging and when shrinking.
    sharp = F.when(F.col("wide") == 1, -0.75).otherwise(-0.5)
    value = kernel(F.abs(F.col("j") - F.col("centre")) / F.col("wide"), mode, sharp)
    held = taps.select("n", "out", F.least(F.greatest(F.col("j"), F.lit(0)), F.col("n") - 1).cast("int").alias("at"), value.alias("v")).filter("v != 0")
    one = held.groupBy("n", "out", "at").agg(F.sum("v").alias("v"))
    total = one.groupBy("n", "out").agg(F.sum("v").alias("total"))
    return one.join(total, ["n", "out"]).select("n", "out", "at", (F.col("v") / F.col("total")).alias("weight"))


def _taps(sizes: DataFrame, m: int, mode: str, axis: str, name: str) -> DataFrame:
    """One row for each size: an array, by new pixel, of arrays of ``(at, weight)``."""
    table = resample_table(sizes.select(F.col(axis).alias("n")).distinct(), m, mode)
    by_out = table.groupBy("n", "out").agg(F.array_sort(F.collect_list(F.struct("at", "weight"))).alias("taps"))
    made = by_out.groupBy("n").agg(F.array_sort(F.collect_list(F.struct("out", "taps"))).alias("all"))
    return made.select(F.col("n").alias(axis), F.col("all.taps").alias(name))


def resized(df: DataFrame, h: int, w: int, mode: str, columns: tuple[str, ...] = ("pixels",)) -> DataFrame:
    """Resample the pixel arrays of ``columns`` to ``h`` by ``w``. The tables of weights have a row for each image size in ``df``."""
    joined = df.join(_taps(df, w, mode, "w", "_across"), "w").join(_taps(df, h, mode, "h", "_down"), "h")

    def product(pixels: Column) -> Column:
        def total(taps, at):
            return F.aggregate(taps, F.lit(0.0), lambda a, t: a + t["weight"] * at(t["at"]))

        across = F.transform(F.sequence(F.lit(0), F.col("h") * w - 1), lambda i: total(F.get(F.col("_across"), (i % w).cast("int")), lambda x: F.get(pixels, (F.floor(i / w) * F.col("w") + x).cast("int"))))
        return let(across, lambda half: F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: total(F.get(F.col("_down"), F.floor(i / w).cast("int")), lambda y: F.get(half, (y * w + i % w).cast("int")))))

    # Columns are bound once: an expression named inside a lambda would be computed for every pixel.
    return joined.withColumns({c: let(F.col(c), product) for c in columns}).withColumns({"h": F.lit(h), "w": F.lit(w)}).select(*df.columns)


def reflected(i: Column, n: Column) -> Column:
    """An index beyond an edge, reflected about the edge pixel; distances are smaller than the image."""
    i = F.abs(i)
    return F.when(i >= n, 2 * (n - 1) - i).otherwise(i)


def convolved(pixels: Column, h: Column, w: Column, across: list[float], down: list[float]) -> Column:
    """Convolution with ``across`` along rows, then ``down`` along columns: odd lists of taps about 0, borders reflected.

    The image is padded once. Then a tap's pixels are a slice of the array, and a pass sums weighted slices side by side; sums that
    reach from one row into the next fall into the padding, which is cut off at the end."""
    rx, ry = len(across) // 2, len(down) // 2
    wide, high = w + 2 * rx, h + 2 * ry

    def pixel(v, i):
        return F.get(v, (reflected(F.floor(i / wide) - ry, h) * w + reflected(i % wide - rx, w)).cast("int"))

    def weighted(v, taps, stride, n):
        parts = F.arrays_zip(*[F.slice(v, (F.lit(i) * stride + 1).cast("int"), n.cast("int")).alias(str(i)) for i in range(len(taps))])
        # A convolution: the slice that begins first has the tap of the greatest distance.
        return F.transform(parts, lambda p: sum((F.lit(k) * p[str(i)] for i, k in enumerate(reversed(taps)) if k), F.lit(0.0)))

    def passes(padded):
        n = high * wide - 2 * rx
        rows = weighted(padded, across, F.lit(1), n)
        return let(let(rows, lambda v: weighted(v, down, wide, (h - 1) * wide + w)), inner)

    def inner(v):
        return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.slice(v, (y * wide + 1).cast("int"), w.cast("int"))))

    return let(pixels, lambda v: let(F.transform(F.sequence(F.lit(0), high * wide - 1), lambda i: pixel(v, i)), passes))


def gaussian(size: int = 5, sigma: float = 1.5) -> list[float]:
    values = [math.exp(-((i - size // 2) ** 2) / (2 * sigma**2)) for i in range(size)]
    return [v / sum(values) for v in values]


def lanczos(shift: float, reach: int, a: int = 3) -> list[float]:
    """Normalised taps at -reach..reach that move an image by ``shift`` pixels; the small offset keeps the centre defined."""
    values = []
    for o in range(-reach, reach + 1):
        x = o - shift + 1e-3
        values.append(a * math.sin(math.pi * x) * math.sin(math.pi * x / a) / (math.pi * x) ** 2 if abs(x) < a else 0.0)
    return [v / sum(values) for v in values]
