"""Quality metrics of predicted images. A pair table has a row per item and band with ``pred`` and ``truth`` pixel arrays, h and w."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import weights
from .catalogue import histogram
from .images import crop


def pairs(pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """Join predictions and truth on the item's ``keys`` and the band."""
    left = pred.select(*keys, "band", "h", "w", F.col("pixels").cast("array<double>").alias("pred"))
    return left.join(truth.select(*keys, "band", F.col("pixels").cast("array<double>").alias("truth")), [*keys, "band"])


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def absolute_error(pred: Column, truth: Column) -> Column:
    return _total(F.zip_with(pred, truth, lambda p, t: F.abs(p - t)))


def squared_error(pred: Column, truth: Column) -> Column:
    return _total(F.zip_with(pred, truth, lambda p, t: (p - t) * (p - t)))


def variation(pixels: Column, h: Column, w: Column) -> Column:
    """Sum of absolute differences of neighbours along both axes, over the number of pixels."""
    n = F.size(pixels)
    across = F.transform(pixels, lambda v, i: F.when(i % w > 0, F.abs(v - F.get(pixels, i - 1))).otherwise(F.lit(0.0)))
    down = F.transform(pixels, lambda v, i: F.when(i >= w, F.abs(v - F.get(pixels, (i - w).cast("int")))).otherwise(F.lit(0.0)))
    return (_total(across) + _total(down)) / n


def psnr(mse: Column) -> Column:
    return -10 * F.log10(mse)


def metric_log(paired: DataFrame, keys: list[str]) -> DataFrame:
    """One row per item: MSE, MAE, TV, PSNR over its bands and pixels, from one pass and one aggregation."""
    p, t = F.col("pred"), F.col("truth")
    own = paired.select(*keys, absolute_error(p, t).alias("ae"), squared_error(p, t).alias("se"), variation(p, F.col("h"), F.col("w")).alias("tv"), F.size("pred").alias("n"))
    return _log(own, keys)


def _log(own: DataFrame, keys: list[str]) -> DataFrame:
    more = [F.avg("sl").alias("SSIM_loss")] if "sl" in own.columns else []
    out = own.groupBy(*keys).agg((F.sum("se") / F.sum("n")).alias("MSE"), (F.sum("ae") / F.sum("n")).alias("MAE"), F.avg("tv").alias("TV"), *more)
    return out.withColumn("PSNR", psnr(F.col("MSE")))


def ssim_losses(p: np.ndarray, t: np.ndarray, size: int = 5, top: float = 1.0) -> np.ndarray:
    """Of stacks of images (n, h, w), the mean of clamp((1 - ssim) / 2, 0, 1) over a Gaussian window with reflected borders."""
    taps, r = weights.gaussian(size), size // 2
    c1, c2 = (0.01 * top) ** 2, (0.03 * top) ** 2

    def blur(a):
        h, w = a.shape[1:]
        rows = np.pad(a, [(0, 0), (r, r), (r, r)], mode="reflect")
        rows = sum(k * rows[:, i : i + h] for i, k in enumerate(taps))
        return sum(k * rows[:, :, i : i + w] for i, k in enumerate(taps))

    mp, mt = blur(p), blur(t)
    means = mp * mp + mt * mt
    ssim_ = (2 * mp * mt + c1) * (2 * (blur(p * t) - mp * mt) + c2) / ((means + c1) * (blur(p * p + t * t) - means + c2) + 1e-12)
    return np.clip((1 - ssim_) / 2, 0, 1).mean(axis=(1, 2))


def ssim_log(paired: DataFrame, keys: list[str], size: int = 5) -> DataFrame:
    """``metric_log`` with SSIM_loss, also from one pass and one aggregation. A window's sums are array work, which Spark's lambdas do
    pixel by pixel; Arrow batches of equally large images do it at once. Images are larger than half a window."""
    kinds = {f.name: f.dataType.simpleString() for f in paired.schema}
    out = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", ae double, se double, tv double, n int, sl double"

    def run(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            h, w = (table.column(c).to_numpy() for c in ("h", "w"))
            for a, b in sorted(set(zip(h.tolist(), w.tolist(), strict=True))):
                at = np.flatnonzero((h == a) & (w == b))
                own = table.take(at)
                p, t = (np.stack(own.column(c).to_numpy()).astype(float).reshape(len(at), a, b) for c in ("pred", "truth"))
                tv = (np.abs(np.diff(p, axis=1)).sum(axis=(1, 2)) + np.abs(np.diff(p, axis=2)).sum(axis=(1, 2))) / (a * b)
                sums = [np.abs(p - t).sum(axis=(1, 2)), ((p - t) ** 2).sum(axis=(1, 2)), tv, np.full(len(at), a * b, np.int32), ssim_losses(p, t, size)]
                made = pa.table([*[own.column(k) for k in keys], *map(pa.array, sums)], names=[*keys, "ae", "se", "tv", "n", "sl"])
                yield from made.to_batches()

    return _log(paired.select(*keys, "h", "w", "pred", "truth").mapInArrow(run, out), keys)


def ssim(paired: DataFrame, keys: list[str], size: int = 5) -> DataFrame:
    """``(keys, SSIM_loss)``, mean over bands."""
    return ssim_log(paired, keys, size).select(*keys, "SSIM_loss")


def bias_adjust(paired: DataFrame) -> DataFrame:
    """Add the mean of truth - pred of each band to its predictions."""
    gap = (_total(F.col("truth")) - _total(F.col("pred"))) / F.size("pred")
    return paired.withColumn("_gap", gap).withColumn("pred", F.transform("pred", lambda v: v + F.col("_gap"))).drop("_gap")


METRICS = {"mse": squared_error, "mae": absolute_error}


def registered_loss(paired: DataFrame, keys: list[str], shift: int, metric: str = "mse") -> DataFrame:
    """``(keys, loss, dx, dy)``: the least metric of the prediction's centre against the truth moved by up to ``shift`` pixels
    each way, and the move that gives it; ties go to the smaller dy, then dx."""
    steps = F.sequence(F.lit(-shift), F.lit(shift))
    moved = paired.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    h, w = F.col("h"), F.col("w")
    inner_w, inner_h = w - 2 * shift, h - 2 * shift
    centre = crop(F.col("pred"), w, F.lit(shift), F.lit(shift), inner_w, inner_h)
    window = crop(F.col("truth"), w, shift - F.col("dx"), shift - F.col("dy"), inner_w, inner_h)
    one = moved.select(*keys, "dx", "dy", METRICS[metric](centre, window).alias("e"), (inner_w * inner_h).alias("n"))
    every = one.groupBy(*keys, "dx", "dy").agg((F.sum("e") / F.sum("n")).alias("loss"))
    least = F.min(F.struct("loss", "dy", "dx")).alias("m")
    return every.groupBy(*keys).agg(least).select(*keys, "m.loss", "m.dx", "m.dy")


def subpixel_loss(paired: DataFrame, keys: list[str], shift: int = 2, step: float = 0.5, lobes: int = 3) -> DataFrame:
    """``(keys, loss, dx, dy)``: the least mean squared error of the prediction's centre against the truth moved by multiples of
    ``step`` pixels up to ``shift`` each way by a Lanczos kernel, and the move; ties go to the smaller dy, then dx.

    The truth is resampled along its rows only, once for each dx. A move by dy is a weighted sum of the result's rows, so its error
    follows from sums of products: of the prediction with the rows at each distance, and of the rows at any two distances.
    The centre is what the kernel reaches from everywhere, ``shift + lobes`` pixels from the borders; smaller images have no row."""
    r = shift + lobes
    moves = [k * step - shift for k in range(int(round(2 * shift / step)) + 1)]
    table = F.array(*[F.array(*[F.lit(v) for v in weights.lanczos(d, r, lobes)]) for d in moves])
    taps, h, w = 2 * r + 1, F.col("h"), F.col("w")
    wide, n = w - 2 * r, (w - 2 * r) * (h - 2 * r)

    def dot(a, b):
        return _total(F.zip_with(a, b, lambda x, y: x * y))

    def rows(truth, d):
        return F.transform(F.sequence(F.lit(0), h * wide - 1), lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(taps - 1)), F.lit(0.0), lambda a, o: a + F.get(d, o) * F.get(truth, (F.floor(i / wide) * w + i % wide + 2 * r - o).cast("int"))))

    def errors(centre, truth, d, at):
        def moved(u):
            # The rows at distance o from the centre's lie one after another.
            part = [F.slice(u, ((2 * r - o) * wide + 1).cast("int"), n.cast("int")) for o in range(taps)]
            sums = F.struct(dot(centre, centre).alias("pp"), F.array(*[dot(centre, p) for p in part]).alias("x"), F.array(*[F.array(*[dot(part[i], part[j]) for j in range(i + 1)]) for i in range(taps)]).alias("a"))

            def losses(m):
                def one(k, at_y):
                    cross = _total(F.zip_with(k, m["x"], lambda a, b: a * b))
                    inner = _total(F.transform(m["a"], lambda line, i: F.get(k, i) * _total(F.transform(line, lambda v, j: v * F.get(k, j) * F.when(i == j, 1.0).otherwise(2.0)))))
                    return F.struct((at * step - shift).alias("dx"), (at_y * step - shift).alias("dy"), (m["pp"] - 2 * cross + inner).alias("e"))

                return F.transform(table, one)

            return geo.let(sums, losses)

        return geo.let(rows(truth, d), moved)

    held = paired.filter((h > 2 * r) & (w > 2 * r))
    centre = crop(F.col("pred"), w, F.lit(r), F.lit(r), wide, h - 2 * r)
    found = geo.let(F.struct(centre.alias("c"), F.col("truth").alias("t")), lambda m: F.flatten(F.transform(table, lambda d, at: errors(m["c"], m["t"], d, at))))
    every = held.select(*keys, n.alias("n"), F.inline(found))
    summed = every.groupBy(*keys, "dx", "dy").agg((F.sum("e") / F.sum("n")).alias("loss"))
    return summed.groupBy(*keys).agg(F.min(F.struct("loss", "dy", "dx")).alias("m")).select(*keys, "m.loss", "m.dx", "m.dy")


def baseline_compare(model: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Join two metric logs: the baseline's MSE and PSNR and the ratio of PSNRs, baseline over model."""
    other = baseline.select(*keys, F.col("MSE").alias("baseline_MSE"), F.col("PSNR").alias("baseline_PSNR"))
    return model.join(other, keys).withColumn("PSNR_ratio", F.col("baseline_PSNR") / F.col("PSNR"))


def full_metric_log(paired: DataFrame, baseline: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One row per item: MSE, MAE, SSIM_loss, TV, PSNR and, from pairs of a baseline's images keyed ``by``, baseline_MSE and
    baseline_PSNR."""
    other = metric_log(baseline, by).select(*by, F.col("MSE").alias("baseline_MSE"), F.col("PSNR").alias("baseline_PSNR"))
    return ssim_log(paired, keys).join(other, by)


def weighted_loss(log: DataFrame, mse: float = 1.0, mae: float = 0.0, ssim_weight: float = 0.0, tv: float = 0.0) -> DataFrame:
    """Add ``loss``; the weights of MSE, MAE and SSIM must sum to 1."""
    if abs(mse + mae + ssim_weight - 1) > 1e-9:
        raise ValueError("weights of MSE, MAE and SSIM must sum to 1")
    loss = mse * F.col("MSE") + mae * F.col("MAE") + tv * F.col("TV")
    return log.withColumn("loss", loss + ssim_weight * F.col("SSIM_loss") if ssim_weight else loss)


def metric_summary(log: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means by every prefix of ``by``, null standing for all."""
    return log.rollup(*by).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def loss_histogram(log: DataFrame, column: str = "loss", bins: int = 10) -> DataFrame:
    return histogram(log, column, bins)


def overlap_area_rings(df: DataFrame, ring: str = "coordinates", bounds: str = "bounds") -> DataFrame:
    """Add ``area``: a footprint polygon's part within the bounds, km2 to two decimals; for footprints that aren't boxes."""
    return df.withColumn("area", geo.ring_overlap_km2(F.col(ring), F.col(bounds)))
