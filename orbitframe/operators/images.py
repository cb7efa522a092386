"""Image tables: pairing, splitting, chipping, scaling.

A chip row is ``(aoi, role, revisit, band, h, w, pixels)`` with the pixels of one band in row-major order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered

# Band composites (numbered from 1), value ranges, and band means and deviations of the low-resolution sensor.
COMPOSITES = {"true_color": [4, 3, 2], "false_color": [8, 4, 3], "swir": [12, 8, 4], "agriculture": [11, 8, 2], "geology": [12, 11, 2], "bathimetric": [4, 3, 1]}
DEPTH = {8: 255.0, 12: 10000.0}
LOW_MEAN = [0.0008, 0.0117, 0.0211, 0.0198, 0.0671, 0.1274, 0.1449, 0.1841, 0.1738, 0.1803, 0.0566, -0.0559]
LOW_STD = [0.0892, 0.0976, 0.1001, 0.1169, 0.1154, 0.1066, 0.1097, 0.1151, 0.1122, 0.1176, 0.1298, 0.1176]


def digest(seed: int, *keys: str) -> Column:
    """Orders rows at random, alike on every engine and partitioning."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def first_revisits(inventory: DataFrame, limits: dict[str, int | None]) -> DataFrame:
    """The first files of each area and role by revisit number; a limit of None takes all, a role without one none."""
    table = F.create_map(*[x for role, n in limits.items() for x in (F.lit(role), F.lit(n if n is not None else 2**31 - 1))])
    place = F.row_number().over(Window.partitionBy("aoi", "role").orderBy("n", "path"))
    return inventory.withColumn("_p", place).filter(F.col("_p") <= F.try_element_at(table, F.col("role"))).drop("_p")


def align_roles(roles: dict[str, DataFrame], by_revisit: tuple[str, ...] = ("lr", "lrc")) -> DataFrame:
    """One record per area (and revisit, for the roles of ``by_revisit``) that every role has; columns get the role's prefix."""
    out = None
    for role, df in roles.items():
        keys = ["aoi", "revisit"] if role in by_revisit else ["aoi"]
        own = df.select(*keys, *[F.col(c).alias(f"{role}_{c}") for c in df.columns if c not in ("aoi", "revisit", "role")])
        out = own if out is None else out.join(own, [k for k in keys if k in out.columns])
    return out


def filter_aois(df: DataFrame, listed: DataFrame) -> DataFrame:
    return df.join(listed.select("aoi"), "aoi", "left_semi")


def split_from_list(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Join the ``split`` column; the list must name train, val and test, and nothing else."""
    names = {r[0] for r in listed.select("split").distinct().limit(5).collect()}
    if names != {"train", "val", "test"}:
        raise ValueError(f"splits must be train, val and test: {sorted(map(str, names))}")
    return df.join(listed.select("aoi", "split"), "aoi")


def shuffle_scenes(df: DataFrame, seed: int = 42) -> DataFrame:
    """``(aoi, position)``: a random order of the areas, numbered from 0."""
    aois = df.select("aoi").distinct().withColumn("_digest", digest(seed, "aoi"))
    return numbered(aois, "position", "_digest", "aoi").select("aoi", (F.col("position") - 1).cast("int").alias("position"))


def split_scenes(df: DataFrame, train: float | int = 0.8, val: float | int = 0.1, test: float | int = 0.1, seed: int = 42) -> DataFrame:
    """Add ``split``. Shares are truncated to whole scenes and taken in turn after the shuffle; the rest is dropped. All rows
    of a scene share its split."""
    order = shuffle_scenes(df, seed)
    n = F.lit(order.count())

    def size(x):
        return F.lit(x) if isinstance(x, int) else F.floor(n * x + 1e-9)

    a = size(train)
    b = a + size(val)
    c = b + size(test)
    p = F.col("position")
    named = order.withColumn("split", F.when(p < a, "train").when(p < b, "val").when(p < c, "test"))
    return df.join(named.filter("split IS NOT NULL").select("aoi", "split"), "aoi")


def subset_train(df: DataFrame, share: float, seed: int = 42, item: tuple[str, ...] = ()) -> DataFrame:
    """The first ``share`` of the training items, by scene in the shuffled order and then by ``item``, the columns that name a chip
    within its scene; without these a scene is one item. Other splits stay."""
    if share >= 1:
        return df
    items = df.filter("split = 'train'").select("aoi", *item).distinct().withColumn("_digest", digest(seed, "aoi"))
    order = numbered(items, "_at", "_digest", "aoi", *item)
    kept = order.filter(F.col("_at") <= F.floor(F.lit(items.count()) * share)).select("aoi", *item)
    return df.filter("split != 'train'").unionByName(df.filter("split = 'train'").join(kept, ["aoi", *item], "left_semi"))


def select_bands(df: DataFrame, composite: str | list[int] = "true_color") -> DataFrame:
    """Rows of the composite's bands, with their place in it in ``channel``. The bands are a plain predicate, so it reaches the scan."""
    bands = COMPOSITES[composite] if isinstance(composite, str) else list(composite)
    return df.filter(F.col("band").isin(bands)).withColumn("channel", F.array_position(F.array(*map(F.lit, bands)), F.col("band")).cast("int"))


def scaled(v: Column, depth: int) -> Column:
    return F.least(F.greatest(v / DEPTH[depth], F.lit(0.0)), F.lit(1.0))


def radiometric_scale(df: DataFrame, depth: int = 12) -> DataFrame:
    """Pixels to [0, 1] from their bit depth."""
    return df.withColumn("pixels", F.transform("pixels", lambda v: scaled(v, depth)))


def stats_table(df: DataFrame, mean: list[float] = LOW_MEAN, std: list[float] = LOW_STD) -> DataFrame:
    rows = [(i + 1, m, s) for i, (m, s) in enumerate(zip(mean, std, strict=True))]
    return df.sparkSession.createDataFrame(rows, "band int, mean double, std double")


def normalise_bands(df: DataFrame, stats: DataFrame) -> DataFrame:
    """(v - mean) / std by band; ``stats`` has a row per band."""
    joined = df.join(stats, "band")
    return joined.withColumn("pixels", F.transform("pixels", lambda v: (v - F.col("mean")) / F.col("std"))).drop("mean", "std")


def denormalise_bands(df: DataFrame, stats: DataFrame) -> DataFrame:
    joined = df.join(stats, "band")
    return joined.withColumn("pixels", F.transform("pixels", lambda v: v * (F.col("std") + 1e-7) + F.col("mean"))).drop("mean", "std")


def band_stats(df: DataFrame, accuracy: int | None = None) -> DataFrame:
    """``(band, n, median, std)``: the lower median and the root mean square distance from it.

    Exactly: values are counted first, with partial counts per task; digital numbers have few of them, so no pixels are gathered.
    With ``accuracy``, for pixels of many values: a mergeable sketch of each band, whose median's rank is off by at most n / accuracy, and
    sums from which the distance follows, in one pass."""
    values = df.select("band", F.explode("pixels").alias("v"))
    if accuracy is not None:
        v = F.col("v").cast("double")
        sums = values.groupBy("band").agg(F.count("v").alias("n"), F.percentile_approx("v", 0.5, accuracy).alias("median"), F.avg(v).alias("mean"), F.var_pop(v).alias("spread"))
        away = F.col("mean") - F.col("median")
        return sums.select("band", "n", "median", F.sqrt(F.col("spread") + away * away).alias("std"))
    counts = values.groupBy("band", "v").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("band")
    upto = F.sum("c").over(w.orderBy("v"))
    marked = counts.withColumns({"upto": upto, "n": F.sum("c").over(w)})
    median = marked.filter("upto * 2 >= n").groupBy("band").agg(F.min("v").alias("median"), F.first("n").alias("n"))
    spread = counts.join(F.broadcast(median), "band").groupBy("band", "n", "median")
    away = F.col("v") - F.col("median")
    return spread.agg(F.sqrt(F.sum(F.col("c") * away * away) / F.col("n")).alias("std"))


def chip_grid(width: int, height: int, w: int, h: int, stride: tuple[int, int] | None = None) -> Column:
    """An array of chip corners (x, y), x outer; a chip must fit in the image."""
    if w > width or h > height:
        raise ValueError("chip exceeds the image")
    sx, sy = stride or (w, h)
    xs, ys = F.sequence(F.lit(0), F.lit(width - w), F.lit(sx)), F.sequence(F.lit(0), F.lit(height - h), F.lit(sy))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.cast("int").alias("chip_x"), y.cast("int").alias("chip_y")))))


def crop(pixels: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), h - 1), lambda r: F.slice(pixels, ((y + r) * width + x + 1).cast("int"), w.cast("int"))))


def chip_images(df: DataFrame, width: int, height: int, w: int, h: int, stride: tuple[int, int] | None = None) -> DataFrame:
    """Cut every image into the chips of a grid given for a ``width`` by ``height`` source; images of another size are cut at
    corners and sizes scaled and rounded. Adds chip_x, chip_y (of the source grid) and ``chip``, the place in the grid."""
    cut = df.select("*", F.posexplode(chip_grid(width, height, w, h, stride)).alias("chip", "corner")).select("*", "corner.*").drop("corner")
    fx, fy = F.col("w") / width, F.col("h") / height
    x, y = F.round(F.col("chip_x") * fx).cast("int"), F.round(F.col("chip_y") * fy).cast("int")
    cw, ch = F.round(w * fx).cast("int"), F.round(h * fy).cast("int")
    return cut.withColumns({"pixels": crop(F.col("pixels"), F.col("w"), x, y, cw, ch), "_w": cw, "_h": ch}).drop("w", "h").withColumnsRenamed({"_w": "w", "_h": "h"})


def chip_index(df: DataFrame, chips: int) -> DataFrame:
    """Number chips scene by scene: ``position`` of the scene times chips per scene plus ``chip``."""
    return df.withColumn("index", F.col("position") * chips + F.col("chip"))


def patch_windows(df: DataFrame, size: int, window: int) -> DataFrame:
    return chip_images(df, size, size, window, window)
