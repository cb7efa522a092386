"""Ranking and choosing revisits, and what to relax where too few are left."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import catalogue

AOI = "aoi_index"


def limit_delta(df: DataFrame, most: int | None) -> DataFrame:
    return df if most is None else df.filter(F.abs("delta") <= most)


def limit_cloud(df: DataFrame, most: float | None) -> DataFrame:
    return df if most is None else df.filter(F.col("cloud_cover") <= most)


def average_rank(value: Column) -> Column:
    """Rank within the area, ties sharing the mean of their places; null for null."""
    w = Window.partitionBy(AOI).orderBy(value.asc_nulls_last())
    ties = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(value.isNotNull(), F.rank().over(w) + (ties - 1) / 2)


def _counted_rank(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``average_rank`` as a column, from counts of each value: places before it, and half of those that share it."""
    marked = df.withColumn("_v", value)
    counts = marked.filter("_v IS NOT NULL").groupBy(AOI, "_v").agg(F.count(F.lit(1)).alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(AOI).orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.join(counts.select(AOI, "_v", (before + (F.col("_c") + 1) / 2).alias(name)), [AOI, "_v"], "left").drop("_v")


def rank_revisits(df: DataFrame, w_delta: float = 1.0, w_cloud: float = 1.0, spread: bool = False) -> DataFrame:
    """Add ``rank``: weighted sum of the average ranks of distance in days and of cloud; 1 for a lone revisit.

    With ``spread``, ranks come from counts of values, joined by area and value, so that an area of any size is spread over
    tasks; without it, from windows over areas, which need no further exchange where rows are dealt by area."""
    if not spread:
        ranked = w_delta * average_rank(F.abs("delta")) + w_cloud * average_rank(F.col("cloud_cover"))
        lone = F.count(F.lit(1)).over(Window.partitionBy(AOI)) == 1
        return df.withColumn("rank", F.when(lone, F.lit(1.0)).otherwise(ranked))
    both = _counted_rank(_counted_rank(df, F.abs("delta"), "_d"), F.col("cloud_cover"), "_k")
    sizes = df.groupBy(AOI).agg(F.count(F.lit(1)).alias("_size"))
    ranked = F.when(F.col("_size") == 1, F.lit(1.0)).otherwise(w_delta * F.col("_d") + w_cloud * F.col("_k"))
    return both.join(sizes, AOI).withColumn("rank", ranked).select(*df.columns, "rank")


def _order() -> list[Column]:
    return [F.col("rank").asc_nulls_last(), F.abs("delta"), F.col("cloud_cover"), F.col("product_id")]


#: Parts that an area's best are taken from before they meet.
PARTS = 64


def select_best(df: DataFrame, n: int, spread: bool = False) -> DataFrame:
    """The ``n`` lowest ranks per area, numbered in that order in ``n``. With ``spread``, those of each of ``PARTS`` parts first."""
    if spread:
        parts = df.withColumn("_part", F.pmod(F.xxhash64("product_id"), F.lit(PARTS)))
        best = parts.withColumn("_n", F.row_number().over(Window.partitionBy(AOI, "_part").orderBy(*_order()))).filter(F.col("_n") <= n)
        df = best.drop("_part", "_n")
    return df.withColumn("n", F.row_number().over(Window.partitionBy(AOI).orderBy(*_order()))).filter(F.col("n") <= n)


def number_selected(df: DataFrame) -> DataFrame:
    return df.withColumn("n", F.row_number().over(Window.partitionBy(AOI).orderBy(*_order())))


def attach_aoi(df: DataFrame, aois: DataFrame) -> DataFrame:
    return df.join(aois.select(AOI, "name", "bounds", "target_date"), AOI)


def select_revisits(aois: DataFrame, revisits: DataFrame, n: int = 8, max_delta: int | None = None, max_cloud: float | None = None, w_delta: float = 1.0, w_cloud: float = 1.0, aoi_area: float | None = None, spread: bool = False) -> DataFrame:
    """Best ``n`` revisits of every area. Limits apply before ranks, which they change. All windows share one exchange on the
    area; the areas' columns are joined once, before it. With ``spread``, for areas too large for one task, rows are never dealt by area
    alone (``rank_revisits``, ``select_best``)."""
    known = aois.select(AOI, "name", "bounds", "target_date")
    joined = revisits.join(known, AOI)
    joined = joined.withColumn("area", catalogue.geo.box_overlap_km2(F.col("footprint"), F.col("bounds")))
    joined = joined.withColumn("delta", F.datediff(F.to_date("datetime"), "target_date"))
    if not spread:
        joined = joined.repartition(int(joined.sparkSession.conf.get("spark.sql.shuffle.partitions")), AOI)
    kept = catalogue.dedupe_revisits(joined)
    if aoi_area is not None:
        kept = catalogue.filter_full_overlap(kept, aoi_area)
    kept = limit_cloud(limit_delta(kept, max_delta), max_cloud)
    return select_best(rank_revisits(kept, w_delta, w_cloud, spread), n, spread)


def shortage_report(aois: DataFrame, selected: DataFrame, n: int) -> DataFrame:
    """``(aoi_index, found)`` of the areas with fewer than ``n`` selected revisits, also those with none."""
    found = selected.groupBy(AOI).agg(F.count(F.lit(1)).alias("found"))
    return aois.select(AOI).distinct().join(found, AOI, "left").select(AOI, F.coalesce("found", F.lit(0)).alias("found")).filter(F.col("found") < n)


def _nth_smallest(df: DataFrame, value: Column, n: int, name: str) -> DataFrame:
    w = Window.partitionBy(AOI).orderBy(value)
    first = df.filter(value.isNotNull()).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
    return first.groupBy(AOI).agg(F.max(value).alias(name), F.count(F.lit(1)).alias("seen"))


def required_delta(df: DataFrame, n: int, most: int) -> DataFrame:
    """``(aoi_index, required_delta)``: the distance in days that admits ``n`` revisits; null if ``most`` already does."""
    need = _nth_smallest(df, F.abs("delta"), n, "need")
    return need.select(AOI, F.when(F.col("need") > most, F.col("need")).alias("required_delta"))


def required_cloud(df: DataFrame, n: int, most: float) -> DataFrame:
    need = _nth_smallest(df, F.col("cloud_cover"), n, "need")
    return need.select(AOI, F.when(F.col("need") > most, F.col("need")).alias("required_cloud"))


def required_combination(df: DataFrame, n: int, max_delta: int, max_cloud: float) -> DataFrame:
    """``(aoi_index, delta_within_cloud, cloud_within_delta)``: the distance needed among revisits under the cloud limit, and the
    cloud needed among those under the distance limit; both null if either set has fewer than ``n`` rows."""
    by_delta = _nth_smallest(df.filter(F.col("cloud_cover") <= max_cloud), F.abs("delta"), n, "d").withColumnRenamed("seen", "seen_d")
    by_cloud = _nth_smallest(df.filter(F.abs("delta") <= max_delta), F.col("cloud_cover"), n, "c").withColumnRenamed("seen", "seen_c")
    joined = df.select(AOI).distinct().join(by_delta, AOI, "left").join(by_cloud, AOI, "left")
    enough = (F.coalesce("seen_d", F.lit(0)) >= n) & (F.coalesce("seen_c", F.lit(0)) >= n)
    return joined.select(AOI, F.when(enough, F.col("d")).alias("delta_within_cloud"), F.when(enough, F.col("c")).alias("cloud_within_delta"))


def recommend_parameters(df: DataFrame, n: int, max_delta: int, max_cloud: float) -> DataFrame:
    """Per area the least limits that give ``n`` revisits; the given limit where it suffices already."""
    out = required_delta(df, n, max_delta).join(required_cloud(df, n, max_cloud), AOI).join(required_combination(df, n, max_delta, max_cloud), AOI)
    return out.select(AOI, F.coalesce("required_delta", F.lit(max_delta)).alias("delta"), F.coalesce("required_cloud", F.lit(max_cloud)).alias("cloud"), "delta_within_cloud", "cloud_within_delta")


def filter_days(df: DataFrame, start: str, days: int) -> DataFrame:
    day, first = F.to_date("datetime"), F.lit(start).cast("date")
    return df.filter((day >= first) & (day < F.date_add(first, days)))


def lost_aois(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select(AOI).distinct().join(after.select(AOI).distinct(), AOI, "left_anti")


def filter_cloud(df: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    kept = df.filter(F.col("cloud_cover") <= most)
    return kept, lost_aois(df, kept)


OPERATORS = {
    ">": operator.gt, "greater": operator.gt, "<": operator.lt, "less": operator.lt,
    ">=": operator.ge, "greater or equal": operator.ge, "<=": operator.le, "less or equal": operator.le,
    "=": operator.eq, "==": operator.eq, "equal": operator.eq,
}


def filter_column(df: DataFrame, column: str, value, op: str) -> DataFrame:
    if op not in OPERATORS:
        raise ValueError(f"unknown operator: {op}")
    return df.filter(OPERATORS[op](F.col(column), value))


def filter_overlap(df: DataFrame, target_area: float, min_revisits: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows of at least ``target_area``; the areas that vanish; the areas left with fewer than ``min_revisits`` rows."""
    kept = df.filter(F.col("area") >= target_area)
    few = kept.groupBy(AOI).agg(F.count(F.lit(1)).alias("found")).filter(F.col("found") < min_revisits)
    return kept, lost_aois(df, kept), few


def verify_overlap(df: DataFrame, target_area: float) -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(F.col("area") >= target_area), F.lit(True)).alias("all_covered"))
