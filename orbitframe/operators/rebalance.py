"""Flattened class distributions, allocation of counts, exact stratified samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stratify

def _whole():
    """Distributions have a row per class, a few dozen, so a window over all of them is small."""
    return Window.partitionBy()


def rebalance(distribution: DataFrame, fn: Callable[[Column], Column] = F.sqrt) -> DataFrame:
    """Add ``share``: fn(count) over the sum of fn(count)."""
    value = fn(F.col("count").cast("double"))
    return distribution.withColumn("share", value / F.sum(value).over(_whole()))


def allocate_counts(shares: DataFrame, target: int, cls: str) -> DataFrame:
    """Add ``number_of_pois``: every share, rounded to two decimals, times ``target``; what is short of the target is dealt
    out by ones in the order of the shares' lost hundredths, as often round as it takes; then truncated. An overshoot
    of the rounding stays."""
    out = shares.withColumn("_start", F.round("share", 2) * target)
    short = F.ceil(F.lit(target) - F.sum("_start").over(_whole()))
    out = out.withColumns({"_short": F.greatest(short, F.lit(0)), "_k": F.count(F.lit(1)).over(_whole()), "_lost": (F.col("share") * 100) % 1})
    place = F.row_number().over(_whole().orderBy(F.col("_lost").desc(), cls)) - 1
    more = F.floor(F.col("_short") / F.col("_k")) + (place < F.col("_short") % F.col("_k")).cast("int")
    return out.withColumn("number_of_pois", (F.col("_start") + more).cast("int")).drop("_start", "_short", "_k", "_lost")


def rebalance_within(points: DataFrame, selected: str, value, cls: str, target: int, fn: Callable[[Column], Column] = F.sqrt) -> DataFrame:
    """Allocation of ``target`` points over the classes ``cls`` of the points whose ``selected`` is ``value``; ``name`` says which."""
    inner = stratify.subclass_distribution(points, selected, value, cls)
    return allocate_counts(rebalance(inner, fn), target, cls).withColumn("name", F.lit(f"{selected}_{value}_{cls}"))


def allocation_check(allocated: DataFrame, target: int) -> DataFrame:
    total = F.coalesce(F.sum("number_of_pois"), F.lit(0))
    return allocated.agg(total.alias("total"), (total == target).alias("matches"))


#: Parts that a class is sampled in before its samples meet.
PARTS = 64


def _smallest(points: DataFrame, cls: str, seed: int, key: str, *more: str) -> DataFrame:
    order = Window.partitionBy(cls, *more).orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string")).cast("binary")), key)
    return points.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= F.col("_wanted")).drop("_place")


def stratified_sample(points: DataFrame, allocated: DataFrame, cls: str, seed: int = 42, key: str = "point_id") -> DataFrame:
    """Exactly ``number_of_pois`` points of every class, or all there are: those of the smallest hashes of ``key``.

    Smallest hashes can be merged: every class is first cut down in ``PARTS`` parts, so that the points of a frequent class never
    meet in one task, only that many samples of it."""
    wanted = allocated.select(cls, F.col("number_of_pois").alias("_wanted"))
    joined = points.join(wanted, cls).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(PARTS)))
    return _smallest(_smallest(joined, cls, seed, key, "_part").drop("_part"), cls, seed, key).drop("_wanted")


def sample_with_top_up(draw, allocated: DataFrame, cls: str, n: int, seed: int = 42, rounds: int = 5, key: str = "point_id") -> DataFrame:
    """A stratified sample from ``draw(a, b)``, the stratified points of draws a to b - 1: the first ``n``, then, while a class is short,
    as many more as there were. Of each draw only its sample is kept, and the samples merge into that of all draws at once.
    After ``rounds`` draws RuntimeError names the classes that are still short."""
    held, have, begin, end = None, {}, 0, n
    wanted = {r[0]: r[1] for r in allocated.select(cls, "number_of_pois").collect()}
    for _ in range(rounds):
        new = stratified_sample(draw(begin, end), allocated, cls, seed, key)
        for name, count in new.groupBy(cls).count().collect():
            have[name] = have.get(name, 0) + count
        held = new if held is None else held.unionByName(new)
        short = sorted(str(c) for c, k in wanted.items() if have.get(c, 0) < k)
        if not short:
            return stratified_sample(held, allocated, cls, seed, key)
        begin, end = end, 2 * end
    raise RuntimeError(f"too few points of {', '.join(short)} after {rounds} draws")


def shortages(points: DataFrame, allocated: DataFrame, cls: str) -> DataFrame:
    have = stratify.class_distribution(points, cls)
    joined = allocated.select(cls, "number_of_pois").join(have, cls, "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return joined.filter(F.col("count") < F.col("number_of_pois"))


def sampled_distribution(sample: DataFrame, allocated: DataFrame, cls: str) -> DataFrame:
    """``(class, sampled, wanted)`` side by side, 0 where a side has none."""
    have = stratify.class_distribution(sample, cls).withColumnRenamed("count", "sampled")
    joined = have.join(allocated.select(cls, F.col("number_of_pois").alias("wanted")), cls, "full")
    return joined.select(cls, F.coalesce("sampled", F.lit(0)).alias("sampled"), F.coalesce("wanted", F.lit(0)).alias("wanted"))


