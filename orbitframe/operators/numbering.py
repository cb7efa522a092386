"""Consecutive numbers over a whole table, without a window over all of its rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a table is numbered in, and rows that their limits are taken from; limits move work, never numbers.
RANGES, SAMPLED = 256, 4096


def _unused(df: DataFrame, *names: str) -> list[str]:
    """Each name with underscores added until no column of ``df`` has it."""
    out = []
    for name in names:
        while name in df.columns:
            name += "_"
        out.append(name)
    return out


def _dealt(df: DataFrame, order_by: tuple[str, ...], hashed: str, at: str) -> tuple[DataFrame, list[str]]:
    columns = [f.name for f in df.schema if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    marked, keys = df.withColumn(hashed, F.xxhash64(*columns)), [*order_by, hashed]
    share = min(1.0, SAMPLED / max(1, df.count()))
    known = marked.select(*keys).sample(share, 7).limit(2 * SAMPLED).orderBy(*[F.col(k).asc_nulls_first() for k in keys]).collect()
    limits = known[:: max(1, -(-len(known) // (RANGES - 1)))]
    place = F.lit(0)
    if limits:
        table = F.array(*[F.struct(*[F.lit(v).cast(marked.schema[k].dataType).alias(k) for k, v in zip(keys, row, strict=True)]) for row in limits])
        place = F.size(F.filter(table, lambda b: b <= F.struct(*[F.col(k) for k in keys])))
    return marked.withColumn(at, place), keys


def ranges(df: DataFrame, *order_by: str) -> DataFrame:
    """Add, as the last column, the range that a row lies in, by the columns of ``order_by`` and then a hash of all columns, so that rows
    that are equal in the order are spread too. Limits come from ``SAMPLED`` rows; null comes first."""
    hashed, at = _unused(df, "_hash", "_range")
    return _dealt(df, order_by, hashed, at)[0].drop(hashed)


def numbered(df: DataFrame, name: str, *order_by: str) -> DataFrame:
    """Add ``name``: 1, 2, ... in the order of ``order_by``, nulls first, rows that are equal there in the order of a hash of all
    columns but maps. Rows are numbered within ranges; the ranges' counts, ``RANGES`` rows at most, are added up and joined."""
    hashed, at, start, place = _unused(df, "_hash", "_range", "_start", "_place")
    placed, keys = _dealt(df, order_by, hashed, at)
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(at).agg(F.count(F.lit(1)).alias(place))
    starts = counts.select(at, F.coalesce(F.sum(place).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(at).orderBy(*[F.col(c).asc_nulls_first() for c in keys])
    out = placed.withColumn(place, F.row_number().over(within)).join(F.broadcast(starts), at)
    return out.withColumn(name, F.col(start) + F.col(place)).select(*[c for c in df.columns if c != name], name)
