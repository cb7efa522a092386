"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """``edges(u, v)``, two columns of one orderable type -> ``(node, root)`` for every node of an edge, root being
    the smallest node of its component. Self loops and nulls are ignored; no edges give no rows.

    Each round hangs every node under the smallest one it knows; the number of rounds grows with the logarithm of the
    longest path. Minima are combined before the shuffle, so a node of many links costs one row per task."""

    def clean(df):
        return df.filter("u IS NOT NULL AND v IS NOT NULL AND u != v")

    def state(df):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = staged(clean(edges).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = clean(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = staged(clean(small).unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        before, seen = seen, state(now)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
