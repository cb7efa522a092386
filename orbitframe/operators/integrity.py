"""Checksums, structure and completeness of a dataset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def checksums(files: DataFrame) -> DataFrame:
    """``(path, md5, sha256)`` of ``files(path, content)``."""
    return files.select("path", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def verify_checksums(files: DataFrame, expected: DataFrame) -> DataFrame:
    """``expected(path, sha256)`` -> ``(path, matches)``; a missing file doesn't match."""
    have = checksums(files).select("path", F.col("sha256").alias("have"))
    return expected.join(have, "path", "left").select("path", F.coalesce(F.col("sha256") == F.col("have"), F.lit(False)).alias("matches"))


def all_match(verified: DataFrame) -> DataFrame:
    return verified.agg(F.coalesce(F.bool_and("matches"), F.lit(True)).alias("all_match"))


def verify_structure(metadata: DataFrame, parts: dict[str, DataFrame], key: str = "aoi") -> DataFrame:
    """``(part, aoi)``: areas of the metadata that a part of the dataset lacks."""
    wanted = metadata.select(key).distinct()
    missing = [wanted.join(df.select(key).distinct(), key, "left_anti").select(F.lit(name).alias("part"), key) for name, df in parts.items()]
    return reduce(DataFrame.unionByName, missing)


def verify_downloads(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """``(name, level, expected, found, missing)`` by area and level."""
    keys = ["name", "level"]
    want = manifest.groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    have = inventory.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"))
    found = F.coalesce("found", F.lit(0))
    return want.join(have, keys, "left").select(*keys, "expected", found.alias("found"), (F.col("expected") - found).alias("missing"))


def pending_downloads(manifest: DataFrame, inventory: DataFrame, overwrite: bool = False) -> DataFrame:
    return manifest if overwrite else manifest.join(inventory.select("path"), "path", "left_anti")
