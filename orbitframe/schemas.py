"""Column checks and shared types."""

from __future__ import annotations

from pyspark.sql import DataFrame

BOUNDS = "struct<lon_min:double,lat_min:double,lon_max:double,lat_max:double>"
RING = "array<struct<lon:double,lat:double>>"
NAME_KEYS = ("poi_id", "poi_name", "id", "name")


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Raise before any job starts if a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
