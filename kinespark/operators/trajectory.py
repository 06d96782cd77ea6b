"""Transforms of whole marker trajectories (long rows with x, y, z)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.operators import series


def _replace(df: DataFrame, new: dict) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def rotate(df: DataFrame, axis: str, degrees: float) -> DataFrame:
    """Turn about a coordinate axis."""
    m = G.axis_rotation(axis.lower(), F.radians(F.lit(degrees)))
    return _replace(df, dict(zip("xyz", G.mat_vec(m, [F.col(c) for c in "xyz"]))))


def offset(df: DataFrame, axis: str, value: float) -> DataFrame:
    axis = axis.lower()
    if axis not in ("x", "y", "z"):
        raise ValueError(f"unknown axis {axis!r}")
    return _replace(df, {axis: F.col(axis) + value})


def scale(df: DataFrame, factor: float | Sequence[float], units: str | None = None) -> DataFrame:
    """Scale all axes alike or one by one; ``units`` relabels a units column."""
    f = [float(factor)] * 3 if isinstance(factor, (int, float)) else [float(v) for v in factor]
    if len(f) != 3:
        raise ValueError("one factor or three expected")
    d = _replace(df, {c: F.col(c) * v for c, v in zip("xyz", f)})
    return d.withColumn("units", F.lit(units)) if units is not None else d


def add_noise(df: DataFrame, width: float, seed: int = 0) -> DataFrame:
    """Gaussian noise of standard deviation ``width`` on each coordinate."""
    return _replace(df, {c: F.col(c) + F.randn(seed + i) * width for i, c in enumerate("xyz")})


def to_metres(df: DataFrame, keys: Sequence[str], units: str, large: float = 10.0) -> DataFrame:
    """Millimetres to metres: by the units column, or where it is NULL by the
    trial's largest coordinate."""
    d = series.per_key(df, keys, F.max(F.greatest("x", "y", "z")).alias("_m"))
    u = F.col(units)
    mm = F.coalesce(F.lower(u).contains("mm"), F.col("_m") > large)
    by = F.when(u.isNotNull(), F.lit(0.001))
    new = {c: F.when(mm, F.when(u.isNotNull(), F.col(c) * by).otherwise(F.col(c) / 1000)).otherwise(F.col(c)) for c in "xyz"}
    return _replace(d, new).drop("_m")
