"""Metric scale from subject height."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.operators.frames import point_of
from kinespark.operators.stats import exact_percentiles


def head_foot_distance(kp: str, heads: Sequence[int], feet: Sequence[int]) -> Column:
    """Largest head to foot distance inside one frame's point array; pairs with a
    missing end are skipped. The joint lists are short constants."""
    d = [G.distance(point_of(kp, h), point_of(kp, f)) for h in heads for f in feet]
    return F.greatest(*d) if len(d) > 1 else d[0]


def model_height(df: DataFrame, keys: Sequence[str], distance: str = "d", percentile: float = 95.0) -> DataFrame:
    """Per key: n, ``height_units`` (exact percentile), median and mean distance."""
    q = exact_percentiles(df, keys, distance, {"height_units": percentile / 100.0, "median_units": 0.5})
    return q.join(df.groupBy(*keys).agg(F.avg(distance).alias("mean_units")), list(keys))


def height_scale(model: DataFrame, subjects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``scale`` = subject height / model height, with status and reason rows
    for unusable trials."""
    d = model.join(subjects.select(*keys, "height_mm"), list(keys), "left")
    ok = (F.col("height_units") > 1e-8) & F.col("height_mm").isNotNull()
    return d.withColumn("scale", F.when(ok, F.col("height_mm") / F.col("height_units"))).withColumn(
        "status", F.when(ok, "ok").otherwise("failed")
    ).withColumn(
        "reason",
        F.when(F.col("height_mm").isNull(), "no subject height").when(~ok, "model height is not positive"),
    )


def scale_points(points: Column, s: Column) -> Column:
    """Multiply K triples by a scale."""
    return F.transform(points, lambda p: F.transform(p, lambda c: c * s))
