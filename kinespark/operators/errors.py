"""Position error metrics between predicted (x, y, z) and reference (rx, ry, rz)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions import geometry as G

PRED = ("x", "y", "z")
REF = ("rx", "ry", "rz")


def pair_frames(pred: DataFrame, ref: DataFrame, on: Sequence[str]) -> DataFrame:
    """Predictions beside the reference on trial, grid index and joint. The key
    is the integer grid index; seconds are never compared for equality."""
    ref = ref.select(*on, *[F.col(c).alias(f"r{c}") for c in "xyz"])
    return pred.join(ref, list(on))


def with_error(df: DataFrame, pred: Sequence[str] = PRED, ref: Sequence[str] = REF) -> DataFrame:
    """Add ``d``, the distance; NULL when a coordinate is missing."""
    return df.withColumn("d", G.distance([F.col(c) for c in pred], [F.col(c) for c in ref]))


def complete_frames(df: DataFrame, frame_keys: Sequence[str], n_joints: int, columns: Sequence[str]) -> DataFrame:
    """Keep frames in which all joints are present with every column set."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    good = df.groupBy(*frame_keys).agg(F.count_if(ok).alias("_n")).where(F.col("_n") == n_joints)
    return df.join(good.select(*frame_keys), list(frame_keys), "left_semi")


def overall_micro(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and RMS over every (frame, joint)."""
    return df.groupBy(*keys).agg(
        F.count("d").alias("n"), F.avg("d").alias("mpjpe"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse")
    )


def per_joint(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return overall_micro(df, [*keys, "joint"])


def overall_macro(df: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """Mean over frames of the mean over the frame's available joints."""
    by_frame = df.groupBy(*keys, frame).agg(F.avg("d").alias("m"))
    return by_frame.groupBy(*keys).agg(F.count("m").alias("n_frames"), F.avg("m").alias("mpjpe"))


def two_grains(df: DataFrame, key: str = "trial") -> DataFrame:
    """Per-joint and per-trial rows from one pass (joint is NULL on the latter)."""
    return df.groupingSets([[F.col(key), F.col("joint")], [F.col(key)]], key, "joint").agg(
        F.count("d").alias("n"), F.avg("d").alias("mpjpe"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse")
    )


def weighted_tracking(df: DataFrame, weights: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of weight times squared distance over the sum of weights."""
    d = df.where("d is not null").join(weights, "joint")
    w, sq = F.col("weight"), F.col("d") * F.col("d")
    return d.groupBy(*keys).agg((F.sum(w * sq) / F.sum(w)).alias("wmse"), F.count("d").alias("n"))
