"""Boxes: from keypoints, from detections, and carried from frame to frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.operators import series

BOX = ("x1", "y1", "x2", "y2")


def box_from_range(
    u0: Column, v0: Column, u1: Column, v1: Column, width: int, height: int,
    pad: float = 0.2, min_side: float = 128.0,
) -> list[Column]:
    """Padded box around a point range, at least ``min_side`` wide, clamped."""
    w, h = u1 - u0, v1 - v0
    px = F.greatest(pad * w, (min_side - w) / 2)
    py = F.greatest(pad * h, (min_side - h) / 2)
    return [
        F.greatest(F.lit(0.0), u0 - px), F.greatest(F.lit(0.0), v0 - py),
        F.least(F.lit(width - 1.0), u1 + px), F.least(F.lit(height - 1.0), v1 + py),
    ]


def keypoint_boxes(
    df: DataFrame, keys: Sequence[str], width: int, height: int, pad: float = 0.2, min_side: float = 128.0
) -> DataFrame:
    """One box per group of (u, v) points; incomplete points are ignored."""
    ok = F.col("u").isNotNull() & F.col("v").isNotNull()
    d = df.where(ok).groupBy(*keys).agg(
        F.min("u").alias("_u0"), F.min("v").alias("_v0"), F.max("u").alias("_u1"), F.max("v").alias("_v1")
    )
    box = box_from_range(*[F.col(c) for c in ("_u0", "_v0", "_u1", "_v1")], width, height, pad, min_side)
    return d.select(*keys, *[c.alias(n) for c, n in zip(box, BOX)])


def center_crop(height: Column, width: Column) -> list[Column]:
    """Heuristic person box of an image, a little below its centre."""
    side = F.floor(0.9 * F.least(height, width))
    cx, cy = F.floor(width / 2), F.floor(height * 0.55)
    x1 = F.greatest(F.lit(0), cx - F.floor(side / 2))
    y1 = F.greatest(F.lit(0), cy - F.floor(side * 0.6))
    return [x1, y1, F.least(width - 1, x1 + side), F.least(height - 1, y1 + F.floor(side * 1.2))]


def previous_box(df: DataFrame, keys: Sequence[str], frame: str, box: str, name: str = "prev") -> DataFrame:
    """The last box known before each frame."""
    return series.carry(
        df, keys, [F.col(frame)], series.block_of(frame, series.FRAMES_PER_BLOCK),
        F.col(box), name, inclusive=False,
    )


def pick_detection(dets: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One detection per frame: nearest centre to the previous box, or the
    largest area without one; the first detection wins ties."""
    d = dets.join(previous, list(keys), "left")
    cx, cy = (F.col("x1") + F.col("x2")) * 0.5, (F.col("y1") + F.col("y2")) * 0.5
    pcx = (F.col("prev.x1") + F.col("prev.x2")) * 0.5
    pcy = (F.col("prev.y1") + F.col("prev.y2")) * 0.5
    near = (cx - pcx) * (cx - pcx) + (cy - pcy) * (cy - pcy)
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    cost = F.when(F.col("prev").isNotNull(), near).otherwise(-area)
    w = W.partitionBy(*keys).orderBy(cost, "det")
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*dets.columns)


def usable_detections(dets: DataFrame, threshold: float = 0.3, every: int = 8, frame: str = "frame") -> DataFrame:
    """Person detections above the threshold on scheduled frames."""
    return dets.where(
        (F.col("label") == 0) & (F.col("score") >= threshold) & (F.col(frame) % max(1, every) == 0)
    )
