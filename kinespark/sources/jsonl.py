"""Frame records as JSON lines: scan, alias-tolerant scan, sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SCHEMA = (
    "trial_id string, subset string, frame_index long, time_sec double, persons array<struct<mean_score:double,"
    "keypoint_scores:array<double>,keypoints_px:array<array<double>>,keypoints_xyz:array<array<double>>>>"
)

# Accepted field names, best first.
PERSON_LISTS = ["persons", "people", "detections", "predictions"]
PERSON_SINGLES = ["person", "prediction"]
POINTS_2D = ["keypoints_px", "keypoints2d", "keypoints_2d", "kpts_px", "kps2d", "pose2d", "pose_2d", "keypoints"]
POINTS_3D = ["keypoints_xyz_mm", "kps3d_mm", "pose3d_mm", "xyz_mm"]
SCORES = ["mean_score", "score", "avg_score", "confidence"]


def read_frames(spark: SparkSession, path: str, schema: str = FRAME_SCHEMA) -> DataFrame:
    """Canonical frames; gzip files are read as they are."""
    return spark.read.schema(schema).json(path)


def write_frames(df: DataFrame, path: str, partition: str | None = "trial_id", compression: str = "gzip") -> None:
    w = df.write.mode("overwrite").option("compression", compression)
    (w.partitionBy(partition) if partition else w).json(path)


def points(v: Column, width: int) -> Column:
    """Points of ``width`` coordinates from a VARIANT in any accepted form: a list of points,
    an object of coordinate lists (x, y, ..) of one length, or a flat list. NULL otherwise."""
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    rows, flat = get("$", "array<array<double>>"), get("$", "array<double>")
    lists = [get(f"$.{c}", "array<double>") for c in "xyz"[:width]]
    same = F.lit(True)
    for one in lists[1:]:
        same = same & (F.size(one) == F.size(lists[0]))
    zipped = F.transform(lists[0], lambda x, i: F.array(x, *[one[i] for one in lists[1:]]))
    cut = F.transform(F.sequence(F.lit(0), (F.size(flat) / width).cast("int") - 1), lambda i: F.slice(flat, i * width + 1, width))
    return F.when(F.forall(rows, lambda p: p.isNotNull() & (F.size(p) == width)), rows).when(same, zipped).when(
        (F.size(flat) > 0) & (F.size(flat) % width == 0), cut)


def read_any_frames(spark: SparkSession, path: str) -> DataFrame:
    """Frames with any of the accepted field names, one row per person:
    trial_id, frame_index, time_sec, person, xy, xyz, mean_score.

    Fields with points are read as VARIANT, in whatever form they come, and taken
    apart by typed paths. Malformed lines are dropped; an absent score is 1."""
    person = "struct<" + ",".join([*(f"{k}:variant" for k in [*POINTS_2D, *POINTS_3D]), *(f"{k}:string" for k in SCORES)]) + ">"
    raw = ", ".join(f"{k} string" for k in [*PERSON_LISTS, *PERSON_SINGLES])
    schema = f"trial_id string, frame_index long, time_sec double, {raw}"
    d = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    lists = [F.from_json(F.col(k), f"array<{person}>") for k in PERSON_LISTS]
    singles = [F.when(F.col(k).isNotNull(), F.array(F.from_json(F.col(k), person))) for k in PERSON_SINGLES]
    d = d.select("trial_id", "frame_index", "time_sec", F.posexplode(F.coalesce(*lists, *singles)).alias("person", "p"))
    p = F.col("p")
    return d.select(
        "trial_id", "frame_index", "time_sec", "person",
        F.coalesce(*[points(p[k], 2) for k in POINTS_2D]).alias("xy"),
        F.coalesce(*[points(p[k], 3) for k in POINTS_3D]).alias("xyz"),
        F.coalesce(*[p[k].try_cast("double") for k in SCORES], F.lit(1.0)).alias("mean_score"),
    )
