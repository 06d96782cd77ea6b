"""Camera calibrations, extrinsics and model tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.operators.camera import translation_mm

CAMERA_XML = (
    "Geometry struct<_width:string,_height:string,_dpx:string,_dpy:string>, "
    "Intrinsic struct<_focal:string,_sx:string,_cx:string,_cy:string,_kappa1:string>, "
    "Extrinsic struct<_tx:string,_ty:string,_tz:string,_rx:string,_ry:string,_rz:string>"
)

# Accepted field names, best first.
ROTATION_KEYS = ["R", "rotation", "R_fromMocap_toVideo", "matrix", "rotation_matrix"]
TRANSLATION_KEYS = [
    "position_fromMocapOrigin_toVideoOrigin", "t_fromMocap_toVideo", "t", "translation", "camera_center", "C_w",
]


def read_camera_xml(spark: SparkSession, path: str, angles: str = "auto") -> DataFrame:
    """One row per <Camera>: file, K, dist, R, t, width, height."""
    d = spark.read.format("xml").option("rowTag", "Camera").schema(CAMERA_XML).load(path)
    return camera_rows(d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.xml$", 1).alias("file"), "*"), angles)


def camera_rows(d: DataFrame, angles: str = "auto") -> DataFrame:
    """Radial camera attributes to matrices; absent attributes take defaults."""
    g, i, e = "Geometry._", "Intrinsic._", "Extrinsic._"
    wanted = {g + "width": None, g + "height": None, g + "dpx": 1.0, g + "dpy": 1.0, i + "focal": None, i + "sx": 1.0,
              i + "cx": None, i + "cy": None, i + "kappa1": 0.0, **{e + c: None for c in ("tx", "ty", "tz", "rx", "ry", "rz")}}
    short = lambda c: "_" + c.rsplit("_", 1)[1]
    rest = [c for c in d.columns if c not in ("Geometry", "Intrinsic", "Extrinsic")]
    d = d.select(*rest, F.col("Extrinsic").isNotNull().alias("_has"), *[
        F.coalesce(F.col(c).try_cast("double"), F.lit(v).cast("double")).alias(short(c)) for c, v in wanted.items()])
    r = [F.col(c) for c in ("_rx", "_ry", "_rz")]
    if angles in ("auto", "rodrigues"):
        m = G.rodrigues(*r)
    elif angles in ("euler-xyz", "euler-zyx"):
        m = G.euler_matrix(*r, order=angles[-3:])
    else:
        raise ValueError(f"unknown angle convention {angles!r}")
    z, one, has = F.lit(0.0), F.lit(1.0), F.col("_has")
    fx = F.col("_focal") * F.col("_sx") / F.col("_dpx")
    return d.select(
        *rest, F.array(fx, z, F.col("_cx"), z, F.col("_focal") / F.col("_dpy"), F.col("_cy"), z, z, one).alias("K"),
        F.array(F.col("_kappa1"), z, z, z, z).alias("dist"),
        F.when(has, F.array(*m)).alias("R"), F.when(has, F.array("_tx", "_ty", "_tz")).alias("t"),
        F.col("_width").cast("int").alias("width"), F.col("_height").cast("int").alias("height"),
    )


def _flat(s: Column) -> Column:
    """Nested or flat numbers as a flat array."""
    rows = F.flatten(F.from_json(s, "array<array<double>>"))
    flat = F.from_json(s, "array<double>")
    return F.when(F.size(rows) > 0, rows).otherwise(flat)


def normalise_extrinsics(records: DataFrame, column: str = "json") -> DataFrame:
    """Extrinsics from JSON text under any accepted name: adds R (nine values,
    validated) and t_mm. A 4x4 matrix gives its upper left part; metres are
    turned into millimetres by the ``unit`` field, or by magnitude without one."""
    schema = ", ".join(f"{k} string" for k in [*dict.fromkeys([*ROTATION_KEYS, *TRANSLATION_KEYS]), "unit"])
    d = records.withColumn("_j", F.from_json(column, schema))
    mats = []
    for k in ROTATION_KEYS:
        v = _flat(F.col("_j")[k])
        m = F.when(F.size(v) == 16, F.array(*[v[4 * i + j] for i in range(3) for j in range(3)])).when(F.size(v) == 9, v)
        mats.append(m)
    d = d.withColumns({f"_m{i}": m for i, m in enumerate(mats)})
    d = d.withColumn("R", F.coalesce(*[G.valid_rotation(F.col(f"_m{i}")) for i in range(len(mats))]))
    t = F.coalesce(*[F.when(F.size(_flat(F.col("_j")[k])) >= 3, F.slice(_flat(F.col("_j")[k]), 1, 3)) for k in TRANSLATION_KEYS])
    d = d.withColumn("_t", t).withColumn("t_mm", translation_mm(F.col("_t"), F.col("_j.unit")))
    return d.select(*records.columns, "R", "t_mm")


def read_model_markers(spark: SparkSession, path: str) -> DataFrame:
    """Marker table of models: file, marker, parent_frame, location, fixed."""
    schema = "_name string, socket_parent_frame string, location string, fixed boolean"
    d = spark.read.format("xml").option("rowTag", "Marker").schema(schema).load(path)
    loc = F.transform(F.split(F.trim("location"), "\\s+"), lambda s: s.cast("double"))
    return d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.col("_name").alias("marker"),
                    F.col("socket_parent_frame").alias("parent_frame"), loc.alias("location"), "fixed")


def read_tracking_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tracking weights: file, marker, apply, weight."""
    schema = "_name string, apply boolean, weight double"
    d = spark.read.format("xml").option("rowTag", "IKMarkerTask").schema(schema).load(path)
    return d.select(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1).alias("file"), F.col("_name").alias("marker"), "apply", "weight")
