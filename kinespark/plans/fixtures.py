"""Motion views over the driver's parquet tables, in Spark and as SQL text.

Each view stands for one input of the library (see FIXTURES.md part B). The
``with_views`` helper puts the SQL twins needed by a check in front of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions.dims import BODY20
from kinespark.operators import series

VEC_BLOCK = 200_000
DAY = 86_400.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """trial, vec_id, frame and the vector as doubles."""
    d = table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("trial"),
        "vec_id",
        F.col("embedding").cast("array<double>").alias("e"),
    )
    return series.add_running_index(
        d, ["trial"], ["vec_id"], series.block_of("vec_id", VEC_BLOCK), "frame"
    )


def _points(scale: str = "1000") -> str:
    return (
        f"transform(sequence(0, 19), k -> named_struct('k', k, 'joint', names[k], "
        f"'x', {scale} * e[3*k], 'y', {scale} * e[3*k+1], 'z', {scale} * e[3*k+2]))"
    )


def _names() -> F.Column:
    return F.array(*[F.lit(j) for j in BODY20])


def pose_frames(spark: SparkSession, sf: str) -> DataFrame:
    """F1 in frame layout: trial, frame, t, kp[{k, joint, x, y, z}]."""
    return (
        vectors(spark, sf)
        .withColumn("names", _names())
        .select("trial", "frame", (F.col("frame") / 60.0).alias("t"), F.expr(_points()).alias("kp"))
    )


def pose_long(spark: SparkSession, sf: str) -> DataFrame:
    """trial, frame, t, k, joint, x, y, z."""
    return pose_frames(spark, sf).select("trial", "frame", "t", F.inline("kp"))


def reference_exact(spark: SparkSession, sf: str) -> DataFrame:
    """F1 plus (rx, ry, rz) under a known similarity."""
    s = 1 + F.col("trial") / 10.0
    up = F.col("trial") + 1
    return pose_long(spark, sf).select(
        "*",
        (s * -F.col("y") + 10 * up).alias("rx"),
        (s * F.col("x") + 20 * up).alias("ry"),
        (s * F.col("z") + 30 * up).alias("rz"),
    )


def reference_near(spark: SparkSession, sf: str) -> DataFrame:
    """F1 plus a slightly different reference; last frame missing."""
    d = series.shift(pose_frames(spark, sf), ["trial"], "frame", {"nxt": "kp"}, -1)
    return d.select("trial", "frame", "t", F.posexplode("kp").alias("i", "p"), "nxt").select(
        "trial", "frame", "t", "p.*",
        *[(0.9 * F.col(f"p.{c}") + 0.1 * F.expr(f"nxt[i].{c}")).alias(f"r{c}") for c in "xyz"],
    )


PERSON = (
    "struct<mean_score:double,keypoint_scores:array<double>,keypoints_px:array<array<double>>,"
    "keypoints_xyz:array<array<double>>>"
)


def person_rows(spark: SparkSession, sf: str) -> DataFrame:
    """F4 in rows: trial, frame, person, mean_score, e."""
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("long").alias("trial"),
        F.expr("vec_id div 3").alias("frame"),
        (F.col("vec_id") % 3).alias("person"),
        (0.5 + F.col("embedding")[60].cast("double")).alias("mean_score"),
        F.col("embedding").cast("array<double>").alias("e"),
    )


def persons(spark: SparkSession, sf: str) -> DataFrame:
    """F4 in frame layout: trial_id, subset, frame_index, time_sec, persons[]."""
    xyz = "transform(sequence(0,19), k -> array(1000*e[3*k], 1000*e[3*k+1], 1000*e[3*k+2]))"
    px = "transform(sequence(0,19), k -> array(480+400*e[3*k], 270+400*e[3*k+1]))"
    sc = "transform(sequence(0,19), k -> 0.5 + e[40+k])"
    return (
        person_rows(spark, sf)
        .groupBy("trial", "frame")
        .agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "person",
                        F.expr(
                            f"named_struct('mean_score', mean_score, 'keypoint_scores', {sc}, "
                            f"'keypoints_px', {px}, 'keypoints_xyz', {xyz})"
                        ).alias("p"),
                    )
                )
            ).alias("ps")
        )
        .select(
            F.col("trial").cast("string").alias("trial_id"),
            F.when(F.col("trial") % 2 == 0, "healthy").otherwise("pathological").alias("subset"),
            F.col("frame").alias("frame_index"),
            (F.col("frame") / 60.0).alias("time_sec"),
            F.col("ps.p").alias("persons"),
        )
    )


def pixels(spark: SparkSession, sf: str) -> DataFrame:
    """trial, frame, k, joint, u, v."""
    return pose_long(spark, sf).select(
        "trial", "frame", "k", "joint",
        (480 + 0.4 * F.col("x")).alias("u"), (270 + 0.4 * F.col("y")).alias("v"),
        "x", "y", "z",
    )


def irregular(spark: SparkSession, sf: str) -> DataFrame:
    """trial, marker, t, x (NULL now and then)."""
    d = table(spark, sf, "events").select(
        F.col("user_id").alias("trial"), F.col("event_type").alias("marker"), "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value").cast("double").alias("value"),
    )
    return series.per_key(d, ["trial"], F.min("us").alias("us0")).select(
        "trial", "marker", "event_id",
        ((F.col("us") - F.col("us0")) / 1e6).alias("t"),
        F.when(F.col("event_id") % 10 != 0, F.col("value")).alias("x"),
    )


def markers_big(spark: SparkSession, sf: str) -> DataFrame:
    """F8: trial, marker, frame, x, y, z from lineitem."""
    d = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("trial"), F.col("l_linenumber").alias("marker"),
        "l_orderkey", "l_partkey", "l_extendedprice",
        F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"),
        F.col("l_discount").alias("z"),
    )
    d = series.add_running_index(
        d, ["trial", "marker"], ["l_orderkey", "l_partkey", "l_extendedprice"],
        series.block_of("l_orderkey", 1_000_000), "frame",
    )
    return d.select("trial", "marker", "frame", "x", "y", "z")


def markers_still(spark: SparkSession, sf: str) -> DataFrame:
    """F8 nearly motionless in frames 20 to 40."""
    m = F.when(F.col("frame").between(20, 40), 0.001).otherwise(1.0)
    return markers_big(spark, sf).select(
        "trial", "marker", "frame", *[(F.col(c) * m).alias(c) for c in "xyz"]
    )


def subjects_raw(spark: SparkSession, sf: str) -> DataFrame:
    """free-form session metadata, flat or nested under ``participant``."""
    d = table(spark, sf, "customer").select("c_custkey")
    cm = "cast(150 + c_custkey % 50 as string)"
    return d.select(
        F.col("c_custkey").alias("subject"),
        F.expr(
            f"""CASE c_custkey % 4
                WHEN 0 THEN concat('1.', cast(50 + c_custkey % 50 as string), ' m')
                WHEN 1 THEN concat({cm}, ' cm')
                WHEN 2 THEN concat({cm}, '0mm')
                ELSE {cm} END"""
        ).alias("height_raw"),
        F.expr(
            """CASE c_custkey % 3 WHEN 0 THEN concat(cast(50 + c_custkey % 60 as string), ' kg')
               WHEN 1 THEN concat(cast(50 + c_custkey % 60 as string), '000 g')
               ELSE cast(50 + c_custkey % 60 as string) END"""
        ).alias("mass_raw"),
        F.expr("CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN ' Woman' WHEN 2 THEN 'female' "
               "WHEN 3 THEN 'MAN' ELSE 'Other' END").alias("sex_raw"),
    )


def session_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """F9 wrapped: subject, meta (map), nested (map of maps)."""
    d = subjects_raw(spark, sf)
    body = F.create_map(
        F.lit("Height (m)"), F.col("height_raw"), F.lit("body-weight"), F.col("mass_raw"),
        F.lit("Gender"), F.col("sex_raw"),
    )
    nested = F.col("subject") % 2 == 1
    return d.select(
        "subject",
        F.when(nested, F.create_map(F.lit("note"), F.lit("see participant"))).otherwise(body).alias("meta"),
        F.when(nested, F.create_map(F.lit("participant"), body)).alias("nested"),
    )


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """one manifest per region, its nations as trials."""
    n = table(spark, sf, "nation")
    trial = F.struct(
        F.col("n_name").alias("id"),
        F.concat(F.lit("${paths.root}/mocap/"), F.col("n_name"), F.lit(".trc")).alias("mocap_trc"),
        F.concat(F.lit("${paths.root}/video/"), F.lower("n_name"), F.lit(".avi")).alias("video_sync"),
    )
    subset = F.when(F.col("n_nationkey") % 2 == 0, "healthy").otherwise("pathological")
    subsets = (
        n.select("n_regionkey", "n_nationkey", subset.alias("subset"), trial.alias("trial"))
        .groupBy("n_regionkey", "subset")
        .agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "trial"))).alias("ts"))
        .select("n_regionkey", F.struct("subset", F.col("ts.trial").alias("trials")).alias("s"))
        .groupBy("n_regionkey")
        .agg(F.map_from_entries(F.array_sort(F.collect_list("s"))).alias("trials"))
    )
    r = table(spark, sf, "region")
    return subsets.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("subject"), F.col("r_regionkey")).alias("subject_id"),
        F.lit("Session1").alias("session"),
        F.concat(F.lit("Cam"), F.col("r_regionkey") % 2).alias("camera"),
        F.when(F.col("r_regionkey") % 2 == 0, "auto").otherwise("59.94").alias("fps_video"),
        F.concat(F.lit("${datasets.root_a}/"), F.col("r_name")).alias("root"),
        F.when(F.col("r_regionkey") % 2 == 0, F.lit("${paths.root}/output")).alias("output_dir"),
        F.lit("${paths.root}/calibration.json").alias("calibration"),
        "trials",
    )


def manifest_vars(spark: SparkSession, sf: str) -> DataFrame:
    """Path variables; the roots are read from the data so that they vary."""
    return table(spark, sf, "region").agg(F.count(F.lit(1)).alias("n")).select(
        F.explode(
            F.array(
                F.struct(F.lit("datasets.root_a").alias("name"),
                         F.concat(F.lit("/data/a"), F.col("n")).alias("value")),
                F.struct(F.lit("outputs_root").alias("name"), F.lit("/out").alias("value")),
            )
        ).alias("v")
    ).select("v.*")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """two boxes per frame around each person: trial, frame, det, x1, y1, x2, y2, score, label."""
    d = person_rows(spark, sf)
    us = F.expr("transform(sequence(0,19), k -> 480+400*e[3*k])")
    vs = F.expr("transform(sequence(0,19), k -> 270+400*e[3*k+1])")
    d = d.select(
        "trial", "frame", "person", F.array_min(us).alias("u0"), F.array_max(us).alias("u1"),
        F.array_min(vs).alias("v0"), F.array_max(vs).alias("v1"),
        (0.5 + F.col("e")[61]).alias("score"), (F.col("frame") % 2).alias("label"),
    )
    box = lambda i, dx: F.struct(
        (F.col("person") * 2 + i).cast("long").alias("det"),
        (F.col("u0") + dx).alias("x1"), F.col("v0").alias("y1"),
        (F.col("u1") + dx * 0.5).alias("x2"), F.col("v1").alias("y2"),
    )
    return d.select(
        "trial", "frame", "score", "label", F.inline(F.array(box(0, -40.0), box(1, 40.0)))
    )


# --------------------------------------------------------------------- SQL twins

_J20 = ", ".join(f"({i},'{j}')" for i, j in enumerate(BODY20))

VIEWS: dict[str, tuple[list[str], str]] = {
    "joints20": ([], f"SELECT * FROM (VALUES {_J20}) AS j(k, joint)"),
    "vec": (
        [],
        "SELECT label::BIGINT AS trial, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, "
        "list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings",
    ),
    "f1": (
        ["vec", "joints20"],
        "SELECT trial, frame, frame/60.0 AS t, k, joint, 1000*e[3*k+1] AS x, 1000*e[3*k+2] AS y, 1000*e[3*k+3] AS z "
        "FROM vec, joints20",
    ),
    "f2": (
        ["f1"],
        "SELECT *, (1+trial/10.0)*(-y)+10*(trial+1) AS rx, (1+trial/10.0)*x+20*(trial+1) AS ry, "
        "(1+trial/10.0)*z+30*(trial+1) AS rz FROM f1",
    ),
    "f3": (
        ["f1"],
        "SELECT *, 0.9::DOUBLE*x+0.1::DOUBLE*lead(x) OVER w AS rx, 0.9::DOUBLE*y+0.1::DOUBLE*lead(y) OVER w AS ry, "
        "0.9::DOUBLE*z+0.1::DOUBLE*lead(z) OVER w AS rz FROM f1 WINDOW w AS (PARTITION BY trial, k ORDER BY frame)",
    ),
    "f4": (
        [],
        "SELECT label::BIGINT AS trial, vec_id // 3 AS frame, vec_id % 3 AS person, 0.5+embedding[61]::DOUBLE AS mean_score, "
        "list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings",
    ),
    # idx = position of the person inside the frame's list
    "f4i": (
        ["f4"],
        "SELECT *, row_number() OVER (PARTITION BY trial, frame ORDER BY person) - 1 AS idx, "
        "count(*) OVER (PARTITION BY trial, frame) AS n_persons FROM f4",
    ),
    "f5": (
        ["f1"],
        "SELECT trial, frame, k, joint, 480+0.4::DOUBLE*x AS u, 270+0.4::DOUBLE*y AS v, x, y, z FROM f1",
    ),
    "f6": (
        [],
        "SELECT user_id AS trial, event_type AS marker, event_id, "
        "(epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, "
        "CASE WHEN event_id % 10 <> 0 THEN value::DOUBLE END AS x FROM events",
    ),
    "f8": (
        [],
        "SELECT l_suppkey AS trial, l_linenumber AS marker, row_number() OVER (PARTITION BY l_suppkey, l_linenumber "
        "ORDER BY l_orderkey, l_partkey, l_extendedprice) - 1 AS frame, l_quantity AS x, l_extendedprice/1000 AS y, "
        "l_discount AS z FROM lineitem",
    ),
    "f12": (
        ["f8"],
        "SELECT trial, marker, frame, x*m AS x, y*m AS y, z*m AS z FROM (SELECT *, CASE WHEN frame BETWEEN 20 AND 40 "
        "THEN 0.001::DOUBLE ELSE 1.0::DOUBLE END AS m FROM f8)",
    ),
    "f9": (
        [],
        "SELECT c_custkey AS subject, CASE c_custkey % 4 WHEN 0 THEN concat('1.', 50 + c_custkey % 50, ' m') "
        "WHEN 1 THEN concat(150 + c_custkey % 50, ' cm') WHEN 2 THEN concat(150 + c_custkey % 50, '0mm') "
        "ELSE (150 + c_custkey % 50)::VARCHAR END AS height_raw, "
        "CASE c_custkey % 3 WHEN 0 THEN concat(50 + c_custkey % 60, ' kg') WHEN 1 THEN concat(50 + c_custkey % 60, '000 g') "
        "ELSE (50 + c_custkey % 60)::VARCHAR END AS mass_raw, "
        "CASE c_custkey % 5 WHEN 0 THEN 'M' WHEN 1 THEN ' Woman' WHEN 2 THEN 'female' WHEN 3 THEN 'MAN' ELSE 'Other' END AS sex_raw "
        "FROM customer",
    ),
    "f10": (
        [],
        "SELECT concat('subject', r_regionkey) AS subject_id, 'Session1' AS session, concat('Cam', r_regionkey % 2) AS camera, "
        "CASE WHEN r_regionkey % 2 = 0 THEN 'auto' ELSE '59.94' END AS fps_video, "
        "concat('/data/a', (SELECT count(*) FROM region), '/', r_name) AS root, "
        "CASE WHEN n_nationkey % 2 = 0 THEN 'healthy' ELSE 'pathological' END AS subset, n_name AS id, n_nationkey, r_regionkey "
        "FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "f11": (
        ["f4"],
        "SELECT trial, frame, 0.5+e[62] AS score, frame % 2 AS label, person*2+b.det AS det, u0+dx AS x1, v0 AS y1, u1+dx*0.5 AS x2, v1 AS y2 "
        "FROM (SELECT *, list_min(us) u0, list_max(us) u1, list_min(vs) v0, list_max(vs) v1 FROM (SELECT *, "
        "list_transform(range(20), lambda k: 480+400*e[3*k+1]) us, list_transform(range(20), lambda k: 270+400*e[3*k+2]) vs "
        "FROM f4)), (VALUES (0::BIGINT, -40.0::DOUBLE), (1, 40.0)) AS b(det, dx)",
    ),
}


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the WITH list of the views it needs."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in VIEWS[n][0]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({VIEWS[n][1]})" for n in order)
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
