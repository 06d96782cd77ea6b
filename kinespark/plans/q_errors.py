"""Queries: centring, error metrics and alignment."""

from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.functions.dims import literal_table
from kinespark.operators import align, errors, frames
from kinespark.plans import fixtures as X
from kinespark.plans.registry import query, r6

X.VIEWS["f3p"] = (
    ["f3"],
    "SELECT trial, frame, " + ", ".join(
        f"(max({c}) FILTER (joint='left_hip') + max({c}) FILTER (joint='right_hip'))*0.5 AS p{c}"
        for c in ("x", "y", "z", "rx", "ry", "rz")
    ) + " FROM f3 GROUP BY trial, frame",
)
X.VIEWS["f3c"] = (
    ["f3", "f3p"],
    "SELECT f3.trial, f3.frame, t, k, joint, "
    + ", ".join(f"{c}-p{c} AS {c}" for c in ("x", "y", "z", "rx", "ry", "rz"))
    + " FROM f3 JOIN f3p USING (trial, frame)",
)
X.VIEWS["f3d"] = (["f3c"], "SELECT *, sqrt((x-rx)*(x-rx)+(y-ry)*(y-ry)+(z-rz)*(z-rz)) AS d FROM f3c")

SIDES = (("x", "y", "z"), ("rx", "ry", "rz"))


def centered(spark, sf):
    return frames.center_on_pelvis(X.reference_near(spark, sf), ["trial", "frame"], SIDES)


def scored(spark, sf):
    return errors.with_error(centered(spark, sf))


@query("agg_8_center_pelvis", ["f3c"],
       "SELECT trial, frame, joint, round(x,6) x, round(y,6) y, round(z,6) z, round(rx,6) rx FROM f3c")
def _(spark, sf):
    return centered(spark, sf).select("trial", "frame", "joint", r6("x"), r6("y"), r6("z"), r6("rx"))


@query("agg_8_center_pelvis_keep", ["f3c", "f3"],
       "SELECT trial, frame, joint, round(CASE WHEN frame%7=0 THEN f3.x ELSE f3c.x END,6) x FROM f3 JOIN f3c USING (trial, frame, joint)"
       " WHERE NOT (frame%7=0 AND joint='left_hip')")
def _(spark, sf):
    d = X.pose_long(spark, sf).where("NOT (frame % 7 = 0 AND joint = 'left_hip')")
    return frames.center_on_pelvis(d, ["trial", "frame"], when_missing="keep").select(
        "trial", "frame", "joint", r6("x"))


@query("agg_9_center_centroid", ["f1"],
       "SELECT trial, frame, joint, round(x-avg(x) OVER w,6) x, round(y-avg(y) OVER w,6) y, round(z-avg(z) OVER w,6) z "
       "FROM f1 WINDOW w AS (PARTITION BY trial, frame)")
def _(spark, sf):
    return frames.center_on_centroid(X.pose_long(spark, sf), ["trial", "frame"]).select(
        "trial", "frame", "joint", r6("x"), r6("y"), r6("z"))


@query("jon_8_pair_frames", ["f3"],
       "SELECT trial, frame, k, round(x,6)+0.0 x, round(rx,6)+0.0 rx FROM f3")
def _(spark, sf):
    ref = X.reference_near(spark, sf).select("trial", "frame", "joint", F.col("rx").alias("x"),
                                             F.col("ry").alias("y"), F.col("rz").alias("z"))
    return errors.pair_frames(X.pose_long(spark, sf), ref, ["trial", "frame", "joint"]).select(
        "trial", "frame", F.col("k").cast("long").alias("k"), r6("x"), r6("rx"))


@query("agg_10_mpjpe_micro", ["f3d"],
       "SELECT trial, count(d) n, round(avg(d),6) mpjpe FROM f3d GROUP BY trial")
def _(spark, sf):
    return errors.overall_micro(scored(spark, sf), ["trial"]).select("trial", "n", r6("mpjpe"))


@query("agg_11_joint_error", ["f3d"],
       "SELECT trial, joint, count(d) n, round(avg(d),6) mpjpe, round(sqrt(avg(d*d)),6) rmse FROM f3d GROUP BY trial, joint")
def _(spark, sf):
    return errors.per_joint(scored(spark, sf), ["trial"]).select("trial", "joint", "n", r6("mpjpe"), r6("rmse"))


@query("agg_11_joint_error_big", ["f8"],
       "SELECT trial, marker, count(*) n, round(avg(d),6) mpjpe, round(sqrt(avg(d*d)),6) rmse FROM "
       "(SELECT trial, marker, sqrt((x-y)*(x-y)+(y-z)*(y-z)+(z-x)*(z-x)) d FROM f8) GROUP BY ALL")
def _(spark, sf):
    d = X.markers_big(spark, sf).select("trial", F.col("marker").alias("joint"), "x", "y", "z",
                                        F.col("y").alias("rx"), F.col("z").alias("ry"), F.col("x").alias("rz"))
    return errors.per_joint(errors.with_error(d), ["trial"]).select(
        "trial", F.col("joint").alias("marker"), "n", r6("mpjpe"), r6("rmse"))


@query("agg_12_rmse", ["f3d"], "SELECT trial, round(sqrt(avg(d*d)),6) rmse FROM f3d GROUP BY trial")
def _(spark, sf):
    return errors.overall_micro(scored(spark, sf), ["trial"]).select("trial", r6("rmse"))


@query("agg_13_mpjpe_macro", ["f3d"],
       "SELECT trial, count(m) n_frames, round(avg(m),6) mpjpe FROM (SELECT trial, frame, avg(d) m FROM f3d "
       "WHERE (frame + k) % 3 <> 0 GROUP BY trial, frame) GROUP BY trial")
def _(spark, sf):
    d = scored(spark, sf).where("(frame + k) % 3 <> 0")
    return errors.overall_macro(d, ["trial"]).select("trial", "n_frames", r6("mpjpe"))


@query("agg_14_report_two_grains", ["f3d"],
       "SELECT trial, joint, count(d) n, round(avg(d),6) mpjpe, round(sqrt(avg(d*d)),6) rmse FROM f3d "
       "GROUP BY GROUPING SETS ((trial, joint), (trial))")
def _(spark, sf):
    return errors.two_grains(scored(spark, sf)).select("trial", "joint", "n", r6("mpjpe"), r6("rmse"))


@query("top_4_joints_sorted", ["f3d"],
       "SELECT joint, round(avg(d),6) mpjpe FROM f3d GROUP BY joint ORDER BY joint")
def _(spark, sf):
    return errors.overall_micro(scored(spark, sf), ["joint"]).select("joint", r6("mpjpe")).orderBy("joint")


@query("flt_15_complete_frames", ["f3c"],
       "SELECT trial, count(DISTINCT frame) frames, count(*) n FROM f3c WHERE (trial, frame) IN "
       "(SELECT (trial, frame) FROM f3c WHERE x IS NOT NULL AND rx IS NOT NULL GROUP BY trial, frame HAVING count(*)=20) GROUP BY trial")
def _(spark, sf):
    d = errors.complete_frames(centered(spark, sf), ["trial", "frame"], 20, ["x", "y", "z", "rx", "ry", "rz"])
    per = d.groupBy("trial", "frame").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("trial").agg(F.count(F.lit(1)).alias("frames"), F.sum("c").alias("n"))


_F2_ANSWER = (
    "SELECT trial::BIGINT trial, 0.0::DOUBLE r00, -1.0::DOUBLE r01, 1.0::DOUBLE r10, 0.0::DOUBLE r11, 1.0::DOUBLE r22, "
    "{s} AS s, {t} FROM (SELECT DISTINCT trial, rank() OVER () r FROM f1)"
)


def _rot_cols():
    return [r6(F.col("R")[i], n) for n, i in (("r00", 0), ("r01", 1), ("r10", 3), ("r11", 4), ("r22", 8))]


@query("agg_15_rotation_fit", ["f1"],
       "SELECT DISTINCT trial, 0.0::DOUBLE r00, -1.0::DOUBLE r01, 1.0::DOUBLE r10, 0.0::DOUBLE r11, 1.0::DOUBLE r22 FROM f1")
def _(spark, sf):
    return align.fit(X.reference_exact(spark, sf), ["trial"]).select("trial", *_rot_cols())


@query("agg_16_similarity_fit", ["f1"],
       "SELECT trial, count(*) n, 0.0::DOUBLE r00, -1.0::DOUBLE r01, 1.0::DOUBLE r10, 0.0::DOUBLE r11, 1.0::DOUBLE r22, "
       "round(1+trial/10.0,6) s, 10.0::DOUBLE*(trial+1) tx, 20.0::DOUBLE*(trial+1) ty, 30.0::DOUBLE*(trial+1) tz FROM f1 GROUP BY trial")
def _(spark, sf):
    f = align.fit(X.reference_exact(spark, sf), ["trial"], "similarity")
    return f.select("trial", "n", *_rot_cols(), r6("s"),
                    *[r6(F.col("tr")[i], n) for i, n in enumerate(("tx", "ty", "tz"))])


@query("agg_16_similarity_fit_big", ["f8"],
       "SELECT trial, marker, count(*) n, CASE WHEN count(*)<3 THEN 1.0::DOUBLE ELSE 2.5::DOUBLE END s FROM f8 GROUP BY ALL")
def _(spark, sf):
    d = X.markers_big(spark, sf).select("trial", "marker", "x", "y", "z", (-2.5 * F.col("z") + 3).alias("rx"),
                                        (2.5 * F.col("y")).alias("ry"), (2.5 * F.col("x") - 7).alias("rz"))
    return align.fit(d, ["trial", "marker"], "similarity").select("trial", "marker", "n", r6("s"))


@query("agg_17_frame_procrustes", ["f1"],
       "SELECT trial, frame, count(*) n, 0.0::DOUBLE r00, -1.0::DOUBLE r01, 1.0::DOUBLE r10, 0.0::DOUBLE r11, 1.0::DOUBLE r22, "
       "round(1+trial/10.0,6) s, 0.0::DOUBLE err FROM f1 GROUP BY trial, frame")
def _(spark, sf):
    d = X.reference_exact(spark, sf)
    f = align.fit(d, ["trial", "frame"], "similarity")
    e = errors.with_error(align.apply_fit(d, f, ["trial", "frame"]), ("ax", "ay", "az"))
    e = e.groupBy("trial", "frame").agg(F.avg("d").alias("err"))
    return f.join(e, ["trial", "frame"]).select("trial", "frame", "n", *_rot_cols(), r6("s"), r6("err"))


@query("agg_18_similarity_2d", ["f5"],
       """SELECT trial, frame, count(*) n,
          round(sqrt(c00*c00+c01*c01+c10*c10+c11*c11+2*abs(c00*c11-c01*c10))/(v+1e-12),6) s, round(atan2(c01-c10,c00+c11),6) theta FROM
          (SELECT trial, frame, covar_pop(x,u) OVER w c00, covar_pop(x,v) OVER w c01, covar_pop(y,u) OVER w c10, covar_pop(y,v) OVER w c11,
           var_pop(x) OVER w + var_pop(y) OVER w v FROM (SELECT trial, frame, x, y, u+0.2::DOUBLE*y AS u, v-0.3::DOUBLE*z AS v FROM f5)
           WINDOW w AS (PARTITION BY trial, frame)) GROUP BY trial, frame, c00, c01, c10, c11, v""")
def _(spark, sf):
    d = X.pixels(spark, sf).withColumn("u", F.col("u") + 0.2 * F.col("y")).withColumn("v", F.col("v") - 0.3 * F.col("z"))
    return align.similarity_2d(d, ["trial", "frame"]).select("trial", "frame", "n", r6("s"), r6("theta"))


@query("agg_18_similarity_2d_applied", ["f5"],
       "SELECT trial, frame, joint, round(u,6) pu, round(v,6) pv FROM f5")
def _(spark, sf):
    d = X.pixels(spark, sf)
    f = align.similarity_2d(d, ["trial", "frame"])
    return align.apply_similarity_2d(d, f, ["trial", "frame"]).select("trial", "frame", "joint", r6("pu"), r6("pv"))


@query("agg_19_affine_fit", ["f5"],
       "SELECT trial, frame, count(*) n, 0.4::DOUBLE m00, 0.1::DOUBLE m20, 480.0::DOUBLE m30, 0.4::DOUBLE m11, 270.0::DOUBLE m31 "
       "FROM f5 GROUP BY trial, frame")
def _(spark, sf):
    d = X.pixels(spark, sf).withColumn("u", F.col("u") + 0.1 * F.col("z"))
    m = F.col("M")
    return align.affine_3d_to_2d(d, ["trial", "frame"]).select(
        "trial", "frame", "n", r6(m[0], "m00"), r6(m[4], "m20"), r6(m[6], "m30"), r6(m[3], "m11"), r6(m[7], "m31"))


@query("agg_20_principal_axis", ["f1"],
       "SELECT trial, frame, round(0.5::DOUBLE*atan2(2*covar_pop(x,y), var_pop(x)-var_pop(y)),6) angle FROM f1 GROUP BY trial, frame")
def _(spark, sf):
    from kinespark.operators import overlay
    return overlay.principal_angle(X.pose_long(spark, sf), ["trial", "frame"]).select("trial", "frame", r6("angle"))


@query("sca_12_apply_similarity", ["f2"],
       "SELECT trial, frame, joint, round(rx,6) ax, round(ry,6) ay, round(rz,6) az FROM f2")
def _(spark, sf):
    d = X.reference_exact(spark, sf)
    f = align.fit(d, ["trial"], "similarity")
    return align.apply_fit(d, f, ["trial"]).select("trial", "frame", "joint", r6("ax"), r6("ay"), r6("az"))


@query("udf_4_rotation_aggregate", ["f1"],
       "SELECT trial, marker_set, 1.0::DOUBLE det FROM (SELECT DISTINCT trial, k % 2 AS marker_set FROM f1)")
def _(spark, sf):
    d = X.reference_near(spark, sf).withColumn("marker_set", (F.col("k") % 2).cast("long"))
    f = align.fit(d, ["trial", "marker_set"])
    return f.select("trial", "marker_set", r6(G.det(G.elements(F.col("R"))), "det"))


@query("udf_1_batched_svd", ["f1"],
       "SELECT trial, round(sum(x*x+y*y+z*z) - (pow(sum(x),2)+pow(sum(y),2)+pow(sum(z),2))/count(*), 3) sigma FROM f1 GROUP BY trial")
def _(spark, sf):
    # H of a point set against itself is its scatter matrix: singular values sum to its trace
    d = X.pose_long(spark, sf)
    m = align.co_moments(d, ["trial"], ("x", "y", "z"), ("x", "y", "z"))
    from kinespark.functions.linalg import best_rotation
    return m.select("trial", F.round(best_rotation(F.col("H"))["sigma"], 3).alias("sigma"))


@query("agg_33_weighted_tracking", ["f3d"],
       "SELECT trial, round(sum(w*d*d)/sum(w),6) wmse, count(d) n FROM (SELECT trial, d, CASE WHEN joint LIKE '%hip%' THEN 25 "
       "WHEN joint LIKE '%toe%' THEN 1 ELSE 5 END w FROM f3d WHERE d IS NOT NULL) GROUP BY trial")
def _(spark, sf):
    w = [(j, 25 if "hip" in j else 1 if "toe" in j else 5) for j in X.BODY20]
    return errors.weighted_tracking(scored(spark, sf), literal_table(spark, ["joint", "weight"], w), ["trial"]).select(
        "trial", r6("wmse"), "n")
