"""Queries: whole jobs and streaming operators."""

from pyspark.sql import functions as F

from kinespark.functions import dims as D
from kinespark.functions.dims import literal_table
from kinespark.operators import camera, names, quality
from kinespark.plans import fixtures as X
from kinespark.plans import jobs
from kinespark.plans import q_geometry as Q
from kinespark.plans import q_models as M
from kinespark.plans import q_select as S
from kinespark.plans import q_series as T
from kinespark.plans.registry import place, query, r6
from kinespark.session import scratch_path
from kinespark.sources import jsonl, trc
from kinespark.streaming import live


@query("job_1_subject_harmonisation", ["f9"],
       "SELECT subject, CASE WHEN subject%5 IN (0,3) THEN 'male' WHEN subject%5 IN (1,2) THEN 'female' ELSE 'Other' END sex, "
       "round(CASE subject%4 WHEN 0 THEN concat('1.', 50+subject%50)::DOUBLE WHEN 2 THEN (150+subject%50)*10/1000.0 ELSE (150+subject%50)/100.0 END,6) height_m, (50+subject%60)::DOUBLE mass_kg FROM f9")
def _(spark, sf):
    d = jobs.harmonise_subjects(X.session_metadata(spark, sf))
    return d.select("subject", "sex", r6("height_m"), r6("mass_kg"))


def trial_frames(spark, sf):
    """F1 as frames with one person per frame, and a worse second one now and then."""
    d = X.pose_frames(spark, sf)
    xyz = F.transform("kp", lambda p: F.array(p["x"], p["y"], p["z"]))
    person = lambda pts, s: F.struct(pts.alias("keypoints_xyz"), F.lit(s).alias("mean_score"))
    other = F.when(F.col("frame") % 3 == 0, F.array(person(F.transform(xyz, lambda p: F.transform(p, lambda c: c * 3.0)), 0.2)))
    return d.select("trial", "frame", F.concat(F.coalesce(other, F.array().cast("array<struct<keypoints_xyz:array<array<double>>,mean_score:double>>")),
                                               F.array(person(xyz, 0.9))).alias("persons"))


_MID = "SELECT trial, frame, CASE WHEN joint LIKE '%hip' THEN 'midHip' ELSE 'neck' END marker, sum(x)*0.5 x, sum(z)*0.5 z FROM f1 WHERE k IN (2,3,8,9) GROUP BY ALL"


@query("job_2_metric_scaling", ["f1", "sc"],
       f"WITH m AS (SELECT trial, frame, joint marker, x, z FROM f1 WHERE k > 0 UNION ALL {_MID}) SELECT trial, frame, marker, round(x*s,5)+0.0 x, round(z*s,5)+0.0 z FROM m JOIN sc USING (trial)")
def _(spark, sf):
    _, m = jobs.metric_scaling(trial_frames(spark, sf), Q.heights(spark, sf), D.BODY20, ["nose", "neck"],
                               ["left_heel", "right_heel", "left_big_toe", "right_big_toe", "left_small_toe", "right_small_toe", "left_ankle", "right_ankle"])
    return m.select("trial", "frame", "marker", *[(F.round(c, 5) + 0.0).alias(c) for c in "xz"])


def sql_resampled(rate):
    """The metric joints at 100 Hz, averaged over seven samples; trials at 100 Hz or more as they are."""
    grid = ("SELECT trial, marker, i, i/100.0::DOUBLE AS t FROM (SELECT trial, marker, max(t) t1 FROM s WHERE fs < 100 GROUP BY ALL), "
            "LATERAL (SELECT unnest(range(round_even(t1*100.0::DOUBLE,0)::BIGINT+1)) AS i)")
    return (f"WITH s AS (SELECT trial, k AS marker, frame, x*s AS x, {rate} AS fs, frame/({rate}) AS t FROM f1 JOIN sc USING (trial)), g AS ({grid}), "
            f"u AS (SELECT g.trial, g.marker, g.i, {T.sql_lerp()} AS x FROM {T.asof('g', 's')}), a AS ("
            + T.sql_moving_average("SELECT trial, marker, i, x FROM u", 3, "avg(f.x)") + " UNION ALL SELECT trial, marker, frame, x FROM s WHERE fs >= 100), "
            "n AS (SELECT k, any_value(joint) joint FROM f1 GROUP BY k), j AS (SELECT trial, i, joint, x FROM a JOIN n ON k = marker WHERE k > 0 AND x IS NOT NULL) "
            "SELECT trial, i AS frame, joint AS marker, round(x,4)+0.0 x FROM j UNION ALL "
            "SELECT trial, i, CASE WHEN joint LIKE '%t_hip' THEN 'midHip' ELSE 'neck' END, round(avg(x),4)+0.0 FROM j WHERE joint LIKE '%t_hip' OR joint LIKE '%t_shoulder' GROUP BY ALL")


FEET = ["left_heel", "right_heel", "left_big_toe", "right_big_toe", "left_small_toe", "right_small_toe", "left_ankle", "right_ankle"]


def trial_rates(spark, sf, rates=T.RATES, of=None):
    """(trial, rate): a rate per trial."""
    d = (of if of is not None else X.vectors(spark, sf)).select("trial").distinct()
    return d.select("trial", F.element_at(F.array(*[F.lit(r) for r in rates]), (F.col("trial") % 3 + 1).cast("int")).alias("rate"))


@query("job_2_metric_upsampled", ["f1", "sc"], sql_resampled("60.0::DOUBLE"))
def _(spark, sf):
    _, m = jobs.metric_scaling(trial_frames(spark, sf), Q.heights(spark, sf), D.BODY20, ["nose", "neck"], FEET, target_rate=100.0)
    return m.select("trial", "frame", "marker", (F.round("x", 4) + 0.0).alias("x"))


@query("job_2_rate_per_trial", ["f1", "sc"], sql_resampled(T.SQL_RATE))
def _(spark, sf):
    _, m = jobs.metric_scaling(trial_frames(spark, sf), Q.heights(spark, sf), D.BODY20, ["nose", "neck"], FEET, source_rate=trial_rates(spark, sf), target_rate=100.0)
    return m.select("trial", "frame", "marker", (F.round("x", 4) + 0.0).alias("x"))


def placed_points(spark, sf):
    cal = Q.calibrations(spark, sf)
    d = Q.in_camera(spark, sf)
    d = camera.project(d, cal, distortion=False)
    return d.select("trial", "frame", F.lit(0).alias("person"), "k", "x", "y", "z", F.col("pu").alias("u"), F.col("pv").alias("v"),
                    F.when(F.col("k") % 5 == 4, 0.1).otherwise(0.9).alias("score"))


@query("job_3_absolute_placement", ["cam"],
       "SELECT trial, frame, k, round(cx,3)+0.0 cx, round(cz,3)+0.0 cz, round(x,3)+0.0 wx, round(z,3)+0.0 wz, 0.0::DOUBLE rmse_px FROM cam")
def _(spark, sf):
    p = jobs.absolute_placement(placed_points(spark, sf), Q.calibrations(spark, sf), min_score=0.3, undistort="off")
    r3 = lambda c: (F.round(c, 3) + 0.0).alias(c)
    return p.select("trial", "frame", "k", r3("cx"), r3("cz"), r3("wx"), r3("wz"), r6("rmse_px"))


@query("job_3_placement_smoothed")
def _(spark, sf):
    p = jobs.absolute_placement(placed_points(spark, sf), Q.calibrations(spark, sf), min_score=0.3, undistort="auto", ema=0.2)
    return p.groupBy("trial").agg(F.count("wx").alias("n"), F.round(F.avg("rmse_px"), 3).alias("rmse_px"))


@query("job_4_canonicalisation", ["f1", "bf"], Q._CAN.format(af="0"))
def _(spark, sf):
    d = X.pose_frames(spark, sf).withColumn("person", F.lit(0))
    c = jobs.canonicalise(d, Q.SIDES)
    return c.select("trial", "frame", "joint", r6("cx"), r6("bx"), r6("by"), r6("bz"))


def labelled(spark, sf):
    i = literal_table(spark, ["marker", "label"], [(1, "RSHO"), (2, "LSHO"), (3, "lasi"), (4, "LASI"), (5, "RKNE"), (6, "other"), (7, " rank ")])
    return X.markers_big(spark, sf).join(i, "marker").select("trial", "frame", F.col("label").alias("marker"), F.col("marker").alias("pos"), "x", "y", "z")


@query("job_5_mocap_missing_labels", ["f8"],
       "WITH h AS (SELECT DISTINCT trial, CASE marker WHEN 1 THEN 'RSHO' WHEN 2 THEN 'LSHO' WHEN 3 THEN 'LASI' WHEN 4 THEN 'LASI' WHEN 5 THEN 'RKNE' WHEN 7 THEN 'RANK' END l FROM f8) "
       f"SELECT trial, label FROM (SELECT DISTINCT trial FROM f8), {S.values([(k,) for k in D.MOCAP_KEEP], 'k', ['label'])} WHERE (trial, label) NOT IN (SELECT (trial, l) FROM h WHERE l IS NOT NULL)")
def _(spark, sf):
    return jobs.missing_labels(labelled(spark, sf).select("trial", "pos", "marker").distinct(), D.MOCAP_KEEP).select("trial", "label")


def sql_mocap(rate, cutoffs):
    src = " UNION ALL ".join(f"SELECT trial, marker, '{c}' c, frame i, {c} v, {rate} fs FROM f8 WHERE marker IN (1, 2, 3, 4, 5, 7)" for c in "xyz")
    # of two labels that differ in case the first column stays
    chosen = "(SELECT * FROM (" + src + ") WHERE marker <> 4 OR trial NOT IN (SELECT trial FROM f8 WHERE marker = 3))"
    name = "CASE marker WHEN 1 THEN 'RSHO' WHEN 2 THEN 'LSHO' WHEN 3 THEN 'LASI' WHEN 4 THEN 'LASI' WHEN 5 THEN 'RKNE' ELSE 'RANK' END"
    inner = T.sql_downsampled("SELECT * FROM " + chosen, cutoffs, 100.0)
    return (f"SELECT trial, i AS frame, round(t,6) t, {name} AS marker, " + ", ".join(f"round(max(y) FILTER (c='{c}'),4)+0.0 {c}" for c in "xyz") + f" FROM ({inner}) GROUP BY ALL")


@query("job_5_mocap_downsample", ["f8"], sql_mocap("250.0::DOUBLE", {250.0: 6.0}))
def _(spark, sf):
    d = labelled(spark, sf)
    m, _ = jobs.downsample_mocap(d, d.select("trial", "pos", "marker").distinct(), D.MOCAP_KEEP, 250.0, 100.0)
    return m.select("trial", "frame", r6("t"), "marker", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


@query("job_5_rate_per_trial", ["f8"], sql_mocap(T.SQL_RATE, {r: 6.0 for r in T.RATES}))
def _(spark, sf):
    d = labelled(spark, sf)
    m, _ = jobs.downsample_mocap(d, d.select("trial", "pos", "marker").distinct(), D.MOCAP_KEEP, trial_rates(spark, sf, of=d), 100.0)
    return m.select("trial", "frame", r6("t"), "marker", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


def exact_pair(spark, sf):
    d = X.reference_exact(spark, sf)
    pred = d.select("trial", "t", "joint", "x", "y", "z")
    return pred, d.select("trial", "t", "joint", *[F.col(f"r{c}").alias(c) for c in "xyz"])


@query("job_6_trial_accuracy", ["f1"],
       "SELECT trial, ceil((count(DISTINCT frame)-1)/60.0*100 - 1e-9)::BIGINT n_frames, round(1+trial/10.0,6) s, 0.0::DOUBLE r00, -1.0::DOUBLE r01, 0.0::DOUBLE pa_mpjpe, 'ok' status FROM f1 GROUP BY trial")
def _(spark, sf):
    t, _, _ = jobs.trial_accuracy(*exact_pair(spark, sf), 20)
    return t.select("trial", "n_frames", r6("s"), r6(F.col("R")[0], "r00"), r6(F.col("R")[1], "r01"), r6("pa_mpjpe"), "status")


@query("job_6_trial_accuracy_at_predictions", ["f3c"],
       "SELECT trial, round(avg(sqrt(pow(x-rx,2)+pow(y-ry,2)+pow(z-rz,2))),6) mpjpe_t_only, count(DISTINCT frame) n_frames FROM f3c WHERE rx IS NOT NULL GROUP BY trial")
def _(spark, sf):
    d = X.reference_near(spark, sf).where("rx is not null")
    pred = d.select("trial", "t", "joint", "x", "y", "z")
    ref = d.select("trial", "t", "joint", *[F.col(f"r{c}").alias(c) for c in "xyz"])
    t, _, _ = jobs.trial_accuracy(pred, ref, 20, eval_on="pred")
    return t.select("trial", r6("mpjpe_t_only"), "n_frames")


@query("job_7_frame_accuracy", ["f1"],
       "WITH p AS (SELECT trial, frame, (max(x) FILTER (joint='left_hip')+max(x) FILTER (joint='right_hip'))*0.5 px, (max(y) FILTER (joint='left_hip')+max(y) FILTER (joint='right_hip'))*0.5 py, "
       "(max(z) FILTER (joint='left_hip')+max(z) FILTER (joint='right_hip'))*0.5 pz FROM f1 GROUP BY trial, frame) SELECT trial, count(*) n_frames, round(avg(m),6)+0.0 mpjpe FROM "
       "(SELECT trial, frame, avg(trial/10.0*sqrt(pow(x-px,2)+pow(y-py,2)+pow(z-pz,2))) m FROM f1 JOIN p USING (trial, frame) GROUP BY trial, frame) GROUP BY trial")
def _(spark, sf):
    t, _ = jobs.frame_accuracy(*exact_pair(spark, sf), pred_axes="forward_left_up")
    return t.select("trial", "n_frames", r6("mpjpe"))


@query("job_7_frame_procrustes", ["f1"], "SELECT trial, joint, count(*) n, 0.0::DOUBLE mpjpe FROM f1 GROUP BY ALL")
def _(spark, sf):
    _, j = jobs.frame_accuracy(*exact_pair(spark, sf), procrustes="similarity")
    return j.select("trial", "joint", "n", r6("mpjpe"))


@query("job_7_anchor_per_trial", ["f1"],
       "WITH q AS (SELECT * FROM f1 WHERE NOT (k = 4 AND trial % 3 = 1)), p AS (SELECT trial, frame, "
       + ", ".join(f"CASE WHEN trial % 3 = 2 THEN avg({c}) ELSE (max({c}) FILTER (joint='left_hip')+max({c}) FILTER (joint='right_hip'))*0.5 END p{c}" for c in "xyz")
       + " FROM q GROUP BY trial, frame) SELECT trial, count(*) n_frames, round(avg(m),6)+0.0 mpjpe, 'ok' status FROM "
       "(SELECT trial, frame, avg(trial/10.0*sqrt(pow(x-px,2)+pow(y-py,2)+pow(z-pz,2))) m FROM q JOIN p USING (trial, frame) GROUP BY trial, frame) GROUP BY trial")
def _(spark, sf):
    # hips in the first third of the trials; spine points instead in the second, one joint all zeros there; neither in the last
    hip = F.col("joint").isin("left_hip", "right_hip")
    other = F.when(F.col("trial") % 3 == 1, F.concat(F.substring("joint", 1, 1), F.lit(".asis"))).otherwise(F.concat(F.lit("pelvis_"), "joint"))
    renamed = lambda d: d.withColumn("joint", F.when(hip & (F.col("trial") % 3 > 0), other).otherwise(F.col("joint")))
    pred, ref = (renamed(d) for d in exact_pair(spark, sf))
    lost = (F.col("joint") == D.BODY20[4]) & (F.col("trial") % 3 == 1)
    pred = pred.select("trial", "t", "joint", *[F.when(lost, 0.0).otherwise(F.col(c)).alias(c) for c in "xyz"])
    t, _ = jobs.frame_accuracy(pred, ref, pred_axes="forward_left_up", missing="triplet")
    return t.select("trial", "n_frames", r6("mpjpe"), "status")


@query("job_2_trc_file", ["f1", "sc"],
       f"WITH m AS (SELECT trial, frame, joint marker, x, z FROM f1 WHERE k > 0 UNION ALL {_MID}) SELECT trial::VARCHAR trial, frame, marker, round(frame/60.0,6) t, round(x*s,5)+0.0 x, round(z*s,5)+0.0 z FROM m JOIN sc USING (trial)")
def _(spark, sf):
    _, m = jobs.metric_scaling(trial_frames(spark, sf), Q.heights(spark, sf), D.BODY20, ["nose", "neck"], FEET)
    path = scratch_path(spark, "trc")
    jobs.write_markers(m, path, 60.0)
    _, rows, _ = trc.read_trc(spark, path)
    return rows.select("trial", "frame", "marker", r6("t"), (F.col("x") + 0.0).alias("x"), (F.col("z") + 0.0).alias("z"))


@query("job_5_trc_file", ["f8"], sql_mocap("250.0::DOUBLE", {250.0: 6.0}).replace("SELECT trial,", "SELECT trial::VARCHAR AS trial,", 1))
def _(spark, sf):
    d = labelled(spark, sf)
    m, _ = jobs.downsample_mocap(d, d.select("trial", "pos", "marker").distinct(), D.MOCAP_KEEP, 250.0, 100.0)
    path = scratch_path(spark, "trc")
    # four digits in the file's millimetres
    trc.write_trc(m, path, 100.0, source_rate=250.0, digits=4)
    _, rows, _ = trc.read_trc(spark, path)
    return rows.where("x is not null").select("trial", "frame", r6("t"), "marker", *[(F.col(c) + 0.0).alias(c) for c in "xyz"])


def sourced_frames(spark, sf):
    """F1 as frames of two persons; the points are metric in even frames, tagged as millimetres in the others."""
    xyz = F.transform("kp", lambda p: F.array(p["x"], p["y"], p["z"]))
    even = F.col("frame") % 2 == 0
    person = lambda pts, s: F.struct(F.when(~even, pts).alias("keypoints_xyz"), F.when(even, pts).alias("keypoints_xyz_mm"),
                                     F.when(~even, "mm").alias("keypoints_xyz_units"), F.lit(s).alias("mean_score"))
    worse = F.transform(xyz, lambda p: F.transform(p, lambda c: c * 3.0))
    return X.pose_frames(spark, sf).select("trial", "frame", "t", F.array(person(worse, 0.2), person(xyz, 0.9)).alias("persons"))


#: Mocap names of the basic joints; the left knee is seen by a medial and a lateral marker.
_MOCAP = {"left_hip": "L_HJC", "right_hip": "R_HJC", "right_knee": "r_knee", "left_ankle": "L_ankle", "right_ankle": "r_ankle", "left_heel": "L_calc",
          "right_heel": "r_calc", "left_big_toe": "L_toe", "right_big_toe": "r_toe"}


def sourced_markers(spark, sf):
    d = X.reference_exact(spark, sf).select("trial", "frame", "t", "joint", *[F.col(f"r{c}").alias(c) for c in "xyz"])
    d = d.join(literal_table(spark, ["joint", "marker", "dx"], [(j, m, 0.0) for j, m in _MOCAP.items()] + [("left_knee", "L_knee_med", 40.0), ("left_knee", "L_knee_lat", -40.0)]), "joint")
    return d.select("trial", "frame", "t", "marker", (F.col("x") + F.col("dx")).alias("x"), "y", "z")


@query("job_6_from_frames", ["f1"],
       "SELECT trial, ceil((n-1)/60.0*100 - 1e-9)::BIGINT n_frames, round(1+trial/10.0,6) s, 0.0::DOUBLE pa_mpjpe, 'ok' status, 10::BIGINT n_joints, ceil(n/2)::BIGINT metric, n//2 tagged "
       "FROM (SELECT trial, count(DISTINCT frame) n FROM f1 GROUP BY trial)")
def _(spark, sf):
    pred, sources = jobs.predicted_joints(sourced_frames(spark, sf), D.BODY20, person_index=-1, min_mean_score=0.5)
    t, j, _ = jobs.trial_accuracy(pred, jobs.mocap_joints(sourced_markers(spark, sf), joint_centers=True), 10)
    n = j.where("mpjpe is not null").groupBy("trial").agg(F.count(F.lit(1)).alias("n_joints"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("source") == s, F.col("frames"))), F.lit(0))
    seen = sources.groupBy("trial").agg(of("keypoints_xyz_mm").alias("metric"), of("keypoints_xyz (units=mm)").alias("tagged"))
    return t.select("trial", "n_frames", r6("s"), r6("pa_mpjpe"), "status").join(n, "trial").join(seen, "trial")


@query("job_6_report_files", ["f1"],
       "SELECT trial, n_frames, 20::BIGINT n_joints, 20*n_frames n_rows, round(1+trial/10.0,6) s, 0.0::DOUBLE pa_mpjpe, 'ok' status FROM "
       "(SELECT trial, ceil((count(DISTINCT frame)-1)/60.0*100 - 1e-9)::BIGINT n_frames FROM f1 GROUP BY trial)")
def _(spark, sf):
    path = scratch_path(spark, "accuracy")
    trials, joints, aligned = jobs.trial_accuracy(*exact_pair(spark, sf), 20)
    jobs.write_accuracy(trials, joints, path, aligned)
    rows = spark.read.parquet(f"{path}/series").groupBy(F.col("trial").cast("long").alias("trial")).agg(F.count(F.lit(1)).alias("n_rows"))
    report = spark.read.json(f"{path}/report")
    n = sum((F.col(f"per_joint_mpjpe.{j}").isNotNull().cast("long") for j in D.BODY20), F.lit(0).cast("long"))
    return report.join(rows, "trial").select("trial", "n_frames", n.alias("n_joints"), "n_rows", r6("s"), r6("pa_mpjpe"), "status")


@query("job_8_enhanced_accuracy", ["f1"],
       "SELECT trial, round(1+trial/10.0,6) s, 0.0::DOUBLE mpjpe, 0.0::DOUBLE rmse FROM f1 GROUP BY trial")
def _(spark, sf):
    m = S.named_markers(spark, sf)
    s, up = 1 + F.col("trial") / 10.0, F.col("trial") + 1
    ref = m.select("trial", "t", "marker", (s * -F.col("y") + 10 * up).alias("x"), (s * F.col("x") + 20 * up).alias("y"), (s * F.col("z")).alias("z"))
    pairs = names.native_pairs(*[S.left_right_names(spark, sf)[1]] * 2)
    t, _ = jobs.enhanced_accuracy(m.select("trial", "t", "marker", "x", "y", "z"), ref, pairs, exclude="wrist")
    return t.select("trial", r6("s"), r6("mpjpe"), r6("rmse"))


def still(spark, sf):
    return X.markers_still(spark, sf).withColumn("marker", F.col("marker").cast("string"))


def sql_still(fs, threshold, step, maximum, only="TRUE"):
    """``fs``: rates by trial % 3."""
    rates = sorted(set(fs))
    pick = f"[{', '.join(f'{r}::DOUBLE' for r in fs)}][trial % {len(fs)} + 1]"
    return (f"WITH v AS (SELECT *, {pick} fs FROM f12), " + M.sql_relaxed({r: quality.window_lengths(r, 0.1) for r in rates}, threshold, step, maximum, "v", only)
            + " SELECT t.trial, start, n, steps, CASE WHEN n IS NULL THEN 'not found' ELSE 'ok' END status, round(start/fs,6) t0, round((start+n-1)/fs,6) t1 "
              "FROM (SELECT DISTINCT trial FROM f12) t LEFT JOIN bs USING (trial)")


#: Every trial of the view has values above 10, so its coordinates count as millimetres.
_METRES = ("q AS (SELECT *", "q AS (SELECT trial, marker, frame, fs, x/1000 x, y/1000 y, z/1000 z")


def windows(d):
    return d.select("trial", "start", "n", "steps", "status", r6("t0"), r6("t1"))


@query("job_9_still_phases", ["f12"], sql_still([30.0], 0.5, 0.001, 100.0, "marker IN (3, 4, 5)").replace(*_METRES, 1))
def _(spark, sf):
    return windows(jobs.still_phases(still(spark, sf), 30.0, root=None, marker_set=["3", "4", "5"]))


@query("job_9_still_phase_windows", ["f12"], sql_still([30.0], 0.02, 0.003, 0.3).replace(*_METRES, 1))
def _(spark, sf):
    return windows(jobs.still_phases(still(spark, sf), 30.0, 0.02, 0.003, 0.3, 0.1, root=None))


@query("job_9_rate_per_trial", ["f12"], sql_still([20.0, 30.0, 40.0], 0.005, 0.001, 0.3).replace(*_METRES, 1))
def _(spark, sf):
    d = still(spark, sf)
    return windows(jobs.still_phases(d, trial_rates(spark, sf, (20.0, 30.0, 40.0), d), 0.005, 0.001, 0.3, 0.1, root=None))


@query("job_10_model_readiness", None,
       f"WITH mm AS ({M._MM}) SELECT s_suppkey AS model, 5::BIGINT tasks, (SELECT count(*) FROM mm WHERE mm.model=s_suppkey AND marker IN ({', '.join(repr(t) for t in M._TASKS)})) tasks_applied, 3::BIGINT measurements FROM supplier")
def _(spark, sf):
    s = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("model"))
    t = s.select("model", F.explode(F.array(*[F.lit(v) for v in M._TASKS])).alias("marker"), F.lit(True).alias("apply"))
    rows = F.array(*[F.struct(F.lit(m).alias("measurement"), F.lit(a).alias("a"), F.lit(b).alias("b")) for m, a, b in M._PAIRS])
    d = jobs.model_readiness(t, s.select("model", F.inline(rows)), M.model_markers(spark, sf))
    return d.select("model", "tasks", "tasks_applied", "measurements")


@query("job_11_projection_audit", ["prj"],
       "SELECT trial, count(*) n, count(*) FILTER (pu>=0 AND pu<960 AND pv>=0 AND pv<540) n_inside, round(median(cz),6) median_z, round(min(pu),6) min_pu, round(max(pv),6) max_pv FROM prj GROUP BY trial")
def _(spark, sf):
    d = X.pose_long(spark, sf).select("trial", "t", F.col("joint").alias("marker"), "x", "y", "z")
    times = X.vectors(spark, sf).select("trial", "frame", (F.col("frame") / 60.0).alias("t"))
    _, t = jobs.projection_audit(d, times, Q.calibrations(spark, sf))
    return t.select("trial", "n", "n_inside", r6("median_z"), r6("min_pu"), r6("max_pv"))


def audit_inputs(spark, sf):
    d = X.pose_long(spark, sf).select("trial", "t", F.col("joint").alias("marker"), "x", "y", "z")
    return d, X.vectors(spark, sf).select("trial", "frame", (F.col("frame") / 60.0).alias("t"))


@query("job_11_orthographic", ["f1"],
       "SELECT trial, count(*) n, count(*) FILTER (u>=0 AND u<960 AND v>=0 AND v<540) n_inside, round(min(u),6) min_pu, round(max(v),6) max_pv, 'ok' status FROM "
       "(SELECT trial, x - avg(x) OVER w u, y - avg(y) OVER w v FROM f1 WINDOW w AS (PARTITION BY trial, frame)) GROUP BY trial")
def _(spark, sf):
    q, t = jobs.projection_audit(*audit_inputs(spark, sf), Q.calibrations(spark, sf), mode="orthographic")
    ends = q.groupBy("trial").agg(r6(F.min("pu"), "min_pu"), r6(F.max("pv"), "max_pv"))
    return t.select("trial", "n", "n_inside", "status").join(ends, "trial")


@query("job_11_given_focal", ["f1"],
       "SELECT trial, count(*) n, count(*) FILTER (u>=0 AND u<960 AND v>=0 AND v<540) n_inside, round(median(d),6) median_z, round(min(u),6) min_pu, round(max(v),6) max_pv, 'ok' status FROM "
       "(SELECT trial, z+3000 d, 700*x/(z+3000)+480 u, 700*y/(z+3000)+270 v FROM f1) GROUP BY trial")
def _(spark, sf):
    # no calibration: a centred camera of 700 pixels, three metres away
    sizes = X.vectors(spark, sf).select("trial").distinct().withColumns({"width": F.lit(960), "height": F.lit(540)})
    _, t = jobs.projection_audit(*audit_inputs(spark, sf), camera.synthetic_calibration(sizes, 700.0), nudge_mm=(0.0, 0.0, 3000.0))
    return t.select("trial", "n", "n_inside", r6("median_z"), r6("min_pu"), r6("max_pv"), "status")


@query("job_12_overlay_geometry", ["f5"],
       M.sql_segments(959, 539, 4))
def _(spark, sf):
    _, s = jobs.overlay_geometry(X.pixels(spark, sf), literal_table(spark, ["a", "b"], D.EDGES), 960, 540)
    return s.select("trial", "frame", place(D.BODY20, F.col("a")).alias("a"), place(D.BODY20, F.col("b")).alias("b"), F.round("length", 4).alias("length"))


@query("job_13_crop_plan", ["f11", "f5prev"],
       "WITH d AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.trial, d.frame ORDER BY CASE WHEN p.x1 IS NULL THEN -(d.x2-d.x1)*(d.y2-d.y1) ELSE pow((d.x1+d.x2)*0.5-(p.x1+p.x2)*0.5,2)+"
       "pow((d.y1+d.y2)*0.5-(p.y1+p.y2)*0.5,2) END, d.det) r FROM (SELECT * FROM f11 WHERE label=0 AND score>=0.4 AND frame%4=0) d JOIN f5prev p USING (trial, frame)) WHERE r=1) "
       "SELECT p.trial, p.frame, CASE WHEN d.det IS NOT NULL THEN 'detector' WHEN p.x1 IS NOT NULL THEN 'tracker' ELSE 'center' END source, round(coalesce(d.x1, p.x1, 237),6) x1, round(coalesce(d.y2, p.y2, 539),6) y2 "
       "FROM f5prev p LEFT JOIN d ON d.trial=p.trial AND d.frame=p.frame")
def _(spark, sf):
    c = jobs.plan_crops(X.detections(spark, sf), S.person_boxes(spark, sf), 960, 540, 0.4, 4)
    return c.select("trial", "frame", "source", r6(F.col("crop.x1"), "x1"), r6(F.col("crop.y2"), "y2"))


# ------------------------------------------------------------------ streaming
def frame_folder(spark, sf):
    """Frames as many small files, some of them repeated."""
    d = X.persons(spark, sf)
    path = scratch_path(spark, "live")
    again = d.where("frame_index % 10 = 0")
    jsonl.write_frames(d.unionByName(again).repartition(8, "frame_index"), path, partition=None)
    return path


def drained(spark, d, mode="append"):
    out = scratch_path(spark, "drained")
    live.run_to_table(d, out, scratch_path(spark, "progress"), mode)
    return spark.read.parquet(out)


@query("str_1_live_frames", ["f4"], "SELECT trial::VARCHAR trial_id, count(DISTINCT frame) n FROM f4 GROUP BY trial")
def _(spark, sf):
    d = drained(spark, live.live_frames(spark, frame_folder(spark, sf), lateness="1 hour").drop("persons"))
    return d.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"))


_WINDOWS = (
       "WITH f AS (SELECT trial, frame, count(*) n, sum(mean_score) s FROM f4 GROUP BY ALL), c AS (SELECT trial, frame, n, s FROM f) "
       "SELECT (epoch_us(TIMESTAMP '2024-01-01') + (frame // 60) * 1000000)//1000000 AS start_s, trial::VARCHAR trial_id, count(*) frames, sum(n)::BIGINT persons, round(sum(s)/sum(n),6) mean_score, 0.0::DOUBLE empty_share FROM c GROUP BY frame // 60, trial")


def window_columns(w):
    return w.select(F.unix_seconds("start").alias("start_s"), "trial_id", "frames", "persons", r6("mean_score"), r6("empty_share"))


@query("str_2_quality_windows", ["f4"], _WINDOWS)
def _(spark, sf):
    # a drained stream: repeated frames are dropped, windows are emitted as they close
    path = frame_folder(spark, sf)
    live.write_end_of_session(spark, path)
    return window_columns(drained(spark, live.closed_windows(live.live_frames(spark, path, lateness="1 hour"), "1 second")))


@query("str_2_windows_of_table", ["f4"], _WINDOWS)
def _(spark, sf):
    # the same aggregate over a table
    return window_columns(live.quality_windows(live.with_event_time(X.persons(spark, sf), "2024-01-01 00:00:00"), "1 second"))


@query("str_3_keyed_smoothing", ["f4"],
       "WITH l AS (SELECT trial, person, list(1000*e[1] ORDER BY frame) xs, list(e[11] ORDER BY frame) bs, list(frame ORDER BY frame) fs FROM f4 GROUP BY ALL) "
       "SELECT trial, person, f AS frame, round(y,6)+0.0 tx, round(b,6)+0.0 x1 FROM (SELECT trial, person, unnest(fs) f, unnest(bs) b, unnest(list_transform(range(1, len(xs)+1), "
       "lambda n: list_reduce(xs[1:n], lambda a, b: (1-0.2::DOUBLE)*a + 0.2::DOUBLE*b))) y FROM l)")
def _(spark, sf):
    d = X.person_rows(spark, sf).select("trial", "person", "frame", *[(1000 * F.col("e")[i]).alias(c) for i, c in enumerate(("tx", "ty", "tz"))],
                                        *[F.col("e")[10 + i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
    d = live.with_event_time(d.withColumn("time_sec", F.col("frame") / 60), "2024-01-01 00:00:00").drop("time_sec")
    path = scratch_path(spark, "state")
    d.write.parquet(path)
    live.end_of_session(d).write.mode("append").parquet(path)
    s = spark.readStream.schema(d.schema).parquet(path)
    out = drained(spark, live.keyed_smoothing(s, 0.2, "1 day"))
    return out.select("trial", "person", "frame", r6("tx"), r6("x1"))

