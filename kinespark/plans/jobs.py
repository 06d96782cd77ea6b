"""Whole jobs: every trial of the input at once, tables in and tables out.

Long tables: keypoints and markers are (trial, frame or t, joint or marker, x, y, z).
Trials that cannot be processed come back as rows with a status and a reason.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import dims, text
from kinespark.functions import geometry as G
from kinespark.operators import (
    align, camera, errors, frames, names, overlay, quality, resample, scale, select, series, smooth, timealign, tracking,
)
from kinespark.session import materialise
from kinespark.sources import tables, trc

XYZ = ("x", "y", "z")


def with_rate(df: DataFrame, rate: float | DataFrame, name: str = "fs") -> DataFrame:
    """``df`` with the sampling rate of each trial: one number, or a table (trial, rate). Trials
    that the table lacks keep a NULL."""
    if isinstance(rate, DataFrame):
        return df.join(rate.select("trial", F.col("rate").cast("double").alias(name)), "trial", "left")
    return df.withColumn(name, F.lit(float(rate)))


# ------------------------------------------------------------------ subjects
def harmonise_subjects(metadata: DataFrame, flat: str = "meta", nested: str = "nested") -> DataFrame:
    """Typed sex, height_m and mass_kg from free-form session metadata."""
    get = lambda keys: text.lookup(F.col(flat), F.col(nested), keys)
    d = metadata.withColumns({"_s": get(text.SEX_KEYS), "_h": get(text.HEIGHT_KEYS), "_m": get(text.MASS_KEYS)})
    rest = [c for c in metadata.columns if c not in (flat, nested)]
    return d.select(*rest, text.sex_of(F.col("_s")).alias("sex"), text.height_m(F.col("_h")).alias("height_m"),
                    text.mass_kg(F.col("_m")).alias("mass_kg"))


# ------------------------------------------------------------------ metric scale
def metric_scaling(
    frames_df: DataFrame, subjects: DataFrame, joint_names: Sequence[str], heads: Sequence[str], feet: Sequence[str],
    person_index: int = -1, min_mean_score: float = 0.0, percentile: float = 95.0,
    source_rate: float | DataFrame = 60.0, target_rate: float | None = None, cutoff: float | None = 6.0,
) -> tuple[DataFrame, DataFrame]:
    """(scales, markers): scale per trial from the subject's height, and the chosen
    person's metric markers with neck and midHip, resampled when asked for.
    ``source_rate`` is a number or a table (trial, rate); trials without a rate, or
    with the target or more, keep their frames.

    ``frames_df``: trial, frame, persons (keypoints_xyz, mean_score)."""
    h = [joint_names.index(j) for j in heads if j in joint_names]
    f = [joint_names.index(j) for j in feet if j in joint_names]
    if not h or not f:
        raise ValueError("no head or no foot joint in the keypoint dictionary")
    p = select.choose_person(F.col("persons"), person_index)
    d = frames_df.select("trial", "frame", p.alias("p"))
    ok = (F.coalesce(F.col("p.mean_score"), F.lit(1.0)) >= min_mean_score) & select.well_formed(F.col("p.keypoints_xyz"))
    labels = F.array(*[F.lit(j) for j in joint_names])
    kp = F.zip_with(F.col("p.keypoints_xyz"), labels, lambda q, j: F.struct(
        j.alias("joint"), q[0].alias("x"), q[1].alias("y"), q[2].alias("z")))
    d = d.select("trial", "frame", ok.alias("ok"), F.when(select.well_formed(F.col("p.keypoints_xyz")), kp).alias("kp"))
    d = materialise(d, "chosen")
    dist = d.where("ok").select("trial", scale.head_foot_distance("kp", h, f).alias("d"))
    scales = scale.height_scale(scale.model_height(dist, ["trial"], percentile=percentile), subjects, ["trial"])
    m = d.join(scales.where("status = 'ok'").select("trial", "scale"), "trial")
    m = m.select("trial", "frame", "scale", F.inline_outer("kp")).select(
        "trial", "frame", "joint", *[(F.col(c) * F.col("scale")).alias(c) for c in XYZ])
    if target_rate and (isinstance(source_rate, DataFrame) or target_rate > source_rate):
        m = with_rate(m.where("joint is not null"), source_rate).withColumn("fs", F.coalesce("fs", F.lit(float(target_rate))))
        m = smooth.upsample(m, ["trial", "joint"], "frame", list(XYZ), "fs", target_rate, cutoff)
        m = m.select("trial", F.col("i").alias("frame"), "joint", *XYZ)
    fk = ["trial", "frame"]
    both = materialise(m.where("joint is not null"), "metric")
    neck = frames.synthetic_joint(both, fk, "neck", "left_shoulder", "right_shoulder")
    hip = frames.synthetic_joint(both, fk, "midHip", "left_hip", "right_hip")
    full = both.where(~F.col("joint").isin("neck", "midHip")).unionByName(neck).unionByName(hip)
    full = select.trim_trailing_missing(full, ["trial"], "frame")
    return scales, full.withColumnRenamed("joint", "marker")


# ------------------------------------------------------------------ placement
def absolute_placement(
    points: DataFrame, calib: DataFrame, person_keys: Sequence[str] = ("trial", "person"), min_score: float = 0.0,
    undistort: str = "auto", ema: float = 0.0, joints: Sequence[int] | None = None,
) -> DataFrame:
    """Camera and world coordinates for a known camera orientation.

    ``points``: trial, frame, person, k, x, y, z, u, v, score. Per frame and person
    the translation is fitted on the reliable joints, smoothed over time per
    person, and applied to all joints; the reprojection error is reported. Every
    point has a row; ``status`` tells those without a calibration or without a
    placement, whose coordinates are NULL."""
    gk = [*person_keys, "frame"]
    d = points = materialise(points, "points")
    if undistort != "off":
        d = camera.undistort(d, calib)
        use = F.lit(True)
        if undistort == "auto":
            first = d.where("person = 0")
            d = d.join(camera.undistort_decision(first.select("trial", "frame", "u", "v"), calib).select("trial", "undistort"), "trial", "left")
            use = F.coalesce(F.col("undistort"), F.lit(True))
        d = d.withColumn("u", F.when(use, F.col("uu")).otherwise(F.col("u"))).withColumn("v", F.when(use, F.col("uv")).otherwise(F.col("v")))
        d = d.select(*points.columns)
    reliable = F.coalesce(F.col("score") >= min_score, F.lit(False))
    if joints is not None:
        reliable = reliable & F.col("k").isin(list(joints))
    if undistort != "off":
        d = materialise(d, "undistorted")
    fit = camera.place_with_rotation(d.where(reliable), calib, gk)
    every = d.select(*gk).distinct().join(fit, gk, "left")
    fit = camera.smooth_translation(every, list(person_keys), "frame", ema)
    q = d.join(calib.select("trial", F.col("R").alias("_R")), "trial", "left").join(fit.select(*gk, "tx", "ty", "tz"), gk, "left")
    r = G.mat_vec(G.elements(F.col("_R")), [F.col(c) for c in XYZ])
    q = q.select(*d.columns, "tx", "ty", "tz", *[(c + F.col(f"t{n}")).alias(f"c{n}") for c, n in zip(r, XYZ)])
    q = materialise(camera.project(q, calib, distortion=False), "placed")
    rmse = camera.reprojection_rmse(q.where(reliable), gk)
    cam = q.drop("pu", "pv").join(rmse, gk, "left")
    inv = camera.invert_calibration(calib).select("trial", F.col("R").alias("_R"), F.col("t").alias("_t"))
    cam = cam.join(inv, "trial", "left")
    w = G.mat_vec(G.elements(F.col("_R")), [F.col(f"c{n}") for n in XYZ])
    status = F.when(F.col("_R").isNull(), "no calibration").when(F.col("tx").isNull(), "not placed").otherwise("ok")
    return cam.select(*[c for c in cam.columns if c not in ("_R", "_t")], *[(c + F.col("_t")[i]).alias(f"w{n}") for i, (c, n) in enumerate(zip(w, XYZ))],
                      status.alias("status"))


def canonicalise(frames_df: DataFrame, joints: dict[str, int], mode: str = "first-frame") -> DataFrame:
    """Body-centred trajectories. ``frames_df``: trial, frame, person, kp; centre
    and axes come from person 0 and apply to every person of the frame."""
    anchor = frames.add_body_frame(frames_df.where("person = 0").select("trial", "frame", "kp"), "kp", joints).drop("kp")
    if mode == "first-frame":
        anchor = frames.first_valid(anchor, ["trial"], "frame", "axes")
    elif mode != "per-frame":
        raise ValueError(f"unknown mode {mode!r}")
    return frames.canonical_points(frames_df.join(anchor, ["trial", "frame"], "left"))


def downsample_mocap(
    markers: DataFrame, labels: DataFrame, keep: Sequence[str], fs: float | DataFrame, target: float = 100.0, cutoff: float | None = 6.0
) -> tuple[DataFrame, DataFrame]:
    """(markers, missing): selected labels (first of duplicates, case ignored),
    filtered and downsampled, and the requested labels a trial lacks. ``fs`` is a
    number or a table (trial, rate); a trial without a rate counts as being at the target.

    ``labels``: trial, pos, marker; ``markers``: trial, frame, marker, x, y, z."""
    first = names.keep_first_label(labels, ["trial"], "marker", "pos").withColumn("label", text.label_name(F.col("marker")))
    # written, so that the join knows their size
    chosen = materialise(first.join(_asked(labels, keep), ["trial", "label"], "left_semi").select("trial", "marker", "label"), "labels")
    d = markers.join(chosen, ["trial", "marker"]).select("trial", F.col("label").alias("marker"), "frame", *XYZ)
    d = with_rate(d, fs).withColumn("fs", F.coalesce("fs", F.lit(float(target))))
    d = smooth.downsample(d, ["trial", "marker"], "frame", list(XYZ), "fs", target, cutoff)
    return d.select("trial", F.col("i").alias("frame"), "t", "marker", *XYZ), missing_labels(labels, keep)


def _asked(labels: DataFrame, keep: Sequence[str]) -> DataFrame:
    return labels.select("trial").distinct().select("trial", F.explode(F.array(*[F.lit(k) for k in keep])).alias("label"))


def missing_labels(labels: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(trial, label): the labels of ``keep`` that a trial of ``labels`` (trial, pos, marker) lacks.
    No marker row is read."""
    held = labels.select("trial", text.label_name(F.col("marker")).alias("label")).distinct()
    return _asked(labels, keep).join(held, ["trial", "label"], "left_anti")


# ------------------------------------------------------------------ accuracy
def predicted_joints(
    frames_df: DataFrame, joint_names: Sequence[str], joint_set: str = "basic", person_index: int = 0, min_mean_score: float = 0.0,
    allow_raw: bool = False, prefer_raw: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(joints, sources): trial, t, joint, x, y, z of the chosen person, and how many frames of
    each trial came from which source.

    ``frames_df``: trial, frame, t, persons (keypoints_xyz, keypoints_xyz_mm,
    keypoints_xyz_units, mean_score). Points come from the best accepted source
    (:func:`select.pick_source`); frames without one, with a malformed one or a low
    score count as source ``none`` and give no joints. ``joint_set`` is ``basic`` or
    ``body20`` (with neck and mid_hip made from the sides)."""
    p = select.choose_person(F.col("persons"), person_index)
    d = frames_df.select("trial", "frame", "t", p.alias("p")).withColumn("s", select.pick_source(F.col("p"), allow_raw, prefer_raw))
    good = (F.coalesce(F.col("p.mean_score"), F.lit(1.0)) >= min_mean_score) & select.well_formed(F.col("s.kp"), len(joint_names))
    d = materialise(d.select("trial", "frame", "t", F.when(good, F.col("s")).alias("s")), "sources")
    sources = d.groupBy("trial", F.coalesce("s.source", F.lit("none")).alias("source")).agg(F.count(F.lit(1)).alias("frames"))
    labels = F.array(*[F.lit(j) for j in joint_names])
    kp = F.zip_with("s.kp", labels, lambda q, j: F.struct(j.alias("joint"), *[q[i].alias(c) for i, c in enumerate(XYZ)]))
    long = d.where("s is not null").select("trial", "frame", "t", F.inline(kp))
    return _joint_set(long, joint_set, names.body20_from_keypoints, lambda x: x.where(F.col("joint").isin(list(dims.BASIC_ALIASES)))), sources


def mocap_joints(markers: DataFrame, joint_set: str = "basic", joint_centers: bool = False) -> DataFrame:
    """trial, t, joint, x, y, z from markers (trial, frame, t, marker, x, y, z). With
    ``joint_centers`` knees and ankles are midpoints of their medial and lateral
    markers in trials that have both."""
    centers = dims.MEDIAL_LATERAL if joint_centers else None
    return _joint_set(markers, joint_set, lambda m: names.assemble_body20(m, dims.BODY20_SINGLE, dims.BODY20_PAIRS),
                      lambda m: names.basic_joints(m, dims.BASIC_ALIASES, centers))


def _joint_set(d: DataFrame, joint_set: str, body20, basic) -> DataFrame:
    if joint_set not in ("basic", "body20"):
        raise ValueError(f"unknown joint set {joint_set!r}")
    times = d.groupBy("trial", "frame").agg(F.min("t").alias("t"))
    made = (basic if joint_set == "basic" else body20)(d.drop("t"))
    return made.join(times, ["trial", "frame"]).select("trial", "t", "joint", *XYZ)


def _align_in_time(
    pred: DataFrame, ref: DataFrame, eval_on: str, rate: float, block_s: float
) -> DataFrame:
    """Both series at the evaluation times: trial, i, t, joint, x.., rx..."""
    pred, ref = (d.select("trial", "t", "joint", *XYZ) for d in (pred, ref))
    times = materialise(resample.evaluation_times(pred, ref, eval_on, rate, block_s=block_s), "times")
    common = pred.select("trial", "joint").distinct().join(ref.select("trial", "joint").distinct(), ["trial", "joint"])
    items = materialise(common.groupBy("trial").agg(F.sort_array(F.collect_list("joint")).alias("items")), "joints")
    sides = [resample.interpolate_frames(d, times, items, ["trial"], "joint", XYZ, block_s=block_s) for d in (pred, ref)]
    p, r = (d.select("trial", "i", "t", F.col("kp").alias(n)) for d, n in zip(sides, ("p", "r")))
    empty = F.transform("items", lambda j: F.lit(None))
    rows = p.join(r.drop("t"), ["trial", "i"]).join(items, "trial")
    cells = F.arrays_zip("items", F.coalesce("p", empty.cast(p.schema["p"].dataType)).alias("p"), F.coalesce("r", empty.cast(r.schema["r"].dataType)).alias("r"))
    rows = materialise(rows.select("trial", "i", "t", F.inline(cells).alias("joint", "p", "r")), "cells")
    key = ["trial", "joint", "i"]
    out = [*key[:1], "i", "t", "joint"]
    done = rows.where("p is not null and r is not null").select(*out, "p.*", *[F.col(f"r.{c}").alias(f"r{c}") for c in XYZ])
    gaps = rows.where("p is null or r is null")
    if not gaps.take(1):
        return done
    # the neighbours of a gap are sought in the joint's own series
    filled = []
    for d, c in ((pred, "p"), (ref, "r")):
        miss = gaps.where(F.col(c).isNull()).select("trial", "joint", "i", "t")
        own = d.join(miss.select("trial", "joint").distinct(), ["trial", "joint"], "left_semi")
        filled.append(resample.interpolate(own, miss, ["trial", "joint"], list(XYZ), block_s=block_s).select(*key, *[F.col(x).alias(f"_{c}{x}") for x in XYZ]))
    gaps = gaps.join(filled[0], key, "left").join(filled[1], key, "left")
    return done.unionByName(gaps.select(*out, *[F.coalesce(F.col(f"p.{x}"), F.col(f"_p{x}")).alias(x) for x in XYZ], *[F.coalesce(F.col(f"r.{x}"), F.col(f"_r{x}")).alias(f"r{x}") for x in XYZ]))


def _transform_reference(d: DataFrame, extrinsics: DataFrame | None, translate: bool) -> DataFrame:
    """Rotate (and move) rx, ry, rz by per-trial extrinsics where present."""
    if extrinsics is None:
        return d
    d = d.join(extrinsics.select("trial", F.col("R").alias("_R"), F.col("t").alias("_t")), "trial", "left")
    moved = G.mat_vec(G.elements(F.col("_R")), [F.col(f"r{c}") for c in XYZ])
    if translate:
        moved = [m + F.coalesce(F.col("_t")[i], F.lit(0.0)) for i, m in enumerate(moved)]
    new = {f"r{c}": F.when(F.col("_R").isNotNull(), m).otherwise(F.col(f"r{c}")) for c, m in zip(XYZ, moved)}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in d.columns if c not in ("_R", "_t")])


def trial_accuracy(
    pred: DataFrame, ref: DataFrame, n_joints: int, estimate_offset: bool = False, max_offset: float = 1.0,
    eval_on: str = "grid", rate: float = 100.0, center: str = "pelvis", extrinsics: DataFrame | None = None,
    hips: tuple[str, str] = ("left_hip", "right_hip"), min_frames: int = 10, block_s: float = series.SECONDS_PER_BLOCK,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(trials, joints, series) of whole-trial alignment.

    ``pred`` and ``ref``: trial, t, joint, x, y, z. One rotation and one similarity
    are fitted per trial on the complete frames; reported are the mean errors as
    they are (translation only), rotated, scaled (N-MPJPE) and rotated and scaled
    (PA-MPJPE). ``series`` holds the aligned coordinates."""
    trials = pred.select("trial").distinct()
    if estimate_offset:
        sig = lambda d: timealign.leg_signal(d, ("trial", "t"))
        off = timealign.time_offset(sig(pred), sig(ref), max_offset=max_offset, block_s=block_s)
        pred = pred.join(off, "trial").withColumn("t", F.col("t") + F.col("offset")).drop("offset")
    else:
        off = trials.select("trial", F.lit(0.0).alias("offset"))
    d = _transform_reference(_align_in_time(pred, ref, eval_on, rate, block_s), extrinsics, center == "none")
    if center == "pelvis":
        d = frames.center_on_pelvis(d, ["trial", "i"], (XYZ, ("rx", "ry", "rz")), *hips)
    d = materialise(d, "aligned")
    whole = errors.complete_frames(d, ["trial", "i"], n_joints, [*XYZ, "rx", "ry", "rz"])
    enough = whole.groupBy("trial").agg((F.count(F.lit(1)) / n_joints).cast("long").alias("n_frames"))
    fit = align.fit(whole, ["trial"], "similarity").join(enough.where(F.col("n_frames") >= min_frames), "trial")
    s = d.join(fit.select("trial", "R", "s", "n_frames"), "trial")
    rot = G.mat_vec(G.elements(F.col("R")), [F.col(c) for c in XYZ])
    s = s.select(*d.columns, "s", *[c.alias(f"rot_{n}") for c, n in zip(rot, XYZ)])
    r = [F.col(f"r{c}") for c in XYZ]
    rotc = [F.col(f"rot_{c}") for c in XYZ]
    e = s.withColumns({
        "d_t": G.distance([F.col(c) for c in XYZ], r), "d_rot": G.distance(rotc, r),
        "d_n": G.distance([F.col("s") * F.col(c) for c in XYZ], r), "d_pa": G.distance([F.col("s") * c for c in rotc], r),
    })
    rms = F.sqrt(F.avg(F.col("d_rot") * F.col("d_rot")))
    joints = e.groupBy("trial", "joint").agg(F.avg("d_rot").alias("mpjpe"), rms.alias("rmse"), F.count("d_rot").alias("n"))
    overall = e.groupBy("trial").agg(
        F.avg("d_rot").alias("mpjpe_rot"), rms.alias("rmse_rot"), F.avg("d_t").alias("mpjpe_t_only"),
        F.avg("d_n").alias("n_mpjpe"), F.avg("d_pa").alias("pa_mpjpe"),
    )
    out = trials.join(off, "trial", "left").join(fit.select("trial", "R", "s", "n_frames"), "trial", "left").join(overall, "trial", "left")
    out = out.withColumn("status", F.when(F.col("s").isNull(), "failed").otherwise("ok")).withColumn(
        "reason", F.when(F.col("s").isNull(), "too little overlap or too few complete frames"))
    return out, joints, e.select(*d.columns, *[f"rot_{c}" for c in XYZ], "s")


def _every_trial(pred: DataFrame, out: DataFrame, value: str, reason: str) -> DataFrame:
    """``out`` with a row for each trial of ``pred``: status, and the reason where there is no value."""
    bad = F.col(value).isNull()
    return pred.select("trial").distinct().join(out, "trial", "left").withColumn("status", F.when(bad, "failed").otherwise("ok")).withColumn(
        "reason", F.when(bad, reason))


def frame_accuracy(
    pred: DataFrame, ref: DataFrame, resample_to: str = "pred", target_hz: float = 100.0, time_shift: float = 0.0,
    pred_axes: str = "none", ref_axes: str = "none", root_center: bool = True, procrustes: str = "none",
    hips: tuple[str, str] = ("left_hip", "right_hip"), block_s: float = series.SECONDS_PER_BLOCK,
    fallbacks: Sequence[tuple[str, str]] = (("l.asis", "r.asis"),), missing: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(trials, joints) with frame-wise Procrustes: ``none``, ``rigid`` or
    ``similarity``. The trial value is the mean over frames of the frame means;
    every trial of ``pred`` has a row with status and reason.

    Root centring takes the hips, in trials without them one of the ``fallbacks`` and
    in trials without any of these the centroid (:func:`frames.center_by_support`).
    ``missing`` reads zeros as missing: ``triplet`` or ``cell``."""
    if missing:
        pred, ref = (select.zero_as_missing(d, mode=missing) for d in (pred, ref))
    turn = lambda d, e: d.select(*[c for c in d.columns if c not in XYZ], *[c.alias(n) for c, n in zip(G.remap_axes([F.col(c) for c in XYZ], e), XYZ)])
    d = _align_in_time(turn(pred, pred_axes), timealign.shift_time(turn(ref, ref_axes), time_shift), resample_to, target_hz, block_s)
    fk = ["trial", "i"]
    if root_center:
        d = frames.center_by_support(materialise(d, "aligned"), ["trial"], fk, [hips, *fallbacks], (XYZ, ("rx", "ry", "rz")))
    if procrustes != "none":
        d = materialise(d, "paired")
        f = align.fit(d, fk, procrustes)
        d = errors.with_error(align.apply_fit(d, f, fk), ("ax", "ay", "az"))
    else:
        d = errors.with_error(d)
    trials = _every_trial(pred, errors.overall_macro(d, ["trial"], "i"), "mpjpe", "no frame of both series")
    return trials, errors.per_joint(d, ["trial"])


def enhanced_accuracy(
    pred: DataFrame, ref: DataFrame, pairs: DataFrame, include: str | None = None, exclude: str | None = None,
    estimate_offset: bool = False, allow_scale: bool = True, rate: float = 100.0, hips: tuple[str, str] = ("L_HJC", "R_HJC"),
    block_s: float = series.SECONDS_PER_BLOCK, min_frames: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """(trials, markers) for enhanced against native mocap markers.

    ``pairs``: trial, left, right from :func:`names.native_pairs`. Centring uses
    the hips, or the centroid in trials that lack one of them. Every trial of
    ``pred`` has a row with status and reason."""
    p = materialise(pairs.where(select.by_pattern("left", include, exclude)), "pairs")
    a = pred.join(p.select("trial", F.col("left").alias("marker"), F.col("left").alias("joint")), ["trial", "marker"]).drop("marker")
    b = ref.join(p.select("trial", F.col("right").alias("marker"), F.col("left").alias("joint")), ["trial", "marker"]).drop("marker")
    if estimate_offset:
        off = timealign.time_offset(timealign.leg_signal(a, ("trial", "t")), timealign.leg_signal(b, ("trial", "t")), block_s=block_s)
        a = a.join(off, "trial").withColumn("t", F.col("t") + F.col("offset")).drop("offset")
    d = _align_in_time(a, b, "grid", rate, block_s)
    fk, sides = ["trial", "i"], (XYZ, ("rx", "ry", "rz"))
    have = p.groupBy("trial").agg((F.count_if(F.col("left").isin(list(hips))) == 2).alias("_hips"), F.count(F.lit(1)).alias("_k"))
    d = d.join(have, "trial")
    by_hips = frames.center_on_pelvis(d.where("_hips"), fk, sides, *hips)
    by_mean = frames.center_on_centroid(d.where("not _hips"), fk, [*XYZ, "rx", "ry", "rz"])
    d = materialise(by_hips.unionByName(by_mean), "aligned")
    ok = F.lit(True)
    for c in [*XYZ, "rx", "ry", "rz"]:
        ok = ok & F.col(c).isNotNull()
    good = d.groupBy(*fk).agg(F.count_if(ok).alias("_n"), F.max("_k").alias("_k")).where("_n = _k").select(*fk)
    whole = d.join(good, fk, "left_semi")
    n = good.groupBy("trial").agg(F.count(F.lit(1)).alias("n_frames")).where(F.col("n_frames") >= min_frames)
    f = align.fit(whole, ["trial"], "similarity" if allow_scale else "rigid").join(n, "trial")
    e = errors.with_error(align.apply_fit(d, f, ["trial"], translate=False), ("ax", "ay", "az"))
    out = errors.overall_micro(e, ["trial"]).join(f.select("trial", "s", "n_frames"), "trial")
    return _every_trial(pred, out, "s", "too few pairs, overlap or complete frames"), errors.per_joint(e, ["trial"])


def write_markers(markers: DataFrame, path: str, rate: float, units: str = "m", source_rate: float | None = None) -> None:
    """The file end of the marker jobs: (trial, frame, marker, x, y, z) as TRC, see :func:`trc.write_trc`."""
    trc.write_trc(markers.select("trial", "frame", "marker", *XYZ), path, rate, units=units, source_rate=source_rate)


def write_accuracy(trials: DataFrame, joints: DataFrame, path: str, aligned: DataFrame | None = None) -> None:
    """The file end of the accuracy jobs: one report record per trial in ``report``, and the
    aligned series in ``series`` by trial."""
    scalars = trials.select(*[F.col(c) for c, t in trials.dtypes if t in ("string", "boolean", "int", "bigint", "double") or c == "trial"])
    per_joint = joints.select(*[c for c in joints.columns if c != "n"])
    reported = tables.report_records(per_joint, scalars).select("*")
    silent = scalars.join(per_joint.select("trial").distinct(), "trial", "left_anti")  # trials that failed
    tables.write_report(reported.unionByName(silent, allowMissingColumns=True), f"{path}/report")
    if aligned is not None:
        tables.write_series(aligned, f"{path}/series")


# ------------------------------------------------------------------ still phases, readiness
def still_phases(
    markers: DataFrame, fs: float | DataFrame, threshold: float = 0.5, step: float = 0.001, maximum: float = 100.0, min_duration: float = 0.1,
    root: str | None = "midHip", rename: bool = False, marker_set: Sequence[str] | None = None,
) -> DataFrame:
    """Earliest, longest still window per trial, with the relaxation it needed.

    ``fs`` is a number or a table (trial, rate): windows of each trial have lengths of
    its own rate. With ``marker_set`` (see :func:`quality.still_markers`) only those
    markers must be still; the root is removed from them first."""
    d = markers.withColumn("marker", names.study_to_mocap(F.col("marker"))) if rename else markers
    d = with_rate(quality.prepare_still(d, root, markers=marker_set), fs)
    lengths = quality.window_lengths_of(F.col("fs"), min_duration)
    out = quality.relaxed_still(quality.motion_ranges(d.where("fs > 0"), lengths, of=["fs"]), markers, threshold, step, maximum)
    if isinstance(fs, DataFrame):
        out = out.join(fs.select("trial", F.col("rate").cast("double").alias("_fs")), "trial", "left")
    else:
        out = out.withColumn("_fs", F.lit(float(fs)))
    return out.withColumn("t0", F.col("start") / F.col("_fs")).withColumn("t1", (F.col("start") + F.col("n") - 1) / F.col("_fs")).drop("_fs")


def model_readiness(tasks: DataFrame, pairs: DataFrame, model_markers: DataFrame) -> DataFrame:
    """Per model: tracking tasks and measurements that stay applied; 0 where it has none."""
    t = quality.prune_tasks(tasks, model_markers).groupBy("model").agg(
        F.count(F.lit(1)).alias("tasks"), F.count_if("apply").alias("tasks_applied"))
    m = quality.prune_measurements(pairs, model_markers).groupBy("model").agg(
        F.count(F.lit(1)).alias("measurements"), F.count_if("apply").alias("measurements_applied"))
    return t.join(m, "model", "full").na.fill(0)


# ------------------------------------------------------------------ image plane
def projection_audit(
    markers: DataFrame, video_times: DataFrame, calib: DataFrame, to_video: DataFrame | None = None, time_offset: float = 0.0,
    yaw_deg: float = 0.0, rotation_only: bool = False, invert_to_video: bool = False, ignore_distortion: bool = False,
    translation_is_center: bool = False, invert_camera: bool = False, nudge_mm: Sequence[float] = (0.0, 0.0, 0.0),
    mode: str = "perspective", block_s: float = series.SECONDS_PER_BLOCK,
) -> tuple[DataFrame, DataFrame]:
    """(points, trials): markers at the video times projected into the image, and
    per trial the share inside it with depth diagnostics; every trial of ``markers``
    has a row, with status and reason.

    ``markers``: trial, t, marker, x, y, z in millimetres; ``video_times``: trial,
    frame, t; ``to_video``: trial, R, t (identity where absent). ``mode`` may be
    ``orthographic``: x and y about the frame's centroid, with the camera left out.
    Trials without a calibration can get one from :func:`camera.synthetic_calibration`."""
    if mode not in ("perspective", "orthographic"):
        raise ValueError(f"unknown mode {mode!r}")
    who = markers.select("trial", "marker").distinct()
    grid = video_times.join(who, "trial").select("trial", "marker", "frame", (F.col("t") + time_offset).alias("t"))
    p = resample.interpolate(markers, grid, ["trial", "marker"], list(XYZ), outside="clamp", min_samples=1, block_s=block_s)
    yaw = G.axis_rotation("y", F.radians(F.lit(float(yaw_deg))))
    if to_video is not None:
        m = to_video.select("trial", "R", "t")
        if rotation_only:
            m = m.withColumn("t", F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)))
        if invert_to_video:
            m = camera.invert_calibration(m)
        m = m.select("trial", F.array(*G.mat_mul(yaw, G.elements(F.col("R")))).alias("R"), "t")
        p = camera.to_camera(p, m).select("trial", "marker", "frame", "t", *[F.col(f"c{c}").alias(c) for c in XYZ])
    elif yaw_deg:
        p = p.select("trial", "marker", "frame", "t", *[c.alias(n) for c, n in zip(G.mat_vec(yaw, [F.col(c) for c in XYZ]), XYZ)])
    k = calib
    if translation_is_center:
        moved = G.mat_vec(G.elements(F.col("R")), G.elements(F.col("t"), 3))
        k = k.withColumn("t", F.array(*[-c for c in moved]))
    if invert_camera:
        k = k.drop("R", "t").join(camera.invert_calibration(k), "trial")
    k = k.withColumn("t", F.array(*[F.col("t")[i] + float(v) for i, v in enumerate(nudge_mm)]))
    if mode == "perspective":
        q = camera.project(camera.to_camera(p, k), k, distortion=not ignore_distortion)
    else:
        flat = frames.center_on_centroid(p.select("*", *[F.col(c).alias(f"_{c}") for c in "xy"]), ["trial", "frame"], ("_x", "_y"))
        q = flat.withColumns({f"c{c}": F.lit(None).cast("double") for c in XYZ}).withColumnsRenamed({"_x": "pu", "_y": "pv"})
    q = q.join(k.select("trial", "width", "height"), "trial", "left")
    q = q.withColumn("inside", overlay.in_frame(F.col("pu"), F.col("pv"), F.col("width"), F.col("height"))).drop("width", "height")
    share = q.groupBy("trial").agg(F.count(F.lit(1)).alias("n"), F.count_if("inside").alias("n_inside"))
    report = share.join(camera.depth_report(q.where("cz is not null"), ["trial"]), "trial", "left")
    known = calib.select("trial").distinct().withColumn("_cal", F.lit(True))
    report = markers.select("trial").distinct().join(report, "trial", "left").join(known, "trial", "left")
    reason = F.when(F.col("_cal").isNull(), "no calibration").when(F.col("n").isNull(), "no video times").when(F.lit(mode == "perspective") & F.col("median_z").isNull(), "no marker at the video times")
    return q, report.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "ok").otherwise("failed")).drop("_cal")


def overlay_geometry(points: DataFrame, edges: DataFrame, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(points, segments) in pixels. ``points``: trial, frame, k, joint, x, y, z, u,
    v; metric points are placed by the affine map fitted to the frame's pixels, and
    orthographically in frames without enough pixels."""
    key = ["trial", "frame"]
    fit = align.affine_3d_to_2d(points, key)
    d = points.join(fit.select(*key, "M"), key, "left")
    one = [F.col("x"), F.col("y"), F.col("z"), F.lit(1.0)]
    aff = [sum((one[i] * F.col("M")[2 * i + j] for i in range(4)), F.lit(0.0)) for j in range(2)]
    d = overlay.place_orthographic(d, key, 200.0)
    d = d.select("trial", "frame", "k", "joint", F.coalesce(aff[0], F.col("pu")).alias("u"), F.coalesce(aff[1], F.col("pv")).alias("v"),
                 F.col("M").isNotNull().alias("fitted"))
    return d, overlay.segments(d, edges, key, width, height)


def plan_crops(
    detections: DataFrame, boxes: DataFrame, width: int, height: int, score_threshold: float = 0.3, every: int = 8
) -> DataFrame:
    """The crop of every frame: a chosen detection, else the previous keypoint box,
    else the centre crop. ``boxes``: trial, frame, box (NULL without a person)."""
    prev = tracking.previous_box(boxes, ["trial"], "frame", "box").select("trial", "frame", "prev")
    usable = tracking.usable_detections(detections, score_threshold, every)
    det = tracking.pick_detection(usable, prev, ["trial", "frame"])
    det = det.select("trial", "frame", F.struct(*tracking.BOX).alias("det_box"))
    d = prev.join(det, ["trial", "frame"], "left")
    crop = tracking.center_crop(F.lit(height), F.lit(width))
    fallback = F.struct(*[c.cast("double").alias(n) for c, n in zip(crop, tracking.BOX)])
    source: Column = F.when(F.col("det_box").isNotNull(), "detector").when(F.col("prev").isNotNull(), "tracker").otherwise("center")
    return d.select("trial", "frame", source.alias("source"), F.coalesce("det_box", "prev", fallback).alias("crop"))


__all__ = [
    "harmonise_subjects", "metric_scaling", "absolute_placement", "canonicalise", "downsample_mocap", "trial_accuracy",
    "frame_accuracy", "predicted_joints", "mocap_joints", "enhanced_accuracy", "still_phases", "model_readiness", "projection_audit", "overlay_geometry",
    "plan_crops", "write_markers", "write_accuracy", "with_rate",
]
