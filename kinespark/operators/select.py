"""Choosing trials, frames, persons and source columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.operators import series


def pick_trials(
    trials: DataFrame, subset: str = "all", ids: Sequence[str] | None = None, unknown: str = "empty"
) -> DataFrame:
    """Trials of one subset (``all`` keeps every subset), optionally by id.

    An unknown subset gives no rows; ``unknown='all'`` falls back, per subject,
    to all of its subsets."""
    d = trials
    if subset != "all":
        if unknown == "all":
            known = trials.groupBy("subject_id").agg(
                F.bool_or(F.col("subset") == subset).alias("_known")
            )
            d = d.join(known, "subject_id").where((F.col("subset") == subset) | ~F.col("_known")).drop("_known")
        else:
            d = d.where(F.col("subset") == subset)
    if ids is not None:
        d = d.where(F.col("id").isin(list(ids)))
    return d


def find_trial(trials: DataFrame, trial_id: str) -> DataFrame:
    """One trial per subject: the first match across its subsets."""
    w = W.partitionBy("subject_id").orderBy("subset_pos", "trial_pos")
    d = trials.where(F.col("id") == trial_id)
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def every_nth(frame: str, n: int) -> Column:
    return F.col(frame) % max(1, n) == 0


def timestamp(media_ms: Column, frame: Column, fps: Column) -> Column:
    """Media time when it is known and positive, else frame over rate."""
    return F.coalesce(F.when(~F.isnan(media_ms) & (media_ms > 0), media_ms / 1000.0), frame / fps)


def frame_rate(manifest: Column, file: Column, default: float = 60.0) -> Column:
    """Rate from the manifest unless it says ``auto``; an unusable file rate
    becomes the default."""
    named = F.when(F.lower(manifest) != "auto", manifest.try_cast("double"))
    ok = F.when(~F.isnan(file) & (file > 0), file)
    return F.coalesce(named, ok, F.lit(default))


def at_least(persons: Column, score: float) -> Column:
    """Persons at or above a score; an absent score counts as 1."""
    return F.filter(persons, lambda p: F.coalesce(p["mean_score"], F.lit(1.0)) >= score)


def best_index(persons: Column) -> Column:
    """Position of the best person, first on ties; an absent score counts as 0."""
    ranked = F.transform(
        persons,
        lambda p, i: F.struct(F.coalesce(p["mean_score"], F.lit(0.0)).alias("s"), (-i).alias("i")),
    )
    return -F.array_max(ranked)["i"]


def choose_person(persons: Column, index: int = -1) -> Column:
    """The best person (-1), or the one at an index clamped to the list."""
    if index == -1:
        return F.get(persons, best_index(persons))
    i = F.least(F.greatest(F.lit(index), F.lit(0)), F.size(persons) - 1)
    return F.get(persons, i)


def well_formed(points: Column, expect: int | None = None) -> Column:
    """True for K triples, and K as expected when given."""
    ok = points.isNotNull() & F.forall(points, lambda p: F.size(p) == 3)
    return ok & (F.size(points) == expect) if expect is not None else ok


def pick_source(p: Column, allow_raw: bool = False, prefer_raw: bool = False) -> Column:
    """struct(kp, source, is_mm) by priority: forced raw, metric, unit-tagged
    millimetres, allowed raw; NULL when nothing is accepted."""
    raw, mm = p["keypoints_xyz"], p["keypoints_xyz_mm"]
    tagged = F.lower(F.coalesce(p["keypoints_xyz_units"], F.lit(""))) == "mm"
    out = lambda kp, s, b: F.struct(kp.alias("kp"), F.lit(s).alias("source"), F.lit(b).alias("is_mm"))
    as_mm = out(raw, "keypoints_xyz (units=mm)", True)
    as_raw = out(raw, "keypoints_xyz (RAW units)", False)
    w = None
    rules = []
    if prefer_raw:
        rules += [(raw.isNotNull() & tagged, as_mm), (raw.isNotNull(), as_raw)]
    rules += [(mm.isNotNull(), out(mm, "keypoints_xyz_mm", True)), (raw.isNotNull() & tagged, as_mm)]
    if allow_raw:
        rules += [(raw.isNotNull(), as_raw)]
    for cond, val in rules:
        w = F.when(cond, val) if w is None else w.when(cond, val)
    return w


def mean_scores(scores: Column) -> Column:
    """Mean of the finite values of an array; NULL when there are none."""
    ok = F.filter(scores, lambda s: s.isNotNull() & ~F.isnan(s))
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, s: a + s) / F.size(ok))


def support_gate(df: DataFrame, keys: Sequence[str], valid: Column, minimum: int, reason: str) -> DataFrame:
    """One row per group: count, ``status`` ok or failed, and the reason."""
    g = df.groupBy(*keys).agg(F.count_if(valid).alias("n_valid"))
    ok = F.col("n_valid") >= minimum
    return g.select(
        *keys, "n_valid",
        F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(~ok, F.lit(reason)).alias("reason"),
    )


def by_pattern(column: str, include: str | None = None, exclude: str | None = None) -> Column:
    """Case-insensitive regular expressions, include first."""
    ok = F.lit(True)
    if include:
        ok = ok & F.col(column).rlike("(?i)" + include)
    if exclude:
        ok = ok & ~F.col(column).rlike("(?i)" + exclude)
    return ok


def by_suffix(df: DataFrame, keys: Sequence[str], column: str, suffix: str) -> DataFrame:
    """Rows whose name ends in ``suffix``; groups without any keep all rows."""
    hit = F.col(column).endswith(suffix)
    d = series.per_key(df, keys, F.bool_or(hit).alias("_any"))
    return d.where(hit | ~F.col("_any")).drop("_any")


def zero_as_missing(df: DataFrame, coords: Sequence[str] = ("x", "y", "z"), mode: str = "triplet") -> DataFrame:
    """Zeros as NULL: whole all-zero triplets, or each zero cell."""
    if mode == "cell":
        new = {c: F.nullif(F.col(c), F.lit(0.0)) for c in coords}
    else:
        zero = F.lit(True)
        for c in coords:
            zero = zero & (F.coalesce(F.col(c), F.lit(1.0)) == 0.0)
        new = {c: F.when(~zero, F.col(c)) for c in coords}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def trim_trailing_missing(
    df: DataFrame, keys: Sequence[str], frame: str, coords: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """Drop the frames behind the last one with any value."""
    any_ok = F.lit(False)
    for c in coords:
        any_ok = any_ok | F.col(c).isNotNull()
    d = series.per_key(df, keys, F.max(F.when(any_ok, F.col(frame))).alias("_last"))
    return d.where(F.col(frame) <= F.col("_last")).drop("_last")


def overlap(df: DataFrame, other: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    """Rows whose time lies inside the other series' range."""
    r = other.groupBy(*keys).agg(F.min(t).alias("_t0"), F.max(t).alias("_t1"))
    return df.join(r, list(keys)).where(F.col(t).between(F.col("_t0"), F.col("_t1"))).drop("_t0", "_t1")


def keypoint_names(info_map: Column, info_list: Column, id2name: Column, names: Column) -> Column:
    """Keypoint names in id order from whichever form the metadata has."""
    ordered = lambda a: F.transform(
        F.array_sort(F.transform(a, lambda e: F.struct(e["id"].alias("id"), e["name"].alias("name")))),
        lambda e: e["name"],
    )
    return F.coalesce(ordered(F.map_values(info_map)), ordered(info_list), id2name, names)


def first_frames(df: DataFrame, keys: Sequence[str], frame: str, n: int) -> DataFrame:
    """The first ``n`` distinct frames of each trial as a sample.

    Per task only the ``n`` smallest frames survive the map-side aggregate."""
    order = df.select(*keys, frame).distinct()
    w = W.partitionBy(*keys, "_blk").orderBy(frame)
    top = order.withColumn("_blk", series.block_of(frame, series.FRAMES_PER_BLOCK))
    top = top.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    final = W.partitionBy(*keys).orderBy("_blk", "_r")
    sizes = top.groupBy(*keys, "_blk").agg(F.count(F.lit(1)).alias("_c"))
    before = W.partitionBy(*keys).orderBy("_blk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_blk", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    kept = top.join(sizes.where(F.col("_off") < n), [*keys, "_blk"]).where(F.col("_off") + F.col("_r") <= n)
    return df.join(kept.select(*keys, frame), [*keys, frame], "left_semi")


def middle_frame(df: DataFrame, keys: Sequence[str], frame: str) -> DataFrame:
    """The frame at half the frame count of each trial."""
    d = series.per_key(df, keys, F.count(F.lit(1)).alias("_n"))
    return d.where(F.col(frame) == F.floor(F.col("_n") / 2)).drop("_n")


def support_counts(df: DataFrame, keys: Sequence[str], frame: str, joint: str, valid: Column) -> DataFrame:
    """keys, frames_in, frames_out (frames with a valid point), valid_points, joints: what a
    conversion has read and kept."""
    keys = list(keys)
    frames = df.groupBy(*keys, frame).agg(F.count_if(valid).alias("_v"))
    frames = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames_in"), F.count_if(F.col("_v") > 0).alias("frames_out"), F.sum("_v").alias("valid_points"))
    joints = df.select(*keys, joint).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("joints"))
    return frames.join(joints, keys)


def pad_to_longest(df: DataFrame, keys: Sequence[str], array: str, name: str) -> DataFrame:
    """Arrays of a key brought to the length ``name`` of its longest one, NULL behind their own end."""
    d = series.per_key(df, list(keys), F.max(F.size(array)).cast("long").alias(name))
    places = F.when(F.col(name) > 0, F.sequence(F.lit(0), (F.col(name) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return d.withColumn(array, F.transform(places, lambda i: F.get(array, i)))
