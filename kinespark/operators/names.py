"""Resolving joints and markers by name.

Name tables are small per trial (one row per marker), so all matching happens on
distinct (trial, name) rows; the long data is only joined once to the outcome.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.functions import text
from kinespark.functions.dims import (
    BODY_LAYOUT_INDEX,
    BODY20, NATIVE_SYNONYMS, STUDY_TO_MOCAP, alias_rows, literal_table,
)


def joint_indices(dictionary: DataFrame, requested: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing) of requested (trial, ord, name) in a (trial, idx, name) dictionary."""
    found = requested.join(dictionary, ["trial", "name"])
    missing = requested.join(dictionary, ["trial", "name"], "left_anti")
    return found, missing


def names_in(df: DataFrame, trial: str = "trial", marker: str = "marker") -> DataFrame:
    return df.select(trial, marker).distinct()


def resolve_aliases(
    present: DataFrame, aliases: DataFrame, normalise=F.lower, trial: str = "trial", marker: str = "marker"
) -> DataFrame:
    """(trial, target, marker): the first candidate present wins."""
    a = aliases.select("target", normalise(F.col("candidate")).alias("_n"), "priority")
    d = present.select(trial, marker, normalise(F.col(marker)).alias("_n")).join(a, "_n")
    w = W.partitionBy(trial, "target").orderBy("priority", F.col(marker).desc())
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(trial, "target", marker)


MIDPOINTS = {
    "neck": ("left_shoulder", "right_shoulder"),
    "mid_hip": ("left_hip", "right_hip"),
}


def joint_plan(
    present: DataFrame,
    single: dict[str, list[str]],
    pairs: dict[str, tuple[list[str], list[str]]] | None = None,
    midpoints: dict[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """(trial, joint, marker, w, parts): how each joint is averaged from markers.

    A joint is one marker (the first candidate present), the midpoint of a pair
    when the trial has both of its sides, or the midpoint of two other joints.
    Works on the (trial, marker) names only."""
    rows = [(t, "one", c, i) for t, cs in single.items() for i, c in enumerate(cs)]
    for t, (a, b) in (pairs or {}).items():
        rows += [(t, "a", c, i) for i, c in enumerate(a)] + [(t, "b", c, i) for i, c in enumerate(b)]
    dim = literal_table(present.sparkSession, ["target", "role", "candidate", "priority"], rows)
    a = dim.select("target", "role", F.lower("candidate").alias("_n"), "priority")
    d = present.select("trial", "marker", F.lower("marker").alias("_n")).join(a, "_n")
    best = d.groupBy("trial", "target", "role").agg(
        F.max_by("marker", F.struct(-F.col("priority"), F.col("marker"))).alias("marker")
    )
    role = lambda r: F.max(F.when(F.col("role") == r, F.col("marker"))).alias(r)
    j = best.groupBy("trial", F.col("target").alias("joint")).agg(role("one"), role("a"), role("b"))
    part = lambda c, w: F.struct(F.col(c).alias("marker"), F.lit(w).alias("w"))
    parts = F.when(
        F.col("a").isNotNull() & F.col("b").isNotNull(), F.array(part("a", 0.5), part("b", 0.5))
    ).when(F.col("one").isNotNull(), F.array(part("one", 1.0)))
    j = j.select("trial", "joint", parts.alias("ps")).where("ps is not null")
    if midpoints:
        mids = F.array(*[
            F.struct(F.lit(m).alias("mid"), F.lit(c).alias("child")) for m, cs in midpoints.items() for c in cs
        ])
        hit = F.filter(mids, lambda m: m["child"] == F.col("joint"))
        half = F.transform("ps", lambda p: F.struct(p["marker"].alias("marker"), (p["w"] * 0.5).alias("w")))
        m = j.select("trial", F.explode(hit).alias("m"), half.alias("ps")).groupBy(
            "trial", F.col("m.mid").alias("joint")
        ).agg(F.count(F.lit(1)).alias("_c"), F.flatten(F.collect_list("ps")).alias("ps"))
        j = j.unionByName(m.where("_c = 2").drop("_c"))
    return j.select("trial", "joint", F.size("ps").alias("parts"), F.inline("ps"))


def apply_plan(df: DataFrame, plan: DataFrame) -> DataFrame:
    """trial, frame, joint, x, y, z; NULL in frames where a part is incomplete."""
    d = df.join(plan, ["trial", "marker"])
    whole = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    g = d.groupBy("trial", "frame", "joint").agg(
        F.max("parts").alias("_p"), F.count_if(whole).alias("_n"),
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"],
    )
    return g.select("trial", "frame", "joint", *[F.when(F.col("_n") == F.col("_p"), F.col(c)).alias(c) for c in "xyz"])


def mean_targets(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """Joint as the mean of all its complete candidate markers in the frame."""
    a = aliases.select(F.col("target").alias("joint"), text.clean_name(F.col("candidate")).alias("_n")).distinct()
    # names are cleaned once each, not on every row
    known = df.select("marker").distinct().withColumn("_n", text.clean_name(F.col("marker"))).join(a, "_n").select("marker", "joint")
    d = df.join(known, "marker")
    ok = F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()
    return d.groupBy("trial", "frame", "joint").agg(
        *[F.avg(F.when(ok, F.col(c))).alias(c) for c in "xyz"]
    )


def basic_joints(
    df: DataFrame, aliases: dict[str, list[str]], centers: dict[str, tuple[list[str], list[str]]] | None = None
) -> DataFrame:
    """Joints by alias; those in ``centers`` are the midpoint of their medial and
    lateral markers wherever a trial has both."""
    return apply_plan(df, joint_plan(names_in(df), aliases, centers))


def assemble_body20(
    df: DataFrame,
    single: dict[str, list[str]],
    pairs: dict[str, tuple[list[str], list[str]]] | None = None,
    complete: bool = True,
) -> DataFrame:
    """The 20-joint body from named markers, neck and mid_hip included.

    ``complete`` drops trials that cannot supply all twenty joints; otherwise
    missing joints stay as NULL rows."""
    plan = joint_plan(names_in(df), single, pairs, MIDPOINTS)
    plan = plan.where(F.col("joint").isin(BODY20))
    if complete:
        return apply_plan(df, plan.join(complete_trials(plan, 20), "trial", "left_semi"))
    wanted = F.array(*[F.lit(j) for j in BODY20])
    frames = df.select("trial", "frame").distinct().select("*", F.posexplode(wanted).alias("ord", "joint"))
    return frames.join(apply_plan(df, plan), ["trial", "frame", "joint"], "left")


def body20_from_keypoints(df: DataFrame) -> DataFrame:
    """The 20-joint body from a keypoint table (``joint`` names); trials that
    lack one of the eighteen measured joints are dropped."""
    own = {j: [j] for j in BODY20 if j not in MIDPOINTS}
    return assemble_body20(df.withColumnRenamed("joint", "marker"), own)


def complete_trials(df: DataFrame, n_joints: int) -> DataFrame:
    """Trials that have ``n_joints`` different joints."""
    names = df.select("trial", "joint").distinct()
    return names.groupBy("trial").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n_joints).select("trial")


def native_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """One-to-one match of enhanced markers (trial, pos, marker) with mocap
    markers (trial, pos, marker): (trial, left_pos, left, right).

    Each left name takes its best candidate on the right; of several left names
    on the same right one, the first in left order keeps it."""
    spark = left.sparkSession
    syn = [(a, b, i + 1) for a, bs in NATIVE_SYNONYMS.items() for i, b in enumerate(bs)]
    syn = literal_table(spark, ["ln", "rn", "priority"], syn)
    first = W.partitionBy("trial", "rn").orderBy("right_pos")
    r = right.select("trial", F.col("pos").alias("right_pos"), F.col("marker").alias("right"),
                     text.native_name(F.col("marker")).alias("rn"))
    r = r.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    l = left.select("trial", F.col("pos").alias("left_pos"), F.col("marker").alias("left"),
                    text.native_name(F.col("marker")).alias("ln"))
    own = l.select("trial", "left_pos", "left", F.col("ln").alias("rn"), F.lit(0).alias("priority"))
    other = l.join(syn, "ln").select("trial", "left_pos", "left", "rn", "priority")
    d = own.unionByName(other).join(r, ["trial", "rn"])
    best = W.partitionBy("trial", "left_pos").orderBy("priority")
    d = d.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    once = W.partitionBy("trial", "right").orderBy("left_pos")
    d = d.withColumn("_q", F.row_number().over(once)).where("_q = 1")
    return d.select("trial", "left_pos", "left", "right")


def study_to_mocap(c: Column) -> Column:
    """Rename a study marker to its mocap name."""
    for old, new in STUDY_TO_MOCAP:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def by_priority(base: DataFrame, key: str, column: str, *sources: DataFrame) -> DataFrame:
    """Look ``column`` up per key in several tables; the first that has it wins."""
    d = base
    for i, s in enumerate(sources):
        d = d.join(s.select(key, F.col(column).alias(f"_s{i}")), key, "left")
    out = F.coalesce(*[F.col(f"_s{i}") for i in range(len(sources))])
    return d.select(*base.columns, out.alias(column))


def reorder(df: DataFrame, order: DataFrame) -> DataFrame:
    """Attach the other side's joint order (trial, joint, ord)."""
    return df.join(order, ["trial", "joint"])


def stack_parts(body: DataFrame, arms: DataFrame) -> DataFrame:
    """Body and arm markers together, only for trials whose parts have the same
    number of frames."""
    count = lambda d, n: d.select("trial", "frame").distinct().groupBy("trial").agg(F.count(F.lit(1)).alias(n))
    same = count(body, "_a").join(count(arms, "_b"), "trial").where("_a = _b").select("trial")
    return body.unionByName(arms).join(same, "trial", "left_semi")


def keep_first_label(labels: DataFrame, keys: Sequence[str], label: str, pos: str) -> DataFrame:
    """First of several labels that differ only in case or blanks."""
    w = W.partitionBy(*keys, "_n").orderBy(pos)
    d = labels.withColumn("_n", text.label_name(F.col(label)))
    return d.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "_n")


def side_index(names: DataFrame, side: str, joint: str, keys: Sequence[str] = ("trial",)) -> DataFrame:
    """Index of the left or right ``joint`` from names: a direct hit first, else
    the first name that contains the joint and the side."""
    s = side[0]
    n = text.canon_name(F.col("name"))
    rank = (
        F.when(n == f"{side}_{joint}", 0)
        .when(n == f"{s}_{joint}", 1)
        .when(n.contains(joint) & (n.startswith(f"{s}_") | n.contains(side)), 2)
    )
    d = names.withColumn("_rank", rank).where("_rank is not null")
    return d.groupBy(*keys).agg(F.min_by("idx", F.struct("_rank", "idx")).alias("idx"))


def side_index_or_guess(layouts: DataFrame, names: DataFrame, side: str, joint: str, keys: Sequence[str] = ("trial",)) -> DataFrame:
    """(keys, idx, guessed) for each layout (keys, n_points): :func:`side_index` where the names tell,
    else the body layout's place if it has 17 points or more, else NULL."""
    keys = list(keys)
    place = BODY_LAYOUT_INDEX.get(f"{side}_{joint}")
    guess = F.when(F.col("n_points") >= 17, F.lit(place)).cast("long")
    d = layouts.join(side_index(names, side, joint, keys).withColumnRenamed("idx", "_named"), keys, "left")
    return d.select(*keys, F.coalesce(F.col("_named").cast("long"), guess).alias("idx"), (F.col("_named").isNull() & guess.isNotNull()).alias("guessed"))
