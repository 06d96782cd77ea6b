"""Centring, synthetic joints and the body frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.operators import series


def joint_in_frame(joint: str, coord: str, frame_keys: Sequence[str]) -> Column:
    """The coordinate of one joint, seen by all rows of its frame. A frame holds
    at most one row per joint of the dictionary, so the window is tiny."""
    w = W.partitionBy(*frame_keys)
    return F.max(F.when(F.col("joint") == joint, F.col(coord))).over(w)


def center_on_pelvis(
    df: DataFrame,
    frame_keys: Sequence[str],
    sides: Sequence[Sequence[str]] = (("x", "y", "z"),),
    left: str = "left_hip",
    right: str = "right_hip",
    when_missing: str = "null",
) -> DataFrame:
    """Subtract the mid-hip of the frame from every coordinate.

    Without a complete pelvis the frame becomes NULL (``when_missing='null'``)
    or stays as it is (``'keep'``)."""
    cols = [c for side in sides for c in side]
    d = df
    for c in cols:
        mid = (joint_in_frame(left, c, frame_keys) + joint_in_frame(right, c, frame_keys)) * 0.5
        d = d.withColumn(f"_p_{c}", mid)
    for side in sides:
        whole = F.lit(True)
        for c in side:
            whole = whole & F.col(f"_p_{c}").isNotNull()
        for c in side:
            moved = F.when(whole, F.col(c) - F.col(f"_p_{c}"))
            d = d.withColumn(f"_n_{c}", moved if when_missing == "null" else F.coalesce(moved, F.col(c)))
    keep = [F.col(f"_n_{c}").alias(c) if c in cols else F.col(c) for c in df.columns]
    return d.select(*keep)


def center_by_support(
    df: DataFrame, keys: Sequence[str], frame_keys: Sequence[str], pairs: Sequence[tuple[str, str]], sides: Sequence[Sequence[str]] = (("x", "y", "z"),)
) -> DataFrame:
    """Centre every frame on the midpoint of a joint pair chosen per key: the pair that is
    complete in most frames, earlier pairs winning ties; keys in which no pair ever is
    are centred on the mean of the frame's points. Frames without the chosen pair
    become NULL."""
    keys, cols = list(keys), [c for side in sides for c in side]
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    seen = [F.bool_or(whole & (F.col("joint") == j)).alias(f"_{k}{i}") for k, pair in enumerate(pairs) for i, j in enumerate(pair)]
    per_frame = df.groupBy(*frame_keys).agg(*seen)
    counts = per_frame.groupBy(*keys).agg(*[F.count_if(F.col(f"_{k}0") & F.col(f"_{k}1")).alias(f"_n{k}") for k in range(len(pairs))])
    most = F.greatest(F.lit(0), *[F.col(f"_n{k}") for k in range(len(pairs))])
    anchor = F.lit(len(pairs))
    for k in reversed(range(len(pairs))):
        anchor = F.when((F.col(f"_n{k}") == most) & (most > 0), k).otherwise(anchor)
    d = df.join(counts.select(*keys, anchor.alias("_anchor")), keys)
    out = center_on_centroid(d.where(F.col("_anchor") == len(pairs)), frame_keys, cols)
    for k, (left, right) in enumerate(pairs):
        out = out.unionByName(center_on_pelvis(d.where(F.col("_anchor") == k), frame_keys, sides, left, right))
    return out.drop("_anchor")


def center_on_marker(
    df: DataFrame, frame_keys: Sequence[str], marker: str, coords: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """Subtract one reference joint of the frame."""
    ref = {c: F.col(c) - joint_in_frame(marker, c, frame_keys) for c in coords}
    return df.select(*[ref[c].alias(c) if c in ref else F.col(c) for c in df.columns])


def center_on_centroid(
    df: DataFrame, frame_keys: Sequence[str], coords: Sequence[str] = ("x", "y", "z")
) -> DataFrame:
    """Subtract the mean of the frame's present points."""
    w = W.partitionBy(*frame_keys)
    new = {c: F.col(c) - F.avg(c).over(w) for c in coords}
    return df.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def synthetic_joint(
    df: DataFrame, frame_keys: Sequence[str], name: str, left: str, right: str, **const: Column
) -> DataFrame:
    """One row per frame: midpoint of two joints, NULL if either is incomplete."""
    pick = lambda j, c: F.max(F.when(F.col("joint") == j, F.col(c)))
    agg = df.where(F.col("joint").isin(left, right)).groupBy(*frame_keys).agg(
        *[pick(left, c).alias(f"_l{c}") for c in "xyz"], *[pick(right, c).alias(f"_r{c}") for c in "xyz"]
    )
    whole = F.lit(True)
    for c in "xyz":
        whole = whole & F.col(f"_l{c}").isNotNull() & F.col(f"_r{c}").isNotNull()
    return agg.select(
        *frame_keys,
        F.lit(name).alias("joint"),
        *[F.when(whole, 0.5 * (F.col(f"_l{c}") + F.col(f"_r{c}"))).alias(c) for c in "xyz"],
    )


def point_of(kp: str, index: int) -> list[Column]:
    """x, y, z of entry ``index`` of a ``kp`` array; NULL beyond its end."""
    p = F.get(F.col(kp), F.lit(index))
    return [p[c] for c in "xyz"]


def _stage_unit(df: DataFrame, raw: Sequence[Column], name: str, eps: float = 1e-8) -> DataFrame:
    """Columns name_0..2 with the unit vector of ``raw``; zero stays zero. Staged
    in steps so that no expression is repeated inside the next."""
    d = df.withColumns({f"_{name}_{i}": c for i, c in enumerate(raw)})
    v = [F.col(f"_{name}_{i}") for i in range(3)]
    d = d.withColumn(f"_{name}_n", G.norm(v))
    n = F.col(f"_{name}_n")
    return d.withColumns({f"{name}_{i}": F.when(n > eps, c / n).when(n.isNotNull(), c * 0.0) for i, c in enumerate(v)})


def add_body_frame(df: DataFrame, kp: str, joints: dict[str, int]) -> DataFrame:
    """Frame layout in, plus ``center`` (mid-hip) and ``axes`` (nine values).

    The rows of ``axes`` are forward, up and right: up points from the hips to
    the neck, right from the left to the right hip; forward and right are made
    orthogonal again. ``joints`` maps left/right shoulder and hip to positions
    in the array. Both results are NULL when one of these points is incomplete."""
    d = df
    for n, i in joints.items():
        d = d.withColumns({f"_{n}_{c}": p for c, p in zip("xyz", point_of(kp, i))})
    get = lambda n: [F.col(f"_{n}_{c}") for c in "xyz"]
    for name, a, b in (("neck", "left_shoulder", "right_shoulder"), ("mid", "left_hip", "right_hip")):
        d = d.withColumns({f"_{name}_{c}": m for c, m in zip("xyz", G.midpoint(get(a), get(b)))})
    unit = lambda n: [F.col(f"{n}_{i}") for i in range(3)]
    d = _stage_unit(d, G.sub(get("neck"), get("mid")), "_up")
    d = _stage_unit(d, G.sub(get("right_hip"), get("left_hip")), "_side")
    d = _stage_unit(d, G.cross(unit("_up"), unit("_side")), "_fwd")
    d = _stage_unit(d, G.cross(unit("_fwd"), unit("_up")), "_right")
    whole = F.lit(True)
    for c in [*get("neck"), *get("mid")]:
        whole = whole & c.isNotNull()
    axes = F.when(whole, F.array(*unit("_fwd"), *unit("_up"), *unit("_right"))).alias("axes")
    return d.select(*df.columns, F.when(whole, F.array(*get("mid"))).alias("center"), axes)


def first_valid(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Replace ``column`` by the trial's first non-null value, kept only on rows
    that had a value of their own."""
    first = F.min_by(F.col(column), F.when(F.col(column).isNotNull(), F.col(order))).alias("_first")
    d = series.per_key(df, keys, first)
    new = F.when(F.col(column).isNotNull(), F.col("_first")).alias(column)
    return d.select(*[new if c == column else F.col(c) for c in df.columns])


def canonical_points(df: DataFrame, kp: str = "kp") -> DataFrame:
    """Long rows with centred (cx, cy, cz) and body-frame (bx, by, bz) points,
    from rows carrying ``center`` and ``axes``."""
    base = [c for c in df.columns if c not in (kp, "center", "axes")]
    d = df.select(*base, "center", "axes", F.inline(kp))
    d = d.select("*", *[(F.col(c) - F.col("center")[i]).alias(f"c{c}") for i, c in enumerate("xyz")])
    ax = G.elements(F.col("axes"))
    body = G.mat_vec(ax, [F.col("cx"), F.col("cy"), F.col("cz")])
    return d.select("*", *[b.alias(f"b{c}") for b, c in zip(body, "xyz")]).drop("center", "axes")
