"""Image-plane geometry of a frame: axes, spread, placement, skeleton segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.functions import geometry as G


def principal_angle(
    df: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x", "y")
) -> DataFrame:
    """Angle of the larger principal axis against the first coordinate."""
    a, b = coords
    return df.groupBy(*keys).agg(
        (0.5 * F.atan2(2 * F.covar_pop(a, b), F.var_pop(a) - F.var_pop(b))).alias("angle")
    )


def pair_distances(points: Column) -> Column:
    """Distances of all pairs i < j of one frame's points, as one array.

    Works inside the row, on the at most K points of the joint dictionary, and
    is meant to be reduced at once (see :func:`pair_summary`)."""
    n = F.size(points)
    each = F.transform(
        points,
        lambda p, i: F.transform(
            F.slice(points, i + 2, F.greatest(n - i - 1, F.lit(0))),
            lambda q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])),
        ),
    )
    return F.flatten(each)


def median_of(values: Column) -> Column:
    """Median of an array, linear between the middle two."""
    s, n = F.array_sort(values), F.size(values)
    lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, lo + (hi - lo) * 0.5)


def frame_points(df: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x", "y")) -> DataFrame:
    """Long to frame layout: present points of each frame in joint order."""
    ok = F.col(coords[0]).isNotNull() & F.col(coords[1]).isNotNull()
    pt = F.struct("k", F.col(coords[0]).alias("x"), F.col(coords[1]).alias("y"))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(ok, pt))).alias("pts"))


def pair_summary(df: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x", "y")) -> DataFrame:
    """Per frame: number, sum, extremes and median of the pairwise distances."""
    d = frame_points(df, keys, coords).withColumn("_d", pair_distances(F.col("pts")))
    return d.select(
        *keys,
        F.size("_d").cast("long").alias("n_pairs"),
        F.aggregate("_d", F.lit(0.0), lambda a, v: a + v).alias("total"),
        F.array_min("_d").alias("shortest"),
        F.array_max("_d").alias("longest"),
        median_of(F.col("_d")).alias("median"),
    )


def place_orthographic(
    df: DataFrame,
    keys: Sequence[str],
    target: float,
    origin: tuple[float, float] = (0.0, 0.0),
    coords: Sequence[str] = ("x", "y"),
) -> DataFrame:
    """Centre on the centroid and scale so that the median pairwise distance
    becomes ``target`` pixels (scale 1 below two points); adds pu, pv."""
    med = pair_summary(df, keys, coords).select(*keys, "median")
    w = W.partitionBy(*keys)
    d = df.join(med, list(keys)).withColumn(
        "_s", F.when(F.col("median").isNotNull(), target / (F.col("median") + 1e-6)).otherwise(F.lit(1.0))
    )
    out = [
        ((F.col(c) - F.avg(c).over(w)) * F.col("_s") + F.lit(o)).alias(n)
        for c, o, n in zip(coords, origin, ("pu", "pv"))
    ]
    return d.select(*df.columns, *out)


def fit_to_canvas(
    df: DataFrame,
    keys: Sequence[str],
    width: int,
    height: int,
    small_span: float = 50.0,
    fill: float = 0.65,
    target: tuple[float, float] = (0.4, 0.6),
    angle_deg: float | None = None,
    auto_angle: str = "pca",
    coords: Sequence[str] = ("u", "v"),
) -> DataFrame:
    """Scale small figures up, turn the principal axis upright (or by a given
    angle) and move the centroid to a fixed place of the canvas; adds pu, pv.
    Frames with fewer than two points are left alone."""
    u, v = coords
    ok = F.col(u).isNotNull() & F.col(v).isNotNull()
    uu, vv = F.when(ok, F.col(u)), F.when(ok, F.col(v))
    a = df.groupBy(*keys).agg(
        F.count_if(ok).alias("_n"), F.avg(uu).alias("_mu"), F.avg(vv).alias("_mv"),
        F.greatest(F.max(uu) - F.min(uu), F.max(vv) - F.min(vv)).alias("_span"),
        F.covar_pop(uu, vv).alias("_cuv"), F.var_pop(uu).alias("_cuu"), F.var_pop(vv).alias("_cvv"),
    )
    if angle_deg is not None:
        theta = F.radians(F.lit(angle_deg))
    elif auto_angle == "pca":
        # principal axis (cos p, sin p) turned onto +v
        p = 0.5 * F.atan2(2 * F.col("_cuv"), F.col("_cuu") - F.col("_cvv"))
        theta = -F.atan2(F.cos(p), F.sin(p))
    else:
        theta = F.lit(0.0)
    grow = F.when((F.col("_span") > 0) & (F.col("_span") < small_span), fill * min(width, height) / F.col("_span"))
    a = a.withColumn("_theta", theta).withColumn("_g", F.coalesce(grow, F.lit(1.0)))
    d = df.join(a, list(keys))
    du, dv = (F.col(u) - F.col("_mu")) * F.col("_g"), (F.col(v) - F.col("_mv")) * F.col("_g")
    c, s = F.cos("_theta"), F.sin("_theta")
    few = F.col("_n") < 2
    return d.select(
        *df.columns,
        F.when(few, F.col(u)).otherwise(c * du - s * dv + width * target[0]).alias("pu"),
        F.when(few, F.col(v)).otherwise(s * du + c * dv + height * target[1]).alias("pv"),
    )


def segments(
    df: DataFrame, edges: DataFrame, keys: Sequence[str], width: int, height: int,
    coords: Sequence[str] = ("u", "v"),
) -> DataFrame:
    """Skeleton segments whose ends are both present and at least one of them,
    rounded to a pixel, lies inside the image."""
    u, v = coords
    pts = df.where(F.col(u).isNotNull() & F.col(v).isNotNull()).select(*keys, "joint", u, v)
    end = lambda n: pts.select(*keys, F.col("joint").alias(n), F.col(u).alias(f"u_{n}"), F.col(v).alias(f"v_{n}"))
    d = end("a").join(edges, "a").join(end("b"), [*keys, "b"])
    inside = lambda n: F.round(f"u_{n}").between(0, width - 1) & F.round(f"v_{n}").between(0, height - 1)
    d = d.where(inside("a") | inside("b"))
    length = G.distance([F.col("u_a"), F.col("v_a")], [F.col("u_b"), F.col("v_b")])
    return d.select(*keys, "a", "b", "u_a", "v_a", "u_b", "v_b", length.alias("length"))


def in_frame(u: Column, v: Column, width: Column | int, height: Column | int) -> Column:
    return u.isNotNull() & v.isNotNull() & (u >= 0) & (u < width) & (v >= 0) & (v < height)
