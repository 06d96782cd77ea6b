"""Calibration lookups, projection, undistortion and placement.

Points are long rows (trial, frame, ..., x, y, z); calibrations are one row per
trial with K, dist, R, t arrays and the image size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.operators import select
from kinespark.operators.stats import exact_percentiles
from kinespark.session import materialise

XYZ = ("x", "y", "z")


def _k(name: str = "K") -> list[Column]:
    return G.elements(F.col(name))


def to_camera(df: DataFrame, calib: DataFrame, on: Sequence[str] = ("trial",), r: str = "R", t: str = "t") -> DataFrame:
    """Add cx, cy, cz = R p + t; NULL without a calibration."""
    d = df.join(calib.select(*on, F.col(r).alias("_R"), F.col(t).alias("_t")), list(on), "left")
    p = G.mat_vec(G.elements(F.col("_R")), [F.col(c) for c in XYZ])
    return d.select(*df.columns, *[(c + F.col("_t")[i]).alias(f"c{n}") for i, (c, n) in enumerate(zip(p, XYZ))])


def to_world(df: DataFrame, calib: DataFrame, on: Sequence[str] = ("trial",)) -> DataFrame:
    """Camera to world with the inverted world-to-camera extrinsics."""
    inv = invert_calibration(calib, on)
    d = to_camera(df, inv, on)
    return d.withColumnsRenamed({f"c{n}": f"w{n}" for n in XYZ})


def invert_calibration(calib: DataFrame, on: Sequence[str] = ("trial",)) -> DataFrame:
    r, t = G.invert_extrinsics(G.elements(F.col("R")), G.elements(F.col("t"), 3))
    return calib.select(*on, F.array(*r).alias("R"), F.array(*t).alias("t"))


def project(
    df: DataFrame, calib: DataFrame, on: Sequence[str] = ("trial",), coords: Sequence[str] = ("cx", "cy", "cz"),
    distortion: bool = True,
) -> DataFrame:
    """Add pixel coordinates pu, pv of camera-frame points; NULL without a calibration."""
    d = df.join(calib.select(*on, F.col("K").alias("_K"), F.col("dist").alias("_D")), list(on), "left")
    dist = G.elements(F.col("_D"), 5) if distortion else None
    u, v = G.project(*[F.col(c) for c in coords], _k("_K"), dist)
    return d.select(*df.columns, u.alias("pu"), v.alias("pv"))


def undistort(
    df: DataFrame, calib: DataFrame, on: Sequence[str] = ("trial",), uv: Sequence[str] = ("u", "v"), rounds: int = 5
) -> DataFrame:
    """Add undistorted pixel coordinates uu, uv; NULL without a calibration."""
    d = df.join(calib.select(*on, F.col("K").alias("_K"), F.col("dist").alias("_D")), list(on), "left")
    d = d.withColumn("_o", G.undistort(F.col(uv[0]), F.col(uv[1]), _k("_K"), F.col("_D"), rounds))
    return d.select(*df.columns, F.col("_o.u").alias("uu"), F.col("_o.v").alias("uv"))


def undistort_decision(
    df: DataFrame, calib: DataFrame, frame: str = "frame", n_frames: int | None = None, threshold: float = 0.1
) -> DataFrame:
    """Per trial: median shift by undistortion over all frames (or the first
    ``n_frames``), and whether it reaches the threshold."""
    some = df if n_frames is None else select.first_frames(df, ["trial"], frame, n_frames)
    d = materialise(undistort(some, calib), "sample")
    d = d.withColumn("_d", G.distance([F.col("uu"), F.col("uv")], [F.col("u"), F.col("v")]))
    q = exact_percentiles(d, ["trial"], "_d", {"median_shift": 0.5})
    return q.select("trial", "median_shift", (F.col("median_shift") >= threshold).alias("undistort"))


def place_with_rotation(
    df: DataFrame, calib: DataFrame, keys: Sequence[str], on: Sequence[str] = ("trial",), min_points: int = 6
) -> DataFrame:
    """Camera translation per group for a known rotation, by linear least squares.

    Each point gives tx - a tz = p and ty - b tz = q with (a, b) its normalised
    image point; the normal equations are closed form in a few sums. Groups with
    fewer than ``min_points`` complete points, or without a calibration, get NULL."""
    whole = F.col("_K").isNotNull() & F.col("_R").isNotNull()
    for c in (*XYZ, "u", "v"):
        whole = whole & F.col(c).isNotNull()
    d = df.join(calib.select(*on, F.col("K").alias("_K"), F.col("R").alias("_R")), list(on), "left")
    k = _k("_K")
    rx, ry, rz = G.mat_vec(G.elements(F.col("_R")), [F.col(c) for c in XYZ])
    good = lambda c, n: F.when(whole, c).alias(n)
    d = d.select(
        *keys, good((F.col("u") - k[2]) / k[0], "a"), good((F.col("v") - k[5]) / k[4], "b"),
        good(rx, "rx"), good(ry, "ry"), good(rz, "rz"),
    )
    d = d.withColumn("p", F.col("a") * F.col("rz") - F.col("rx")).withColumn("q", F.col("b") * F.col("rz") - F.col("ry"))
    s = d.groupBy(*keys).agg(
        F.count("a").alias("n"), F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum("p").alias("sp"), F.sum("q").alias("sq"),
        F.sum(F.col("a") * F.col("a") + F.col("b") * F.col("b")).alias("saa"),
        F.sum(F.col("a") * F.col("p") + F.col("b") * F.col("q")).alias("sap"),
    )
    n = F.col("n")
    num = (F.col("sa") * F.col("sp") + F.col("sb") * F.col("sq")) / n - F.col("sap")
    den = F.col("saa") - (F.col("sa") * F.col("sa") + F.col("sb") * F.col("sb")) / n
    s = s.withColumn("tz", F.when((n >= min_points) & (F.abs(den) > 1e-15), num / den))
    return s.select(
        *keys, "n",
        ((F.col("sp") + F.col("tz") * F.col("sa")) / n).alias("tx"),
        ((F.col("sq") + F.col("tz") * F.col("sb")) / n).alias("ty"), "tz",
    )


def reprojection_rmse(df: DataFrame, keys: Sequence[str], uv=("u", "v"), puv=("pu", "pv")) -> DataFrame:
    du, dv = F.col(puv[0]) - F.col(uv[0]), F.col(puv[1]) - F.col(uv[1])
    return df.groupBy(*keys).agg(F.sqrt(F.avg(du * du + dv * dv)).alias("rmse_px"))


def depth_report(df: DataFrame, keys: Sequence[str], z: str = "cz", uv=("pu", "pv")) -> DataFrame:
    """Median depth, share behind the camera and pixel ranges."""
    med = exact_percentiles(df, keys, z, {"median_z": 0.5})
    g = df.groupBy(*keys).agg(
        F.avg(F.when(F.col(z).isNotNull(), (F.col(z) <= 0).cast("int"))).alias("behind"),
        *[f(c).alias(f"{n}_{c}") for c in uv for n, f in (("min", F.min), ("max", F.max))],
    )
    return med.select(*keys, "median_z").join(g, list(keys))


def rescale_intrinsics(k: Column, size: Column, width: Column, height: Column) -> Column:
    """Intrinsics for another image size. The stored size may be (w, h) or (h, w);
    the order with the smaller mismatch of scales and aspect wins."""

    def candidate(w0: Column, h0: Column) -> Column:
        sx, sy = width / w0, height / h0
        penalty = F.abs(sx - sy) + F.abs(width / height - w0 / h0)
        return F.struct(F.when((w0 > 0) & (h0 > 0), penalty).alias("penalty"), sx.alias("sx"), sy.alias("sy"))

    both = F.filter(F.array(candidate(size[0], size[1]), candidate(size[1], size[0])), lambda c: c["penalty"].isNotNull())
    best = F.array_min(both)
    change = (F.abs(best["sx"] - 1) > 1e-3) | (F.abs(best["sy"] - 1) > 1e-3)
    new = [k[i] * (best["sx"] if i in (0, 2) else best["sy"] if i in (4, 5) else 1.0) for i in range(9)]
    return F.when(change, F.array(*new)).otherwise(k)


def centered_principal_point(k: Column, width: Column, height: Column) -> Column:
    return F.array(*[width * 0.5 if i == 2 else height * 0.5 if i == 5 else k[i] for i in range(9)])


def synthetic_intrinsics(width: Column, height: Column, focal: Column | None = None) -> Column:
    f = F.greatest(width, height).cast("double") if focal is None else focal
    z, one = F.lit(0.0), F.lit(1.0)
    return F.array(f, z, width * 0.5, z, f, height * 0.5, z, z, one)


def synthetic_calibration(sizes: DataFrame, focal: float | None = None) -> DataFrame:
    """A calibration for trials that have none: (trial, width, height) with a centred camera of
    the given focal length in pixels (the longer side by default), no distortion, and
    identity extrinsics."""
    zeros = lambda n: F.array(*[F.lit(0.0)] * n)
    eye = F.array(*[F.lit(float(i % 4 == 0)) for i in range(9)])
    k = synthetic_intrinsics(F.col("width"), F.col("height"), None if focal is None else F.lit(float(focal)))
    return sizes.select("trial", k.alias("K"), zeros(5).alias("dist"), eye.alias("R"), zeros(3).alias("t"), "width", "height")


def translation_mm(t: Column, unit: Column | None = None, below: float = 5.0) -> Column:
    """Translation in millimetres: by its unit when known, else metres are
    assumed for norms under ``below``."""
    n = F.sqrt(t[0] * t[0] + t[1] * t[1] + t[2] * t[2])
    unit = unit if unit is not None else F.lit(None).cast("string")
    metres = F.coalesce(unit == "m", (n > 1e-6) & (n < below))
    return F.when(metres, F.transform(t, lambda c: c * 1000.0)).otherwise(t)


def axis_candidates(df: DataFrame, keys: Sequence[str], penalty: str, value: str) -> DataFrame:
    """The candidate with the smallest penalty per key, first on ties."""
    return df.groupBy(*keys).agg(F.min_by(F.col(value), F.struct(penalty, value)).alias(value))


def smooth_translation(df: DataFrame, keys: Sequence[str], frame: str, alpha: float) -> DataFrame:
    """Exponential average of (tx, ty, tz) over solved frames."""
    from kinespark.operators.smooth import exponential_over_solved

    if alpha <= 0:
        return df
    return exponential_over_solved(df, keys, frame, ["tx", "ty", "tz"], alpha)


def out_of_image(df: DataFrame, calib: DataFrame) -> DataFrame:
    """Trials with keypoints more than a pixel outside their image; NULL without an image size."""
    d = df.join(calib.select("trial", "width", "height"), "trial", "left")
    u, v = F.col("u"), F.col("v")
    out = (u < -1) | (u > F.col("width") + 1) | (v < -1) | (v > F.col("height") + 1)
    return d.groupBy("trial").agg(F.bool_or(out).alias("out_of_image"))


