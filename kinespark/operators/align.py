"""Rigid, similarity and affine fits from aggregated moments.

Points are reduced to co-moments per group by Spark's mergeable covariance
aggregates (stable even far from the origin, combined map side), so a fit over
a trial of any length ends in one small row before the SVD.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.functions.linalg import best_rotation, solve_normal_4x2
from kinespark.operators.errors import PRED, REF


def co_moments(
    df: DataFrame, keys: Sequence[str], a: Sequence[str] = PRED, b: Sequence[str] = REF
) -> DataFrame:
    """n, means, H (sum of centred a_i b_j) and sum of squares of a, per group,
    over rows in which all coordinates are present."""
    whole = F.lit(True)
    for c in [*a, *b]:
        whole = whole & F.col(c).isNotNull()
    n = F.count(F.lit(1))
    return (
        df.where(whole)
        .groupBy(*keys)
        .agg(
            n.alias("n"),
            F.array(*[F.avg(c) for c in a]).alias("mean_a"),
            F.array(*[F.avg(c) for c in b]).alias("mean_b"),
            F.array(*[n * F.covar_pop(p, q) for p in a for q in b]).alias("H"),
            F.array(*[n * F.var_pop(c) for c in a]).alias("_sq"),
        )
        .withColumn("ssa", F.col("_sq")[0] + F.col("_sq")[1] + F.col("_sq")[2])
        .drop("_sq")
    )


def fit(
    df: DataFrame,
    keys: Sequence[str],
    mode: str = "rigid",
    a: Sequence[str] = PRED,
    b: Sequence[str] = REF,
    signed_scale: bool = False,
    min_points: int = 3,
) -> DataFrame:
    """Per group: n, R (nine values), s, tr with b ~ s R a + tr.

    The scale is the plain sum of singular values over the variance; with
    ``signed_scale`` the smallest one is subtracted when a reflection was
    repaired. Groups below ``min_points`` get the identity."""
    m = co_moments(df, keys, a, b).withColumn("_f", best_rotation(F.col("H")))
    enough = F.col("n") >= min_points
    eye = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    sigma = F.col("_f.sigma_signed" if signed_scale else "_f.sigma")
    scale = sigma / (F.col("ssa") + 1e-12) if mode == "similarity" else F.lit(1.0)
    d = m.select(
        *keys,
        "n",
        F.when(enough, F.col("_f.R")).otherwise(eye).alias("R"),
        F.when(enough, scale).otherwise(F.lit(1.0)).alias("s"),
        "mean_a",
        "mean_b",
        enough.alias("_ok"),
    )
    moved = G.mat_vec(G.elements(F.col("R")), G.elements(F.col("mean_a"), 3))
    t = [F.when(F.col("_ok"), F.col("mean_b")[i] - F.col("s") * moved[i]).otherwise(F.lit(0.0)) for i in range(3)]
    return d.withColumn("tr", F.array(*t)).drop("mean_a", "mean_b", "_ok")


def apply_fit(
    df: DataFrame,
    fits: DataFrame,
    keys: Sequence[str],
    coords: Sequence[str] = PRED,
    scale: bool = True,
    rotate: bool = True,
    translate: bool = True,
    prefix: str = "a",
) -> DataFrame:
    """Add the transformed coordinates (prefix + name). Left join: groups without
    a fit keep NULL."""
    d = df.join(fits.select(*keys, "R", "s", "tr"), list(keys), "left")
    p = [F.col(c) for c in coords]
    q = G.mat_vec(G.elements(F.col("R")), p) if rotate else p
    if scale:
        q = [F.col("s") * c for c in q]
    if translate:
        q = [c + F.col("tr")[i] for i, c in enumerate(q)]
    return d.select(*df.columns, *[c.alias(prefix + n) for c, n in zip(q, coords)])


def similarity_2d(
    df: DataFrame, keys: Sequence[str], a: Sequence[str] = ("x", "y"), b: Sequence[str] = ("u", "v")
) -> DataFrame:
    """Planar similarity in closed form: s, theta, tx, ty with b ~ s R(theta) a + t."""
    whole = F.lit(True)
    for c in [*a, *b]:
        whole = whole & F.col(c).isNotNull()
    m = df.where(whole).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in [*a, *b]],
        *[F.covar_pop(p, q).alias(f"c{i}{j}") for i, p in enumerate(a) for j, q in enumerate(b)],
        (F.var_pop(a[0]) + F.var_pop(a[1])).alias("var"),
    ).where("n >= 2")
    p, q = F.col("c00") + F.col("c11"), F.col("c01") - F.col("c10")
    det = F.col("c00") * F.col("c11") - F.col("c01") * F.col("c10")
    frob = sum((F.col(f"c{i}{j}") * F.col(f"c{i}{j}") for i in range(2) for j in range(2)), F.lit(0.0))
    m = m.withColumn("theta", F.atan2(q, p)).withColumn(
        "s", F.sqrt(frob + 2 * F.abs(det)) / (F.col("var") + 1e-12)
    )
    c, s = F.cos("theta"), F.sin("theta")
    ax, ay = F.col(f"m_{a[0]}"), F.col(f"m_{a[1]}")
    return m.select(
        *keys, "n", "s", "theta",
        (F.col(f"m_{b[0]}") - F.col("s") * (c * ax - s * ay)).alias("tx"),
        (F.col(f"m_{b[1]}") - F.col("s") * (s * ax + c * ay)).alias("ty"),
    )


def apply_similarity_2d(
    df: DataFrame, fits: DataFrame, keys: Sequence[str], coords: Sequence[str] = ("x", "y")
) -> DataFrame:
    """Add ``pu``, ``pv``: the points under the fitted planar similarity; groups
    without a fit keep NULL."""
    d = df.join(fits.select(*keys, "s", "theta", "tx", "ty"), list(keys), "left")
    x, y = F.col(coords[0]), F.col(coords[1])
    c, s = F.cos("theta"), F.sin("theta")
    return d.select(
        *df.columns,
        (F.col("s") * (c * x - s * y) + F.col("tx")).alias("pu"),
        (F.col("s") * (s * x + c * y) + F.col("ty")).alias("pv"),
    )


def affine_3d_to_2d(
    df: DataFrame, keys: Sequence[str], a: Sequence[str] = PRED, b: Sequence[str] = ("u", "v")
) -> DataFrame:
    """Least-squares affine map of 3D points to pixels: M (4x2, row order);
    needs four complete points. The normal equations are set up in covariances, which
    Spark merges centred, so that points far from the origin lose no digits."""
    whole = F.lit(True)
    for c in [*a, *b]:
        whole = whole & F.col(c).isNotNull()
    x = [F.col(c) for c in a]
    sums = df.where(whole).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.covar_pop(x[i], x[j]).alias(f"s{i}{j}") for i in range(3) for j in range(i, 3)],
        *[F.covar_pop(x[i], F.col(q)).alias(f"r{i}{j}") for i in range(3) for j, q in enumerate(b)],
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.avg(q).alias(f"q{j}") for j, q in enumerate(b)],
    ).where("n >= 4")
    zero, one = F.lit(0.0), F.lit(1.0)
    lhs = [F.col(f"s{min(i, j)}{max(i, j)}") if max(i, j) < 3 else (one if i == j else zero) for i in range(4) for j in range(4)]
    rhs = [F.col(f"r{i}{j}") if i < 3 else zero for i in range(4) for j in range(2)]
    fit = sums.withColumn("_M", solve_normal_4x2(F.array(*lhs, *rhs)))
    # the last row puts the centre of the points onto the centre of the pixels
    shift = [F.col(f"q{j}") - sum((F.col(f"m{i}") * F.col("_M")[2 * i + j] for i in range(3)), F.lit(0.0)) for j in range(2)]
    return fit.select(*keys, "n", F.when(F.col("_M").isNotNull(), F.concat(F.slice("_M", 1, 6), F.array(*shift))).alias("M"))


def apply_affine(df: DataFrame, fits: DataFrame, keys: Sequence[str], coords: Sequence[str] = PRED) -> DataFrame:
    """Add ``pu``, ``pv``: the points under the fitted map; groups without a fit keep NULL."""
    d = df.join(fits.select(*keys, "M"), list(keys), "left")
    one = [*[F.col(c) for c in coords], F.lit(1.0)]
    out = [sum((one[i] * F.col("M")[2 * i + j] for i in range(4)), F.lit(0.0)) for j in range(2)]
    return d.select(*df.columns, out[0].alias("pu"), out[1].alias("pv"))
