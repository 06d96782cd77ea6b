"""Point, rotation and camera expressions. Everything here is a Column; a 3x3
matrix is an ``array<double>`` of nine values in row order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = Sequence[Column]


def vec(prefix: str = "", names: str = "xyz") -> list[Column]:
    return [F.col(prefix + c) for c in names]


def sub(a: Vec, b: Vec) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def cross(a: Vec, b: Vec) -> list[Column]:
    return [
        a[1] * b[2] - a[2] * b[1],
        a[2] * b[0] - a[0] * b[2],
        a[0] * b[1] - a[1] * b[0],
    ]


def normalize(a: Vec, eps: float = 1e-8) -> list[Column]:
    """Unit vector; the zero vector stays zero."""
    n = norm(a)
    return [F.when(n > eps, c / n).when(n.isNotNull(), c * 0.0) for c in a]


def midpoint(a: Vec, b: Vec) -> list[Column]:
    return [(p + q) * 0.5 for p, q in zip(a, b)]


def elements(m: Column, n: int = 9) -> list[Column]:
    return [m[i] for i in range(n)]


def mat_vec(m: Vec, v: Vec) -> list[Column]:
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def mat_mul(a: Vec, b: Vec) -> list[Column]:
    return [dot(a[3 * i : 3 * i + 3], [b[j], b[3 + j], b[6 + j]]) for i in range(3) for j in range(3)]


def transpose(m: Vec) -> list[Column]:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def det(m: Vec) -> Column:
    return dot(m[0:3], cross(m[3:6], m[6:9]))


def orthonormal(m: Vec, tol: float = 1e-3) -> Column:
    """True when the columns of ``m`` are orthonormal within ``tol`` (plus the
    usual relative 1e-5 on the unit diagonal)."""
    g = mat_mul(transpose(m), m)
    ok = F.lit(True)
    for i in range(3):
        for j in range(3):
            one = 1.0 if i == j else 0.0
            ok = ok & (F.abs(g[3 * i + j] - one) <= tol + 1e-5 * one)
    return ok


def valid_rotation(m: Column) -> Column:
    """The matrix when orthonormal, its last column flipped when it is a
    reflection, NULL otherwise."""
    e = elements(m)
    flipped = F.array(*[-c if i % 3 == 2 else c for i, c in enumerate(e)])
    return F.when((F.size(m) == 9) & orthonormal(e), F.when(det(e) < 0, flipped).otherwise(m))


def invert_extrinsics(r: Vec, t: Vec) -> tuple[list[Column], list[Column]]:
    """(R', t') = (R transposed, -R transposed t)."""
    rt = transpose(r)
    return rt, [-c for c in mat_vec(rt, t)]


def axis_rotation(axis: str, angle: Column) -> list[Column]:
    c, s, one, zero = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return {
        "x": [one, zero, zero, zero, c, -s, zero, s, c],
        "y": [c, zero, s, zero, one, zero, -s, zero, c],
        "z": [c, -s, zero, s, c, zero, zero, zero, one],
    }[axis]


def euler_matrix(rx: Column, ry: Column, rz: Column, order: str = "xyz") -> list[Column]:
    """``xyz`` turns about x first, then y, then z; ``zyx`` the other way round."""
    x, y, z = axis_rotation("x", rx), axis_rotation("y", ry), axis_rotation("z", rz)
    if order == "xyz":
        return mat_mul(mat_mul(z, y), x)
    if order == "zyx":
        return mat_mul(mat_mul(x, y), z)
    raise ValueError(f"unsupported Euler order: {order}")


def rodrigues(rx: Column, ry: Column, rz: Column) -> list[Column]:
    """Matrix of a rotation vector (axis times angle)."""
    th = norm([rx, ry, rz])
    tiny = th < 1e-12
    k = [F.when(tiny, F.lit(0.0)).otherwise(c / th) for c in (rx, ry, rz)]
    c, s = F.cos(th), F.sin(th)
    skew = [F.lit(0.0), -k[2], k[1], k[2], F.lit(0.0), -k[0], -k[1], k[0], F.lit(0.0)]
    return [
        (c if i == j else F.lit(0.0)) + (1 - c) * k[i] * k[j] + s * skew[3 * i + j]
        for i in range(3)
        for j in range(3)
    ]


# Named axis remaps.
AXIS_PRESETS = {"none": "x,y,z", "forward_left_up": "-y,x,z"}


def parse_axes(expr: str) -> list[tuple[float, int]]:
    """``"-y,x,z"`` or a preset name to (sign, source axis) triples."""
    parts = [p.strip() for p in AXIS_PRESETS.get(expr.strip().lower(), expr).lower().split(",")]
    if len(parts) != 3:
        raise ValueError(f"three comma separated axes expected: {expr!r}")
    out = []
    for p in parts:
        name = p.lstrip("+-")
        if name not in ("x", "y", "z"):
            raise ValueError(f"unknown axis {p!r}")
        out.append((-1.0 if p.startswith("-") else 1.0, "xyz".index(name)))
    if len({a for _, a in out}) != 3:
        raise ValueError(f"each axis must be used once: {expr!r}")
    return out


def remap_axes(v: Vec, expr: str) -> list[Column]:
    return [-v[a] if s < 0 else v[a] for s, a in parse_axes(expr)]


def distort(a: Column, b: Column, d: Vec) -> tuple[Column, Column]:
    """Brown model on normalised coordinates; ``d`` = k1, k2, p1, p2, k3."""
    r2 = a * a + b * b
    radial = 1 + r2 * (d[0] + r2 * (d[1] + r2 * d[4]))
    return (
        a * radial + 2 * d[2] * a * b + d[3] * (r2 + 2 * a * a),
        b * radial + d[2] * (r2 + 2 * b * b) + 2 * d[3] * a * b,
    )


def project(x: Column, y: Column, z: Column, k: Vec, d: Vec | None) -> tuple[Column, Column]:
    """Camera coordinates to pixels."""
    a, b = x / z, y / z
    if d is not None:
        a, b = distort(a, b, d)
    return k[0] * a + k[2], k[4] * b + k[5]


def undistort(u: Column, v: Column, k: Column, d: Column, rounds: int = 5) -> Column:
    """Fixed-point inverse of the Brown model; struct(u, v) in pixels.

    The rounds run inside one higher-order function so that the expression
    stays small."""
    a0, b0 = (u - k[2]) / k[0], (v - k[5]) / k[4]
    de = elements(d, 5)

    def step(acc: Column, _: Column) -> Column:
        a, b = acc["a"], acc["b"]
        r2 = a * a + b * b
        radial = 1 + r2 * (de[0] + r2 * (de[1] + r2 * de[4]))
        dx = 2 * de[2] * a * b + de[3] * (r2 + 2 * a * a)
        dy = de[2] * (r2 + 2 * b * b) + 2 * de[3] * a * b
        return F.struct(((a0 - dx) / radial).alias("a"), ((b0 - dy) / radial).alias("b"))

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(a0.alias("a"), b0.alias("b")),
        step,
        lambda acc: F.struct(
            (k[0] * acc["a"] + k[2]).alias("u"), (k[4] * acc["b"] + k[5]).alias("v")
        ),
    )
