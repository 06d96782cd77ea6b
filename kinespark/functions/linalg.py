"""Small dense linear algebra on aggregated rows, in Arrow batches.

Inputs are a few numbers per group (already reduced by Spark), so a batch of
thousands of groups is one stacked NumPy call.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

_ROW = ArrayType(DoubleType())
_ROTATION = StructType(
    [StructField("R", _ROW), StructField("sigma", DoubleType()), StructField("sigma_signed", DoubleType())]
)


@pandas_udf(_ROTATION)
def _best_rotation(h: pd.Series) -> pd.DataFrame:
    m = np.stack([np.asarray(v, dtype=float) for v in h]).reshape(-1, 3, 3)
    good = np.isfinite(m).all(axis=(1, 2))
    u, s, vt = np.linalg.svd(np.where(good[:, None, None], m, np.eye(3)))
    flip = np.sign(np.linalg.det(vt) * np.linalg.det(u))
    vt[:, 2, :] *= flip[:, None]
    r = np.transpose(vt, (0, 2, 1)) @ np.transpose(u, (0, 2, 1))
    out = pd.DataFrame(
        {
            "R": list(r.reshape(-1, 9)),
            "sigma": s.sum(axis=1),
            "sigma_signed": s[:, 0] + s[:, 1] + flip * s[:, 2],
        }
    )
    out.loc[~good, ["sigma", "sigma_signed"]] = np.nan
    return out


def best_rotation(h: Column) -> Column:
    """Rotation R maximising trace(R H) for H = sum of a_i b_j (nine values, row
    order), with the sums of its singular values, plain and sign-corrected."""
    return _best_rotation(h)


@pandas_udf(_ROW)
def _solve_normal(a: pd.Series) -> pd.Series:
    m = np.stack([np.asarray(v, dtype=float) for v in a])
    lhs, rhs = m[:, :16].reshape(-1, 4, 4), m[:, 16:].reshape(-1, 4, 2)
    return pd.Series(list((np.linalg.pinv(lhs, rcond=1e-12, hermitian=True) @ rhs).reshape(-1, 8)))


def solve_normal_4x2(a: Column) -> Column:
    """Least-squares solution of 4x4 normal equations with two right sides;
    input 16 + 8 values, output 4x2 in row order."""
    return _solve_normal(F.transform(a, lambda v: v.cast("double")))
