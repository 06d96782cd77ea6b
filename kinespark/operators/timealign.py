"""Alignment signal and time offset between two recordings of a trial."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kinespark.operators import blocks, resample, series
from kinespark.session import materialise


def leg_signal(df: DataFrame, keys: Sequence[str] = ("trial", "frame"), legs=(("left_hip", "left_ankle"), ("right_hip", "right_ankle"))) -> DataFrame:
    """Sum of the hip to ankle distances of both sides per frame; 0 in frames
    whose trial lacks one of the joints altogether is left to the caller."""
    pick = lambda j, c: F.max(F.when(F.col("joint") == j, F.col(c)))
    wanted = [j for leg in legs for j in leg]
    d = df.where(F.col("joint").isin(wanted)).groupBy(*keys).agg(
        *[pick(j, c).alias(f"{j}_{c}") for j in wanted for c in "xyz"]
    )
    total = F.lit(0.0)
    for a, b in legs:
        sq = F.lit(0.0)
        for c in "xyz":
            diff = F.col(f"{a}_{c}") - F.col(f"{b}_{c}")
            sq = sq + diff * diff
        total = total + F.sqrt(sq)
    return d.select(*keys, total.alias("signal"))


def time_offset(
    a: DataFrame, b: DataFrame, keys: Sequence[str] = ("trial",), max_offset: float = 1.0, fs: float = 100.0,
    min_overlap: float = 0.5, width: int = series.FRAMES_PER_BLOCK, block_s: float = series.SECONDS_PER_BLOCK,
) -> DataFrame:
    """Seconds to add to ``a`` (keys, t, signal) so that it best matches ``b``.

    Both are put on a common grid and standardised; the lagged products are
    summed per block and then over blocks, so a trial's length does not matter.
    Too little overlap gives 0."""
    keys = list(keys)
    r = resample.overlap_range(a, b, keys)
    spans = materialise(r.where(F.col("t1") - F.col("t0") >= min_overlap), "overlaps")
    on_grid = lambda side, spans: resample.on_grid(
        side.select(*keys, "t", "signal"), spans, keys, ["signal"], fs, "half_open", outside="clamp", min_samples=1, block_s=block_s)
    level = lambda side: on_grid(side, spans).groupBy(*keys).agg(
        F.avg("signal").alias("_m"), F.stddev_pop("signal").alias("_s"), F.count(F.lit(1)).alias("_n"))
    lag = int(round(max_offset * fs))
    width = max(width, 2 * lag, 1)
    levels = [materialise(level(side), "levels") for side in (a, b)]

    def standard(side: DataFrame, levels: DataFrame) -> DataFrame:
        d = on_grid(side, spans.join(levels.drop("_n"), keys))
        return d.select(*keys, "i", ((F.col("signal") - F.col("_m")) / (F.col("_s") + 1e-8)).alias("z"))

    # one shuffle: rows of b in their block, rows of a in every block that they reach
    za = series.with_halo(standard(a, levels[0]), "i", lag, lag, width).drop("_own").withColumn("_b", F.lit(False))
    zb = standard(b, levels[1]).withColumns({"_blk": series.block_of("i", width), "_b": F.lit(True)})
    out = StructType([f for f in za.schema if f.name in keys] + [StructField("c", ArrayType(DoubleType()))])

    def products(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        """Lagged products of all blocks at once: each block has its stretch of two long rows."""
        side, pos = pdf["_b"].to_numpy(dtype=bool), pdf["i"].to_numpy()
        z = pdf["z"].to_numpy(dtype=float)
        size = np.diff(np.append(starts, len(pdf)))
        first, last = np.minimum.reduceat(pos, starts), np.maximum.reduceat(pos, starts)
        length = last - first + 1
        begin = lag + np.cumsum(length + 2 * lag) - (length + 2 * lag)
        at = np.repeat(begin - first, size) + pos
        wide = np.zeros(int(begin[-1] + length[-1]) + lag)
        wide[at[~side]] = z[~side]
        block = np.repeat(np.arange(len(starts)), size)[side]
        mine, own = at[side], z[side]
        c = np.stack([np.bincount(block, wide[mine + k] * own, len(starts)) for k in range(-lag, lag + 1)], axis=1)
        rows = pdf[keys].iloc[starts].reset_index(drop=True)
        return rows.assign(c=list(c))

    sums = blocks.map_blocks(za.unionByName(zb), keys, "i", products, out).select(*keys, F.posexplode("c").alias("lag", "c"))
    sums = sums.groupBy(*keys, (F.col("lag") - lag).cast("long").alias("lag")).agg(F.sum("c").alias("c"))
    sums = sums.join(levels[0].select(*keys, "_n"), keys).where(F.abs("lag") < F.col("_n"))
    best = sums.groupBy(*keys).agg(F.max_by("lag", F.struct(F.round("c", 9), -F.col("lag"))).alias("lag"))
    every = a.select(*keys).distinct()
    return every.join(best, keys, "left").select(
        *keys, F.coalesce(-F.col("lag") / fs + 0.0, F.lit(0.0)).alias("offset")
    )


def shift_time(df: DataFrame, shift: float, t: str = "t") -> DataFrame:
    return df.withColumn(t, F.col(t) + shift)
