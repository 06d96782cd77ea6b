"""Filters along a trial's time axis, block by block, at one rate or each trial at its own."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.functions import kernels
from kinespark.operators import blocks, recursive, resample, series
from kinespark.session import materialise


def window_length(fs: Column, cutoff: Column) -> Column:
    """Odd moving-average length for a cutoff: about 0.443 fs / cutoff, at least
    3, at most two seconds and one frame."""
    raw = F.bround(0.443 * fs / F.greatest(F.lit(0.1), cutoff), 0).cast("long")
    n = F.greatest(F.lit(3), F.least(raw, (2 * fs).cast("long") + 1))
    return F.when(n % 2 == 0, n + 1).otherwise(n)


def moving_average(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    values: Sequence[str],
    length: int | Column,
    width: int = series.FRAMES_PER_BLOCK,
    placed: bool = False,
) -> DataFrame:
    """Centred moving average with mirrored ends on a gap-free index from 0.

    Gaps are filled for the averaging and become NULL again. ``length`` may
    differ per row group: the window is one unit of index / half wide, so one
    range window serves every length. Lengths below 3 leave the data alone.
    ``placed`` rows of numbers come from :func:`resample.on_grid` with this ``width`` and half a
    window as ``halo``; they stay in their tasks and leave without the columns of their place."""
    keys = list(keys)
    if isinstance(length, int):
        half = (length + 1 - length % 2) // 2 if length >= 3 else 0
        if placed:
            return _averaged_in_place(df, keys, index, list(values), half, series.group_rows(width))
        return _averaged(df, keys, index, list(values), half, width) if half else df
    n_col = F.when(length % 2 == 0, length + 1).otherwise(length)
    d = df.withColumn("_half", F.when(n_col >= 3, F.floor(n_col / 2)).otherwise(F.lit(0)).cast("long"))
    gaps = F.struct(*[F.col(v).isNull().alias(v) for v in values])
    d = materialise(resample.fill_gaps(d.withColumn("_gap", gaps), keys, index, values, width), "filled")
    d = series.per_key(d, keys, (F.max(index) + 1).alias("_n"))
    # mirrored copies: positions p in [-half, n-1+half] that reflect onto the row
    i, n, half = F.col(index), F.col("_n"), F.col("_half")
    period = 2 * (n - 1)
    turns = F.when(period > 0, F.ceil(half / period)).otherwise(F.lit(0)).cast("long")
    k = F.sequence(-turns - 1, turns + 1)
    seen = F.when(
        n == 1, F.sequence(-half, half)
    ).otherwise(
        F.array_distinct(F.concat(F.transform(k, lambda m: i + period * m), F.transform(k, lambda m: -i + period * m)))
    )
    seen = F.filter(seen, lambda p: (p >= -half) & (p <= n - 1 + half))
    near_end = (i <= half) | (i >= n - 1 - half)
    d = d.withColumn("_p", F.explode(F.when(near_end, seen).otherwise(F.array(i))))
    d = series.with_halo(d, "_p", half, half, width)
    # order by p / half: a range of one unit is the row's own window length
    unit = F.when(half > 0, F.col("_p") / half).otherwise(F.col("_p") * 4.0)
    d = d.withColumn("_u", unit)
    over = (
        f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)}, _blk, _half ORDER BY _u "
        "RANGE BETWEEN 1.0000001D PRECEDING AND 1.0000001D FOLLOWING)"
    )
    d = d.select("*", *[F.expr(f"avg(`{v}`) {over}").alias(f"_m_{v}") for v in values])
    d = d.where(F.col("_own") & (F.col("_p") == i))
    new = {v: F.when(~F.col(f"_gap.{v}"), F.col(f"_m_{v}")) for v in values}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def _averaged(df: DataFrame, keys: list[str], index: str, values: list[str], half: int, width: int) -> DataFrame:
    """:func:`moving_average` of one length. The rows are shuffled once: a block gets its own rows and
    those ``half`` away, fills gaps among them and mirrors them at the ends of the series; what lies
    beyond them comes from one summary row per block."""
    i = F.col(index)
    ends = _beyond(df.withColumn("_blk", series.block_of(i, width)), keys, index, values, half, width)

    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)}, _blk ORDER BY `{index}`)"
    d = series.with_halo(df, index, half, half, width)
    known = lambda v: f"if(`{v}` IS NULL, NULL, named_struct('t', `{index}`, 'v', `{v}`))"
    d = d.select("*", *[F.expr(f"{fn}({known(v)}, 1) IGNORE NULLS {over}").alias(f"_{fn}_{v}") for v in values for fn in ("lag", "lead")])
    d = d.join(ends, [*keys, "_blk"])
    near = lambda v: (F.coalesce(f"_lag_{v}", f"_before_{v}"), F.coalesce(f"_lead_{v}", f"_behind_{v}"))
    fill = [F.coalesce(F.col(v), resample.lerp(i, *near(v), "clamp")).alias(f"_f_{v}") for v in values]
    d = d.select(*df.columns, "_blk", "_own", "_n", *fill)
    # positions of the block's span that reflect onto the row
    n = F.col("_n")
    period = 2 * (n - 1)
    turns = F.when(period > 0, F.ceil(F.lit(half) / period)).otherwise(F.lit(0)).cast("long")
    k = F.sequence(-turns - 1, turns + 1)
    seen = F.when(n == 1, F.sequence(F.lit(-half).cast("long"), F.lit(half).cast("long"))).otherwise(
        F.array_distinct(F.concat(F.transform(k, lambda m: i + period * m), F.transform(k, lambda m: -i + period * m))))
    first = F.col("_blk") * width - half
    seen = F.filter(seen, lambda p: (p >= F.greatest(first, F.lit(-half))) & (p <= F.least(first + width + 2 * half, n + half) - 1))
    near_end = (i <= half) | (i >= n - 1 - half)
    d = d.withColumn("_p", F.explode(F.when(near_end, seen).otherwise(F.array(i))))
    window = W.partitionBy(*keys, "_blk").orderBy("_p").rangeBetween(-half, half)
    d = d.select("*", *[F.avg(f"_f_{v}").over(window).alias(f"_m_{v}") for v in values]).where(F.col("_own") & (F.col("_p") == i))
    new = {v: F.when(F.col(v).isNotNull(), F.col(f"_m_{v}")) for v in values}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def _beyond(d: DataFrame, keys: list[str], index: str, values: list[str], half: int, width: int) -> DataFrame:
    """keys, _blk, _n (rows of the key) and, for each value, _before_ and _behind_: (t, v) of the last
    known row more than ``half`` before the block and of the first one more than ``half`` behind it."""
    i, skip, rest = F.col(index), half // width + 1, half % width
    inside = i - F.col("_blk") * width
    aggs = [F.max(index).alias("_top")]
    for v in values:
        known = F.col(v).isNotNull()
        for name, where, end, by in (
            ("last", known, F.max, F.max_by), ("early", known & (inside < width - rest), F.max, F.max_by),
            ("first", known, F.min, F.min_by), ("late", known & (inside >= rest), F.min, F.min_by),
        ):
            at = F.when(where, i)
            aggs += [end(at).alias(f"_t_{name}_{v}"), by(v, at).alias(f"_v_{name}_{v}")]
    ends = d.groupBy(*keys, "_blk").agg(*aggs)
    pair = lambda name, v: F.when(F.col(f"_t_{name}_{v}").isNotNull(), F.struct(F.col(f"_t_{name}_{v}").alias("t"), F.col(f"_v_{name}_{v}").alias("v")))
    ends = ends.select(*keys, "_blk", "_top", *[pair(n, v).alias(f"_{n}_{v}") for v in values for n in ("last", "early", "first", "late")])
    along = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)} ORDER BY _blk)"
    # the last known value before a block's rows and the first one behind them
    ends = ends.select(
        *keys, "_blk", (F.max("_top").over(W.partitionBy(*keys)) + 1).alias("_n"),
        *[F.coalesce(f"_early_{v}", F.expr(f"lag(`_last_{v}`, 1) IGNORE NULLS {along}")).alias(f"_early_{v}") for v in values],
        *[F.coalesce(f"_late_{v}", F.expr(f"lead(`_first_{v}`, 1) IGNORE NULLS {along}")).alias(f"_late_{v}") for v in values])
    return ends.select(
        *keys, "_blk", "_n", *[F.expr(f"lag(`_early_{v}`, {skip}) {along}").alias(f"_before_{v}") for v in values],
        *[F.expr(f"lead(`_late_{v}`, {skip}) {along}").alias(f"_behind_{v}") for v in values])


def _averaged_in_place(df: DataFrame, keys: list[str], index: str, values: list[str], half: int, width: int) -> DataFrame:
    """:func:`_averaged` of rows that lie in groups of ``width``, in order and with the ``half`` rows on
    both sides: a task streams through them. Only keys of several groups need the summary rows."""
    out = [c for c in df.columns if c not in ("_grp", "_n")]
    own = series.block_of(index, width) == F.col("_grp")
    if not half:
        return df.where(own).select(*out)
    d = df.withColumns({v: F.col(v).cast("double") for v in values})
    long = d.where(own & (F.col("_n") > width)).withColumn("_blk", F.col("_grp"))
    ends = materialise(_beyond(long.drop("_n"), keys, index, values, half, width), "ends")
    sides = ("before", "behind")
    beyond = [] if ends.isEmpty() else [f"_{side}_{f}_{v}" for v in values for side in sides for f in "tv"]
    if beyond:  # the rows are read and left in order: no sort
        flat = [F.col(f"_{side}_{v}.{f}").alias(f"_{side}_{f}_{v}") for v in values for side in sides for f in "tv"]
        d = d.join(ends.select(*keys, F.col("_blk").alias("_grp"), *flat).hint("shuffle_hash"), [*keys, "_grp"], "left")

    def mean(of: blocks.Columns, starts: np.ndarray) -> blocks.Columns:
        i, n, none = of[index][0], of["_n"][0], np.zeros(len(of[index][0]), dtype=int)
        near = lambda side, v: [of.get(f"_{side}_{f}_{v}", (none, none > 0)) for f in "tv"]
        return {v: (kernels.window_mean(i, n, starts, kernels.filled(i, starts, of[v], near("before", v), near("behind", v)), half), of[v][1]) for v in values}

    return blocks.map_placed(d, index, out, mean, [*values, *beyond], width, half)


def _param(value: float | str | Column | None) -> Column:
    """A number for all rows, or the column that holds each key's own."""
    if isinstance(value, str):
        return F.col(value).cast("double")
    return value.cast("double") if isinstance(value, Column) else F.lit(value).cast("double")


def upsample(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], source_rate: float | str | Column, target_rate: float,
    cutoff: float | None = 6.0, width: int = series.FRAMES_PER_BLOCK,
) -> DataFrame:
    """Linear resampling to a higher rate followed by the moving average. Keys whose
    source rate (a number, or a column that is constant in a key) is the target or
    more keep their data and timing."""
    keys = list(keys)
    src = df.select(*keys, F.col(index).alias("i"), *values, _param(source_rate).alias("_rate")).withColumn("t", F.col("i") / F.col("_rate"))
    kept = src.where(F.col("_rate") >= target_rate).select(*keys, "i", "t", *values)
    src = src.where(F.col("_rate") < target_rate)
    span = src.groupBy(*keys).agg(F.lit(0.0).alias("t0"), F.max("t").alias("t1"))
    d = resample.on_grid(src.select(*keys, "t", *values), span, keys, values, target_rate, "rounded", block_s=width / target_rate)
    if cutoff is not None:
        # the length depends on the job's rate and cutoff only
        n = max(3, min(int(round(0.443 * target_rate / max(0.1, cutoff))), int(2 * target_rate) + 1))
        d = moving_average(materialise(d, "upsampled"), keys, "i", values, n, width)
    return d.select(*keys, "i", "t", *values).unionByName(kept)


def first_order_lowpass(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], fs: float | str | Column, cutoff: float | str | Column | None,
    width: int = series.FRAMES_PER_BLOCK,
) -> DataFrame:
    """Forward exponential low-pass on a gap-free index. Rates and cutoffs may be
    columns that are constant in a key; keys without a positive cutoff stay as they are."""
    return _filtered(df, fs, cutoff, lambda d: recursive.apply(d, keys, index, values, ["_fs", "_fc"], kernels.first_order, False, width=width))


def _filtered(df: DataFrame, fs: float | str | Column, cutoff: float | str | Column | None, run) -> DataFrame:
    if cutoff is None or (isinstance(cutoff, (int, float)) and cutoff <= 0):
        return df
    d = df.withColumns({"_fs": _param(fs), "_fc": _param(cutoff)})
    if isinstance(cutoff, (int, float)):
        return run(d)
    asked = F.coalesce(F.col("_fc") > 0, F.lit(False))
    return run(d.where(asked)).unionByName(d.where(~asked).drop("_fs", "_fc", "_lo", "_hi"))


def exponential(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], alpha: float,
    width: int = series.FRAMES_PER_BLOCK,
) -> DataFrame:
    """y <- (1 - alpha) y + alpha x, seeded by the first row."""
    if alpha <= 0:
        return df
    return recursive.apply(df.withColumn("_alpha", F.lit(float(alpha))), keys, index, values, ["_alpha"], kernels.exponential, False, width=width)


def exponential_over_solved(
    df: DataFrame, keys: Sequence[str], frame: str, values: Sequence[str], alpha: float,
    width: int = series.FRAMES_PER_BLOCK,
) -> DataFrame:
    """Exponential average over the frames that have a value; the others are
    skipped and stay NULL."""
    solved = F.lit(True)
    for v in values:
        solved = solved & F.col(v).isNotNull()
    d = series.add_running_index(df.where(solved), keys, [frame], series.block_of(frame, width), "_i")
    d = exponential(d, keys, "_i", values, alpha, width).drop("_i")
    rest = df.where(~solved)
    blank = {v: F.lit(None).cast("double") for v in values}
    return d.unionByName(rest.select(*[blank[c].alias(c) if c in blank else F.col(c) for c in df.columns]))


def butterworth(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], fs: float | str | Column, cutoff: float | str | Column | None,
    order: int = 4, width: int = series.FRAMES_PER_BLOCK, reused: bool = False,
) -> DataFrame:
    """Zero-phase Butterworth low-pass on a gap-free index: forward and backward
    over the oddly extended series. Series too short for the extension get the
    first-order filter. Rates and cutoffs may be columns that are constant in a key;
    keys without a positive cutoff stay as they are. ``reused`` as in :func:`recursive.apply`."""
    design = partial(kernels.lowpass, order=order)
    return _filtered(df, fs, cutoff, lambda d: recursive.apply(
        d, keys, index, values, ["_fs", "_fc"], design, True, 3 * (order + 1), kernels.first_order, width, reused))


def antialias_cutoff(fs: float | Column, target: float | None, cutoff: float | None) -> float | Column | None:
    """Cutoff of the downsampling filter; a column where the rate is one."""
    if isinstance(fs, Column):
        plain = F.lit(cutoff if cutoff and cutoff > 0 else None).cast("double")
        if not target or target <= 0:
            return plain
        return F.when(fs > target, F.least(F.lit(float(cutoff or 0.45 * target)), 0.49 * fs)).otherwise(plain)
    if target and 0 < target < fs:
        return min(cutoff or 0.45 * target, 0.49 * fs)
    return cutoff if cutoff and cutoff > 0 else None


def downsample(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], fs: float | str | Column, target: float,
    cutoff: float | None = 6.0, width: int = series.FRAMES_PER_BLOCK,
) -> DataFrame:
    """Filter, then interpolate onto a floored grid at ``target``; keys whose rate
    (a number, or a column that is constant in a key) is the target or less keep
    their frames. Gaps are filled first."""
    keys = list(keys)
    # the fill reads its rows twice
    d = materialise(df.select(*keys, index, *values, _param(fs).alias("_rate")), "rows")
    d = materialise(resample.fill_gaps(d, keys, index, values, width, extent=True), "filled")
    rate = F.col("_rate") if not isinstance(fs, (int, float)) else float(fs)
    d = butterworth(d, keys, index, values, "_rate", antialias_cutoff(rate, target, cutoff), width=width, reused=True)
    d = d.withColumn("t", F.col(index) / F.col("_rate"))
    thin = (F.col("_rate") > target) & F.lit(target > 0)
    kept = d.where(~thin).select(*keys, F.col(index).alias("i"), "t", *values)
    d = d.where(thin)
    span = d.groupBy(*keys).agg(F.lit(0.0).alias("t0"), F.max("t").alias("t1"))
    d = resample.on_grid(
        d.select(*keys, "t", *values), span, keys, values, target, "floored", outside="clamp", min_samples=1, block_s=width / target if target > 0 else width)
    return d.unionByName(kept)
