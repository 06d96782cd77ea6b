"""Still phases, model readiness and sanity checks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.functions import dims
from kinespark.operators import blocks, frames, series
from kinespark.session import materialise

COORDS = ("x", "y", "z")


def still_markers(arms: bool = True, keypoints: bool = False, mocap: bool = False) -> list[str]:
    """Markers that must be still: the study set with or without arms, by study or mocap
    names, or the keypoint set."""
    if keypoints:
        return list(dims.STILL_KEYPOINTS)
    chosen = dims.STILL_MARKERS + (dims.STILL_ARM_MARKERS if arms else [])
    if mocap:
        for old, new in dims.STUDY_TO_MOCAP:
            chosen = [m.replace(old, new) for m in chosen]
    return list(chosen)


def prepare_still(df: DataFrame, root: str | None = "midHip", large: float = 10.0, markers: Sequence[str] | None = None) -> DataFrame:
    """Remove the root marker's motion in trials that have it (frames without it are
    missing there), keep ``markers`` (all by default) and bring millimetres to metres
    when the largest coordinate left in the trial says so."""
    d = df
    if root:
        fk = ["trial", "frame"]
        d = series.per_key(d, ["trial"], F.max((F.col("marker") == root) & F.col("x").isNotNull()).alias("_has"), written=True)
        moved = {c: F.when(F.col("_has"), F.col(c) - frames.joint_in_frame(root, c, fk)).otherwise(F.col(c)) for c in COORDS}
        d = d.withColumn("joint", F.col("marker"))
        d = d.select(*[moved[c].alias(c) if c in moved else F.col(c) for c in d.columns]).drop("joint", "_has")
    if markers is not None:
        d = d.where(F.col("marker").isin(list(markers)))
    d = series.per_key(materialise(d, "moved"), ["trial"], F.max(F.greatest(*COORDS)).alias("_m"), written=True)
    big = F.col("_m") > large
    new = {c: F.when(big, F.col(c) / 1000).otherwise(F.col(c)) for c in COORDS}
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns])


def window_lengths(fs: float, minimum_s: float, start_s: float = 1.0, step_s: float = 0.1) -> list[int]:
    """Frame counts tried, longest first, down to the minimum duration."""
    n, step, out = int(start_s * fs + 1), int(step_s * fs), []
    while n >= 1 and round((n - 1) / fs, 2) >= minimum_s:
        out.append(n)
        if step < 1:
            break
        n -= step
    return out


def window_lengths_of(fs: Column, minimum_s: float, start_s: float = 1.0, step_s: float = 0.1) -> Column:
    """:func:`window_lengths` as an array column, for a rate per row."""
    n, step = F.floor(start_s * fs + 1).cast("int"), F.floor(step_s * fs).cast("int")
    tried = F.when(step >= 1, F.sequence(n, F.least(n, F.lit(1)), -F.greatest(step, F.lit(1)))).otherwise(F.array(n))
    return F.filter(tried, lambda k: (k >= 1) & (F.bround((k - 1) / fs, 2) >= minimum_s))


def motion_ranges(
    df: DataFrame, lengths: Sequence[int] | Column, index: str = "frame", width: int = 4096, of: Sequence[str] = (),
) -> DataFrame:
    """(trial, start, n, needed): the largest coordinate range of any marker in
    the window of n frames that begins at ``start``; the smallest threshold that
    calls it still lies above it. Windows must be complete for every marker: one
    with a missing frame or coordinate is never still.

    ``lengths`` are the same for all trials, or an array column made of the columns
    ``of``, which are constant in a trial. A block holds all markers of its frames. Extrema over 1, 2, 4, .. frames are
    made once; a window is the union of two of them, so its length costs nothing. The tables
    of many blocks with equal lengths lie one below the other; windows across two are left out."""
    sizes = lengths if isinstance(lengths, Column) else F.array(*[F.lit(int(n)) for n in lengths])
    base, of = (df.withColumn("_n", sizes), ["_n"]) if isinstance(lengths, Column) and not of else (df, list(of))
    # lengths are made once per trial, behind the written table; as text, as an array in every
    # row takes long between Spark and Python
    trials = materialise(base.select("trial", "marker", *of).distinct().groupBy("trial", *of).agg(F.count(F.lit(1)).alias("_m")), "trials")
    trials = trials.withColumn("_n", (F.col("_n") if of == ["_n"] else sizes).cast("array<int>")).where(F.size("_n") > 0)
    trials = trials.select("trial", "_m", F.array_max("_n").cast("long").alias("_reach"), F.array_join("_n", ",").alias("_n"))
    d = df.select("trial", "marker", F.col(index).cast("long").alias(index), *[F.col(c).cast("double") for c in COORDS])
    d = series.with_halo(d.join(trials, "trial"), index, 0, F.col("_reach"), width).drop("_reach", "_own")

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        k, cuts = len(starts), np.append(starts, len(pdf))
        row_block = np.repeat(np.arange(k), np.diff(cuts))
        xyz = pdf[list(COORDS)].to_numpy(dtype=float)
        # a marker's column in its block
        code, names_ = pd.factorize(pdf["marker"])
        seen, of = np.unique(row_block * len(names_) + code, return_inverse=True)
        n_markers = np.bincount(seen // len(names_), minlength=k)
        col = of - (np.cumsum(n_markers) - n_markers)[row_block]
        # tables begin with the first row there; windows begin in front of the next block, so a
        # block that only holds copies of its rows has none
        trial, lo = pdf["trial"].to_numpy()[starts], pdf[index].to_numpy()[starts]
        own = (pdf["_blk"].to_numpy()[starts] + 1) * width - lo
        at = pdf[index].to_numpy() - lo[row_block]
        height = at[cuts[1:] - 1] + 1
        alike: dict[str, list[int]] = {}
        sizes = pdf["_n"].to_numpy()[starts]
        for s in np.flatnonzero((n_markers >= pdf["_m"].to_numpy()[starts]) & (own > 0)):
            alike.setdefault(sizes[s], []).append(s)
        found = []
        for lengths, chosen in alike.items():
            for part in _tables(chosen, height, n_markers):
                h, n_cols = height[part], n_markers[part].max()
                first = np.cumsum(h) - h
                where = np.full(k, -1)
                where[part] = np.arange(len(part))
                rows = np.flatnonzero(where[row_block] >= 0)
                table = np.full((int(h.sum()), n_cols, 3), np.nan)
                table[np.repeat(np.arange(n_cols) >= n_markers[part][:, None], h, axis=0)] = 0.0  # columns that a block lacks
                table[first[where[row_block[rows]]] + at[rows], col[rows]] = xyz[rows]
                step, left, owner = (np.arange(len(table)) - np.repeat(first, h), np.repeat(first + h, h) - np.arange(len(table)), np.repeat(part, h))
                for n, needed in window_ranges(table.reshape(len(table), -1), [int(n) for n in lengths.split(",")]):
                    ok = np.flatnonzero(~np.isnan(needed) & (left[:len(needed)] >= n) & (step[:len(needed)] < own[owner[:len(needed)]]))
                    found.append((trial[owner[ok]], step[ok] + lo[owner[ok]], np.full(len(ok), n), needed[ok]))
        cols = [np.concatenate(c) for c in zip(*found)] if found else [[], [], [], []]
        return pd.DataFrame(dict(zip(("trial", "start", "n", "needed"), cols)))

    return blocks.map_blocks(d, ["trial"], index, run, f"trial {df.schema['trial'].dataType.simpleString()}, start long, n int, needed double")


#: Cells of the tables whose windows are made together.
CELLS = 1 << 20


def _tables(chosen: Sequence[int], height: np.ndarray, n_markers: np.ndarray) -> Iterator[np.ndarray]:
    """``chosen`` blocks in runs whose common table stays below CELLS, one block at least."""
    held, rows, cols = [], 0, 0
    for s in chosen:
        rows, cols = rows + int(height[s]), max(cols, int(n_markers[s]))
        if held and rows * cols * 3 > CELLS:
            yield np.array(held)
            held, rows, cols = [], int(height[s]), int(n_markers[s])
        held.append(s)
    if held:
        yield np.array(held)


def window_ranges(table: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each length n that fits: the largest range of any column over rows i .. i+n-1; NaN if a value is missing."""
    high = low = table
    span = 1
    for n in sorted(int(n) for n in lengths):
        if n > len(table):
            return
        while 2 * span <= n:  # extrema over twice as many rows
            high, low, span = np.maximum(high[:-span], high[span:]), np.minimum(low[:-span], low[span:]), 2 * span
        rows, shift = len(table) - n + 1, n - span
        yield n, (np.maximum(high[:rows], high[shift:shift + rows]) - np.minimum(low[:rows], low[shift:shift + rows])).max(axis=1)


def first_still(ranges: DataFrame, threshold: float) -> DataFrame:
    """Per trial: the longest window below the threshold, the earliest of those."""
    d = ranges.where(F.col("needed") < threshold)
    return d.groupBy("trial").agg(F.max_by(F.struct("start", "n", "needed"), F.struct("n", -F.col("start"))).alias("w")).select("trial", "w.*")


def relaxed_still(
    ranges: DataFrame, trials: DataFrame, threshold: float = 0.5, step: float = 0.001, maximum: float = 100.0
) -> DataFrame:
    """As :func:`first_still`, raising the threshold by ``step`` until a window
    fits. The number of steps a window needs follows from its range, so there is
    no loop. Trials without any window get a ``not found`` row."""
    # smallest whole number of steps whose threshold exceeds the range
    k = F.greatest(F.lit(0), F.floor((F.col("needed") - threshold) / step + 1e-9) + 1).cast("long")
    k = F.when(F.col("needed") < threshold, F.lit(0)).otherwise(k)
    d = ranges.withColumn("steps", k).where(threshold + F.col("steps") * step <= maximum)
    best = F.min_by(F.struct("start", "n", "needed", "steps"), F.struct("steps", -F.col("n"), "start"))
    d = d.groupBy("trial").agg(best.alias("w")).select("trial", "w.*")
    d = trials.select("trial").distinct().join(d, "trial", "left")
    return d.withColumn("status", F.when(F.col("n").isNull(), "not found").otherwise("ok"))


def prune_tasks(tasks: DataFrame, model_markers: DataFrame) -> DataFrame:
    """Switch off tracking tasks whose marker the model lacks: (model, marker,
    apply, ...) against (model, marker)."""
    m = model_markers.select("model", "marker").distinct().withColumn("_in", F.lit(True))
    d = tasks.join(m, ["model", "marker"], "left")
    return d.withColumn("apply", F.col("apply") & F.col("_in").isNotNull()).drop("_in")


def prune_measurements(pairs: DataFrame, model_markers: DataFrame) -> DataFrame:
    """(model, measurement, pairs, complete, apply): marker pairs present in the
    model; a measurement without any is not applied."""
    m = model_markers.select("model", F.col("marker").alias("_m")).distinct()
    has = lambda d, c, n: d.join(m.select("model", F.col("_m").alias(c), F.lit(1).alias(n)), ["model", c], "left")
    d = has(has(pairs, "a", "_a"), "b", "_b")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return d.groupBy("model", "measurement").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(ok).alias("complete")
    ).withColumn("apply", F.col("complete") > 0)


def segment_sanity(scales: DataFrame, keys: Sequence[str], limit: float = 1.0) -> DataFrame:
    """Largest spread of segment scale factors over the axes, and whether it is
    anthropometrically plausible."""
    spread: Column = F.greatest(*[F.max(c) - F.min(c) for c in ("sx", "sy", "sz")])
    return scales.groupBy(*keys).agg(spread.alias("spread")).withColumn("plausible", F.col("spread") <= limit)
