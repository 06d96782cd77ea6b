"""Grids, bracket joins, interpolation and nearest-time lookups.

All of them rest on one bracket join: samples and targets are put on one time
axis and the nearest known sample on either side is carried to each target (see
``series.carry_many``). No pair of samples is ever enumerated.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.operators import series
from kinespark.operators.stats import exact_percentiles
from kinespark.session import discard, materialise


def grid_length(span: Column, rate: Column, rule: str) -> Column:
    """Number of grid points over ``span`` seconds: ``half_open`` (the end is
    left out), ``rounded`` or ``floored`` (both ends counted)."""
    steps = span * rate
    return {
        "half_open": F.ceil(steps),
        "rounded": F.bround(steps, 0).cast("long") + 1,
        "floored": F.floor(steps) + 1,
    }[rule].cast("long")


def expand(ranges: DataFrame, n: Column, name: str = "i", width: int = series.FRAMES_PER_BLOCK) -> DataFrame:
    """One row per grid index 0..n-1. Blocks are spread first, so a long trial's
    grid is generated by many tasks."""
    d = ranges.withColumn("_n", n).where("_n > 0")
    d = d.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / width))))
    d = d.repartition("_b", *[c for c in ranges.columns])
    lo = F.col("_b") * width
    hi = F.least(lo + width, F.col("_n")) - 1
    return d.withColumn(name, F.explode(F.sequence(lo, hi))).drop("_n", "_b")


def time_grid(
    ranges: DataFrame, rate: Column | float, rule: str, t0: str = "t0", t1: str = "t1"
) -> DataFrame:
    """Rows (keys, i, t) with t = t0 + i / rate for every (keys, t0, t1) range."""
    r = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    d = expand(ranges, grid_length(F.col(t1) - F.col(t0), r, rule))
    return d.withColumn("t", F.col(t0) + F.col("i") / r)


def ranges(df: DataFrame, keys: Sequence[str], t: str = "t") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(t).alias("t0"), F.max(t).alias("t1"))


def overlap_range(a: DataFrame, b: DataFrame, keys: Sequence[str], t: str = "t", shift: float | Column = 0.0) -> DataFrame:
    """Common (t0, t1) of two series, ``shift`` added to the first; keys without
    overlap are dropped."""
    s = F.lit(shift) if isinstance(shift, float) else shift
    ra = ranges(a, keys, t).select(*keys, (F.col("t0") + s).alias("a0"), (F.col("t1") + s).alias("a1"))
    d = ra.join(ranges(b, keys, t), list(keys))
    return d.select(*keys, F.greatest("a0", "t0").alias("t0"), F.least("a1", "t1").alias("t1")).where("t1 > t0")


def sampling_rate(df: DataFrame, keys: Sequence[str], t: str = "t", block_s: float = series.SECONDS_PER_BLOCK) -> DataFrame:
    """Two estimates per key: 1 / median step and 1 / mean step (4 decimals)."""
    d = series.carry(df.select(*keys, t), keys, [t], series.block_of(t, block_s), F.col(t), "_p", inclusive=False)
    d = d.select(*keys, (F.col(t) - F.col("_p")).alias("dt")).where("dt is not null")
    med = exact_percentiles(d, keys, "dt", {"med": 0.5})
    mean = d.groupBy(*keys).agg(F.avg("dt").alias("mean_dt"))
    d = med.join(mean, list(keys))
    inv = lambda c: F.when(F.col(c) > 0, 1.0 / F.col(c))
    return d.select(*keys, inv("med").alias("rate_median"), F.round(inv("mean_dt"), 4).alias("rate_mean"))


def bracket(
    samples: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    t: str = "t",
    block_s: float = series.SECONDS_PER_BLOCK,
    whole_row: bool = False,
    totals: dict[str, Column] | None = None,
) -> DataFrame:
    """Targets with the last sample at or before and the first one after them:
    ``prev_<v>`` and ``next_<v>`` structs of (t, v), per channel, so that a
    channel's own gaps are skipped. ``whole_row`` brackets by row instead and
    yields ``prev`` and ``next`` structs of (t, values). ``totals`` counts expressions
    over the samples (struct ``_s``) of a key."""
    keys = list(keys)
    extra = [c for c in targets.columns if c not in (*keys, t)]
    s = samples.select(
        *keys, F.col(t), F.lit(0).alias("_is"), F.struct(F.col(t).alias("t"), *values).alias("_s"),
        F.lit(None).cast(targets.select(F.struct(*extra) if extra else F.lit(1)).schema[0].dataType).alias("_x"),
    )
    g = targets.select(
        *keys, F.col(t), F.lit(1).alias("_is"), F.lit(None).cast(s.schema["_s"].dataType).alias("_s"),
        (F.struct(*extra) if extra else F.lit(1)).alias("_x"),
    )
    want: dict[str, tuple[Column, bool]] = {}
    if whole_row:
        row = F.col("_s")
        want = {"prev": (row, True), "next": (row, False)}
    else:
        for v in values:
            one = F.when(F.col(f"_s.{v}").isNotNull(), F.struct(F.col("_s.t").alias("t"), F.col(f"_s.{v}").alias("v")))
            want[f"prev_{v}"], want[f"next_{v}"] = (one, True), (one, False)
    d = series.carry_many(
        s.unionByName(g), keys, [t, "_is"], series.block_of(t, block_s), want, totals=totals, place=t
    ).where("_is = 1")
    return d.select(*keys, t, *[F.col("_x")[c].alias(c) for c in extra], *want, *(totals or {}))


def lerp(t: Column, prev: Column, nxt: Column, outside: str = "null") -> Column:
    """Linear value between two (t, v) structs; a sample at ``t`` is taken as is."""
    inner = prev["v"] + (nxt["v"] - prev["v"]) * ((t - prev["t"]) / (nxt["t"] - prev["t"]))
    w = F.when(prev["t"] == t, prev["v"]).when(prev.isNotNull() & nxt.isNotNull(), inner)
    return F.coalesce(w, prev["v"], nxt["v"]) if outside == "clamp" else w


def interpolate(
    samples: DataFrame,
    targets: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    t: str = "t",
    outside: str = "null",
    min_samples: int = 2,
    block_s: float = series.SECONDS_PER_BLOCK,
) -> DataFrame:
    """Values of each channel at the target times. Outside a channel's range the
    result is NULL, or the end value with ``outside='clamp'``. Channels with
    fewer than ``min_samples`` known values stay NULL."""
    counts = {f"_n_{v}": F.col(f"_s.{v}") for v in values} if min_samples > 1 else None
    d = bracket(samples, targets, keys, values, t, block_s, totals=counts)
    out = []
    for v in values:
        c = lerp(F.col(t), F.col(f"prev_{v}"), F.col(f"next_{v}"), outside)
        out.append((F.when(F.col(f"_n_{v}") >= min_samples, c) if min_samples > 1 else c).alias(v))
    return d.select(*targets.columns, *out)


#: Placed grid rows that a task makes, and the stretches that it sorts for them, on average.
ROWS_PER_TASK, STRETCHES_PER_TASK = 1 << 20, 1 << 17


def on_grid(
    samples: DataFrame,
    spans: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    rate: Column | float,
    rule: str,
    t: str = "t",
    outside: str = "null",
    min_samples: int = 2,
    block_s: float = series.SECONDS_PER_BLOCK,
    width: int = series.FRAMES_PER_BLOCK,
    halo: int | None = None,
) -> DataFrame:
    """:func:`interpolate` at the grid times of ``spans`` (keys, t0, t1, columns that stay): rows
    (spans without t0 and t1, i, t, values). Only samples are shuffled: each one makes the grid rows
    up to the next one, the first one also those before it. Keys without samples have no rows.

    ``halo`` places the rows for an operator that follows: a task makes whole groups of blocks of
    ``width`` in order, each with the ``halo`` rows on both sides, so the rows themselves need no
    shuffle. Columns ``_grp`` and ``_n``, the rows of the key, are added. The samples' stretches of
    the grid are written first; nothing reads the samples any more."""
    keys, values = list(keys), list(values)
    r = F.lit(float(rate)) if isinstance(rate, (int, float)) else rate
    spans = spans.withColumns({"_r": r, "_n": grid_length(F.col("t1") - F.col("t0"), r, rule)}).where("_n > 0")
    d = samples.select(*keys, F.col(t).alias("t"), *values).where("t is not null")
    block, used = series.block_of("t", block_s), []
    if halo is not None:
        # a key of few samples is one block: sparse blocks would need a summary for each sample
        used = [materialise(d.groupBy(*keys).agg(F.count(F.lit(1)).alias("_many")).where(f"_many > {series.FRAMES_PER_BLOCK}"), "many")]
        d = d.join(used[0], keys, "left")
        block = F.when(F.col("_many").isNotNull(), block).otherwise(F.lit(0).cast("long"))
    d = d.withColumn("_blk", block)
    if halo is not None:
        d = d.drop("_many").repartition(*keys, "_blk")  # before the pairs of the window are made
    channels = {**{v: F.col(v) for v in values}, "_row": F.col("t")}
    aggs = []
    for n, v in channels.items():
        at = F.when(v.isNotNull(), F.col("t"))
        for side, end, by in (("p", F.max, F.max_by), ("n", F.min, F.min_by)):
            aggs += [end(at).alias(f"_{side}t_{n}"), by(v, at).alias(f"_{side}v_{n}")]
    # plain columns aggregate by hash; the pairs are made afterwards
    tails = d.groupBy(*keys, "_blk").agg(*aggs, *[F.count(v).alias(f"_t__n_{v}") for v in values])
    pair = lambda side, n: F.when(F.col(f"_{side}t_{n}").isNotNull(), F.struct(F.col(f"_{side}t_{n}").alias("t"), F.col(f"_{side}v_{n}").alias("v"))).alias(f"_t_{side}_{n}")
    tails = tails.select(*keys, "_blk", *[pair(s, n) for n in channels for s in "pn"], *[f"_t__n_{v}" for v in values])
    reach = {f"{s}_{n}": (F.lit(None), s == "p") for n in channels for s in "pn"}
    used.append(materialise(tails, "tails"))
    ends = series._scan(used[-1], keys, reach, {f"_n_{v}": F.lit(None) for v in values}).join(spans, keys)

    for n, v in channels.items():
        d = d.withColumn(f"_k_{n}", F.when(v.isNotNull(), F.struct(F.col("t").alias("t"), v.alias("v"))))
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)}, _blk ORDER BY t)"
    d = d.select(*keys, "_blk", "t", *[f"_k_{n}" for n in channels], *[
        F.expr(f"{fn}(`_k_{n}`, 1) IGNORE NULLS {over}").alias(f"_l_{s}_{n}") for n in channels for s, fn in (("p", "lag"), ("n", "lead"))])
    d = d.join(ends.hint("merge"), [*keys, "_blk"])
    near = lambda s, n: F.coalesce(F.col(f"_l_{s}_{n}"), F.col(f"_c_{s}_{n}"))

    def place(c: Column) -> Column:
        """First grid index at or after a time."""
        time = lambda i: F.col("t0") + i / F.col("_r")
        i = F.ceil((c - F.col("t0")) * F.col("_r")).cast("long")
        i = F.when(time(i - 1) >= c, i - 1).when(time(i) < c, i + 1).otherwise(i)
        return F.least(F.greatest(i, F.lit(0)), F.col("_n"))

    more = [c for c in spans.columns if c not in (*keys, "t0", "t1", "_r", "_n")]
    d = d.select(
        *keys, *more, "t0", "_r", "_n", place(F.col("t")).alias("_lo"), F.when(near("n", "_row").isNull(), F.col("_n")).otherwise(place(near("n", "_row")["t"])).alias("_hi"),
        near("p", "_row").isNull().alias("_first"), *[f"_c__n_{v}" for v in values],
        *[c for v in values for c in (F.coalesce(F.col(f"_k_{v}"), near("p", v)).alias(f"_p_{v}"), near("n", v).alias(f"_n_{v}"), F.col(f"_k_{v}"))])
    part = lambda lo, hi, early: F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(early).alias("early"))
    own, early = part(F.col("_lo"), F.col("_hi"), False), part(F.lit(0).cast("long"), F.col("_lo"), True)
    d = d.withColumn("_part", F.explode(F.when(F.col("_first"), F.array(early, own)).otherwise(F.array(own)))).where("_part.lo < _part.hi")
    lo, hi, before = F.col("_part.lo"), F.col("_part.hi"), F.col("_part.early")
    prev = lambda v: F.when(~before, F.col(f"_p_{v}"))
    nxt = lambda v: F.when(before, F.coalesce(F.col(f"_k_{v}"), F.col(f"_n_{v}"))).otherwise(F.col(f"_n_{v}"))
    enough = lambda v, c: F.when(F.col(f"_c__n_{v}") >= min_samples, c) if min_samples > 1 else c
    if halo is None:
        d = d.withColumn("_b", F.explode(F.sequence(F.floor(lo / width), F.floor((hi - 1) / width))))
        d = d.withColumn("i", F.explode(F.sequence(F.greatest(lo, F.col("_b") * width), F.least(hi, F.col("_b") * width + width) - 1)))
        d = d.withColumn("t", F.col("t0") + F.col("i") / F.col("_r"))
        return d.select(*keys, *more, "i", "t", *[enough(v, lerp(F.col("t"), prev(v), nxt(v), outside)).alias(v) for v in values])

    rows, g = series.group_rows(width), F.col("_grp")
    d = d.select(*keys, *more, "t0", "_r", "_n", lo.alias("_lo"), hi.alias("_hi"), *[enough(v, c(v)).alias(n + v) for v in values for n, c in (("_p_", prev), ("_n_", nxt))])
    d = materialise(d, "stretches")
    discard(*used)
    made, stretches = d.agg(F.coalesce(F.sum(F.col("_hi") - F.col("_lo")), F.lit(0)), F.count(F.lit(1))).first()
    parts = math.ceil(made / ROWS_PER_TASK + stretches / STRETCHES_PER_TASK) or 1
    last = F.floor((F.col("_n") - 1) / rows)
    d = d.withColumn("_grp", F.explode(F.sequence(
        F.greatest(F.floor((F.col("_lo") - halo) / rows), F.lit(0).cast("long")), F.least(F.floor((F.col("_hi") - 1 + halo) / rows), last))))
    d = d.withColumns({"_lo": F.greatest("_lo", g * rows - halo), "_hi": F.least("_hi", g * rows + (rows + halo))})
    d = d.repartition(parts, *keys, "_grp").sortWithinPartitions(*keys, "_grp", "_lo")
    d = d.withColumn("i", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)))
    d = d.withColumn("t", F.col("t0") + F.col("i") / F.col("_r"))
    return d.select(*keys, *more, "i", "t", *[lerp(F.col("t"), F.col(f"_p_{v}"), F.col(f"_n_{v}"), outside).alias(v) for v in values], "_grp", "_n")


def whole_frames(samples: DataFrame, items: DataFrame, keys: Sequence[str], item: str, values: Sequence[str], t: str = "t") -> DataFrame:
    """(keys, t, kp): one row per time with an array of value structs in the order of the
    key's ``items`` (keys, items); NULL for an item that the frame lacks or has in part."""
    keys = list(keys)
    f = samples.groupBy(*keys, t).agg(F.collect_list(F.struct(item, *values)).alias("_kp")).join(items, keys)

    def cell(j: Column) -> Column:
        one = F.get(F.filter("_kp", lambda s: s[item] == j), F.lit(0))
        whole = F.lit(True)
        for v in values:
            whole = whole & one[v].isNotNull()
        return F.when(whole, F.struct(*[one[v].alias(v) for v in values]))

    return f.select(*keys, t, F.transform("items", cell).alias("kp"))


def interpolate_frames(
    samples: DataFrame, targets: DataFrame, items: DataFrame, keys: Sequence[str], item: str, values: Sequence[str], t: str = "t",
    block_s: float = series.SECONDS_PER_BLOCK,
) -> DataFrame:
    """(targets, kp): interpolated value structs of all ``items`` at once. Frames are
    bracketed, not items; an item that isn't known in both frames around a time is
    NULL and needs :func:`interpolate` on its own series."""
    frames = whole_frames(samples, items, keys, item, values, t)
    b = bracket(frames, targets, keys, ["kp"], t, block_s, whole_row=True)
    u, p, n = F.col(t), F.col("prev"), F.col("next")
    share = (u - p["t"]) / (n["t"] - p["t"])

    def between(x: Column, y: Column) -> Column:
        return F.when(x.isNotNull() & y.isNotNull(), F.struct(*[F.when(p["t"] == u, x[v]).otherwise(x[v] + (y[v] - x[v]) * share).alias(v) for v in values]))

    return b.select(*targets.columns, F.zip_with("prev.kp", "next.kp", between).alias("kp"))


def nearest(
    samples: DataFrame,
    requests: DataFrame,
    keys: Sequence[str],
    values: Sequence[str],
    t: str = "t",
    tolerance: float | None = None,
    block_s: float = series.SECONDS_PER_BLOCK,
) -> DataFrame:
    """Nearest sample of each request as struct ``hit`` (t, values); the earlier
    one on ties. Beyond ``tolerance`` seconds there is none."""
    d = bracket(samples, requests, keys, values, t, block_s, whole_row=True)
    before, after = F.col(t) - F.col("prev.t"), F.col("next.t") - F.col(t)
    take_prev = F.col("next").isNull() | (before <= after)
    hit = F.when(F.col("prev").isNotNull() & take_prev, F.col("prev")).otherwise(F.col("next"))
    d = d.withColumn("hit", hit)
    if tolerance is not None:
        d = d.withColumn("hit", F.when(F.abs(F.col("hit.t") - F.col(t)) <= tolerance, F.col("hit")))
    return d.select(*requests.columns, "hit")


def fill_gaps(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], width: int = series.FRAMES_PER_BLOCK, extent: bool = False
) -> DataFrame:
    """Fill NULLs by row position: linear inside, end values outside. ``extent`` adds the key's
    first and last index, ``_lo`` and ``_hi``."""
    want: dict[str, tuple[Column, bool]] = {}
    for v in values:
        one = F.when(F.col(v).isNotNull(), F.struct(F.col(index).alias("t"), F.col(v).alias("v")))
        want[f"_p_{v}"], want[f"_n_{v}"] = (one, True), (one, False)
    d = series.carry_many(df, keys, [index], series.block_of(index, width), want, place=index, extent=index if extent else None)
    new = {
        v: F.coalesce(F.col(v), lerp(F.col(index), F.col(f"_p_{v}"), F.col(f"_n_{v}"), "clamp")) for v in values
    }
    return d.select(*[new[c].alias(c) if c in new else F.col(c) for c in df.columns], *(("_lo", "_hi") if extent else ()))


def evaluation_times(
    pred: DataFrame, ref: DataFrame, mode: str, rate: float = 100.0, keys: Sequence[str] = ("trial",), t: str = "t",
    block_s: float = series.SECONDS_PER_BLOCK,
) -> DataFrame:
    """Target times (keys, i, t): a half-open grid at ``rate`` over the overlap
    (``grid``), a floored grid at ``rate`` (``hz``) or at the slower of both
    sampling rates (``common``), the prediction times inside the reference's
    range (``pred``), or the reference times (``ref``). ``i`` numbers the times
    of a key."""
    keys = list(keys)
    if mode in ("grid", "hz", "common"):
        r = overlap_range(pred, ref, keys, t)
        if mode == "common":
            rp = sampling_rate(pred.select(*keys, t).distinct(), keys, t, block_s).select(*keys, F.col("rate_median").alias("_a"))
            rr = sampling_rate(ref.select(*keys, t).distinct(), keys, t, block_s).select(*keys, F.col("rate_median").alias("_b"))
            r = r.join(rp, keys, "left").join(rr, keys, "left")
            hz = F.least(F.coalesce("_a", F.lit(25.0)), F.coalesce("_b", F.lit(100.0)))
            r = r.withColumn("_hz", hz).drop("_a", "_b")
            return time_grid(r, F.col("_hz"), "floored").select(*keys, "i", "t")
        return time_grid(r, rate, "half_open" if mode == "grid" else "floored").select(*keys, "i", "t")
    base = (pred if mode == "pred" else ref).select(*keys, t).distinct()
    if mode == "pred":
        r = ranges(ref, keys, t)
        base = base.join(r, keys).where(F.col(t).between(F.col("t0"), F.col("t1"))).select(*keys, t)
    return series.add_running_index(base, keys, [t], series.block_of(t, block_s), "i").select(*keys, "i", t)
