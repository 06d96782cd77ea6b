"""Recursive filters along long series: every block on its own, states carried between blocks.

A filter is a sum of one-pole recursions w <- p w + x (``kernels.Poles``). Over a block
of L samples such a recursion takes the state before it to p**L times that state plus
what the block adds, so the maps of blocks compose. One pass filters every block
from state zero and sums up what it adds; the states before all blocks follow from
a prefix scan of the summaries, first inside groups of blocks, then across them; the
rows of later blocks get the closed-form response to the state before them. A series
that fits one block needs nothing carried.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.functions.kernels import Poles, odd_extension, run_poles
from kinespark.operators import blocks, series
from kinespark.session import materialise

#: Blocks whose maps are composed in one task.
GROUP = 1024
Design = Callable[..., Poles]


def _pairs(z: np.ndarray) -> list[float]:
    return np.ascontiguousarray(z, complex).view(float).ravel().tolist()


def _complex(rows: Sequence, n: int) -> np.ndarray:
    x = np.array(list(rows), float).reshape(len(rows), n, -1, 2)
    return x[..., 0] + 1j * x[..., 1]


def apply(
    df: DataFrame, keys: Sequence[str], index: str, values: Sequence[str], params: Sequence[str], design: Design, both_ways: bool, pad: int = 0,
    short: Design | None = None, width: int = series.FRAMES_PER_BLOCK, reused: bool = False,
) -> DataFrame:
    """Filter ``values`` along a gap-free ``index``; ``design`` makes the filter from a row's ``params``
    (columns that are constant in a key, dropped from the result).

    The series is taken as constant before its first and after its last sample.
    ``both_ways`` filters forward, then backward over the series extended oddly by
    ``pad`` samples; keys with at most ``pad`` rows get the forward filter ``short``. Columns
    ``_lo`` and ``_hi``, if there, are the key's first and last index and are dropped too.
    ``reused``: the result is read more than once, so all of it is written."""
    keys, values, params = list(keys), list(values), list(params)
    out_cols = [c for c in df.columns if c not in (*params, "_lo", "_hi")]
    width = max(width, 4 * pad, 8)
    d = df if {"_lo", "_hi"} <= set(df.columns) else series.per_key(df, keys, F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    n = F.col("_hi") - F.col("_lo") + 1
    last = F.greatest(F.floor(n / width) - 1, F.lit(0)).cast("long")  # a short rest belongs to the block before it
    d = d.withColumn("_last", last).withColumn("_blk", F.least(series.block_of(F.col(index) - F.col("_lo"), width), F.col("_last")))

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        x = pdf[values].to_numpy(dtype=float)
        cuts = np.append(starts, len(pdf))
        blk, tail = pdf["_blk"].to_numpy()[starts], pdf["_last"].to_numpy()[starts]
        y = np.empty_like(x)
        at, length = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
        sums: list = [None] * len(pdf)
        settings = list(zip(*[pdf[p].to_numpy()[starts] for p in params]))
        brief = (tail == 0) & (np.diff(cuts) <= pad)
        for few in (False, True):
            chosen = np.flatnonzero(brief == few)
            if not len(chosen):
                continue
            ext, front = [], []
            for s in chosen:
                part, first, end = x[cuts[s]:cuts[s + 1]], blk[s] == 0, blk[s] == tail[s]
                front.append(pad if first and pad and not few else 0)
                ext.append(odd_extension(part, pad, first, end) if pad and not few else part)
            spec = [(short if few else design)(*settings[s]) for s in chosen]
            begins, ends = blk[chosen] == 0, blk[chosen] == tail[chosen]
            res, ahead, back = run_poles(ext, spec, begins, ends, both_ways and not few)
            for k, s in enumerate(chosen):
                a, b = cuts[s], cuts[s + 1]
                y[a:b] = res[k][front[k]:front[k] + b - a]
                at[a:b] = np.arange(front[k], front[k] + b - a)
                length[a:b] = len(ext[k])
                if tail[s] > 0:
                    sums[a] = _pairs(np.stack([ahead[k], back[k]]))
        out = pdf[[*out_cols, *params, "_blk"]].copy()
        out[values] = y
        return out.assign(_at=at, _len=length, _end=pdf["_blk"].to_numpy() == pdf["_last"].to_numpy(), _more=pdf["_last"].to_numpy() > 0, _sum=sums)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*out_cols, *params).schema)
    done = materialise(blocks.map_blocks(d, keys, index, run, f"{own}, _blk long, _at long, _len long, _end boolean, _more boolean, _sum array<double>"), "filtered")
    long = done.where("_more")
    if not long.take(1):  # no series goes on in a second block
        return done.select(*out_cols)
    states = _states(long.where("_sum is not null").select(*keys, *params, "_blk", "_len", "_end", "_sum"), keys, params, design, len(values), both_ways)
    fixed = long.join(states, [*keys, "_blk"])

    def correct(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            y = pdf[values].to_numpy(dtype=float)
            for setting, rows in pdf.reset_index(drop=True).groupby(params, sort=False).indices.items():
                spec = design(*(setting if isinstance(setting, tuple) else (setting,)))
                p = len(spec.poles)
                w, v = (_complex(pdf[c].iloc[rows].to_list(), p) for c in ("_w", "_v"))
                y[rows] += response(spec, pdf["_at"].to_numpy()[rows], pdf["_len"].to_numpy()[rows], w, v, both_ways)
            out = pdf[out_cols].copy()
            out[values] = y
            yield out

    fixed = fixed.mapInPandas(correct, df.select(*out_cols).schema)
    fixed = materialise(fixed, "filtered") if reused else fixed
    return done.where("not _more").select(*out_cols).unionByName(fixed)


def response(spec: Poles, at: np.ndarray, length: np.ndarray, w: np.ndarray, v: np.ndarray, both_ways: bool) -> np.ndarray:
    """What states ``w`` before and ``v`` behind a block add to its samples ``at``; states are (n, poles, channels)."""
    k, rest = at[:, None], (length - at)[:, None]
    ahead = spec.poles ** (k + 1)
    h = np.real(np.einsum("p,np,npc->nc", spec.weights, ahead, w))
    if not both_ways:
        return h
    u = spec.poles[None, :, None] ** rest[:, :, None] * v
    for pole, weight, state in spec.every(w):
        turn = pole * spec.poles[None, :]
        u = u + (weight * pole ** (k + 1) * (1 - turn ** rest) / (1 - turn))[:, :, None] * state[:, None, :]
    return spec.direct * h + np.real(np.einsum("p,npc->nc", spec.weights, u))


def _states(sums: DataFrame, keys: list[str], params: list[str], design: Design, channels: int, both_ways: bool) -> DataFrame:
    """keys, _blk, _w, _v: the states before and behind each block."""
    poles = lambda pdf: [design(*s) for s in zip(*[pdf[p] for p in params])]
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sums.select(*keys, *params, "_blk", "_len", "_end").schema)

    def ready(batches):
        for pdf in batches:
            spec = poles(pdf)
            both = [_complex([s], 2 * len(q.poles))[0] for s, q in zip(pdf["_sum"], spec)]
            gain = [_pairs(q.poles ** n) for q, n in zip(spec, pdf["_len"])]
            yield pdf[[*keys, *params, "_blk", "_len", "_end"]].assign(
                gain=gain, state=[_pairs(b[:len(q.poles)]) for b, q in zip(both, spec)], back=[_pairs(b[len(q.poles):]) for b, q in zip(both, spec)])

    wide = "gain array<double>, state array<double>, back array<double>"
    d = materialise(sums.mapInPandas(ready, f"{shape}, {wide}"), "states")
    ahead = prefix(d, keys, "_blk", "_w")
    if not both_ways:
        return materialise(ahead.select(*keys, "_blk", "_w", F.col("_w").alias("_v")), "states")

    def turned(batches):
        """The state that each block hands to the one before it once its own incoming state is known."""
        for pdf in batches:
            state, given = [], []
            for q, n, end, w, back in zip(poles(pdf), pdf["_len"], pdf["_end"], pdf["_w"], pdf["back"]):
                w, back = _complex([w], len(q.poles)), _complex([back], len(q.poles))[0]
                v = np.zeros_like(w)
                if end:  # constant behind the last sample
                    v[0] = response(q, np.array([n - 1]), np.array([n]), w, v, False) / (1 - q.poles)[:, None]
                u = (q.poles ** n)[:, None] * v[0]
                for pole, weight, s in q.every(w):
                    turn = pole * q.poles
                    u = u + (weight * pole * (1 - turn ** n) / (1 - turn))[:, None] * s[0][None, :]
                state.append(_pairs(back + u))
                given.append(_pairs(v[0]))
            yield pdf[[*keys, *params, "_blk", "_len", "_end", "gain", "_w"]].assign(state=state, given=given)

    d = materialise(ahead.mapInPandas(turned, f"{shape}, gain array<double>, _w array<double>, state array<double>, given array<double>"), "states")
    out = prefix(d.withColumn("_back", -F.col("_blk")), keys, "_back", "_v")
    return materialise(out.select(*keys, "_blk", "_w", F.when(F.col("_end"), F.col("given")).otherwise(F.col("_v")).alias("_v")), "states")


def prefix(df: DataFrame, keys: Sequence[str], order: str, name: str) -> DataFrame:
    """Column ``name``: the state before each row when s <- gain s + state runs along ``order``.

    ``gain`` and ``state`` are complex numbers as (real, imaginary) pairs, one gain
    for each equal share of the state. Rows are composed in groups of GROUP places,
    the groups' maps in turn per key, and each group is run again from its state."""
    keys = list(keys)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def read(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n = len(pdf["gain"].iloc[0]) // 2
        return _complex(pdf["gain"], n), _complex(pdf["state"], n)

    def composed(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        rows = []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            total, s = 1.0 + 0j, 0j
            for gain, state in zip(*read(pdf.iloc[a:b])):
                total, s = gain * total, gain * s + state
            rows.append((_pairs(total), _pairs(s)))
        return pdf[[*keys, "_blk"]].iloc[starts].set_axis([*keys, "_ord"], axis=1).assign(gain=[r[0] for r in rows], state=[r[1] for r in rows])

    def before(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        found = []
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            gains, states = read(pdf.iloc[a:b])
            s = np.zeros_like(states[0]) if "_in" not in pdf else _complex([pdf["_in"].iloc[a]], gains.shape[1])[0]
            for gain, state in zip(gains, states):
                found.append(_pairs(s))
                s = gain * s + state
        return pdf[[*keys, "_ord"]].assign(**{name: found})

    rows = df.select(*keys, F.col(order).alias("_ord"), F.floor(F.col(order) / GROUP).cast("long").alias("_blk"), "gain", "state")
    groups = blocks.map_blocks(rows, keys, "_ord", composed, f"{own}, _ord long, gain array<double>, state array<double>").withColumn("_blk", F.lit(0).cast("long"))
    entry = blocks.map_blocks(groups, keys, "_ord", before, f"{own}, _ord long, {name} array<double>")
    entry = entry.select(*keys, F.col("_ord").alias("_blk"), F.col(name).alias("_in"))
    out = blocks.map_blocks(rows.join(entry, [*keys, "_blk"]), keys, "_ord", before, f"{own}, _ord long, {name} array<double>")
    return df.join(out.withColumnRenamed("_ord", order), [*keys, order])
