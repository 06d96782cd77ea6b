"""Queries: grids, interpolation, nearest joins, filters and time alignment."""

import numpy as np
from pyspark.sql import functions as F

from kinespark.functions import kernels
from kinespark.operators import resample, series, smooth, stats, timealign
from kinespark.plans import fixtures as X
from kinespark.plans.registry import query, r6
from kinespark.session import discard, materialise

HOUR = 3600.0
K2 = ["trial", "marker"]


def sql_lerp(outside="null", v="x"):
    inner = f"CASE WHEN p.t=g.t THEN p.{v} WHEN p.t IS NOT NULL AND n.t IS NOT NULL THEN p.{v}+(n.{v}-p.{v})*((g.t-p.t)/(n.t-p.t)) END"
    return f"coalesce({inner}, p.{v}, n.{v})" if outside == "clamp" else inner


def asof(grid, samples, keys=("trial", "marker")):
    on = lambda a: " AND ".join(f"g.{k}={a}.{k}" for k in keys)
    return (f"{grid} g ASOF LEFT JOIN {samples} p ON {on('p')} AND g.t >= p.t "
            f"ASOF LEFT JOIN {samples} n ON {on('n')} AND g.t < n.t")


_N = {"half_open": "ceil((t1-t0)*r)", "rounded": "round_even((t1-t0)*r,0)+1", "floored": "floor((t1-t0)*r)+1"}


def sql_grid(rule, rate, src="f6"):
    return (f"SELECT trial, marker, i, t0 + i/r AS t FROM (SELECT trial, marker, min(t) t0, max(t) t1, {rate} AS r FROM {src} GROUP BY ALL), "
            f"LATERAL (SELECT unnest(range(({_N[rule]})::BIGINT)) AS i)")


X.VIEWS["f6v"] = (["f6"], "SELECT * FROM f6 WHERE x IS NOT NULL")
X.VIEWS["f6n"] = (["f6"], "SELECT trial, marker FROM f6 GROUP BY ALL HAVING count(x) >= 2")
X.VIEWS["g7"] = (["f6"], sql_grid("floored", "1/3600.0::DOUBLE"))
X.VIEWS["f7"] = (["g7", "f6v", "f6n"], f"SELECT g.trial, g.marker, g.i, g.t, {sql_lerp()} AS x FROM {asof('g7', 'f6v')} "
                                       "WHERE (g.trial, g.marker) IN (SELECT (trial, marker) FROM f6n)")


def hourly(spark, sf, rule="floored"):
    r = resample.ranges(X.irregular(spark, sf), K2)
    return resample.time_grid(r, 1 / HOUR, rule).select(*K2, "i", "t")


def regular(spark, sf, **place):
    """F6 on an hourly grid; series with fewer than two samples left out."""
    d = X.irregular(spark, sf)
    if place:
        d = materialise(d.select(*K2, "t", "x"), "samples")
    spans = resample.ranges(d, K2).join(d.groupBy(*K2).agg(F.count("x").alias("n")).where("n >= 2").select(*K2), K2)
    grid = resample.on_grid(d, spans, K2, ["x"], 1 / HOUR, "floored", block_s=X.DAY, **place)
    if place:  # the stretches of the grid are written
        discard(d)
    return grid


for _rule in ("half_open", "rounded", "floored"):
    def _make(rule):
        @query(f"win_1_grid_{rule}", ["f6"], f"SELECT trial, marker, count(*) n, round(max(t),6) t1 FROM ({sql_grid(rule, '1/3600.0::DOUBLE')}) GROUP BY ALL")
        def _(spark, sf):
            return hourly(spark, sf, rule).groupBy(*K2).agg(F.count(F.lit(1)).alias("n"), r6(F.max("t"), "t1"))
    _make(_rule)


@query("win_2_interpolate", ["f7"], "SELECT trial, marker, i, round(t,6) t, round(x,6) x FROM f7")
def _(spark, sf):
    return regular(spark, sf).select(*K2, "i", r6("t"), r6("x"))


@query("win_2_interpolate_big", ["f8"],
       f"WITH s AS (SELECT trial, marker, frame/60.0 AS t, x, y, z FROM f8), g AS (SELECT trial, marker, i, i/100.0 AS t FROM (SELECT trial, marker, "
       "max(t) t1 FROM s GROUP BY ALL HAVING count(*) > 1), LATERAL (SELECT unnest(range(floor(t1*100)::BIGINT+1)) AS i)), "
       f"q AS (SELECT g.trial, g.marker, {sql_lerp(v='x')} AS x, {sql_lerp(v='y')} AS y, {sql_lerp(v='z')} AS z FROM {asof('g', 's')}) "
       "SELECT trial, marker, count(x) n, round(avg(x),6) mx, round(avg(y),6) my, round(avg(z),6) mz FROM q GROUP BY ALL")
def _(spark, sf):
    d = materialise(X.markers_big(spark, sf).withColumn("t", F.col("frame") / 60.0), "samples")
    span = d.groupBy(*K2).agg(F.lit(0.0).alias("t0"), F.max("t").alias("t1"), F.count(F.lit(1)).alias("n")).where("n > 1")
    q = resample.on_grid(d, span.select(*K2, "t0", "t1"), K2, ["x", "y", "z"], 100.0, "floored")
    return q.groupBy(*K2).agg(F.count("x").alias("n"), *[r6(F.avg(c), f"m{c}") for c in "xyz"])


@query("win_3_interpolate_clamped", ["f6", "f6v"],
       f"WITH g AS (SELECT trial, marker, t + 1800.0 AS t, event_id FROM f6) SELECT g.event_id, round({sql_lerp('clamp')},6) x FROM {asof('g', 'f6v')}")
def _(spark, sf):
    d = X.irregular(spark, sf)
    g = d.select(*K2, (F.col("t") + 1800.0).alias("t"), "event_id")
    return resample.interpolate(d, g, K2, ["x"], outside="clamp", min_samples=1, block_s=X.DAY).select("event_id", r6("x"))


_PR = ("WITH a AS (SELECT trial, t, x FROM f6 WHERE event_id % 2 = 0), b AS (SELECT trial, t, x FROM f6 WHERE event_id % 2 = 1), "
       "o AS (SELECT * FROM (SELECT trial, greatest(a0,b0) t0, least(a1,b1) t1 FROM (SELECT trial, min(t) a0, max(t) a1 FROM a GROUP BY 1) "
       "JOIN (SELECT trial, min(t) b0, max(t) b1 FROM b GROUP BY 1) USING (trial)) WHERE t1 > t0) ")


def two_series(spark, sf):
    d = X.irregular(spark, sf)
    return d.where("event_id % 2 = 0").select("trial", "t", "x"), d.where("event_id % 2 = 1").select("trial", "t", "x")


@query("win_4_eval_times_grid", ["f6"],
       _PR + "SELECT trial, count(*) n, round(max(t),6) t1 FROM (SELECT trial, t0 + i/(1/3600.0::DOUBLE) AS t FROM o, LATERAL (SELECT unnest(range(ceil((t1-t0)*(1/3600.0::DOUBLE))::BIGINT)) AS i)) GROUP BY trial")
def _(spark, sf):
    a, b = two_series(spark, sf)
    return resample.evaluation_times(a, b, "grid", 1 / HOUR).groupBy("trial").agg(F.count(F.lit(1)).alias("n"), r6(F.max("t"), "t1"))


@query("win_4_eval_times_pred", ["f6"],
       _PR + "SELECT trial, i, round(t,6) t FROM (SELECT a.trial, t, row_number() OVER (PARTITION BY a.trial ORDER BY t)-1 i FROM a JOIN "
       "(SELECT trial, min(t) b0, max(t) b1 FROM b GROUP BY 1) r ON r.trial=a.trial WHERE t BETWEEN b0 AND b1)")
def _(spark, sf):
    a, b = two_series(spark, sf)
    return resample.evaluation_times(a, b, "pred", block_s=X.DAY).select("trial", "i", r6("t"))


@query("win_4_eval_times_common", ["f6"],
       _PR + ", rt AS (SELECT trial, least(max(r) FILTER (s='a'), max(r) FILTER (s='b')) r FROM (SELECT s, trial, 1.0::DOUBLE/median(dt) r FROM "
       "(SELECT s, trial, t - lag(t) OVER (PARTITION BY s, trial ORDER BY t) dt FROM (SELECT 'a' s, * FROM a UNION ALL SELECT 'b', * FROM b)) GROUP BY ALL) GROUP BY trial) "
       "SELECT trial, floor((t1-t0)*r)::BIGINT + 1 n FROM o JOIN rt USING (trial) WHERE r IS NOT NULL")
def _(spark, sf):
    a, b = two_series(spark, sf)
    both = a.groupBy("trial").agg(F.count(F.lit(1)).alias("c")).where("c > 1").join(
        b.groupBy("trial").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "trial")
    return resample.evaluation_times(a, b, "common", block_s=X.DAY).groupBy("trial").agg(F.count(F.lit(1)).alias("n")).join(both, "trial", "left_semi")


@query("win_5_fill_gaps", ["f6"],
       "WITH s AS (SELECT *, row_number() OVER (PARTITION BY trial, marker ORDER BY t)-1 i FROM f6), w AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b pi, "
       "last_value(x IGNORE NULLS) OVER b px, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER f ni, first_value(x IGNORE NULLS) OVER f nx FROM s "
       "WINDOW b AS (PARTITION BY trial, marker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY trial, marker ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
       "SELECT event_id, round(coalesce(x, px+(nx-px)*((i-pi)/(ni-pi)), px, nx),6) x FROM w")
def _(spark, sf):
    d = series.add_running_index(X.irregular(spark, sf), K2, ["t"], series.block_of("t", X.DAY), "i")
    return resample.fill_gaps(d, K2, "i", ["x"]).select("event_id", r6("x"))


def gappy(spark, sf, **place):
    """F7 as an indexed series with its gaps."""
    return regular(spark, sf, **place).drop("t").withColumn("x", F.when(F.col("i") % 11 != 5, F.col("x")))


def sql_moving_average(src, half, value="round(avg(f.x),6)"):
    """Filled, mirrored and averaged; gaps restored."""
    return f"""WITH ms AS ({src}), w AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b pi, last_value(x IGNORE NULLS) OVER b px,
 first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER f ni, first_value(x IGNORE NULLS) OVER f nx FROM ms
 WINDOW b AS (PARTITION BY trial, marker ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY trial, marker ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 f AS (SELECT trial, marker, i, x AS raw, coalesce(x, px+(nx-px)*((i-pi)/(ni-pi)), px, nx) x, max(i) OVER (PARTITION BY trial, marker) m FROM w),
 q AS (SELECT f.trial, f.marker, f.i, f.raw, d, CASE WHEN m = 0 THEN 0 ELSE abs((((f.i+d) % (2*m)) + 3*m) % (2*m) - m) END j FROM f, range(-{half}, {half}+1) o(d))
 SELECT q.trial, q.marker, q.i, CASE WHEN q.raw IS NOT NULL THEN {value} END x FROM q JOIN f ON f.trial=q.trial AND f.marker=q.marker AND f.i=q.j GROUP BY q.trial, q.marker, q.i, q.raw"""


@query("win_6_moving_average", ["f7"],
       sql_moving_average("SELECT trial, marker, i, CASE WHEN i % 11 <> 5 THEN x END x FROM f7", 3))
def _(spark, sf):
    return smooth.moving_average(gappy(spark, sf, width=64, halo=3), K2, "i", ["x"], 7, width=64, placed=True).select(*K2, "i", r6("x"))


@query("win_7_window_length", None,
       "SELECT c_custkey, CASE WHEN n%2=0 THEN n+1 ELSE n END n FROM (SELECT c_custkey, greatest(3, least(round_even(0.443::DOUBLE*fs/greatest(0.1, fc),0)::BIGINT, "
       "(2*fs)::BIGINT+1)) n FROM (SELECT c_custkey, 25.0+c_custkey%200 fs, (c_custkey%13)/2.0 fc FROM customer))")
def _(spark, sf):
    d = X.table(spark, sf, "customer")
    fs, fc = 25.0 + F.col("c_custkey") % 200, (F.col("c_custkey") % 13) / 2.0
    return d.select("c_custkey", smooth.window_length(fs, fc).alias("n"))


@query("win_8_upsample", ["f1"],
       "WITH s AS (SELECT trial, k AS marker, frame/60.0 AS t, x FROM f1), g AS (SELECT trial, marker, i, i/100.0 AS t FROM (SELECT trial, marker, max(t) t1 FROM s GROUP BY ALL), "
       "LATERAL (SELECT unnest(range(round_even(t1*100,0)::BIGINT+1)) AS i)), u AS (SELECT g.trial, g.marker, g.i, "
       + sql_lerp() + " AS x FROM " + asof("g", "s") + "), "
       + sql_moving_average("SELECT trial, marker, i, x FROM u", 3)[5:])
def _(spark, sf):
    d = X.pose_long(spark, sf).select("trial", F.col("k").alias("marker"), "frame", "x")
    return smooth.upsample(d, K2, "frame", ["x"], 60.0, 100.0, 6.0).select(*K2, "i", r6("x"))


def sql_upsampled(rate, target):
    """Linear at ``target``, averaged over three samples; trials at or above the target keep their frames."""
    n = f"SELECT trial, marker, i, i/{target}::DOUBLE AS t FROM (SELECT trial, marker, max(t) t1 FROM s WHERE fs < {target} GROUP BY ALL), LATERAL (SELECT unnest(range(round_even(t1*{target}::DOUBLE,0)::BIGINT+1)) AS i)"
    return (f"WITH s AS (SELECT trial, k AS marker, frame, x, {rate} AS fs, frame/({rate}) AS t FROM f1), g AS ({n}), u AS (SELECT g.trial, g.marker, g.i, {sql_lerp()} AS x FROM {asof('g', 's')}), "
            + sql_moving_average("SELECT trial, marker, i, x FROM u", 3)[5:] + f" UNION ALL SELECT trial, marker, frame, round(x,6) FROM s WHERE fs >= {target}")


@query("win_8_rate_per_trial", ["f1"], sql_upsampled("[60.0::DOUBLE, 100.0::DOUBLE, 250.0::DOUBLE][trial % 3 + 1]", 100.0))
def _(spark, sf):
    d = rated(X.pose_long(spark, sf).select("trial", F.col("k").alias("marker"), "frame", "x"))
    return smooth.upsample(d, K2, "frame", ["x"], "fs", 100.0, 6.0).select(*K2, "i", r6("x"))


_A = kernels.smoothing_alpha(60.0, 6.0)
_FOLD = ("SELECT trial, marker, i, round(y,6) x FROM (SELECT trial, marker, unnest(range(len(xs))) i, unnest(ys) y FROM (SELECT *, "
         "list_transform(range(1, len(xs)+1), lambda n: list_reduce(xs[1:n], lambda a, b: a + {a}*(b-a))) ys FROM "
         "(SELECT trial, marker, {rate} AS fs, list(x ORDER BY frame) xs FROM f8 WHERE trial IS NOT NULL GROUP BY ALL)))")
#: Rates of the trials by trial % 3.
RATES = (60.0, 100.0, 250.0)
SQL_RATE = f"[{', '.join(f'{r}::DOUBLE' for r in RATES)}][trial % 3 + 1]"


def rated(d):
    """``fs``: a rate per trial."""
    return d.withColumn("fs", F.element_at(F.array(*[F.lit(r) for r in RATES]), (F.col("trial") % 3 + 1).cast("int")))


def coefficients(fs, cutoff, order=4):
    """b, a and the settled state of the difference equation, and the first-order coefficient."""
    poles, gain = kernels.butterworth_poles(order, min(0.9999, cutoff / (fs * 0.5)))
    a, b = np.real(np.poly(poles)), gain * np.poly(-np.ones(order))
    step = np.zeros(order)
    z = np.zeros(order)
    settled = b.sum() / a.sum()  # output for a constant input of one
    for i in range(order - 1, -1, -1):
        z[i] = b[i + 1] - a[i + 1] * settled + (z[i + 1] if i + 1 < order else 0.0)
    return [fs, *b, *a[1:], *z, kernels.smoothing_alpha(fs, cutoff)]


def sql_zero_phase(src, cutoffs, pad=15):
    """(trial, marker, c, i, y): the difference equation run sample by sample, forward and backward,
    over ``src`` (trial, marker, c, i, v, fs) with odd extension; first order for series of up to ``pad`` rows."""
    names = ["fs", *[f"b{i}" for i in range(5)], *[f"a{i}" for i in range(1, 5)], *[f"z{i}" for i in range(4)], "al"]
    co = ", ".join("(" + ", ".join(f"{float(v)!r}::DOUBLE" for v in coefficients(fs, fc)) + ")" for fs, fc in cutoffs.items())
    step = lambda x, y: f"{x} AS x, b1*{x} - a1*{y} + {{1}} AS w0, b2*{x} - a2*{y} + {{2}} AS w1, b3*{x} - a3*{y} + {{3}} AS w2, b4*{x} - a4*{y} AS w3"
    first, later = step("xs[1]", "(b0*xs[1] + z0*xs[1])"), step("xs[j+2]", "(b0*xs[j+2] + w0)")

    def run(lists, name):
        start = first.format(0, *(f"z{i}*xs[1]" for i in range(1, 4)))
        go = later.format(0, *(f"w{i}" for i in range(1, 4)))
        return (f"{name} AS (SELECT k, 0 AS j, b0*xs[1] + z0*xs[1] AS y, {start} FROM {lists} UNION ALL "
                f"SELECT r.k, j+1, b0*xs[j+2] + w0, {go} FROM {name} r JOIN {lists} l ON l.k=r.k WHERE j+1 < len(xs))")

    return f"""WITH RECURSIVE co({', '.join(names)}) AS (VALUES {co}),
 l0 AS (SELECT trial, marker, c, any_value(fs) fs, list(v ORDER BY i) v, row_number() OVER () k FROM ({src}) GROUP BY trial, marker, c),
 l1 AS (SELECT k, v, len(v) n, co.*, list_concat(list_transform(range({pad}, 0, -1), lambda q: 2*v[1] - v[q+1]), v, list_transform(range(1, {pad}+1), lambda q: 2*v[len(v)] - v[len(v)-q])) xs
        FROM l0 JOIN co USING (fs) WHERE len(v) > {pad}),
 {run('l1', 'f')},
 l2 AS (SELECT k, any_value(n) n, any_value(COLUMNS('^([abz][0-9])$')), list(y ORDER BY j DESC) xs FROM f JOIN (SELECT * EXCLUDE (xs, v) FROM l1) USING (k) GROUP BY k),
 {run('l2', 'g')},
 o AS (SELECT k, n + {pad} - 1 - j AS i, y FROM g JOIN (SELECT k, n FROM l2) USING (k) WHERE n + {pad} - 1 - j BETWEEN 0 AND n - 1
       UNION ALL SELECT k, unnest(range(len(v))), unnest(list_transform(range(1, len(v)+1), lambda q: list_reduce(v[1:q], lambda a, b: a + al*(b-a)))) FROM l0 JOIN co USING (fs) WHERE len(v) <= {pad})
 SELECT trial, marker, c, i, y FROM o JOIN (SELECT k, trial, marker, c FROM l0) USING (k)"""


def sql_channels(src, rate, value="{c}"):
    return " UNION ALL ".join(f"SELECT trial, marker, '{c}' c, frame i, {value.format(c=c)} v, {rate} fs FROM {src}" for c in "xyz")


def sql_wide(inner, extra="", digits=6):
    return (f"SELECT trial, marker, i{extra}, " + ", ".join(f"round(max(y) FILTER (c='{c}'),{digits})+0.0 {c}" for c in "xyz") + f" FROM ({inner}) GROUP BY ALL")


def sql_downsampled(src, cutoffs, target):
    """The filtered series on the floored grid; a rate at the target or below keeps the frames."""
    grid = (f"SELECT trial, marker, c, i, i/{target}::DOUBLE AS t, fs FROM (SELECT trial, marker, c, fs, max(t) t1 FROM z GROUP BY ALL HAVING fs > {target}), "
            f"LATERAL (SELECT unnest(range(floor(t1*{target}::DOUBLE)::BIGINT+1)) i)")
    return (f"WITH r AS (SELECT DISTINCT trial, marker, c, fs FROM ({src})), z AS (SELECT trial, marker, c, i, i/fs AS t, y x, fs FROM ({sql_zero_phase(src, cutoffs)}) JOIN r USING (trial, marker, c)), "
            f"g AS ({grid}) SELECT g.trial, g.marker, g.c, g.i, g.t, {sql_lerp('clamp')} y FROM {asof('g', 'z', ('trial', 'marker', 'c'))} "
            f"UNION ALL SELECT trial, marker, c, i, t, x FROM z WHERE fs <= {target}")


@query("win_9_first_order_lowpass", ["f8"], _FOLD.format(a=f"{_A!r}::DOUBLE", rate="1"))
def _(spark, sf):
    d = X.markers_big(spark, sf).select("trial", "marker", "frame", "x")
    return smooth.first_order_lowpass(d, K2, "frame", ["x"], 60.0, 6.0).select(*K2, F.col("frame").alias("i"), r6("x"))


@query("win_9_rate_per_trial", ["f8"],
       _FOLD.format(a="CASE fs " + " ".join(f"WHEN {r} THEN {kernels.smoothing_alpha(r, 6.0)!r}::DOUBLE" for r in RATES) + " END", rate=SQL_RATE))
def _(spark, sf):
    d = rated(X.markers_big(spark, sf)).select("trial", "marker", "frame", "x", "fs")
    return smooth.first_order_lowpass(d, K2, "frame", ["x"], "fs", 6.0).select(*K2, F.col("frame").alias("i"), r6("x"))


@query("win_10_butterworth", ["f8"], sql_wide(sql_zero_phase(sql_channels("f8", "60.0::DOUBLE"), {60.0: 6.0})).replace("i, round", "i AS frame, round", 1))
def _(spark, sf):
    d = X.markers_big(spark, sf)
    return smooth.butterworth(d, K2, "frame", ["x", "y", "z"], 60.0, 6.0).select(*K2, "frame", r6("x"), r6("y"), r6("z"))


@query("win_10_rate_per_trial", ["f8"], sql_wide(sql_zero_phase(sql_channels("f8", SQL_RATE), {r: 6.0 for r in RATES}), digits=4))
def _(spark, sf):
    d = smooth.butterworth(rated(X.markers_big(spark, sf)), K2, "frame", ["x", "y", "z"], "fs", 6.0)
    return d.select(*K2, F.col("frame").alias("i"), *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


@query("udf_2_sequential_filter", ["f8"],
       f"SELECT trial, marker, count(y) n, round(min(y),6) lo, round(max(y),6) hi, round(avg(y),6) mean FROM ({sql_zero_phase(sql_channels('f8', '100.0::DOUBLE'), {100.0: 6.0})}) WHERE c='x' GROUP BY ALL")
def _(spark, sf):
    d = smooth.butterworth(X.markers_big(spark, sf).select(*K2, "frame", "x"), K2, "frame", ["x"], 100.0, 6.0)
    return d.groupBy(*K2).agg(F.count("x").alias("n"), r6(F.min("x"), "lo"), r6(F.max("x"), "hi"), r6(F.avg("x"), "mean"))


# gaps in every ninth frame are filled before the filter
X.VIEWS["f8g"] = (["f8"], "SELECT trial, marker, frame, x, CASE WHEN frame % 9 <> 4 OR m < 5 THEN x END AS gap FROM (SELECT *, max(frame) OVER (PARTITION BY trial, marker) m FROM f8)")
X.VIEWS["f8f"] = (["f8g"], "SELECT trial, marker, frame, coalesce(gap, CASE WHEN n IS NULL THEN p ELSE (p+n)/2 END) AS x FROM (SELECT *, lag(x) OVER w p, lead(x) OVER w n FROM f8g WINDOW w AS (PARTITION BY trial, marker ORDER BY frame))")


@query("win_11_downsample", ["f8f"],
       "SELECT trial, marker, i, round(t,6) t, round(y,6) x FROM (" + sql_downsampled("SELECT trial, marker, 'x' c, frame i, x v, 100.0::DOUBLE fs FROM f8f", {100.0: 6.0}, 25.0) + ")")
def _(spark, sf):
    d = series.per_key(X.markers_big(spark, sf), K2, F.max("frame").alias("m"), written=True)
    d = d.select(*K2, "frame", F.when((F.col("frame") % 9 != 4) | (F.col("m") < 5), F.col("x")).alias("x"))
    return smooth.downsample(d, K2, "frame", ["x"], 100.0, 25.0, 6.0).select(*K2, "i", r6("t"), r6("x"))


@query("win_11_downsample_values", ["f8"], sql_wide(sql_downsampled(sql_channels("f8", "100.0::DOUBLE"), {100.0: 6.0}, 25.0)))
def _(spark, sf):
    d = smooth.downsample(X.markers_big(spark, sf), K2, "frame", ["x", "y", "z"], 100.0, 25.0, 6.0)
    return d.select(*K2, "i", r6("x"), r6("y"), r6("z"))


@query("win_11_rate_per_trial", ["f8"], sql_wide(sql_downsampled(sql_channels("f8", SQL_RATE), {r: 6.0 for r in RATES}, 100.0), ", round(t,6) t", 4))
def _(spark, sf):
    d = smooth.downsample(rated(X.markers_big(spark, sf)), K2, "frame", ["x", "y", "z"], "fs", 100.0, 6.0)
    return d.select(*K2, "i", r6("t"), *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


@query("win_12_ema", ["f3"],
       "WITH l AS (SELECT trial, k AS marker, list(rx ORDER BY frame) xs, list(frame ORDER BY frame) fs FROM f3 WHERE rx IS NOT NULL AND frame % 4 <> 1 GROUP BY ALL) "
       "SELECT trial, marker, f AS frame, round(y,6) x FROM (SELECT trial, marker, unnest(fs) f, unnest(list_transform(range(1, len(xs)+1), "
       "lambda n: list_reduce(xs[1:n], lambda a, b: (1-0.2::DOUBLE)*a + 0.2::DOUBLE*b))) y FROM l) "
       "UNION ALL SELECT trial, k, frame, NULL FROM f3 WHERE rx IS NULL OR frame % 4 = 1")
def _(spark, sf):
    d = X.reference_near(spark, sf).select("trial", F.col("k").alias("marker"), "frame",
                                           F.when(F.col("frame") % 4 != 1, F.col("rx")).alias("x"))
    return smooth.exponential_over_solved(d, K2, "frame", ["x"], 0.2).select(*K2, "frame", r6("x"))


@query("win_13_time_offset", ["f6v"],
       f"""WITH a AS (SELECT trial, t, x FROM f6v), b AS (SELECT trial, t + 10800 + 600*sin(t/90000) AS t, x FROM f6v),
 o AS (SELECT trial, t0, t1 FROM (SELECT trial, greatest(a0, b0) t0, least(a1, b1) t1 FROM (SELECT trial, min(t) a0, max(t) a1 FROM a GROUP BY 1) JOIN
  (SELECT trial, min(t) b0, max(t) b1 FROM b GROUP BY 1) USING (trial)) WHERE t1 - t0 >= 360000),
 g AS (SELECT trial, i, t0 + i/(1/1800.0::DOUBLE) AS t FROM o, LATERAL (SELECT unnest(range(ceil((t1-t0)*(1/1800.0::DOUBLE))::BIGINT)) AS i)),
 ga AS (SELECT g.trial, g.i, {sql_lerp('clamp')} AS v FROM {asof('g', 'a', ['trial'])}),
 gb AS (SELECT g.trial, g.i, {sql_lerp('clamp')} AS v FROM {asof('g', 'b', ['trial'])}),
 za AS (SELECT trial, i, (v - avg(v) OVER w)/(stddev_pop(v) OVER w + 1e-8) z FROM ga WINDOW w AS (PARTITION BY trial)),
 zb AS (SELECT trial, i, (v - avg(v) OVER w)/(stddev_pop(v) OVER w + 1e-8) z FROM gb WINDOW w AS (PARTITION BY trial)),
 c AS (SELECT zb.trial, lag, sum(za.z*zb.z) c FROM zb, range(-12, 13) l(lag), za WHERE za.trial=zb.trial AND za.i=zb.i+lag GROUP BY ALL),
 best AS (SELECT trial, lag FROM (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY round(c,9) DESC, lag) r FROM c) WHERE r=1)
 SELECT trial, coalesce(round(-lag/(1/1800.0::DOUBLE),6),0.0::DOUBLE) AS "offset" FROM (SELECT DISTINCT trial FROM a) LEFT JOIN best USING (trial)""")
def _(spark, sf):
    d = X.irregular(spark, sf).where("x is not null").select("trial", "t", F.col("x").alias("signal"))
    late = d.withColumn("t", F.col("t") + 10800 + 600 * F.sin(F.col("t") / 90000))
    return timealign.time_offset(d, late, max_offset=6 * HOUR, fs=1 / 1800.0, min_overlap=360000.0, block_s=X.DAY, width=64).select(
        "trial", r6("offset"))


@query("win_14_leg_signal", ["f1"],
       "WITH j AS (SELECT trial, frame, " + ", ".join(
           f"max({c}) FILTER (joint='{s}_{p}') AS {s}_{p}_{c}" for s in ("left", "right") for p in ("hip", "ankle") for c in "xyz")
       + " FROM f1 GROUP BY trial, frame) SELECT trial, frame, round(" + " + ".join(
           "sqrt(" + "+".join(f"pow({s}_hip_{c}-{s}_ankle_{c},2)" for c in "xyz") + ")" for s in ("left", "right")) + ",6) signal FROM j")
def _(spark, sf):
    return timealign.leg_signal(X.pose_long(spark, sf)).select("trial", "frame", r6("signal"))


@query("win_15_shift_time", ["f6"], "SELECT event_id, round(t + 0.25::DOUBLE,6) t FROM f6")
def _(spark, sf):
    return timealign.shift_time(X.irregular(spark, sf), 0.25).select("event_id", r6("t"))


@query("jon_9_bracket", ["f6", "f6v"],
       f"WITH g AS (SELECT trial, marker, t + 7.0 AS t, event_id FROM f6) SELECT g.event_id, round(p.t,6) pt, round(p.x,6) px, round(n.t,6) nt, round(n.x,6) nx FROM {asof('g', 'f6v')}")
def _(spark, sf):
    d = X.irregular(spark, sf)
    g = d.select(*K2, (F.col("t") + 7.0).alias("t"), "event_id")
    b = resample.bracket(d, g, K2, ["x"], block_s=X.DAY)
    return b.select("event_id", r6(F.col("prev_x.t"), "pt"), r6(F.col("prev_x.v"), "px"), r6(F.col("next_x.t"), "nt"), r6(F.col("next_x.v"), "nx"))


_NEAR = ("WITH g AS (SELECT trial, marker, t + 900.0 AS t, event_id FROM f6), b AS (SELECT g.event_id, g.t, p.t pt, p.event_id pe, n.t nt, n.event_id ne FROM "
         + asof("g", "f6") + ") SELECT event_id, ")
_HIT = "CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t-pt <= nt-t) THEN pe ELSE ne END"
_GAP = "CASE WHEN pt IS NOT NULL AND (nt IS NULL OR t-pt <= nt-t) THEN t-pt ELSE nt-t END"


def nearest_requests(spark, sf):
    d = X.irregular(spark, sf)
    return d.withColumn("eid", F.col("event_id")), d.select(*K2, (F.col("t") + 900.0).alias("t"), "event_id")


@query("jon_10_nearest_within", ["f6"], _NEAR + f"CASE WHEN {_GAP} <= 3600 THEN {_HIT} END AS hit FROM b")
def _(spark, sf):
    s, g = nearest_requests(spark, sf)
    return resample.nearest(s, g, K2, ["eid"], tolerance=HOUR, block_s=X.DAY).select("event_id", F.col("hit.eid").alias("hit"))


@query("jon_11_nearest", ["f6"], _NEAR + f"{_HIT} AS hit FROM b")
def _(spark, sf):
    s, g = nearest_requests(spark, sf)
    return resample.nearest(s, g, K2, ["eid"], block_s=X.DAY).select("event_id", F.col("hit.eid").alias("hit"))


@query("agg_25_sampling_rate", ["f6"],
       "SELECT trial, round(1e4*1.0::DOUBLE/median(dt),6) rate_median, round(1.0::DOUBLE/avg(dt),4) rate_mean FROM (SELECT trial, t-lag(t) OVER (PARTITION BY trial ORDER BY t) dt FROM f6) GROUP BY trial")
def _(spark, sf):
    d = X.irregular(spark, sf).select("trial", "t")
    return resample.sampling_rate(d, ["trial"], block_s=X.DAY).select("trial", r6(1e4 * F.col("rate_median"), "rate_median"), "rate_mean")


@query("agg_29_overlap_range", ["f6"], _PR + "SELECT trial, round(t0,6) t0, round(t1,6) t1 FROM o")
def _(spark, sf):
    a, b = two_series(spark, sf)
    return resample.overlap_range(a, b, ["trial"]).select("trial", r6("t0"), r6("t1"))


@query("agg_5_exact_percentiles", ["f8"],
       "SELECT marker, count(y) n, round(quantile_cont(y,0.95),6) p95, round(median(y),6) med, round(quantile_cont(y,0.0),6) lo, round(quantile_cont(y,1.0),6) hi FROM f8 GROUP BY marker")
def _(spark, sf):
    d = X.markers_big(spark, sf)
    q = stats.exact_percentiles(d, ["marker"], "y", {"p95": 0.95, "med": 0.5, "lo": 0.0, "hi": 1.0})
    return q.select("marker", "n", *[r6(c) for c in ("p95", "med", "lo", "hi")])
