"""Blocked operators against plain windows and brute force."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.functions import kernels
from kinespark.plans import jobs
from kinespark.operators import quality, recursive, resample, series, smooth, stats


def wave(spark, n=500, keys=2):
    return spark.range(n * keys).select(
        (F.col("id") % keys).alias("k"), F.floor(F.col("id") / keys).alias("i"),
    ).withColumn("x", F.when((F.col("i") * 7 + F.col("k")) % 5 != 0, F.sin(F.col("i") / 9.0) + F.col("k")))


def test_carry_equals_plain_window(spark):
    d = wave(spark)
    got = series.carry(d, ["k"], [F.col("i")], series.block_of("i", 16), F.col("x"), "p")
    w = W.partitionBy("k").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    want = d.withColumn("p", F.last("x", ignorenulls=True).over(w))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_running_index_and_rolling(spark):
    d = wave(spark)
    idx = series.add_running_index(d, ["k"], ["i"], series.block_of("i", 16), "n")
    assert idx.where("n <> i").count() == 0
    got = series.rolling(d, ["k"], "i", 3, 2, {"m": F.max("x")}, width=16)
    want = d.withColumn("m", F.max("x").over(W.partitionBy("k").orderBy("i").rowsBetween(-3, 2)))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_exact_percentiles_on_skewed_groups(spark):
    d = spark.range(60000).select((F.col("id") % 10 == 0).cast("int").alias("k"), (F.pow(F.col("id") % 9973, F.lit(2)) % 5003).alias("v"))
    got = {r["k"]: r for r in stats.exact_percentiles(d, ["k"], "v", {"p95": 0.95, "p0": 0.0, "med": 0.5}).collect()}
    want = {r["k"]: r for r in d.groupBy("k").agg(F.expr("percentile(v, 0.95)").alias("p95"), F.min("v").alias("p0"), F.expr("percentile(v, 0.5)").alias("med")).collect()}
    for k in want:
        for c in ("p95", "p0", "med"):
            assert abs(got[k][c] - want[k][c]) < 1e-9


def test_line_is_resampled_to_line(spark):
    s = spark.range(100).select(F.lit(1).alias("k"), (F.col("id") * 0.1).alias("t"), (F.col("id") * 0.2 + 1).alias("x"))
    g = resample.time_grid(resample.ranges(s, ["k"]), 37.0, "floored").select("k", "i", "t")
    out = resample.interpolate(s, g, ["k"], ["x"], block_s=0.7)
    assert out.where(F.abs(F.col("x") - (2 * F.col("t") + 1)) > 1e-9).count() == 0 and out.where("x is null").count() == 0


def direct_form(b, a, x, zi):
    """Difference equation, one sample at a time."""
    z, y = zi.copy(), np.empty_like(x)
    for n, v in enumerate(x):
        y[n] = b[0] * v + z[0]
        for i in range(len(z) - 1):
            z[i] = b[i + 1] * v + z[i + 1] - a[i + 1] * y[n]
        z[-1] = b[-1] * v - a[-1] * y[n]
    return y


def brute_filtfilt(x, order, wn):
    poles, gain = kernels.butterworth_poles(order, wn)
    a = np.real(np.poly(poles))
    b = gain * np.poly(-np.ones(order))
    n = order
    m = np.eye(n) - np.vstack([np.concatenate([[-a[i + 1]], np.zeros(n - 1)]) for i in range(n)])
    for i in range(n - 1):
        m[i, i + 1] -= 1.0
    zi = np.linalg.solve(m, b[1:] - a[1:] * b[0])
    pad = 3 * (order + 1)
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]])
    y = direct_form(b, a, e, zi * e[0])
    y = direct_form(b, a, y[::-1], zi * y[-1])[::-1]
    return y[pad:-pad]


def test_butterworth_matches_difference_equation(spark):
    d = wave(spark, 900, 2).withColumn("x", F.sin(F.col("i") / 9.0) + F.cos(F.col("i") * 1.7) + F.col("k"))
    out = smooth.butterworth(d, ["k"], "i", ["x"], 60.0, 6.0, width=64).orderBy("k", "i").toPandas()
    src = d.orderBy("k", "i").toPandas()
    for k in (0, 1):
        x = src[src.k == k].x.to_numpy()
        want = brute_filtfilt(x, 4, 0.2)
        assert np.abs(out[out.k == k].x.to_numpy() - want).max() < 1e-9


def test_exponential_matches_loop(spark):
    d = wave(spark, 700, 1).withColumn("x", F.cos(F.col("i") * 0.3))
    got = smooth.exponential(d, ["k"], "i", ["x"], 0.05, width=64).orderBy("i").toPandas().x.to_numpy()
    x = d.orderBy("i").toPandas().x.to_numpy()
    y = [x[0]]
    for v in x[1:]:
        y.append(0.95 * y[-1] + 0.05 * v)
    assert np.abs(got - np.array(y)).max() < 1e-12


def test_moving_average_keeps_constants_and_short_series(spark):
    d = spark.sql("select 1 k, cast(id as bigint) i, 2.5D x from range(4) union all select 2, 0, 7D")
    out = smooth.moving_average(d, ["k"], "i", ["x"], 7)
    assert out.where("k = 1 and abs(x - 2.5) > 1e-12").count() == 0
    assert [r.x for r in out.where("k = 2").collect()] == [7.0]


def sample_by_sample(x, spec):
    """The filter's recursions one sample at a time in wide numbers, forward and backward."""
    poles, weights = spec.poles.astype(np.clongdouble), spec.weights.astype(np.clongdouble)

    def one_way(x):
        w, y = x[0] / (1 - poles), np.empty_like(x)
        for n, v in enumerate(x):
            w = poles * w + v
            y[n] = spec.direct * v + np.real(weights * w).sum()
        return y

    pad = 15
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2:-pad - 2:-1]]).astype(np.longdouble)
    return one_way(one_way(e)[::-1])[::-1][pad:-pad]


def test_low_cutoff_runs_over_many_blocks(spark, monkeypatch):
    """The response at 0.05 Hz and 1 kHz is far longer than a block; states are carried through groups of blocks."""
    monkeypatch.setattr(recursive, "GROUP", 4)
    d = wave(spark, 3000, 2).withColumn("x", F.sin(F.col("i") / 90.0) + F.cos(F.col("i") * 1.7) + F.col("k"))
    out = smooth.butterworth(d, ["k"], "i", ["x"], 1000.0, 0.05, width=128).orderBy("k", "i").toPandas()
    src = d.orderBy("k", "i").toPandas()
    for k in (0, 1):
        want = sample_by_sample(src[src.k == k].x.to_numpy(), kernels.lowpass(1000.0, 0.05))
        assert np.abs(out[out.k == k].x.to_numpy() - want).max() < 1e-9


def test_each_key_has_its_own_rate(spark):
    rates = {0: 60.0, 1: 100.0, 2: 250.0}
    d = wave(spark, 400, 3).withColumn("x", F.sin(F.col("i") / 9.0) + F.cos(F.col("i") * 1.7))
    rated = d.withColumn("fs", F.element_at(F.array(*[F.lit(r) for r in rates.values()]), (F.col("k") + 1).cast("int")))
    for run in (smooth.butterworth, smooth.first_order_lowpass):
        got = run(rated, ["k"], "i", ["x"], "fs", 6.0, width=64).select("k", "i", "x").toPandas().set_index(["k", "i"]).x
        for k, fs in rates.items():
            want = run(d.where(F.col("k") == k), ["k"], "i", ["x"], fs, 6.0).toPandas().set_index(["k", "i"]).x
            assert np.abs(got[k] - want[k]).max() < 1e-10
    # unfiltered where the cutoff is missing
    same = smooth.butterworth(rated.withColumn("fc", F.when(F.col("k") > 0, 6.0)), ["k"], "i", ["x"], "fs", "fc").where("k = 0").select("i", "x")
    assert same.exceptAll(d.where("k = 0").select("i", "x")).count() == 0


def test_still_windows_equal_brute_force(spark):
    g = np.random.default_rng(4)
    rows, want = [], set()
    for trial, (n, lengths) in enumerate([(700, [33, 16, 5]), (90, [7]), (40, [64])]):
        data = np.cumsum(g.normal(size=(n, 3, 3)), axis=0)
        data[min(50, n - 1), 1, 2] = np.nan
        rows += [(trial, int(f), f"m{m}", *[None if np.isnan(v) else float(v) for v in data[f, m]], lengths) for f in range(n) for m in range(3) if (trial, f, m) != (0, 300, 2)]
        if trial == 0:
            data[300, 2] = np.nan
        for k in lengths:
            for s in range(n - k + 1):
                r = (data[s:s + k].max(axis=0) - data[s:s + k].min(axis=0)).max()
                if not np.isnan(r):
                    want.add((trial, s, k, round(float(r), 9)))
    d = spark.createDataFrame(rows, "trial int, frame long, marker string, x double, y double, z double, n array<int>")
    got = {(r.trial, r.start, r.n, round(r.needed, 9)) for r in quality.motion_ranges(d, F.col("n"), width=64).collect()}
    assert got == want


def test_percentiles_narrow_in_rounds(spark, monkeypatch):
    """A key of a million values with heavy ties and a small one, over several rounds, equal to sorted lists."""
    monkeypatch.setattr(stats, "LIMIT", 200)
    d = spark.range(1_000_300).select(
        F.when(F.col("id") < 1_000_000, 0).otherwise(F.lit(None).cast("int")).alias("k"),
        F.when(F.col("id") % 3 == 0, 7.5).otherwise((F.col("id") * F.col("id")) % 999_983 / 1000.0 - 20).alias("v"))
    wanted = {"p0": 0.0, "p5": 0.05, "third": 1 / 3, "med": 0.5, "p95": 0.95, "p1": 1.0}
    got = {r["k"]: r for r in stats.exact_percentiles(d, ["k"], "v", wanted).collect()}
    for k, rows in d.toPandas().groupby("k", dropna=False):
        x = rows["v"].to_numpy()
        r = got[None if k != k else k]
        assert r["n"] == len(x) and all(abs(r[c] - np.quantile(x, p)) < 1e-9 for c, p in wanted.items())
    assert stats.exact_percentiles(d.where("false"), ["k"], "v", wanted).collect() == []


def test_whole_frames_equal_joint_by_joint(spark):
    """Gaps of single joints, missing values and frames: the same as every joint's own series."""
    r = np.random.default_rng(8)
    rows = {s: [(t, f * step, j, *[None if r.random() < 0.05 else float(v) for v in r.normal(size=3)])
                for t in range(2) for f in range(60) for j in ("a", "b", "c") if r.random() > 0.1 and (t, j) != (1, "c")]
            for s, step in (("pred", 0.1), ("ref", 0.07))}
    pred, ref = (spark.createDataFrame(rows[s], "trial int, t double, joint string, x double, y double, z double") for s in ("pred", "ref"))
    for mode in ("grid", "pred"):
        got = jobs._align_in_time(pred, ref, mode, 37.0, 1.3)
        times = resample.evaluation_times(pred, ref, mode, 37.0)
        grid = times.join(pred.select("trial", "joint").distinct(), "trial").select("trial", "joint", "i", "t")
        p, q = (resample.interpolate(d, grid, ["trial", "joint"], ["x", "y", "z"]) for d in (pred, ref))
        want = p.join(q.select("trial", "joint", "i", *[F.col(c).alias(f"r{c}") for c in "xyz"]), ["trial", "joint", "i"]).select(got.columns)
        rnd = lambda d: sorted((x[0], x[1], x[3], *[None if v is None else round(v, 9) for v in x[4:]]) for x in map(tuple, d.collect()))
        assert sorted(map(str, rnd(got))) == sorted(map(str, rnd(want)))


def test_sparse_key_has_no_long_scan(spark, monkeypatch):
    """Every row a block of its own, blocks in groups of three."""
    monkeypatch.setattr(series, "BLOCKS_PER_GROUP", 3)
    d = spark.range(200).select((F.col("id") % 2).alias("k"), (F.col("id") * 1e5).alias("t"), F.when(F.col("id") % 7 < 2, F.col("id")).alias("v"))
    got = series.carry_many(d, ["k"], [F.col("t")], series.block_of("t", 600.0), {"p": (F.col("v"), True), "n": (F.col("v"), False)}, totals={"c": F.col("v")})
    w = W.partitionBy("k").orderBy("t")
    want = d.select("*", F.last("v", True).over(w).alias("p"), F.first("v", True).over(w.rowsBetween(0, W.unboundedFollowing)).alias("n"), F.count("v").over(W.partitionBy("k")).alias("c"))
    assert got.exceptAll(want).count() == 0 and got.count() == 200
