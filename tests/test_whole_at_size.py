"""Results and work that showed only on larger tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinespark import session
from kinespark.functions import text
from kinespark.operators import quality, resample, series, smooth
from kinespark.plans import catalog, jobs, q_jobs, q_series
from kinespark.sources import trc


def test_fixed_point_text_rounds_the_exact_value(spark):
    some = np.random.default_rng(1).uniform(-50, 50, 2000)
    v = [125 * j / 64 for j in range(-80, 80)] + [0.0, -0.0, -1e-7, 0.999995, 1.000005, 2.5, 4.5e15, 1e18, *np.round(some, 6).tolist(), *some.tolist()]
    d = spark.createDataFrame([(float(x),) for x in v], "x double")
    for digits in (0, 2, 5, 8):
        assert [t for (t,) in d.select(text.fixed(F.col("x"), digits)).collect()] == [f"{x:.{digits}f}" for x in v]


def test_moving_average_shuffles_rows_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(smooth, "materialise", lambda df, label: written.append(label) or df)
    rng = np.random.default_rng(3)
    series = {1: np.where(rng.random(97) < 0.7, np.nan, rng.normal(size=97)), 2: np.array([4.0]), 3: np.array([1.0, np.nan, 5.0]), 4: np.full(20, np.nan)}
    rows = [(k, i, None if np.isnan(x) else float(x)) for k, v in series.items() for i, x in enumerate(v)]
    d = spark.createDataFrame(rows, "k int, i long, x double")
    for width, length in ((8, 7), (8, 17), (4, 40), (16, 1), (64, 4)):
        got = {(r["k"], r["i"]): r["x"] for r in smooth.moving_average(d, ["k"], "i", ["x"], length, width).collect()}
        half = (length + 1 - length % 2) // 2 if length >= 3 else 0
        assert len(got) == len(rows)
        for k, v in series.items():
            n, known = len(v), np.flatnonzero(~np.isnan(v))
            full = np.interp(np.arange(n), known, v[known]) if len(known) else v
            at = lambda p: 0 if n == 1 else min(p % (2 * (n - 1)), -p % (2 * (n - 1)))
            for i in range(n):
                want = None if np.isnan(v[i]) else np.mean([full[at(p)] for p in range(i - half, i + half + 1)])
                assert (got[k, i] is None) == (want is None) and (want is None or abs(got[k, i] - want) < 1e-9)
    assert not written


def test_grid_values_come_from_the_samples(spark):
    s = spark.createDataFrame(
        [(1, 0.0, 1.0, None), (1, 0.5, None, 2.0), (1, 7.25, 3.0, None), (1, 7.5, 4.0, 6.0), (2, 3.0, 5.0, 1.0), (3, 1.0, None, None), (3, 9.0, None, 2.0)],
        "k int, t double, x double, y double")
    spans = spark.createDataFrame([(1, -1.0, 9.0, "a"), (2, 3.0, 3.0, "b"), (3, 0.0, 12.0, "c")], "k int, t0 double, t1 double, note string")
    for rule, rate in (("floored", 4.0), ("half_open", 3.0), ("rounded", 0.7)):
        for outside, least in (("null", 2), ("clamp", 1)):
            got = resample.on_grid(s, spans, ["k"], ["x", "y"], rate, rule, outside=outside, min_samples=least, block_s=0.6, width=5)
            grid = resample.time_grid(spans, rate, rule).select("k", "note", "i", "t")
            want = resample.interpolate(s, grid, ["k"], ["x", "y"], outside=outside, min_samples=least, block_s=0.6)
            assert got.columns == want.columns and got.count() == want.count() and got.exceptAll(want).count() == 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_an_index_need_no_window(spark, sf):
    d = q_jobs.labelled(spark, sf)
    assert "Window" in plan(d)
    assert "Window" not in plan(d.select("trial", "pos", "marker").distinct())
    odd = spark.createDataFrame([(1, 5), (1, 3), (None, 4), (2, 9), (2, None)], "k int, o int")
    got = series.add_running_index(odd, ["k"], ["o"], series.block_of("o", 4), "i").collect()
    assert sorted((r.k, r.o, r.i) for r in got) == [(1, 3, 0), (1, 5, 1), (2, 9, 0)]


def test_missing_labels_reads_no_marker_rows(spark):
    labels = spark.createDataFrame([(1, 1, "a"), (1, 2, " B "), (2, 1, "c"), (2, 2, "C"), (3, 1, "x")], "trial int, pos int, marker string")
    got = jobs.missing_labels(labels, ["A", "B", "C"])
    assert sorted(map(tuple, got.collect())) == [(1, "C"), (2, "A"), (2, "B"), (3, "A"), (3, "B"), (3, "C")]


def test_downsampling_joins_no_bounds_to_its_rows(spark, monkeypatch):
    rows = [(k, i, float(np.sin(i / 3 + k)) if i % 7 else None) for k, n in ((1, 90), (2, 5), (3, 1), (4, 200)) for i in range(n)]
    d = spark.createDataFrame(rows, "k int, i long, x double")
    want = smooth.butterworth(resample.fill_gaps(d, ["k"], "i", ["x"]), ["k"], "i", ["x"], 60.0, 6.0)
    want = {(r.k, r.i): r.x for r in want.collect()}

    def none(*args, **kw):
        raise AssertionError("rows are joined by key")

    monkeypatch.setattr(series, "per_key", none)
    for width in (16384, 64):
        got = {(r.k, r.i): r.x for r in smooth.downsample(d, ["k"], "i", ["x"], 60.0, 60.0, 6.0, width=width).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9) for k in want)


def test_still_windows_make_no_empty_rows(spark, monkeypatch):
    made, kept = [], {}
    monkeypatch.setattr(quality.blocks, "map_blocks", lambda d, keys, order, run, schema: kept.update(d=d, run=run) or d)
    rng = np.random.default_rng(5)
    rows = [(t, m, f, *map(float, rng.normal(size=3))) for t in range(6) for m in range(1 + t % 3) for f in range(3 * t, 40) if rng.random() < 0.98]
    d = spark.createDataFrame([r if rng.random() < 0.98 else (*r[:3], None, *r[4:]) for r in rows], "trial int, marker int, frame long, x double, y double, z double")
    at = {(t, m, f): p for t, m, f, *p in map(tuple, d.collect())}
    whole = quality.window_ranges
    monkeypatch.setattr(quality, "window_ranges", lambda table, lengths: made.append(len(table)) or whole(table, lengths))
    want = set()
    for t in range(6):
        ms = {m for k, m, _ in at if k == t}
        for n in (3, 5, 8):
            for s in range(40):
                cells = [[at.get((t, m, f)) for f in range(s, s + n)] for m in ms]
                if all(c is not None and None not in c for row in cells for c in row):
                    want.add((t, s, n, round(float(max(np.ptp(np.array(row), axis=0).max() for row in cells)), 9)))
    for width, cells in ((4096, 1 << 20), (8, 1 << 20), (8, 60)):
        monkeypatch.setattr(quality, "CELLS", cells)
        made.clear()
        quality.motion_ranges(d, [3, 5, 8], width=width)
        pdf = kept["d"].toPandas().sort_values(["trial", "_blk", "frame"]).reset_index(drop=True)
        starts = np.flatnonzero((pdf[["trial", "_blk"]] != pdf[["trial", "_blk"]].shift()).any(axis=1))
        got = kept["run"](pdf, starts)
        assert {(r.trial, r.start, r.n, round(r.needed, 9)) for r in got.itertuples()} == want and len(got) == len(want)
        assert sum(made) <= len(pdf)


def test_still_coordinates_are_not_shuffled_by_trial(spark):
    d = spark.createDataFrame([(t, str(m), f, 1.0 * f, 20.0 * t, 0.0) for t in range(3) for m in range(2) for f in range(4)],
                              "trial int, marker string, frame long, x double, y double, z double")
    out = quality.prepare_still(d, None)
    assert "Exchange hashpartitioning" not in plan(out)
    assert {(r.trial, r.y) for r in out.collect()} == {(0, 0.0), (1, 0.02), (2, 0.04)}


def test_trc_lines_are_read_once(spark, sf):
    path = session.scratch_path(spark, "trc")
    d = spark.createDataFrame([(t, f, m, 1.0, 2.0, 3.0) for t in (1, 2) for f in range(3) for m in "ab"], "trial int, frame long, marker string, x double, y double, z double")
    trc.write_trc(d, path, 60.0)
    header, rows, errors = trc.read_trc(spark, path)
    assert "FileScan text" not in plan(rows) + plan(header) + plan(errors)
    assert rows.count() == 12 and header.count() == 2 and errors.count() == 0


def test_queries_shuffle_into_small_parts(spark, sf):
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.unset(name)
    catalog.QUERIES["win_16_still_ranges"](spark, sf)
    assert int(spark.conf.get(name)) == session.PARTS
    spark.conf.set(name, "7")
    catalog.QUERIES["win_16_still_ranges"](spark, sf)
    assert spark.conf.get(name) == "7"
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def test_written_rows_are_not_broadcast(spark):
    d = session.materialise(spark.range(2000).selectExpr("id % 3 as k", "id as i", "if(id % 5 = 0, null, 1.0D) as x"), "rows")
    joins = [line for line in plan(resample.fill_gaps(d, ["k"], "i", ["x"])).splitlines() if "Join" in line]
    assert "SortMergeJoin" in joins[0]


def test_placed_grid_rows_are_averaged_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(series, "FRAMES_PER_BLOCK", 8)
    rng = np.random.default_rng(5)
    rows = [(k, str(k % 2), float(t), None if rng.random() < 0.3 else float(rng.normal()))
            for k, n in ((1, 90), (2, 40), (3, 5), (4, 2), (5, 1)) for t in np.sort(rng.uniform(0, 70, n))]
    rows += [(6, "a", 0.0, 1.0), (6, "a", 200.0, 3.0), (7, "b", 4.0, None), (7, "b", 60.0, None), (8, "c", 3.0, 2.0), (8, "c", 3.5, 4.0), (None, "c", 1.0, 2.0), (9, "d", None, 2.0)]
    s = spark.createDataFrame(rows, "k int, m string, t double, x double").withColumn("y", F.col("x") * 3 + F.when(F.col("t") < 40, F.col("t")))
    spans = resample.ranges(s, ["k", "m"]).withColumn("note", F.col("t1"))
    gaps = lambda d: d.withColumns({c: F.when(~((F.col("i") % 11 == 5) | (F.col("i") % 37).between(9, 30)), F.col(c)) for c in "xy"})
    for per_task, width, length in ((1 << 22, 8, 7), (150, 4, 17), (300, 3, 40), (300, 16, 2), (80, 64, 5)):
        monkeypatch.setattr(resample, "ROWS_PER_TASK", per_task)
        half = (length + 1 - length % 2) // 2 if length >= 3 else 0
        grid = lambda **place: gaps(resample.on_grid(s, spans, ["k", "m"], ["x", "y"], 1.5, "floored", block_s=6.0, width=width, **place))
        want = smooth.moving_average(grid(), ["k", "m"], "i", ["x", "y"], length, width)
        got = smooth.moving_average(grid(halo=half), ["k", "m"], "i", ["x", "y"], length, width, placed=True)
        assert got.schema == want.schema and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    with pytest.raises(Exception, match="aren't whole"):
        smooth.moving_average(grid(halo=1), ["k", "m"], "i", ["x", "y"], 5, width, placed=True).collect()


def test_hourly_average_shuffles_no_grid_rows(spark, tmp_path):
    spark.range(200).selectExpr(
        "id as event_id", "timestamp_seconds(id % 10 * 90000 + id % 7) as ts", "id div 20 as user_id", "if(id % 20 < 10, 'click', 'view') as event_type",
        "if(id % 9 = 4, null, id * 0.37D) as value", "'' as props").write.parquet(str(tmp_path / "events.parquet"))
    out = catalog.QUERIES["win_6_moving_average"](spark, str(tmp_path))
    lines = plan(out).splitlines()
    made = next(k for k, line in enumerate(lines) if "Generate" in line)
    assert not any("Exchange" in line or "Sort " in line for line in lines[:made])
    want = smooth.moving_average(q_series.gappy(spark, str(tmp_path)), ["trial", "marker"], "i", ["x"], 7, width=64).withColumn("x", F.round("x", 6) + 0.0)
    assert out.count() == want.count() > 4000 and out.exceptAll(want).count() == 0
