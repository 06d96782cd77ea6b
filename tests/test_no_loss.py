"""Trials without calibration stay in the results of the jobs, with a status."""

import os

import pytest
from pyspark.sql import functions as F

from kinespark import session
from kinespark.operators import frames, names, select
from kinespark.plans import jobs
from kinespark.sources import trc
from kinespark.streaming import live

EYE = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def calibration(spark):
    row = ("a", [500.0, 0.0, 320.0, 0.0, 500.0, 240.0, 0.0, 0.0, 1.0], [0.0] * 5, EYE, [0.0, 0.0, 0.0], 640, 480)
    return spark.createDataFrame([row], "trial string, K array<double>, dist array<double>, R array<double>, t array<double>, width int, height int")


def test_placement_keeps_trials_without_calibration(spark):
    pts = [(t, f, 0, k, x, y, z, 320 + 500 * (x + 1) / (z + 4), 240 + 500 * (y + 1) / (z + 4), 1.0)
           for t in "ab" for f in range(3) for k, (x, y, z) in enumerate([(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 2)])]
    d = spark.createDataFrame([(t, f, p, k, *map(float, r)) for t, f, p, k, *r in pts],
                              "trial string, frame long, person int, k int, x double, y double, z double, u double, v double, score double")
    for undistort in ("off", "auto"):
        out = jobs.absolute_placement(d, calibration(spark), undistort=undistort).groupBy("trial", "status").agg(
            F.count("*").alias("n"), F.count("wx").alias("known"), F.round(F.max("cx"), 4).alias("cx")).collect()
        assert sorted(map(tuple, out)) == [("a", "ok", 18, 18, 2.0), ("b", "no calibration", 18, 0, None)]


def test_audit_reports_every_trial(spark):
    m = spark.createDataFrame([(t, i / 10, "m", 0.0, 0.0, 4.0) for t in "abc" for i in range(5)], "trial string, t double, marker string, x double, y double, z double")
    times = spark.createDataFrame([(t, i, i / 20) for t in "ab" for i in range(4)], "trial string, frame int, t double")
    _, report = jobs.projection_audit(m, times, calibration(spark))
    got = {r.trial: (r.status, r.reason, r.n, r.n_inside) for r in report.collect()}
    assert got == {"a": ("ok", None, 4, 4), "b": ("failed", "no calibration", 4, 0), "c": ("failed", "no calibration", None, None)}


def test_support_counts_padding_and_guess(spark):
    d = spark.createDataFrame([("a", 0, "j", 1.0), ("a", 0, "k", None), ("a", 1, "j", None), ("b", 0, "j", 2.0)], "trial string, frame int, joint string, x double")
    got = {tuple(r) for r in select.support_counts(d, ["trial"], "frame", "joint", F.col("x").isNotNull()).collect()}
    assert got == {("a", 2, 1, 1, 2), ("b", 1, 1, 1, 1)}
    e = spark.createDataFrame([("a", [1, 2, 3]), ("a", [4]), ("b", [])], "trial string, v array<int>")
    got = sorted((r.trial, r.v, r.m) for r in select.pad_to_longest(e, ["trial"], "v", "m").collect())
    assert got == [("a", [1, 2, 3], 3), ("a", [4, None, None], 3), ("b", [], 0)]
    layouts = spark.createDataFrame([("a", 20), ("b", 17), ("c", 16)], "trial string, n_points int")
    named = spark.createDataFrame([("a", 4, "Left-Hip")], "trial string, idx int, name string")
    got = {tuple(r) for r in names.side_index_or_guess(layouts, named, "left", "hip").collect()}
    assert got == {("a", 4, False), ("b", 11, True), ("c", None, False)}


def test_anchor_by_support(spark):
    rows = []
    for f in range(4):
        rows += [("a", f, "left_hip", 1.0 if f else None), ("a", f, "right_hip", 3.0), ("a", f, "l.asis", 0.0), ("a", f, "r.asis", 4.0 if f > 2 else None), ("a", f, "k", 5.0)]
        rows += [("b", f, "l.asis", 1.0), ("b", f, "r.asis", 2.0), ("b", f, "k", 5.0), ("c", f, "k", 5.0), ("c", f, "m", 6.0)]
    d = spark.createDataFrame([(*r, r[3], r[3]) for r in rows], "trial string, i int, joint string, x double, y double, z double")
    out = frames.center_by_support(d, ["trial"], ["trial", "i"], [("left_hip", "right_hip"), ("l.asis", "r.asis")])
    got = {(r.trial, r.i): r.x for r in out.where("joint = 'k'").collect()}
    assert got == {**{("a", f): 3.0 if f else None for f in range(4)}, **{("b", f): 3.5 for f in range(4)}, **{("c", f): -0.5 for f in range(4)}}
    assert out.count() == len(rows)


@pytest.mark.parametrize("files", [1, 8])
def test_windows_close_alike(spark, tmp_path, files):
    """The same windows whatever the number of files a trigger takes; the last one is closed by the end record."""
    d = spark.range(240).select(F.concat(F.lit("t"), F.col("id") % 2).alias("trial_id"), F.col("id").alias("frame_index"), (F.col("id") / 60).alias("time_sec"),
                                F.array(F.struct((F.col("id") % 5).cast("double").alias("mean_score"))).alias("persons"))
    path = str(tmp_path / "in")
    d.unionByName(d.where("id % 10 = 0") if "id" in d.columns else d.where("frame_index % 10 = 0")).repartition(8, "frame_index").write.json(path)
    live.write_end_of_session(spark, path)
    s = live.closed_windows(live.live_frames(spark, path, lateness="1 hour", max_files=files), "1 second")
    live.run_to_table(s, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = sorted((r.trial_id, r.frames, round(r.mean_score, 9), r.start) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    whole = live.quality_windows(live.with_event_time(d, "2024-01-01 00:00:00"), "1 second").collect()
    assert got == sorted((r.trial_id, r.frames, round(r.mean_score, 9), r.start) for r in whole) and len(got) == 8


def test_trc_names_beyond_the_first_split(spark, tmp_path):
    """A long preamble: the name line lies in a later split than the file's first line."""
    head = [f"note {i} " + "x" * 90 for i in range(30)] + ["DataRate\tUnits", "60\tmm", "Frame#\tTime\tA\t\t\tB", "\tX1\tY1\tZ1\tX2\tY2\tZ2", ""]
    body = [f"{i + 1}\t{i / 60}\t{i}\t2\t3\t4\t5\t6" for i in range(40)]
    (tmp_path / "long.trc").write_text("\n".join(head + body + ["end of data", "99\t1\t1\t1\t1\t1\t1\t1"]))
    (tmp_path / "none.trc").write_text("nothing here\n1\t2\t3")
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        header, rows = trc.read_any_trc(spark, str(tmp_path))
        got = {r.trial: (r.status, r.units, r.data_rate, r.markers) for r in header.collect()}
        assert got == {"long": ("ok", "mm", 60.0, ["A", "B"]), "none": ("no names", None, None, None)}
        out = sorted((r.frame, r.marker, round(r.x, 9)) for r in rows.collect())
        assert out == sorted((i + 1, m, i / 1000 if m == "a" else 0.004) for i in range(40) for m in ("a", "b"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_discard_removes_own_tables_only(spark, tmp_path):
    d = session.materialise(spark.range(5), "gone")
    folder = d.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    spark.range(5).write.parquet(str(tmp_path / "kept"))
    session.discard(d, spark.read.parquet(str(tmp_path / "kept")))
    assert not os.path.exists(folder) and os.path.exists(tmp_path / "kept")
