"""Gaps, bad cells and missing partners: nothing is lost without a word."""

import pytest
from pyspark.sql import functions as F

from kinespark import session
from kinespark.operators import align, camera, quality
from kinespark.plans import jobs
from kinespark.sources import trc


def test_gap_is_not_still(spark):
    rows = [("a", "m", i, 1.0 if i in (0, 8, 9, 10) else None, 0.0, 0.0) for i in range(11)]
    d = spark.createDataFrame(rows, "trial string, marker string, frame long, x double, y double, z double")
    got = {(r.start, r.n) for r in quality.motion_ranges(d, [3]).collect()}
    assert got == {(8, 3)}


def test_root_gap_is_missing(spark):
    rows = [("a", m, i, 1.0, 1.0, 1.0) for i in range(2) for m in ("midHip", "k") if (m, i) != ("midHip", 1)] + [("b", "k", 0, 1.0, 1.0, 1.0)]
    d = spark.createDataFrame(rows, "trial string, marker string, frame long, x double, y double, z double")
    got = {(r.trial, r.frame): r.x for r in quality.prepare_still(d).where("marker = 'k'").collect()}
    assert got == {("a", 0): 0.0, ("a", 1): None, ("b", 0): 1.0}


def test_trc_bad_cells_and_late_names(spark, tmp_path):
    head = ["PathFileType", "DataRate", "60\t60\t3", "Frame#\tTime\tA\t\t\tB", "\tX1", ""]
    body = ["1\t0.0\t1\t2\t3\t4\t5\t6", "two\t0.1\t1\t2\t3\t4\t5\t6", "3\t0.2\t1"]
    (tmp_path / "t.trc").write_text("\n".join(head + body))
    header, rows, errors = trc.read_trc(spark, str(tmp_path))
    h = header.first()
    assert h.num_frames == 3 and h.units is None and h.markers == ["A", "B"]
    assert rows.count() == 2 and errors.count() == 2
    late = tmp_path / "late"
    late.mkdir()
    (late / "x.trc").write_text("\n".join(["note"] * 400 + ["Frame#\tTime\tA", "\tX1\tY1\tZ1", "1\t0.0\t1\t2\t3"]))
    (late / "y.trc").write_text("nothing here")
    header, rows = trc.read_any_trc(spark, str(late))
    assert rows.select("trial", "marker", "x").collect() == [("x", "a", 1.0)]
    assert {(r.trial, r.status) for r in header.collect()} == {("x", "ok"), ("y", "no names")}


def test_partners_may_be_missing(spark):
    d = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0)], "trial string, x double, y double")
    fits = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0)], "trial string, s double, theta double, tx double, ty double")
    got = {r.trial: r.pu for r in align.apply_similarity_2d(d, fits, ["trial"]).collect()}
    assert got == {"a": 1.0, "b": None}
    calib = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0], [0.0] * 5)], "trial string, K array<double>, dist array<double>")
    px = d.withColumnsRenamed({"x": "u", "y": "v"})
    assert camera.undistort(px, calib).count() == 2
    tasks = spark.createDataFrame([("m", "k", True)], "model string, marker string, apply boolean")
    pairs = spark.createDataFrame([], "model string, measurement string, a string, b string")
    model = spark.createDataFrame([("m", "k")], "model string, marker string")
    out = jobs.model_readiness(tasks, pairs, model).collect()
    assert [(r.model, r.tasks, r.measurements) for r in out] == [("m", 1, 0)]


def test_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Fake:
        conf = Conf

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        session.shared_dir(Fake)


def test_undistort_decision_sees_all_frames(spark):
    calib = spark.createDataFrame([("a", [100.0, 0.0, 50.0, 0.0, 100.0, 50.0, 0.0, 0.0, 1.0], [0.5, 0.0, 0.0, 0.0, 0.0])], "trial string, K array<double>, dist array<double>")
    # the principal point for 60 frames, the edge for the rest
    d = spark.range(200).select(F.lit("a").alias("trial"), F.col("id").alias("frame"), F.when(F.col("id") < 60, 50.0).otherwise(90.0).alias("u"), F.lit(50.0).alias("v"))
    assert camera.undistort_decision(d, calib).first().undistort
    assert not camera.undistort_decision(d, calib, n_frames=50).first().undistort


def test_smoothing_of_frames_in_any_order(spark):
    from kinespark.streaming import live

    rows = [("a", p, f, float(f * (p + 1)), 0.0, 0.0, None if f % 3 else float(f), 0.0, 1.0, 1.0) for p in range(2) for f in range(64)]
    d = spark.createDataFrame(rows, "trial string, person long, frame long, tx double, ty double, tz double, x1 double, y1 double, x2 double, y2 double")
    d = live.with_event_time(d.withColumn("time_sec", F.col("frame") / 60), "2024-01-01 00:00:00").drop("time_sec")
    path = session.scratch_path(spark, "shuffled")
    for k in range(7, -1, -1):  # the last frames come first
        d.where(F.col("frame") % 16 >= 8 if k == 3 else F.lit(True)).where(F.col("frame") % 8 == k).coalesce(1).write.mode("append").parquet(path)
    d.where((F.col("frame") % 8 == 3) & (F.col("frame") % 16 < 8)).coalesce(1).write.mode("append").parquet(path)
    live.end_of_session(d).coalesce(1).write.mode("append").parquet(path)

    def run(files, lateness):
        s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", files).parquet(path)
        out = session.scratch_path(spark, "smoothed")
        late = live.run_to_table(live.keyed_smoothing(s, 0.5, lateness), out, session.scratch_path(spark, "progress"))
        return late, sorted((r.person, r.frame, r.tx, r.x1) for r in spark.read.parquet(out).collect())

    want = []
    for p in range(2):
        y = b = None
        for f in range(64):
            y = f * (p + 1.0) if y is None else 0.5 * y + 0.5 * f * (p + 1)
            b = b if f % 3 else float(f)
            want.append((p, f, y, b))
    assert run(1, "10 seconds") == run(8, "10 seconds") == (0, want)
    with pytest.warns(UserWarning, match="left out"):
        late, got = run(1, "0 seconds")
    assert late == len(want) - len(got) > 0
