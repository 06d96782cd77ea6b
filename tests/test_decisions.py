"""Decided behaviour of ambiguous cases, and invariants."""

import pytest
from pyspark.sql import functions as F

from kinespark.functions import geometry as G
from kinespark.functions import text
from kinespark.operators import align, quality, select
from kinespark.plans import fixtures as X


def one(spark, sql, *cols):
    return spark.sql(sql).select(*cols).first()


def test_unknown_subset_is_empty(spark):
    t = spark.sql("select 's' subject_id, 'healthy' subset, 'a' id")
    assert select.pick_trials(t, "nope").count() == 0
    assert select.pick_trials(t, "nope", unknown="all").count() == 1
    assert select.pick_trials(t, "all").count() == 1


def test_absent_score_defaults(spark):
    sql = "select array(named_struct('mean_score', cast(null as double)), named_struct('mean_score', 0.1D)) p"
    assert one(spark, sql, select.best_index(F.col("p")))[0] == 1
    assert len(one(spark, sql, select.at_least(F.col("p"), 0.5))[0]) == 1


def test_zero_as_missing_modes(spark):
    d = spark.sql("select 0D x, 1D y, 0D z union all select 0D, 0D, 0D")
    assert select.zero_as_missing(d).where("x is null").count() == 1
    assert select.zero_as_missing(d, mode="cell").where("x is null").count() == 2


def test_axis_expression_is_checked():
    for bad in ("x,y", "x,x,z", "a,y,z"):
        with pytest.raises(ValueError):
            G.parse_axes(bad)


def test_number_parsing(spark):
    r = one(spark, "select '  -1.75 M tall' s", text.number_of(F.col("s")), text.unit_of(F.col("s")))
    assert r[0] == -1.75 and r[1] == "m"


def test_unsigned_and_signed_scale(spark):
    # a mirrored point set: the plain scale keeps the sum of singular values
    d = spark.sql("select 1 k, * from values (1D,0D,0D,-1D,0D,0D),(-1D,0D,0D,1D,0D,0D),(0D,2D,0D,0D,2D,0D),(0D,-2D,0D,0D,-2D,0D),(0D,0D,3D,0D,0D,3D),(0D,0D,-3D,0D,0D,-3D) t(x,y,z,rx,ry,rz)")
    plain = align.fit(d, ["k"], "similarity").first()
    signed = align.fit(d, ["k"], "similarity", signed_scale=True).first()
    assert abs(plain.s - 1.0) < 1e-9 and signed.s < plain.s


def test_too_few_points_give_identity(spark):
    d = spark.sql("select 1 k, 1D x, 2D y, 3D z, 4D rx, 5D ry, 6D rz")
    f = align.fit(d, ["k"], "similarity").first()
    assert f.R == [1, 0, 0, 0, 1, 0, 0, 0, 1] and f.s == 1 and f.tr == [0, 0, 0]


def test_rotations_are_proper(spark, sf):
    f = align.fit(X.reference_near(spark, sf), ["trial"])
    bad = f.where(F.abs(G.det(G.elements(F.col("R"))) - 1) > 1e-9).count()
    assert bad == 0


def test_still_lengths_stop_at_minimum():
    assert quality.window_lengths(100.0, 0.3) == [101, 91, 81, 71, 61, 51, 41, 31]
    assert min(quality.window_lengths(30.0, 0.1)) >= 4


def test_still_relaxation_reports_not_found(spark):
    m = spark.range(40).select(F.lit(1).alias("trial"), F.lit("a").alias("marker"), F.col("id").alias("frame"),
                               (F.col("id") * 1.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    r = quality.motion_ranges(m, [5, 3])
    assert quality.relaxed_still(r, m, 0.1, 0.1, 1.0).first().status == "not found"
    hit = quality.relaxed_still(r, m, 0.1, 0.5, 10.0).first()
    assert (hit.start, hit.n, hit.steps) == (0, 3, 4)
