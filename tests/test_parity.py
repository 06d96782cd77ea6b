"""A cross-section of registered queries against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "nation region customer supplier part orders lineitem events embeddings".split()
NAMES = [
    "agg_14_report_two_grains", "agg_16_similarity_fit", "agg_2_best_person", "jon_7_native_match", "jon_9_bracket",
    "win_20_tracked_box", "sca_11_canonical_per_frame", "sca_17_undistort", "src_4_alias_scan", "src_7_trc_tolerant",
    "fea_9_enhancement", "win_17_relaxed_still", "job_13_crop_plan", "job_7_frame_procrustes",
]


def norm(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return v


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    a = sorted(repr(tuple(norm(r[c]) for c in sorted(cols))) for r in df.collect())
    b = sorted(repr(tuple(norm(r[cols.index(c)]) for c in sorted(cols))) for r in cur.fetchall())
    assert len(a) == len(b) and len(a) > 0
    same = sum(x == y for x, y in zip(a, b))
    assert same >= len(a) - math.ceil(len(a) * 1e-3)


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_stream_equals_batch(spark, sf):
    from pyspark.sql import functions as F

    from kinespark.plans import fixtures as X
    from kinespark.plans.q_jobs import drained
    from kinespark.session import scratch_path
    from kinespark.sources import jsonl
    from kinespark.streaming import live

    path = scratch_path(spark, "twin")
    jsonl.write_frames(X.persons(spark, sf), path, partition=None)
    out = drained(spark, live.quality_windows(live.live_frames(spark, path, lateness="0 seconds"), "1 second"))
    want = live.quality_windows(live.with_event_time(X.persons(spark, sf), "2024-01-01 00:00:00"), "1 second")
    last = want.agg(F.max("start")).first()[0]
    r = lambda d: d.where(F.col("start") < last).select("start", "trial_id", "frames", "persons", F.round("mean_score", 9).alias("m"))
    assert r(out).exceptAll(r(want)).count() == 0 and r(want).exceptAll(r(out)).count() == 0
