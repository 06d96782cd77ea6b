"""Streaming counterparts: live ingest, quality windows and keyed state."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kinespark.sources.jsonl import FRAME_SCHEMA


def live_frames(
    spark: SparkSession, path: str, session_start: str = "2024-01-01 00:00:00", lateness: str = "30 seconds",
    max_files: int = 1000, schema: str = FRAME_SCHEMA,
) -> DataFrame:
    """Frame records as they arrive, with event time ``ts``; repeated frames within
    the lateness are dropped."""
    d = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).json(path)
    return with_event_time(d, session_start).withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["trial_id", "frame_index"])


def with_event_time(d: DataFrame, session_start: str) -> DataFrame:
    us = F.unix_micros(F.lit(session_start).cast("timestamp")) + F.round(F.col("time_sec") * 1e6).cast("long")
    return d.withColumn("ts", F.timestamp_micros(us))


def quality_windows(d: DataFrame, length: str = "10 seconds") -> DataFrame:
    """Frames, persons, mean score and share of empty frames per trial and window.
    Works the same on a stream and on a table."""
    n = F.size("persons")
    score = F.aggregate("persons", F.lit(0.0), lambda a, p: a + F.coalesce(p["mean_score"], F.lit(1.0)))
    g = d.groupBy(F.window("ts", length), "trial_id").agg(
        F.count(F.lit(1)).alias("frames"), F.sum(n).alias("persons"), F.sum(score).alias("_s"), F.count_if(n == 0).alias("_e"))
    share: Column = F.col("_e") / F.col("frames")
    return g.select(F.col("window.start").alias("start"), "trial_id", "frames", "persons",
                    F.when(F.col("persons") > 0, F.col("_s") / F.col("persons")).alias("mean_score"), share.alias("empty_share"))


def closed_windows(frames: DataFrame, length: str = "10 seconds") -> DataFrame:
    """:func:`quality_windows` of a stream of :func:`live_frames`: each window comes out once,
    when the watermark has passed it; frames behind the watermark are left out and counted
    (see :func:`run_to_table`). The window of the record that ends a session stays open."""
    return quality_windows(frames, length)


def write_end_of_session(spark: SparkSession, path: str) -> None:
    """A last record without a trial, later than any other, in a folder of frame records: it
    moves the watermark past all of them."""
    seconds = F.unix_seconds(F.lit(END).cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    row = spark.range(1).select(F.lit("").alias("trial_id"), F.lit(-1).cast("long").alias("frame_index"), seconds.cast("double").alias("time_sec"))
    row.write.mode("append").json(path)


OUTPUT = "person long, frame long, tx double, ty double, tz double, x1 double, y1 double, x2 double, y2 double"
STATE = "seen long, tx double, ty double, tz double, x1 double, y1 double, x2 double, y2 double, held binary"
#: Event time of the row that ends a session: later than any record.
END = "2200-01-01 00:00:00"


def end_of_session(d: DataFrame) -> DataFrame:
    """One row like those of ``d``, nulls but for ``ts``: written to a stream's folder
    after all records, it moves the watermark past every one of them."""
    row = d.sparkSession.range(1)
    return row.select(*[(F.lit(END) if f.name == "ts" else F.lit(None)).cast(f.dataType).alias(f.name) for f in d.schema])


def keyed_smoothing(d: DataFrame, alpha: float, lateness: str = "30 seconds", timeout_ms: int | None = None) -> DataFrame:
    """Running exponential average of the translation and the last known box per
    (trial, person): rows trial, person, frame, ts, tx, ty, tz, x1, y1, x2, y2 in,
    smoothed rows out; ``ts`` rises with the frame.

    Rows wait in the state until the watermark, ``lateness`` behind the latest ``ts``,
    has passed them, and leave in order of their frames; of a repeated frame the first
    is taken. So the result doesn't depend on how rows fall into micro-batches. Rows
    that come when the watermark has passed them are left out and counted by
    ``run_to_table``. What waits when a stream ends needs ``end_of_session``.

    ``timeout_ms`` drops the state of keys that many milliseconds of event time after
    their last row."""
    cols = ["tx", "ty", "tz"]
    box = ["x1", "y1", "x2", "y2"]
    names = ["us", "frame", *cols, *box]

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, ema, b, held = 0, np.full(3, np.nan), np.full(4, np.nan), np.zeros((0, len(names)))
        if state.exists:
            s = state.get
            seen, ema, b = s[0], np.array(s[1:4], float), np.array(s[4:8], float)
            held = np.frombuffer(s[8], float).reshape(-1, len(names))
        new = [] if state.hasTimedOut else [x[names].to_numpy(float) for x in batches]
        rows = np.concatenate([held, *new])
        rows = rows[~np.isnan(rows[:, 1])]  # the end of a session has no frame
        rows = rows[np.unique(rows[:, 1], return_index=True)[1]]
        passed = ~(rows[:, 0] > state.getCurrentWatermarkMs() * 1000)  # a row without a time doesn't wait
        out, held = [], rows[~passed]
        for row in rows[passed]:
            t, x = row[2:5], row[5:]
            if np.isfinite(t).all():
                ema = t if not np.isfinite(ema).all() else (1 - alpha) * ema + alpha * t
            if np.isfinite(x).all():
                b = x
            out.append((key[0], key[1], int(row[1]), *ema, *b))
        seen = int(np.fmax.reduce(rows[:, 0], initial=seen))
        forget = seen // 1000 + timeout_ms if timeout_ms and seen else None
        if len(held):
            state.update((seen, *map(float, ema), *map(float, b), held.tobytes()))
            state.setTimeoutTimestamp(int(held[:, 0].min()) // 1000 + 1)
        elif forget and forget <= state.getCurrentWatermarkMs():
            if state.exists:
                state.remove()
        elif seen:
            state.update((seen, *map(float, ema), *map(float, b), b""))
            if forget:
                state.setTimeoutTimestamp(forget)
        if out:
            yield pd.DataFrame(out, columns=["trial", "person", "frame", *cols, *box])

    timed = d.withColumn("us", F.unix_micros("ts")).withWatermark("ts", lateness)
    return timed.groupBy("trial", "person").applyInPandasWithState(
        step, f"trial {d.schema['trial'].dataType.simpleString()}, {OUTPUT}", STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(d: DataFrame, path: str, checkpoint: str, mode: str = "append") -> int:
    """Drain what is available now into parquet; restartable from its checkpoint.
    Returns, and warns of, the number of rows left out as they came behind the watermark."""
    q = (d.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    late: dict[int, int] = {}
    done = False
    while not done:  # the query remembers its last 100 batches only
        done = q.awaitTermination(1)
        for p in q.recentProgress:
            late[p["batchId"]] = max(late.get(p["batchId"], 0), sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]))
    n = sum(late.values())
    if n:
        warnings.warn(f"{n} rows came behind the watermark and were left out", stacklevel=2)
    return n
