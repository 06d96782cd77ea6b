"""Marker trajectories as TRC text.

Files are read line by line, so a file may be split over many tasks. A line's
place is (file, split offset, running id). The strict scan finds the header in the
first split of a trial's first file, the tolerant one anywhere. A trial may be one file or a folder of ordered parts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.functions import text
from kinespark.session import materialise

HEADER_LINES = 6
# Second header line.
HEADER_FIELDS = ["DataRate", "CameraRate", "NumFrames", "NumMarkers", "Units", "OrigDataRate", "OrigDataStartFrame", "OrigNumFrames"]


def write_trc(
    df: DataFrame, path: str, rate: float, order: Sequence[str] | None = None, units: str = "mm",
    source_rate: float | None = None, digits: int = 5,
) -> None:
    """Write (trial, frame, marker, x, y, z) as one folder of TRC parts per trial.

    Frames count from 0 here and from 1 in the file; times are frame / rate;
    missing values are empty cells. The parts of a trial, in name order, are one
    TRC text, so a long trial is written by many tasks."""
    # markers are read more than once, lines once more to find the ranges
    lines = materialise(trc_lines(materialise(df, "markers"), rate, order, units, source_rate, digits), "lines")
    lines.repartitionByRange("trial", "pos").sortWithinPartitions(
        "trial", "pos"
    ).select("trial", F.col("line").alias("value")).write.mode("overwrite").partitionBy("trial").text(path)


def trc_lines(
    df: DataFrame, rate: float, order: Sequence[str] | None = None, units: str = "mm",
    source_rate: float | None = None, digits: int = 5,
) -> DataFrame:
    """(trial, pos, line): header lines at 0..5, frame f at f + 6."""
    src = rate if source_rate is None else source_rate
    cells = F.map_from_entries(F.collect_list(F.struct("marker", F.struct("x", "y", "z"))))
    body = df.groupBy("trial", "frame").agg(cells.alias("_m"))
    names = F.array_sort(F.collect_set("marker")) if order is None else F.array(*[F.lit(m) for m in order])
    stats = df.groupBy("trial").agg((F.max("frame") + 1).alias("_f"), names.alias("_names"))
    d = body.join(stats.select("trial", "_names"), "trial")
    one = lambda n: F.transform(
        F.array(*[F.try_element_at(F.col("_m"), n)[c] for c in "xyz"]), lambda v: text.fixed(v, digits)
    )
    row = F.concat(
        F.array((F.col("frame") + 1).cast("string"), text.fixed(F.col("frame") / rate, 8)),
        F.flatten(F.transform("_names", one)),
    )
    d = d.select("trial", (F.col("frame") + HEADER_LINES).alias("pos"), F.array_join(row, "\t").alias("line"))
    k, n = F.size("_names"), F.col("_f").cast("string")
    xyz = F.transform(F.sequence(F.lit(1), k), lambda i: F.concat_ws("\t", *[F.concat(F.lit(c), i.cast("string")) for c in "XYZ"]))
    numbers = F.concat_ws(
        "\t", F.lit(f"{rate:.1f}"), F.lit(f"{rate:.1f}"), n, k.cast("string"), F.lit(units), F.lit(f"{src:.1f}"), F.lit("1"), n
    )
    lines = [
        F.concat(F.lit("PathFileType\t4\t(X/Y/Z)\t"), F.col("trial").cast("string"), F.lit(".trc")),
        F.lit("\t".join(HEADER_FIELDS)), numbers,
        F.concat(F.lit("Frame#\tTime\t"), F.array_join("_names", "\t\t\t"), F.lit("\t\t\t")),
        F.concat(F.lit("\t"), F.array_join(xyz, "\t")), F.lit(""),
    ]
    head = stats.select("trial", F.posexplode(F.array(*lines)).alias("pos", "line"))
    return head.select("trial", F.col("pos").cast("long").alias("pos"), "line").unionByName(d)


def _lines(spark: SparkSession, path: str, trial: str) -> DataFrame:
    """trial, value, pos (order of the line: file, split offset, running id), written once: the
    scans read them several times, and opening many small files is what takes the time."""
    raw = spark.read.text(path)
    name = F.col(trial).cast("string") if trial in raw.columns else F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1)
    return materialise(raw.select(
        name.alias("trial"), "value",
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("id")).alias("pos"),
    ), "lines")


def _numbered(spark: SparkSession, path: str, trial: str) -> DataFrame:
    """trial, value, pos, no (line number in the first split)."""
    raw = _lines(spark, path, trial)
    first = raw.groupBy("trial").agg(F.min("pos").alias("_first"))
    same = (F.col("pos.file") == F.col("_first.file")) & (F.col("pos.block") == F.col("_first.block"))
    return raw.join(first, "trial").select("trial", "value", "pos", F.when(same, F.col("pos.id") - F.col("_first.id")).alias("no"))


def _names(line: Column) -> Column:
    fields = F.filter(F.split(line, "[\\s,]+"), lambda s: s != "")
    return F.slice(fields, F.lit(3), F.greatest(F.size(fields) - 2, F.lit(0)))


def _rows(cells: Column, names: Column) -> Column:
    """Marker structs from a frame's cells."""
    num = lambda i: F.get(cells, i).try_cast("double")
    return F.transform(names, lambda m, i: F.struct(
        m.alias("marker"), num(3 * i + 2).alias("x"), num(3 * i + 3).alias("y"), num(3 * i + 4).alias("z")))


def read_trc(spark: SparkSession, path: str, trial: str = "trial") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Strict scan: (header, markers, errors). The header is at fixed lines; a
    frame whose cell count is not 2 + 3 markers, or whose number or time can't be
    read, becomes an error row; missing header fields are NULL."""
    d = _numbered(spark, path, trial)
    at = lambda n: F.max(F.when(F.col("no") == n, F.col("value")))
    head = d.where(F.col("no") < HEADER_LINES).groupBy("trial").agg(at(2).alias("v"), at(3).alias("n"))
    v = F.split("v", "\\s+")
    header = head.select(
        "trial", F.get(v, 0).try_cast("double").alias("data_rate"), F.get(v, 1).try_cast("double").alias("camera_rate"),
        F.get(v, 2).try_cast("int").alias("num_frames"), F.get(v, 3).try_cast("int").alias("num_markers"), F.get(v, 4).alias("units"),
        F.get(v, 5).try_cast("double").alias("orig_data_rate"), _names(F.col("n")).alias("markers"),
    )
    body = d.where("no is null or no >= 5").where(F.trim("value") != "").join(header.select("trial", "markers"), "trial")
    body = body.withColumn("cells", F.split("value", "\t"))
    number, time = F.get("cells", 0).try_cast("long"), F.get("cells", 1).try_cast("double")
    good = F.coalesce((F.size("cells") == 2 + 3 * F.size("markers")) & number.isNotNull() & time.isNotNull(), F.lit(False))
    rows = body.where(good).select(
        "trial", (number - 1).alias("frame"), time.alias("t"),
        F.inline(_rows(F.col("cells"), F.col("markers"))),
    )
    errors = body.where(~good).select("trial", F.col("pos.id").alias("line"), F.size("cells").alias("cells"),
                                      (2 + 3 * F.size("markers")).alias("expected"))
    return header, rows, errors


def read_any_trc(
    spark: SparkSession, path: str, trial: str = "trial", zero_as_missing: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Tolerant scan: (header, markers in metres). The name line is the first line with
    Frame and Time fields, on whatever line and in whatever split; units and rate go
    by column name in the first Units line above it; unreadable cells are missing and
    data end at the first line that is not numeric. The header has a row for every
    trial: ``status`` is ``no names`` for one without a name line, which has no markers."""
    d = _lines(spark, path, trial)
    has = lambda *words: reduce(lambda x, y: x & y, [F.col("value").rlike(rf"(?i)\b{w}\b") for w in words])
    at = d.groupBy("trial").agg(F.min(F.when(has("Frame", "Time"), F.col("pos"))).alias("_h"), F.min(F.when(has("Units"), F.col("pos"))).alias("_u"))
    lost = at.where("_h is null").select("trial", F.lit("no names").alias("status"))
    d = d.join(at.where("_h is not null").select("trial", "_h", F.when(F.col("_u") < F.col("_h"), F.col("_u")).alias("_u")), "trial")
    # the lines themselves, and the ones right behind them
    line = lambda c: F.max(F.when(F.col("pos") == F.col(c), F.col("value")))
    after = lambda c: F.min(F.when(F.col("pos") > F.col(c), F.struct("pos", "value")))
    lines = d.groupBy("trial").agg(line("_h").alias("_names"), line("_u").alias("_fields"), after("_u")["value"].alias("_values"), after("_h")["pos"].alias("_s"))
    cols = lambda c: F.filter(F.split(c, "[\\s,]+"), lambda s: s != "")
    lines = lines.select("trial", "_names", "_s", F.transform(cols(F.col("_fields")), lambda s: F.lower(s)).alias("_k"), cols(F.col("_values")).alias("_v"))
    field = lambda n: F.when(F.array_position("_k", n) > 0, F.get("_v", (F.array_position("_k", n) - 1).cast("int")))
    header = lines.select(
        "trial", "_s", F.lower(F.coalesce(field("units"), F.lit("m"))).alias("units"),
        field("datarate").try_cast("double").alias("data_rate"), _names(F.col("_names")).alias("markers"),
    )
    body = d.drop("_h", "_u").join(header, "trial").where(F.col("pos") > F.col("_s")).where(F.trim("value") != "")
    tabbed = F.split("value", "\t")
    body = body.withColumn("cells", F.when(F.col("value").contains("\t"), tabbed).otherwise(cols(F.col("value"))))
    num = lambda k: F.get("cells", F.lit(k)).try_cast("double")
    body = body.withColumn("_ok", num(0).isNotNull() & num(1).isNotNull())
    stop = body.groupBy("trial").agg(F.min(F.when(~F.col("_ok"), F.col("pos"))).alias("_stop"))
    body = body.join(stop, "trial").where("_stop is null or pos < _stop")
    rows = body.select("trial", num(0).cast("long").alias("frame"), num(1).alias("t"), "units",
                       F.inline(_rows(F.col("cells"), F.transform("markers", lambda m: text.clean_name(m)))))
    if zero_as_missing:
        from kinespark.operators.select import zero_as_missing as drop_zeros

        rows = drop_zeros(rows, mode=zero_as_missing)
    mm = F.col("units").contains("mm")
    rows = rows.select("trial", "frame", "t", "marker", *[F.when(mm, F.col(c) * (1.0 / 1000.0)).otherwise(F.col(c)).alias(c) for c in "xyz"])
    found = header.drop("_s").withColumn("status", F.lit("ok"))
    return found.unionByName(lost, allowMissingColumns=True), rows


def check_header(header: DataFrame, rows: DataFrame) -> DataFrame:
    """Declared against actual counts; the actual ones win."""
    f = rows.select("trial", "frame").distinct().groupBy("trial").agg(F.count(F.lit(1)).alias("frames"))
    m = rows.select("trial", "marker").distinct().groupBy("trial").agg(F.count(F.lit(1)).alias("markers"))
    h = header.select("trial", "num_frames", "num_markers")
    return h.join(f, "trial").join(m, "trial").select(
        "trial", "frames", "markers",
        (F.col("num_frames") != F.col("frames")).alias("frames_differ"),
        (F.col("num_markers") != F.col("markers")).alias("markers_differ"),
    )
