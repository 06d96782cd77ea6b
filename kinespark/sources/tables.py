"""Meta records, array bundles, reports and aligned series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

META_SCHEMA = (
    "trial string, dataset_name string, keypoint_names array<string>, subject struct<id:string,sex:string,height_m:double,"
    "mass_kg:double>, calibration string, fps double"
)

# Accepted bundle columns, best first.
BUNDLE_DATA = ["pred_mm", "markers_mm", "outputs", "Y", "pred", "arr_0"]
BUNDLE_NAMES = ["names", "marker_names", "markers_names", "joint_names"]
BUNDLE_TIMES = ["t_60", "t", "time_60", "time"]


def read_meta(spark: SparkSession, path: str, schema: str = META_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def check_meta(meta: DataFrame) -> DataFrame:
    """Add ``missing``: required subject fields that are absent or not positive."""
    bad = lambda c: F.col(c).isNull() | ~(F.col(c) > 0)
    names = [("height_m", bad("subject.height_m")), ("mass_kg", bad("subject.mass_kg")),
             ("keypoint_names", F.col("keypoint_names").isNull())]
    return meta.withColumn("missing", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in names]), lambda x: x.isNotNull()))


def write_meta_once(meta: DataFrame, roots: Sequence[str], path: str) -> None:
    """One meta record per output root."""
    meta.dropDuplicates(list(roots)).write.mode("overwrite").json(path)


def read_bundles(df: DataFrame, keys: Sequence[str], fs: float = 60.0) -> DataFrame:
    """Array bundles to long rows (keys, i, t, marker, x, y, z). Columns are found
    under any accepted name; without a time vector t = i / fs."""
    have = set(df.columns)
    pick = lambda names: F.coalesce(*[F.col(n) for n in names if n in have]) if have & set(names) else None
    data, names, times = pick(BUNDLE_DATA), pick(BUNDLE_NAMES), pick(BUNDLE_TIMES)
    if data is None or names is None:
        raise ValueError("no prediction array or no marker names in the bundle")
    d = df.select(*keys, names.alias("_n"), (times if times is not None else F.lit(None).cast("array<double>")).alias("_t"),
                  F.posexplode(data).alias("i", "_row"))
    t = F.coalesce(F.get("_t", F.col("i")), F.col("i") / fs)
    pts = F.transform("_n", lambda m, k: F.struct(m.alias("marker"), *[F.get(F.get(F.col("_row"), k), F.lit(a)).alias(c) for a, c in enumerate("xyz")]))
    return d.select(*keys, "i", t.alias("t"), F.inline(pts))


def finite(c: Column) -> Column:
    """NaN and infinities as NULL, at every boundary of the library."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def report_records(joint_rows: DataFrame, trial_rows: DataFrame, key: str = "trial") -> DataFrame:
    """One record per trial: the trial's scalars and per-joint maps. The maps hold
    one entry per joint of the dictionary."""
    maps = [c for c in joint_rows.columns if c not in (key, "joint")]
    entry = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct("joint", finite(F.col(c).cast("double")).alias("v")))))
    j = joint_rows.groupBy(key).agg(*[entry(c).alias(f"per_joint_{c}") for c in maps])
    return trial_rows.join(j, key)


def write_report(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def write_series(df: DataFrame, path: str, key: str = "trial") -> None:
    """Aligned series (trial, variant, i, t, joint, x, y, z) as parquet."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)
