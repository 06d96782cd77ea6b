"""Features for marker models, standardisation, scoring and post-processing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from kinespark.functions.dims import feature_rows, literal_table
from kinespark.operators import blocks, series
from kinespark.session import materialise

# predict(T x F block) -> T x M, rows in frame order
Predict = Callable[[np.ndarray], np.ndarray]


def marker_set(spark, version: str, part: str, kind: str) -> DataFrame:
    """Ordered (ord, marker) inputs (``feature``) or outputs (``response``)."""
    rows = [(o, m) for v, p, k, o, m in feature_rows() if (v, p, k) == (version, part, kind)]
    return literal_table(spark, ["ord", "marker"], rows)


def marker_names(version: str, part: str, kind: str) -> list[str]:
    return [m for v, p, k, _, m in feature_rows() if (v, p, k) == (version, part, kind)]


def wide_matrix(df: DataFrame, keys: Sequence[str], order: DataFrame) -> DataFrame:
    """Long (keys, marker, x, y, z) to one row per frame with a flat ``f`` array
    in the given order; frames that lack a marker are dropped."""
    n = order.agg(F.count(F.lit(1))).scalar()
    d = df.join(order, "marker")
    pts = F.array_sort(F.collect_list(F.struct("ord", "x", "y", "z")))
    d = d.groupBy(*keys).agg(pts.alias("_p")).where(F.size("_p") == n)
    return d.select(*keys, F.flatten(F.transform("_p", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("f"))


def normalise_by_height(f: Column, height: Column) -> Column:
    return F.transform(f, lambda v: v / height)


def height_in_units(height_m: Column, units: Column) -> Column:
    """Subject height in the trajectory's unit."""
    return height_m * F.when(F.lower(units).startswith("mm"), F.lit(1000.0)).otherwise(F.lit(1.0))


def append_subject(f: Column, height_m: Column, mass_kg: Column, expected: int | None) -> Column:
    """Append nothing, height, or height and mass, whichever gives the length the
    model expects (both when unknown); other lengths are an error."""
    both = F.concat(f, F.array(height_m, mass_kg))
    if expected is None:
        return both
    n = F.size(f)
    return (
        F.when(n == expected, f)
        .when(n + 1 == expected, F.concat(f, F.array(height_m)))
        .when(n + 2 == expected, both)
        .otherwise(F.raise_error(F.concat(F.lit(f"feature length mismatch, expected {expected}, base "), n)).cast("array<double>"))
    )


def standardise(f: Column, mean: Sequence[float] | None, std: Sequence[float] | None) -> Column:
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    if mean is not None:
        f = F.zip_with(f, lit(mean), lambda a, b: a - b)
    if std is not None:
        f = F.zip_with(f, lit(std), lambda a, b: a / b)
    return f


def distribution(df: DataFrame, keys: Sequence[str], column: str = "f") -> DataFrame:
    """Mean and population deviation over all values of an array column."""
    d = df.select(*keys, F.explode(column).alias("v"))
    return d.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def linear_model(matrix: np.ndarray, bias: np.ndarray | None = None) -> Predict:
    b = 0.0 if bias is None else bias
    return lambda x: x @ matrix + b


def score_frames(df: DataFrame, predict: Predict, column: str = "f", out: str = "y") -> DataFrame:
    """Score each frame on its own: a model without memory needs no grouping."""
    schema = StructType([*[f for f in df.schema if f.name != column], StructField(out, ArrayType(DoubleType()))])
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                pdf[out] = list(np.asarray(predict(np.stack(pdf[column].to_list()).astype(float)), dtype=float))
                yield pdf[names]

    return df.mapInPandas(run, schema)


def score_sequences(
    df: DataFrame, predict: Predict, keys: Sequence[str], index: str, context: int, column: str = "f", out: str = "y",
    width: int = 4096,
) -> DataFrame:
    """Score frames in order with ``context`` frames of history and outlook.

    A trial is cut into blocks; ``predict`` sees a block with its context and the
    context's outputs are dropped. This equals scoring the whole trial for models
    whose output depends on at most ``context`` frames on either side."""
    schema = StructType([*[f for f in df.schema if f.name != column], StructField(out, ArrayType(DoubleType()))])
    names = [f.name for f in schema]

    def run(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        own, f = pdf["_own"].to_numpy(), pdf[column].to_list()
        y: list = [None] * len(pdf)
        for a, b in zip(starts, [*starts[1:], len(pdf)]):
            if own[a:b].any():
                y[a:b] = list(np.asarray(predict(np.stack(f[a:b]).astype(float)), dtype=float))
        pdf = pdf.assign(**{out: y})
        return pdf.loc[own, names]

    d = series.with_halo(df, index, context, context, max(width, 2 * context))
    return blocks.map_blocks(d, keys, index, run, schema)


def attach_markers(scored: DataFrame, keys: Sequence[str], responses: Sequence[str], column: str = "y") -> DataFrame:
    """Flat outputs to long marker rows."""
    lit = F.array(*[F.lit(m) for m in responses])
    y = F.col(column)
    pts = F.transform(lit, lambda m, i: F.struct(m.alias("marker"), y[3 * i].alias("x"), y[3 * i + 1].alias("y"), y[3 * i + 2].alias("z")))
    return scored.select(*keys, F.inline(pts))


def drop_to_floor(df: DataFrame, responses: DataFrame, keys: Sequence[str], gap: float = 0.01) -> DataFrame:
    """Shift y so that the lowest response marker of the trial lies ``gap`` above 0;
    trials without responses stay where they are."""
    low = responses.groupBy(*keys).agg(F.min("y").alias("_low"))
    d = df.join(low, list(keys), "left")
    new = F.col("y") - F.coalesce(F.col("_low") - gap, F.lit(0.0))
    return d.select(*[new.alias("y") if c == "y" else F.col(c) for c in df.columns])


def axis_spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[(F.max(c) - F.min(c)).alias(f"spread_{c}") for c in "xyz"])


def enhance(
    markers: DataFrame, subjects: DataFrame, models: dict[str, Predict], version: str = "0.3", units: str = "mm",
    reference: str = "midHip", expected: dict[str, int] | None = None,
    mean: dict[str, Sequence[float]] | None = None, std: dict[str, Sequence[float]] | None = None, gap: float = 0.01,
) -> DataFrame:
    """Whole enhancement: centre on the reference marker, divide by height, append
    subject values, standardise, score each body part, undo the normalisation,
    add the response markers to the input ones and put the feet on the floor.
    Trials without subject values or whole frames keep their input markers.

    ``markers``: trial, frame, marker, x, y, z; ``subjects``: trial, height_m, mass_kg."""
    spark = markers.sparkSession
    key = ["trial", "frame"]
    ref = markers.where(F.col("marker") == reference).select(*key, F.array("x", "y", "z").alias("_ref"))
    subj = subjects.select("trial", "height_m", "mass_kg")
    ok = (F.col("height_m") > 0) & (F.col("mass_kg") > 0)
    responses = None
    for part, predict in models.items():
        names = marker_names(version, part, "feature")
        order = literal_table(spark, ["ord", "marker"], list(enumerate(names)))
        d = markers.join(order, "marker").join(ref, key)
        pts = F.array_sort(F.collect_list(F.struct("ord", *[(F.col(c) - F.col("_ref")[i]).alias(c) for i, c in enumerate("xyz")])))
        d = d.groupBy(*key).agg(pts.alias("_p"), F.first("_ref").alias("_ref")).where(F.size("_p") == len(names))
        d = d.join(subj, "trial").where(ok).withColumn("_h", height_in_units(F.col("height_m"), F.lit(units)))
        flat = F.flatten(F.transform("_p", lambda p: F.array(p["x"], p["y"], p["z"])))
        d = d.withColumn("f", normalise_by_height(flat, F.col("_h")))
        d = d.withColumn("f", append_subject(F.col("f"), F.col("height_m"), F.col("mass_kg"), (expected or {}).get(part)))
        d = d.withColumn("f", standardise(F.col("f"), (mean or {}).get(part), (std or {}).get(part)))
        y = score_frames(d.select(*key, "_ref", "_h", "f"), predict)
        r = attach_markers(y, [*key, "_ref", "_h"], marker_names(version, part, "response"))
        r = r.select(*key, "marker", *[(F.col(c) * F.col("_h") + F.col("_ref")[i]).alias(c) for i, c in enumerate("xyz")])
        responses = r if responses is None else responses.unionByName(r)
    # scored once, used for the union and for the floor
    responses = materialise(responses, "responses")
    everything = markers.select(*key, "marker", "x", "y", "z").unionByName(responses)
    return drop_to_floor(everything, responses, ["trial"], gap)
