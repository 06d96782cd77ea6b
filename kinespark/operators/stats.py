"""Exact order statistics without gathering a group in one buffer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.session import materialise

#: Steps of the grid of quantiles that cuts a band, and the sketch's accuracy (error: one in so many rows).
GRID, ACCURACY = 512, 4096
#: Rows between the ends of a band that are ranked at once.
LIMIT = 32768


def _grid(value: Column) -> Column:
    return F.percentile_approx(value, [i / GRID for i in range(GRID + 1)], ACCURACY)


def _bracket(q: Column, rank: Column, n: Column) -> tuple[Column, Column]:
    """Grid values that enclose the ``rank``-th (from 0) of n values, the sketch's error included."""
    at, slack = rank / n * GRID, GRID / ACCURACY + 1e-9
    low = F.greatest(F.lit(0), F.floor(at - slack) - 1).cast("int")
    high = F.least(F.lit(GRID), F.ceil(at + 1.0 / n * GRID + slack) + 1).cast("int")
    return F.get(q, low), F.get(q, high)


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Exact linear-interpolated percentiles per key.

    The built-in ``percentile`` keeps every distinct value of a group in one
    buffer. Here a mergeable quantile sketch brackets each wanted rank between two
    values; rows below, at and between them are counted, and as long as more than
    LIMIT lie between, those are sketched and bracketed again. What is left is
    ranked. Every round is an aggregate, whatever the size of a key; a rank that its
    bracket misses is an error. Result: keys, ``n`` and one column per wanted percentile."""
    keys = list(keys)
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    whole = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), _grid(F.col("_v")).alias("_q"))
    targets = []
    for name, p in wanted.items():
        at = F.lit(p) * (F.col("n") - 1)
        for rank in (F.floor(at), F.ceil(at)):
            targets.append(F.struct(F.lit(name).alias("name"), rank.cast("long").alias("rank"), (at - F.floor(at)).alias("w")))
    bands = whole.select(*keys, "n", "_min", "_max", "_q", F.inline(F.array_distinct(F.array(*targets))))
    low, high = _bracket(F.col("_q"), F.col("rank"), F.col("n"))
    small = F.col("n") <= LIMIT  # nothing to cut
    first, last = F.col("rank") == 0, F.col("rank") == F.col("n") - 1
    ends = lambda a, b, c: F.when(first, F.col("_min")).when(last, F.col("_max")).when(small, F.col(a)).otherwise(c).alias(b)
    bands = bands.select(*keys, "n", "name", "rank", "w", ends("_min", "lo", low), ends("_max", "hi", high),
                         F.when(small, F.col("n")).otherwise(F.ceil(F.col("n") * (4 / GRID + 4 / ACCURACY)) + 4).cast("long").alias("most"))
    bands = materialise(bands, "bands")
    while bands.where((F.col("most") > LIMIT) & (F.col("lo") < F.col("hi"))).take(1):
        bands = materialise(_narrowed(d, bands, keys), "bands")
    return _ranked(d, bands, keys, wanted)


def _same(keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}"))
    return on


def _narrowed(d: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """Bands with more than LIMIT rows between their ends, bracketed anew among those rows."""
    open_ = (F.col("most") > LIMIT) & (F.col("lo") < F.col("hi"))
    own = [*keys, "n", "name", "rank", "w", "lo", "hi"]
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    seen = d.alias("d").join(bands.where(open_).alias("b"), _same(keys)).where(v <= hi).select("b.*", "_v")
    inner = (v > lo) & (v < hi)
    seen = seen.groupBy(*own).agg(
        F.count_if(v < lo).alias("_below"), F.count_if(v == lo).alias("_at"), F.count_if(inner).alias("_in"), F.count_if(v == hi).alias("_top"),
        _grid(F.when(inner, v)).alias("_q"))
    rank = F.col("rank") - F.col("_below") - F.col("_at")  # among the rows between
    miss = F.raise_error(F.lit("a quantile bracket misses its rank")).cast("double")
    a, b = _bracket(F.col("_q"), rank, F.col("_in"))
    where = lambda inside: F.when((rank < 0) & (rank >= -F.col("_at")), lo).when((rank >= 0) & (rank < F.col("_in")), inside).when(
        (rank >= F.col("_in")) & (rank < F.col("_in") + F.col("_top")), hi).otherwise(miss)
    most = F.ceil(F.col("_in") * (4 / GRID + 4 / ACCURACY)) + 4
    done = seen.select(*keys, "n", "name", "rank", "w", where(a).alias("lo"), where(b).alias("hi"), most.cast("long").alias("most"))
    return bands.where(~open_).unionByName(done)


def _ranked(d: DataFrame, bands: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """One row per distinct value of a band, those below it folded into one; the values of its ranks are picked."""
    v, rank = F.col("_v"), F.col("want.rank")
    known = bands.where("lo = hi").select(*keys, "n", "name", "rank", "w", F.col("lo").alias("x"))
    # ranks next to each other share a band
    shared = bands.where("lo < hi").groupBy(*keys, "n", "lo", "hi").agg(F.collect_list(F.struct("name", "rank", "w")).alias("_want"))
    counted = (
        d.alias("d").join(shared.alias("b"), _same(keys)).where(v <= F.col("hi"))
        .select("b.*", F.when(v >= F.col("lo"), v).alias("_k"))
        .groupBy(*keys, "n", "lo", "hi", "_want", "_k").agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = W.partitionBy(*keys, "lo", "hi").orderBy(F.col("_k").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ends = counted.withColumn("_end", F.sum("_c").over(upto)).select(*keys, "n", "_k", "_c", "_end", F.explode("_want").alias("want"))
    hit = (F.col("_end") > rank) & (F.col("_end") - F.col("_c") <= rank)
    found = ends.groupBy(*keys, "n", "want").agg(F.max(F.when(hit, F.col("_k"))).alias("x"))
    x = F.coalesce(F.col("x"), F.raise_error(F.lit("a quantile bracket misses its rank")).cast("double"))
    picked = known.unionByName(found.select(*keys, "n", "want.*", x.alias("x")))
    value = F.min("x") + (F.max("x") - F.min("x")) * F.max("w")
    each = picked.groupBy(*keys, "n", "name").agg(value.alias("x"))
    return each.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("name") == n, F.col("x"))).alias(n) for n in wanted])
