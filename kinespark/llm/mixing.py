"""Mixing sources to target weights by capped water-filling.

Sources share a total in proportion to their weights. A source whose share
exceeds ``max_epochs`` times its size is clamped there, and the excess goes to
the others by weight until no share is above its cap. A source that takes
``e`` epochs repeats every document ``floor(e)`` times and a seeded choice of
its documents once more, so that the words taken come to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm.text import hashed_share, n_words
from kinespark.session import materialise

SHARE, MAX_EPOCHS, WEIGHTS = 1.5, 2.0, (5.0, 2.0, 1.0)
#: A source's documents are ranked within 2**BUCKET_BITS ranges of their digest.
BUCKET_BITS, DIGEST_BITS = 12, 60


def water_fill(sources: DataFrame, total: Column | float, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, weight) to those and ``target``, as Spark aggregates.

    The level L at which sum(min(weight * L, cap)) = total: sources in order of
    cap / weight are clamped as long as the level of the rest exceeds that ratio.
    The table has a row a source; no document is read here."""
    cap, w = F.col("source_size") * max_epochs, F.col("weight")
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        sources.withColumns({"cap": cap, "ratio": cap / w})
        .withColumns({"filled": F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)), "before": F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0))})
        .withColumn("all_w", F.sum("weight").over(Window.partitionBy()))
        # the level if just the sources before this one are clamped
        .withColumn("level", (F.lit(total) - F.col("filled")) / (F.col("all_w") - F.col("before")))
        .withColumn("free", F.col("level") <= F.col("ratio"))
        .withColumn("_level", F.min(F.when(F.col("free"), F.struct("ratio", "level"))).over(Window.partitionBy())["level"])
    )
    return ranked.select("source", "source_size", "weight", F.when(F.col("_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), w * F.col("_level"))).alias("target"))


def weigh(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Sources by code point, null last, weigh ``weights`` in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(x) for x in weights])
    return sizes.withColumn("weight", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))


def plan(sized: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Per source: source_size, target, whole (repetitions of every document) and
    ``cut``: documents with a digest up to it are repeated once more (null: none).

    ``sized`` has source, size and digest. Sizes are summed per source and digest
    range; the target falls in one range of a source, and just that range is
    ranked, so no source is sorted whole."""
    bucket = F.shiftright("digest", DIGEST_BITS - BUCKET_BITS)
    ranges = materialise(sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "mix-ranges")
    sizes = ranges.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    targets = water_fill(weigh(sizes, weights), total, max_epochs).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    ).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = materialise(targets, "mix-targets")
    null_key = F.struct(F.col("source").isNull(), F.coalesce("source", F.lit("")))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        ranges.withColumn("low", F.coalesce(F.sum("size").over(run), F.lit(0)))
        .join(targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where("low < rest AND rest <= low + size")
        .select("s", "bucket", "low", "rest")
    )
    inside = Window.partitionBy("s", "bucket").orderBy("digest").rangeBetween(Window.unboundedPreceding, 0)
    cuts = (
        sized.select("source", "digest", "size", bucket.alias("b"))
        .join(edge, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("bucket")))
        .groupBy("s", "bucket", "low", "rest", "digest").agg(F.sum("size").alias("size"))
        .withColumn("upto", F.col("low") + F.sum("size").over(inside))
        # the digest up to which the sum comes nearest to the target; none: all lower ranges
        .groupBy("s", "bucket", "low", "rest")
        .agg(F.min(F.struct(F.abs(F.col("upto") - F.col("rest")).alias("off"), F.col("digest").alias("digest"))).alias("best"))
        .select("s", F.when(F.col("best.off") <= F.col("rest") - F.col("low"), F.col("best.digest")).otherwise(
            F.shiftleft(F.col("bucket"), DIGEST_BITS - BUCKET_BITS) - 1).alias("cut"))
    )
    out = targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")
    return materialise(out, "mix-plan")


def digest(*more: Column) -> Column:
    return hashed_share(F.lit("mix"), F.col("doc_id"), *more)


def mix(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, times: how often each document is taken.

    Null texts and texts without words have size 0 and are taken ``whole`` times
    with no words; null sources are one source; rows that repeat an id share its
    digest and are taken alike. Texts stay out of every shuffle."""
    sized = materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), digest().alias("digest")), "mix-sizes")
    p = plan(sized, **how).withColumnRenamed("source", "s")
    times = F.col("whole") + F.when(F.col("digest") <= F.col("cut"), 1).otherwise(0)
    return sized.join(p, F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"))


def repeat_documents(docs: DataFrame, **how) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it. Only the plan, a row a
    source, meets the texts."""
    names = docs.columns
    p = plan(docs.select("source", n_words(F.col("text")).alias("size"), digest().alias("digest")), **how).withColumnRenamed("source", "s").select("s", "whole", "cut")
    row = docs.select(F.struct(*[F.col(c) for c in names]).alias("_row"), F.col("source").alias("_source"), digest().alias("_digest"))
    times = F.col("whole") + F.when(F.col("_digest") <= F.col("cut"), 1).otherwise(0)
    return row.join(p, F.col("_source").eqNullSafe(F.col("s"))).select("_row", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select("_row.*")
