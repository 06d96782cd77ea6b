"""Ordered work inside a trial, cut into bounded blocks.

A window partitioned by trial alone puts a whole trial in one task. Here the
order axis (frame number or seconds) is cut into blocks; each operator runs its
window per ``(keys, block)`` and passes what crosses a block edge either as a

* halo  - the few neighbouring rows a block needs, copied to it, or
* carry - one summary row per block, scanned per key and joined back.

Both are exact. A block holds at most ``width`` steps of one key, whatever the
length of the trial.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinespark.session import materialise

FRAMES_PER_BLOCK = 16384
SECONDS_PER_BLOCK = 600.0


def group_rows(width: int) -> int:
    """Rows of a group of whole blocks of ``width``, about FRAMES_PER_BLOCK."""
    return width * max(1, FRAMES_PER_BLOCK // width)


def block_of(order: str | Column, width: float) -> Column:
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(width)).cast("long")


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def add_running_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, name: str
) -> DataFrame:
    """0-based position of each row inside its key, in ``order``.

    ``bucket`` must not decrease along ``order``. Positions are counted inside
    each bucket and shifted by the sizes of the earlier buckets; rows without a key or
    bucket are left out. Every bucket has one size, so where a plan doesn't use the
    positions (say, the distinct keys), Spark drops the left join and the window with it."""
    keys = list(keys)
    d = df.withColumn("_bk", bucket).where(" and ".join(f"`{k}` is not null" for k in [*keys, "_bk"]))
    sizes = d.groupBy(*keys, "_bk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_bk").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        *keys, "_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")
    )
    local = F.row_number().over(W.partitionBy(*keys, "_bk").orderBy(*order))
    return (
        d.withColumn("_rn", local)
        .join(sizes, [*keys, "_bk"], "left")
        .withColumn(name, (F.col("_rn") + F.col("_off") - 1).cast("long"))
        .drop("_bk", "_rn", "_off")
    )


def carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column,
    value: Column,
    name: str,
    forward: bool = True,
    inclusive: bool = True,
) -> DataFrame:
    """Last non-null ``value`` at or before each row (``forward``), or the first
    one at or after it. ``order`` lists ascending sort columns; ``block`` must
    not decrease along them. ``inclusive=False`` leaves the row itself out."""
    return carry_many(df, keys, order, block, {name: (value, forward)}, inclusive)


#: Blocks whose summaries are scanned together.
BLOCKS_PER_GROUP = 256


def carry_many(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column,
    values: dict[str, tuple[Column, bool]],
    inclusive: bool = True,
    totals: dict[str, Column] | None = None,
    place: str | None = None,
    extent: str | None = None,
) -> DataFrame:
    """Several :func:`carry` columns at once: one shuffle and one sort of the rows, one
    summary row per block. Summaries are scanned in groups of blocks, then across the
    groups, so a key of many sparse blocks has no long scan either. ``totals`` adds the
    number of non-null values of a key. ``place`` names a number that orders the rows that
    have a value; summaries of plain or struct values then aggregate by hash. ``extent`` adds
    the least and largest value of a column in a key, ``_lo`` and ``_hi``."""
    keys, totals, ends = list(keys), totals or {}, {"_lo": F.min, "_hi": F.max} if extent else {}
    d = df.withColumn("_blk", block)
    names = [c if isinstance(c, str) else f"_o{k}" for k, c in enumerate(order)]
    own: dict[int, str] = {}  # a value carried both ways is kept once
    col_of = {}
    for n, (v, _) in values.items():
        if id(v) not in own:
            own[id(v)] = f"_v_{n}"
            d = d.withColumn(f"_v_{n}", v)
        col_of[n] = own[id(v)]
    d = d.withColumns({f"_v_{n}": v for n, v in totals.items()} | {n: c for n, c in zip(names, order) if not isinstance(c, str)})
    pos = F.col(place) if place else F.struct(*names)
    tails = d.groupBy(*keys, "_blk").agg(
        *[a for n, (_, fwd) in values.items() for a in _tail(d, col_of[n], n, fwd, pos, place is not None)],
        *[F.count(f"_v_{n}").alias(f"_t_{n}") for n in totals], *[f(extent).alias(f"_t_{n}") for n, f in ends.items()])
    tails = tails.select(*keys, "_blk", *[_whole_tail(d, col_of[n], n, place is not None).alias(f"_t_{n}") for n in values], *[f"_t_{n}" for n in (*totals, *ends)])
    over = f"OVER (PARTITION BY {', '.join(f'`{k}`' for k in keys)}, _blk ORDER BY {', '.join(f'`{n}`' for n in names)})"
    near = {n: F.expr(f"{'lag' if fwd else 'lead'}(`{col_of[n]}`, 1) IGNORE NULLS {over}") for n, (_, fwd) in values.items()}
    local = d.select(*df.columns, "_blk", *[(F.coalesce(F.col(col_of[n]), c) if inclusive else c).alias(f"_l_{n}") for n, c in near.items()])
    # a row per block, used three times; rows are sorted already, and written rows can look small enough to be broadcast
    return local.join(_scan(materialise(tails, "tails"), keys, values, totals, ends).hint("merge"), [*keys, "_blk"]).select(
        *df.columns, *[F.coalesce(F.col(f"_l_{n}"), F.col(f"_c_{n}")).alias(n) for n in values], *[F.col(f"_c_{n}").alias(n) for n in (*totals, *ends)],
    )


def _tail(d: DataFrame, c: str, n: str, fwd: bool, pos: Column, plain: bool) -> list[Column]:
    """Aggregates of a block's last (``fwd``) or first known value; field by field if ``plain``."""
    at = F.when(F.col(c).isNotNull(), pos)
    by, end = (F.max_by, F.max) if fwd else (F.min_by, F.min)
    kind = d.schema[c].dataType
    if plain and isinstance(kind, StructType):
        return [end(at).alias(f"_at_{n}"), *[by(F.col(c)[f], at).alias(f"_t_{n}_{k}") for k, f in enumerate(kind.names)]]
    return [by(F.col(c), at).alias(f"_t_{n}")]


def _whole_tail(d: DataFrame, c: str, n: str, plain: bool) -> Column:
    kind = d.schema[c].dataType
    if plain and isinstance(kind, StructType):
        return F.when(F.col(f"_at_{n}").isNotNull(), F.struct(*[F.col(f"_t_{n}_{k}").alias(f) for k, f in enumerate(kind.names)]))
    return F.col(f"_t_{n}")


def _scan(
    tails: DataFrame, keys: list[str], values: dict[str, tuple[Column, bool]], totals: dict[str, Column], ends: dict[str, Callable] | None = None,
) -> DataFrame:
    """keys, _blk, _c_<name>: what reaches each block from the blocks before or behind it, and what
    ``totals`` (added up) and ``ends`` (by their function) make of all blocks of the key."""
    whole = {n: F.sum for n in totals} | (ends or {})
    group = F.floor(F.col("_blk") / BLOCKS_PER_GROUP)
    d = tails.withColumn("_grp", group)
    known = lambda n: F.when(F.col(f"_t_{n}").isNotNull(), F.col("_blk"))
    groups = d.groupBy(*keys, "_grp").agg(
        *[(F.max_by if fwd else F.min_by)(F.col(f"_t_{n}"), known(n)).alias(f"_t_{n}") for n, (_, fwd) in values.items()],
        *[f(f"_t_{n}").alias(f"_t_{n}") for n, f in whole.items()])

    def reach(partition: list[str], along: str, n: str, fwd: bool) -> Column:
        w = W.partitionBy(*partition).orderBy(F.col(along).asc() if fwd else F.col(along).desc()).rowsBetween(W.unboundedPreceding, -1)
        return F.last(f"_t_{n}", ignorenulls=True).over(w)

    far = groups.select(*keys, "_grp", *[reach(keys, "_grp", n, fwd).alias(f"_g_{n}") for n, (_, fwd) in values.items()],
                        *[f(f"_t_{n}").over(W.partitionBy(*keys)).alias(f"_c_{n}") for n, f in whole.items()])
    near = d.select(*keys, "_blk", "_grp", *[reach([*keys, "_grp"], "_blk", n, fwd).alias(f"_n_{n}") for n, (_, fwd) in values.items()])
    return near.join(far, [*keys, "_grp"]).select(
        *keys, "_blk", *[F.coalesce(f"_n_{n}", f"_g_{n}").alias(f"_c_{n}") for n in values], *[f"_c_{n}" for n in whole])


def with_halo(
    df: DataFrame, index: str, before: int | Column, after: int | Column, width: int
) -> DataFrame:
    """Copy each row into every block that needs it: its own (``_own`` true) and
    those whose span, widened by ``before``/``after`` steps, reaches it."""
    i = F.col(index)
    b = F.lit(before) if isinstance(before, int) else before
    a = F.lit(after) if isinstance(after, int) else after
    span = F.sequence(block_of(i - a, width), block_of(i + b, width))
    return df.withColumn("_blk", F.explode(span)).withColumn(
        "_own", F.col("_blk") == block_of(i, width)
    )


def rolling(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    before: int,
    after: int,
    aggs: dict[str, Column],
    width: int = FRAMES_PER_BLOCK,
) -> DataFrame:
    """Row-framed aggregates over ``before`` rows back to ``after`` rows ahead on
    a gap-free integer index."""
    d = with_halo(df, index, before, after, max(width, before + after))
    w = W.partitionBy(*keys, "_blk").orderBy(index).rowsBetween(-before, after)
    d = d.select("*", *[a.over(w).alias(n) for n, a in aggs.items()])
    return d.where("_own").drop("_blk", "_own")


def shift(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    columns: dict[str, str],
    by: int,
    width: int = FRAMES_PER_BLOCK,
) -> DataFrame:
    """``lag`` (``by`` > 0) or ``lead`` (``by`` < 0) on a gap-free integer index;
    ``columns`` maps the new name to the source column."""
    n = abs(by)
    d = with_halo(df, index, n if by > 0 else 0, 0 if by > 0 else n, max(width, n))
    w = W.partitionBy(*keys, "_blk").orderBy(index)
    fn = F.lag if by > 0 else F.lead
    d = d.select("*", *[fn(c, n).over(w).alias(o) for o, c in columns.items()])
    return d.where("_own").drop("_blk", "_own")


def per_key(df: DataFrame, keys: Sequence[str], *aggs: Column, written: bool = False) -> DataFrame:
    """Join per-key aggregates back to the rows. The aggregate is combined map
    side first, so a hot key costs one small row per task, not one big window.
    ``written`` writes the aggregates first, so that the join knows their size and
    rows are not shuffled to a small table."""
    found = df.groupBy(*keys).agg(*aggs)
    return df.join(materialise(found, "keys") if written else found, list(keys))
