"""NumPy work on whole (keys, block) groups, streamed through each partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

# fn(frame, starts): frame holds complete blocks in order, starts their first rows
BlockFn = Callable[[pd.DataFrame, np.ndarray], pd.DataFrame]

#: Numeric columns by name: values, and which of them are known.
Columns = dict[str, tuple[np.ndarray, np.ndarray]]


def map_blocks(df: DataFrame, keys: Sequence[str], order: str, fn: BlockFn, schema: StructType) -> DataFrame:
    """Shuffle by (keys, _blk), sort, and hand complete blocks to ``fn``.

    Many blocks travel in one Arrow batch; a task holds one batch and at most one
    unfinished block at a time."""
    group = [*keys, "_blk"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if pdf.empty:
                continue
            new = np.zeros(len(pdf), dtype=bool)
            new[0] = True
            for c in group:
                v = pdf[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            last = int(starts[-1])
            if last and len(out := fn(pdf.iloc[:last], starts[:-1])):
                yield out
            held = pdf.iloc[last:].reset_index(drop=True)
        if held is not None and len(out := fn(held, np.array([0]))):
            yield out

    placed = df.repartition(*group).sortWithinPartitions(*group, order)
    return placed.mapInPandas(run, schema)


def map_placed(
    df: DataFrame, index: str, out: Sequence[str], fn: Callable[[Columns, np.ndarray], Columns], needs: Sequence[str], width: int, halo: int,
) -> DataFrame:
    """Hand complete groups of rows that :func:`resample.on_grid` has placed (groups of ``width``
    rows and the ``halo`` on both sides) to ``fn``, which gets the columns ``needs``, the index, _grp
    and _n, and the groups' first rows, and yields new columns. Columns ``out`` of the groups' own
    rows are returned.

    Rows stay where they are; a group that isn't whole and in order is an error. A task holds one
    Arrow batch and at most one unfinished group at a time."""
    out, schema = list(out), df.select(*out).schema

    def done(rows: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        of = {c: (rows[c].fill_null(0).to_numpy(), rows[c].is_valid().to_numpy()) for c in (index, "_grp", "_n", *needs)}
        i, g, n = (of[c][0] for c in (index, "_grp", "_n"))
        ends, g0 = np.append(starts[1:], len(i)) - 1, g[starts]
        if (i[starts] != np.maximum(g0 * width - halo, 0)).any() or (i[ends] != np.minimum((g0 + 1) * width + halo, n[starts]) - 1).any():
            raise ValueError(f"rows of the groups aren't whole and in the order of {index}")
        new = {c: pa.array(v, mask=~known) for c, (v, known) in fn(of, starts).items()}
        yield from pa.table([new[c] if c in new else rows[c] for c in out], names=out).filter(pa.array(i // width == g)).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows]).combine_chunks()
            if not rows.num_rows:
                continue
            # a group begins at or before its first own row, the one before it in the task ends at or after one
            i, g = rows[index].to_numpy(), rows["_grp"].to_numpy()
            starts = np.append(0, np.flatnonzero((np.diff(i) != 1) | (np.diff(g) != 0)) + 1)
            last = int(starts[-1])
            if last:
                yield from done(rows.slice(0, last), starts[:-1])
            held = rows.slice(last)
        if held is not None:
            yield from done(held, np.array([0]))

    return df.mapInArrow(run, schema)
