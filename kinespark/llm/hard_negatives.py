"""Hard negatives: candidates of another label that score just below a positive.

Candidates are cut into blocks of bounded size along (label, digest of the id), and
each block becomes a cover tree (``cover_tree``), written once. Queries go to the
blocks that may hold their answers and are searched there block by block; what each
block returns is merged by score and id. First the blocks of a query's own label
give its positives, then the blocks with other labels give the negatives in the
score window of each positive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinespark.llm.cover_tree import BLOCK, LIMIT, NONE, CoverTree
from kinespark.session import materialise

#: Queries searched at once.
PACK = 256


def usable(rows: DataFrame, vec_id: str, label: Column, vector: str, scale: int) -> DataFrame:
    """(id, label, vec) of rows that take part, components as floor(scale * x); one row an id."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = rows.where(F.col(vec_id).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()).where(whole).select(
        F.col(vec_id).cast("long").alias("id"), label.cast("long").alias("label"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))
    return out.groupBy("id").agg(F.min(F.struct("label", "vec")).alias("r")).select("id", "r.label", "r.vec")


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows of ``width`` components, shorter vectors filled up with 0."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def blocks(rows: DataFrame) -> DataFrame:
    """(block, labels, tree): cover trees over ``rows`` (id, label, vec), at most BLOCK points each.

    Rows are dealt by ranges of (label, digest), so that a frequent label spreads over
    many tasks; a task cuts its rows into blocks as they come."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("at", F.xxhash64("id")).repartitionByRange(parts, "label", "at").sortWithinPartitions("label", "at")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def block(b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values("id", kind="stable")
            tree = CoverTree(b["id"].to_numpy(), b["label"].to_numpy(), _matrix(list(b["vec"]), max(map(len, b["vec"]))))
            return pd.DataFrame({"block": [part + parts * made], "labels": [sorted(set(b["label"]))], "tree": [tree.dump()]})

        for b in batches:
            held.append(b)
            size += len(b)
            while size >= BLOCK:
                b = pd.concat(held, ignore_index=True)
                yield block(b.iloc[:BLOCK])
                made, held, size = made + 1, [b.iloc[BLOCK:]], size - BLOCK
        if size:
            yield block(pd.concat(held, ignore_index=True))

    return materialise(dealt.select("id", "label", "vec").mapInPandas(build, "block long, labels array<long>, tree binary"), "cover-trees")


def search(trees: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(id, hit, score): for each row of ``asked`` (block, id, label, vec, low, high) the points of the
    block that are among the k best of one of its windows [low, high] (arrays)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, tree = None, None
        for b in batches:
            for start in range(0, len(b), PACK):
                for at, part in b.iloc[start:start + PACK].groupby("block", sort=False):
                    blob = part["tree"].dropna()
                    if len(blob):  # it comes before its block's queries
                        block, tree = at, CoverTree.load(blob.iloc[0])
                    part = part[part["id"].notna()]
                    if not len(part) or block != at:
                        continue
                    width = max(tree.vectors.shape[1], *map(len, part["vec"])) if len(part) else 0
                    n = max(map(len, part["low"]))
                    low, high = np.ones((len(part), n), np.int64), np.zeros((len(part), n), np.int64)
                    for i, (x, y) in enumerate(zip(part["low"], part["high"])):
                        low[i, :len(x)], high[i, :len(y)] = x, y
                    own = part["id"].to_numpy(np.int64)
                    best = tree.search(_matrix(list(part["vec"]), width)[:, :tree.vectors.shape[1]], part["label"].to_numpy(np.int64), same, own, low, high, k)
                    for i, found in enumerate(best):
                        found = np.unique(found[found != NONE])
                        if len(found):
                            score, hit = tree.read(found)
                            yield pd.DataFrame({"id": own[i], "hit": hit, "score": score})

    none = lambda kind: F.lit(None).cast(kind)
    first = trees.select("block", none("long").alias("id"), none("long").alias("label"), none("array<long>").alias("vec"), none("array<long>").alias("low"),
                         none("array<long>").alias("high"), "tree")
    rows = asked.select("block", "id", "label", "vec", "low", "high", none("binary").alias("tree"))
    dealt = first.unionByName(rows).repartition("block").sortWithinPartitions("block", F.col("id").asc_nulls_first())
    return dealt.mapInPandas(run, "id long, hit long, score long")


def mine(
    rows: DataFrame, anchors: Column, vec_id: str = "vec_id", label: str | Column = "label", vector: str = "embedding", scale: int = 256, positives: int = 5,
    negatives: int = 5, share: int = 80,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` tells by id which rows are anchors. Positives are an anchor's best rows of
    its label; negatives the best rows of other labels that score at least ``share``
    percent of a positive and at most as much. Higher scores come first, ties by
    smaller id. Rows with a null id, label, vector or component, or a component that
    isn't finite, take no part; of rows with one id the least (label, vector) does;
    a shorter vector counts as filled up with zeros. An empty table gives no rows.
    Other columns aren't read. Scores of 2**49 and more are an error."""
    label = F.col(label) if isinstance(label, str) else label
    table = materialise(usable(rows, vec_id, label, vector, scale), "vectors")
    trees = blocks(table)
    queries = table.where(anchors)
    # positives: the blocks that hold the label
    wide = [F.array(F.lit(v).cast("long")) for v in (1 - LIMIT, LIMIT - 1)]
    at = trees.select("block", F.explode("labels").alias("label"))
    asked = queries.join(at, "label").select("block", "id", "label", "vec", wide[0].alias("low"), wide[1].alias("high"))
    best = W.partitionBy("id").orderBy(F.col("score").desc(), "hit")
    near = materialise(search(trees, asked, True, positives).withColumn("place", F.row_number().over(best)).where(F.col("place") <= positives), "positives")
    # negatives: every block with another label
    window = near.groupBy("id").agg(F.sort_array(F.collect_set("score")).alias("high"))
    low = F.transform("high", lambda p: ((share * p + F.pmod(-share * p, F.lit(100))) / 100).cast("long"))  # rounded up
    last = trees.agg(F.max("block")).first()[0]
    spread = queries.join(window, "id").select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last or 0).cast("long"))).alias("block"), "id", "label", "vec", low.alias("low"), "high")
    other = trees.select("block", F.when(F.size("labels") == 1, F.col("labels")[0]).alias("only"))
    asked = spread.join(other, "block").where(~F.col("label").eqNullSafe(F.col("only")))
    far = materialise(search(trees, asked, False, negatives), "negatives")
    pairs = near.select("id", "place", F.col("hit").alias("positive_id"), F.col("score").alias("p")).join(
        far.select("id", F.col("hit").alias("negative_id"), F.col("score").alias("s")), "id").where((share * F.col("p") <= 100 * F.col("s")) & (F.col("s") <= F.col("p")))
    rank = F.row_number().over(W.partitionBy("id", "place").orderBy(F.col("s").desc(), "negative_id"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        F.col("id").alias("anchor_id"), "positive_id", "rank", "negative_id", F.col("p").alias("positive_score"), F.col("s").alias("negative_score"))
