"""Jaccard self-join on word shingles with several global token orders.

A set of n shingles may have at most ``(100 - percent) n / 100`` (its slack) that a
partner lacks, so two partners share tokens among the first of each, whatever order
the tokens have. Three orders are intersected before any pair is compared:

* by digest, per document: of its first ``slack + 1 + extra`` tokens a document with
  a partner has several that another document's first tokens hold, too. Most
  documents have not and are dropped here; only these first tokens are shuffled.
* by rarity, per pair: the shingles of the others are counted exactly and ranked, the
  rarest first. Partners share a token, and at the first one that they share neither
  has left more tokens behind than its share of the differences.
* by two more digests, per pair: a token must be shared among the first under each.

What is left is compared exactly.

Components are wanted, so a pair is of use only if it joins two. Each token's holders
are first compared with one of them, the one with the fewest rarer tokens, and once
more with one of its largest component; after that all pairs of holders whose
components still differ are compared. Groups of copies are so compared a number of
times in proportion to their members, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinespark.llm import shingles as S
from kinespark.llm.components import components
from kinespark.session import discard, materialise

PERCENT = 80
#: Tokens beyond the slack that a document's first ones have at least, and rounds with hubs.
EXTRA, HUB_ROUNDS = 8, 2
_ORDERS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344), np.uint64(0xA4093822299F31D0))


def _slack(n: int, percent: int) -> int:
    """The most shingles of a set of n that a partner may lack."""
    return (100 - percent) * n // 100


def _first(n: int, percent: int) -> int:
    """How many tokens of a set of n are its first ones under the first order."""
    k = _slack(n, percent)
    return min(n, k + 1 + max(k // 2, EXTRA))


def _shared_least(n: int, percent: int) -> int:
    """How many of its first tokens a set of n shares at least with a partner's: of the two
    the one whose first tokens end earlier shares all but its slack; the smallest partner counts."""
    m = -(-percent * n // 100)
    return _first(m, percent) - _slack(m, percent)


def _lead(s: np.ndarray, order: int, keep: int) -> np.ndarray:
    """The first ``keep`` tokens under an order by digest."""
    return s[np.argpartition(S.mix(s ^ _ORDERS[order]), keep - 1)[:keep]] if 0 < keep < len(s) else s


def prefixes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, unit, n, least, tokens): ``unit`` stands for the text, ``tokens`` are its first ones
    under the first order, of which it shares ``least`` with a partner's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for texts in S.batches(list(b["text"])):
                sets = S.sets(texts)
                part = b.iloc[at:at + len(texts)]
                at += len(texts)
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").array, "unit": part["unit"].array, "n": [len(s) for s in sets],
                                    "least": [_shared_least(len(s), percent) for s in sets],
                                    "tokens": [_lead(s, 0, _first(len(s), percent)).view(np.int64) for s in sets]})

    return docs.mapInPandas(run, "doc_id long, unit long, n int, least int, tokens array<long>")


def _whole(texts: DataFrame, percent: int) -> DataFrame:
    """(unit, n, tokens, second, third): the whole set, and the low halves of its first tokens under the other orders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for run_of in S.batches(list(b["text"])):
                sets = S.sets(run_of)
                lead = lambda s, o: _lead(s, o, _slack(len(s), percent) + 1).view(np.int64).astype(np.int32)
                yield pd.DataFrame({"unit": b["unit"].iloc[at:at + len(run_of)].array, "n": [len(s) for s in sets], "tokens": [s.view(np.int64) for s in sets],
                                    "second": [lead(s, 1) for s in sets], "third": [lead(s, 2) for s in sets]})
                at += len(run_of)

    return texts.mapInPandas(run, "unit long, n int, tokens array<long>, second array<int>, third array<int>")


def _partnered(table: DataFrame) -> DataFrame:
    """Units that share enough of their first tokens with other units."""
    of = Window.partitionBy("token")
    posts = table.where("n > 0").select("unit", F.explode("tokens").alias("token"))
    shared = posts.withColumn("low", F.min("unit").over(of)).withColumn("high", F.max("unit").over(of)).where("low <> high")
    held = shared.select("token", "unit").distinct().groupBy("unit").agg(F.count("*").alias("held"))
    return table.select("unit", "least").distinct().join(held, "unit").where("held >= least").select("unit")


def _ranked(sets: DataFrame, percent: int) -> DataFrame:
    """(token, unit, n, i): tokens that two units hold, ``i`` of the unit's own tokens being rarer;
    only those that can be the first one shared with a partner."""
    by_unit = Window.partitionBy("unit")
    posts = sets.select("unit", "n", F.explode("tokens").alias("token"))
    shared = posts.withColumn("holders", F.count("*").over(Window.partitionBy("token"))).where("holders > 1")
    alone = F.col("n") - F.count("*").over(by_unit)
    placed = shared.select("token", "unit", "n", (F.row_number().over(by_unit.orderBy("holders", "token")) - 1 + alone).alias("i"))
    return placed.where(F.lit(100) * F.col("i") <= F.lit(100 - percent) * F.col("n")).select("token", "unit", "n", F.col("i").cast("int").alias("i"))


def _fits(percent: int, n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m can link if i and j of their tokens come before the first one shared."""
    return F.lit(100 + percent) * F.least(n - i, m - j) >= F.lit(percent) * (n + m)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of units that share a token under the other orders, too, and pass the exact test."""
    of = lambda side, *cols: sets.select(F.col("unit").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in cols])
    for cols, test in ((("second", "third"), F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b")),
                       (("n", "tokens"), F.expr(f"100 * both >= {percent} * (n_a + n_b - both)"))):
        rows = pairs.join(of("a", *cols), "a").join(of("b", *cols), "b")
        if "tokens" in cols:
            rows = rows.withColumn("both", F.size(F.array_intersect("tokens_a", "tokens_b")))
        pairs = materialise(rows.where(test).select("a", "b"), "pairs")
    return pairs


def _rooted(posts: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return posts.withColumn("root", F.col("unit"))
    return posts.join(roots, F.col("unit") == F.col("node"), "left").select(*posts.columns, F.coalesce("root", "unit").alias("root"))


def _to_hubs(posts: DataFrame, percent: int) -> DataFrame:
    """Every holder of a token with the token's hub, one of its commonest component, unless it is of that."""
    parts = posts.groupBy("token", "root").agg(F.count("*").alias("c"), F.min(F.struct("i", "unit", "n")).alias("hub"))
    hubs = parts.groupBy("token").agg(F.min(F.struct(-F.col("c"), "hub", "root")).alias("h"), F.count("*").alias("roots")).where("roots > 1").select(
        "token", F.col("h.root").alias("of"), F.col("h.hub.unit").alias("hub"), F.col("h.hub.n").alias("m"), F.col("h.hub.i").alias("j"))
    return posts.join(hubs, "token").where((F.col("root") != F.col("of")) & _fits(percent, F.col("n"), F.col("i"), F.col("m"), F.col("j"))).select(
        F.least("unit", "hub").alias("a"), F.greatest("unit", "hub").alias("b")).distinct()


def _still_apart(posts: DataFrame, percent: int) -> DataFrame:
    """All pairs of holders of a token that are of different components. The commonest
    component of a token isn't paired within itself."""
    tally = posts.groupBy("token", "root").count().groupBy("token").agg(F.max(F.struct("count", "root"))["root"].alias("common"), F.count("*").alias("roots"))
    of = posts.join(tally.where("roots > 1").select("token", "common"), "token")
    other = of.select("token", *[F.col(c).alias(f"{c}_2") for c in ("unit", "n", "i", "root")])
    fits = _fits(percent, F.col("n"), F.col("i"), F.col("n_2"), F.col("i_2"))
    return of.where("root <> common").drop("common").join(other, "token").where((F.col("root") != F.col("root_2")) & fits).select(
        F.least("unit", "unit_2").alias("a"), F.greatest("unit", "unit_2").alias("b")).distinct()


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, unit, n, root: documents of one component have one root (a unit)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("unit", F.xxhash64("text"))
    table = materialise(prefixes(docs, percent), "prefixes")
    partnered = materialise(_partnered(table), "partnered")
    out = materialise(table.select("doc_id", "unit", F.col("n").cast("long").alias("n")), "sizes")
    discard(table)
    # one row a unit: copies of a text are compared once
    texts = docs.select("unit", "text").join(partnered, "unit", "left_semi").groupBy("unit").agg(F.min("text").alias("text"))
    sets = materialise(_whole(texts, percent), "sets")
    posts = materialise(_ranked(sets, percent), "postings")
    links = roots = None
    for step in [_to_hubs] * HUB_ROUNDS + [_still_apart]:
        pairs = materialise(step(_rooted(posts, roots), percent), "pairs")
        if not pairs.take(1):  # no token has holders of different components that can link
            continue
        more = _verified(pairs, sets, percent)
        if more.take(1):
            links = more if links is None else links.unionByName(more)
            roots = components(links)
        discard(pairs)
    discard(sets, posts, partnered)
    if roots is None:
        return out.withColumn("root", F.col("unit"))
    return out.join(roots, F.col("unit") == F.col("node"), "left").select("doc_id", "unit", "n", F.coalesce("root", "unit").alias("root"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Documents link when 100 * intersection >= percent * union of their 5-word shingle
    sets. Null texts and texts without words have no shingle and are alone; rows
    with the same text are in one component, repeated rows too; null ids count for
    no component's smallest id; other columns aren't read. Texts are told apart by
    a 64-bit digest."""
    rows = materialise(classes(docs, percent), "classes")
    least = rows.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, (rows["root"] == least["root"]) & (F.col("n") > 0), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The row of ``docs`` with the smallest id of each component (null ids last), ties
    by digest of the text; documents without words all stay, and of rows with equal id
    and text one does. Texts are shuffled once."""
    key = lambda unit: F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), unit)
    rows = materialise(classes(docs, percent), "classes")
    best = rows.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "unit")).alias("k")).select("k.doc_id", "k.unit")
    best = materialise(best.select(key(F.col("unit")).alias("_key")), "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    wordless = ~text.rlike(r"[^\x20\x09-\x0D]")
    hit = docs.where(~wordless).withColumn("_key", key(F.xxhash64(text))).join(best, "_key", "left_semi").dropDuplicates(["_key"])
    return hit.select(docs.columns).unionByName(docs.where(wordless))
