"""Benchmark decontamination by SimHash of item-sized windows.

Words and shingles are those of ``shingles``; a shingle weighs as many as its
words have bytes, so that runs of short words say less. Every item and every
window of as many words as some item has gets a 64-bit SimHash. Fingerprints are
cut into ``radius + 1`` blocks: two within the radius agree on a block at least,
so a join on (size, block, value) finds all pairs within it. The pairs found
are compared exactly: cosine of the weighted shingle sets, ``similarity`` or more.

A window can't reach a similarity s with an item unless shingles of items of
its size hold s*s of its squared weight. That bound, tested against a fixed-size
bit map of the items' shingles, spares the windows that hold too few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.llm import shingles as S
from kinespark.session import materialise

SIMILARITY, RADIUS = 0.8, 20
#: The bit map has 2**MAP_BITS bits (2 MB), whatever the size of the benchmark.
MAP_BITS = 24


def _signs(s: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(S.mix(s + np.uint64(0x51ED27)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.float64) * 2 - 1


def _pack(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">i8").ravel()


def _weighted(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Per text: its shingles in order, their weights, its words."""
    for run in S.batches(texts):
        digest, size, bounds = S.words(run)
        s, n = S.shingle_at(digest, bounds), S.places(bounds)
        heavy = np.concatenate([[0], np.cumsum(size)])
        for b, c, words in zip(bounds, n, np.diff(bounds)):
            i = np.arange(b, b + c)
            yield s[b:b + c], (heavy[np.minimum(i + S.K, b + words)] - heavy[i]).astype(np.float64), int(words)


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, fingerprint, shingles, weights); items without words can't be found."""

    def run(batches):
        for b in batches:
            rows = []
            for item, (s, w, n) in zip(b["item_id"], _weighted(list(b["text"]))):
                if n:
                    u, at = np.unique(s, return_index=True)
                    rows.append((item, n, int(_pack((_signs(u) * w[at, None]).sum(0)[None])[0]), u.view(np.int64), w[at]))
            yield pd.DataFrame(rows, columns=["item_id", "words", "fingerprint", "shingles", "weights"])

    t = benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).where("item_id IS NOT NULL")
    return t.mapInPandas(run, "item_id long, words int, fingerprint long, shingles array<long>, weights array<double>")


def _slot(s: np.ndarray, words: int) -> np.ndarray:
    return (S.mix(s + np.uint64(words * 0x9E37)) >> np.uint64(64 - MAP_BITS)).astype(np.int64)


def _map_of(items: DataFrame) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bit maps of (shingle) and (shingle, size), and the sizes. What reaches the driver
    is bounded by the map: at most 2**MAP_BITS / 64 numbers each."""

    def run(batches):
        for b in batches:
            for n, s in zip(b["words"], b["shingles"]):
                s = np.asarray(s, np.int64).view(np.uint64)
                for kind, slot in ((0, _slot(s, 0)), (1, _slot(s, n))):
                    yield pd.DataFrame({"kind": kind, "place": slot >> 6, "bit": np.left_shift(np.int64(1), slot & 63)})

    rows = items.mapInPandas(run, "kind int, place long, bit long").groupBy("kind", "place").agg(F.bit_or("bit").alias("bits")).toPandas()
    maps = []
    for kind in (0, 1):
        m = np.zeros(1 << MAP_BITS >> 6, np.int64)
        some = rows[rows["kind"] == kind]
        m[some["place"].to_numpy(np.int64)] = some["bits"].to_numpy(np.int64)
        maps.append(np.unpackbits(m.astype("<i8").view(np.uint8), bitorder="little").astype(bool))
    return maps[0], maps[1], sorted(r[0] for r in items.select("words").distinct().collect())


def windows_of(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(window, row, words, place, fingerprint, shingles, weights) of the windows that pass the bound.

    ``docs`` has row and text. A text shorter than an item is one window for it."""
    spark = docs.sparkSession
    shared, sized, sizes = _map_of(items)
    held = spark.sparkContext.broadcast((np.packbits(shared), np.packbits(sized), sizes))  # 4 MB and the sizes

    def of_text(s, w, n, shared, sized, sizes):
        hit = np.flatnonzero(shared[_slot(s, 0)])
        if not len(hit):
            return
        _, inverse, times = np.unique(s, return_inverse=True, return_counts=True)
        lone = times[inverse] == 1
        square = w * w
        for m in sizes:
            own = np.zeros(len(s), bool)
            own[hit] = sized[_slot(s[hit], m)]
            if not own.any():
                continue
            span = max(1, min(m, n) - S.K + 1) if n >= S.K else 1
            inside = np.concatenate([[0], np.cumsum(np.where(own, square, 0))])
            outside = np.concatenate([[0], np.cumsum(np.where(~own & lone, square, 0))])
            at = np.arange(len(s) - span + 1)
            h, q = inside[at + span] - inside[at], outside[at + span] - outside[at]
            at = at[(h > 0) & (h * (1 - similarity ** 2) >= q * similarity ** 2 - 1e-9)]
            for i in at:
                u, first = np.unique(s[i:i + span], return_index=True)
                v = w[i:i + span][first]
                yield m, int(i), int(_pack((_signs(u) * v[:, None]).sum(0)[None])[0]), u.view(np.int64), v

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        one, two, sizes = held.value
        shared, sized = np.unpackbits(one).astype(bool), np.unpackbits(two).astype(bool)
        k = TaskContext.get().partitionId() << 36
        for b in batches:
            rows = []
            for row, (s, w, n) in zip(b["row"], _weighted(list(b["text"]))):
                for x in of_text(s, w, n, shared, sized, sizes):
                    rows.append((k, row, *x))
                    k += 1
                if len(rows) >= 4096:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    names = ["window", "row", "words", "place", "fingerprint", "shingles", "weights"]
    return docs.mapInPandas(run, "window long, row long, words int, place int, fingerprint long, shingles array<long>, weights array<double>")


def _blocks(fingerprint, radius: int):
    """(block, value) of radius + 1 blocks that cover the 64 bits."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("value"))
        for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]))


def matches(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(row, item_id, place, words, similarity): the best window of each row and item that reaches ``similarity``.

    ``docs`` has row (unique) and text. Texts and items without words match nothing."""

    @F.pandas_udf("double")
    def cosine(a: pd.Series, u: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
        out = []
        for s, w, t, x in zip(a, u, b, v):
            _, i, _ = np.intersect1d(np.asarray(s, np.int64), np.asarray(t, np.int64), assume_unique=True, return_indices=True)
            w, x = np.asarray(w), np.asarray(x)
            out.append((w[i] ** 2).sum() / np.sqrt((w ** 2).sum() * (x ** 2).sum()))
        return pd.Series(out)

    items = materialise(items_of(benchmark), "items")
    windows = materialise(windows_of(docs, items, similarity), "windows")
    prints = windows.select("words", "fingerprint").distinct()  # copies of a passage share theirs
    left = prints.select("words", "fingerprint", _blocks(F.col("fingerprint"), radius).alias("b")).select("words", "fingerprint", "b.*")
    right = items.select("item_id", "words", F.col("fingerprint").alias("other"), _blocks(F.col("fingerprint"), radius).alias("b")).select("item_id", "words", "other", "b.*")
    near = left.join(right, ["words", "block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("other"))) <= radius).select(
        "words", "fingerprint", "item_id").distinct()
    whole = items.select("item_id", F.col("words").alias("w2"), F.col("shingles").alias("s2"), F.col("weights").alias("v2"))
    found = (
        windows.join(near, ["words", "fingerprint"]).join(whole, "item_id").where("words = w2")
        .withColumn("similarity", cosine("shingles", "weights", "s2", "v2")).where(F.col("similarity") >= similarity - 1e-12)
    )
    return found.groupBy("row", "item_id").agg(F.max(F.struct("similarity", (-F.col("place")).alias("back"), "words")).alias("best")).select(
        "row", "item_id", (-F.col("best.back")).alias("place"), "best.words", "best.similarity")


def leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """(doc_id, item_id, place, words, similarity): each item found in each document.

    Null texts hold nothing; null ids stay null and count as one document, as rows
    that repeat an id do; items with a repeated id count as one; other columns aren't read."""
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("~")))
    t = docs.select(key.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = matches(t, benchmark, **how)
    return found.join(docs.select(key.alias("row"), "doc_id").distinct(), "row").select("doc_id", "item_id", "place", "words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """Rows of ``docs`` that hold no item. Rows are judged by their text, so that a
    leaking row doesn't take others of its id with it."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = materialise(matches(docs.select(key.alias("row"), F.coalesce("text", F.lit("")).alias("text")), benchmark, **how).select(
        F.col("row").alias("_leak")).distinct(), "leaks")
    return docs.join(found, key == F.col("_leak"), "left_anti")
