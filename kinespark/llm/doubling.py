"""Repeated passages by level-wise doubling.

A passage of ``length`` words is repeated only if every shorter window inside it is.
Levels double their window up to ``length`` (9, 18, 35). At each level a passage is
judged by one window of that many words inside it: the one with the least digest, so
that equal passages choose equal windows. Windows that occur once alone are counted
out with all passages that chose them; what survives is extended to the next level,
until nothing survives or the whole passage is the window, which is then exact.

Counting needs no join: a digest that occurs once has just one holder, so its
grouped row itself tells whom it rules out. Frequent windows are summed before the
shuffle, and no group of holders is ever gathered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kinespark.llm import shingles as S
from kinespark.session import discard, materialise

LENGTH, SHORTEST = 35, 9
#: Passages a piece holds; an address is ``piece << 20 | first << 8 | passages - 1``.
PIECE = 4096
_RNG = np.random.default_rng(4_711)
_COEF = _RNG.integers(1, 1 << 63, (2, 4096), dtype=np.uint64) | np.uint64(1)


def levels(length: int) -> list[int]:
    """Window lengths, each at most twice the one before; the first about SHORTEST."""
    out = [length]
    while out[0] > SHORTEST:
        out.insert(0, -(-out[0] // 2))
    return out


def text_words(text: str) -> np.ndarray:
    """Digests of a text's words; a very long text is read in pieces that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = at + S.STEP
        while end < len(text) and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        out.append(S.words([text[at:end]], fold=False)[0])
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def all_words(texts: list[str]) -> Iterator[np.ndarray]:
    """Digests of the words of each text."""
    for run in S.batches(texts):
        if len(run[0]) > S.STEP:  # it stands alone
            yield text_words(run[0])
        else:
            digest, _, bounds = S.words(run, fold=False)
            yield from np.split(digest, bounds[1:-1])


def windows(d: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Digest of the ``size`` words from each place on, by doubling: a window is its two halves."""
    if size == 1:
        return S.mix(d * _COEF[which, 0])
    half = -(-size // 2)
    h = windows(d, half, which)
    n = len(d) - size + 1
    return S.mix(h[:n] * _COEF[which, size % 4096] + S.mix(h[size - half:size - half + n] ^ _COEF[which, half % 4096]))


def chosen(h: np.ndarray, span: int) -> np.ndarray:
    """Place of the least (leftmost) of the ``span`` values from each place on."""
    at, value, width = np.arange(len(h)), h, 1
    while width < span:
        step = min(width, span - width)
        n = len(value) - step
        right = value[step:] < value[:n]
        at, value = np.where(right, at[step:], at[:n]), np.where(right, value[step:], value[:n])
        width += step
    return at


def votes(d: np.ndarray, size: int, length: int, which: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the passages of words ``d``: digests of the windows they choose, the first
    passage of each choice and how many passages make it."""
    h = windows(d, size, which)
    at = chosen(h, length - size + 1)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return h[at[first]], first, np.diff(np.append(first, len(at)))


def _alone(seen: DataFrame, keys: list[str], address: list[str]) -> DataFrame:
    """Addresses of the rows whose keys occur once."""
    least = [F.min(c).alias(c) for c in address]  # of a single row
    return seen.groupBy(*keys).agg(F.count("*").alias("_n"), *least).where("_n = 1").select(*address)


def _ruled_out(alone: DataFrame, keys: list[str]) -> DataFrame:
    return alone.groupBy(*keys).agg(F.collect_list("range").alias("out"))


def _survivors(n: int, out) -> np.ndarray:
    """Which of n passages are in none of the ranges (first << 8 | passages - 1)."""
    edge = np.zeros(n + 1, np.int64)
    if out is not None and len(out):
        x = np.asarray(out, np.int64)
        np.add.at(edge, x >> 8, 1)
        np.add.at(edge, (x >> 8) + (x & 255) + 1, -1)
    return np.cumsum(edge[:-1]) == 0


def _runs(good: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], good.view(np.int8), [0]])))
    return list(zip(edge[::2], edge[1::2]))


def _address() -> tuple[Column, Column]:
    """96 bits that tell rows of different id or text apart; rows alike repeat each other anyway."""
    return F.xxhash64("doc_id", "text"), F.shiftright(F.xxhash64("text", "doc_id"), 32).cast("int")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(a, b, runs): word ranges [start, end) of each text that repeated passages cover;
    ``a`` and ``b`` as in ``_address``."""
    if not 2 <= length <= 256:
        raise ValueError("passages of 2 to 256 words")
    sizes = levels(length)
    # a text of fewer characters has too few words
    a, b = _address()
    texts = docs.where(F.length("text") >= 2 * length - 1).select(a.alias("a"), b.alias("b"), "text")

    def first_level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = zip(f["a"], f["b"], all_words(list(f["text"])))
            held, size = [], 0
            for a, b, d in rows:
                if len(d) >= length:
                    h, first, n = votes(d, sizes[0], length)
                    held.append((h.view(np.int64), np.full(len(h), a), np.full(len(h), b), (first << 8) + n - 1))
                    size += len(h)
                if size > 100_000:
                    yield pd.DataFrame(dict(zip(["digest", "a", "b", "range"], map(np.concatenate, zip(*held)))))
                    held, size = [], 0
            if held:
                yield pd.DataFrame(dict(zip(["digest", "a", "b", "range"], map(np.concatenate, zip(*held)))))

    seen = texts.mapInPandas(first_level, "digest long, a long, b int, range long")
    out = _ruled_out(_alone(seen, ["digest"], ["a", "b", "range"]), ["a", "b"])

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made = TaskContext.get().partitionId(), 0
        for f in batches:
            rows = []
            for a, b, ranges, d in zip(f["a"], f["b"], f["out"], all_words(list(f["text"]))):
                if len(d) < length:
                    continue
                for start, end in _runs(_survivors(len(d) - length + 1, ranges)):
                    for at in range(start, end, PIECE):
                        to = min(end, at + PIECE)
                        rows.append(((part << 26) + made, a, b, at, to - at, d[at:to + length - 1].view(np.int64)))
                        made += 1
            if rows:
                yield pd.DataFrame(rows, columns=["piece", "a", "b", "start", "n", "words"])

    pieces = materialise(texts.join(out, ["a", "b"], "left").mapInPandas(extend, "piece long, a long, b int, start long, n int, words array<long>"), "pieces")
    rejected = None
    for size in sizes[1:] or sizes:
        last = size == length

        def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in batches:
                held = []
                for piece, words, ranges in zip(f["piece"], f["words"], f["out"]):
                    d = np.asarray(words, np.int64).view(np.uint64)
                    h, first, n = votes(d, size, length)
                    good = np.add.reduceat(_survivors(len(d) - length + 1, ranges), first) > 0  # some passage of the choice is still in
                    second = windows(d, length, 1)[first] if last else h
                    held.append((h[good].view(np.int64), (second[good] >> np.uint64(32)).astype(np.uint32).view(np.int32), (piece << 20) + (first[good] << 8) + n[good] - 1))
                if held:
                    yield pd.DataFrame(dict(zip(["digest", "more", "address"], map(np.concatenate, zip(*held)))))

        rows = pieces.select("piece", "words")
        rows = rows.join(rejected, "piece", "left") if rejected is not None else rows.withColumn("out", F.lit(None).cast("array<long>"))
        seen = rows.mapInPandas(level, "digest long, more int, address long")
        alone = _alone(seen, ["digest", "more"], ["address"]).select(F.shiftright("address", 20).alias("piece"), F.col("address").bitwiseAND((1 << 20) - 1).alias("range"))
        if rejected is not None:
            alone = alone.unionByName(rejected.select("piece", F.explode("out").alias("range")))
        rejected = materialise(_ruled_out(alone, ["piece"]), "ruled-out")

    def covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            rows = [(a, b, int(start + x), int(start + y + length - 1)) for a, b, start, n, out in zip(f["a"], f["b"], f["start"], f["n"], f["out"])
                    for x, y in _runs(_survivors(n, out))]
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b", "start", "end"])

    spans = pieces.select("piece", "a", "b", "start", "n").join(rejected, "piece", "left").drop("piece").mapInPandas(covered, "a long, b int, start long, end long")
    runs = materialise(spans.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("runs")), "runs")
    discard(pieces, rejected)
    return runs


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text``: the words that no
    repeated passage covers, joined by one space.

    Every copy of a passage goes, the first one too. Null and empty texts have no
    words and an empty ``kept_text``; repeated rows repeat each other; rows with a
    null id are treated like any other; an empty table gives no rows; columns of
    ``docs`` with the names of the new ones are replaced."""
    runs = repeated_runs(docs, length)
    kept = docs.drop("n_words", "n_removed", "kept_text")
    row = F.struct(*[F.col(c) for c in kept.columns])
    keyed = kept.select(row.alias("row"), F.coalesce("text", F.lit("")).alias("text"), *[c.alias(n) for c, n in zip(_address(), "ab")])
    return keyed.join(runs, ["a", "b"], "left").select("row", _without("text", "runs").alias("r")).select("row.*", "r.*")


@F.pandas_udf(StructType([StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())]))
def _without(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
    rows = []
    for text, ranges in zip(texts, runs):
        words = text.encode("utf-8", "replace").split()  # bytes split at the six ASCII white-space characters
        gone = np.zeros(len(words), bool)
        for r in ranges if ranges is not None else ():
            gone[r["start"]:r["end"]] = True
        left = b" ".join([w for w, x in zip(words, gone) if not x])
        rows.append((len(words), int(gone.sum()), left.decode()))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_text"])
