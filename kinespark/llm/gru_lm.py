"""Scoring documents with a recurrent language model and corpus counts.

Counts of all words of all training documents are gathered first. The
``VOCABULARY`` commonest words are the recurrent model's own; any other word is
the model's "other" times its share of the other words' counts, so rare words,
however many, need no weights. The model is trained by truncated
backpropagation in every partition on the documents of a round, by digest of
their ids, and the partitions' weights are averaged by tokens; each round begins
with the last one's average.

A text is scored whole, its state carried from window to window. Counts of the
``KNOWN`` commonest words, a fixed number, go to the tasks; the others are looked
up by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm import gru
from kinespark.session import materialise

VOCABULARY, KNOWN = 2047, 200_000
#: Rounds of the one pass over all training documents; each teaches in one of them.
ROUNDS = 4
#: Documents whose ids a task holds at once, as long as their words are no more than this.
POOL, POOL_WORDS = 65_536, 4_000_000
#: Bytes of text that are cut into words at once, one document at least; distinct words a task sums up before it sends them.
SLICE, SUMMED = 8 << 20, 500_000


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the batches, so many at once that their texts are about ``SLICE`` bytes."""
    for b in batches:
        part = np.cumsum(pc.binary_length(b["text"]).to_numpy(zero_copy_only=False), dtype=np.int64) // SLICE
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        yield from (b.slice(i, j - i) for i, j in zip(cuts, cuts[1:]) if j > i)


def _words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, as binary, and how many each text has."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat, ends = cut.flatten(), np.cumsum(pc.list_value_length(cut).to_numpy(zero_copy_only=False))
    full = pc.greater(pc.binary_length(flat), 0)  # there is an empty one where a text begins or ends with white space
    sums = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    return flat.filter(full).cast(pa.binary()), np.diff(sums[ends], prepend=0)


def counts(training: DataFrame) -> DataFrame:
    """(word, c) of all words of ``text``; tasks send sums, not words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rows = [], 0
        for b in _slices(batches):
            word, c = pc.value_counts(_words(b["text"])[0]).flatten()
            seen.append(pa.table({"word": word, "c": c}))
            rows += len(word)
            if rows > SUMMED:
                seen = [pa.concat_tables(seen).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])]
                rows = len(seen[0])
            if rows > SUMMED:
                yield from seen[0].to_batches()
                seen, rows = [], 0
        for t in seen:
            yield from t.to_batches()

    return training.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _ranks(words: pa.Array, table: pa.Array) -> np.ndarray:
    """Places of words in ``table``; -1 for a word that isn't there."""
    return pc.index_in(words, value_set=table).fill_null(-1).to_numpy(zero_copy_only=False)


def _own_ids(rank: np.ndarray, n: np.ndarray, own: int, other: int) -> list[np.ndarray]:
    """Ids of each document with its end: 0 the end, 1 .. own words, ``other`` the rest."""
    ids = np.zeros(len(rank) + len(n), np.int32)
    ids[np.arange(len(rank)) + np.repeat(np.arange(len(n)), n)] = np.where((rank < 0) | (rank >= own), other, rank + 1)
    return np.split(ids, np.cumsum(n + 1)[:-1])


class Corpus:
    """What training documents tell: the counts, N, V, and the commonest words."""

    def __init__(self, training: DataFrame, vocabulary: int = VOCABULARY, known: int = KNOWN):
        self.counts = materialise(counts(training), "word-counts")
        self.ends = training.count()
        total = self.counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.distinct = total["n"] + self.ends, total["v"] + (self.ends > 0)
        top = self._commonest(known)
        self.words = pa.array([bytes(w) for w in top["word"]], pa.binary())
        self.known = top["c"].to_numpy(np.int64) if len(top) else np.zeros(0, np.int64)
        self.own = min(vocabulary, len(self.words))
        #: ids of the recurrent model: the end, its own words, unused ones; then "other"
        self.size = -(-(self.own + 1) // gru.SPAN) * gru.SPAN
        own = np.concatenate([[self.ends], self.known[:self.own]])
        self.other_tokens, self.other_words = int(self.tokens - own.sum()), int(self.distinct - (self.ends > 0) - self.own)
        self.start = gru.init(np.concatenate([own, np.full(self.size - len(own), -0.5)]), self.other_tokens)

    def _commonest(self, known: int) -> pd.DataFrame:
        """At most ``known`` words, the commonest first: those above a count found from a
        small histogram, so that no task sends more than it has of them."""
        step = F.floor(F.log2("c") * 16).cast("int")
        tally = sorted(((r["s"], r["count"]) for r in self.counts.groupBy(step.alias("s")).count().collect()), reverse=True)  # a row a step
        least, n = 1 << 20, 0
        for s, k in tally:
            if n + k > known:
                break
            least, n = s, n + k
        return self.counts.where(step >= F.lit(least)).toPandas().sort_values(["c", "word"], ascending=[False, True])


def train(training: DataFrame, corpus: Corpus, rounds: int = ROUNDS) -> gru.Params:
    """Weights after one pass over ``training`` (doc_id, text) in ``rounds`` rounds."""
    spark, model, like = training.sparkSession, corpus.start, corpus.start
    words, own, other = corpus.words[:corpus.own], corpus.own, corpus.size
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for r in range(rounds):
        held = spark.sparkContext.broadcast((gru.pack(model), words))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            data, words = held.value
            trainer, docs, size = gru.Trainer(gru.unpack(data, like)), [], 0
            for b in _slices(batches):
                found, n = _words(b["text"])
                docs += _own_ids(_ranks(found, words), n, own, other)
                size += len(found)
                if len(docs) >= POOL or size >= POOL_WORDS:
                    gru.train(trainer, docs)
                    docs, size = [], 0
            gru.train(trainer, docs)
            if trainer.tokens:
                yield pa.RecordBatch.from_pydict({"salt": pa.array([TaskContext.get().partitionId() % 16], pa.int32()), "tokens": [trainer.tokens], "weights": [gru.pack(trainer.p)]})

        def average(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, tokens = None, 0
            for b in batches:
                for t, w in zip(b["tokens"], b["weights"]):
                    x = np.frombuffer(w, np.float32) * np.float64(t)
                    total, tokens = x if total is None else total + x, tokens + t
            if tokens:
                yield pd.DataFrame({"salt": [0], "tokens": [tokens], "weights": [(total / tokens).astype(np.float32).tobytes()]})

        shape = "salt int, tokens long, weights binary"
        share = training.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == r).select("text")
        means = list(average([share.mapInArrow(run, shape).repartition(min(n, 16), "salt").mapInPandas(average, shape).toPandas()]))  # 16 rows at most
        if means:
            model = gru.unpack(means[0]["weights"][0], like)
        held.unpersist()
    return model


def score(docs: DataFrame, **how) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Null texts count as empty (their end alone); null ids count as empty texts for the
    fold; repeated rows are scored alike and train as often as they occur; other
    columns aren't read. Without training documents every count is 0."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    training = docs.where(~F.col("held_out"))
    corpus = Corpus(training, **how)
    model = train(training, corpus)
    own, other, ends_seen = corpus.own, corpus.size, corpus.ends
    base_of = math.log10(corpus.tokens + corpus.distinct + 1)
    other_of = math.log10(corpus.other_tokens + corpus.other_words + 1)
    like = corpus.start
    held = spark.sparkContext.broadcast((gru.pack(model), corpus.words, corpus.known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, words, known = held.value
        p, logs = gru.unpack(data, like), np.append(np.log10(known + 1.0), 0.0)  # a rank of -1 finds the 0
        over = np.append(np.where(np.arange(len(known)) < own, 0.0, logs[:-1] - other_of), -other_of)  # what a word adds to the model's score
        row0 = TaskContext.get().partitionId() << 36

        def frame(rows, **columns):
            return pa.RecordBatch.from_arrays([rows, *(columns[f.name] if f.name in columns else pa.nulls(len(rows), f.type) for f in fields)], ["row", *(f.name for f in fields)])

        def scored(parts, docs, first):
            n, has, base, more = (np.concatenate([x[k] for x in parts]) for k in range(1, 5))
            return frame(pa.array(np.arange(first, first + len(docs))), n_tokens=pa.array(n + 1, pa.int64()), n_known=pa.array(has.astype(np.int64) + (ends_seen > 0)),
                         doc_id=pa.concat_arrays([x[0]["doc_id"].cast(pa.int64()) for x in parts]), held_out=pa.concat_arrays([x[0]["held_out"] for x in parts]),
                         base=pa.array(base + math.log10(ends_seen + 1) - (n + 1) * base_of), score=pa.array(gru.score(p, docs) / math.log(10) + more))

        parts, docs, size = [], [], 0
        for b in _slices(batches):
            found, n = _words(b["text"])
            rank, doc = _ranks(found, words), np.repeat(np.arange(len(n)), n)
            sums = lambda x: np.bincount(doc, x, len(n))
            rare = np.flatnonzero(rank < 0)
            if len(rare):
                each = pa.table({"row": row0 + len(docs) + doc[rare], "word": found.take(pa.array(rare))}).group_by(["row", "word"]).aggregate([([], "count_all")])
                yield from (frame(t["row"], word=t["word"], times=t["count_all"]) for t in each.to_batches())
            parts.append((b.select(["doc_id", "held_out"]), n, sums(rank >= 0), sums(logs[rank]), sums(over[rank])))
            docs += _own_ids(rank, n, own, other)
            size += len(found)
            if len(docs) >= POOL or size >= POOL_WORDS:
                yield scored(parts, docs, row0)
                row0 += len(docs)
                parts, docs, size = [], [], 0
        if docs:
            yield scored(parts, docs, row0)

    fields = [pa.field("doc_id", pa.int64()), pa.field("held_out", pa.bool_()), pa.field("n_tokens", pa.int64()), pa.field("n_known", pa.int64()),
              pa.field("base", pa.float64()), pa.field("score", pa.float64()), pa.field("word", pa.binary()), pa.field("times", pa.int64())]
    shape = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, times long"
    parts = materialise(docs.mapInArrow(run, shape), "scores")
    # words beyond the commonest: each adds its log10(c + 1) to both sums
    rare = parts.where("word IS NOT NULL").select("word", "row", "times").join(corpus.counts, "word").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return parts.where("n_tokens IS NOT NULL").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
