"""Spelling variants: words one edit apart, found by pivotal bigrams.

A word's bigrams are ordered by how rare they are over all words. The first three
occurrences are its prefix, and the two rarest of them that don't overlap are its
pivots: one edit spoils at most one pivot, so of two words one edit apart the one
whose prefix ends first in the order has a pivot in the other's prefix. A pivot that
is left alone has the edit on one side only: the other side, and the pivot's
position counted from its end, are the same in both words, as is one half of the
side with the edit. These join pivots to prefixes, so that words that share nothing
but a common bigram aren't paired. Candidates are verified by edit distance.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinespark.session import materialise

#: A-Z, a-z and the code points 192 to 255, as bytes of Latin-1.
LETTERS = rb"[a-z\xc0-\xff]"
LEAST_LENGTH, LEAST_COUNT, TIMES, SLIP = 6, 5, 5, 199
#: Words a task holds before it passes their counts on.
HELD = 200_000


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slip: int | None = SLIP) -> DataFrame:
    """(word, n): lower-cased letter runs of the texts and how often they occur.

    With ``slip``, a run loses the code point at h % length where ``slip`` divides
    h, the crc32 of ``<doc_id>:<run>`` (a null id is the empty string)."""
    # a run shorter than the least length stays too short when it loses a code point
    need = re.compile(LETTERS + b"{%d,}" % max(1, least_length))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()
        for b in batches:
            for d, text in zip(b["id"], b["text"]):
                # one byte a code point: whatever is beyond the alphabet becomes "?"; bytes.lower() touches A-Z only
                runs = need.findall(text.encode("latin-1", "replace").lower())
                held.update(runs)
                head = zlib.crc32(f"{d}:".encode())
                for w in set(runs) if slip else ():
                    h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), head)
                    if h % slip == 0:
                        k, n = h % len(w), runs.count(w)
                        held[w] -= n
                        held[w[:k] + w[k + 1:]] += n
                if len(held) > HELD:
                    yield pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})
                    held.clear()
        if held:
            yield pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": list(held.values())})

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    counts = texts.mapInPandas(count, "word string, n long").where(F.length("word") >= least_length)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def gram_order(words: DataFrame) -> dict[str, int]:
    """Bigrams from rare to common. The alphabet has 90 letters, so there are at most 8,100."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = words.where(F.length("word") > 1).select(F.explode(F.transform(places, lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("g"))
    counts = [(r["n"], r["g"]) for r in grams.groupBy("g").agg(F.count("*").alias("n")).collect()]
    return {g: k for k, (_, g) in enumerate(sorted(counts))}


def pivots(places: list[tuple[int, int]]) -> tuple[int, int]:
    """The two places at least two apart with the least sum of ranks; ``places`` lists
    (position, rank) of a prefix. One pass by position: the best place that ended
    two or more before is joined to each next one."""
    places = sorted(places)
    best, done, lead = None, 0, None
    for p, r in places:
        while places[done][0] <= p - 2:  # now far enough behind to be the first of a pair
            if lead is None or places[done][1] < lead[1]:
                lead = places[done]
            done += 1
        if lead is not None and (best is None or lead[1] + r < best[0]):
            best = (lead[1] + r, lead[0], p)
    return best[1], best[2]


def parts(word: str, front: int, back: int, size: int) -> list[str]:
    """Keys of ``word`` for a partner of ``size`` code points: one pair holds the word up to
    the gram at ``front``, one the word from the gram at ``back`` on, each with either
    half of what is left. The halves are those of the partner, so a partner that
    differs in one place has a key in common wherever its grams stand alike."""
    n, keys = len(word), []
    if 0 <= (rest := size - front - 2):
        half = rest // 2
        keys += [f"{size}a{front}:{word[:front + 2 + half]}", f"{size}b{front}:{word[:front + 2]}|{word[n - (rest - half):]}"]
    if 0 <= (rest := size - (n - back)):
        half = rest // 2
        keys += [f"{size}c{n - back}:{word[:half]}|{word[back:]}", f"{size}d{n - back}:{word[max(0, n - size + half):]}"]
    return keys


def _keys(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """(key, word, n, last, pivot): what a word looks for others by (pivot), or is found by.

    An edit behind the first pivot leaves the word up to it alone; any other edit
    leaves the word from the second pivot on alone."""
    held = words.sparkSession.sparkContext.broadcast(order)  # at most 8,100 bigrams

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rank = held.value
        for b in batches:
            rows = []
            for w, n in zip(b["word"], b["n"]):
                size = len(w)
                ranks = [rank[w[i:i + 2]] for i in range(size - 1)]
                last = sorted(ranks)[2]
                # every occurrence of the last bigram belongs to the prefix
                prefix = [(p, r) for p, r in enumerate(ranks) if r <= last]
                one, two = pivots(sorted(prefix, key=lambda x: (x[1], x[0]))[:3])
                rows += [(k, w, n, last, True) for m in (size - 1, size, size + 1) for k in parts(w, one, two, m)]
                rows += [(k, w, n, last, False) for p, _ in prefix for k in parts(w, p, p, size)]
            yield pd.DataFrame(rows, columns=["key", "word", "n", "last", "pivot"])

    return words.mapInPandas(run, "key string, word string, n long, last int, pivot boolean")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of words one edit apart. ``words``
    (word, n) holds distinct words of four code points or more."""
    keys = materialise(_keys(words, gram_order(words)), "pivots")
    a = keys.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"))
    b = keys.where("not pivot").select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"))
    alike = a.join(b, "key").where((F.col("la") <= F.col("lb")) & (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1))
    both = F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")),
                   F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    return alike.select(F.inline(both)).distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without circles: every round doubles the way followed."""
    table = materialise(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = table.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialise(table.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        table = step.select("word", "root")
        if not step.where("moved").take(1):
            return table


def group_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, slip: int | None = SLIP) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word.

    A word's form is its near word of largest n (the smaller on ties) if that is
    ``times`` its own or more; ``root`` follows forms to the last. Null and empty
    texts give no words, repeated rows count again, an empty table gives no rows;
    only ``doc_id`` and ``text`` are read."""
    if least_length < 4:
        raise ValueError("three bigrams need words of four code points or more")
    words = materialise(vocabulary(docs, least_length, least_count, slip), "words")
    near = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.max("near_n").alias("top_n"), F.min(F.struct((-F.col("near_n")).alias("k"), "near"))["near"].alias("top"))
    far = F.col("top_n") >= times * F.col("n")
    table = materialise(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(far, F.col("top")).alias("form"), F.when(far, F.col("top_n")).alias("form_n")), "forms")
    last = roots(table.where("form is not null"))
    return table.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
