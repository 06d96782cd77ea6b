"""Token counts by overlap resynchronisation.

A huge document is encoded in overlapping chunks with offsets. Two neighbouring
chunks are spliced where both start a word of the pre-tokeniser at the same
place inside the overlap: its matches depend on the text from their start on
and on one character after their end, so from a common start on both agree, as
long as it is no nearer to the end of the first chunk than a special token is
long. Where no common start is found the overlap is doubled, and a chunk that
is overlapped whole is made longer, up to the whole text. The counts are
therefore those of the whole text. Shorter documents are one chunk each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm import subwords

#: Characters of a chunk and of the first overlap tried.
CHUNK, OVERLAP = 32_768, 512
#: Shorter texts handled at once.
STEP = 256


class _Chunk:
    """Ids of a chunk and, at absolute places, the starts of its words."""

    def __init__(self, tokenizer, text: str, at: int, end: int):
        e = tokenizer.encode(text[at:end], add_special_tokens=False)
        self.ids = np.array(e.ids, np.int32)
        word = np.array([-1 - i if w is None else w for i, w in enumerate(e.word_ids)], np.int64)
        first = np.flatnonzero(np.diff(word, prepend=np.iinfo(np.int64).min)) if len(word) else np.zeros(0, np.int64)
        # words are numbered anew after a special token, so a number may repeat: a step of any kind starts a word
        self.token = first
        self.place = np.array(e.offsets, np.int64).reshape(-1, 2)[first, 0] + at

    def index(self, place: int) -> int:
        return int(self.token[np.searchsorted(self.place, place)])


def spliced_ids(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[np.ndarray]:
    """The ids of the whole text, piece by piece."""
    n = len(text)
    margin = max([1, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())])
    at, end, left = 0, min(n, chunk), 0
    here = _Chunk(tokenizer, text, at, end)
    begin = 0  # the first id of `here` that counts
    while end < n:
        lap = overlap
        while True:
            start = end - lap
            if start <= left:  # overlapped whole
                end = min(n, at + 2 * (end - at))
                here, lap = _Chunk(tokenizer, text, at, end), overlap
                begin = here.index(left) if left else 0
                if end == n:
                    break
                continue
            following = _Chunk(tokenizer, text, start, min(n, start + max(chunk, 2 * lap)))
            common = np.intersect1d(here.place, following.place[1:])
            common = common[(common > max(start, left)) & (common <= end - margin)]
            if len(common):
                break
            lap *= 2
        if end == n:
            break
        place = int(common[-1])
        yield here.ids[begin:here.index(place)]
        here, at, left = following, start, place
        end = min(n, start + max(chunk, 2 * lap))
        begin = here.index(place)
    yield here.ids[begin:]


def counter(path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
    """A column function: text to its number of tokens under the byte-level tokenizer at ``path``."""

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = subwords.load(path)
        for texts in batches:
            texts = texts.fillna("")
            huge = texts.str.len() > chunk
            out = np.zeros(len(texts), np.int64)
            short = np.flatnonzero(~huge.values)
            for i in range(0, len(short), STEP):  # the pieces of a few texts at a time
                some = short[i:i + STEP]
                out[some] = subwords.byte_counts(path, list(texts.iloc[some]))
            for i in np.flatnonzero(huge.values):
                out[i] = sum(map(len, spliced_ids(tokenizer, texts.iloc[i], chunk, overlap)))
            yield pd.Series(out)

    return n_tokens


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row.

    Null texts count as empty: 0 bytes, 0 tokens. Special tokens' strings in texts are
    the tokens, the library's default. Repeated rows are counted alike; other
    columns aren't read. There is no shuffle."""
    t = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    return docs.select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), counter(path, chunk)(t).alias("n_tokens")).withColumn(
        "over_limit", F.col("n_tokens") > limit)
