"""Memoised use of a public tokenizer inside Spark tasks.

The libraries' own pre-tokenisation costs about a microsecond a byte; words
repeat, so each Python worker remembers the ids of the pieces it has met. A
memo that holds ``limit`` pieces forgets those it met least, which bounds its memory.
"""

from __future__ import annotations

import gc
import os
import re
import string
import unicodedata
from itertools import accumulate, chain

import numpy as np

#: Pieces a worker remembers, about 70 MB.
LIMIT = 400_000
_loaded: dict[tuple, object] = {}


def load(path: str, **flags):
    """The tokenizer of a .json file, once a worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task a core
    key = (path, *sorted(flags.items()))
    if key not in _loaded:
        from tokenizers import Tokenizer

        _loaded[key] = t = Tokenizer.from_file(path)
        for k, v in flags.items():
            setattr(t, k, v)
    return _loaded[key]


class _Slots(dict):
    """Piece to slot number; ``new`` lists pieces that have a slot but no ids yet."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, piece):
        slot = self[piece] = len(self)
        self.new.append(piece)
        return slot


class Memo:
    """``look`` turns a list of pieces into slots; ``ids`` and ``counts`` serve them.

    ``encode`` gives the ids of each of a list of new pieces, as lists or packed in 4 bytes each."""

    def __init__(self, encode, limit: int = LIMIT):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self):
        self.slots = _Slots()
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.start, self.size, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0
        self.met = np.zeros(0, np.int64)

    def look(self, pieces: list) -> np.ndarray:
        if len(self.slots) > self.limit:
            self._forget()
        out = np.fromiter(map(self.slots.__getitem__, pieces), np.int64, len(pieces))
        if self.slots.new:
            self._learn()
        met = np.bincount(out, minlength=self.n)
        met[:len(self.met)] += self.met
        self.met = met
        return out

    def _forget(self):
        """Keeps the pieces met twice or more since the last time, at most half of them."""
        least = max(2, int(np.partition(self.met, -self.limit // 2)[-self.limit // 2]) + 1)
        keep = np.flatnonzero(self.met >= least)
        flat, size, place = self.ids(keep), self.size[keep], np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        old = self.slots
        self.clear()
        self.slots.update((w, place[i]) for w, i in old.items() if place[i] >= 0)
        self.flat, self.used = np.append(flat, np.zeros(1 << 16, np.int32)), len(flat)
        self.start, self.size, self.n = np.cumsum(size) - size, size, len(size)
        self.met = np.zeros(self.n, np.int64)

    def _learn(self):
        new, self.slots.new = self.slots.new, []
        collects = gc.isenabled()
        gc.disable()  # many small lists and no cycles: looking for some takes a tenth of the time
        try:
            lists = self.encode(new)
        finally:
            if collects:
                gc.enable()
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        packed = bool(lists) and isinstance(lists[0], bytes)
        if packed:
            sizes //= 4
        need, n = self.used + int(sizes.sum()), self.n + len(lists)
        while need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while n > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros(len(a) + 1024, np.int64)]) for a in (self.start, self.size))
        self.flat[self.used:need] = np.frombuffer(b"".join(lists), np.int32) if packed else np.fromiter(chain.from_iterable(lists), np.int32, need - self.used)
        self.size[self.n:n] = sizes
        self.start[self.n:n] = self.used + np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else 0
        self.used, self.n = need, n

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """Ids of the slots, one after another."""
        size = self.size[slots]
        ends = np.cumsum(size)
        if not len(size) or not ends[-1]:
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(self.start[slots] - ends + size, size) + np.arange(ends[-1])]


_memos: dict[tuple, Memo] = {}

# ---- vocabularies that drop white space: every ASCII-white-space word stands alone

_TAIL = string.punctuation.encode()


def _closed(core: bytes) -> bool:
    """Whether the last character is a letter or digit, also as the normaliser leaves it."""
    if core[-1:].isascii():
        return core[-1:].isalnum()
    last = unicodedata.normalize("NFC", core[-4:].decode("utf-8", "ignore")[-1:]).lower()
    return unicodedata.category(last[-1:] or " ")[0] in "LN"


def _packed(lists: list[list[int]]) -> list[bytes]:
    """Ids in 4 bytes each: the garbage collector needn't look at bytes."""
    raw = np.fromiter(chain.from_iterable(lists), np.int32).tobytes()
    cuts = [0, *accumulate(4 * len(x) for x in lists)]
    return [raw[i:j] for i, j in zip(cuts, cuts[1:])]


def _plain_encoder(tokenizer):
    """Ids of words of letters alone, which such a tokenizer takes as one piece each. Lower-case
    ASCII letters are their own normal form and byte symbols, so the model gets them at once.
    Other letters go through the library many words a text: every piece ends in one token with
    the end-of-word suffix, so a text with as many of those as words falls apart at them. Where
    either doesn't hold, words go one by one."""
    model = tokenizer.model
    one_by_one = lambda texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    direct = lambda texts: [[t.id for t in model.tokenize(x)] for x in texts]
    probe = ["a", "the", "zebra", "qxzjkvwpy", "internationally", "abcdefghijklmnopqrstuvwxyz" * 3]
    at_once = direct(probe) == one_by_one(probe)
    suffix = getattr(model, "end_of_word_suffix", None)
    ends = np.zeros(tokenizer.get_vocab_size(), bool)
    if suffix:
        ends[[i for w, i in tokenizer.get_vocab().items() if w.endswith(suffix)]] = True

    def encode(words: list[bytes]) -> list[bytes]:
        texts = [w.decode() for w in words]
        if words and words[0].isascii():
            return _packed(direct(texts) if at_once else one_by_one(texts))
        if not suffix:
            return _packed(one_by_one(texts))
        out, step = [], 32
        joined = one_by_one([" ".join(texts[i:i + step]) for i in range(0, len(texts), step)])
        for k, ids in enumerate(joined):
            part = texts[k * step:(k + 1) * step]
            row = np.array(ids, np.int32)
            cuts = (4 * (np.flatnonzero(ends[row]) + 1)).tolist()
            if len(cuts) == len(part) and cuts[-1] == 4 * len(ids):
                raw = row.tobytes()
                out += [raw[i:j] for i, j in zip([0, *cuts], cuts)]
            else:
                out += _packed(one_by_one(part))
        return out

    return encode


def _word_encoder(tokenizer):
    """Ids of words by those of their core and their closing punctuation, which such
    a tokenizer never joins where the core ends in a letter or digit; ASCII capitals
    fold, as its normaliser would. Left whole are cores that end in anything else, as
    the tokenizer takes a run of marks as one piece, and what may hold a special
    token's string."""
    cores: dict[bytes, bytes] = {b"": b""}
    older: dict[bytes, bytes] = {}
    plain = _plain_encoder(tokenizer)

    def parts(w: bytes) -> tuple[bytes, bytes]:
        if b"<|" in w:
            return w, b""
        if w.isascii():
            w = w.lower()
        core = w.rstrip(_TAIL)
        return (core, w[len(core):]) if _closed(core) else (w, b"")

    def encode(words: list[bytes]) -> list[bytes]:
        nonlocal cores, older
        if len(cores) > LIMIT // 2:
            cores, older = {b"": b""}, cores
        # isalpha: ASCII letters alone
        split = [(w.lower(), b"") if w.isalpha() else (w[:-1].lower(), w[-1:]) if w[-1] in _TAIL and w[:-1].isalpha() else parts(w) for w in words]
        new = {a for a, _ in split if a not in cores}
        new.update({b for _, b in split if b not in cores})
        if older:
            for x in [x for x in new if x in older]:
                cores[x] = older[x]
                new.remove(x)
        letters = [x for x in new if x.isalpha() and x.islower()]
        others = [x for x in new if not x.isascii() and (t := x.decode("utf-8", "replace")).isalpha() and t.encode() == x]
        rest = list(new.difference(letters, others))
        cores.update(zip(letters, plain(letters)))
        cores.update(zip(others, plain(others)))
        whole = tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in rest], add_special_tokens=False)
        cores.update(zip(rest, _packed([e.ids for e in whole])))
        return [cores[a] + cores[b] if b else cores[a] for a, b in split]

    return encode


def word_ids(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text under a tokenizer whose words never cross white space."""
    key = ("words", path)
    if key not in _memos:
        _memos[key] = Memo(_word_encoder(load(path)))
    memo = _memos[key]
    raw = [t.encode("utf-8", "replace") for t in texts]
    # fewer words to remember; beside other letters capitals may compose otherwise, and a special token's string has its case
    split = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in raw]
    slots = memo.look([w for ws in split for w in ws])
    ids = memo.ids(slots)
    per_text = np.add.reduceat(np.append(memo.size[slots], 0), np.cumsum([0] + [len(x) for x in split])[:-1]) if split else np.zeros(0, np.int64)
    per_text = np.where([len(x) > 0 for x in split], per_text, 0).astype(np.int64)
    return np.split(ids, np.cumsum(per_text)[:-1]) if split else []


# ---- byte-level vocabularies: a lone space between two words opens a piece of its own

_STABLE, _DOUBLE = re.compile(r"(?<=\S) (?=\S)"), re.compile(r"\s\s")


def _pieces(text: str) -> list[str]:
    """Pieces whose ids don't depend on their neighbours. The pre-tokeniser never lets
    a match that ends in a non-space run over a single space or newline, and starts
    anew there. The first piece is marked by \\r, as it has no space before it."""
    if _DOUBLE.search(text) or text[0].isspace() or text[-1].isspace():
        out = _STABLE.split(text)
    else:
        out = text.replace("\n", " \n").split(" ")
    out[0] = "\r" + out[0]
    return out


def _piece_encoder(tokenizer):
    def encode(pieces: list[str]) -> list[list[int]]:
        raw = [p[1:] if p[0] == "\r" else p if p[0] == "\n" else " " + p for p in pieces]
        return [e.ids for e in tokenizer.encode_batch_fast(raw, add_special_tokens=False)]

    return encode


def byte_ids(path: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text under a byte-level tokenizer with the usual word pattern."""
    key = ("bytes", path)
    if key not in _memos:
        _memos[key] = Memo(_piece_encoder(load(path)))
    memo = _memos[key]
    split = [_pieces(t) if t else [] for t in texts]
    slots = memo.look([p for ps in split for p in ps])
    return [memo.ids(s) for s in np.split(slots, np.cumsum([len(p) for p in split])[:-1])] if split else []


def byte_counts(path: str, texts: list[str]) -> np.ndarray:
    """Lengths of what ``byte_ids`` gives."""
    key = ("bytes", path)
    if key not in _memos:
        _memos[key] = Memo(_piece_encoder(load(path)))
    memo = _memos[key]
    split = [_pieces(t) if t else [] for t in texts]
    slots = memo.look([p for ps in split for p in ps])
    run = np.concatenate([[0], np.cumsum(memo.size[slots])])
    ends = np.cumsum([len(p) for p in split])
    return run[ends] - run[ends - np.array([len(p) for p in split])] if split else np.zeros(0, np.int64)
