"""Repeated passages, spelling variants and hard negatives against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kinespark.llm import doubling, hard_negatives, ngram_join, subwords, variants
from kinespark.llm.cover_tree import LIMIT, NONE, CoverTree
from kinespark.session import materialise

R = random.Random(11)
VOCAB = [a + b for a in "ba co di fe gu ha jo ki la mu".split() for b in "nar sol ten vix zu".split()]
DOCS = "doc_id long, text string, a string, b long, runs string, n_words string, word string, n string"


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(d, t, "x", 1, "y", "z", "w", "n") for d, t in rows], DOCS).repartition(parts)


# --- repeated passages


def brute_repeats(rows, length):
    words = [[w.decode() for w in (t or "").encode().split()] for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone |= set(range(i, i + length))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return Counter(out)


def repeat_rows():
    base, passage = [prose(80) for _ in range(6)], prose(35)
    long = prose(9000)
    words = base[2].split()
    return [(i, t) for i, t in enumerate(base)] + [
        (10, base[0]), (11, base[0] + " tail"), (11, base[0] + " tail"), (12, base[1].upper()), (13, " ".join(words[:40] + ["other"] + words[40:])),
        (20, None), (21, ""), (22, " \n\t "), (23, "one"), (24, " ".join(passage.split()[:34])), (25, passage), (26, prose(9) + "\n\n" + passage + " x " + prose(9)),
        (30, "same words " * 300), (31, "loop " * 34), (32, "loop " * 36), (None, base[4]), (33, long), (34, long[:20_000]), (35, "Ünï çödé " + passage.replace(" ", "\x0b")),
    ]


@pytest.mark.parametrize("length", [35, 8, 70])
def test_drop_repeats(spark, length):
    rows = repeat_rows()
    out = doubling.drop_repeats(table(spark, rows), length)
    assert set(out.columns) == {"doc_id", "text", "a", "b", "runs", "word", "n", "n_words", "n_removed", "kept_text"}
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in out.collect())
    assert got == brute_repeats(rows, length)
    assert hashlib.sha256(b"").hexdigest() in {r[0] for r in out.select(F.sha2("kept_text", 256)).collect()}


def test_drop_repeats_small_pieces(spark, monkeypatch):
    """Passages cut into pieces, and texts read in pieces, give the same."""
    rows = repeat_rows()
    want = [doubling.text_words(t) for _, t in rows if t]
    monkeypatch.setattr(doubling, "PIECE", 16)  # taken along to the workers
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in doubling.drop_repeats(table(spark, rows)).collect())
    assert got == brute_repeats(rows, 35)
    monkeypatch.setattr(doubling.S, "STEP", 512)
    assert all((x == y).all() for x, y in zip(want, (doubling.text_words(t) for _, t in rows if t)))


def test_drop_repeats_empty(spark):
    assert doubling.drop_repeats(table(spark, []).where("false")).collect() == []


def test_levels_double():
    for n in range(2, 257):
        sizes = doubling.levels(n)
        assert sizes[-1] == n and all(x < y <= 2 * x for x, y in zip(sizes, sizes[1:]))


def test_equal_passages_choose_equal_windows():
    d = np.random.default_rng(3).integers(0, 5, 400).astype(np.uint64)  # many ties
    h, first, n = doubling.votes(d, 4, 11)
    choice = np.repeat(h, n)
    by = {}
    for i in range(len(choice)):
        assert by.setdefault(tuple(d[i:i + 11]), choice[i]) == choice[i]
    assert len(choice) == 390


# --- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    s, t = sorted((a, b), key=len)
    return len(t) == len(s) + 1 and any(t[:i] + t[i + 1:] == s for i in range(len(t)))


def brute_variants(rows, slip):
    count = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % slip == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    form, rows = {}, {}
    for w, n in words.items():
        close = sorted((x for x in words if near(w, x)), key=lambda x: (-words[x], x))
        if close and words[close[0]] >= 5 * n:
            form[w] = close[0]
        rows[w] = [n, len(close)]
    out = set()
    for w, (n, k) in rows.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, n, k, form.get(w), words.get(form.get(w)), root))
    return out


def test_variants(spark):
    base = ["banana", "cabbage", "aaaaaa", "aaaaaaa", "ababab", "bababa", "straße", "ÉLANGUR", "nation", "ration", "Nations", "xyzxyz", "mississippi"]
    words = list(base)
    for w in base:
        for _ in range(12):
            i = R.randrange(len(w))
            words.append(R.choice([w[:i] + w[i + 1:], w[:i] + R.choice("abcé") + w[i:], w[:i] + R.choice("abcÀ") + w[i + 1:]]))
    texts = [" ".join(R.choice(words[:13] * 9 + words) for _ in range(200)) for _ in range(60)]
    rows = list(enumerate(texts)) + [(None, texts[0]), (3, texts[3]), (70, None), (71, ""), (72, "12 %% κόσμος"), (73, "chain" + "x" * 50_000)]
    for step, w in enumerate(["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]):  # a chain of forms
        rows.append((80 + step, f"{w} " * 5 * 6 ** (3 - step)))
    got = {tuple(r) for r in variants.group_variants(table(spark, rows)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    want = brute_variants(rows, 199)
    assert got == want and any(root != form for *_, form, _, root in want if form)


def test_pivots_are_disjoint_and_least():
    for _ in range(300):
        places = [(p, R.randrange(9)) for p in R.sample(range(8), 3)]
        a, b = variants.pivots(places)
        rank = dict(places)
        assert b - a >= 2 and rank[a] + rank[b] == min(r + s for p, r in places for q, s in places if q - p >= 2)


def test_variants_empty(spark):
    assert variants.group_variants(table(spark, []).where("false")).collect() == []
    assert variants.group_variants(table(spark, [(1, "two words only")])).collect() == []


# --- hard negatives


def brute_negatives(rows):
    best = {}
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        r = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * x)) for x in v])
        best[i] = min(best.get(i, r), r)
    out = set()
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))
    for a, (label, v) in best.items():
        if a % 100:
            continue
        ranked = sorted(((-dot(v, x), i, lab) for i, (lab, x) in best.items() if i != a))
        for s, i, lab in [r for r in ranked if r[2] == label][:5]:
            hits = [r for r in ranked if r[2] != label and -80 * s <= -100 * r[0] <= -100 * s][:5]
            out |= {(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(hits)}
    return out


def test_hard_negatives(spark):
    g = np.random.default_rng(5)
    rows = [(i, int(g.integers(0, 4)), [float(x) for x in g.normal(size=8)]) for i in range(700)]
    rows += [(700 + i, i % 3, [1.0, 0.5] + [0.0] * 6) for i in range(120)]  # one vector many times: ties
    rows += [(900, None, [1.0] * 8), (901, 1, None), (902, 1, [1.0, float("nan")]), (903, 1, [None, 1.0]), (904, 2, [float("inf")]), (905, 2, []), (1000, 2, [0.25, 0.25]),
             (None, 1, [1.0] * 8), (1100, 9, [1.0] * 8), rows[100], (200, 3, [2.0] * 8), (1200, 1, [0.0] * 8)]
    df = spark.createDataFrame([(i, lab, v, "x", 5) for i, lab, v in rows], "vec_id long, label int, embedding array<float>, id string, block long").repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = [tuple(r) for r in hard_negatives.mine(df, F.col("id") % 100 == 0, label=label).collect()]
    rows = [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows)


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hard_negatives.mine(df, F.col("id") % 100 == 0).collect() == []


def test_cover_tree_covers_and_skips():
    g = np.random.default_rng(2)
    spots = g.integers(-200, 200, (12, 16))
    v = spots[g.integers(0, 12, 3000)] + g.integers(-4, 5, (3000, 16))
    tree = CoverTree.load(CoverTree(np.arange(3000), np.zeros(3000, np.int64), v).dump())
    assert sorted(np.concatenate(tree.leaves)) == list(range(3000))
    for (c, r, parent, _, _), (up, _, _, _, _) in zip(tree.levels[1:], tree.levels):
        assert (parent >= 0).all() and (r >= 0).all() and len(up) > parent.max()
    n = 20
    low, high = np.full((n, 1), 1 - LIMIT), np.full((n, 1), LIMIT - 1)
    best = tree.search(v[:n].astype(float), np.zeros(n, np.int64), True, np.arange(n), low, high, 5)
    assert (best != NONE).all()
    score = v[:n] @ v.T
    for i in range(n):
        want = [j for j in np.lexsort((np.arange(3000), -score[i])) if j != i][:5]
        assert list(tree.read(best[i, 0])[1]) == want


def test_join_compares_few_pairs(spark, monkeypatch):
    """Documents that share a passage, or differ a little too much, aren't compared pair by pair; links stay."""
    word = lambda i: f"w{i}"
    passage = [word(i) for i in range(60)]
    rows = [(i, " ".join(passage + [f"d{i}x{j}" for j in range(150)])) for i in range(80)]
    base = [f"b{j}" for j in range(200)]
    for i in range(60):  # four edits each: two of them share 160 of 232 shingles
        w = list(base)
        for j in range(4):
            w[(7 * i + 50 * j) % 200] = f"e{i}x{j}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, " ".join(base)), (201, rows[5][1] + " more"), (202, rows[5][1])]
    seen, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, *a: (seen.append(pairs.count()), verified(pairs, *a))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(df).collect()}
    assert sum(seen) <= 3 * len(rows), seen
    sets = {d: {tuple(t.split()[i:i + 5]) for i in range(len(t.split()) - 4)} for d, t in rows}
    root = {d: d for d in sets}
    for a in sorted(sets):  # each component takes its smallest id
        for b in sets:
            if root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {d: low if r == high else r for d, r in root.items()}
    assert got == root and got[101] == 100 and got[202] == got[201] == 5


def test_shuffle_files_go_with_a_write(spark):
    """A written table's shuffle files don't stay until the session ends, and the setting does not stay either."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(name, None), []
    df = spark.range(10).groupBy("id").count()
    real = type(df.write).parquet
    try:
        type(df.write).parquet = lambda self, path, *a, **k: (seen.append(spark.conf.get(name)), real(self, path, *a, **k))[1]
        assert materialise(df, "t").count() == 10
    finally:
        type(df.write).parquet = real
    assert seen == ["true"] and spark.conf.get(name, None) == before


def test_new_words_cost_few_library_calls(monkeypatch):
    """Words of letters reach the library joined or not at all; ids are those of the library for odd words, too."""
    path = public_tokenizers.path("word_bpe_49k.json")
    tk, r = subwords.load(path), random.Random(3)
    odd = list("abcXYZ09'\"$&<|>_-.,!?#é") + ["ç", "ß", "İ", "ñ", "Σ", "́", "̌", "J", "中", "'s", "'ll", "1"]
    for k in range(300):
        text = " ".join("".join(r.choice(odd) for _ in range(r.randint(1, 7))) for _ in range(6))
        text = text if k % 3 else text.encode("ascii", "ignore").decode()
        assert subwords.word_ids(path, [text])[0].tolist() == tk.encode(text, add_special_tokens=False).ids

    class Counted:
        sent = 0

        def __getattr__(self, name):
            return getattr(tk, name)

        def encode_batch_fast(self, texts, **how):
            Counted.sent += len(texts)
            return tk.encode_batch_fast(texts, **how)

    encode = subwords._word_encoder(Counted())
    Counted.sent = 0
    words = [w.encode() for w in ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(300)]]
    words += [w + b"$$$" for w in words] + [w + "éü".encode() for w in words]
    got = [np.frombuffer(x, np.int32).tolist() for x in encode(words)]
    assert got == [tk.encode(w.decode(), add_special_tokens=False).ids for w in words]
    assert Counted.sent < 30
