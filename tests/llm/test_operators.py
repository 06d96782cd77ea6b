"""Operators of kinespark.llm against brute force, on small awkward tables."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kinespark.llm import decontam, gru_lm, html_diff, license_scan, mixing, ngram_join, quality_rules, subwords, token_count, token_store, url_rules

R = random.Random(7)
VOCAB = [a + b for a in "ba co di fe gu ha jo ki la mu".split() for b in "nar sol ten vix zu".split()]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size long, unit string"


def prose(n):
    return " ".join(R.choice(VOCAB) for _ in range(n))


LONG = prose(9000)
BASE = [prose(60) for _ in range(12)]
ITEM = prose(25)
ROWS = [(i, t) for i, t in enumerate(BASE)] + [
    (20, BASE[0]), (21, BASE[0] + " tail"), (22, BASE[0].upper()), (23, " ".join(BASE[1].split()[:30] + ["other"] + BASE[1].split()[30:])),
    (30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "one two"), (34, "one two"), (35, "one two"), (36, LONG), (37, LONG + " end"),
    (40, prose(40) + "\n" + ITEM + "\n" + prose(40)), (None, BASE[3]), (41, "%%% ### " * 60), (42, "same line\n" * 80), (43, "a b c " * 40), (44, "Ünï çödé <|endoftext|> x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    langs, sources = ["en", "fr", None], ["b", "a", None, "c"]
    rows = [(i, t, langs[k % 3], sources[k % 4], None, "x", -1, "y") for k, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def shingles(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return Counter((d, len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows))


def test_ngram_join(docs):
    got = Counter(tuple(r) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute_components(ROWS)


def test_ngram_join_groups(spark):
    """A large group of near copies that differ from each other, and chains."""
    base = prose(120).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[R.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(w)))
    chain = prose(100).split()
    rows += [(100 + i, " ".join(chain[6 * i:] + [f"c{j}" for j in range(6 * i)])) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in ngram_join.near_duplicates(df).collect()) == brute_components(rows)


def test_one_of_each(docs):
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and not any(ids[i] for i in (20, 21, 22, 23, 35, 37)) and ids[34] == 1
    assert all(ids[i] == 1 for i in (30, 31, 32)) and ids[None] == 0


def test_quality_measures(docs):
    for r in quality_rules.judge(docs, docs.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")).collect():
        texts = [t for d, t in ROWS if d == r.doc_id]
        t = texts[0] or ""
        w = [x.decode() for x in t.encode().split()]
        tri = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        hit = {i + j for i in range(len(w) - 2) if tri[tuple(w[i:i + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if x.encode().split()]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.n_symbols == sum(t.count(c) for c in "#*$%&|<>") and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_binomial_tail(spark):
    cases = [(1, 0), (10, 0), (464, 1), (5000, 30), (200_000, 1900)]
    df = spark.createDataFrame(cases, "n long, k long").withColumn("p", quality_rules.binomial_tail(F.col("n"), F.col("k"), 0.01))
    for r in df.collect():
        logs = [math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.01) + (r.n - i) * math.log(0.99) for i in range(r.k + 1)]
        assert r.p == pytest.approx(1.0 if r.k > 0.01 * r.n else sum(map(math.exp, logs)), rel=1e-7)


def test_cutoffs_are_certified(spark):
    """Bad documents full of symbols are rejected, good ones aren't; too few labels give no cutoff."""
    rows, labels = [], []
    for i in range(3000):
        bad = i % 10 == 0
        rows.append((i, (prose(30) + " ") * 2 if not bad else " ".join(w + " ###" for w in prose(60).split()), "en" if i < 2990 else "fr"))
        labels.append((i, int(not bad), 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    df = df.withColumn("text", F.concat("text", F.lit(" "), F.col("doc_id").cast("string")))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules.judge(df, lab).collect()}
    assert not any(out[i].kept for i in range(0, 2990, 10))
    assert all(r.kept != r.base_failed for i, r in out.items() if i % 10)
    assert all(r.kept != r.base_failed for i, r in out.items() if i >= 2990)
    assert quality_rules.filter_documents(df, lab).columns == df.columns


def test_mix(docs):
    rows = [r.asDict() for r in mixing.mix(docs).collect()]
    assert len(rows) == len(ROWS)
    size = Counter()
    for k, (_, t) in enumerate(ROWS):
        size[["b", "a", None, "c"][k % 4]] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: [5, 2, 1][i % 3] for i, s in enumerate(order)}
    left, target, free = 1.5 * sum(size.values()), {}, set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * level > 2 * size[s]]
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    assert {round(r["target"], 6) for r in rows} == {round(x, 6) for x in target.values()}
    for s in order:
        mine = [r for r in rows if r["source_size"] == size[s]]
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= max(r["size"] for r in mine)
    assert all(r["taken"] <= 2 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(str(r.asDict()) for r in mixing.mix(docs.repartition(5)).collect())
    assert mixing.repeat_documents(docs).count() == sum(r["times"] for r in rows)


TEXTS = [t for _, t in ROWS if t] + ["It's  we'll  don't", "İstanbul É é x ́y", "a b c d", "!!<|endoftext|>!!", "<|ENDOFTEXT|>", " x", "x ", "\n", "a \n b", "12345 6789", "a\u0085b"]


def test_word_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(TEXTS, add_special_tokens=False)]
    assert [list(x) for x in subwords.word_ids(path, TEXTS)] == want
    memo = subwords.Memo(lambda ps: [[len(p), i] for i, p in enumerate(ps)], limit=50)
    for _ in range(40):
        some = [R.choice(VOCAB) + str(R.randrange(9)) for _ in range(80)]
        slots = memo.look(some)
        assert memo.ids(slots)[::2].tolist() == [len(p) for p in some]


def test_word_ids_of_mark_runs():
    path = public_tokenizers.path("word_bpe_49k.json")
    marks = ["a).", 'said",', "dogs'.", "50%,", "(see).", '9233...B"!!', "a_.", "can't.", "é.", "É!", "x².", "İ.", "क़.", "e\u0301.", "字,", "٣.", "...", "()", "(.)", "-.", "<|endoftext|>."]
    texts = marks + [" ".join(marks), *(" ".join(w + m for w in ("He", "40", "ça")) for m in (").", '",', "%,", "'.", "?!", "”.", ").”,"))]
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [list(x) for x in subwords.word_ids(path, texts)] == want


def test_byte_ids_and_splices():
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    want = [e.ids for e in tokenizer.encode_batch(TEXTS, add_special_tokens=False)]
    assert [list(x) for x in subwords.byte_ids(path, TEXTS)] == want
    assert list(subwords.byte_counts(path, TEXTS)) == [len(x) for x in want]
    for t in ["a" * 500 + " b c" * 50 + "<|endoftext|>" * 30 + " x" * 100, "<|endoftext|>!! ??" * 40, prose(300), LONG[:4000]]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        for chunk, lap in ((37, 5), (64, 8), (900, 40)):
            assert [int(i) for x in token_count.spliced_ids(tokenizer, t, chunk, lap) for i in x] == ids


def test_token_counts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    n = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    got = Counter(tuple(r) for r in token_count.count_tokens(docs, path, chunk=2000).collect())
    assert got == Counter((d, len((t or "").encode()), n(t), n(t) > 512) for d, t in ROWS)


def test_token_store(spark, docs, tmp_path):
    path, out = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "tokens")
    tokenizer = Tokenizer.from_file(path)
    ids = lambda t: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
    rows = sorted(token_store.store(docs, path, out=out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows][:-1] == sorted(d for d, _ in ROWS if d is not None) and rows[-1].doc_id is None
    start = 0
    for r in rows:
        assert r.start == start
        start += r.n_tokens
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == Counter((d, len(ids(t)), zlib.crc32(ids(t).tobytes())) for d, t in ROWS)
    assert token_store.lookup(spark, out, 36).tolist() == ids(LONG).tolist() and token_store.lookup(spark, out, 999) is None


def test_gru_scores(docs):
    rows = gru_lm.score(docs).collect()
    out = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    c = Counter(w for d, t in ROWS if not out(d) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(ROWS)
    want = Counter((d, out(d), len(words(t)) + 1, sum(c[w] > 0 for w in [*words(t), None]), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 4)) for d, t in ROWS)
    assert Counter((*r[:5], round(r.base_score, 4)) for r in rows) == want
    assert all(r.score < 0 for r in rows)


def test_every_training_document_teaches(spark):
    from kinespark.llm import gru

    rows = spark.createDataFrame([(i, prose(30)) for i in range(6)], "doc_id long, text string").coalesce(1)
    corpus = gru_lm.Corpus(rows)
    start = gru.pack(corpus.start)
    assert all(gru.pack(gru_lm.train(rows.where(F.col("doc_id") == i), corpus)) != start for i in range(6))
    assert gru_lm.VOCABULARY >= 2047 and gru.HIDDEN >= 24


def test_gru_gradients_and_gain():
    from kinespark.llm import gru

    rng = np.random.default_rng(0)
    turn = [np.append(np.tile([1, 2, 3], 40)[int(rng.integers(3)):][:90], 0) for _ in range(64)]  # the next word follows from the last
    model = gru.init(np.array([64.0, 1920, 1920, 1920]), 0.0)
    before, trainer = gru.score(model, turn).sum(), gru.Trainer(model)
    for _ in range(60):
        gru.train(trainer, turn)
    assert gru.score(model, turn).sum() > 0.5 * before
    # probabilities of all words and "other" add up to 1
    states = rng.standard_normal((5, gru.HIDDEN)).astype(np.float32)
    total = sum(np.exp(gru._log_probs(model, states, np.full(5, y), None)[0]) for y in range(gru.SPAN + 1))
    assert np.allclose(total, 1, atol=1e-3)  # 32-bit sums
    # a state carried across windows scores like one long window
    assert np.allclose(gru.score(model, turn[:3]), [gru.score(model, [d])[0] for d in turn[:3]], rtol=1e-4)


def test_leaks(spark, docs):
    short = "alpha beta gamma"
    bench = spark.createDataFrame([(1, ITEM, "z"), (2, prose(30), "z"), (3, None, "z"), (4, "", "z"), (5, short, "z"), (None, "q w e r t y", "z")], "item_id long, text string, doc_id string")
    more = spark.createDataFrame([(50, short), (51, "x " + short), (52, " ".join(ITEM.split()[:24] + ["odd"]) + " " + prose(50)), (53, " ".join(ITEM.split()[:9]) + " " + prose(60))], "doc_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontam.leaks(docs.select("doc_id", "text").union(more), bench).collect()}
    assert found == {(40, 1), (50, 5), (52, 1)}
    assert 40 not in {r.doc_id for r in decontam.clean(docs, bench).collect()}
    assert decontam.clean(docs, bench).count() == len(ROWS) - 1 and decontam.clean(docs, bench).columns == docs.columns


def page(menu, body, foot="f"):
    return f"<html><head><title>t</title><script>var x='<p>';</script></head><body><div>{menu}</div>{body}<div>{foot}</div></body></html>"


def test_page_text(spark):
    rows = [
        (1, "http://a.com/x/1", page("Home News", "<p>first &amp; only<br>body</p><p>two</p>")), (2, "http://a.com/x/2", page("Home News", "<p>other body</p>")),
        (3, "http://b.com/1", page("Home News", "<p>alone</p>")), (4, None, None), (5, "no scheme", ""), (1, "http://a.com/x/1", page("Home News", "<p>first &amp; only<br>body</p><p>two</p>")),
        (6, "http://c.com/1", "<article><h1>T</h1><nav>n</nav><p>a\n  b<p>c</article><footer>g</footer><ul class='menu'><li>m</ul><div id=comments><p>no</p></div><form>q</form>"),
        (7, "http://d.com/1", page("m", "<p>copy of a text that is long enough to be the page</p>")), (8, "http://d.com/2", page("m", "<p>copy of a text that is long enough to be the page</p><p>n</p>")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: (r.text, r.n_chars) for r in html_diff.extract(df).collect()}
    assert html_diff.extract(df).count() == len(rows)
    assert got[1][0] == "first & only body\ntwo" and got[2][0] == "other body" and got[3][0] == "Home News\nalone\nf"
    assert got[4] == got[5] == ("", 0) and got[6][0] == "T\na b\nc" and "copy of a text" in got[7][0] and "copy of a text" in got[8][0]


def test_shared_lines():
    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(400):
        a, b = (np.array([R.randrange(6) for _ in range(R.randrange(14))], np.int64) for _ in range(2))
        found = html_diff.shared_lines(a, b)
        rest = iter(b.tolist())
        assert len(found) == lcs(a, b) and found == sorted(set(found)) and all(any(x == y for y in rest) for x in a[found].tolist())


def test_url_rules(spark):
    urls = ["http://x.com/a", "https://WWW.Example.COM/en/1?q=1", "http://example.com/en/", "http://a.b.net/es/q#f", "http://net/fr/x", "http://mynet.org/fr/", "http://x.com?y", None, "plain", "http://q.org/bad/9", "http://q.org/ok/9"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("token", F.lit(1))
    lab = spark.createDataFrame([(f"http://{h}.org/{s}/{i}", s == "bad") for i in range(60) for h in "qr" for s in ("bad", "ok")] + [(None, True), ("http://z.org/bad/", None)], "url string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, lab).collect()}
    assert url_rules.judge(df, lab).count() == len(urls) + 1
    assert got[0] == ("x.com", "/a", "com/", "allow") and got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2][2:] == ("example.com/en/", "block") and got[3] == ("a.b.net", "/es/q", "net/es/", "block") and got[4][2] == "net/fr/"
    assert got[5][2:] == (None, "allow") and got[6] == ("x.com", "", None, "allow") and got[7] == got[8] == ("", "", None, "allow")
    assert got[9][3] == "block" and got[10][3] == "allow"
    none = url_rules.judge(df, lab.limit(0)).where("page_id = 9").first()
    assert none.verdict == "allow"


def test_license_scan(spark, docs):
    notices = {"mit": "Released under the MIT License.", "apache": "Licensed under the Apache License, Version 2.0.", "cc-by-nc": "Licensed under CC BY-NC 4.0.",
               "gpl": "This work is licensed under the GNU General Public License, version 3."}
    rows = [(1000 + i, prose(70) + "\n" + (notices[f] if i % 2 else prose(10) + " " + notices[f] + " " + prose(10)) + "\n" + prose(30)) for i, f in enumerate([*notices] * 4)]
    rows += [(2000 + i, prose(40) + "\nwritten permission was licensed to the public " + prose(20)) for i in range(8)]
    df = docs.select("doc_id", "text", "lang", "kept").union(spark.createDataFrame([(*r, "en", "x") for r in rows], "doc_id long, text string, lang string, kept string"))
    got = {(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(df).collect()}
    assert got == {(1000 + i, 1, f) for i, f in enumerate([*notices] * 4)}


def test_empty_tables(spark, docs):
    none, bench = docs.limit(0), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    word, byte = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
    for df in (ngram_join.near_duplicates(none), ngram_join.one_of_each(none), quality_rules.judge(none, labels), quality_rules.filter_documents(none, labels), mixing.mix(none),
               mixing.repeat_documents(none), token_count.count_tokens(none, byte), token_store.store(none, word), gru_lm.score(none), decontam.leaks(none, bench), decontam.clean(none, bench),
               html_diff.extract(spark.createDataFrame([], "page_id long, url string, html string")), license_scan.scan(none)):
        assert df.count() == 0
    assert decontam.leaks(docs, bench).count() == 0
