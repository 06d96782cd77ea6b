"""Quality rules with risk-controlled cutoffs.

Every text is measured with SQL functions. A rule rejects a document when one of
its ratios exceeds a cutoff; cutoffs are chosen per stratum from labelled
documents so that the share of good documents each rejects is limited with
high confidence:

* labelled documents are split by a digest of their id into a *choice* half and a
  *holdout* half;
* on the holdout, H0 "this cutoff rejects more than ``risk / rules`` of the good
  documents of the stratum" is tested with the exact binomial tail
  (Clopper-Pearson); cutoffs of a ratio are tested from lenient to strict and
  testing stops at the first failure (fixed sequence), and the level ``delta`` is
  divided by strata x rules (Bonferroni);
* among certified cutoffs the choice half picks the one with the greatest
  ``bad rejected - cost * good rejected``; none is used if that isn't positive.

With probability ``1 - delta`` or more, therefore, no stratum loses more than
``risk`` of its good documents to the rules. A stratum with too few labels gets
no cutoff and keeps its documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.text import WORD, hashed_share, words
from kinespark.session import materialise

#: Cutoffs of each ratio, lenient to strict.
GRID: dict[str, list[float]] = {
    "symbols": [4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05],
    "dup_lines": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.2],
    "repeats": [0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2],
    "word_length": [40.0, 20.0, 15.0, 12.0, 11.0, 10.0, 9.0, 8.5, 8.0],
}
RISK, DELTA, COST = 0.04, 0.05, 20.0
NO_STRATUM = "~"


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Appends n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long).

    Null and empty texts have zeros. ``n_repeat_words`` counts the words that lie
    in some 3-word window whose words occur in that order twice or more."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    w, win, twins, rep = F.col("_w"), F.col("_win"), F.col("_twins"), F.col("_rep")
    no_pos = F.array().cast("array<int>")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    ).otherwise(F.array().cast("array<bigint>"))
    # most texts repeat no window
    repeats = F.size(F.array_distinct(win)) < F.size(win)
    # windows sorted by digest and place: equal windows become neighbours
    placed = F.when(repeats, F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    same = lambda x, j: F.coalesce(x["h"] == F.get(twins, j)["h"], F.lit(False))
    twice = F.when(
        twins.isNotNull(),
        F.sort_array(F.transform(F.filter(twins, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))
    ).otherwise(no_pos)
    # each repeated window adds its three words, less those the next one covers too
    covered = F.aggregate(
        F.transform(rep, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(rep, j + 1) - p, F.lit(3)))),
        F.lit(0).cast("long"), lambda a, x: a + x)
    return (
        docs.withColumns({"_w": words(t), "_lines": lines})
        .withColumn("_win", windows)
        .withColumn("_twins", placed)
        .withColumn("_rep", twice)
        .withColumns({
            "n_words": F.size(w).cast("long"),
            "word_chars": F.length(F.array_join(w, "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_n_lines": F.size("_lines").cast("long"),
            "n_repeat_words": covered,
        })
        .drop("_w", "_lines", "_win", "_twins", "_rep")
    )


def ratios() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
        "repeats": F.col("n_repeat_words") / n,
        "word_length": F.col("word_chars") / n,
    }


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _lgamma(x: Column) -> Column:
    """Stirling's series after a shift by eight: exact to about 1e-13 for x >= 1."""
    y = x + 8
    s = (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    for i in range(8):
        s = s - F.log(x + i)
    return s


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed downwards from its largest term; what lies
    more than 12 standard deviations lower is below double precision."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_lgamma(n + 1) - _lgamma(k + 1) - _lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log(1 - p))
    steps = F.least(k, 60 + 12 * F.sqrt(n)).cast("int")
    start = F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t"), k.alias("i"))
    walk = F.aggregate(
        F.sequence(F.lit(0), steps), start,
        lambda a, _: F.struct(
            (a["s"] + a["t"]).alias("s"),
            (a["t"] * a["i"] / (n - a["i"] + 1) * ((1 - p) / p)).alias("t"),
            (a["i"] - 1).alias("i")),
        lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).when(k > n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * walk))


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA,
            cost: float = COST, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """Per (stratum, rule): the certified cutoff, if any. All labelled rows count.

    ``measured`` has doc_id, stratum and the measures; ``labels`` doc_id and quality
    (repeated ids: good only if all say so; null ids or qualities are ignored)."""
    grid = grid or GRID
    truth = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"))
    rows = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cut"), (ratios()[r] > c).alias("out"))
        for r in grid for i, c in enumerate(grid[r])]))
    level = delta / max(1, len(grid) * measured.select("stratum").distinct().count())
    tallies = (
        measured.join(truth, "doc_id")
        .withColumn("held", hashed_share(F.col("doc_id")) % 2 == 1)
        .select("stratum", "held", "good", rows.alias("r"))
        .groupBy("stratum", "r.rule", "r.step", "r.cut")
        .agg(
            F.count(F.when(F.col("held") & (F.col("good") == 1), 1)).alias("n"),
            F.count(F.when(F.col("held") & (F.col("good") == 1) & F.col("r.out"), 1)).alias("k"),
            F.count(F.when(~F.col("held") & (F.col("good") == 1) & F.col("r.out"), 1)).alias("good_out"),
            F.count(F.when(~F.col("held") & (F.col("good") != 1) & F.col("r.out"), 1)).alias("bad_out"),
        )
    )
    passed = tallies.withColumns({
        "failed": binomial_tail(F.col("n"), F.col("k"), risk / len(grid)) > level,
        "gain": F.col("bad_out") - cost * F.col("good_out"),
    })
    # fixed sequence: what follows the first failure of a (stratum, rule) doesn't count
    return (
        passed.groupBy("stratum", "rule")
        .agg(F.min(F.when(F.col("failed"), F.col("step"))).alias("stop"),
             F.collect_list(F.struct("step", "cut", "gain")).alias("all"))  # one entry for each cutoff of the grid
        .select("stratum", "rule", F.filter("all", lambda s: (s["gain"] > 0) & (s["step"] < F.coalesce(F.col("stop"), F.lit(1 << 30)))).alias("ok"))
        .where(F.size("ok") > 0)
        .select("stratum", "rule", F.array_max(F.transform("ok", lambda s: F.struct(s["gain"], -s["step"], s["cut"].alias("cut"))))["cut"].alias("cut"))
    )


def _decided(docs: DataFrame, labels: DataFrame, keep: Column, stratum: str, how: dict) -> DataFrame:
    """``_row`` (what ``keep`` says of each row), doc_id, the measures, base_failed, kept.

    The measures are written once: cutoffs and verdicts both need them. Texts
    meet no shuffle; the cutoffs are a row a stratum."""
    s = F.coalesce(F.col(stratum).cast("string"), F.lit(NO_STRATUM))
    measured = materialise(measures(docs.select(keep.alias("_row"), "doc_id", s.alias("stratum"), "text")).drop("text"), "measures")
    cuts = cutoffs(measured.drop("_row"), labels, **how).groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cut"))).alias("_cuts"))  # at most one entry a rule
    over = F.lit(False)
    for rule, r in ratios().items():
        over = over | F.coalesce(r > F.element_at("_cuts", rule), F.lit(False))
    return measured.join(cuts, "stratum", "left").withColumns({"base_failed": base_failed(), "kept": ~base_failed() & ~over})


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """doc_id, the measures, ``base_failed`` and ``kept`` of every row of ``docs``.

    Null texts count as empty (base_failed); null strata form one of their own;
    repeated rows are judged alike; other columns aren't read."""
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return _decided(docs, labels, F.lit(None).cast("string"), stratum, how).select("doc_id", *made)


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **how) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they were."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _decided(docs, labels, row, stratum, how).where("kept").select("_row.*")
