"""URL filters: explicit host and path rules, then mined association rules.

Tokens of a url are its host labels (``h:``), path segments (``p:``) and query
keys (``q:``). Spark's FP-growth mines the token combinations of labelled urls
that go with a bad label; rules with enough support and confidence form an
inverted index from token to rule. A url is blocked when it holds every token of
some rule. Explicit rules, the longest first, override the mined ones.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinespark.llm.text import ascii_lower

#: (verdict, host with its subdomains, path prefix)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.7
_BAD = "=bad"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #``; A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a url; none for a null or one without ``://``."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    parts = lambda tag, xs: F.transform(F.filter(xs, lambda x: x != ""), lambda x: F.concat(F.lit(tag), x))
    found = F.array_distinct(F.concat(
        parts("h:", F.split(host_of(url), r"\.")),
        parts("p:", F.split(path_of(url), "/")),
        parts("q:", F.transform(F.split(query, "&"), lambda x: F.regexp_extract(x, "^([^=]*)", 1))),
    ))
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0, found).otherwise(F.array().cast("array<string>"))


def explicit(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    hits = F.array(*[
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p),
               F.struct(F.lit(len(h + p)).alias("len"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for v, h, p in rules])
    return F.array_max(hits)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, n_tokens, confidence, support) from rows of (url, bad).

    Rows with a null label or without tokens are ignored; with no bad row there is no rule."""
    rows = labelled.where("bad IS NOT NULL").withColumn("tokens", tokens_of(F.col("url"))).where(F.size("tokens") > 0)
    baskets = rows.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(_BAD))).otherwise(F.col("tokens")).alias("items"))
    if not rows.where("bad").take(1):
        found = rows.sparkSession.createDataFrame([], "tokens array<string>, confidence double, support double")
    else:
        model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
        found = model.associationRules.where(F.element_at("consequent", 1) == _BAD).select(F.col("antecedent").alias("tokens"), "confidence", "support")
    return found.select(F.xxhash64(F.array_join(F.array_sort("tokens"), "\n")).alias("rule_id"), "tokens", F.size("tokens").alias("n_tokens"), "confidence", "support")


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls that hold every token of some rule, by the inverted index."""
    index = rules.select("rule_id", "n_tokens", F.explode("tokens").alias("token"))
    held = urls.select("url").where("url IS NOT NULL").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    return held.join(index, "token").groupBy("url", "rule_id", "n_tokens").count().where("count = n_tokens").select("url").distinct()


def judge(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, **how) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    Null urls and urls without ``://`` have empty host and path, fit no rule and are
    allowed; repeated rows are judged alike; columns of those names are replaced."""
    bad = matched(pages, mine(labelled, **how)).withColumn("_bad", F.lit(True))
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    hit = explicit(F.col("host"), F.col("path"), rules)
    return (
        out.withColumn("_hit", hit).join(bad, "url", "left")
        .withColumns({"rule": F.col("_hit.rule"), "verdict": F.coalesce(F.col("_hit.verdict"), F.when(F.col("_bad"), "block").otherwise("allow"))})
        .drop("_hit", "_bad")
    )
