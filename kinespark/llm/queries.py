"""The registered queries of the numbered operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.llm import decontam, doubling, gru_lm, hard_negatives, html_diff, license_scan, mixing, ngram_join, quality_rules, token_count, token_store, url_rules, variants
from kinespark.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_source_mix(spark, sf_dir):
    """Words taken of each document by the capped mix."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op5_quality_rules(spark, sf_dir):
    """Measures and verdict of each document under certified cutoffs."""
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_url_rules(spark, sf_dir):
    """Verdict of each page's url; the labels of the page's number train the miner."""
    pages, labels = table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels")
    labelled = pages.join(labels, F.col("page_id") == F.col("doc_id")).select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_rules.judge(pages, labelled).select("page_id", "host", "path", "rule", "verdict")


@query
def op6_token_counts(spark, sf_dir):
    """Bytes and byte-level tokens of each document."""
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_token_store(spark, sf_dir):
    """Place, length and checksum of each document's ids, read back from the files."""
    return token_store.store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_page_text(spark, sf_dir):
    """Main text of each page."""
    return html_diff.extract(table(spark, sf_dir, "pages"))


@query
def op8_benchmark_leaks(spark, sf_dir):
    """Benchmark items found in each document."""
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op2_ngram_join(spark, sf_dir):
    """Component of each document under shingle similarity."""
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op4_gru_scores(spark, sf_dir):
    """Log-probability of each document under the recurrent model and under counts."""
    return gru_lm.score(table(spark, sf_dir, "documents"))


@query
def op9_license_scan(spark, sf_dir):
    """Licence notices of each document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query
def op11_substring_dedup(spark, sf_dir):
    """What is left of each document without passages of 35 words that occur twice."""
    return doubling.drop_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op12_spelling_variants(spark, sf_dir):
    """Words of all documents with their form and root."""
    return variants.group_variants(table(spark, sf_dir, "documents"))


@query
def op13_hard_negatives(spark, sf_dir):
    """Negatives just below each positive of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)
