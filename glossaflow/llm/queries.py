"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_extraction, language_id, mixing, ngram_join, oracles, packing, periodic_runs, piece_table, quality_rules, ranked_search, simhash, substring_dedup, suffix_dedup, token_counts

#: The vocabulary's special string with its id, and the id that ends a packed document.
VOCABULARY = packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))
END_ID = 2


#: Margins of the mixture: rare sources, languages and topics weigh more than their share.
MARGINS = [mixing.Margin("source", power=0.5), mixing.Margin("lang", power=0.7), mixing.Margin("topic", power=0.9)]
TOPICS = {
    "legal": ["license", "licence", "copyright", "rights", "warranty", "terms", "mit", "apache"],
    "commerce": ["buy", "price", "sale", "order", "shop", "casino", "win"],
    "contact": ["mail", "email", "phone", "call", "www", "com", "org"],
    "code": ["def", "return", "class", "import", "var", "function"],
}
KEEP = 0.7


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), VOCABULARY, END_ID, 1024)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.with_components(documents(spark, sf_dir), ngram_join.Join(3, 90, 100)).drop("dh")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compared(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), 1_500_000)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.with_token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 512)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(documents(spark, sf_dir), MARGINS, TOPICS, KEEP, vocabulary=VOCABULARY)
    value = lambda c: F.when(F.col(c) != mixing.NULL, F.col(c))
    return mixed.select("doc_id", value("_source").alias("source"), value("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").cast("long").alias("n_tokens"), F.col("_probability").alias("probability"), F.col("_kept").alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures", "policy", "only_failure")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir), suffix_dedup.Shape(400, 128, "byte"), with_text=True)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(documents(spark, sf_dir), substring_dedup.Shape(20, 5, "word"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.with_runs(periodic_runs.with_planted(documents(spark, sf_dir)), periodic_runs.Least(6, 4)))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


def op13_piece_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = piece_table.encoded(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
    return made.select("doc_id", F.floor(F.octet_length("ids") / 4).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_pack, op2_ngram_join, op3_simhash, op4_language_id, op5_html_extraction, op6_token_counts, op7_mixing, op8_quality_rules, op9_suffix_dedup, op10_substring_dedup, op11_periodic_runs, op12_ranked_search, op13_piece_table)}
ORACLES: dict[str, str] = {"op2_ngram_join": oracles.NGRAM_JOIN, "op8_quality_rules": oracles.QUALITY_RULES, "op9_suffix_dedup": oracles.SUFFIX_DEDUP, "op10_substring_dedup": oracles.SUBSTRING_DEDUP, "op12_ranked_search": oracles.RANKED_SEARCH}
