"""The numbered queries: each applies its operator to its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, materialize, table
from .decontaminate import contamination
from .katz import katz_scores
from .licences import NOTICES, exact_phrase, licence_labels
from .merkle import digest_of, folded, merkle_manifest, proof_digest
from .mixing import mix_sources
from .neardup_embeddings import near_duplicate_vectors
from .ngram_join import jaccard_components
from .oracle import ORACLE_SQL  # noqa: F401
from .quality import fit_quality, score_quality
from .token_counts import token_counts
from .token_store import token_digests
from .toxicity import fit_toxicity, score_toxicity
from .url_rules import UrlRule, judge_urls
from .vector_codes import digest_codebooks, label_errors, product_codes

URL_RULES = [
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
]


def mix_levels() -> dict[str, Column]:
    """The tree of the mixture: a domain by the name of the source, then language, then source."""
    return {"domain": F.when(F.col("source").rlike("^src[0-9]$"), "web").otherwise("curated"), "lang": F.col("lang"), "source": F.col("source")}


MIX_WEIGHTS = {
    (domain, *lang): w
    for domain, d in (("web", 0.6), ("curated", 0.4))
    for lang, w in {(): d, ("en",): 0.5, ("de",): 0.2, ("fr",): 0.2, ("es",): 0.1, ("(none)",): 0.01}.items()
}


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_toxicity(documents, labels, crc_mod("doc_id", 3) != 1)
    return _judged(score_toxicity(documents, model), crc_mod("doc_id", 3) == 1)


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), mix_levels(), MIX_WEIGHTS, share=0.8, max_epochs=2)
    return got.select("doc_id", "mix_domain", "mix_lang", "mix_source", "mix_epoch", "mix_tokens", "mix_take")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, block_bytes=4 << 20)
    return got.withColumnRenamed("id", "doc_id")


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), words_each=3, percent=90)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return token_counts(table(spark, sf_dir, "documents"), path, pattern, fields=("source", "lang", "text"), rule="majority", separator=" ")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = fit_quality(documents, labels, crc_mod("doc_id", 4) != 2)
    return _judged(score_quality(documents, model), crc_mod("doc_id", 4) == 2)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = crc_mod("doc_id", 10)
    return katz_scores(table(spark, sf_dir, "documents"), turn != 0, order=3).withColumn("held_out", F.coalesce(turn == 0, F.lit(False)))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    hashed = lambda n_chars: digest_of([F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")])
    altered = F.when((crc_mod("doc_id", 7) == 0) & F.col("n_chars").isNotNull(), hashed(F.col("n_chars").cast("decimal(20,0)") + 1))
    leaves = documents.select("doc_id", "lang", hashed(F.col("n_chars")).alias("leaf"), altered.alias("altered"))
    proved = merkle_manifest(leaves, "lang", ["doc_id", "leaf"], "leaf")
    proved = proved.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("way")))
    return proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("way")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The places that are counted; their labels stay whatever the notices add.
BASE_PHRASES = [exact_phrase("cc by", "cc-by"), exact_phrase("general public license", "gpl"), exact_phrase("all rights reserved", "reserved")]


def op12_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_labels(table(spark, sf_dir, "documents"), [*BASE_PHRASES, *NOTICES])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, codebooks = product_codes(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256.0)
    coded = label_errors(materialize(coded)).withColumn("codebooks_sha256", F.lit(digest_codebooks(codebooks)))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES = {f.__name__: f for f in (op1_embedding_near_dedup, op2_toxicity, op3_url_rules, op4_source_mixing, op5_decontamination, op6_token_store, op7_ngram_jaccard, op8_token_counts, op9_quality, op10_katz, op11_merkle_manifest, op12_licence_scan, op13_vector_codes)}
