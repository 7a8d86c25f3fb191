"""A training corpus from raw documents, in five stages; each is written before the next begins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm.common import crc_mod, materialize, table
from assayloom.llm.decontaminate import decontaminated
from assayloom.llm.mixing import mix_sources
from assayloom.llm.ngram_join import jaccard_components
from assayloom.llm.queries import MIX_WEIGHTS, mix_levels
from assayloom.llm.token_store import token_digests
from assayloom.llm.toxicity import fit_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.7 or more; learns as query op2 does.

    Null and empty texts stay unless the bias alone reaches 0.7; repeated rows are judged alike.
    Without labels every score is 0.5 and all stay.
    """
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return score_toxicity(docs, model, "toxicity_score").where("toxicity_score < 0.7").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of texts linked at Jaccard 0.8 of 5-word shingles.

    Empty texts and null ids are no duplicates of anything. Of rows that repeat an id, the one whose
    columns come first in order, text before the others, stays.
    """
    groups = materialize(jaccard_components(docs, words_each=5, percent=80))
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = groups.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return left
    order = ["text", *[c for c in docs.columns if c not in ("doc_id", "text")]]
    first = left.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("row")).select("doc_id", "row.*")
    return left.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage similar to a benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of domains, languages and sources, as many words as came in, in two epochs at most.

    Null languages and sources are branches of their own; texts without words come with those
    around them. A document taken in both epochs comes twice.
    """
    taken = mix_sources(docs, mix_levels(), MIX_WEIGHTS, share=1.0, max_epochs=2)
    return taken.withColumn("n_chars", F.when(F.col("mix_take") < F.col("mix_tokens"), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the token store, as read back and verified."""
    return token_digests(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing", mix),
    ("token store", store_tokens),
]

#: Scores, links and ids are not SQL's to express; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
