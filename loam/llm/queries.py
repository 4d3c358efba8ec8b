"""The registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, embedding_dedup, fingerprints, language_id, lexical_search, licenses, mixing, ngram_join, secrets, token_counts, token_output, toxicity
from .common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents")).drop("name")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.held_out)
    out = F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ";") for c in ("licenses", "rules", "spdx")})


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.systematic_mix(mixing.sizes(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False))
    return language_id.predict(docs, language_id.train(docs, language_id.held_out)).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.training_order(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_embedding_near_dedup, op3_toxicity, op4_license_scan, op5_mix_sources, op6_ngram_jaccard_join,
        op7_secret_scan, op8_language_id, op9_decontamination, op10_token_output, op11_phrase_collocations, op12_document_fingerprints, op13_lexical_search,
    )
}

ORACLES: dict[str, str] = {
    "op4_license_scan": licenses.ORACLE,
    "op5_mix_sources": mixing.ORACLE,
    "op7_secret_scan": secrets.ORACLE,
    "op11_phrase_collocations": collocations.ORACLE,
    "op13_lexical_search": lexical_search.ORACLE,
}
