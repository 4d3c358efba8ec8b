"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing, training order.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last return the
columns of ``docs``. Between stages the rows are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm import decontamination, mixing, ngram_join, token_output, toxicity
from loam.llm.common import fresh, named_once, numbered, stored, table
from loam.runtime import ship


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows named in ``gone(file, row)``, by the numbers of ``common.numbered``: an id may be null or repeat.

    The names are written first: with their size known, the planner broadcasts few of them and shuffles for many.
    """
    named, file, row = numbered(docs)
    gone = stored(gone.select(F.col("file").alias(file), F.col("row").alias(row)).distinct(), "pipeline-gone")
    return named.join(gone, [file, row], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; null and empty texts stay."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.held_out)
    score = fresh(docs, "score")
    return toxicity.score(docs, model, score).where(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word Jaccard 0.8 or more hold together: one with the smallest id."""
    ship(spark)
    named = named_once(docs)
    return without(named, ngram_join.jaccard_rows(named).where("not kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item's template."""
    ship(spark)
    named = named_once(docs)
    return without(named, decontamination.contaminated_rows(named, table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    ship(spark)
    return mixing.mixed_documents(docs)


def order_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of token ids in training order."""
    ship(spark)
    return token_output.training_order(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mix_sources", mix),
    ("token_output", order_tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
