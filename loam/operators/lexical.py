"""Lexical re-ranking (BM25) over candidates, and its parts over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loam.functions import text as tx

K1, B, SEMANTIC = 1.5, 0.75, 0.7


def document_frequency(docs: DataFrame, column: str = "text") -> DataFrame:
    """(token, df): in how many rows each token is."""
    return docs.select(F.explode(F.array_distinct(tx.tokens(F.col(column)))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def rerank_text(df: DataFrame):
    """Path, titles, tags and content in one text; a missing part is an empty one."""
    titles = F.array_join("title_path", " ") if "title_path" in df.columns else F.lit("")
    return F.concat_ws(" ", F.coalesce("rel_path", F.lit("")), titles, F.coalesce(F.array_join("tags", " "), F.lit("")), F.coalesce("content", F.lit("")))


def max_normalized(score: str, *by: str):
    """The score over the largest of its group, 0 where that is not positive."""
    most = F.max(F.greatest(F.col(score), F.lit(0.0))).over(W.partitionBy(*by))
    return F.when(most > 0, F.col(score) / most).otherwise(F.lit(0.0))


def occurrences(tokens: str, wanted: Column) -> Column:
    """How often each of an array of wanted tokens is among ``tokens``, as an array."""
    return F.transform(wanted, lambda w: F.size(F.filter(tokens, lambda x: x == w)).cast("double"))


def wanted(spark: SparkSession, query_text: str) -> list[str]:
    """The distinct tokens of a query."""
    return spark.range(1).select(F.array_distinct(tx.tokens(F.lit(query_text)))).first()[0]


def rerank(candidates: DataFrame, query_text: str | Column, *by: str) -> DataFrame:
    """Candidates scored anew: 0.7 of the normalised semantic score and 0.3 of the normalised BM25 score.

    Frequencies and lengths are those of the candidates of a group. ``query_text`` is one text, or a column that is the same within a group. A query
    without tokens, or candidates without any, change nothing. Candidates are bounded by the query's window, and one row per candidate and query token is the most there is. Their
    ``chunk_id`` must be unique within ``by``.
    """
    blank = {c: F.lit(None).cast("double") for c in ("bm25_score", "bm25_norm", "semantic_norm")}
    if isinstance(query_text, str):
        asked = wanted(candidates.sparkSession, query_text)
        if not asked:
            return candidates.withColumns({"pre_rerank_score": F.col("score"), **blank})
        rows, tokens = candidates, F.array(*[F.lit(w) for w in asked])
    else:
        rows, tokens = candidates.withColumn("__asked", F.array_distinct(tx.tokens(query_text))), F.col("__asked")
        plain = rows.where(F.size("__asked") == 0).select(*candidates.columns)
        return _reranked(rows.where(F.size("__asked") > 0), candidates.columns, tokens, *by).unionByName(plain.withColumns({"pre_rerank_score": F.col("score"), **blank}))
    return _reranked(rows, candidates.columns, tokens, *by)


def _reranked(rows: DataFrame, columns: list[str], asked: Column, *by: str) -> DataFrame:
    own = F.struct(*columns).alias("__row")
    # explode keeps the tokens a column of their own: inlined, they would be made again for each wanted token
    terms = rows.select(*by, "chunk_id", own, asked.alias("__asked"), F.explode(F.array(tx.tokens(rerank_text(rows)))).alias("__t")).select(
        *by, "chunk_id", "__row", F.size("__t").cast("double").alias("__len"), F.posexplode(occurrences("__t", F.col("__asked"))).alias("__k", "__tf")
    )
    per_token = W.partitionBy(*by, "__k")
    terms = terms.withColumns(
        {"__df": F.sum(F.when(F.col("__tf") > 0, 1.0).otherwise(0.0)).over(per_token), "__n": F.count("*").over(per_token).cast("double"), "__avg": F.avg("__len").over(per_token)}
    )
    idf = F.log(1 + (F.col("__n") - F.col("__df") + 0.5) / (F.col("__df") + 0.5))
    term = idf * (F.col("__tf") * (K1 + 1)) / (F.col("__tf") + K1 * (1 - B + B * F.col("__len") / F.col("__avg")))
    found = terms.groupBy(*by, "chunk_id").agg(
        F.first("__row").alias("__row"), F.first("__avg").alias("__avg"), F.sum(F.when(F.col("__tf") > 0, term).otherwise(0.0)).alias("bm25_score")
    ).select("__row.*", "__avg", "bm25_score").withColumn("__sem", F.greatest("score", F.lit(0.0)))
    found = found.withColumns({"bm25_norm": max_normalized("bm25_score", *by), "semantic_norm": max_normalized("__sem", *by), "pre_rerank_score": F.col("score")})
    blended = SEMANTIC * F.col("semantic_norm") + (1 - SEMANTIC) * F.col("bm25_norm")
    return found.withColumn("score", F.when(F.col("__avg") > 0, blended).otherwise(F.col("score"))).drop("__avg", "__sem")
