"""Mixing sources to target weights by systematic sampling.

``source_targets`` shares a budget of words over sources by weight, each capped at a multiple of
what it has, the excess reshared by weight. ``systematic_mix`` gives every document of a source
the same expected copies, target / size of the source; it sums them up in a fixed order, adds one
offset per source and emits a document once for every integer the running sum crosses.

The running sum is not taken in one window per source, for a source may hold a third of all rows:
documents go to about sqrt(n) buckets per source by a hash of their id and text, bucket counts are summed
up (one small row per bucket), and ranks within a bucket follow from size and id. Only rows alike in id and text share a bucket whatever
their number; null ids do not.

Defined cases: a null text has size 0; sizes count runs of characters outside space and
tab to carriage return. Null is a source of its own, last in order; null ids sort first in their bucket;
equal rows are separate documents; a source without words has target 0 and no copies; an empty
table gives an empty result; other columns, whatever their names, pass through ``mixed_documents`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, numbered, stored

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words as the mix counts them; every word has its own end, a character not followed by another."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fraction(value: Column) -> Column:
    """A fixed number in [0, 1) from a string, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(value), 1, 8), 16, 10).cast("double") / 4294967296.0


def source_targets(totals: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, n, target) from ``totals(source, source_size, n)``, one row per source.

    Sources take ``weights`` in turn by code point, null last. In order of cap / weight, a source
    is capped if the share that would be left for it per unit of weight reaches its cap. One
    window over one row per source.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    ranked = ranked.withColumn(
        "level",
        (F.sum("source_size").over(every) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    ).withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("level")))).over(every)["level"]
    return ranked.select(
        "source", "source_size", "n", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight")).alias("target")
    )


def sizes(docs: DataFrame, *more: str) -> DataFrame:
    """What ``systematic_mix`` needs of ``docs(doc_id, source, text)``: the size of each row and a mark of its text."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", "source", word_count(text).alias("size"), F.md5(F.coalesce(text, F.lit(""))).alias("mark"), *more)


def systematic_mix(sized: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", more: Sequence[str] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, *more) per row of ``sized(doc_id, source, size, mark, *more)``."""
    mark = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.col("mark") if "mark" in sized.columns else F.lit(""))
    hashed = F.conv(F.substring(F.md5(mark), 1, 8), 16, 10).cast("long")
    sized = stored(sized.select("doc_id", "source", "size", hashed.alias("hashed"), *more), "sizes")  # read four times below; the texts are read once
    more = [f"d.{c}" for c in more]
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(totals, weights, share, most).withColumn("buckets", F.ceil(F.sqrt("n")))
    same = F.col("d.source").eqNullSafe(F.col("t.source"))
    placed = sized.alias("d").join(targets.alias("t"), same).select(
        "d.doc_id", "d.source", "d.size", "t.source_size", "t.target", F.pmod("d.hashed", "t.buckets").alias("bucket"), *more
    )
    counts = placed.groupBy("source", "bucket").agg(F.count("*").alias("in_bucket"))
    starts = counts.select(
        "source", "bucket",
        F.coalesce(F.sum("in_bucket").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"),
    )
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy("source", "bucket").orderBy("size", "doc_id")))
    rate = F.when(F.col("d.source_size") > 0, F.col("d.target") / F.col("d.source_size")).otherwise(F.lit(0.0))
    position = F.col("s.before") + F.col("d.rank")
    offset = fraction(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("d.source"), F.lit("\u0000"))))
    copies = F.floor(offset + position * rate) - F.floor(offset + (position - 1) * rate)
    return ranked.alias("d").join(starts.alias("s"), same_bucket()).select(
        "d.doc_id", "d.source", "d.size", "d.source_size", "d.target", copies.cast("long").alias("copies"), *more
    )


def same_bucket() -> Column:
    return F.col("d.source").eqNullSafe(F.col("s.source")) & (F.col("d.bucket") == F.col("s.bucket"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it.

    Rows meet their copies by the numbers that name them (``common.numbered``), so equal rows and rows without an id are dealt theirs one by one.
    """
    named, file, row = numbered(docs)
    taken = systematic_mix(sizes(named, file, row), more=(file, row), **how).where("copies > 0")
    copies, copy = fresh(named, "copies"), fresh(named, "copy")
    taken = taken.select(file, row, F.col("copies").cast("int").alias(copies))
    met = named.join(taken.hint("shuffle_hash"), [file, row])  # texts are shuffled, not sorted
    return met.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


#: The same in SQL, for the query over documents.
ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(text, '')) AS mark FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n FROM sized GROUP BY source
), ranked AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)] AS weight, source_size * 2.0::DOUBLE AS cap FROM totals
), levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ranked WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, ceil(sqrt(n))::BIGINT AS buckets,
    CASE WHEN level * weight >= cap THEN cap
         ELSE (min(CASE WHEN level * weight < cap THEN {'r': cap / weight, 'level': level} END) OVER ()).level * weight END AS target
  FROM levels
), placed AS (
  SELECT d.*, t.source_size, t.target, ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || '|' || d.mark), 1, 8))::BIGINT % t.buckets AS bucket
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), positions AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY bucket, size, doc_id NULLS FIRST) AS position,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off
  FROM placed
)
SELECT doc_id, size, source_size, target, (floor(off + position * rate) - floor(off + (position - 1) * rate))::BIGINT * size AS taken FROM positions
"""
