"""Which collections a path means, and other questions of the collection registry.

A path meets the roots that hold it through its own leading parts: an equi-join on (part = root), never a comparison of every path
with every root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leading_parts(path: Column) -> Column:
    """The path itself and every path above it, the root ``/`` left out."""
    parts = F.split(path, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.filter(every, lambda p: p != "")


def longest_prefix(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, root, rest): the deepest root of ``registry(root)`` that is or holds each of ``paths(path)``, if any does."""
    parts = paths.select("path", F.explode(leading_parts(F.col("path"))).alias("root"))
    found = parts.join(registry.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return found.withColumn("rest", F.when(F.col("path") == F.col("root"), "").otherwise(F.expr("substring(path, length(root) + 2)")))


def descendants(paths: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, root): the roots strictly below each path, for paths that no root is or holds."""
    lone = paths.select("path").distinct().join(longest_prefix(paths, registry).select("path"), "path", "left_anti")
    above = registry.select("root").distinct().select("root", F.explode(leading_parts(F.col("root"))).alias("path")).where("path <> root")
    return lone.join(above, "path").select("path", "root")


def by_id_prefix(registry: DataFrame, prefix: str) -> DataFrame:
    """The rows whose id is ``prefix``, else those it begins; more than one means it is ambiguous."""
    own = registry.where(F.col("collection_id").startswith(prefix)).withColumn("exact", F.col("collection_id") == prefix)
    best = own.withColumn("best", F.max("exact").over(W.partitionBy()))
    return best.where(F.col("exact") == F.col("best")).select("collection_id", "exact", F.count("*").over(W.partitionBy()).alias("matches"))


def combined(configs: DataFrame) -> DataFrame:
    """One row: each setting if all collections share it, else ``multiple`` (0 for the dimension)."""
    one = lambda c: F.when(F.count_distinct(c) == 1, F.first(c)).otherwise("multiple").alias(c)
    return configs.agg(
        one("provider"), one("model"), F.when(F.count_distinct("vector_dim") == 1, F.first("vector_dim")).otherwise(0).alias("vector_dim"), one("db_version"), one("file_type"),
        (F.count_distinct("provider", "model", "vector_dim") == 1).alias("mmr_compatible"),
    )


def listed(registry: DataFrame, states: DataFrame) -> DataFrame:
    """The registry with file and chunk counts and the last time indexed; a collection without states is kept with an error."""
    counts = states.groupBy("collection_id").agg(F.count("*").alias("files"), F.sum("chunk_count").alias("chunks"), F.max("last_indexed_at").alias("last"))
    return registry.join(counts, "collection_id", "left").select(
        F.substring("collection_id", 1, 12).alias("short_id"), "root", F.coalesce("files", F.lit(0)).alias("files"), F.coalesce("chunks", F.lit(0)).alias("chunks"),
        F.coalesce(F.date_format("last", "yyyy-MM-dd HH:mm"), F.lit("-")).alias("updated"), F.when(F.col("files").isNull(), "state not found").otherwise("").alias("error"),
    )


def prunable(registry: DataFrame, temporary: str = "/var/folders") -> DataFrame:
    """Collections under a temporary folder or whose state cannot be read."""
    t = F.col("root")
    there = (t == temporary) | t.startswith(temporary + "/")
    return registry.where(there | ~F.col("readable")).select("collection_id", "root", F.when(there, "temporary").otherwise("unreadable").alias("reason"))
