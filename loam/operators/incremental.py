"""What an incremental scan does, as joins of files, states and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reasons(**checks: Column) -> Column:
    """The names of the checks that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def marked(files: DataFrame, states: DataFrame, recipe_hash: Column | str, force: bool = False, keys: Sequence[str] = ("rel_path",), carry: Sequence[str] = ()) -> DataFrame:
    """``files(*keys, file_hash, ...)`` with ``action`` (skip or update), ``reasons`` and the columns ``carry`` of their states; each file is looked at once."""
    recipe = F.lit(recipe_hash) if isinstance(recipe_hash, str) else recipe_hash
    prior = states.select(*keys, F.col("file_hash").alias("old_hash"), F.col("recipe_hash").alias("old_recipe"), F.lit(True).alias("known"), *carry)
    joined = files.join(prior, list(keys), "left")
    why = reasons(
        missing_state=F.col("known").isNull(),
        file_hash_changed=~F.col("file_hash").eqNullSafe(F.col("old_hash")),
        recipe_changed=~recipe.eqNullSafe(F.col("old_recipe")),
    )
    out = joined.withColumn("reasons", why).drop("old_hash", "old_recipe", "known")
    return out.withColumn("action", F.when(F.lit(force) | (F.size("reasons") > 0), "update").otherwise("skip"))


def plan(files: DataFrame, states: DataFrame, recipe_hash: Column | str, force: bool = False, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """(*keys, action, reasons) of each of ``files(*keys, file_hash)``: skip, or update and why."""
    return marked(files.select(*keys, "file_hash"), states, recipe_hash, force, keys).select(*keys, "action", "reasons")


def deleted(states: DataFrame, files: DataFrame, keys: Sequence[str] = ("rel_path",)) -> DataFrame:
    """States whose file is gone."""
    return states.join(files.select(*keys).distinct(), list(keys), "left_anti")


def rebuild_reasons(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(collection_id, reasons) where a stored configuration differs from the current one."""
    fields = ("provider", "model", "splitter", "vector_dim", "db_version")
    both = stored.alias("s").join(current.alias("c"), "collection_id")
    why = reasons(**{f"{f}_changed": ~F.col(f"s.{f}").eqNullSafe(F.col(f"c.{f}")) for f in fields})
    return both.select("collection_id", why.alias("reasons")).where(F.size("reasons") > 0)


def upsert(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; of rows of ``new`` with one key, the last by ``created_at``."""
    latest = new
    if "created_at" in new.columns:
        others = [c for c in new.columns if c != key]
        latest = new.groupBy(key).agg(F.max_by(F.struct(*others), F.struct("created_at")).alias("r")).select(key, "r.*").select(*new.columns)
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def without_source(chunks: DataFrame, source: str) -> DataFrame:
    return chunks.where(~F.col("source").eqNullSafe(F.lit(source)))


def embedded(chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with their vectors, chunks that have none)."""
    return chunks.join(embeddings, "chunk_id"), chunks.join(embeddings.select("chunk_id"), "chunk_id", "left_anti")


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts of a scan from ``outcomes(status)``; processed files are those skipped or updated."""
    count = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(
        (count("skipped") + count("updated")).alias("processed"), count("skipped").alias("skipped"), count("updated").alias("updated"),
        count("deleted").alias("deleted"), count("error").alias("errors"),
    )
