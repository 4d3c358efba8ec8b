"""What several operators share: reading tables, cutting lineage, joining components."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = os.path.join(tempfile.gettempdir(), "checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the shared folder: for the small frames of iterations.

    Columns get identities of their own, so the result joins with frames it was made from.
    """
    shared_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    return done.select(*[F.col(c).alias(c) for c in done.columns])


def stored(df: DataFrame, name: str, codec: str = "zstd", **options) -> DataFrame:
    """Write once to the shared folder, read back: for results that several later jobs read. ``options`` are the writer's."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(compression=codec, **options).parquet(path)
    return spark.read.parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame) -> tuple[DataFrame, str, str]:
    """``df`` with two numbers that together name each row, and their columns' names.

    Of Parquet files they are a hash of the file's name and the row's place in it, so every later read has the same;
    anything else is written once with numbers of its own.
    """
    file, row = fresh(df, "row_file"), fresh(df, "row_place")
    try:
        hidden = df.metadataColumn("_metadata")
        return df.select("*", F.xxhash64(hidden["file_path"]).alias(file), hidden["row_index"].alias(row)), file, row
    except AnalysisException:
        return stored(df.select("*", F.lit(0).cast("long").alias(file), F.monotonically_increasing_id().alias(row)), "numbered"), file, row


def named_once(df: DataFrame) -> DataFrame:
    """``df`` as rows of Parquet files, so that ``numbered`` names its rows alike however often it is asked: itself, if it is that, or written."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df
    except AnalysisException:
        return stored(df, "rows")


def as_table(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The named column of a batch with 64-bit offsets dropped and offset zero."""
    col = batch.column(batch.schema.get_field_index(name))
    return col if col.type == pa.string() else col.cast(pa.string())


def give_back() -> None:
    """Freed memory goes back to the system: a Python worker outlives its tasks, and what it keeps counts as its executor's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def giving_back(of: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``of`` for ``mapInArrow``, with ``give_back`` after each task."""

    @functools.wraps(of)
    def run(batches):
        yield from of(batches)
        give_back()

    return run


def is_forest_of_stars(edges: DataFrame) -> bool:
    """Does every ``a`` hang under one ``b``, and no ``b`` under another? Then nothing is left to join."""
    return (
        edges.groupBy("a").count().where("count > 1").isEmpty()
        and edges.select("b").join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: rows (node, root), root the smallest node reachable, without the roots.

    Each round hangs every node's larger neighbours, and the node itself, under its smallest
    neighbour, then hangs each node's smaller neighbours under the smallest of them. Edges stay
    linear in their first number, rounds logarithmic in the nodes. A round reads the last one's
    checkpoint, so a lost executor costs one round. Nulls and self-loops in ``edges`` are passed
    over; an empty input gives an empty result.
    """
    cur = checkpointed(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    )
    while not is_forest_of_stars(cur):
        both = cur.select("a", "b").union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # cut here: joined with a plain table, a node with very many neighbours is split over tasks by adaptive execution
        low = checkpointed(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")))
        large = (
            both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.where("m < a").select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select("a", F.col("m").alias("b")))
            .where("a <> b")
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        )
        cur = checkpointed(small)
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
