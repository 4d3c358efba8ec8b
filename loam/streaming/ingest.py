"""An extension without a counterpart: files that arrive as a stream are indexed batch by batch.

Each micro-batch is one incremental scan without reconciling, so a batch that is run again finds its files unchanged and skips them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loam.functions.hashing import Recipe
from loam.jobs.index import Collection, Store, scan

ARRIVALS = "rel_path string, content string, arrived timestamp"


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of Parquet files of ``ARRIVALS``. Nothing is dropped here: a version that comes again may be a revert, and the
    scan skips files that are as they were."""
    return spark.readStream.schema(ARRIVALS).parquet(folder).withColumn("file_hash", F.sha2("content", 256))


def ingest(stream: DataFrame, store: Store, recipe: Recipe, collection: Collection, checkpoint: str) -> StreamingQuery:
    def batch(df: DataFrame, _: int) -> None:
        latest = df.groupBy("rel_path").agg(F.max_by(F.struct("content", "file_hash"), "arrived").alias("r")).select("rel_path", "r.*")
        scan(store, latest.withColumn("collection_id", F.lit(collection.collection_id)), recipe, [collection], reconcile=False)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
