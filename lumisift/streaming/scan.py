"""Extension: listings that arrive as files are applied to the stored table batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumisift.operators.decisions import upsert
from lumisift.sources.files import LISTING, Snapshots


def follow(spark: SparkSession, folder: str, store: Snapshots, checkpoint: str) -> StreamingQuery:
    """Runs over the listings there are now and stops; a batch met again leaves the table as it is."""
    def apply(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("relative_path").agg(F.max_by(F.struct("size", "mtime"), "mtime").alias("f")).select("relative_path", "f.*").withColumn("status", F.lit("active"))
        store.write(upsert(store.read(), newest))

    return spark.readStream.schema(LISTING).parquet(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
