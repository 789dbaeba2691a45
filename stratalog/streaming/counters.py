"""Access counts of a stream of reads by hour, and totals of a stream of changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_counts(reads: DataFrame, late: str = "1 hour") -> DataFrame:
    """hash, hour, n, last of a stream (or table) of reads (hash, ts); reads that come later than `late` after newer ones do not count in a stream."""
    stamped = reads.withColumn("ts", F.col("ts").cast("timestamp"))
    if reads.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    counts = stamped.groupBy("hash", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    return counts.select("hash", F.col("w.start").alias("hour"), "n", "last")


def read_events(spark, folder: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def settle(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there, append its finished rows to a folder, and end; a later call goes on from the checkpoint."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def numbered(changes: DataFrame, scope: str, order: list[str], start: int = 0) -> DataFrame:
    """A batch of changes with the sequence number of each in its scope, after `start`."""
    from pyspark.sql.window import Window

    return changes.withColumn("seq", (F.row_number().over(Window.partitionBy(scope).orderBy(*order)) + start).cast("long"))
