"""Exact deduplication as a stream over keyed state that never expires.

1. Every row lands in a table of the shared folder with the digest of its normalised text.
   Its place there (file and row number) is its content locator.
2. A stream reads the digests of the landed files in micro-batches. Its state, kept by
   RocksDB on the executors' disks and in the checkpoint, holds per digest the first row
   seen by id (its stable identifier and content locator) and the number of rows. Spark sums
   each batch's rows of a digest before the shuffle, so a digest of a third of all rows
   stays cheap. A later run on the same state folder goes on where this one ended.
3. A hit is a row whose digest has another keeper. Its whole text is compared with the
   text at the keeper's locator; rows that differ (a digest collision) are grouped by
   their whole text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_IDS, Scratch, col

WHITE = r"[\x20\x09-\x0D]+"
LAST = (1 << 63) - 1
#: Landed files of one micro-batch.
FILES_PER_BATCH = 256


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(landed: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns of landed rows, and their locator: the file's name, which is unique, and the row's number in it."""
    return landed.select(*columns, F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias("locator"))


def keyed_state(spark: SparkSession, folder: str, schema, files_per_batch: int) -> DataFrame:
    """digest, first (order_id, locator), group_size: the stream's state after the last landed file under `folder`."""
    settings = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.unloadOnCommit": "true",  # no store stays in an executor's memory after its task
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space laid out ahead
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    given = spark.conf.getAll
    before = {k: given.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/landed/*")
        state = located(rows, "digest", "order_id").groupBy("digest").agg(F.min(F.struct("order_id", "locator")).alias("first"), F.count("*").alias("group_size"))

        def keep_batch(changed: DataFrame, batch: int) -> None:
            changed.write.mode("overwrite").parquet(f"{folder}/state/batch={batch}")

        state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/stream").trigger(availableNow=True).foreachBatch(keep_batch).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    changes = spark.read.schema("digest binary, first struct<order_id: bigint, locator: string>, group_size bigint").parquet(f"{folder}/state")
    return changes.groupBy("digest").agg(F.min("first").alias("first"), F.max("group_size").alias("group_size"))


def collided(everything: DataFrame, repeated: DataFrame, scratch: Scratch, run: str) -> DataFrame:
    """A digest for each hit of this run whose full bytes differ from those at the keeper's locator. No aggregate follows the join: it would keep Spark from splitting a large key."""
    keepers = repeated.select(F.col("first.locator").alias("locator"))
    if keepers.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4:
        repeated, keepers = F.broadcast(repeated), F.broadcast(keepers)
    # only texts that are compared are normalised again
    kept = located(everything, "digest", "text").join(keepers, "locator", "left_semi").select("digest", normalised(F.col("text")).alias("keeper"))
    kept = scratch.save(kept, "keepers")  # so that the join reads two plain shuffles, of which Spark can split a large key
    hits = located(everything.where(F.col("run") == run), "digest", "text").join(repeated.select("digest", "first"), "digest").where("locator <> first.locator")
    return scratch.save(hits.select("digest", normalised(F.col("text")).alias("norm")), "hits").join(kept, "digest").where("norm <> keeper").select("digest")


def regrouped(everything: DataFrame, decided: DataFrame, wrong: DataFrame) -> DataFrame:
    """The decisions, grouped by the whole text itself for the digests that collided."""
    rows = located(everything, "digest", "order_id", normalised(F.col("text")).alias("norm")).join(wrong, "digest", "left_semi")
    groups = rows.groupBy("norm").agg(F.min(F.struct("order_id", "locator")).alias("first"), F.count("*").alias("group_size"))
    right = rows.join(groups, "norm").select("locator", F.col("first").alias("new"), F.col("group_size").alias("size"))
    return decided.join(right, "locator", "left").select("doc_id", "locator", "digest", "text_sha256", F.coalesce("new", "first").alias("first"), F.coalesce("size", "group_size").alias("group_size"))


def landed_decisions(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column], files_per_batch: int, state: str | None) -> tuple[DataFrame, DataFrame, Scratch]:
    """(the decisions of `docs` by locator, the landed rows of `docs` with each whole row as `doc`, the scratch tables)."""
    spark = docs.sparkSession
    scratch, run = Scratch(spark, "exact-dedup"), uuid.uuid4().hex
    folder = state.rstrip("/") if state else scratch.root
    rows = docs.select(F.struct(*(col(c) for c in docs.columns)).alias("doc"), col(id_col).cast("long").alias("doc_id"), normalised(col(text_col)).alias("norm"), F.lit(run).alias("run"))
    # the text is stored once, inside the whole row
    text = F.col("doc").getField(text_col).cast("string")
    rows = rows.select("doc", "doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("order_id"), digest(F.col("norm")).alias("digest"), F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "run")
    rows.write.parquet(f"{folder}/landed/{run}")
    mine = spark.read.schema(rows.schema).parquet(f"{folder}/landed/{run}")
    everything = spark.read.schema(rows.schema).parquet(f"{folder}/landed/*")
    if mine.limit(1).count():
        found = keyed_state(spark, folder, rows.schema, files_per_batch)
    else:
        found = located(mine, "digest", "order_id").groupBy("digest").agg(F.min(F.struct("order_id", "locator")).alias("first"), F.count("*").alias("group_size"))
    repeated = scratch.save(found.where("group_size > 1"), "repeated")
    own = F.struct("order_id", "locator")
    decided = located(mine, "doc_id", "order_id", "digest", "text_sha256").join(repeated, "digest", "left")
    decided = decided.select("doc_id", "locator", "digest", "text_sha256", F.coalesce("first", own).alias("first"), F.coalesce("group_size", F.lit(1)).alias("group_size"))
    texts = everything.withColumn("text", text)
    wrong = scratch.save(collided(texts, repeated, scratch, run), "collided")
    scratch.drop("hits", "keepers", "stream")
    if wrong.limit(1).count():
        decided = regrouped(texts, decided, wrong.distinct())
    return decided, mine, scratch


def decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, files_per_batch: int = FILES_PER_BATCH, state: str | None = None
) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, locator (of the row that stays).

    Texts are equal when identical after each run of white space becomes one space; null
    counts as empty. Of equal texts the row with the smallest id stays, a null id counting
    as the largest; of repeated rows with one id, one stays. An empty table gives no rows.
    Other columns are ignored, whatever their names. With `state`, a shared folder, the
    rows also meet those of earlier calls on that folder, and are kept for later ones.
    """
    decided, _, _ = landed_decisions(docs.select(col(id_col), col(text_col)), id_col, text_col, digest, files_per_batch, state)
    return decided.select(
        "doc_id",
        F.when(F.col("first.order_id") < LAST, F.col("first.order_id")).alias("keep_id"),
        "group_size",
        (F.col("locator") == F.col("first.locator")).alias("kept"),
        "text_sha256",
        F.col("first.locator").alias("locator"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row, that of the smallest id, of each text; all columns stay, whatever their names.

    Null and empty texts are one text, of which one row stays; a null id counts as the
    largest. An empty table stays empty.
    """
    decided, mine, scratch = landed_decisions(docs, id_col, text_col, sha256, FILES_PER_BATCH, None)
    gone = scratch.save(decided.where("locator <> first.locator").select("locator"), "gone")
    if gone.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4:
        gone = F.broadcast(gone)
    kept = located(mine, "doc").join(gone, "locator", "left_anti")
    return kept.select(*(F.col("doc").getField(c).alias(c) for c in docs.columns))
