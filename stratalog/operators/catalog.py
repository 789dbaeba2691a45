"""Replicas, usage, garbage and stripes of a chunk catalog: joins and grouped sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def copies(chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """`chunks` with the number of drives that hold each, 0 included. `locations` has each pair of chunk and drive once."""
    held = locations.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    return chunks.join(held, "chunk_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))


def replica_audit(volumes: DataFrame, chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """Per volume: committed chunks, those below the least number of copies, those without any, and the fewest copies."""
    per = copies(chunks.where("committed"), locations).groupBy("volume_id", "copies").agg(F.count("*").alias("n"))
    low = F.col("copies") < F.col("min_copies")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return volumes.join(per, "volume_id", "left").groupBy("volume_id", "name").agg(count(F.lit(True)).alias("chunks"), count(low).alias("below_min"), count(F.col("copies") == 0).alias("lost"), F.min("copies").alias("fewest"))


def volume_usage(volumes: DataFrame, files: DataFrame, file_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per volume: attached files and their logical bytes, and physical bytes with every chunk once."""
    sizes = file_chunks.join(chunks.select("chunk_id", "stored_size"), "chunk_id").groupBy("file_id").agg(F.sum("stored_size").alias("bytes"))
    logical = files.where("not detached").join(sizes, "file_id", "left").groupBy("volume_id").agg(F.count("*").alias("files"), F.sum(F.coalesce("bytes", F.lit(0))).alias("logical_bytes"))
    physical = chunks.groupBy("volume_id").agg(F.count("*").alias("chunks"), F.sum("stored_size").alias("physical_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return volumes.join(logical, "volume_id", "left").join(physical, "volume_id", "left").select("volume_id", *map(zero, ("files", "logical_bytes", "chunks", "physical_bytes")))


def drive_usage(drives: DataFrame, chunks: DataFrame, locations: DataFrame) -> DataFrame:
    """Per drive: bytes in use and bytes free; no free bytes are named for a drive without a limit."""
    used = locations.join(chunks.select("chunk_id", "stored_size"), "chunk_id").groupBy("drive_id").agg(F.sum("stored_size").alias("used"))
    out = drives.join(used, "drive_id", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    free = F.when(F.col("capacity_bytes") > 0, F.greatest(F.lit(0), F.col("capacity_bytes") - F.col("used")))
    return out.select("drive_id", "node", "tier", "state", "capacity_bytes", "used", free.alias("available"))


def tier_usage(usage: DataFrame) -> DataFrame:
    """Per tier: use, capacity of limited drives, their ratio, spread of the drives' ratios, and free bytes outside draining drives (null if one has no limit)."""
    limited = F.col("capacity_bytes") > 0
    ratio = F.when(limited, F.col("used") / F.col("capacity_bytes"))
    open_ = F.col("state") != "draining"
    return usage.groupBy("tier").agg(
        F.sum("used").alias("used"),
        F.sum("capacity_bytes").alias("capacity"),
        F.round(F.coalesce(F.sum(F.when(limited, F.col("used"))) / F.sum("capacity_bytes"), F.lit(0.0)), 6).alias("ratio"),
        F.round(F.max(ratio) - F.min(ratio), 6).alias("spread"),
        F.when(~F.bool_or(open_ & ~limited), F.sum(F.when(open_, F.col("available")))).alias("available"),
    )


def sole_copy_drives(locations: DataFrame) -> DataFrame:
    """Drives that hold the only copy of chunks, most first."""
    alone = locations.groupBy("chunk_id").agg(F.min("drive_id").alias("drive_id"), F.max("drive_id").alias("other")).where("drive_id = other")
    return alone.groupBy("drive_id").agg(F.count("*").alias("sole_copies")).orderBy(F.desc("sole_copies"), "drive_id")


def sweep(chunks: DataFrame, *marked: DataFrame) -> DataFrame:
    """Every chunk with its fate: kept (referenced), protected (uncommitted or being written) or garbage."""
    marks = marked[0].select("chunk_id")
    for more in marked[1:]:
        marks = marks.union(more.select("chunk_id"))
    marks = marks.distinct().withColumn("marked", F.lit(True))
    fate = F.when(F.col("marked"), "kept").when(~F.col("committed") | F.col("active_writes"), "protected").otherwise("garbage")
    return chunks.join(marks, "chunk_id", "left").select("chunk_id", "volume_id", "stored_size", fate.alias("fate"))


def sweep_summary(swept: DataFrame) -> DataFrame:
    of = lambda fate: F.count_if(F.col("fate") == fate)
    return swept.groupBy("volume_id").agg(of("garbage").alias("deleted"), of("protected").alias("protected"), of("kept").alias("kept"), F.coalesce(F.sum(F.when(F.col("fate") == "garbage", F.col("stored_size"))), F.lit(0)).alias("freed_bytes"))


def stripe_states(shards: DataFrame, locations: DataFrame, data: int = 4) -> DataFrame:
    """Per stripe: shards with a copy, and healthy, degraded (enough to rebuild) or critical; critical ones first."""
    there = locations.select("chunk_id").distinct().withColumn("there", F.lit(1))
    n = shards.join(there, "chunk_id", "left").groupBy("stripe_id").agg(F.count("*").alias("shards"), F.count("there").alias("available"))
    state = F.when(F.col("available") == F.col("shards"), "healthy").when(F.col("available") >= data, "degraded").otherwise("critical")
    return n.withColumn("state", state).orderBy((F.col("state") != "critical"), (F.col("state") != "degraded"), "stripe_id")


def missing_replicas(expected: DataFrame, actual: DataFrame, reached: DataFrame) -> DataFrame:
    """Expected copies on reached drives that are not there."""
    return expected.join(reached, "drive_id", "left_semi").join(actual, ["chunk_id", "drive_id"], "left_anti")


def snapshot_diff(base: DataFrame, now: DataFrame) -> DataFrame:
    """Chunks of each file by whether both, only the snapshot or only the live tree name them."""
    both = base.withColumn("b", F.lit(1)).join(now.withColumn("n", F.lit(1)), ["file_id", "chunk_id"], "full_outer")
    return both.groupBy("file_id").agg(F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.count_if(F.col("b").isNotNull() & F.col("n").isNotNull()).alias("unchanged"))


def stop_safety(volumes: DataFrame, chunks: DataFrame, locations: DataFrame, drives: DataFrame) -> DataFrame:
    """Per node: its chunks that would have no copy, or too few, on active drives of other nodes if it stopped."""
    placed = locations.join(F.broadcast(drives.select("drive_id", "node", "state")), "drive_id")
    # one pass over a chunk's copies: its active ones by node, and the sum of them over its nodes
    held = placed.groupBy("chunk_id", "node").agg(F.count_if(F.col("state") == "active").alias("own")).withColumn("all", F.sum("own").over(Window.partitionBy("chunk_id")))
    need = chunks.join(volumes.select("volume_id", "min_copies"), "volume_id", "left").select("chunk_id", F.coalesce("min_copies", F.lit(1)).alias("need"))
    left = F.col("all") - F.col("own")
    return held.join(need, "chunk_id").groupBy("node").agg(F.count("*").alias("chunks"), F.count_if(left == 0).alias("stranded"), F.count_if((left > 0) & (left < F.col("need"))).alias("below_min"))


def pressure(usage: DataFrame, threshold: float) -> DataFrame:
    """Limited drives whose use has reached the share `threshold`."""
    return usage.where((F.col("capacity_bytes") > 0) & (F.col("used") >= F.col("capacity_bytes") * threshold)).select("drive_id", "used", "capacity_bytes")


def file_digest(file_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """SHA-256 of each file's size and ordered chunk hashes."""
    parts = file_chunks.join(chunks.select("chunk_id", "hash", "stored_size"), "chunk_id")
    ordered: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "hash"))), lambda x: x["hash"]), ",")
    return parts.groupBy("file_id").agg(F.count("*").alias("chunks"), F.sum("stored_size").alias("size"), ordered.alias("hashes")).select("file_id", "chunks", "size", F.sha2(F.concat_ws(":", F.col("size").cast("string"), "hashes"), 256).alias("digest"))
