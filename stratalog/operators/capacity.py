"""Capacity, quotas, health and pressure of a cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the kinds of work, and what a volume's target is when the volume is unknown.
WEIGHTS = {"user_read": 100, "metadata_commit": 90, "user_write": 80, "replication": 60, "read_repair": 40, "repair": 20, "scrub": 10}
UNKNOWN_TARGET = 3


def cluster_capacity(usage: DataFrame) -> DataFrame:
    """One row: drives, used, and capacity and free bytes, which are null (unlimited) if a drive has no limit."""
    limited = F.bool_and(F.col("capacity_bytes") > 0)
    return usage.agg(F.count("*").alias("drives"), F.sum("used").alias("used"), F.when(limited, F.sum("capacity_bytes")).alias("capacity"), F.when(limited, F.sum("available")).alias("available"))


def available(usage: DataFrame, tier: str | None = None, exclude: tuple[int, ...] = ()) -> DataFrame:
    """One row: free bytes of a tier or of all, without draining drives and those named; null if one of them has no limit."""
    open_ = usage.where((F.col("state") != "draining") & ~F.col("drive_id").isin(list(exclude)))
    if tier is not None:
        open_ = open_.where(F.col("tier") == tier)
    return open_.agg(F.when(F.coalesce(F.bool_and(F.col("capacity_bytes") > 0), F.lit(True)), F.coalesce(F.sum("available"), F.lit(0))).alias("available"))


def redundant_bytes(locations: DataFrame, chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per drive: bytes of chunks that have more copies than their volume wants."""
    n = locations.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    rich = n.join(chunks.select("chunk_id", "volume_id", "stored_size"), "chunk_id").join(volumes.select("volume_id", "factor"), "volume_id", "left").where(F.col("copies") > F.coalesce("factor", F.lit(UNKNOWN_TARGET)))
    return locations.join(rich.select("chunk_id", "stored_size"), "chunk_id").groupBy("drive_id").agg(F.sum("stored_size").alias("redundant"))


def tier_balance(usage: DataFrame, threshold: float) -> DataFrame:
    """Per tier of limited drives: weighted mean ratio, spread, whether the spread reaches the threshold, and bytes above the mean on drives half the threshold above it."""
    limited = usage.where("capacity_bytes > 0").withColumn("ratio", F.col("used") / F.col("capacity_bytes"))
    mean = limited.groupBy("tier").agg((F.sum("used") / F.sum("capacity_bytes")).alias("mean"), (F.max("ratio") - F.min("ratio")).alias("spread"))
    over = F.greatest(F.lit(0), F.col("used") - F.floor(F.col("capacity_bytes") * F.col("mean")))
    sums = limited.join(F.broadcast(mean), "tier").groupBy("tier").agg(F.sum(F.when(F.col("ratio") - F.col("mean") >= threshold / 2, over).otherwise(0)).alias("overfull"))
    return mean.join(sums, "tier").select("tier", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"), (F.col("spread") >= threshold).alias("uneven"), "overfull")


def drive_health(drives: DataFrame) -> DataFrame:
    """Per node: healthy if no drive is draining, unhealthy if all are (or there is none), degraded else."""
    bad = F.count_if(F.col("state") == "draining")
    state = F.when((F.count("*") == 0) | (bad == F.count("*")), "unhealthy").when(bad > 0, "degraded").otherwise("healthy")
    return drives.groupBy("node").agg(F.count("*").alias("drives"), bad.alias("failing"), state.alias("health"))


def storage_health(usage: DataFrame, warn: float = 0.85, critical: float = 0.95) -> DataFrame:
    """One row: utilisation of the limited drives, writable drives, and health."""
    total = F.sum(F.when(F.col("capacity_bytes") > 0, F.col("used"))) / F.sum("capacity_bytes")
    n = usage.agg(F.coalesce(total, F.lit(0.0)).alias("utilisation"), F.count_if(F.col("state") == "active").alias("writable"))
    health = F.when((F.col("writable") == 0) | (F.col("utilisation") >= critical), "unhealthy").when(F.col("utilisation") >= warn, "degraded").otherwise("healthy")
    return n.select(F.round("utilisation", 6).alias("utilisation"), "writable", health.alias("health"))


def degraded_volumes(chunks: DataFrame, locations: DataFrame, volumes: DataFrame) -> DataFrame:
    """Volumes, and whether any of their chunks has fewer copies than wanted."""
    n = locations.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    low = chunks.select("chunk_id", "volume_id").join(n, "chunk_id", "left").groupBy("volume_id").agg(F.min(F.coalesce("copies", F.lit(0))).alias("fewest"))
    return volumes.join(low, "volume_id", "left").select("volume_id", F.coalesce(F.col("fewest") < F.col("factor"), F.lit(False)).alias("degraded"))


def volume_conditions(volumes: DataFrame, nodes: int, writable: int, utilisation: float, critical: int) -> DataFrame:
    """Per volume the first thing that is wrong: more copies wanted than nodes, no writable drive, over 95 % full, a critical escalation pending, or nothing."""
    wrong = F.when(F.col("factor") > nodes, "under_replicated").when(F.lit(writable == 0), "no_writable_drive").when(F.lit(utilisation > 0.95), "full").when(F.lit(critical > 0), "escalation").otherwise("ok")
    return volumes.select("volume_id", wrong.alias("condition"))


def quota_checks(writes: DataFrame, volumes: DataFrame, usage: DataFrame) -> DataFrame:
    """Writes (volume_id, bytes) against max_bytes and max_files of their volume (null: none) and its use (files, logical_bytes)."""
    joined = writes.join(volumes.select("volume_id", "max_bytes", "max_files"), "volume_id").join(usage.select("volume_id", "files", "logical_bytes"), "volume_id", "left")
    fits = F.col("max_bytes").isNull() | (F.coalesce("logical_bytes", F.lit(0)) + F.col("bytes") <= F.col("max_bytes"))
    room = F.col("max_files").isNull() | (F.coalesce("files", F.lit(0)) < F.col("max_files"))
    return joined.select("volume_id", "bytes", F.when(~fits, "over_capacity").when(~room, "too_many_files").otherwise("ok").alias("verdict"))


def pressure_level(used: Column, capacity: Column, boost: float = 0.85, critical: float = 0.95) -> Column:
    """normal, boost or critical by use over capacity; none without a limit."""
    level = F.when(capacity > 0, used / capacity).otherwise(0.0)
    return F.when(level >= critical, "critical").when(level >= boost, "boost").otherwise("normal")


def work_weight(kind: Column, level: Column) -> Column:
    """The weight of a kind of work; under pressure scrubs and repairs weigh half as much again, when it is critical as much as replication."""
    table = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))
    own = F.element_at(table, kind)
    lifted = kind.isin("scrub", "repair")
    return F.when(lifted & (level == "boost"), F.round(own * 1.5).cast("int")).when(lifted & (level == "critical"), WEIGHTS["replication"]).otherwise(own)


def quorum(nodes: DataFrame) -> DataFrame:
    """Per node (node, reachable): whether a majority of all members is reachable without it."""
    totals = nodes.agg(F.count("*").alias("members"), F.count_if("reachable").alias("up")).first()
    need = totals["members"] // 2 + 1
    return nodes.select("node", (F.lit(totals["up"]) - F.col("reachable").cast("long")).alias("left"), (F.lit(totals["up"]) - F.col("reachable").cast("int") >= need).alias("survives"))


def removal_guard(audit: DataFrame, system: DataFrame, force: bool = False) -> DataFrame:
    """One row: refuse if a system volume would lose data; else ok if no volume is at risk, forced if asked for, refuse else. `audit` has volume_id, below_min and lost."""
    risk = audit.join(system.select("volume_id", "system"), "volume_id").agg(F.coalesce(F.max((F.col("system") & (F.col("lost") > 0)).cast("int")), F.lit(0)).alias("hard"), F.count_if((F.col("below_min") > 0) | (F.col("lost") > 0)).alias("at_risk"))
    return risk.select("at_risk", F.when(F.col("hard") == 1, "refuse").when(F.col("at_risk") == 0, "ok").when(F.lit(force), "forced").otherwise("refuse").alias("decision"))


def off_duty(nodes: DataFrame) -> DataFrame:
    """Nodes (node, state) that are draining or under maintenance."""
    return nodes.where(F.col("state").isin("draining", "maintenance"))


def over_replicated_asks(volumes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Volumes that want more copies than there are nodes."""
    there = nodes.select("node").distinct().count()
    return volumes.select("volume_id", (F.col("factor") > there).alias("degraded"))


def with_defaults(stats: DataFrame, configs: DataFrame, key: str, default: dict[str, int]) -> DataFrame:
    """Rows with the settings of their key, or the default ones."""
    joined = stats.join(F.broadcast(configs), key, "left")
    return joined.select(*stats.columns, *(F.coalesce(F.col(k), F.lit(v)).alias(k) for k, v in default.items()))
