"""Access counts, coldness, and moves between tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .logs import moment
from .ordered import running_total

#: Hours that count for a chunk that was never read, what a read a day weighs in hours, daily reads for promotion, idle seconds for demotion, idle cycles before counts go.
NEVER_HOURS, FREQUENCY, PROMOTE_AT, DEMOTE_AFTER, IDLE_CYCLES = 87_600.0, 10, 10, 86_400, 3
#: The tiers from the fastest.
TIERS = ("hot", "warm", "cold")


def coldness(daily: Column, last: Column, now: str) -> Column:
    """The lower, the colder: hours since the last read, negative, and reads a day times FREQUENCY."""
    idle = F.when(last.isNull(), NEVER_HOURS).otherwise((F.unix_seconds(moment(now).cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))) / 3600.0)
    return -idle + F.coalesce(daily, F.lit(0)) * FREQUENCY


def next_tier(tier: Column, step: int) -> Column:
    """One tier faster (-1) or slower (1), null beyond the ends."""
    out = F.lit(None).cast("string")
    for k, name in enumerate(TIERS):
        if 0 <= k + step < len(TIERS):
            out = F.when(tier == name, TIERS[k + step]).otherwise(out)
    return out


def hot(counts: DataFrame, least: int, limit: int = 100) -> DataFrame:
    """Chunks (hash, hourly) read at least so often, the most read first."""
    return counts.where(F.col("hourly") >= least).orderBy(F.desc("hourly"), "hash").limit(limit)


def cold(counts: DataFrame, cutoff: str, limit: int | None = None) -> DataFrame:
    """Chunks (hash, last) last read before a moment."""
    found = counts.where(F.col("last") < moment(cutoff))
    return found if limit is None else found.orderBy("last", "hash").limit(limit)


def moves(placed: DataFrame, stats: DataFrame, full: DataFrame, now: str, cycle: int) -> DataFrame:
    """Chunks (chunk_id, drive_id, tier) with a new tier: chunk_id, tier, to_tier, reason.

    Read PROMOTE_AT times a day or more, a chunk goes up; never read, or idle for more than
    DEMOTE_AFTER seconds, it goes down. Of each tier in `full` the coldest tenth of `cycle`
    goes down as well, and then for that reason alone.
    """
    joined = placed.join(stats, "chunk_id", "left")
    idle = F.unix_seconds(moment(now).cast("timestamp")) - F.unix_seconds(F.col("last").cast("timestamp"))
    up = (F.coalesce("daily", F.lit(0)) >= PROMOTE_AT) & next_tier(F.col("tier"), -1).isNotNull()
    down = (F.col("last").isNull() | (idle > DEMOTE_AFTER)) & next_tier(F.col("tier"), 1).isNotNull()
    reason = F.when(up, "promote").when(down, "demote")
    scored = joined.select("chunk_id", "tier", reason.alias("reason"), coldness(F.col("daily"), F.col("last"), now).alias("score"))
    # the coldest of each of many deals, then of all of them
    place = lambda *by: F.row_number().over(Window.partitionBy("tier", *by).orderBy("score", "chunk_id"))
    open_ = scored.where(next_tier(F.col("tier"), 1).isNotNull()).join(F.broadcast(full.select("tier").distinct()), "tier", "left_semi")
    most = cycle // 10
    some = open_.withColumn("deal", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).withColumn("n", place("deal")).where(F.col("n") <= most)
    evicted = some.withColumn("n", place()).where(F.col("n") <= most).select("chunk_id", F.lit("evict").alias("evict"))
    found = scored.join(evicted, "chunk_id", "left").withColumn("reason", F.coalesce("evict", "reason")).where("reason is not null")
    to = F.when(F.col("reason") == "promote", next_tier(F.col("tier"), -1)).otherwise(next_tier(F.col("tier"), 1))
    return found.select("chunk_id", "tier", to.alias("to_tier"), "reason")


def decayed(access: DataFrame, now: str) -> DataFrame:
    """hash, daily, staleness, last: counts after the hourly cycles from each chunk's first read up to `now`.

    A cycle takes a twenty-fourth (rounded down) from the daily count and adds the hour's
    reads; after IDLE_CYCLES cycles without either, the chunk's counts go. The fold is as
    long as a chunk's hours, not its reads.
    """
    hour = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).cast("long")
    hours = access.groupBy("hash", hour.alias("h")).agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    each = hours.groupBy("hash").agg(F.map_from_entries(F.collect_list(F.struct("h", "n"))).alias("reads"), F.min("h").alias("from"), F.max("last").alias("last"))
    end = F.floor(F.unix_seconds(moment(now).cast("timestamp")) / 3600).cast("long")
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("daily"), zero.alias("staleness"))

    def step(acc: Column, h: Column) -> Column:
        n = F.coalesce(F.try_element_at("reads", h), zero)
        daily = F.greatest(zero, acc["daily"] - F.floor(acc["daily"] / 24) + n)
        gone = (acc["staleness"] >= IDLE_CYCLES) & (n == 0)  # dropped before, and not read since
        idle = (daily == 0) & (n == 0)
        return F.struct(F.when(gone, zero).otherwise(daily).alias("daily"), F.when(gone, acc["staleness"]).when(idle, acc["staleness"] + 1).otherwise(zero).alias("staleness"))

    folded = each.withColumn("s", F.aggregate(F.sequence(F.col("from"), end), start, step))
    return folded.where(F.col("s.staleness") < IDLE_CYCLES).select("hash", "s.daily", "s.staleness", "last")


def pruned(counts: DataFrame, most: int) -> DataFrame:
    """The counts (hash, hourly, daily, last, staleness) that stay when there are more than `most`: inactive ones go first, the stalest and then the oldest of them, then the oldest of all.

    Places in both orders are running counts over deals by staleness and hour, so neither
    order passes through one task.
    """
    over = max(0, counts.count() - most)
    if not over:
        return counts
    rows = counts.withColumn("idle", (F.col("hourly") == 0) & (F.col("daily") == 0)).withColumn("one", F.lit(1)).withColumn("all", F.lit(0))
    hour = F.date_trunc("hour", "last")
    idle = running_total(rows.where("idle"), "all", F.struct(-F.col("staleness"), hour), [F.desc("staleness"), "last", "hash"], "one", "place").where(F.col("place") > over).drop("place")
    left = rows.where("not idle").unionByName(idle.select(*rows.columns))
    more = max(0, left.count() - most)
    kept = running_total(left, "all", hour, ["last", "hash"], "one", "place").where(F.col("place") > more)
    return kept.select(*counts.columns)
