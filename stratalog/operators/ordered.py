"""Order inside groups: offsets, overlaps, pages, retention, gaps and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Numbers of a scope that one window orders.
RUN = 100_000


def chunk_offsets(file_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """Position and byte range [start, end) of each chunk in its file."""
    order = Window.partitionBy("file_id").orderBy("chunk_id")
    sized = file_chunks.join(chunks.select("chunk_id", "stored_size"), "chunk_id")
    end = F.sum("stored_size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return sized.select("file_id", "chunk_id", F.row_number().over(order).cast("long").alias("pos"), (end - F.col("stored_size")).alias("start"), end.alias("end"))


def range_read(offsets: DataFrame, first: int, last: int) -> DataFrame:
    """Chunks that bytes [first, last) of each file touch, with the part of each chunk that is read."""
    touched = offsets.where((F.col("start") < last) & (F.col("end") > first))
    return touched.select("file_id", "chunk_id", (F.greatest(F.lit(first), "start") - F.col("start")).alias("skip"), (F.least(F.lit(last), "end") - F.greatest(F.lit(first), "start")).alias("take"))


def claim_conflicts(claims: DataFrame) -> DataFrame:
    """Per path: claims, and pairs of claims that overlap with one of both exclusive.

    Counted without forming pairs: of two that overlap one begins while the other is open,
    or both begin together. Pairs of shared claims are taken off again.
    """
    marks = claims.select("path", "exclusive", F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("begins")), F.struct(F.col("end").alias("at"), F.lit(0).alias("begins")))).alias("m")).select("path", "exclusive", "m.at", "m.begins")
    # ends come first on ties: the claims open at a start are those that it overlaps and that began earlier
    signed = F.when(F.col("begins") == 1, 1).otherwise(-1)
    sums = marks.groupBy("path", "at", "begins").agg(F.count("*").alias("n"), F.count_if(~F.col("exclusive")).alias("shared"))
    before = Window.partitionBy("path").orderBy("at", "begins").rowsBetween(Window.unboundedPreceding, -1)
    runs = sums.select("path", "begins", "n", "shared", F.coalesce(F.sum(signed * F.col("n")).over(before), F.lit(0)).alias("open"), F.coalesce(F.sum(signed * F.col("shared")).over(before), F.lit(0)).alias("open_shared"))
    pairs = lambda n, open_: F.sum(F.when(F.col("begins") == 1, F.col(n) * F.col(open_) + F.expr(f"{n} * ({n} - 1) div 2")).otherwise(0))
    return runs.groupBy("path").agg(F.sum(F.when(F.col("begins") == 1, F.col("n")).otherwise(0)).alias("claims"), (pairs("n", "open") - pairs("shared", "open_shared")).alias("conflicts"))


def key_listing(keys: DataFrame, prefix: str, delimiter: str = "/") -> DataFrame:
    """Keys under a prefix; those with the delimiter further on are rolled up to common prefixes."""
    rest = F.expr(f"substring(key, {len(prefix) + 1})")
    common = rest.contains(delimiter)
    name = F.when(common, F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    return keys.where(F.col("key").startswith(prefix)).groupBy(name.alias("name"), common.alias("is_prefix")).agg(F.count("*").alias("keys"))


def keyset_page(rows: DataFrame, key: str, after: str, size: int) -> DataFrame:
    """The `size` rows that follow `after` in the order of a unique key."""
    return rows.where(F.col(key) > after).orderBy(key).limit(size)


def sequence_gaps(rows: DataFrame, scope: str, seq: str = "seq") -> DataFrame:
    """Per scope: runs of numbers that are missing between those that arrived.

    A number's follower is found by runs of numbers: inside a run of RUN by a window, between
    runs by the ends of the runs, so a scope of any length is dealt over many tasks.
    """
    run = F.expr(f"{seq} div {RUN}")
    found = rows.select(scope, F.col(seq).alias("at"), run.alias("run")).distinct()
    inside = found.withColumn("before", F.lag("at").over(Window.partitionBy(scope, "run").orderBy("at")))
    ends = found.groupBy(scope, "run").agg(F.min("at").alias("at"), F.max("at").alias("last"))
    between = ends.withColumn("before", F.lag("last").over(Window.partitionBy(scope).orderBy("run")))
    gaps = inside.where("at - before > 1").select(scope, "before", "at").union(between.where("at - before > 1").select(scope, "before", "at"))
    return gaps.select(scope, (F.col("before") + 1).alias("first_lost"), (F.col("at") - 1).alias("last_lost"))


def retained(items: DataFrame, now: str, days: int = 7, weeks: int = 4, months: int = 12) -> DataFrame:
    """Grandfather-father-son retention per volume: the newest item of a day, then of an ISO week, then of a month.

    Each stage keeps at most so many, the latest first, of the items younger than 7 days,
    28 days and 372 days at `now`, and works on all items that the stages before it left.
    """
    kept = None
    for stage, unit, most, age in (("day", "day", days, 7), ("week", "week", weeks, 28), ("month", "month", months, 372)):
        left = items.select("volume_id", "file_id", "created_at").where(F.col("created_at") > F.expr(f"timestamp_ntz'{now}' - interval {age} days"))
        if kept is not None:
            k = kept.select(F.col("volume_id").alias("kept_volume"), F.col("file_id").alias("kept_file"))
            left = left.join(k, F.col("volume_id").eqNullSafe(F.col("kept_volume")) & F.col("file_id").eqNullSafe(F.col("kept_file")), "left_anti")
        newest = left.groupBy("volume_id", F.date_trunc(unit, "created_at").alias("unit")).agg(F.max(F.struct("created_at", "file_id")).alias("top"))
        place = F.row_number().over(Window.partitionBy("volume_id").orderBy(F.desc("unit")))
        found = newest.withColumn("n", place).where(F.col("n") <= most).select("volume_id", "top.file_id", F.lit(stage).alias("stage"))
        kept = found if kept is None else kept.union(found)
    return kept


def latest(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The greatest row of each group by a total order of columns."""
    return rows.groupBy(group).agg(F.max(F.struct(*order)).alias("top")).select(group, "top.*")


def round_robin(drives: DataFrame) -> DataFrame:
    """Drives with the round in which each node in turn gives one."""
    return drives.select("node", "drive_id", F.row_number().over(Window.partitionBy("node").orderBy("drive_id")).cast("long").alias("round"))


def running_total(rows: DataFrame, group: str, deal: Column, order: list, value: str, name: str, newest_first: bool = False) -> DataFrame:
    """`rows` with the running sum of a value inside each group, the row itself included.

    A group is dealt by `deal`, which has to grow (or, newest first, to fall) with the
    order: a window sums each deal, another one the totals of the deals before it.
    """
    dealt = rows.withColumn("__deal", deal)
    sums = dealt.groupBy(group, "__deal").agg(F.sum(value).alias("__sum"))
    step = F.desc("__deal") if newest_first else F.asc("__deal")
    before = F.sum("__sum").over(Window.partitionBy(group).orderBy(step).rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select(group, "__deal", F.coalesce(before, F.lit(0)).alias("__before"))
    inside = F.sum(value).over(Window.partitionBy(group, "__deal").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn(name, inside).join(sums, [group, "__deal"]).withColumn(name, F.col(name) + F.col("__before")).drop("__deal", "__before")


def least_recent(access: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """Per volume the chunks most lately used whose sizes fit a budget together."""
    used = access.groupBy("hash").agg(F.max("ts").alias("last"))
    rows = used.withColumnRenamed("hash", "chunk_id").join(chunks, "chunk_id").select("volume_id", "chunk_id", "stored_size", "last")
    total = running_total(rows, "volume_id", F.date_trunc("hour", "last"), [F.desc("last"), "chunk_id"], "stored_size", "total", newest_first=True)
    return total.where(F.col("total") <= budget).select("volume_id", "chunk_id", "total")


def health_changes(rows: DataFrame, group: str, order: list[str], abnormal: Column) -> DataFrame:
    """Rows at which a group's health is first seen or changes.

    Rows are compared with the one before them inside an hour; the first of an hour with the
    last of the hour before, of which a row an hour is known. The first of `order` is the time.
    """
    flagged = rows.withColumn("abnormal", abnormal).withColumn("hour", F.date_trunc("hour", order[0]))
    inside = Window.partitionBy(group, "hour").orderBy(*order)
    ends = flagged.groupBy(group, "hour").agg(F.max_by("abnormal", F.struct(*order)).alias("last"))
    ends = ends.select(group, "hour", F.lag("last").over(Window.partitionBy(group).orderBy("hour")).alias("before"))
    compared = flagged.withColumn("was", F.lag("abnormal").over(inside)).withColumn("n", F.row_number().over(inside)).join(ends, [group, "hour"])
    was = F.when(F.col("n") == 1, F.col("before")).otherwise(F.col("was"))
    return compared.where(~was.eqNullSafe(F.col("abnormal"))).drop("was", "n", "before", "hour")


def claim_refusals(new: DataFrame, claims: DataFrame) -> DataFrame:
    """Claims asked for (new_id, path, start, end, exclusive) with the first of the held ones (claim_id, ...) that refuses each: the ranges overlap and one of both is exclusive.

    Held claims of a path that have the same range and scope count as the first of them.
    """
    held = claims.groupBy("path", "start", "end", "exclusive").agg(F.min("claim_id").alias("claim_id"))
    held = held.select(F.col("path").alias("of"), F.col("start").alias("from"), F.col("end").alias("to"), F.col("exclusive").alias("alone"), "claim_id")
    met = new.join(held, (F.col("path") == F.col("of")) & (F.col("start") < F.col("to")) & (F.col("from") < F.col("end")) & (F.col("exclusive") | F.col("alone")))
    return met.groupBy("new_id").agg(F.min("claim_id").alias("refused_by"))


def regressions(runs: DataFrame, window: int = 4, higher_is_worse: bool = True) -> DataFrame:
    """Values of a label over 10 % and two deviations on the wrong side of the median of its last runs."""
    order = Window.partitionBy("label").orderBy("day").rowsBetween(-window, -1)
    past = runs.select("label", "day", "value", F.collect_list("value").over(order).alias("past")).where(F.size("past") >= 2)
    mean = F.aggregate("past", F.lit(0.0), lambda a, x: a + x) / F.size("past")
    ranked = F.array_sort("past")
    half = F.size("past") / 2
    median = (F.get(ranked, (F.ceil(half) - 1).cast("int")) + F.get(ranked, F.floor(half).cast("int"))) / 2
    past = past.withColumn("mean", mean).withColumn("median", median)
    deviation = F.sqrt(F.aggregate("past", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("past"))
    past = past.withColumn("deviation", deviation).where(F.col("median") > 0)
    change = F.col("value") - F.col("median") if higher_is_worse else F.col("median") - F.col("value")
    far = F.col("value") > F.col("median") * 1.1 if higher_is_worse else F.col("value") < F.col("median") * 0.9
    past = past.where(far & (change > F.col("deviation") * 2))
    return past.select("label", "day", F.round("value", 4).alias("value"), F.round("median", 4).alias("median"))
