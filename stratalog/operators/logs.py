"""Audit events, jobs, escalations, leases and rate limits: filters whose parts are optional, and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def one_of(column: str, wanted) -> Column:
    """Equality with a value, or membership in a list of them; null asks for nothing."""
    if wanted is None:
        return F.lit(True)
    return F.col(column).isin(list(wanted)) if isinstance(wanted, (list, tuple, set)) else F.col(column) == wanted


def moment(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


def audit(events: DataFrame, event_type=None, actor=None, resource: str | None = None, since: str | None = None, until: str | None = None, limit: int | None = 100) -> DataFrame:
    """Events by any of type (one or several), actor, prefix of the resource (null never matches) and inclusive times; the oldest `limit` of them, oldest first."""
    found = events.where(one_of("event_type", event_type) & one_of("actor_uid", actor))
    if resource is not None:
        found = found.where(F.col("resource").startswith(resource))
    if since is not None:
        found = found.where(F.col("ts") >= moment(since))
    if until is not None:
        found = found.where(F.col("ts") <= moment(until))
    found = found.orderBy("ts", "id")
    return found if limit is None else found.limit(limit)


def recent(events: DataFrame, limit: int = 50) -> DataFrame:
    """The newest `limit` events, oldest first."""
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(limit).orderBy("ts", "id")


def cluster_audit(events: DataFrame, node: str, limit: int) -> DataFrame:
    """The oldest `limit` events of each node, together newest first, cut to `limit`.

    A node gives its part by ranges of ids, so that no window holds all its events.
    """
    place = lambda *by: F.row_number().over(Window.partitionBy(node, *by).orderBy("ts", "id"))
    some = events.withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("n", place("deal")).where(F.col("n") <= limit)
    each = some.withColumn("n", place()).where(F.col("n") <= limit).drop("n", "deal")
    return each.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def jobs(rows: DataFrame, status=None, kind=None) -> DataFrame:
    """Jobs by status and type, newest first."""
    return rows.where(one_of("status", status) & one_of("type", kind)).orderBy(F.desc("created_at"), "job_id")


def backlog(rows: DataFrame, status, now: str) -> DataFrame:
    """Jobs of some states by state and priority, and those whose time has run out by `now`."""
    return rows.where(one_of("status", status)).groupBy("status", "priority").agg(F.count("*").alias("jobs"), F.count_if(F.col("expires_at") < moment(now)).alias("expired"))


def escalations(rows: DataFrame, status=None, category=None) -> DataFrame:
    """Escalations by status and category, oldest first."""
    return rows.where(one_of("status", status) & one_of("category", category)).orderBy("created_at", "id")


def pending_by_category(rows: DataFrame) -> DataFrame:
    return rows.where("status = 'pending'").groupBy("category").agg(F.count("*").alias("pending"))


def swept_escalations(rows: DataFrame, now: str) -> DataFrame:
    """Pending escalations whose time has run out by `now` become expired."""
    late = (F.col("status") == "pending") & (F.col("expires_at") <= moment(now))
    return rows.withColumn("status", F.when(late, "expired").otherwise(F.col("status")))


def leases(rows: DataFrame, now: str) -> DataFrame:
    """Per state: running leases that hold at `now`, and those that have run out."""
    out = F.col("expires_at") <= moment(now)
    return rows.groupBy("priority").agg(F.count_if(~out).alias("active"), F.count_if(out).alias("expired"))


def orphans(rows: DataFrame, now: str, grace: int) -> DataFrame:
    """Writes that began more than `grace` seconds before `now`."""
    return rows.where(F.col("created_at") < moment(now) - F.expr(f"interval {grace} seconds"))


def due(rows: DataFrame, now: str) -> DataFrame:
    """Schedules (id, interval_s, last_run) that are due: with an interval, and never run or run no less than it ago."""
    ago = F.unix_micros(moment(now).cast("timestamp")) - F.unix_micros(F.col("last_run").cast("timestamp"))
    return rows.where((F.col("interval_s") > 0) & (F.col("last_run").isNull() | (ago >= F.col("interval_s").cast("long") * 1_000_000)))


def latest_completed(rows: DataFrame, group: str, order: str) -> DataFrame:
    return rows.groupBy(group).agg(F.max(order).alias("latest"))


def file_date(name: Column) -> Column:
    """The date in a name like 2024-01-31 or 2024-01-31.jsonl, null for other names."""
    return F.try_to_timestamp(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})(?:\.jsonl)?$", 1), F.lit("yyyy-MM-dd")).cast("date")


def expired_files(names: DataFrame, today: str, days: int) -> DataFrame:
    """Names whose date is more than `days` days before `today`; names without a date stay."""
    return names.withColumn("day", file_date(F.col("name"))).where(F.col("day") < F.date_sub(F.lit(today).cast("date"), days)).select("name", "day")


def rate_limited(requests: DataFrame, key: str, most: int, window_s: int) -> DataFrame:
    """Per key: requests let through and turned away, under windows that begin with the first request after the last one ended.

    Times are sorted and folded by key; a key's requests are first summed by second, so the
    fold is as long as the seconds in which the key asked.
    """
    seconds = requests.groupBy(key, F.unix_seconds(F.col("ts").cast("timestamp")).alias("s")).agg(F.count("*").alias("n"))
    lists = seconds.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("s", "n"))).alias("asked"))
    start = F.struct(F.lit(None).cast("long").alias("begun"), F.lit(0).cast("long").alias("in_window"), F.lit(0).cast("long").alias("passed"))

    def step(acc: Column, x: Column) -> Column:
        same = F.coalesce(x["s"] - acc["begun"] < window_s, F.lit(False))
        used = F.when(same, acc["in_window"]).otherwise(F.lit(0).cast("long"))
        more = F.least(x["n"], F.greatest(F.lit(0), most - used))
        return F.struct(F.when(same, acc["begun"]).otherwise(x["s"]).alias("begun"), (used + more).alias("in_window"), (acc["passed"] + more).alias("passed"))

    total = F.aggregate(F.transform("asked", lambda x: x["n"]), F.lit(0).cast("long"), lambda a, n: a + n)
    return lists.select(key, F.aggregate("asked", start, step)["passed"].alias("passed"), total.alias("asked")).select(key, "passed", (F.col("asked") - F.col("passed")).alias("refused"))


def claims(rows: DataFrame, prefix: str = "", path: str | None = None, kind: str | None = None, holder=None) -> DataFrame:
    """Claims under a prefix, at a path, of a kind and of a holder, each where asked for, by id."""
    found = rows.where(F.col("path").startswith(prefix) & one_of("path", path) & one_of("kind", kind) & one_of("holder", holder))
    return found.orderBy("claim_id")


def active_locks(rows: DataFrame, now: str | None) -> DataFrame:
    """Locks that have not run out at `now`, or all."""
    return rows if now is None else rows.where(F.col("expires_at") > moment(now))


def kept_events(events: DataFrame, now: str, days: int, most: int) -> DataFrame:
    """Events of the last `days` days, the newest `most` of them."""
    return events.where(F.col("ts") >= moment(now) - F.expr(f"interval {days} days")).orderBy(F.desc("ts"), F.desc("id")).limit(most)


def within(created: Column, now: str, days: int) -> Column:
    """Whether the whole days since are fewer than `days` (weeks have 7, months 31)."""
    return F.floor((F.unix_seconds(moment(now).cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))) / 86_400) < days
