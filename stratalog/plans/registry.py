"""Queries of the storage-metadata engine by name, and DuckDB SQL for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.operators import catalog, content, logs, ordered, tiering

from .views import Views

#: The moments that stand for the present.
NOW, NOW_ORDERS = "2024-01-31 00:00:00", "2001-08-02 00:00:00"
PAGE_AFTER, PAGE_SIZE = "h", 50
CHUNK, PART = 256, 1_000
BUDGET = 10_000

#: The views of views.py in SQL.
VIEWS = {
    "v_volumes": "SELECT n_nationkey::BIGINT AS volume_id, n_name AS name, (1 + n_regionkey % 3)::BIGINT AS factor, (1 + n_regionkey % 2)::BIGINT AS min_copies, n_nationkey = 0 AS system FROM nation",
    "v_drives": "SELECT s_suppkey AS drive_id, s_nationkey::BIGINT AS node, ['hot', 'warm', 'cold'][(s_suppkey % 3 + 1)::INT] AS tier, CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 1000000 END::BIGINT AS capacity_bytes, CASE s_suppkey % 7 WHEN 0 THEN 'draining' WHEN 1 THEN 'standby' ELSE 'active' END AS state FROM supplier",
    "v_chunks": "SELECT o_orderkey AS chunk_id, sha256(o_orderkey::VARCHAR) AS hash, o_orderkey % 25 AS volume_id, floor(o_totalprice / 150)::BIGINT AS stored_size, o_orderkey % 11 <> 0 AS committed, o_orderkey % 13 = 0 AS active_writes FROM orders",
    "v_locations": "SELECT DISTINCT l_orderkey AS chunk_id, l_suppkey AS drive_id FROM lineitem",
    "v_file_chunks": "SELECT DISTINCT l_partkey AS file_id, l_orderkey AS chunk_id FROM lineitem",
    "v_files": "SELECT p_partkey AS file_id, p_partkey % 25 AS volume_id, p_size % 2 = 0 AS detached, (DATE '1997-12-01' + p_size::INT)::TIMESTAMP AS created_at, '/' || p_brand || '/' || p_type || '/' || p_partkey AS path FROM part",
    "v_backups": "SELECT o_orderkey AS file_id, o_orderkey % 25 AS volume_id, o_orderdate AS created_at FROM orders",
    "v_shards": "SELECT o_orderkey // 6 AS stripe_id, o_orderkey % 6 AS idx, o_orderkey AS chunk_id FROM orders",
    "v_snapshot": "SELECT f.* FROM v_file_chunks f WHERE file_id IN (SELECT file_id FROM v_files WHERE created_at < TIMESTAMP '1998-01-01')",
    "v_keys": "SELECT regexp_replace(url, '^[a-z]+://', '') AS key FROM pages",
    "v_content": "SELECT doc_id AS file_id, source, coalesce(text, '') AS text FROM documents",
    "v_claims": "SELECT row_number() OVER () AS claim_id, l_partkey % 500 AS path, (l_linenumber * 10)::BIGINT AS start, CASE WHEN l_partkey % 50 = 0 THEN 1099511627776 ELSE l_linenumber * 10 + l_quantity::BIGINT END AS stop, l_suppkey % 3 = 0 AS exclusive FROM lineitem",
    "v_offsets": "SELECT file_id, chunk_id, row_number() OVER w AS pos, (sum(stored_size) OVER w)::BIGINT AS stop, (sum(stored_size) OVER w)::BIGINT - stored_size AS start FROM v_file_chunks JOIN v_chunks USING (chunk_id) WINDOW w AS (PARTITION BY file_id ORDER BY chunk_id ROWS UNBOUNDED PRECEDING)",
    "v_usage": "SELECT d.*, coalesce(u.used, 0)::BIGINT AS used FROM v_drives d LEFT JOIN (SELECT drive_id, sum(stored_size) AS used FROM v_locations JOIN v_chunks USING (chunk_id) GROUP BY 1) u USING (drive_id)",
    "v_sweep": "SELECT c.*, CASE WHEN chunk_id IN (SELECT chunk_id FROM v_file_chunks JOIN v_files USING (file_id) WHERE NOT detached UNION SELECT chunk_id FROM v_snapshot) THEN 'kept' WHEN NOT committed OR active_writes THEN 'protected' ELSE 'garbage' END AS fate FROM v_chunks c",
}
#: Which views a view reads.
NEEDS = {"v_snapshot": ("v_file_chunks", "v_files"), "v_offsets": ("v_file_chunks", "v_chunks"), "v_usage": ("v_drives", "v_locations", "v_chunks"), "v_sweep": ("v_snapshot", "v_file_chunks", "v_files", "v_chunks")}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a function of views under its name, with its SQL."""

    def add(make: Callable[[Views], DataFrame]):
        QUERIES[make.__name__] = lambda spark, sf_dir: make(Views(spark, sf_dir))
        wanted = [v for v in VIEWS if v in sql]
        for v in wanted:
            wanted += [n for n in NEEDS.get(v, ()) if n not in wanted]
        wanted.sort(key=list(VIEWS).index)
        SQL[make.__name__] = ("WITH " + ",\n".join(f"{v} AS ({VIEWS[v]})" for v in wanted) + "\n" if wanted else "") + sql
        return make

    return add


@query("""SELECT v.volume_id, v.name, count(p.chunk_id) AS chunks, count(*) FILTER (copies < min_copies) AS below_min, count(*) FILTER (copies = 0) AS lost, min(copies) AS fewest
    FROM v_volumes v LEFT JOIN (SELECT c.chunk_id, c.volume_id, count(DISTINCT drive_id) AS copies FROM v_chunks c LEFT JOIN v_locations USING (chunk_id) WHERE committed GROUP BY ALL) p ON p.volume_id = v.volume_id GROUP BY ALL""")
def replica_audit(v: Views) -> DataFrame:
    return catalog.replica_audit(v.volumes, v.chunks, v.locations)


@query("""SELECT v.volume_id, coalesce(files, 0) AS files, coalesce(logical_bytes, 0)::BIGINT AS logical_bytes, coalesce(chunks, 0) AS chunks, coalesce(physical_bytes, 0)::BIGINT AS physical_bytes FROM v_volumes v
    LEFT JOIN (SELECT volume_id, count(*) AS files, sum(bytes) AS logical_bytes FROM v_files LEFT JOIN (SELECT file_id, sum(stored_size) AS bytes FROM v_file_chunks JOIN v_chunks USING (chunk_id) GROUP BY 1) USING (file_id) WHERE NOT detached GROUP BY 1) l USING (volume_id)
    LEFT JOIN (SELECT volume_id, count(*) AS chunks, sum(stored_size) AS physical_bytes FROM v_chunks GROUP BY 1) p USING (volume_id)""")
def volume_usage(v: Views) -> DataFrame:
    return catalog.volume_usage(v.volumes, v.files, v.file_chunks, v.chunks)


def usage(v: Views) -> DataFrame:
    return catalog.drive_usage(v.drives, *v.sized_locations)


@query("SELECT drive_id, node, tier, state, capacity_bytes, used, CASE WHEN capacity_bytes > 0 THEN greatest(0, capacity_bytes - used) END AS available FROM v_usage")
def drive_usage(v: Views) -> DataFrame:
    return usage(v)


@query("""SELECT tier, sum(used)::BIGINT AS used, sum(capacity_bytes)::BIGINT AS capacity, round(sum(used) FILTER (capacity_bytes > 0) / sum(capacity_bytes), 6) AS ratio,
    round(max(used / capacity_bytes) FILTER (capacity_bytes > 0) - min(used / capacity_bytes) FILTER (capacity_bytes > 0), 6) AS spread,
    CASE WHEN NOT bool_or(state <> 'draining' AND capacity_bytes = 0) THEN (sum(greatest(0, capacity_bytes - used)) FILTER (state <> 'draining'))::BIGINT END AS available FROM v_usage GROUP BY 1""")
def tier_usage(v: Views) -> DataFrame:
    return catalog.tier_usage(usage(v))


@query("SELECT drive_id, used, capacity_bytes FROM v_usage WHERE capacity_bytes > 0 AND used >= capacity_bytes * 0.85")
def storage_pressure(v: Views) -> DataFrame:
    return catalog.pressure(usage(v), 0.85)


@query("SELECT drive_id, count(*) AS sole_copies FROM (SELECT min(drive_id) AS drive_id FROM v_locations GROUP BY chunk_id HAVING count(DISTINCT drive_id) = 1) GROUP BY 1")
def sole_copy_drives(v: Views) -> DataFrame:
    return catalog.sole_copy_drives(v.locations)


def swept(v: Views) -> DataFrame:
    # a file marks its chunks if it is attached or in the snapshot: one semi-join for both
    marking = v.files.where("not detached or created_at < timestamp_ntz'1998-01-01 00:00:00'").select("file_id")
    return catalog.sweep(v.chunks, v.references.join(marking, "file_id", "left_semi"))


@query("SELECT chunk_id, volume_id, stored_size, fate FROM v_sweep")
def mark_and_sweep(v: Views) -> DataFrame:
    return swept(v)


@query("SELECT volume_id, count(*) FILTER (fate = 'garbage') AS deleted, count(*) FILTER (fate = 'protected') AS protected, count(*) FILTER (fate = 'kept') AS kept, coalesce(sum(stored_size) FILTER (fate = 'garbage'), 0)::BIGINT AS freed_bytes FROM v_sweep GROUP BY 1")
def sweep_summary(v: Views) -> DataFrame:
    return catalog.sweep_summary(swept(v))


@query("""SELECT stripe_id, shards, available, CASE WHEN available = shards THEN 'healthy' WHEN available >= 4 THEN 'degraded' ELSE 'critical' END AS state
    FROM (SELECT stripe_id, count(*) AS shards, count(l.chunk_id) AS available FROM v_shards LEFT JOIN (SELECT DISTINCT chunk_id FROM v_locations) l USING (chunk_id) GROUP BY 1)""")
def stripe_states(v: Views) -> DataFrame:
    return catalog.stripe_states(v.shards, v.locations)


@query("SELECT chunk_id, drive_id FROM v_locations JOIN v_drives USING (drive_id) WHERE state = 'active' AND (chunk_id + drive_id) % 37 = 0")
def anti_entropy(v: Views) -> DataFrame:
    held = v.locations.where("(chunk_id + drive_id) % 37 <> 0")
    return catalog.missing_replicas(v.locations, held, v.drives.where("state = 'active'").select("drive_id"))


@query("""SELECT file_id, count(*) FILTER (b IS NULL) AS added, count(*) FILTER (n IS NULL) AS removed, count(*) FILTER (b = 1 AND n = 1) AS unchanged
    FROM (SELECT *, 1 AS b FROM v_snapshot) FULL JOIN (SELECT *, 1 AS n FROM v_file_chunks WHERE chunk_id % 9 <> 0) USING (file_id, chunk_id) GROUP BY 1""")
def snapshot_diff(v: Views) -> DataFrame:
    return catalog.snapshot_diff(v.snapshot, v.file_chunks.where("chunk_id % 9 <> 0"))


@query("""SELECT node, count(*) AS chunks, count(*) FILTER (rest = 0) AS stranded, count(*) FILTER (rest > 0 AND rest < need) AS below_min FROM (
    SELECT h.node, h.chunk_id, v.min_copies AS need, (SELECT count(*) FROM v_locations l JOIN v_drives d USING (drive_id) WHERE l.chunk_id = h.chunk_id AND d.state = 'active' AND d.node <> h.node) AS rest
    FROM (SELECT DISTINCT node, chunk_id FROM v_locations JOIN v_drives USING (drive_id)) h JOIN v_chunks c ON c.chunk_id = h.chunk_id JOIN v_volumes v ON v.volume_id = c.volume_id) GROUP BY 1""")
def stop_safety(v: Views) -> DataFrame:
    return catalog.stop_safety(v.volumes, v.chunks, v.locations, v.drives)


@query("""SELECT file_id, count(*) AS chunks, sum(stored_size)::BIGINT AS size, sha256(sum(stored_size)::BIGINT::VARCHAR || ':' || string_agg(hash, ',' ORDER BY chunk_id)) AS digest FROM v_file_chunks JOIN v_chunks USING (chunk_id) GROUP BY 1""")
def file_digest(v: Views) -> DataFrame:
    return catalog.file_digest(v.file_chunks, v.chunks)


@query('SELECT file_id, chunk_id, pos, start, stop AS "end" FROM v_offsets')
def chunk_offsets(v: Views) -> DataFrame:
    return ordered.chunk_offsets(v.file_chunks, v.chunks)


@query("SELECT file_id, chunk_id, greatest(1000, start) - start AS skip, least(6000, stop) - greatest(1000, start) AS take FROM v_offsets WHERE start < 6000 AND stop > 1000")
def range_read(v: Views) -> DataFrame:
    return ordered.range_read(ordered.chunk_offsets(v.file_chunks, v.chunks), 1_000, 6_000)


@query("""SELECT path, count(*) AS claims, coalesce(sum(n), 0)::BIGINT AS conflicts FROM v_claims LEFT JOIN (
    SELECT a.claim_id, count(*) AS n FROM v_claims a JOIN v_claims b ON a.path = b.path AND a.claim_id < b.claim_id AND a.start < b.stop AND b.start < a.stop AND (a.exclusive OR b.exclusive) GROUP BY 1) USING (claim_id) GROUP BY 1""")
def claim_conflicts(v: Views) -> DataFrame:
    return ordered.claim_conflicts(v.claims)


@query("SELECT key AS name, false AS is_prefix, count(*) AS keys FROM v_keys WHERE starts_with(key, 'www.') AND NOT contains(substring(key, 5), '/') GROUP BY 1 UNION ALL SELECT 'www.' || split_part(substring(key, 5), '/', 1) || '/', true, count(*) FROM v_keys WHERE starts_with(key, 'www.') AND contains(substring(key, 5), '/') GROUP BY 1")
def key_listing(v: Views) -> DataFrame:
    return ordered.key_listing(v.keys, "www.")


@query(f"SELECT DISTINCT key FROM v_keys WHERE key > '{PAGE_AFTER}' ORDER BY key LIMIT {PAGE_SIZE}")
def keyset_page(v: Views) -> DataFrame:
    return ordered.keyset_page(v.keys.distinct(), "key", PAGE_AFTER, PAGE_SIZE)


@query("""SELECT node, before + 1 AS first_lost, seq - 1 AS last_lost FROM (SELECT node, seq, lag(seq) OVER (PARTITION BY node ORDER BY seq) AS before FROM (
    SELECT user_id % 3 AS node, event_id, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS seq FROM events) WHERE event_id % 17 <> 0) WHERE seq - before > 1""")
def sequence_gaps(v: Views) -> DataFrame:
    return ordered.sequence_gaps(v.received, "node")


def retention_sql() -> str:
    """The newest of each day, then week, then month, within 7, 28 and 372 whole days, each stage over what the stages before it left."""
    parts, kept = [], "SELECT NULL::BIGINT AS volume_id, NULL::BIGINT AS file_id WHERE false"
    for stage, most, age in (("day", 7, 7), ("week", 4, 28), ("month", 12, 372)):
        left = f"SELECT b.* FROM v_backups b ANTI JOIN ({kept}) k USING (volume_id, file_id) WHERE created_at > TIMESTAMP '{NOW_ORDERS}' - INTERVAL {age} DAYS"
        newest = f"SELECT volume_id, date_trunc('{stage}', created_at) AS unit, arg_max(file_id, (created_at, file_id)) AS file_id FROM ({left}) GROUP BY ALL"
        parts.append(f"{stage}s AS (SELECT volume_id, file_id, '{stage}' AS stage FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY unit DESC) AS n FROM ({newest})) WHERE n <= {most})")
        kept = " UNION ALL ".join(f"SELECT volume_id, file_id FROM {s}s" for s in ("day", "week", "month")[: len(parts)])
    return f"SELECT * FROM (WITH {', '.join(parts)} SELECT * FROM days UNION ALL SELECT * FROM weeks UNION ALL SELECT * FROM months)"


@query(retention_sql())
def retained_backups(v: Views) -> DataFrame:
    return ordered.retained(v.backups, NOW_ORDERS)


@query("SELECT node, max((ts, event_id)).ts AS ts, max((ts, event_id)).event_id AS event_id FROM (SELECT user_id % 3 AS node, ts, event_id FROM events) GROUP BY 1".replace("max((ts, event_id))", "max({'ts': ts, 'event_id': event_id})"))
def latest_envelope(v: Views) -> DataFrame:
    return ordered.latest(v.envelopes, "node", ["ts", "event_id"])


@query("SELECT node, drive_id, row_number() OVER (PARTITION BY node ORDER BY drive_id) AS round FROM v_drives")
def round_robin(v: Views) -> DataFrame:
    return ordered.round_robin(v.drives)


@query(f"""SELECT volume_id, chunk_id, total::BIGINT AS total FROM (SELECT volume_id, chunk_id, sum(stored_size) OVER (PARTITION BY volume_id ORDER BY last DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS total
    FROM (SELECT user_id AS chunk_id, max(ts) AS last FROM events GROUP BY 1) JOIN v_chunks USING (chunk_id)) WHERE total <= {BUDGET}""")
def least_recent(v: Views) -> DataFrame:
    return ordered.least_recent(v.access, v.chunks, BUDGET)


@query("SELECT node, ts, event_id, abnormal FROM (SELECT *, lag(abnormal) OVER (PARTITION BY node ORDER BY ts, event_id) AS was FROM (SELECT user_id % 3 AS node, ts, event_id, event_id % 5 = 0 AS abnormal FROM events)) WHERE was IS DISTINCT FROM abnormal")
def health_changes(v: Views) -> DataFrame:
    return ordered.health_changes(v.envelopes, "node", ["ts", "event_id"], F.col("event_id") % 5 == 0)


@query("""SELECT label, day, round(value, 4) AS value, round(median, 4) AS median FROM (SELECT *, quantile_cont(value, 0.5) OVER w AS median, stddev_pop(value) OVER w AS deviation, count(*) OVER w AS n
    FROM (SELECT event_type AS label, ts::DATE AS day, avg(value) AS value FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY label ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE n >= 2 AND median > 0 AND value > median * 1.1 AND value - median > deviation * 2""")
def regressions(v: Views) -> DataFrame:
    runs = v.audit.groupBy(F.col("event_type").alias("label"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return ordered.regressions(runs)


@query("""SELECT label, day, round(value, 4) AS value, round(median, 4) AS median FROM (SELECT *, quantile_cont(value, 0.5) OVER w AS median, stddev_pop(value) OVER w AS deviation, count(*) OVER w AS n
    FROM (SELECT event_type AS label, ts::DATE AS day, avg(value) AS value FROM events GROUP BY ALL) WINDOW w AS (PARTITION BY label ORDER BY day ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) WHERE n >= 2 AND median > 0 AND value < median * 0.9 AND median - value > deviation * 2""")
def throughput_regressions(v: Views) -> DataFrame:
    runs = v.audit.groupBy(F.col("event_type").alias("label"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("value"))
    return ordered.regressions(runs, higher_is_worse=False)


@query("""SELECT e.event_id AS new_id, min(c.id) AS refused_by FROM (SELECT event_id, event_id % 500 AS path, (event_id % 60) * 2 AS start, (event_id % 60) * 2 + 5 AS stop, event_id % 2 = 0 AS exclusive FROM events) e
    JOIN (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 500 AS path, (l_linenumber * 10)::BIGINT AS start, (l_linenumber * 10 + l_quantity::BIGINT)::BIGINT AS stop, l_suppkey % 3 = 0 AS exclusive FROM lineitem) c
    ON e.path = c.path AND e.start < c.stop AND c.start < e.stop AND (e.exclusive OR c.exclusive) GROUP BY 1""")
def claim_refusals(v: Views) -> DataFrame:
    key = F.col("event_id")
    new = v.table("events").select(key.alias("new_id"), (key % 500).alias("path"), (key % 60 * 2).alias("start"), (key % 60 * 2 + 5).alias("end"), (key % 2 == 0).alias("exclusive"))
    start = (F.col("l_linenumber") * 10).cast("long")
    held = v.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("claim_id"), (F.col("l_partkey") % 500).alias("path"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), (F.col("l_suppkey") % 3 == 0).alias("exclusive"))
    return ordered.claim_refusals(new, held)


@query(f"SELECT user_id AS hash, count(*) AS hourly FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AND ts <= TIMESTAMP '{NOW}' GROUP BY 1 ORDER BY hourly DESC, hash LIMIT 100")
def hot_chunks(v: Views) -> DataFrame:
    recent = v.access.where(f"ts >= timestamp_ntz'{NOW}' - interval 24 hours and ts <= timestamp_ntz'{NOW}'")
    return tiering.hot(recent.groupBy("hash").agg(F.count("*").alias("hourly")), 1)


@query(f"SELECT user_id AS hash, max(ts) AS last FROM events GROUP BY 1 HAVING max(ts) < TIMESTAMP '{NOW}' - INTERVAL 1 DAYS")
def cold_chunks(v: Views) -> DataFrame:
    return tiering.cold(v.access.groupBy("hash").agg(F.max("ts").alias("last")), "2024-01-30 00:00:00")


@query("SELECT event_id AS id, ts, event_type, user_id AS actor_uid FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20' ORDER BY ts, id LIMIT 100")
def audit_query(v: Views) -> DataFrame:
    found = logs.audit(v.audit, event_type=["error", "purchase"], since="2024-01-05 00:00:00", until="2024-01-20 00:00:00")
    return found.select("id", "ts", "event_type", "actor_uid")


@query(f"SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS jobs, count(*) FILTER (o_orderdate + INTERVAL 30 DAYS < TIMESTAMP '{NOW_ORDERS}') AS expired FROM orders WHERE o_orderstatus IN ('O', 'P') GROUP BY ALL")
def job_backlog(v: Views) -> DataFrame:
    return logs.backlog(v.jobs, ["O", "P"], NOW_ORDERS)


@query(f"""SELECT source, sum(n)::BIGINT AS chunks, count(*) AS stored_chunks, sum(n * length)::BIGINT AS bytes, sum(length)::BIGINT AS stored_bytes FROM (SELECT source, sha256(piece) AS hash, count(*) AS n, max(octet_length(piece)) AS length
    FROM (SELECT source, encode(text)[pos * {CHUNK} + 1 : pos * {CHUNK} + {CHUNK}] AS piece FROM v_content, unnest(range(0, (octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK})) AS u(pos)) GROUP BY ALL) GROUP BY 1""")
def chunk_dedup(v: Views) -> DataFrame:
    return content.dedup_savings(content.fixed_chunks(v.content, CHUNK))


@query(f"""SELECT file_id, md5(unhex(string_agg(md5(encode(text)[pos * {PART} + 1 : pos * {PART} + {PART}]), '' ORDER BY pos))) || '-' || count(*) AS etag FROM v_content, unnest(range(0, greatest(1, (octet_length(encode(text)) + {PART - 1}) // {PART}))) AS u(pos) GROUP BY 1""")
def multipart_etags(v: Views) -> DataFrame:
    return content.part_etags(v.content, PART)


from . import lists, more  # noqa: E402, F401  they add their queries to QUERIES and SQL
