"""Queries of access, placement, paths, logs, tiering, capacity, files and statistics, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.functions import keys, paths as path_functions, units
from stratalog.operators import access, capacity, catalog, content, files, logs, ordered, paths, placement, stats, tiering
from stratalog.streaming import counters

from .registry import CHUNK, NEEDS, NOW, NOW_ORDERS, VIEWS, query, usage
from .views import Views

NODE, DRIVE = 7, 3
VIEWS.update(
    {
        "v_objects": """SELECT p_partkey AS object_id, p_partkey % 7 AS uid, p_partkey % 5 AS gid, p_partkey * 37 % 512 AS mode, CASE WHEN p_partkey % 3 = 0 THEN (p_size % 8)::BIGINT END AS user_id, (p_size % 8)::BIGINT AS user_bits,
            CASE WHEN p_partkey % 4 = 0 THEN (p_size % 6)::BIGINT END AS group_id, (p_partkey // 8) % 8 AS group_bits, CASE WHEN p_partkey % 5 = 0 THEN (p_partkey // 64) % 8 ELSE 7 END AS mask FROM part""",
        "v_requests": "SELECT l_partkey AS object_id, l_suppkey % 8 AS uid, (l_linenumber % 6)::BIGINT AS gid, [4, 2, 1][(l_orderkey % 3 + 1)::INT]::BIGINT AS want FROM lineitem",
        "v_locks": """SELECT event_id AS lock_id, '/src' || event_id % 20 || CASE WHEN event_id % 3 = 0 THEN '' ELSE '/d' || event_id % 7 END || CASE WHEN event_id % 4 <> 1 THEN '' ELSE '/f' || event_id % 50 END AS path,
            event_id % 2 = 0 AS deep, user_id % 4 = 0 AS exclusive, user_id AS holder, ts + INTERVAL 10 DAYS AS expires_at FROM events""",
        "v_targets": "SELECT doc_id AS target_id, '/' || coalesce(source, 'none') || '/d' || doc_id % 7 || '/f' || doc_id % 50 AS path FROM documents",
        "v_ranges": "SELECT row_number() OVER () AS id, l_orderkey AS file_id, l_suppkey AS client, (l_linenumber * 10)::BIGINT AS start, (l_linenumber * 10 + l_quantity::BIGINT)::BIGINT AS stop, l_partkey % 3 = 0 AS exclusive FROM lineitem",
        "v_stats": "SELECT user_id AS chunk_id, count(*) AS daily, max(ts) AS last FROM events GROUP BY 1",
        "v_escalations": """SELECT event_id AS id, event_type AS category, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'resolved' ELSE 'expired' END AS status,
            CASE WHEN event_id % 4 = 0 THEN 'critical' ELSE 'warning' END AS severity, ts AS created_at, ts + INTERVAL 3 DAYS AS expires_at FROM events""",
        "v_jobs": "SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderpriority AS priority, o_orderdate AS created_at, o_orderdate + INTERVAL 30 DAYS AS expires_at FROM orders",
        "v_copies": "SELECT chunk_id, volume_id, stored_size, (SELECT count(*) FROM v_locations l WHERE l.chunk_id = c.chunk_id) AS copies FROM v_chunks c",
        "v_spread": "SELECT node, drive_id, tier, state, row_number() OVER (ORDER BY turn, node) AS place FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY drive_id) AS turn FROM v_drives)",
    }
)
NEEDS.update({"v_copies": ("v_chunks", "v_locations"), "v_spread": ("v_drives",)})


def sizes(v: Views) -> DataFrame:
    return v.file_chunks.join(v.chunks.select("chunk_id", "stored_size"), "chunk_id")


# access

BITS = """CASE WHEN r.uid = o.uid THEN mode // 64 WHEN user_id IS NOT DISTINCT FROM r.uid THEN user_bits & mask WHEN r.gid = o.gid OR group_id IS NOT DISTINCT FROM r.gid
    THEN (CASE WHEN r.gid = o.gid THEN (mode // 8) % 8 & mask ELSE 0 END) | (CASE WHEN group_id IS NOT DISTINCT FROM r.gid THEN group_bits & mask ELSE 0 END) ELSE mode % 8 END"""


@query(f"SELECT object_id, count(*) FILTER (allowed) AS granted, count(*) FILTER (NOT allowed) AS denied FROM (SELECT object_id, r.uid = 0 OR (({BITS}) & want) <> 0 AS allowed FROM v_requests r JOIN v_objects o USING (object_id)) GROUP BY 1")
def access_decisions(v: Views) -> DataFrame:
    found = access.decisions(v.requests, v.objects)
    return found.groupBy("object_id").agg(F.count_if("allowed").alias("granted"), F.count_if(~F.col("allowed")).alias("denied"))


@query("SELECT n_nationkey::BIGINT AS volume_id, ([4, 6, 7][(n_nationkey % 3 + 1)::INT] | CASE WHEN n_nationkey % 2 = 0 THEN 4 ELSE 0 END)::BIGINT AS bits FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey % 5 = 0")
def volume_permissions(v: Views) -> DataFrame:
    names = F.array(F.element_at(F.array(*map(F.lit, access.VOLUME_BITS)), (F.col("volume_id") % 3 + 1).cast("int")), F.when(F.col("volume_id") % 2 == 0, "read").otherwise(F.element_at(F.array(*map(F.lit, access.VOLUME_BITS)), (F.col("volume_id") % 3 + 1).cast("int"))))
    asked = F.when(F.col("volume_id") % 5 == 0, F.array(F.lit("own"))).otherwise(names)
    return v.volumes.select("volume_id", access.volume_bits(asked).alias("bits"))


# placement


@query("SELECT volume_id, u.place::BIGINT AS place, drive_id, node FROM v_volumes, unnest(range(1, factor + 1)) AS u(place) JOIN v_spread s ON s.place = u.place WHERE min_copies <= (SELECT count(*) FROM v_drives)")
def metadata_replicas(v: Views) -> DataFrame:
    return placement.metadata_replicas(v.volumes, v.drives)


@query("""SELECT chunk_id, coalesce(t, 0) AS trusted, greatest(0, factor - coalesce(t, 0)) AS add, greatest(0, coalesce(t, 0) - factor) AS drop, greatest(0, min_copies - coalesce(t, 0)) AS shortfall FROM v_chunks JOIN v_volumes USING (volume_id)
    LEFT JOIN (SELECT chunk_id, count(*) AS t FROM v_locations JOIN v_drives USING (drive_id) WHERE state = 'active' GROUP BY 1) USING (chunk_id)""")
def replica_delta(v: Views) -> DataFrame:
    return placement.replica_delta(v.chunks, v.volumes, v.locations, v.drives.where("state = 'active'"))


@query("""SELECT chunk_id, place, drive_id FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY turn, held, node) AS place FROM (
    SELECT s.chunk_id, s.add, d.node, d.drive_id, coalesce(h.held, 0) AS held, row_number() OVER (PARTITION BY s.chunk_id, d.node ORDER BY d.drive_id) AS turn
    FROM (SELECT chunk_id, greatest(0, factor + 2 - copies) AS add FROM v_copies JOIN v_volumes USING (volume_id)) s JOIN v_drives d ON d.state = 'active' AND s.add > 0
    LEFT JOIN (SELECT chunk_id, node, count(*) AS held FROM v_locations JOIN v_drives USING (drive_id) GROUP BY ALL) h ON h.chunk_id = s.chunk_id AND h.node = d.node
    ANTI JOIN v_locations l ON l.chunk_id = s.chunk_id AND l.drive_id = d.drive_id)) WHERE place <= add""")
def replica_targets(v: Views) -> DataFrame:
    held = v.locations.groupBy("chunk_id").agg(F.count("*").alias("copies"))
    short = v.chunks.join(v.volumes, "volume_id").join(held, "chunk_id", "left").select("chunk_id", F.greatest(F.lit(0), F.col("factor") + 2 - F.coalesce("copies", F.lit(0))).alias("add"))
    return placement.replica_targets(short, v.locations, v.drives, 5)


@query("""SELECT stripe_id, idx, drive_id FROM (SELECT stripe_id, count(*) AS shards FROM v_shards GROUP BY 1), unnest(range(0, shards)) AS u(idx), (SELECT count(*) AS n FROM v_drives WHERE state = 'active') JOIN (SELECT drive_id, row_number() OVER (ORDER BY turn, node) AS place
    FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY drive_id) AS turn FROM v_drives WHERE state = 'active')) s ON s.place = idx % n + 1""")
def stripe_targets(v: Views) -> DataFrame:
    stripes = v.shards.groupBy("stripe_id").agg(F.count("*").alias("shards"))
    return placement.stripe_targets(stripes, placement.spread(v.drives.where("state = 'active'").select("node", "drive_id")))


@query("SELECT stripe_id, count(DISTINCT drive_id) AS drives, count(DISTINCT node) AS nodes, count(DISTINCT node) >= 3 AS safe FROM v_shards JOIN v_locations USING (chunk_id) JOIN v_drives USING (drive_id) GROUP BY 1")
def placement_check(v: Views) -> DataFrame:
    return placement.placement_check(v.dealt(v.shards.join(v.locations, "chunk_id").select("stripe_id", "drive_id"), "stripe_id"), v.drives, 2)


SCORE = f"CASE WHEN tier IS NULL THEN 100 WHEN tier = 'hot' THEN CASE WHEN node = {NODE} THEN 0 ELSE 10 END WHEN state = 'standby' THEN 50 WHEN node = {NODE} THEN 20 ELSE 30 END"


@query(f"SELECT chunk_id, arg_min(drive_id, (score, md5(chunk_id || ':' || drive_id))) AS drive_id, min(score)::BIGINT AS score FROM (SELECT chunk_id, drive_id, {SCORE} AS score FROM v_locations LEFT JOIN v_drives USING (drive_id)) GROUP BY 1")
def best_copies(v: Views) -> DataFrame:
    return placement.best_copies(v.locations, v.drives, NODE)


@query("SELECT node, round(0.3 * least(latency / 1000.0, 1.0) + 0.4 * load + 0.3 * queue + CASE WHEN off THEN 1.0 ELSE 0.0 END, 6) AS cost FROM (SELECT user_id AS node, avg(value) * 5 AS latency, count(*) % 10 / 10.0 AS load, (max(event_id) % 7) / 7 AS queue, user_id % 9 = 0 AS off FROM events GROUP BY ALL)")
def node_costs(v: Views) -> DataFrame:
    measured = v.table("events").groupBy(F.col("user_id").alias("node")).agg((F.avg("value") * 5).alias("latency_ms"), (F.count("*") % 10 / 10.0).alias("load"), (F.max("event_id") % 7 / 7).alias("queue")).withColumn("off_duty", F.col("node") % 9 == 0)
    return placement.node_costs(measured).withColumn("cost", F.round("cost", 6))


@query("SELECT drive_id, node, tier, CASE WHEN capacity_bytes > 0 THEN used / capacity_bytes ELSE 0.0 END AS ratio FROM v_usage WHERE state = 'active' AND CASE WHEN capacity_bytes > 0 THEN used / capacity_bytes ELSE 0.0 END < 0.9")
def eligible_drives(v: Views) -> DataFrame:
    return placement.eligible(usage(v), 0.9)


@query("SELECT node, tier, arg_min(drive_id, (CASE state WHEN 'active' THEN 0 ELSE 1 END, CASE WHEN capacity_bytes > 0 THEN used / capacity_bytes ELSE 0.0 END, drive_id)) AS drive_id FROM v_usage WHERE state <> 'draining' GROUP BY ALL")
def write_targets(v: Views) -> DataFrame:
    return placement.write_targets(usage(v))


@query("SELECT a.drive_id, b.tier AS to_tier, arg_min(b.drive_id, (b.used, b.drive_id)) AS target FROM v_usage a JOIN v_usage b ON a.node = b.node AND a.drive_id <> b.drive_id AND b.state <> 'draining' GROUP BY ALL")
def move_targets(v: Views) -> DataFrame:
    return placement.move_targets(usage(v), list(tiering.TIERS))


@query("""SELECT tier, source, target FROM (SELECT tier, max(ratio) FILTER (ratio > mean) AS hi, min(ratio) FILTER (ratio < mean) AS lo, arg_max(drive_id, (ratio, -drive_id)) FILTER (ratio > mean) AS source, arg_min(drive_id, (ratio, drive_id)) FILTER (ratio < mean) AS target
    FROM (SELECT tier, drive_id, used / capacity_bytes AS ratio, sum(used) OVER w / sum(capacity_bytes) OVER w AS mean, count(*) OVER w AS n FROM v_usage WHERE capacity_bytes > 0 WINDOW w AS (PARTITION BY tier)) WHERE n >= 2 GROUP BY 1) WHERE hi - lo >= 0.05""")
def rebalance_pairs(v: Views) -> DataFrame:
    return placement.rebalance_pairs(usage(v), 0.05)


@query(f"""SELECT chunk_id, copies - 1 AS others, CASE WHEN chunk_id IN (SELECT chunk_id FROM v_shards WHERE stripe_id % 2 = 0) THEN 'migrate' WHEN copies - 1 >= factor THEN 'delete' ELSE 'migrate' END AS action
    FROM v_copies JOIN v_volumes USING (volume_id) WHERE chunk_id IN (SELECT chunk_id FROM v_locations WHERE drive_id = {DRIVE})""")
def evacuation(v: Views) -> DataFrame:
    return placement.evacuation(v.chunks, v.volumes, v.shards.where("stripe_id % 2 = 0"), v.locations, DRIVE)


POINT = "('0x' || substring(sha256({}), 1, 8))::BIGINT"
RING = f"SELECT node, {POINT.format('node || chr(58) || k')} AS point FROM (SELECT DISTINCT node FROM v_drives{{}}), unnest(range(0, 16)) AS u(k)"
OWNERS = "SELECT segment, list(node ORDER BY spot)[1:3] AS owners FROM (SELECT s.segment, node, min(CASE WHEN point >= s.segment * 16777216 THEN point ELSE point + 4294967296 END) AS spot FROM ({}), (SELECT unnest(range(0, 256)) AS segment) s GROUP BY ALL) GROUP BY 1"


def ring(v: Views, without: int | None = None) -> DataFrame:
    nodes = v.drives.select("node").distinct()
    return placement.ring_owners(placement.ring_points(nodes if without is None else nodes.where(F.col("node") != without), 16), 3)


@query(f"SELECT segment, array_to_string(owners, ',') AS owners FROM ({OWNERS.format(RING.format(''))})")
def ring_segments(v: Views) -> DataFrame:
    return ring(v).select("segment", F.array_join(F.transform("owners", lambda o: o.cast("string")), ",").alias("owners"))


@query(f"""SELECT segment, array_to_string(list_filter(b.owners, lambda x: NOT list_contains(a.owners, x)), ',') AS gained, array_to_string(list_filter(a.owners, lambda x: NOT list_contains(b.owners, x)), ',') AS lost
    FROM ({OWNERS.format(RING.format(''))}) a JOIN ({OWNERS.format(RING.format(f' WHERE node <> {NODE}'))}) b USING (segment) WHERE a.owners <> b.owners""")
def ring_changes(v: Views) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda o: o.cast("string")), ",").alias(c)
    return placement.ring_changes(ring(v), ring(v, NODE)).select("segment", text("gained"), text("lost"))


# paths


@query("""SELECT target_id, count(*) AS locks, max(lock_id) AS last FROM v_targets t JOIN v_locks l ON t.path = l.path OR (l.deep AND starts_with(t.path, l.path || '/')) GROUP BY 1""")
def covering_locks(v: Views) -> DataFrame:
    return paths.covering_locks(v.targets, v.locks)


@query("SELECT root, count(*) AS locks FROM (SELECT DISTINCT '/src' || doc_id % 20 AS root FROM documents) JOIN v_locks ON starts_with(path, root || '/') GROUP BY 1")
def locks_below(v: Views) -> DataFrame:
    roots = v.table("documents").select(F.concat(F.lit("/src"), (F.col("doc_id") % 20).cast("string")).alias("root"))
    return paths.locks_below(roots, v.locks).groupBy("root").agg(F.count("*").alias("locks"))


@query("""SELECT a.target_id AS asked_id, count(*) AS conflicts FROM (SELECT *, target_id % 3 = 0 AS deep, target_id % 2 = 0 AS exclusive FROM v_targets) a JOIN v_locks l
    ON (a.path = l.path OR (l.deep AND starts_with(a.path, l.path || '/')) OR (a.deep AND starts_with(l.path, a.path || '/'))) AND (a.exclusive OR l.exclusive) GROUP BY 1""")
def lock_overlaps(v: Views) -> DataFrame:
    asked = v.targets.select(F.col("target_id").alias("asked_id"), "path", (F.col("target_id") % 3 == 0).alias("deep"), (F.col("target_id") % 2 == 0).alias("exclusive"))
    return paths.lock_overlaps(asked, v.locks)


KIND = "['path', 'create', 'pinned', 'subtree', 'byte_range'][(lock_id % 5 + 1)::INT]"


@query(f"""SELECT new_id, count(*) AS conflicts FROM (SELECT target_id AS new_id, path, target_id % 4 = 0 AS tree, target_id % 2 = 0 AS exclusive FROM v_targets) a JOIN (SELECT path, {KIND} AS kind, exclusive FROM v_locks) c
    ON kind <> 'byte_range' AND (a.path = c.path OR (kind = 'subtree' AND starts_with(a.path, c.path || '/')) OR (a.tree AND starts_with(c.path, a.path || '/'))) AND (a.exclusive OR c.exclusive) GROUP BY 1""")
def claim_overlaps(v: Views) -> DataFrame:
    new = v.targets.select(F.col("target_id").alias("new_id"), "path", F.when(F.col("target_id") % 4 == 0, "subtree").otherwise("create").alias("kind"), (F.col("target_id") % 2 == 0).alias("exclusive"))
    kinds = F.array(*map(F.lit, ("path", "create", "pinned", "subtree", "byte_range")))
    claims = v.locks.select(F.col("lock_id").alias("claim_id"), "path", F.element_at(kinds, (F.col("lock_id") % 5 + 1).cast("int")).alias("kind"), "exclusive")
    return paths.claim_overlaps(new, claims)


@query("SELECT a.file_id, count(*) AS conflicts FROM v_ranges a JOIN v_ranges b ON a.file_id = b.file_id AND a.id < b.id AND a.client <> b.client AND a.start < b.stop AND b.start < a.stop AND (a.exclusive OR b.exclusive) GROUP BY 1")
def range_lock_conflicts(v: Views) -> DataFrame:
    return paths.range_conflicts(v.ranges)


@query("SELECT split_part(substring(path, 2), '/', 1) AS name, true AS is_dir, count(*) AS entries FROM v_targets GROUP BY 1")
def directory_listing(v: Views) -> DataFrame:
    return paths.listed(v.targets, "/")


@query("""SELECT path, path <> '' AND starts_with(path, '/') AND NOT contains(path, '..') AND (path = '/' OR NOT ends_with(path, '/')) AS valid, CASE WHEN path = '/' THEN path ELSE rtrim(path, '/') END AS normal,
    CASE WHEN path = '/' THEN NULL WHEN regexp_extract(path, '^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS parent, '/' || array_to_string(list_filter(string_split(path, '/'), lambda p: p <> ''), '/') AS directory
    FROM (SELECT DISTINCT CASE doc_id % 6 WHEN 0 THEN '/' WHEN 1 THEN path || '//' WHEN 2 THEN substring(path, 2) WHEN 3 THEN '/a/../b' WHEN 4 THEN '/' || doc_id ELSE path END AS path FROM (SELECT target_id AS doc_id, path FROM v_targets))""")
def path_forms(v: Views) -> DataFrame:
    key, path = F.col("target_id") % 6, F.col("path")
    form = F.when(key == 0, "/").when(key == 1, F.concat(path, F.lit("//"))).when(key == 2, F.expr("substring(path, 2)")).when(key == 3, "/a/../b").when(key == 4, F.concat(F.lit("/"), F.col("target_id").cast("string"))).otherwise(path)
    shown = v.targets.select(form.alias("path")).distinct()
    return shown.select("path", path_functions.valid(path).alias("valid"), path_functions.normalized(path).alias("normal"), path_functions.parent(path).alias("parent"), path_functions.of_prefix(path).alias("directory"))


# logs


def resources(v: Views) -> DataFrame:
    return v.audit.withColumn("resource", F.when(F.col("actor_uid") % 10 != 0, F.concat(F.lit("/vol"), (F.col("actor_uid") % 5).cast("string"), F.lit("/"), F.col("id").cast("string"))))


@query("SELECT event_id AS id, ts, event_type, user_id AS actor_uid FROM events WHERE user_id % 10 <> 0 AND user_id % 5 = 2 AND event_type = 'view' AND ts >= TIMESTAMP '2024-01-03' ORDER BY ts, id LIMIT 100")
def audit_by_resource(v: Views) -> DataFrame:
    return logs.audit(resources(v), event_type="view", resource="/vol2/", since="2024-01-03 00:00:00").select("id", "ts", "event_type", "actor_uid")


@query("SELECT event_id AS id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_audit(v: Views) -> DataFrame:
    return logs.recent(v.audit).select("id", "ts")


@query("SELECT id, ts FROM (SELECT event_id AS id, ts, row_number() OVER (PARTITION BY user_id % 3 ORDER BY ts, event_id) AS n FROM events) WHERE n <= 40 ORDER BY ts DESC, id DESC LIMIT 40")
def cluster_audit(v: Views) -> DataFrame:
    return logs.cluster_audit(v.audit.withColumn("node", F.col("actor_uid") % 3), "node", 40).select("id", "ts")


@query("SELECT id, category, severity, created_at FROM v_escalations WHERE status = 'pending' AND category IN ('error', 'click')")
def escalation_list(v: Views) -> DataFrame:
    return logs.escalations(v.escalations, "pending", ["error", "click"]).select("id", "category", "severity", "created_at")


@query(f"SELECT category, count(*) FILTER (status = 'pending' AND expires_at > TIMESTAMP '{NOW}') AS pending, count(*) FILTER (status = 'expired' OR (status = 'pending' AND expires_at <= TIMESTAMP '{NOW}')) AS expired FROM v_escalations GROUP BY 1")
def escalation_sweep(v: Views) -> DataFrame:
    swept = logs.swept_escalations(v.escalations, NOW)
    return swept.groupBy("category").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "expired").alias("expired"))


@query("SELECT category, count(*) AS pending FROM v_escalations WHERE status = 'pending' GROUP BY 1")
def pending_escalations(v: Views) -> DataFrame:
    return logs.pending_by_category(v.escalations)


@query("SELECT priority, count(*) FILTER (expires_at > TIMESTAMP '2001-07-01') AS active, count(*) FILTER (expires_at <= TIMESTAMP '2001-07-01') AS expired FROM v_jobs GROUP BY 1")
def lease_states(v: Views) -> DataFrame:
    return logs.leases(v.jobs, "2001-07-01 00:00:00")


@query(f"SELECT job_id, created_at FROM v_jobs WHERE status = 'O' AND created_at < TIMESTAMP '{NOW_ORDERS}' - INTERVAL 3600 SECONDS")
def orphaned_writes(v: Views) -> DataFrame:
    return logs.orphans(v.jobs.where("status = 'O'"), NOW_ORDERS, 3600).select("job_id", "created_at")


@query(f"SELECT id, last_run FROM (SELECT c_custkey AS id, (c_custkey % 4) * 86400 * 30 AS interval_s, max(o_orderdate) AS last_run FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL) WHERE interval_s > 0 AND (last_run IS NULL OR epoch(TIMESTAMP '{NOW_ORDERS}') - epoch(last_run) >= interval_s)")
def due_schedules(v: Views) -> DataFrame:
    runs = v.table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.max("o_orderdate").alias("last_run"))
    return logs.due(v.table("customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 4 * 86400 * 30).alias("interval_s")).join(runs, "id", "left"), NOW_ORDERS).select("id", "last_run")


@query("SELECT priority, max(created_at) AS latest FROM v_jobs WHERE status = 'F' GROUP BY 1")
def latest_completed(v: Views) -> DataFrame:
    return logs.latest_completed(v.jobs.where("status = 'F'"), "priority", "created_at")


@query("SELECT DISTINCT name, day FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') || ['', '.jsonl', '.tmp'][(o_orderkey % 3 + 1)::INT] AS name, o_orderdate::DATE AS day, o_orderkey % 3 AS k FROM orders) WHERE k < 2 AND day < DATE '2001-08-02' - 90")
def expired_files(v: Views) -> DataFrame:
    end = F.element_at(F.array(F.lit(""), F.lit(".jsonl"), F.lit(".tmp")), (F.col("job_id") % 3 + 1).cast("int"))
    return logs.expired_files(v.jobs.select(F.concat(F.date_format("created_at", "yyyy-MM-dd"), end).alias("name")).distinct(), "2001-08-02", 90)


@query("""WITH RECURSIVE g AS (SELECT user_id, epoch(date_trunc('second', ts))::BIGINT AS s, count(*) AS n FROM events GROUP BY ALL), e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s) AS k FROM g),
    w AS (SELECT user_id, k, s AS begun, least(n, 3) AS used, least(n, 3) AS passed, n AS asked FROM e WHERE k = 1
    UNION ALL SELECT e.user_id, e.k, CASE WHEN e.s - begun < 86400 THEN begun ELSE e.s END, CASE WHEN e.s - begun < 86400 THEN used ELSE 0 END + least(e.n, greatest(0, 3 - CASE WHEN e.s - begun < 86400 THEN used ELSE 0 END)),
    passed + least(e.n, greatest(0, 3 - CASE WHEN e.s - begun < 86400 THEN used ELSE 0 END)), asked + e.n FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
    SELECT user_id, max(passed) AS passed, max(asked) - max(passed) AS refused FROM w GROUP BY 1""")
def rate_limits(v: Views) -> DataFrame:
    return logs.rate_limited(v.table("events").select("user_id", "ts"), "user_id", 3, 86_400)


# tiering

SCORED = f"SELECT c.chunk_id, tier, daily, last, CASE WHEN last IS NULL THEN -87600.0 ELSE -(epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', last))) / 3600.0 END + coalesce(daily, 0) * 10 AS score FROM (SELECT chunk_id, arg_min(tier, drive_id) AS tier FROM v_locations JOIN v_drives USING (drive_id) GROUP BY 1) c LEFT JOIN (SELECT chunk_id, daily % 20 AS daily, last FROM v_stats) USING (chunk_id)"


@query(f"""SELECT chunk_id, tier, CASE WHEN evict THEN 'evict' ELSE reason END AS reason, CASE WHEN NOT evict AND reason = 'promote' THEN CASE tier WHEN 'cold' THEN 'warm' ELSE 'hot' END ELSE CASE tier WHEN 'hot' THEN 'warm' ELSE 'cold' END END AS to_tier FROM (
    SELECT *, tier = 'warm' AND row_number() OVER (PARTITION BY tier ORDER BY score, chunk_id) <= 10 AS evict,
    CASE WHEN coalesce(daily, 0) >= 10 AND tier <> 'hot' THEN 'promote' WHEN (last IS NULL OR epoch(TIMESTAMP '{NOW}') - epoch(date_trunc('second', last)) > 86400) AND tier <> 'cold' THEN 'demote' END AS reason FROM ({SCORED})) WHERE evict OR reason IS NOT NULL""")
def tier_moves(v: Views) -> DataFrame:
    placed = v.locations.join(F.broadcast(v.drives.select("drive_id", "tier")), "drive_id").groupBy("chunk_id").agg(F.min_by("tier", "drive_id").alias("tier"))
    full = v.drives.select("tier").where("tier = 'warm'")
    return tiering.moves(placed, v.stats.withColumn("daily", F.col("daily") % 20), full, NOW, 100)


@query(f"""WITH RECURSIVE h AS (SELECT user_id AS hash, floor(epoch(ts) / 3600)::BIGINT AS h, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL),
    e AS (SELECT hash, min(h) AS h0, max(last) AS last FROM h GROUP BY 1),
    w AS (SELECT hash, h0 AS h, (SELECT n FROM h WHERE h.hash = e.hash AND h.h = e.h0) AS daily, 0::BIGINT AS staleness FROM e
    UNION ALL SELECT w.hash, w.h + 1, CASE WHEN staleness >= 3 AND coalesce(n, 0) = 0 THEN 0 ELSE daily - daily // 24 + coalesce(n, 0) END, CASE WHEN staleness >= 3 AND coalesce(n, 0) = 0 THEN staleness WHEN daily - daily // 24 + coalesce(n, 0) = 0 THEN staleness + 1 ELSE 0 END
    FROM w LEFT JOIN h ON h.hash = w.hash AND h.h = w.h + 1 WHERE w.h < floor(epoch(TIMESTAMP '{NOW}') / 3600)::BIGINT)
    SELECT hash, daily::BIGINT AS daily, staleness, last FROM w JOIN e USING (hash) WHERE h = floor(epoch(TIMESTAMP '{NOW}') / 3600)::BIGINT AND staleness < 3""")
def decayed_counts(v: Views) -> DataFrame:
    return tiering.decayed(v.access, NOW)


@query(f"""SELECT hash, hourly, daily, last, staleness FROM (SELECT *, row_number() OVER (ORDER BY gone, last, hash) AS m, count(*) FILTER (NOT gone) OVER () AS stay FROM (SELECT *, hourly = 0 AND daily = 0 AND row_number() OVER (PARTITION BY hourly = 0 AND daily = 0 ORDER BY staleness DESC, last, hash) <= total - 60 AS gone FROM (
    SELECT user_id AS hash, count(*) FILTER (event_type = 'error') % 3 AS hourly, count(*) % 2 AS daily, max(ts) AS last, user_id % 4 AS staleness, count(*) OVER () AS total FROM events GROUP BY user_id))) WHERE NOT gone AND m > stay - least(60, stay)""")
def pruned_counts(v: Views) -> DataFrame:
    found = v.table("events").groupBy(F.col("user_id").alias("hash")).agg((F.count_if(F.col("event_type") == "error") % 3).alias("hourly"), (F.count("*") % 2).alias("daily"), F.max("ts").alias("last")).withColumn("staleness", F.col("hash") % 4)
    return tiering.pruned(found, 60)


@query("SELECT user_id AS hash, date_trunc('hour', ts) AS hour, count(*) AS n, max(ts) AS last FROM events GROUP BY ALL")
def hourly_reads(v: Views) -> DataFrame:
    found = counters.hourly_counts(v.access)
    return found.select("hash", F.col("hour").cast("timestamp_ntz").alias("hour"), "n", F.col("last").cast("timestamp_ntz").alias("last"))


# capacity


@query("SELECT count(*) AS drives, sum(used)::BIGINT AS used, CASE WHEN bool_and(capacity_bytes > 0) THEN sum(capacity_bytes)::BIGINT END AS capacity, CASE WHEN bool_and(capacity_bytes > 0) THEN sum(greatest(0, capacity_bytes - used))::BIGINT END AS available FROM v_usage")
def cluster_capacity(v: Views) -> DataFrame:
    return capacity.cluster_capacity(usage(v))


@query("SELECT CASE WHEN bool_and(capacity_bytes > 0) THEN sum(greatest(0, capacity_bytes - used))::BIGINT END AS available FROM v_usage WHERE state <> 'draining' AND tier = 'warm' AND drive_id % 10 <> 0")
def tier_capacity(v: Views) -> DataFrame:
    return capacity.available(usage(v).where("drive_id % 10 <> 0"), "warm")


@query("SELECT drive_id, sum(stored_size)::BIGINT AS redundant FROM v_locations JOIN v_copies USING (chunk_id) LEFT JOIN v_volumes USING (volume_id) WHERE copies > coalesce(factor, 3) GROUP BY 1")
def redundant_bytes(v: Views) -> DataFrame:
    return capacity.redundant_bytes(v.locations, v.chunks, v.volumes)


@query("""SELECT tier, round(mean, 6) AS mean, round(spread, 6) AS spread, spread >= 0.1 AS uneven, overfull FROM (SELECT tier, any_value(mean) AS mean, max(ratio) - min(ratio) AS spread, sum(CASE WHEN ratio - mean >= 0.05 THEN greatest(0, used - floor(capacity_bytes * mean)) ELSE 0 END)::BIGINT AS overfull
    FROM (SELECT *, used / capacity_bytes AS ratio, sum(used) OVER w / sum(capacity_bytes) OVER w AS mean FROM v_usage WHERE capacity_bytes > 0 WINDOW w AS (PARTITION BY tier)) GROUP BY 1)""")
def tier_balance(v: Views) -> DataFrame:
    return capacity.tier_balance(usage(v), 0.1)


@query("SELECT node, count(*) AS drives, count(*) FILTER (state = 'draining') AS failing, CASE WHEN bool_and(state = 'draining') THEN 'unhealthy' WHEN bool_or(state = 'draining') THEN 'degraded' ELSE 'healthy' END AS health FROM v_drives GROUP BY 1")
def drive_health(v: Views) -> DataFrame:
    return capacity.drive_health(v.drives)


@query("SELECT round(u, 6) AS utilisation, w AS writable, CASE WHEN w = 0 OR u >= 0.95 THEN 'unhealthy' WHEN u >= 0.85 THEN 'degraded' ELSE 'healthy' END AS health FROM (SELECT sum(used) FILTER (capacity_bytes > 0) / sum(capacity_bytes) AS u, count(*) FILTER (state = 'active') AS w FROM v_usage)")
def storage_health(v: Views) -> DataFrame:
    return capacity.storage_health(usage(v))


@query("SELECT v.volume_id, coalesce(bool_or(copies < factor), false) AS degraded FROM v_volumes v LEFT JOIN v_copies c ON c.volume_id = v.volume_id GROUP BY 1")
def degraded_volumes(v: Views) -> DataFrame:
    return capacity.degraded_volumes(v.chunks, v.locations, v.volumes)


@query("SELECT volume_id, CASE WHEN factor > 2 THEN 'under_replicated' ELSE 'escalation' END AS condition FROM v_volumes")
def volume_conditions(v: Views) -> DataFrame:
    return capacity.volume_conditions(v.volumes, 2, 5, 0.5, 1)


@query("""SELECT volume_id, count(*) FILTER (verdict = 'ok') AS fit, count(*) FILTER (verdict = 'over_capacity') AS over, count(*) FILTER (verdict = 'too_many_files') AS many FROM (SELECT w.volume_id, CASE WHEN max_bytes IS NOT NULL AND coalesce(b, 0) + stored_size > max_bytes THEN 'over_capacity'
    WHEN max_files IS NOT NULL AND coalesce(n, 0) >= max_files THEN 'too_many_files' ELSE 'ok' END AS verdict FROM v_chunks w JOIN (SELECT volume_id, CASE WHEN volume_id % 3 = 0 THEN 2000 WHEN volume_id % 3 = 1 THEN 1000000000000 END AS max_bytes, CASE WHEN volume_id % 4 = 1 THEN 1 END AS max_files FROM v_volumes) USING (volume_id)
    LEFT JOIN (SELECT volume_id, count(*) AS n, 0 AS b FROM v_files GROUP BY 1) USING (volume_id)) GROUP BY 1""")
def quota_checks(v: Views) -> DataFrame:
    key = F.col("volume_id")
    limits = v.volumes.select("volume_id", F.when(key % 3 == 0, 2_000).when(key % 3 == 1, 10**12).cast("long").alias("max_bytes"), F.when(key % 4 == 1, 1).alias("max_files"))
    use = v.files.groupBy("volume_id").agg(F.count("*").alias("files"), F.lit(0).alias("logical_bytes"))
    found = capacity.quota_checks(v.chunks.select("volume_id", F.col("stored_size").alias("bytes")), limits, use)
    return found.groupBy("volume_id").agg(*(F.count_if(F.col("verdict") == k).alias(a) for k, a in (("ok", "fit"), ("over_capacity", "over"), ("too_many_files", "many"))))


@query("""SELECT drive_id, level, CASE WHEN level = 'boost' THEN 15 WHEN level = 'critical' THEN 60 ELSE 10 END AS scrub, 80 AS user_write FROM (SELECT drive_id, CASE WHEN r >= 0.95 THEN 'critical' WHEN r >= 0.85 THEN 'boost' ELSE 'normal' END AS level FROM (SELECT drive_id, CASE WHEN capacity_bytes > 0 THEN used / capacity_bytes ELSE 0 END AS r FROM v_usage))""")
def pressure_levels(v: Views) -> DataFrame:
    found = usage(v).select("drive_id", capacity.pressure_level(F.col("used"), F.col("capacity_bytes")).alias("level"))
    return found.select("drive_id", "level", *(capacity.work_weight(F.lit(k), F.col("level")).alias(k) for k in ("scrub", "user_write")))


@query("SELECT size AS p_size, CASE size % 5 WHEN 0 THEN size WHEN 1 THEN size * 1048576 WHEN 2 THEN (size + 0.5) * 1073741824 WHEN 3 THEN NULL ELSE size * 1024 * 1073741824 END::BIGINT AS bytes FROM (SELECT DISTINCT p_size::BIGINT AS size FROM part)")
def capacity_texts(v: Views) -> DataFrame:
    size, end = F.col("p_size").cast("string"), F.array(F.lit(""), F.lit("M"), F.lit(".5G"), F.lit("X"), F.lit("T"))
    rows = v.table("part").select(F.col("p_size").cast("long").alias("p_size")).distinct()
    return rows.select("p_size", units.text_bytes(F.concat(size, F.element_at(end, (F.col("p_size") % 5 + 1).cast("int")))).alias("bytes"))


@query("SELECT class, count(*) AS events, max(skew)::BIGINT AS worst FROM (SELECT skew, CASE WHEN skew >= 1000 THEN 'quarantine' WHEN skew >= 500 THEN 'critical' WHEN skew >= 200 THEN 'warning' ELSE 'ok' END AS class FROM (SELECT abs((event_id + (value * 3)::INT) - (event_id + (user_id * 2) // 2)) AS skew FROM (SELECT event_id, user_id, floor(value)::INT AS value FROM events))) GROUP BY 1")
def clock_skews(v: Views) -> DataFrame:
    remote = F.col("event_id") + F.floor(F.col("value")) * 3
    skew = units.skew_ms(F.col("event_id"), F.col("event_id") + F.col("user_id") * 2, remote)
    return v.table("events").select(skew.cast("long").alias("skew")).withColumn("class", units.skew_class(F.col("skew"))).groupBy("class").agg(F.count("*").alias("events"), F.max("skew").alias("worst"))


@query("SELECT node, up - reachable::INT AS left, up - reachable::INT >= n // 2 + 1 AS survives FROM (SELECT *, count(*) OVER () AS n, count(*) FILTER (reachable) OVER () AS up FROM (SELECT node, bool_or(state = 'active') AND node % 2 = 0 AS reachable FROM v_drives GROUP BY 1))")
def quorum_survival(v: Views) -> DataFrame:
    nodes = v.drives.groupBy("node").agg((F.bool_or(F.col("state") == "active")).alias("on")).select("node", (F.col("on") & (F.col("node") % 2 == 0)).alias("reachable"))
    return capacity.quorum(nodes)


# files

AUDIT_SQL = f"SELECT v.volume_id, system, count(*) FILTER (copies < min_copies) AS below_min, count(*) FILTER (copies = 0) AS lost FROM v_volumes v LEFT JOIN (SELECT c.chunk_id, c.volume_id, count(drive_id) AS copies FROM v_chunks c LEFT JOIN (SELECT * FROM v_locations WHERE drive_id <> {DRIVE}) USING (chunk_id) WHERE committed GROUP BY ALL) p ON p.volume_id = v.volume_id GROUP BY ALL"


@query(f"SELECT volume_id, below_min, lost FROM ({AUDIT_SQL})")
def replica_what_if(v: Views) -> DataFrame:
    return files.what_if(v.volumes, v.chunks, v.locations, DRIVE)


@query(f"SELECT count(*) FILTER (below_min > 0 OR lost > 0) AS at_risk, CASE WHEN bool_or(system AND lost > 0) THEN 'refuse' WHEN count(*) FILTER (below_min > 0 OR lost > 0) = 0 THEN 'ok' ELSE 'forced' END AS decision FROM ({AUDIT_SQL})")
def removal_guard(v: Views) -> DataFrame:
    return capacity.removal_guard(files.what_if(v.volumes, v.chunks, v.locations, DRIVE), v.volumes, force=True)


@query(f"""SELECT count(*) FILTER (now < need) AS lost, count(*) FILTER (now >= need AND later < need) AS at_risk FROM (SELECT stripe_id, least(4, count(*)) AS need, count(*) FILTER (n > 0) AS now, count(*) FILTER (m > 0) AS later
    FROM v_shards LEFT JOIN (SELECT chunk_id, count(*) AS n, count(*) FILTER (drive_id <> {DRIVE}) AS m FROM v_locations GROUP BY 1) USING (chunk_id) GROUP BY 1)""")
def stripe_risk(v: Views) -> DataFrame:
    return files.stripe_risk(v.shards, v.locations, DRIVE)


@query("SELECT of_volume, count(*) AS chunks, sum(stored_size)::BIGINT AS bytes FROM (SELECT DISTINCT volume_id AS of_volume, chunk_id FROM v_file_chunks JOIN v_files USING (file_id)) JOIN (SELECT chunk_id, stored_size FROM v_chunks) USING (chunk_id) GROUP BY 1")
def referenced_chunks(v: Views) -> DataFrame:
    return files.chunks_of_files(v.files, v.file_chunks, v.chunks).groupBy("of_volume").agg(F.count("*").alias("chunks"), F.sum("stored_size").alias("bytes"))


@query(f"SELECT chunk_id, hash, volume_id FROM v_chunks WHERE chunk_id IN (SELECT chunk_id FROM v_locations JOIN v_drives USING (drive_id) WHERE node = {NODE} AND tier = 'hot')")
def chunks_on_node(v: Views) -> DataFrame:
    return files.chunks_at(v.chunks, v.locations, v.drives, NODE, tier="hot").select("chunk_id", "hash", "volume_id")


@query("SELECT chunk_id, volume_id, stored_size FROM v_chunks WHERE NOT committed")
def uncommitted_chunks(v: Views) -> DataFrame:
    return v.chunks.where("not committed").select("chunk_id", "volume_id", "stored_size")


@query("SELECT stripe_id, arg_min(volume_id, idx) AS volume_id, count(*) AS shards FROM v_shards JOIN v_chunks USING (chunk_id) GROUP BY 1")
def volume_stripes(v: Views) -> DataFrame:
    return files.stripes_of(v.shards, v.chunks)


@query("SELECT file_id, path FROM v_files WHERE file_id = 17")
def file_lookup(v: Views) -> DataFrame:
    return files.lookup(v.files, "file_id", 17).select("file_id", "path")


@query("SELECT chunk_id, hash FROM v_chunks WHERE chunk_id BETWEEN 100 AND 228 ORDER BY chunk_id")
def extent_range(v: Views) -> DataFrame:
    return files.key_range(v.chunks, "chunk_id", 100, 228, inclusive=True).select("chunk_id", "hash")


@query("SELECT file_id, path FROM v_files WHERE path >= '/Brand#1' AND path < '/Brand#2' ORDER BY path")
def path_range(v: Views) -> DataFrame:
    return files.key_range(v.files, "path", "/Brand#1", "/Brand#2").select("file_id", "path")


@query("SELECT file_id, path, volume_id FROM v_files WHERE starts_with(path, '/Brand#17/')")
def prefix_scan(v: Views) -> DataFrame:
    return files.with_prefix(v.files, "path", "/Brand#17/").select("file_id", "path", "volume_id")


@query("SELECT volume_id, name FROM v_volumes WHERE NOT system ORDER BY name")
def volume_list(v: Views) -> DataFrame:
    return v.volumes.where("not system").select("volume_id", "name").orderBy("name")


@query("""SELECT substring(path, 2) AS key, '"' || md5(file_id || ':' || coalesce(size, 0)) || '"' AS etag, coalesce(size, 0)::BIGINT AS size, created_at AS last_modified FROM v_files LEFT JOIN (SELECT file_id, sum(stored_size)::BIGINT AS size FROM v_file_chunks JOIN v_chunks USING (chunk_id) GROUP BY 1) USING (file_id)""")
def object_rows(v: Views) -> DataFrame:
    return files.object_row(v.files, sizes(v).groupBy("file_id").agg(F.sum("stored_size").alias("size")))


@query("""SELECT name, is_prefix, n > 20 AS more FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY name) AS k FROM (SELECT DISTINCT CASE WHEN contains(key, '/') THEN split_part(key, '/', 1) || '/' ELSE key END AS name, contains(key, '/') AS is_prefix FROM v_keys) WHERE name > 'm') WHERE k <= 20""")
def listing_page(v: Views) -> DataFrame:
    return files.listing_page(v.keys, "", "/", 20, "m")


@query("SELECT file_id, k AS cookie FROM (SELECT file_id, row_number() OVER (ORDER BY file_id) AS k FROM v_files) WHERE k > 30 AND k <= 46")
def offset_page(v: Views) -> DataFrame:
    return files.offset_page(v.files.select("file_id"), "file_id", 30, 1024)


@query("SELECT path, CASE WHEN k % 7 = 0 THEN 'deleted' WHEN k % 5 = 0 OR k % 3 = 0 THEN 'included' ELSE 'unchanged' END AS fate FROM (SELECT path, file_id AS k FROM v_files) WHERE NOT (k % 7 = 0 AND k % 5 = 0)")
def baseline_diff(v: Views) -> DataFrame:
    named = v.files.select("path", F.col("file_id").alias("k"))
    now = named.where("k % 7 <> 0").select("path", F.when(F.col("k") % 3 == 0, "new").otherwise("old").alias("digest"))
    return files.baseline_diff(now, named.where("k % 5 <> 0").select("path", F.lit("old").alias("digest")))


@query("SELECT path, (k % 4)::INT AS step, 'd' || (k % 4) AS digest FROM (SELECT path, file_id AS k FROM v_files) WHERE k % 4 <> 3")
def restored_chain(v: Views) -> DataFrame:
    k = F.col("file_id")
    chain = v.files.select("path", "file_id", F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("step"))
    return files.restored(chain.select("path", "step", (F.col("step") == 3).alias("deleted"), F.concat(F.lit("d"), F.col("step").cast("string")).alias("digest")))


@query("SELECT DISTINCT chunk_id FROM v_shards WHERE stripe_id IN (SELECT file_id FROM v_files WHERE NOT detached)")
def stripe_marks(v: Views) -> DataFrame:
    return files.stripe_marks(v.files.where("not detached").select(F.col("file_id").alias("stripe_id")), v.shards)


@query("SELECT DISTINCT stripe_id FROM v_shards WHERE stripe_id NOT IN (SELECT file_id FROM v_files WHERE NOT detached)")
def unreferenced_stripes(v: Views) -> DataFrame:
    return files.unreferenced_stripes(v.shards, v.files.where("not detached").select(F.col("file_id").alias("stripe_id")))


@query("SELECT chunk_id, volume_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM v_file_chunks JOIN v_files USING (file_id) WHERE NOT detached) THEN 'kept' WHEN volume_id % 5 = 0 OR NOT committed OR active_writes THEN 'protected' ELSE 'garbage' END AS fate FROM v_chunks")
def guarded_sweep(v: Views) -> DataFrame:
    live = v.file_chunks.join(v.files.where("not detached").select("file_id"), "file_id", "left_semi")
    return files.guarded_sweep(v.chunks, live, v.volumes.where("volume_id % 5 = 0"))


@query(f"SELECT chunk_id, chunk_id % 9 <> 0 AS tracked FROM v_locations WHERE drive_id = {DRIVE}")
def tracked_blobs(v: Views) -> DataFrame:
    blobs = v.locations.where(F.col("drive_id") == DRIVE).select("chunk_id")
    return files.tracked(blobs, v.chunks.where("chunk_id % 9 <> 0"))


@query("SELECT chunk_id, arg_max(volume_id, (created_at, file_id)) AS volume_id FROM v_file_chunks JOIN v_files USING (file_id) WHERE chunk_id % 2 = 0 GROUP BY 1")
def encrypted_chunk_volumes(v: Views) -> DataFrame:
    return files.volume_of_chunk(v.file_chunks, v.files, F.col("chunk_id") % 2 == 0)


@query("SELECT file_id, count(*) FILTER (stop <= 5000) AS prefix, count(*) FILTER (start < 20000 AND stop > 5000) AS affected, count(*) FILTER (start >= 20000) AS suffix, coalesce(sum(stop - start) FILTER (start < 20000 AND stop > 5000), 0)::BIGINT AS covered FROM v_offsets GROUP BY 1")
def write_regions(v: Views) -> DataFrame:
    return files.write_regions(ordered.chunk_offsets(v.file_chunks, v.chunks), 5_000, 20_000)


STRIPES = "SELECT file_id, stripe, (stop - bytes + 100)::BIGINT AS start, (stop + 100)::BIGINT AS stop FROM (SELECT file_id, (pos - 1) // 4 AS stripe, sum(stop - start) AS bytes, max(stop) AS stop FROM v_offsets GROUP BY ALL)"


@query(f'SELECT file_id, stripe, start, stop AS "end" FROM ({STRIPES})')
def stripe_offsets(v: Views) -> DataFrame:
    sized = ordered.chunk_offsets(v.file_chunks, v.chunks).select("file_id", "pos", (F.col("end") - F.col("start")).alias("stored_size"))
    return files.stripe_offsets(sized, 4, 100)


@query(f"SELECT file_id, stripe, greatest(1000, start) - start AS skip, least(30000, stop) - greatest(1000, start) AS take FROM ({STRIPES}) WHERE start < 30000 AND stop > 1000")
def stripe_reads(v: Views) -> DataFrame:
    sized = ordered.chunk_offsets(v.file_chunks, v.chunks).select("file_id", "pos", (F.col("end") - F.col("start")).alias("stored_size"))
    return files.stripe_reads(files.stripe_offsets(sized, 4, 100), 1_000, 30_000)


@query("SELECT file_id, least(60000, size) AS read_end, CASE WHEN file_id % 3 <> 0 THEN greatest(0, least(60000, size) - greatest(10000, covered)) ELSE 0 END::BIGINT AS zeros FROM (SELECT file_id, sum(stored_size)::BIGINT AS covered, sum(stored_size)::BIGINT + 5000 AS size FROM v_file_chunks JOIN v_chunks USING (chunk_id) GROUP BY 1)")
def sparse_tails(v: Views) -> DataFrame:
    known = sizes(v).groupBy("file_id").agg(F.sum("stored_size").alias("covered")).select("file_id", "covered", (F.col("covered") + 5_000).alias("size"), (F.col("file_id") % 3 != 0).alias("complete"))
    return files.sparse_tail(known, 10_000, 50_000)


@query("SELECT upload_id, number, chunks, row_number() OVER w AS place, (sum(chunks) OVER w - chunks)::BIGINT AS before FROM (SELECT l_orderkey AS upload_id, l_linenumber::BIGINT AS number, count(*) AS chunks FROM lineitem GROUP BY ALL) WINDOW w AS (PARTITION BY upload_id ORDER BY number ROWS UNBOUNDED PRECEDING)")
def upload_parts(v: Views) -> DataFrame:
    parts = v.table("lineitem").groupBy(F.col("l_orderkey").alias("upload_id"), F.col("l_linenumber").cast("long").alias("number")).agg(F.count("*").alias("chunks"))
    return files.upload_parts(parts)


@query("SELECT chunk_id, array_to_string(list(DISTINCT drive_id ORDER BY drive_id), ',') AS drives, sum(size)::BIGINT AS size FROM (SELECT l_orderkey AS chunk_id, l_suppkey AS drive_id, l_quantity::BIGINT AS size FROM lineitem) GROUP BY 1")
def commit_options(v: Views) -> DataFrame:
    refs = v.table("lineitem").select(F.col("l_orderkey").alias("chunk_id"), F.col("l_suppkey").alias("drive_id"), F.col("l_quantity").cast("long").alias("size"))
    return files.commit_options(refs).withColumn("drives", F.array_join(F.transform("drives", lambda d: d.cast("string")), ","))


@query("""SELECT chunk_id, coalesce(array_to_string(list_sort(list(DISTINCT drive_id) FILTER (drive_id IS NOT NULL)), ','), '') AS drives, chunk_id % 4 <> 0 AS known FROM (SELECT chunk_id FROM v_chunks) LEFT JOIN (SELECT * FROM v_locations WHERE drive_id % 2 = 0 OR chunk_id % 4 <> 0) USING (chunk_id) GROUP BY 1""")
def reconciled_chunks(v: Views) -> DataFrame:
    drives = lambda cond: v.locations.where(cond).groupBy("chunk_id").agg(F.collect_list("drive_id").alias("drives"))
    old = v.chunks.where("chunk_id % 4 <> 0").select("chunk_id").join(drives("chunk_id % 4 <> 0"), "chunk_id", "left").withColumn("drives", F.coalesce("drives", F.array().cast("array<bigint>")))
    return files.reconciled(v.dealt(v.chunks.select("chunk_id"), "chunk_id"), drives("drive_id % 2 = 0"), old).withColumn("drives", F.array_join(F.transform("drives", lambda d: d.cast("string")), ","))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new:1' ELSE 'kept:' || c_nationkey || CASE WHEN c_custkey % 3 = 1 THEN ',set:' || c_custkey ELSE '' END END AS labels FROM customer")
def label_updates(v: Views) -> DataFrame:
    key = F.col("c_custkey")
    attributes = F.create_map(F.lit("label.kept"), F.col("c_nationkey").cast("string"), F.lit("label.set"), F.lit("old"), F.lit("other"), F.lit("x"))
    asked = F.when(key % 3 == 0, F.create_map(F.lit("new"), F.lit("1"))).when(key % 3 == 1, F.create_map(F.lit("set"), key.cast("string"))).otherwise(F.create_map(F.lit("set"), F.lit("")))
    mask = F.when(key % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("set")))
    done = files.masked_labels(files.labels_of(attributes, "label."), asked, mask)
    shown = F.array_join(F.transform(F.sort_array(F.map_entries(done)), lambda e: F.concat_ws(":", e["key"], e["value"])), ",")
    return v.table("customer").select(key.alias("id"), shown.alias("labels"))


@query("SELECT o_custkey AS file_id, o_orderkey AS version, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS previous FROM orders")
def version_chain(v: Views) -> DataFrame:
    return files.version_chain(v.table("orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("version")))


@query("SELECT true AS covered")
def snapshot_coverage(v: Views) -> DataFrame:
    roots = v.volumes.select(F.explode(F.sequence(F.lit(1), F.lit(3))).alias("snapshot_id"), F.col("volume_id").alias("shard"), F.col("name"))
    roots = roots.select("snapshot_id", "shard", F.md5(F.concat_ws(":", "name", F.when(F.col("snapshot_id") == 2, "old").otherwise("now")).cast("binary")).alias("root"))
    return files.covered_by_other(roots, roots.where("snapshot_id = 3").select("shard", "root"), 3)


@query("SELECT o_orderkey AS id, lpad(lower(hex(o_orderkey)), 16, '0') AS key, o_orderkey AS back, o_orderkey // 64 AS grp, (('0x' || substring(sha256(o_orderkey::VARCHAR), 1, 8))::BIGINT % 64) AS shard, o_orderkey % 3 <> 0 AS is_hash FROM orders")
def extent_keys(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.when(key % 3 == 0, "zz").otherwise(F.sha2(key.cast("string"), 256))
    coded = keys.extent_key(key)
    return v.table("orders").select(key.alias("id"), coded.alias("key"), keys.extent_index(coded).alias("back"), keys.extent_group(key).alias("grp"), keys.shard_of(key.cast("string"), 64).alias("shard"), keys.hash_of(text).isNotNull().alias("is_hash"))


@query("SELECT file_id, octet_length(encode(text))::BIGINT AS bytes, CASE WHEN octet_length(encode(text)) = 0 THEN 'none' WHEN octet_length(encode(text)) < 65536 THEN 'single' WHEN octet_length(encode(text)) < 1048576 THEN 'fixed' ELSE 'content-defined' END AS strategy, CASE WHEN octet_length(encode(text)) < 65536 THEN (octet_length(encode(text)) > 0)::BIGINT WHEN octet_length(encode(text)) < 1048576 THEN ceil(octet_length(encode(text)) / 262144)::BIGINT END AS chunks FROM v_content")
def chunk_strategies(v: Views) -> DataFrame:
    return content.chunking(v.content)


@query(f"""SELECT file_id, count(*) FILTER (known OR k > 1) AS shared, count(*) FILTER (NOT known AND k = 1) AS stored, coalesce(sum(length) FILTER (NOT known AND k = 1), 0)::BIGINT AS stored_bytes FROM (SELECT *, hash IN (SELECT hash FROM pieces WHERE file_id % 10 = 0) AS known, row_number() OVER (PARTITION BY hash ORDER BY file_id, pos) AS k
    FROM (SELECT * FROM pieces WHERE file_id % 10 <> 0)) GROUP BY 1""".replace("SELECT file_id", f"WITH pieces AS MATERIALIZED (SELECT file_id, pos, sha256(encode(text)[pos * {CHUNK} + 1 : pos * {CHUNK} + {CHUNK}]) AS hash, octet_length(encode(text)[pos * {CHUNK} + 1 : pos * {CHUNK} + {CHUNK}]) AS length FROM (SELECT doc_id AS file_id, coalesce(text, '') AS text FROM documents), unnest(range(0, (octet_length(encode(text)) + {CHUNK - 1}) // {CHUNK})) AS u(pos)) SELECT file_id", 1))
def write_plans(v: Views) -> DataFrame:
    pieces = content.fixed_chunks(v.content, CHUNK)
    return content.write_plan(pieces.where("file_id % 10 <> 0"), pieces.where("file_id % 10 = 0"))


@query("SELECT hash, CASE WHEN file_id % 7 = 0 THEN 'key_unavailable' WHEN file_id % 5 = 0 THEN 'corrupt' ELSE 'ok' END AS state FROM (SELECT doc_id AS file_id, sha256(encode(coalesce(text, ''))) AS hash FROM documents)")
def scrub_states(v: Views) -> DataFrame:
    body = F.col("text").cast("binary")
    data = F.when(F.col("file_id") % 5 == 0, F.concat(body, F.lit("!").cast("binary"))).otherwise(body)
    return content.scrubbed(v.content.select(F.sha2(body, 256).alias("hash"), data.alias("data"), (F.col("file_id") % 7 != 0).alias("key_known")))


# statistics


@query("SELECT event_type AS metric, count(*) AS events, round(sum(value), 2) AS total, arg_max(value, (ts, event_id)) AS last, count(*) FILTER (value <= 10) AS le_10, count(*) FILTER (value <= 100) AS le_100 FROM events GROUP BY 1")
def event_metrics(v: Views) -> DataFrame:
    return stats.metrics(v.table("events"), "event_type", "value", ["ts", "event_id"], [10, 100])


@query("SELECT event_type, " + ", ".join(f"list(value ORDER BY value)[greatest(1, round({p} / 100 * count(*)))::INT] AS p{p}" for p in (50, 95, 99)) + ", max(value) AS max FROM events GROUP BY 1")
def latency_percentiles(v: Views) -> DataFrame:
    return stats.nearest_rank(v.table("events").select("event_type", "value"), "event_type", "value")


@query("SELECT user_id, (max(total) - least(0, min(run)))::BIGINT AS total FROM (SELECT user_id, sum(delta) OVER w AS run, sum(delta) OVER (PARTITION BY user_id) AS total FROM (SELECT user_id, ts, event_id, (floor(value)::BIGINT % 100) * CASE WHEN event_type IN ('error', 'view') THEN -1 ELSE 1 END AS delta FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) GROUP BY 1")
def clamped_counters(v: Views) -> DataFrame:
    delta = F.floor("value") % 100 * F.when(F.col("event_type").isin("error", "view"), -1).otherwise(1)
    return stats.clamped_totals(v.table("events").select("user_id", "ts", "event_id", delta.alias("delta")), "user_id", ["ts", "event_id"], "delta")


@query("SELECT grp, top.wall AS wall, top.counter AS counter, top.node AS node FROM (SELECT event_id % 11 AS grp, max({'wall': floor(epoch_ms(ts) / 60000)::BIGINT, 'counter': event_id % 4, 'node': user_id}) AS top FROM events GROUP BY 1)")
def newest_by_clock(v: Views) -> DataFrame:
    wall = F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 60000)
    rows = v.table("events").select((F.col("event_id") % 11).alias("grp"), wall.alias("wall"), (F.col("event_id") % 4).alias("counter"), F.col("user_id").alias("node"))
    return stats.newest_by_clock(rows, "grp", "wall", "counter", "node")


@query("SELECT event_id, round(row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) / (1 + user_id % 25 % 3), 6) AS finish FROM events")
def fair_order(v: Views) -> DataFrame:
    queue = v.table("events").select("event_id", "ts", (F.col("user_id") % 25).alias("volume_id")).withColumn("weight", 1 + F.col("volume_id") % 3)
    return stats.fair_order(queue, "volume_id", "weight", ["ts", "event_id"]).select("event_id", F.round("finish", 6).alias("finish"))


@query("SELECT state, count(*) AS stripes FROM (SELECT CASE WHEN available = shards THEN 'healthy' WHEN available >= 4 THEN 'degraded' ELSE 'critical' END AS state FROM (SELECT stripe_id, count(*) AS shards, count(l.chunk_id) AS available FROM v_shards LEFT JOIN (SELECT DISTINCT chunk_id FROM v_locations JOIN v_drives USING (drive_id) WHERE state = 'active' AND drive_id % 3 = 0) l USING (chunk_id) GROUP BY 1)) GROUP BY 1")
def stripe_totals(v: Views) -> DataFrame:
    good = v.locations.join(v.drives.where("state = 'active' and drive_id % 3 = 0").select("drive_id"), "drive_id", "left_semi")
    return catalog.stripe_states(v.shards, good).groupBy("state").agg(F.count("*").alias("stripes"))
