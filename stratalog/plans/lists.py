"""Queries of lists, reports and joins of the catalog, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.operators import capacity, catalog, content, files, logs, ordered, placement

from .more import DRIVE, KIND, NODE
from .registry import NOW, NOW_ORDERS, query, usage
from .views import Views


@query("SELECT volume_id, name, 'replicate:' || factor || '/' || min_copies AS durability, system FROM v_volumes")
def volume_rows(v: Views) -> DataFrame:
    return v.volumes.select("volume_id", "name", F.concat(F.lit("replicate:"), F.col("factor").cast("string"), F.lit("/"), F.col("min_copies").cast("string")).alias("durability"), "system")


RISK = "SELECT v.volume_id, v.name, count(*) FILTER (copies < min_copies) AS below_min, count(*) FILTER (copies = 0) AS lost FROM v_volumes v JOIN (SELECT c.chunk_id, c.volume_id, count(drive_id) AS copies FROM v_chunks c LEFT JOIN v_locations USING (chunk_id) WHERE committed GROUP BY ALL) p ON p.volume_id = v.volume_id GROUP BY ALL"


@query(f"SELECT volume_id, below_min, lost FROM ({RISK}) WHERE below_min > 0 OR lost > 0")
def at_risk_volumes(v: Views) -> DataFrame:
    return catalog.replica_audit(v.volumes, v.chunks, v.locations).where("below_min > 0 or lost > 0").select("volume_id", "below_min", "lost")


@query(f"SELECT 'volume' AS kind, volume_id AS id, below_min AS n FROM ({RISK}) WHERE below_min > 0 UNION ALL SELECT 'lost', volume_id, lost FROM ({RISK}) WHERE lost > 0 UNION ALL SELECT 'sole_copies', drive_id, count(*) FROM (SELECT min(drive_id) AS drive_id FROM v_locations GROUP BY chunk_id HAVING count(*) = 1) GROUP BY ALL")
def audit_report(v: Views) -> DataFrame:
    audit = catalog.replica_audit(v.volumes, v.chunks, v.locations)
    row = lambda kind, n: audit.where(F.col(n) > 0).select(F.lit(kind).alias("kind"), F.col("volume_id").alias("id"), F.col(n).alias("n"))
    sole = catalog.sole_copy_drives(v.locations).select(F.lit("sole_copies").alias("kind"), F.col("drive_id").alias("id"), F.col("sole_copies").alias("n"))
    return row("volume", "below_min").union(row("lost", "lost")).union(sole)


def claims(v: Views) -> DataFrame:
    kinds = F.array(*map(F.lit, ("path", "create", "pinned", "subtree", "byte_range")))
    return v.locks.select(F.col("lock_id").alias("claim_id"), "path", F.element_at(kinds, (F.col("lock_id") % 5 + 1).cast("int")).alias("kind"), "holder")


@query("SELECT lock_id AS claim_id, path FROM v_locks WHERE starts_with(path, '/src3/')")
def claims_under(v: Views) -> DataFrame:
    return logs.claims(claims(v), "/src3/").select("claim_id", "path")


@query(f"SELECT lock_id AS claim_id, holder FROM v_locks WHERE path = '/src8/d1' AND {KIND} = 'subtree'")
def claims_at(v: Views) -> DataFrame:
    return logs.claims(claims(v), path="/src8/d1", kind="subtree").select("claim_id", "holder")


@query("SELECT lock_id AS claim_id, path FROM v_locks WHERE holder = 5")
def claims_of_holder(v: Views) -> DataFrame:
    return logs.claims(claims(v), holder=5).select("claim_id", "path")


@query(f"SELECT lock_id, path FROM v_locks WHERE expires_at > TIMESTAMP '{NOW}' AND regexp_matches(path, '^/src7/[^/]+$')")
def lock_children(v: Views) -> DataFrame:
    found = logs.active_locks(v.locks, NOW).where(F.col("path").startswith("/src7/") & ~F.expr("substring(path, 7)").contains("/"))
    return found.select("lock_id", "path")


@query("SELECT o_orderkey AS chunk_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS verified_at FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 17 <> 0 AND (o_orderkey % 4 = 0 OR o_orderdate < TIMESTAMP '1999-01-01')")
def scrub_candidates(v: Views) -> DataFrame:
    verified = v.table("orders").select(F.col("o_orderkey").alias("chunk_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderdate")).alias("verified_at"))
    skipped = v.chunks.where("chunk_id % 17 = 0").select("chunk_id")
    open_ = v.chunks.where("committed").select("chunk_id").join(verified, "chunk_id").where(F.col("verified_at").isNull() | (F.col("verified_at") < logs.moment("1999-01-01 00:00:00")))
    return open_.join(skipped, "chunk_id", "left_anti")


@query(f"SELECT chunk_id FROM v_chunks WHERE chunk_id % 2 = 0 AND chunk_id % 3 = 1 AND chunk_id IN (SELECT chunk_id FROM v_locations JOIN v_drives USING (drive_id) WHERE node = {NODE})")
def rotation_candidates(v: Views) -> DataFrame:
    old = v.chunks.where("chunk_id % 2 = 0 and chunk_id % 3 = 1")  # encrypted, under the old key
    return files.chunks_at(old, v.locations, v.drives, NODE).select("chunk_id")


@query(f"SELECT chunk_id, volume_id FROM v_chunks WHERE chunk_id IN (SELECT chunk_id FROM v_locations WHERE drive_id = {DRIVE} AND drive_id IN (SELECT drive_id FROM v_drives WHERE node = (SELECT node FROM v_drives WHERE drive_id = {DRIVE})))")
def chunks_on_drive(v: Views) -> DataFrame:
    node = v.drives.where(F.col("drive_id") == DRIVE).first()["node"]
    return files.chunks_at(v.chunks, v.locations, v.drives, node, DRIVE).select("chunk_id", "volume_id")


@query("SELECT chunk_id, stored_size FROM v_chunks WHERE volume_id = 4")
def volume_chunks(v: Views) -> DataFrame:
    return files.of_volume(v.chunks, 4).select("chunk_id", "stored_size")


@query("SELECT file_id, path FROM v_files WHERE volume_id = 4")
def volume_files(v: Views) -> DataFrame:
    return files.of_volume(v.files, 4).select("file_id", "path")


@query("SELECT node, CASE WHEN bool_or(state = 'draining') THEN 'draining' WHEN bool_or(state = 'standby') THEN 'maintenance' END AS state FROM v_drives GROUP BY 1 HAVING bool_or(state IN ('draining', 'standby'))")
def off_duty_nodes(v: Views) -> DataFrame:
    state = F.when(F.bool_or(F.col("state") == "draining"), "draining").when(F.bool_or(F.col("state") == "standby"), "maintenance").otherwise("active")
    return capacity.off_duty(v.drives.groupBy("node").agg(state.alias("state")))


@query(f"SELECT job_id AS upload_id, created_at FROM v_jobs WHERE status = 'P' AND created_at < TIMESTAMP '{NOW_ORDERS}' - INTERVAL 7 DAYS")
def abandoned_uploads(v: Views) -> DataFrame:
    return logs.orphans(v.jobs.where("status = 'P'"), NOW_ORDERS, 7 * 86_400).select(F.col("job_id").alias("upload_id"), "created_at")


@query(f"SELECT n_nationkey::BIGINT AS volume_id, last_run FROM nation LEFT JOIN (SELECT o_orderkey % 25 AS k, max(o_orderdate) - INTERVAL 1 DAY * (o_orderkey % 25 * 3) AS last_run FROM orders GROUP BY k) ON k = n_nationkey WHERE last_run IS NULL OR epoch(TIMESTAMP '{NOW_ORDERS}') - epoch(last_run) >= 2592000".replace("(o_orderkey % 25 * 3)", "(k * 3)"))
def scrub_due(v: Views) -> DataFrame:
    last = v.jobs.groupBy((F.col("job_id") % 25).alias("volume_id")).agg(F.max("created_at").alias("last")).withColumn("last_run", F.expr("last - make_dt_interval(cast(volume_id * 3 as int))"))
    rows = v.volumes.select(F.col("volume_id").alias("id")).join(last.select(F.col("volume_id").alias("id"), "last_run"), "id", "left").withColumn("interval_s", F.lit(2_592_000))
    return logs.due(rows, NOW_ORDERS).select(F.col("id").alias("volume_id"), "last_run")


@query("SELECT p.volume_id, p.chunk_id AS page, d.drive_id FROM v_chunks p JOIN (SELECT volume_id, drive_id FROM v_volumes JOIN v_drives ON drive_id % 5 = volume_id % 5 AND drive_id < 10) d ON d.volume_id = p.volume_id WHERE (p.chunk_id + d.drive_id) % 9 = 0")
def page_divergence(v: Views) -> DataFrame:
    some = v.drives.where("drive_id < 10").select("drive_id", (F.col("drive_id") % 5).alias("k"))
    declared = v.volumes.select("volume_id", (F.col("volume_id") % 5).alias("k")).join(some, "k").select("volume_id", "drive_id")
    pages = v.chunks.select("volume_id", F.col("chunk_id").alias("page"))
    held = pages.join(declared, "volume_id").where("(page + drive_id) % 9 <> 0").select("page", "drive_id")
    return files.page_divergence(pages, declared, held)


@query("SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY chunk_id) AS pos, chunk_id, CASE WHEN chunk_id % 8 <> 0 THEN hash END AS hash, CASE WHEN chunk_id % 8 <> 0 THEN stored_size END AS stored_size FROM v_file_chunks JOIN v_chunks USING (chunk_id)")
def chunk_infos(v: Views) -> DataFrame:
    listed = ordered.chunk_offsets(v.file_chunks, v.chunks).select("file_id", "pos", "chunk_id")
    return files.chunk_infos(listed, v.chunks.where("chunk_id % 8 <> 0"))


@query(f"SELECT chunk_id, drive_id, tier, state, CASE WHEN tier IS NULL THEN 100 WHEN tier = 'hot' THEN CASE WHEN node = {NODE} THEN 0 ELSE 10 END WHEN state = 'standby' THEN 50 WHEN node = {NODE} THEN 20 ELSE 30 END AS score FROM v_locations LEFT JOIN (SELECT * FROM v_drives WHERE drive_id % 9 <> 0) USING (drive_id)")
def enriched_locations(v: Views) -> DataFrame:
    known = v.drives.where("drive_id % 9 <> 0").select("drive_id", "node", "tier", "state")
    joined = v.locations.join(F.broadcast(known), "drive_id", "left")
    return joined.select("chunk_id", "drive_id", "tier", "state", placement.location_score(F.col("tier"), F.col("state"), F.coalesce(F.col("node") == NODE, F.lit(False))).alias("score"))


@query("SELECT chunk_id, daily, CASE WHEN chunk_id % 25 < 10 THEN (chunk_id % 25)::INT ELSE 10 END AS promote_at FROM v_stats")
def tiering_configs(v: Views) -> DataFrame:
    configs = v.volumes.where("volume_id < 10").select("volume_id", F.col("volume_id").cast("int").alias("promote_at"))
    own = v.stats.select("chunk_id", "daily", (F.col("chunk_id") % 25).alias("volume_id"))
    return capacity.with_defaults(own, configs, "volume_id", {"promote_at": 10}).select("chunk_id", "daily", "promote_at")


@query("SELECT file_id, count(*) AS pins FROM v_files JOIN (SELECT event_id % 500 AS file_id FROM events UNION ALL SELECT user_id FROM events) USING (file_id) WHERE detached GROUP BY 1")
def pinned_files(v: Views) -> DataFrame:
    pins = v.table("events").select(F.col("event_id").alias("claim_id"), F.array(F.col("event_id") % 500, "user_id").alias("file_ids"))
    return files.pinned_files(v.files, pins)


@query(f"SELECT count(DISTINCT volume_id) AS volumes, count(DISTINCT volume_id) = 0 AS clear FROM v_chunks JOIN v_locations USING (chunk_id) WHERE drive_id = {DRIVE}")
def drive_references(v: Views) -> DataFrame:
    return files.naming(v.locations.join(v.chunks.select("chunk_id", "volume_id"), "chunk_id"), DRIVE)


@query("SELECT volume_id, factor > (SELECT count(DISTINCT node) FROM v_drives WHERE drive_id < 2) AS degraded FROM v_volumes")
def overasked_volumes(v: Views) -> DataFrame:
    return capacity.over_replicated_asks(v.volumes, v.drives.where("drive_id < 2"))


@query("SELECT chunk_id, max(coalesce(min_copies, 1)) AS need FROM (SELECT chunk_id, volume_id FROM v_chunks UNION ALL SELECT chunk_id, (chunk_id + 7) % 30 FROM v_chunks) c LEFT JOIN (SELECT volume_id, min_copies FROM v_volumes) USING (volume_id) GROUP BY 1")
def owner_minimum(v: Views) -> DataFrame:
    owners = v.chunks.select("chunk_id", F.array("volume_id", (F.col("chunk_id") + 7) % 30).alias("volume_ids"))
    return files.owner_minimum(owners, v.volumes)


@query("SELECT node, count(*) AS rows, array_to_string(list(chunk_id ORDER BY chunk_id)[1:5], ',') AS sample FROM (SELECT node, chunk_id FROM (SELECT DISTINCT node, chunk_id FROM v_locations JOIN v_drives USING (drive_id)) GROUP BY ALL) WHERE chunk_id IN (SELECT chunk_id FROM v_locations JOIN v_drives USING (drive_id) GROUP BY 1 HAVING count(DISTINCT node) = 1) GROUP BY 1")
def stranded_samples(v: Views) -> DataFrame:
    held = v.locations.join(F.broadcast(v.drives.select("drive_id", "node")), "drive_id").groupBy("chunk_id").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other").select("node", "chunk_id")
    return files.samples(held, "node", "chunk_id", 5).select("node", "rows", F.array_join(F.transform("sample", lambda c: c.cast("string")), ",").alias("sample"))


@query("SELECT CASE WHEN bool_and(capacity_bytes > 0) THEN sum(greatest(0, capacity_bytes - used))::BIGINT END AS available FROM v_usage WHERE state <> 'draining' AND drive_id NOT IN (1, 2, 3)")
def any_tier_capacity(v: Views) -> DataFrame:
    return capacity.available(usage(v), exclude=(1, 2, 3))


@query("SELECT node, count(*) AS copies FROM v_locations JOIN v_drives USING (drive_id) GROUP BY 1")
def copies_per_node(v: Views) -> DataFrame:
    return v.locations.join(F.broadcast(v.drives.select("drive_id", "node")), "drive_id").groupBy("node").agg(F.count("*").alias("copies"))


@query("SELECT node, array_to_string(list(drive_id ORDER BY drive_id), ',') AS drives FROM v_drives GROUP BY 1")
def drives_by_node(v: Views) -> DataFrame:
    return v.drives.groupBy("node").agg(F.array_join(F.transform(F.sort_array(F.collect_list("drive_id")), lambda d: d.cast("string")), ",").alias("drives"))


@query("SELECT file_id, sum(stop - start)::BIGINT AS covered, round(sum(stop - start) / sum(least(6000, stop) - greatest(1000, start)), 6) AS amplification FROM v_offsets WHERE start < 6000 AND stop > 1000 GROUP BY 1")
def read_amplification(v: Views) -> DataFrame:
    offsets = ordered.chunk_offsets(v.file_chunks, v.chunks)
    read = ordered.range_read(offsets, 1_000, 6_000).join(offsets.select("file_id", "pos", "chunk_id", (F.col("end") - F.col("start")).alias("bytes")), ["file_id", "chunk_id"])
    return read.groupBy("file_id").agg(F.sum("bytes").alias("covered"), F.round(F.sum("bytes") / F.sum("take"), 6).alias("amplification"))


@query("SELECT user_id AS node, event_type AS service, count(*) AS seen FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def services_by_type(v: Views) -> DataFrame:
    return v.table("events").where(logs.one_of("event_type", ["view", "click"])).groupBy(F.col("user_id").alias("node"), F.col("event_type").alias("service")).agg(F.count("*").alias("seen"))


@query("SELECT job_id, status, created_at FROM v_jobs WHERE status IN ('O', 'P') AND priority = (SELECT min(priority) FROM v_jobs) ORDER BY created_at DESC, job_id")
def job_list(v: Views) -> DataFrame:
    first = v.jobs.agg(F.min("priority")).first()[0]
    return logs.jobs(v.jobs.withColumnRenamed("priority", "type"), ["O", "P"], first).select("job_id", "status", "created_at")


@query("SELECT file_id AS snapshot_id, created_at FROM v_backups WHERE volume_id = 3 ORDER BY created_at DESC, file_id")
def snapshot_list(v: Views) -> DataFrame:
    return files.of_volume(v.backups, 3).select(F.col("file_id").alias("snapshot_id"), "created_at").orderBy(F.desc("created_at"), "snapshot_id")


@query("SELECT snapshot_id, n > 25 AS more FROM (SELECT file_id AS snapshot_id, row_number() OVER (ORDER BY file_id) AS k, count(*) OVER () AS n FROM v_backups WHERE file_id > 1000) WHERE k <= 25")
def snapshot_page(v: Views) -> DataFrame:
    return files.paged(v.backups.where("file_id > 1000").select(F.col("file_id").alias("snapshot_id")), "snapshot_id", 25)


@query("SELECT departed FROM (SELECT DISTINCT node AS departed FROM v_drives) WHERE departed NOT IN (SELECT node FROM v_drives WHERE state = 'active')")
def departed_peers(v: Views) -> DataFrame:
    return v.drives.select(F.col("node").alias("departed")).distinct().join(v.drives.where("state = 'active'").select(F.col("node").alias("departed")), "departed", "left_anti")


@query("SELECT DISTINCT node FROM v_drives WHERE state = 'active' AND node IN (SELECT node FROM v_drives WHERE tier = 'hot')")
def connected_core(v: Views) -> DataFrame:
    return v.drives.where("state = 'active'").select("node").intersect(v.drives.where("tier = 'hot'").select("node"))


@query(f"SELECT id, ts FROM (SELECT event_id AS id, ts FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 10 DAYS ORDER BY ts DESC, event_id DESC LIMIT 200)")
def audit_retention(v: Views) -> DataFrame:
    return logs.kept_events(v.audit, NOW, 10, 200).select("id", "ts")


@query(f"SELECT volume_id, count(*) FILTER (days < 7) AS week, count(*) FILTER (days < 28) AS four_weeks, count(*) FILTER (days < 372) AS year FROM (SELECT volume_id, floor((epoch(TIMESTAMP '{NOW_ORDERS}') - epoch(created_at)) / 86400) AS days FROM v_backups) GROUP BY 1")
def backup_ages(v: Views) -> DataFrame:
    return v.backups.groupBy("volume_id").agg(*(F.count_if(logs.within(F.col("created_at"), NOW_ORDERS, d)).alias(n) for n, d in (("week", 7), ("four_weeks", 28), ("year", 372))))


@query("SELECT file_id, sha256(encode(text)[301:1100] || unhex(repeat('00', (800 - octet_length(encode(text)[301:1100]))::INT))) AS digest FROM v_content WHERE octet_length(encode(text)) > 300")
def byte_ranges(v: Views) -> DataFrame:
    pieces = content.fixed_pieces(v.content, 256)
    return files.assembled(pieces, 300, 1_100).select("file_id", F.sha2("data", 256).alias("digest"))


@query("SELECT split_part(substring(path, 2), '/', 2) AS name, true AS is_dir, count(*) AS files, NULL::BIGINT AS size FROM v_files WHERE starts_with(path, '/Brand#3/') GROUP BY 1 UNION ALL SELECT split_part(path, '/', 4), false, 1, file_id * 10 FROM v_files WHERE starts_with(path, '/Brand#3/SMALL/')")
def directory_entries(v: Views) -> DataFrame:
    from stratalog.operators import paths

    top = paths.listed(v.files, "/Brand#3").select("name", "is_dir", F.col("entries").alias("files"), F.lit(None).cast("long").alias("size"))
    inside = paths.listed(v.files, "/Brand#3/SMALL").withColumn("file_id", F.col("name").cast("long"))
    sizes = v.files.select("file_id", (F.col("file_id") * 10).alias("size"))
    return top.union(inside.join(sizes, "file_id", "left").select("name", "is_dir", F.col("entries").alias("files"), "size"))


@query(f"SELECT chunk_id, volume_id FROM v_chunks WHERE chunk_id IN (SELECT chunk_id FROM v_locations JOIN v_drives USING (drive_id) WHERE node = {NODE})")
def node_chunks(v: Views) -> DataFrame:
    return files.chunks_at(v.chunks, v.locations, v.drives, NODE).select("chunk_id", "volume_id")


@query("SELECT path, file_id * 10 AS size, CASE WHEN file_id % 3 = 0 THEN file_id % 512 END AS mode, CASE WHEN file_id % 4 = 0 THEN 'k=' || file_id END AS attributes FROM v_files")
def manifest_entries(v: Views) -> DataFrame:
    key = F.col("file_id")
    access = v.files.where("file_id % 3 = 0").select("file_id", (key % 512).alias("mode"))
    attributes = v.files.where("file_id % 4 = 0").select("file_id", F.concat(F.lit("k="), key.cast("string")).alias("attributes"))
    return files.manifest_entries(v.files.select("file_id", "path", (key * 10).alias("size")), access, attributes)


@query("SELECT chunk_id, array_to_string(list(drive_id ORDER BY drive_id), ',') AS drives FROM v_locations WHERE (chunk_id + drive_id) % 4 <> 0 GROUP BY 1")
def kept_locations(v: Views) -> DataFrame:
    kept = files.kept_locations(v.locations, v.locations.where("(chunk_id + drive_id) % 4 = 0"))
    return kept.withColumn("drives", F.array_join(F.transform("drives", lambda d: d.cast("string")), ","))


@query("SELECT chunk_id, volume_id, CASE WHEN chunk_id IN (SELECT chunk_id FROM v_chunks WHERE chunk_id % 3 = 0 AND volume_id % 4 <> 1) THEN 'kept' WHEN (volume_id % 4 = 1 AND volume_id IN (SELECT volume_id FROM v_chunks WHERE chunk_id % 3 = 0)) OR NOT committed OR active_writes THEN 'protected' ELSE 'garbage' END AS fate FROM v_chunks")
def extent_sweep(v: Views) -> DataFrame:
    extents = v.chunks.where("chunk_id % 3 = 0").select("volume_id", "chunk_id")
    marks, unread = files.extent_marks(extents, v.volumes.where("volume_id % 4 <> 1"))
    return files.guarded_sweep(v.chunks, marks, unread)


@query("SELECT file_id, count(*) FILTER (stop <= 20000) AS prefix, count(*) FILTER (start < 40000 AND stop > 20000) AS affected, count(*) FILTER (start >= 40000) AS suffix, coalesce(sum(stop - start) FILTER (start < 40000 AND stop > 20000), 0)::BIGINT AS covered FROM (SELECT file_id, (pos - 1) // 4 AS stripe, min(start) AS start, max(stop) AS stop FROM v_offsets GROUP BY ALL) GROUP BY 1")
def stripe_regions(v: Views) -> DataFrame:
    sized = ordered.chunk_offsets(v.file_chunks, v.chunks).select("file_id", "pos", (F.col("end") - F.col("start")).alias("stored_size"))
    return files.write_regions(files.stripe_offsets(sized, 4), 20_000, 40_000)


@query("SELECT o_orderkey AS key, ('0x' || substring(sha256(o_orderkey::VARCHAR), 1, 2))::BIGINT AS segment FROM orders")
def key_segments(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    return v.table("orders").select(key.alias("key"), placement.segment_of(key.cast("string")).alias("segment"))


@query("SELECT l_orderkey % 25 AS volume_id, count(*) AS files, sum(l_quantity::BIGINT)::BIGINT AS bytes FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1")
def reconciled_counters(v: Views) -> DataFrame:
    live = v.table("lineitem").where("l_returnflag <> 'R'")
    return live.groupBy((F.col("l_orderkey") % 25).alias("volume_id")).agg(F.count("*").alias("files"), F.sum(F.col("l_quantity").cast("long")).alias("bytes"))


def content_chunks(spark, sf_dir: str) -> DataFrame:
    """Content-defined chunks of every document; the sizes suit texts of a few kilobytes."""
    return content.defined_chunks(Views(spark, sf_dir).content.select("file_id", F.col("text").cast("binary").alias("body")), 256, 1_024, 4_096)


#: Queries that SQL cannot express; tests hold them against brute force.
BEYOND_SQL = {"content_chunks": content_chunks}
