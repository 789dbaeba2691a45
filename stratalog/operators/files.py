"""Files, chunks, stripes, snapshots and listings: lookups, diffs, reads and write plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """The live row of a unique key, if there is one."""
    return rows.where(F.col(key) == value).limit(1)


def key_range(rows: DataFrame, key: str, start=None, end=None, inclusive: bool = False) -> DataFrame:
    """Rows of [start, end), either side open where null, in order of the key; with `inclusive` the end is part of it."""
    found = rows if start is None else rows.where(F.col(key) >= start)
    if end is not None:
        found = found.where(F.col(key) <= end if inclusive else F.col(key) < end)
    return found.orderBy(key)


def with_prefix(rows: DataFrame, key: str, prefix: str) -> DataFrame:
    return rows.where(F.col(key).startswith(prefix))


def of_volume(rows: DataFrame, volume: int) -> DataFrame:
    return rows.where(F.col("volume_id") == volume)


def chunks_at(chunks: DataFrame, locations: DataFrame, drives: DataFrame, node: int, drive: int | None = None, tier: str | None = None) -> DataFrame:
    """Chunks with a copy on a node, or on one drive of it, or on one in a tier."""
    on = drives.where(F.col("node") == node)
    on = on if drive is None else on.where(F.col("drive_id") == drive)
    on = on if tier is None else on.where(F.col("tier") == tier)
    return chunks.join(locations.join(F.broadcast(on.select("drive_id")), "drive_id", "left_semi").select("chunk_id"), "chunk_id", "left_semi")


def chunks_of_files(files: DataFrame, file_chunks: DataFrame, chunks: DataFrame) -> DataFrame:
    """volume_id and chunk of every chunk that a volume's files name, once; names without a chunk are left out."""
    named = file_chunks.join(files.select("file_id", F.col("volume_id").alias("of_volume")), "file_id").select("of_volume", "chunk_id").distinct()
    return named.join(chunks.select("chunk_id", "stored_size", "committed"), "chunk_id")


def stripes_of(shards: DataFrame, chunks: DataFrame) -> DataFrame:
    """stripe_id, volume_id (of its first shard), shards."""
    return shards.join(chunks.select("chunk_id", "volume_id"), "chunk_id").groupBy("stripe_id").agg(F.min_by("volume_id", "idx").alias("volume_id"), F.count("*").alias("shards"))


def object_row(files: DataFrame, sizes: DataFrame) -> DataFrame:
    """Files as a bucket lists them: key without the leading slash, entity tag, size, time of the last change."""
    tag = F.concat(F.lit('"'), F.md5(F.concat_ws(":", F.col("file_id").cast("string"), F.coalesce("size", F.lit(0)).cast("string")).cast("binary")), F.lit('"'))
    return files.join(sizes, "file_id", "left").select(F.regexp_replace("path", "^/", "").alias("key"), tag.alias("etag"), F.coalesce("size", F.lit(0)).alias("size"), F.col("created_at").alias("last_modified"))


def listing_page(keys: DataFrame, prefix: str, delimiter: str, most: int, after: str | None = None) -> DataFrame:
    """One page of a listing, in order: the first `most` keys and common prefixes after a token, and whether there are more.

    A page needs one entry more than it shows; what follows is never sorted.
    """
    rest = F.expr(f"substring(key, {len(prefix) + 1})")
    rolled = rest.contains(delimiter)
    name = F.when(rolled, F.concat(F.lit(prefix), F.substring_index(rest, delimiter, 1), F.lit(delimiter))).otherwise(F.col("key"))
    found = keys.where(F.col("key").startswith(prefix)).select(name.alias("name"), rolled.alias("is_prefix")).distinct()
    found = found if after is None else found.where(F.col("name") > after)
    return paged(found, "name", most)


def paged(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first `most` rows by a unique key (all if it is 0), each with `more`: whether another follows the page."""
    if not most:
        return rows.orderBy(key).withColumn("more", F.lit(False))
    some = rows.orderBy(key).limit(most + 1)  # at most most + 1 rows from here on
    place = F.row_number().over(Window.orderBy(key))
    some = some.withColumn("n", place).withColumn("more", F.max("n").over(Window.partitionBy()) > most)
    return some.where(F.col("n") <= most).drop("n")


def offset_page(rows: DataFrame, key: str, cookie: int, count: int) -> DataFrame:
    """Rows after a cookie (1 is the first row) by key: max(count div 64, 1) of them, each with its own cookie."""
    size = max(count // 64, 1)
    first = rows.orderBy(key).limit(cookie + size).withColumn("cookie", F.row_number().over(Window.orderBy(key)).cast("long"))
    return first.where(F.col("cookie") > cookie)


def baseline_diff(files: DataFrame, baseline: DataFrame) -> DataFrame:
    """path and fate of each file (path, digest) against a baseline: included (new or changed), unchanged, or deleted."""
    both = files.select("path", "digest").join(baseline.select("path", F.col("digest").alias("before")), "path", "full_outer")
    fate = F.when(F.col("digest").isNull(), "deleted").when(F.col("digest").eqNullSafe(F.col("before")), "unchanged").otherwise("included")
    return both.select("path", fate.alias("fate"))


def restored(chain: DataFrame) -> DataFrame:
    """The newest state of each path over a chain of backups (path, step, deleted, digest), without those whose last entry deletes them."""
    last = chain.groupBy("path").agg(F.max(F.struct("step", "deleted", "digest")).alias("last"))
    return last.where("not last.deleted").select("path", "last.step", "last.digest")


def stripe_marks(file_stripes: DataFrame, shards: DataFrame) -> DataFrame:
    """Chunks that files name through stripes; a stripe that is not there names none."""
    return file_stripes.select("stripe_id").distinct().join(shards.select("stripe_id", "chunk_id"), "stripe_id").select("chunk_id").distinct()


def unreferenced_stripes(shards: DataFrame, file_stripes: DataFrame) -> DataFrame:
    return shards.select("stripe_id").distinct().join(file_stripes.select("stripe_id"), "stripe_id", "left_anti")


def guarded_sweep(chunks: DataFrame, marks: DataFrame, unmarked: DataFrame) -> DataFrame:
    """Chunks with their fate when some volumes could not be read: of those, nothing is garbage."""
    named = marks.select("chunk_id").distinct().withColumn("marked", F.lit(True))
    unread = F.broadcast(unmarked.select("volume_id").distinct().withColumn("unread", F.lit(True)))
    fate = F.when(F.col("marked"), "kept").when(F.col("unread") | ~F.col("committed") | F.col("active_writes"), "protected").otherwise("garbage")
    return chunks.join(named, "chunk_id", "left").join(unread, "volume_id", "left").select("chunk_id", "volume_id", fate.alias("fate"))


def tracked(blobs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Blobs on a drive, those that the catalog knows first."""
    known = blobs.join(chunks.select("chunk_id").withColumn("tracked", F.lit(True)), "chunk_id", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))
    return known.orderBy(F.desc("tracked"), "chunk_id")


def volume_of_chunk(file_chunks: DataFrame, files: DataFrame, wanted: Column) -> DataFrame:
    """Of wanted chunks the volume of the file that was written last."""
    named = file_chunks.where(wanted).join(files.select("file_id", "volume_id", "created_at"), "file_id")
    return named.groupBy("chunk_id").agg(F.max_by("volume_id", F.struct("created_at", "file_id")).alias("volume_id"))


def write_regions(offsets: DataFrame, start: int, end: int) -> DataFrame:
    """Per file: chunks before, inside and after the bytes [start, end) of a write, and the bytes of the touched chunks."""
    touched = (F.col("start") < end) & (F.col("end") > start)
    return offsets.groupBy("file_id").agg(F.count_if(F.col("end") <= start).alias("prefix"), F.count_if(touched).alias("affected"), F.count_if(F.col("start") >= end).alias("suffix"), F.sum(F.when(touched, F.col("end") - F.col("start")).otherwise(0)).alias("covered"))


def stripe_offsets(sized: DataFrame, data: int, base: int = 0) -> DataFrame:
    """file_id, stripe, start, end: byte ranges of stripes of `data` chunks in a row (file_id, pos from 1, stored_size), shifted by `base`."""
    stripes = sized.groupBy("file_id", F.floor((F.col("pos") - 1) / data).cast("long").alias("stripe")).agg(F.sum("stored_size").alias("bytes"))
    end = F.sum("bytes").over(Window.partitionBy("file_id").orderBy("stripe").rowsBetween(Window.unboundedPreceding, 0))
    return stripes.select("file_id", "stripe", (end - F.col("bytes") + base).alias("start"), (end + base).alias("end"))


def stripe_reads(offsets: DataFrame, first: int, last: int) -> DataFrame:
    """Stripes that the bytes [first, last) of each file touch, with the part of each that is read."""
    touched = offsets.where((F.col("start") < last) & (F.col("end") > first))
    return touched.select("file_id", "stripe", (F.greatest(F.lit(first), "start") - F.col("start")).alias("skip"), (F.least(F.lit(last), "end") - F.greatest(F.lit(first), "start")).alias("take"))


def sparse_tail(sizes: DataFrame, offset: int, length: int) -> DataFrame:
    """Per file (file_id, size, covered, complete): bytes of a read beyond the last chunk, which read as zeros; none if a chunk is missing."""
    end = F.least(F.lit(offset + length), "size")
    return sizes.select("file_id", end.alias("read_end"), F.when(F.col("complete"), F.greatest(F.lit(0), end - F.greatest(F.lit(offset), "covered"))).otherwise(0).cast("long").alias("zeros"))


def what_if(volumes: DataFrame, chunks: DataFrame, locations: DataFrame, drive: int) -> DataFrame:
    """Per volume: committed chunks below the least number of copies, and without any, if a drive were gone."""
    left = locations.where(F.col("drive_id") != drive).groupBy("chunk_id").agg(F.count_distinct("drive_id").alias("copies"))
    per = chunks.where("committed").select("chunk_id", "volume_id").join(left, "chunk_id", "left").groupBy("volume_id", F.coalesce("copies", F.lit(0)).alias("copies")).agg(F.count("*").alias("n"))
    joined = volumes.join(per, "volume_id", "left")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return joined.groupBy("volume_id").agg(count(F.col("copies") < F.col("min_copies")).alias("below_min"), count(F.col("copies") == 0).alias("lost"))


def stripe_risk(shards: DataFrame, locations: DataFrame, drive: int, data: int = 4) -> DataFrame:
    """One row: stripes lost already (fewer than `data` shards, or all of a short stripe), and those that a drive's loss would add."""
    n = locations.groupBy("chunk_id").agg(F.count("*").alias("now"), F.count_if(F.col("drive_id") != drive).alias("then"))
    per = shards.join(n, "chunk_id", "left").groupBy("stripe_id").agg(F.count("*").alias("shards"), F.count_if(F.col("now") > 0).alias("now"), F.count_if(F.col("then") > 0).alias("then"))
    need = F.least(F.lit(data), "shards")
    return per.agg(F.count_if(F.col("now") < need).alias("lost"), F.count_if((F.col("now") >= need) & (F.col("then") < need)).alias("at_risk"))


def upload_parts(parts: DataFrame) -> DataFrame:
    """Complete uploads (upload_id, number, chunks): parts in the order of their numbers, with the place of each in the file, and the number of chunks before it."""
    order = Window.partitionBy("upload_id").orderBy("number")
    before = F.coalesce(F.sum("chunks").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("upload_id", "number", "chunks", F.row_number().over(order).cast("long").alias("place"), before.alias("before"))


def commit_options(refs: DataFrame) -> DataFrame:
    """Per hash: its distinct locations in order, and its size summed over the references (hash, drive_id, size)."""
    return refs.groupBy("chunk_id").agg(F.sort_array(F.collect_set("drive_id")).alias("drives"), F.sum("size").alias("size"))


def reconciled(claimed: DataFrame, reported: DataFrame, existing: DataFrame) -> DataFrame:
    """Claimed chunks with the union of reported and existing locations (arrays), and whether the catalog had them."""
    both = claimed.select("chunk_id").distinct().join(reported.select("chunk_id", F.col("drives").alias("new")), "chunk_id", "left").join(existing.select("chunk_id", F.col("drives").alias("old")), "chunk_id", "left")
    none = F.array().cast("array<bigint>")
    return both.select("chunk_id", F.sort_array(F.array_union(F.coalesce("old", none), F.coalesce("new", none))).alias("drives"), F.col("old").isNotNull().alias("known"))


def labels_of(attributes: Column, prefix: str) -> Column:
    """The attributes under a prefix, without it, as a map."""
    return F.transform_keys(F.map_filter(attributes, lambda k, v: k.startswith(prefix)), lambda k, v: F.substring(k, len(prefix) + 1, 1 << 20))


def masked_labels(current: Column, asked: Column, mask: Column) -> Column:
    """Labels after an update: without a mask all are replaced; else each masked key takes the asked value, and goes if that is empty or missing."""
    kept = F.map_filter(current, lambda k, v: ~F.array_contains(mask, k))
    taken = F.map_filter(asked, lambda k, v: F.array_contains(mask, k) & (v != ""))
    return F.when(F.size(mask) == 0, asked).otherwise(F.map_concat(kept, taken))


def version_chain(versions: DataFrame) -> DataFrame:
    """Versions (file_id, version, ...) of a file with the one before each."""
    return versions.withColumn("previous", F.lag("version").over(Window.partitionBy("file_id").orderBy("version")))


def covered_by_other(roots: DataFrame, current: DataFrame, restoring: int) -> DataFrame:
    """One row: whether a snapshot other than the one restored has exactly the current roots (shard, root)."""
    want = current.agg(F.count("*").alias("n")).first()["n"]
    same = roots.where(F.col("snapshot_id") != restoring).join(current.select("shard", F.col("root").alias("now")), "shard", "left")
    full = same.groupBy("snapshot_id").agg(F.count("*").alias("n"), F.count_if(F.col("root") == F.col("now")).alias("equal")).where((F.col("n") == want) & (F.col("equal") == want))
    return full.agg((F.count("*") > 0).alias("covered"))


def chunk_infos(listed: DataFrame, chunks: DataFrame) -> DataFrame:
    """A list of chunks (file_id, pos, chunk_id) with what the catalog knows of each, in the list's order; unknown ones have nulls."""
    return listed.join(chunks.select("chunk_id", "hash", "stored_size"), "chunk_id", "left").select("file_id", "pos", "chunk_id", "hash", "stored_size")


def page_divergence(pages: DataFrame, declared: DataFrame, held: DataFrame) -> DataFrame:
    """Pages (volume_id, page) that a drive declared for their volume (volume_id, drive_id) does not hold."""
    return pages.join(declared, "volume_id").join(held, ["page", "drive_id"], "left_anti").select("volume_id", "page", "drive_id")


def pinned_files(files: DataFrame, pins: DataFrame) -> DataFrame:
    """Detached files that claims (claim_id, file_ids) pin, with the number of pins."""
    each = pins.select("claim_id", F.explode("file_ids").alias("file_id"))
    return files.where("detached").select("file_id").join(each, "file_id").groupBy("file_id").agg(F.count("*").alias("pins"))


def naming(declared: DataFrame, drive: int) -> DataFrame:
    """One row: volumes that still name a drive, and whether there is none."""
    return declared.where(F.col("drive_id") == drive).agg(F.count_distinct("volume_id").alias("volumes")).withColumn("clear", F.col("volumes") == 0)


def owner_minimum(owners: DataFrame, volumes: DataFrame) -> DataFrame:
    """Per chunk (chunk_id, volume_ids) the strictest least number of copies over its owners; an owner that is not there asks for one."""
    each = owners.select("chunk_id", F.explode_outer("volume_ids").alias("volume_id")).join(volumes.select("volume_id", "min_copies"), "volume_id", "left")
    return each.groupBy("chunk_id").agg(F.max(F.coalesce("min_copies", F.lit(1))).alias("need"))


def samples(rows: DataFrame, group: str, key: str, most: int) -> DataFrame:
    """Per group: the number of rows and the `most` least keys, as an array. Each of many deals gives its least keys first."""
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64(key), F.lit(64)))
    place = lambda *by: F.row_number().over(Window.partitionBy(group, *by).orderBy(key))
    some = dealt.withColumn("n", place("deal")).where(F.col("n") <= most).withColumn("n", place()).where(F.col("n") <= most)
    few = some.groupBy(group).agg(F.sort_array(F.collect_list(key)).alias("sample"))  # at most `most` a group
    return rows.groupBy(group).agg(F.count("*").alias("rows")).join(few, group)


def assembled(parts: DataFrame, first: int, last: int) -> DataFrame:
    """file_id, data: bytes [first, last) of each file from its parts (file_id, start, data); what no part covers at the end reads as zeros. A range has to fit a task."""
    end = F.col("start") + F.octet_length("data")
    touched = parts.where((F.col("start") < last) & (end > first))
    skip = F.greatest(F.lit(first) - F.col("start"), F.lit(0)).cast("int")
    piece = F.substring("data", skip + 1, (F.least(F.lit(last), end) - F.greatest(F.lit(first), "start")).cast("int"))
    lists = touched.select("file_id", "start", piece.alias("piece")).groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("start", "piece"))).alias("p"))
    body = F.aggregate("p", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["piece"]))
    zeros = F.unhex(F.repeat(F.lit("00"), (F.lit(last - first) - F.octet_length("body")).cast("int")))
    return lists.select("file_id", body.alias("body")).select("file_id", F.concat("body", zeros).alias("data"))


def manifest_entries(files: DataFrame, access: DataFrame, attributes: DataFrame) -> DataFrame:
    """Files (file_id, path, size) with their access list (file_id, mode) and attributes (file_id, attributes) where they have any."""
    return files.join(access.select("file_id", "mode"), "file_id", "left").join(attributes.select("file_id", "attributes"), "file_id", "left").select("path", "size", "mode", "attributes")


def kept_locations(locations: DataFrame, excess: DataFrame) -> DataFrame:
    """Per chunk its drives without the excess ones (chunk_id, drive_id), in order."""
    return locations.join(excess, ["chunk_id", "drive_id"], "left_anti").groupBy("chunk_id").agg(F.sort_array(F.collect_list("drive_id")).alias("drives"))


def extent_marks(extents: DataFrame, readable: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks that extents (volume_id, chunk_id) of readable volumes name, volumes that could not be read)."""
    known = F.broadcast(readable.select("volume_id").distinct())
    return extents.join(known, "volume_id", "left_semi").select("chunk_id").distinct(), extents.select("volume_id").distinct().join(known, "volume_id", "left_anti")
