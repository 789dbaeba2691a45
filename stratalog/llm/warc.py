"""A content-addressed WARC archive as two tables.

`payloads` holds every distinct payload once under its SHA-256, which is checked when it
is read; `records` holds the exact header block of each record with the digest it points
to. A WARC record is the header block, an empty line and the payload; a join restores it,
and what is reported of a record is parsed from its restored bytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BROADCAST_IDS, Scratch, col

#: Equal payloads of at least so many bytes are stored as revisits of the first.
REVISIT_BYTES = 100
#: Fixed values of the WARC 1.1 format.
VERSION, CRLF = "WARC/1.1", "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The capture date of records whose table has none.
CAPTURED = "1970-01-01T00:00:00Z"


def record_id(page_id: Column) -> Column:
    """A stable urn:uuid from the page's id."""
    h = F.sha2(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(">"))


def header_value(block: Column, name: str) -> Column:
    """The value of one header field, null where the block has none."""
    found = F.regexp_extract(block, rf"(?:^|\r\n){name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def write_archive(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> tuple[DataFrame, DataFrame]:
    """Write (payloads, records) of `pages` and return them as reread from storage.

    Null payload is empty, null url an empty target. Of records with equal payloads of at
    least REVISIT_BYTES that with the smallest id is the response, the others revisit it;
    a null id counts as the largest. Line breaks in a url become %0D and %0A, so that they
    cannot end a header field. No pages give two empty tables.
    """
    url = F.replace(F.replace(F.coalesce(col(url_col).cast("string"), F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    rows = pages.select(col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    index = scratch.save(rows.select("page_id", "url", "digest", "payload_bytes"), "index")
    firsts = index.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
    firsts = scratch.save(firsts, "firsts")
    payloads = scratch.save(stored_once(rows, scratch.save(firsts.where("copies > 1"), "repeated")), "payloads")
    placed = index.join(firsts.where("copies > 1").select("digest", "first_id"), "digest", "left")
    revisit = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    body = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF))
    block = F.concat(
        F.lit(VERSION + CRLF),
        field("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", record_id(F.col("page_id"))),
        field("WARC-Date", F.lit(CAPTURED)),
        field("WARC-Target-URI", F.col("url")),
        F.when(revisit, F.concat(field("WARC-Profile", F.lit(REVISIT_PROFILE)), field("WARC-Refers-To", record_id(F.col("first_id"))), field("X-Refers-To-Page", F.col("first_id")))).otherwise(F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        field("X-Payload-Length", F.col("payload_bytes")),
        field("Content-Length", body),
        F.lit(CRLF),
    )
    records = scratch.save(placed.select("page_id", "digest", block.cast("binary").alias("header")), "records")
    scratch.drop("index", "firsts", "repeated")
    return payloads, records


def stored_once(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """digest and payload of each distinct payload. Payloads of one row stay where they are; of repeated ones only those under the first id are shuffled."""
    again = repeated.select("digest", "first_id")
    if again.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4:
        again = F.broadcast(again)
    marked = rows.select("page_id", "digest", "payload").join(again.withColumn("again", F.lit(True)), "digest", "left")
    alone = marked.where("again is null").select("digest", "payload")
    # a null id comes after all others: with nothing but null ids, all rows are candidates
    several = marked.where(F.col("again") & F.coalesce(F.col("page_id") == F.col("first_id"), F.col("first_id").isNull())).select("digest", "payload")
    return alone.union(several.dropDuplicates(["digest"]))


def restore(payloads: DataFrame, records: DataFrame) -> DataFrame:
    """One row per record: page_id, header, payload, intact (the stored bytes still have the digest and length that the header states)."""
    checked = payloads.select("digest", "payload", (F.sha2("payload", 256) == F.col("digest")).alias("sound"))
    block = F.col("header").cast("string")
    return records.join(checked, "digest", "left").select(
        "page_id", "header", "payload",
        (F.coalesce("sound", F.lit(False)) & (header_value(block, "WARC-Payload-Digest") == F.concat(F.lit("sha256:"), "digest")) & (F.octet_length("payload").cast("string") == header_value(block, "X-Payload-Length"))).alias("intact"),
    )


def with_body(revisit: Column) -> Column:
    """A record's bytes from its header block and payload."""
    end = F.lit(CRLF * 2).cast("binary")
    return F.when(revisit, F.concat("header", end)).otherwise(F.concat("header", "payload", end))


def record_bytes(restored: DataFrame) -> DataFrame:
    """The records as a WARC file holds them: page_id, record. A revisit has no payload of its own."""
    revisit = header_value(F.col("header").cast("string"), "WARC-Type") == "revisit"
    return restored.select("page_id", with_body(revisit).alias("record"))


def parsed(records: DataFrame) -> DataFrame:
    """`records` (page_id, record) cut into header block and body again, as a reader of WARC files does: page_id, block, body, whole (the record ends where its lengths say)."""
    text = F.col("record").cast("string")
    block = F.concat(F.substring_index(text, CRLF * 2, 1), F.lit(CRLF))
    size = header_value(F.col("block"), "Content-Length").cast("int")
    at = F.octet_length("block") + len(CRLF)
    body = F.substring(F.col("record"), at + 1, F.col("size"))
    end = F.octet_length("record") == at + F.col("size") + 2 * len(CRLF)
    return records.withColumn("block", block).withColumn("size", size).select("page_id", "block", body.alias("body"), (F.col("block").startswith(VERSION + CRLF) & end).alias("whole"))


def archived(spark: SparkSession, pages: DataFrame, **columns: str) -> DataFrame:
    """Write and read back an archive: page_id, payload_bytes, payload_digest, record_type, refers_to, all parsed from the restored records.

    A damaged record fails the job: one whose stored payload has not the digest and length
    that its header states, whose lengths do not add up, or whose own body, if it is a
    response, has another digest than it states. Cases of nulls, empty payloads, ties and
    repeated rows are those of `write_archive`.
    """
    payloads, records = write_archive(pages, Scratch(spark, "warc"), **columns)
    restored = restore(payloads, records)
    revisit = header_value(F.col("header").cast("string"), "WARC-Type") == "revisit"
    read = parsed(restored.select(F.struct("page_id", "intact").alias("page_id"), with_body(revisit).alias("record")))
    kind = header_value(F.col("block"), "WARC-Type")
    stated = F.substring(header_value(F.col("block"), "WARC-Payload-Digest"), 8, 64)
    sound = F.col("page_id.intact") & F.col("whole") & F.when(kind == "response", F.sha2("body", 256) == stated).otherwise(F.octet_length("body") == 0)
    page = F.col("page_id.page_id")
    damaged = F.raise_error(F.concat(F.lit("damaged record of page "), F.coalesce(page.cast("string"), F.lit("null")))).cast("long")
    return read.select(
        page.alias("page_id"),
        F.when(F.coalesce(sound, F.lit(False)), header_value(F.col("block"), "X-Payload-Length").cast("long")).otherwise(damaged).alias("payload_bytes"),
        stated.alias("payload_digest"),
        kind.alias("record_type"),
        header_value(F.col("block"), "X-Refers-To-Page").cast("long").alias("refers_to"),
    )
