"""Content-addressed storage of bytes: chunks, their digests and what sharing them saves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes below which content is one chunk, and below which it has chunks of FIXED bytes.
SINGLE, SMALL, FIXED = 64 << 10, 1 << 20, 256 << 10


def fixed_chunks(content: DataFrame, size: int) -> DataFrame:
    """file_id, source, pos, hash and length of each chunk of `size` bytes; an empty text has none. Bytes are cut by place, so a file costs its length."""
    body = content.select("file_id", "source", F.col("text").cast("binary").alias("body"))
    at = F.when(F.length("body") > 0, F.sequence(F.lit(0), F.floor((F.length("body") - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = body.select("file_id", "source", "body", F.explode(at).alias("pos"))
    piece = F.substring(F.col("body"), F.col("pos") * size + 1, F.lit(size))
    return parts.select("file_id", "source", F.col("pos").cast("long").alias("pos"), F.sha2(piece, 256).alias("hash"), F.length(piece).cast("long").alias("length"))


def fixed_pieces(content: DataFrame, size: int) -> DataFrame:
    """file_id, start and data of each chunk of `size` bytes."""
    body = content.select("file_id", F.col("text").cast("binary").alias("body")).where(F.length("body") > 0)
    parts = body.select("file_id", "body", F.explode(F.sequence(F.lit(0), F.floor((F.length("body") - 1) / size).cast("int"))).alias("pos"))
    return parts.select("file_id", (F.col("pos") * size).alias("start"), F.substring(F.col("body"), F.col("pos") * size + 1, F.lit(size)).alias("data"))


def dedup_savings(chunked: DataFrame) -> DataFrame:
    """Per source: chunks, distinct chunks, bytes, and bytes after each distinct chunk is stored once."""
    distinct = chunked.groupBy("source", "hash").agg(F.count("*").alias("n"), F.max("length").alias("length"))
    return distinct.groupBy("source").agg(F.sum("n").alias("chunks"), F.count("*").alias("stored_chunks"), F.sum(F.col("n") * F.col("length")).alias("bytes"), F.sum("length").alias("stored_bytes"))


def part_etags(content: DataFrame, size: int) -> DataFrame:
    """Multipart entity tags: the MD5 of the raw MD5 digests of parts of `size` bytes, with the number of parts."""
    body = content.select("file_id", F.col("text").cast("binary").alias("body"))
    at = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("body") - 1) / size).cast("int")))
    parts = F.transform(at, lambda i: F.md5(F.substring(F.col("body"), i * size + 1, F.lit(size))))
    return body.select("file_id", F.concat(F.md5(F.unhex(F.array_join(parts, ""))), F.lit("-"), F.size(parts).cast("string")).alias("etag"))


def chunking(content: DataFrame) -> DataFrame:
    """file_id, bytes, strategy (none, single, fixed, content-defined) and chunks (null where the content defines them) by size."""
    size = F.octet_length("text").cast("long")
    kind = F.when(size == 0, "none").when(size < SINGLE, "single").when(size < SMALL, "fixed").otherwise("content-defined")
    count = F.when(size < SINGLE, (size > 0).cast("long")).when(size < SMALL, F.ceil(size / FIXED).cast("long"))
    return content.select("file_id", size.alias("bytes"), kind.alias("strategy"), count.alias("chunks"))


def write_plan(chunked: DataFrame, stored: DataFrame) -> DataFrame:
    """Per file: chunks that are stored already and get one reference more, chunks to store, and bytes to store; a hash that the files share is stored by the smallest (file, pos)."""
    known = chunked.join(stored.select("hash").distinct().withColumn("known", F.lit(True)), "hash", "left")
    firsts = known.where("known is null").groupBy("hash").agg(F.min(F.struct("file_id", "pos")).alias("first"))
    placed = known.join(firsts, "hash", "left").withColumn("new", F.coalesce(F.struct("file_id", "pos") == F.col("first"), F.lit(False)))
    return placed.groupBy("file_id").agg(F.count_if(~F.col("new")).alias("shared"), F.count_if("new").alias("stored"), F.sum(F.when(F.col("new"), F.col("length")).otherwise(0)).alias("stored_bytes"))


def scrubbed(blobs: DataFrame) -> DataFrame:
    """Blobs (hash, data, key_known) classed as ok, corrupt or key_unavailable."""
    state = F.when(~F.col("key_known"), "key_unavailable").when(F.sha2("data", 256) == F.col("hash"), "ok").otherwise("corrupt")
    return blobs.select("hash", state.alias("state"))


#: Content-defined chunks: least, target and most bytes.
DEFINED = (64 << 10, 256 << 10, 1 << 20)


def defined_chunks(content: DataFrame, least: int = DEFINED[0], target: int = DEFINED[1], most: int = DEFINED[2]) -> DataFrame:
    """file_id, pos, start, length and hash of content-defined chunks of each file's bytes (file_id, body): equal runs of bytes give equal chunks wherever they stand.

    A cut comes where a hash of the last 64 bytes has zeros in its mask, of more bits before
    `target` bytes and of fewer after it, never before `least` nor after `most`.
    """
    import hashlib

    import numpy as np
    import pyarrow as pa

    # a number for each byte from its digest
    gear = [int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)]
    bits = target.bit_length() - 1
    masks = tuple(((1 << n) - 1) << (64 - n) for n in (bits + 2, bits - 2))

    def hashes(data: np.ndarray) -> np.ndarray:
        """At each byte the sum of the last 64 numbers, each doubled once for every byte since."""
        out = np.array(gear, np.uint64)[data]
        width = 1
        while width < 64:
            out[width:] = out[width:] + (out[:-width] << np.uint64(width))
            width *= 2
        return out

    def cuts(data: np.ndarray) -> list[int]:
        marks = hashes(data)
        hard, easy = (np.flatnonzero(marks & np.uint64(m) == 0) + 1 for m in masks)
        at, out = 0, []
        while at < len(data):
            end = min(len(data), at + most)
            for found, low, high in ((hard, at + least, min(end, at + target)), (easy, min(end, at + target), end)):
                k = np.searchsorted(found, low + (found is easy))
                if k < len(found) and found[k] <= high:
                    end = int(found[k])
                    break
            out.append(end)
            at = end
        return out

    def run(batches):
        for batch in batches:
            rows = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body, start = body.as_buffer(), 0
                data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
                for pos, end in enumerate(cuts(data)):
                    rows.append((key, pos, start, end - start, hashlib.sha256(data[start:end]).hexdigest()))
                    start = end
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 4 else pa.int64()) for k, c in enumerate(columns)], ["file_id", "pos", "start", "length", "hash"])

    return content.select(F.col("file_id").cast("long"), F.col("body").cast("binary")).mapInArrow(run, "file_id bigint, pos bigint, start bigint, length bigint, hash string")
