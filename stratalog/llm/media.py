"""Media columns: data kept as lossless WebP images, three bytes a pixel, and read back as pixel arrays.

A payload is a series of strips, an image file each, one after the other in one binary
column, so a payload of any length is written and read in runs of bounded size.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import Scratch, col, in_arrow
from .textkit import slices
from .webp import STRIP, WIDTH, Known, read_strips, write_strips

#: A payload is filled up with blanks to a multiple of a row of pixels.
ROW_BYTES = WIDTH * 3
#: Bytes that are written, or whose strips are read, at once; whole strips.
RUN_BYTES = 1360 * STRIP * 3
#: Tail of the payload that has a checksum of its own.
TAIL_BYTES = 16
#: Parts of the payload whose means make the feature's bits.
PARTS = 64


def padded(text: bytes) -> bytes:
    return text + b" " * (-len(text) % ROW_BYTES or (0 if text else ROW_BYTES))


def runs(items: list[list], size) -> Iterator[list[tuple[int, object]]]:
    """(item, piece) in runs of about RUN_BYTES, in order."""
    held, total = [], 0
    for k, pieces in enumerate(items):
        for piece in pieces:
            n = size(piece)
            if held and total + n > RUN_BYTES:
                yield held
                held, total = [], 0
            held.append((k, piece))
            total += n
    if held:
        yield held


def to_media(payloads: list[bytes]) -> list[bytes]:
    out: list[list[bytes]] = [[] for _ in payloads]
    cut = [[p[a : a + RUN_BYTES] for a in range(0, len(p), RUN_BYTES)] for p in payloads]
    for run in runs(cut, len):
        files = write_strips(np.frombuffer(b"".join(p for _, p in run), np.uint8), np.array([len(p) for _, p in run]))
        for (k, _), file in zip(run, files, strict=True):
            out[k].append(file)
    return [b"".join(x) for x in out]


def files_of(series: bytes) -> list[bytes]:
    at, out = 0, []
    while at < len(series):
        size = 8 + int.from_bytes(series[at + 4 : at + 8], "little")
        out.append(series[at : at + size])
        at += size
    return out


def from_media(media: list[bytes], known: Known) -> list[bytes]:
    out: list[list[bytes]] = [[] for _ in media]
    for run in runs([files_of(m) for m in media], lambda f: STRIP * 3):
        for (k, _), data in zip(run, read_strips([f for _, f in run], known), strict=True):
            out[k].append(data)
    return [b"".join(x) for x in out]


def feature(payload: bytes) -> str:
    """Rows of pixels, mean of each channel, and a bit for each part of the payload that is brighter than the whole."""
    samples = np.frombuffer(payload, np.uint8)
    means = samples.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (len(samples) // 3)
    parts = samples.reshape(PARTS, -1).sum(axis=1, dtype=np.int64)
    bits = np.packbits(parts * PARTS > parts.sum()).tobytes().hex()
    return f"{len(samples) // ROW_BYTES} {' '.join(f'{m:.3f}' for m in means)} {bits}"


def written(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the payload's WebP files) of each input row."""

    def run(batches):
        for batch in batches:
            for ids, texts in slices(batch.column(0), batch.column(1), RUN_BYTES):
                bodies = [t.as_buffer() for t in texts]
                bodies = [b"" if b is None else b.to_pybytes() for b in bodies]
                media = to_media([padded(b) for b in bodies])
                yield pa.RecordBatch.from_arrays([ids, pa.array([len(b) for b in bodies], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").alias("text"))
    return in_arrow(rows, run, "doc_id bigint, n_bytes bigint, media binary")


def described(stored: DataFrame, payloads: bool = False) -> DataFrame:
    """Reads the media column: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, with payloads, payload (the samples)."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["payload"] * payloads
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]  # from payload_bytes on
    sha = lambda b: hashlib.sha256(b).hexdigest()

    def run(batches):
        known = Known()
        for batch in batches:
            for part, media in slices(pa.StructArray.from_arrays(batch.columns[:2], ["doc_id", "n_bytes"]), batch.column(2), RUN_BYTES):
                files = media.to_pylist()
                rows = []
                for file, data in zip(files, from_media(files, known), strict=True):
                    row = (len(data), sha(data), zlib.crc32(data[-TAIL_BYTES:]), len(file), sha(file), feature(data))
                    rows.append((*row, data) if payloads else row)
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*part.flatten(), *columns], names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return in_arrow(stored.select("doc_id", "n_bytes", "media"), run, schema + ", payload binary" * payloads)


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", payloads: bool = False) -> DataFrame:
    """Stores every text as media in the shared folder, rereads it and describes what was read.

    Null text is empty; an empty text is a row of blanks. Equal texts have equal media.
    Repeated rows are stored each by itself, null ids stay, other columns are ignored; an
    empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "media")
    return described(scratch.save(written(docs, id_col, text_col), "media"), payloads)
