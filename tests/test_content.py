"""Content-defined chunks against the rule byte by byte, and ranges of bytes."""

import hashlib
import random

from stratalog.operators import content, files
from stratalog.plans import lists


def by_hand(body, least, target, most):
    gear = [int.from_bytes(hashlib.sha256(bytes([b])).digest()[:8], "little") for b in range(256)]
    bits = target.bit_length() - 1
    hard, easy = (((1 << n) - 1) << (64 - n) for n in (bits + 2, bits - 2))
    marks = []
    for k in range(len(body)):
        marks.append(sum(gear[body[j]] << (k - j) for j in range(max(0, k - 63), k + 1)) % 2**64)
    at, out = 0, []
    while at < len(body):
        end = min(len(body), at + most)
        for k in range(at + least, end + 1):
            if marks[k - 1] & (hard if k <= at + target else easy) == 0:
                end = k
                break
        out.append((at, end - at))
        at = end
    return out


def test_content_defined_chunks(spark):
    draw = random.Random(2)
    shared = draw.randbytes(9_000)
    bodies = [b"", b"x", draw.randbytes(30_000), shared + draw.randbytes(4_000), draw.randbytes(777) + shared, b"\0" * 5_000, None]
    rows = spark.createDataFrame(list(enumerate(bodies)), "file_id bigint, body binary")
    got = content.defined_chunks(rows, 64, 256, 1_024).collect()
    for i, body in enumerate(bodies):
        own = sorted((r.start, r.length) for r in got if r.file_id == i)
        assert own == by_hand(body or b"", 64, 256, 1_024), i
        assert all(r.hash == hashlib.sha256(body[r.start : r.start + r.length]).hexdigest() for r in got if r.file_id == i)
    a, b = ({r.hash for r in got if r.file_id == i} for i in (3, 4))
    assert len(a & b) > 10  # the shared bytes are stored once, wherever they stand


def test_assembled_ranges_end_in_zeros(spark):
    text = spark.createDataFrame([(1, "s", "a" * 10 + "b" * 10), (2, "s", "c" * 3)], "file_id bigint, source string, text string")
    got = {r.file_id: bytes(r.data) for r in files.assembled(content.fixed_pieces(text, 7), 5, 25).collect()}
    assert got == {1: b"a" * 5 + b"b" * 10 + b"\0" * 5}


def test_content_chunks_of_the_documents(spark):
    got = {}
    for r in lists.content_chunks(spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.file_id, []).append((r.pos, r.start, r.length))
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    for r in rows[:60]:
        want = by_hand((r.text or "").encode(), 256, 1_024, 4_096)
        assert sorted(got.get(r.doc_id, [])) == [(k, a, n) for k, (a, n) in enumerate(want)]
    assert set(got) == {r.doc_id for r in rows if r.text}
