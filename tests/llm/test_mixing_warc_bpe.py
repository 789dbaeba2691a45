import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import bpe, mixing, warc
from stratalog.llm.queries_text import tokenizer_path
from stratalog.llm.scratch import Scratch


def test_mixing_meets_targets_to_the_word(docs):
    rows = [(i, "w " * (1 + i % 40), f"s{i % 6}" if i % 6 else None) for i in range(600)] + [(1000, None, "tiny"), (1001, "one two", "tiny")]
    out = mixing.schedule(docs(rows))
    per = out.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("source_size").alias("size"), F.max("weight").alias("w")).collect()
    assert all(abs(r.taken - r.target) < 1 for r in per)
    assert abs(sum(r.target for r in per) - sum(r.size for r in per)) < 1e-6
    assert out.where("taken > 3 * size or taken < 0").count() == 0
    named = sorted((r for r in per if r.source), key=lambda r: r.source) + [r for r in per if not r.source]
    assert [r.w for r in named] == [1, 2, 3, 1, 2, 3, 1]
    assert next(r for r in per if r.source == "tiny").taken == 6
    assert sorted(out.collect()) == sorted(mixing.schedule(docs(rows).repartition(7)).collect())


def test_mix_order_and_texts(docs):
    rows = [(i, f"a{i} b c\td", "x" if i % 3 else "y") for i in range(90)] + [(500, "", "x"), (501, None, None)]
    plan = mixing.schedule(docs(rows))
    ordered = mixing.in_order(plan).collect()
    assert [r.virtual_finish for r in ordered] == sorted(r.virtual_finish for r in ordered)
    out = mixing.mixed(docs(rows))
    assert out.columns == docs([]).columns
    assert sum(len(r.text.split()) for r in out.collect()) == plan.agg(F.sum("taken")).first()[0] == sum(r.words for r in ordered)


def test_mixing_empty_and_wordless(docs):
    assert mixing.schedule(docs([])).count() == 0
    assert [r.taken for r in mixing.schedule(docs([(1, None, None), (1, "", "a")])).collect()] == [0, 0]


PAGES = [(1, "http://a", "x" * 100), (2, "u\r\nWARC-Type: fake", "x" * 100), (3, None, "short"), (4, "b", "short"), (5, "c", None), (6, "d", ""), (7, "e", "é" * 50), (7, "e", "é" * 50), (None, "f", "x" * 100), (8, "g", "z\r\n\r\nWARC/1.1\r\n" * 20_000)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id bigint, url string, html string, digest string, header int")


def test_warc_round_trip(spark):
    out = {(r.page_id, r.payload_bytes): r for r in warc.archived(spark, pages(spark, PAGES)).collect()}
    for i, _, html in PAGES:
        r = out[i, len((html or "").encode())]
        assert r.payload_digest == hashlib.sha256((html or "").encode()).hexdigest()
        assert (r.record_type, r.refers_to) == (("revisit", 1) if i in (2, None) else ("response", None))
    payloads, records = warc.write_archive(pages(spark, PAGES), Scratch(spark, "t"))
    assert payloads.count() == len({p or "" for _, _, p in PAGES}) and records.count() == len(PAGES)
    raw = {r.page_id: bytes(r.record) for r in warc.record_bytes(warc.restore(payloads, records)).collect()}
    assert raw[1].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw[1].endswith(b"\r\n\r\n" + b"x" * 100 + b"\r\n\r\n")
    assert b"Content-Length: 0\r\n\r\n\r\n\r\n" in raw[2] and b"u%0D%0AWARC-Type: fake" in raw[2]


def test_warc_damage_and_empty(spark):
    assert warc.archived(spark, pages(spark, [])).count() == 0
    payloads, records = warc.write_archive(pages(spark, PAGES[:3]), Scratch(spark, "t"))
    broken = payloads.withColumn("payload", F.concat("payload", F.lit("!").cast("binary")))
    assert {r.intact for r in warc.restore(broken, records).collect()} == {False}


TEXTS = ["", None, "Hello, WORLD's 123 ½ foo_bar", "a" * 20_000, "<|endoftext|>x<|startoftext|>", "ΑΣ Σ'LL", "\x1c\x85​  é é", "中文 字🙂", "don't  stop\n\tnow"]


def test_bpe_equals_the_library(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_path()
    reference = tokenizers.Tokenizer.from_file(path)
    out = {r.doc_id: r for r in bpe.encoded(docs([(i, t, None) for i, t in enumerate(TEXTS)]), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = reference.encode(t or "", add_special_tokens=False).ids
        text = reference.decode(ids, skip_special_tokens=False)
        assert (out[i].ids, out[i].decoded, out[i].n_tokens) == (ids, text, len(ids))
        assert out[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encoded(docs([]), path).count() == 0
