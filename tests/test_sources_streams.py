"""Streams against the same rows as a table, archives written and read back, and gaps over run borders."""

import random

import pytest

from stratalog.operators import files, ordered
from stratalog.sources import manifests
from stratalog.streaming import counters

SF = "/root/testdata/sf0.001"


def test_hourly_counts_of_a_stream_equal_those_of_the_table(spark, tmp_path):
    reads = spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id as hash", "ts").orderBy("ts")
    want = {tuple(r) for r in counters.hourly_counts(reads).collect()}
    source = str(tmp_path / "in")
    reads.repartitionByRange(3, "ts").write.parquet(source)
    stream = counters.hourly_counts(counters.read_events(spark, source, reads.schema, 100), "30 days")
    done, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    # with no watermark reached, the whole state comes out in complete mode
    stream.writeStream.outputMode("complete").format("memory").queryName("hourly").option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("hourly").collect()} == want
    counters.settle(counters.read_events(spark, source, reads.schema), done, str(tmp_path / "mark2"))
    counters.settle(counters.read_events(spark, source, reads.schema), done, str(tmp_path / "mark2"))
    assert spark.read.parquet(done).count() == reads.count()


def test_numbers_go_on_after_the_last(spark):
    rows = spark.createDataFrame([(1, 5), (1, 4), (2, 9)], "node int, ts int")
    assert sorted(tuple(r) for r in counters.numbered(rows, "node", ["ts"], 10).collect()) == [(1, 4, 11), (1, 5, 12), (2, 9, 11)]


def test_manifests_and_a_chain_of_them(spark, tmp_path):
    made = lambda rows: spark.createDataFrame(rows, "path string, size bigint, digest string")
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    manifests.write_manifest(made([("/x", 1, "d1"), ("/y", 2, "d2"), ("/z", 3, "d3")]), a, "v")
    manifests.write_manifest(made([("/y", 4, "d4")]), b, "v", spark.createDataFrame([("/z",)], "path string"))
    assert sorted(tuple(r) for r in manifests.read_manifest(spark, b).collect()) == [("/y", 4, "d4", False), ("/z", None, None, True)]
    assert sorted(tuple(r) for r in files.restored(manifests.chain(spark, [a, b])).collect()) == [("/x", 0, "d1"), ("/y", 1, "d4")]
    spark.sql("select 9 as schema_version, '/q' as path").write.json(str(tmp_path / "c"))
    with pytest.raises(Exception, match="manifest version 9"):
        manifests.read_manifest(spark, str(tmp_path / "c")).collect()
    assert {r.name for r in manifests.snapshots(spark, str(tmp_path)).collect()} == {"a", "b", "c"}


def test_gaps_over_the_borders_of_runs(spark, monkeypatch):
    monkeypatch.setattr(ordered, "RUN", 7)
    draw = random.Random(3)
    there = {(n, s) for n in range(3) for s in range(1, 200) if draw.random() < 0.7}
    want = set()
    for n in range(3):
        got = sorted(s for m, s in there if m == n)
        want |= {(n, a + 1, b - 1) for a, b in zip(got, got[1:], strict=False) if b - a > 1}
    rows = spark.createDataFrame(sorted(there) + sorted(there)[:20], "node int, seq bigint")
    assert {tuple(r) for r in ordered.sequence_gaps(rows, "node").collect()} == want
