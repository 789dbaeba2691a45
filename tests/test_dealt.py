"""Copies are dealt to as many tasks as their number needs, and queries over them give the same rows then."""

import pytest

from stratalog.plans import registry, views

SF = "/root/testdata/sf0.001"
#: Queries that go over all copies, by chunk, stripe or drive.
OVER_COPIES = "drive_usage placement_check evacuation stop_safety best_copies tier_moves reconciled_chunks move_targets replica_targets replica_delta".split()


def test_the_tasks_grow_with_the_copies(spark, monkeypatch):
    copies = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    for rows in (copies // 40, copies // 160):
        monkeypatch.setattr(views, "TASK_ROWS", rows)
        v = views.Views(spark, SF)
        assert v.locations.rdd.getNumPartitions() >= copies / rows
        assert v.dealt(v.shards, "stripe_id").rdd.getNumPartitions() >= copies / rows


@pytest.mark.parametrize("name", OVER_COPIES)
def test_rows_are_the_same_in_many_tasks(spark, monkeypatch, name):
    plain = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    many = registry.QUERIES[name](spark, SF)
    assert sorted(map(repr, many.collect())) == plain


def test_stripes_are_checked_in_as_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 300)
    assert registry.QUERIES["placement_check"](spark, SF).rdd.getNumPartitions() > 8
