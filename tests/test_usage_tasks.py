"""Every query over the use of drives meets the copies in as many tasks as their number needs, and gives the same rows then."""

import time

import pytest

from stratalog.plans import registry, views

SF, ROWS = "/root/testdata/sf0.001", 300
OVER_USAGE = [
    "cluster_capacity",
    "drive_usage",
    "pressure_levels",
    "rebalance_pairs",
    "storage_health",
    "storage_pressure",
    "tier_balance",
    "tier_usage",
    "any_tier_capacity",
    "move_targets",
    "write_targets",
]


def most_tasks(spark, group: str) -> int:
    """Tasks of the widest stage that a group of jobs ran, when its jobs have ended."""
    tracker = spark.sparkContext.statusTracker()
    for _ in range(100):
        jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(group)]
        if jobs and all(j and j.status == "SUCCEEDED" for j in jobs):
            break
        time.sleep(0.1)
    stages = [tracker.getStageInfo(s) for j in jobs for s in j.stageIds]
    return max(s.numTasks for s in stages if s)


@pytest.mark.parametrize("name", OVER_USAGE)
def test_copies_are_met_in_as_many_tasks_as_they_need(spark, monkeypatch, name):
    copies = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    plain = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(views, "TASK_ROWS", ROWS, raising=False)
    group = f"usage-{name}"
    spark.sparkContext.setJobGroup(group, name)
    try:
        many = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert many == plain
    assert most_tasks(spark, group) >= copies / ROWS


@pytest.mark.parametrize("name", OVER_USAGE)
def test_copies_are_met_in_no_more_tasks_than_they_need(spark, monkeypatch, name):
    """Many shuffle partitions, each with pages of its own, are no reason for more tasks; chunks and copies meet without another shuffle."""
    copies = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    plain = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(views, "TASK_ROWS", ROWS, raising=False)
    group = f"usage-least-{name}"
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup(group, name)
    try:
        many = sorted(map(repr, registry.QUERIES[name](spark, SF).collect()))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert many == plain
    assert most_tasks(spark, group) == copies // ROWS + 1
