"""Counters, gauges, distributions, clocks and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import running_total


def metrics(events: DataFrame, name: str, value: str, at: list[str], buckets: list[float]) -> DataFrame:
    """Per metric: count, sum, last value, and events at or below each of some bounds."""
    sums = [F.count_if(F.col(value) <= b).alias(f"le_{b:g}".replace(".", "_")) for b in buckets]
    return events.groupBy(F.col(name).alias("metric")).agg(F.count("*").alias("events"), F.round(F.sum(value), 2).alias("total"), F.max_by(value, F.struct(*at)).alias("last"), *sums)


def nearest_rank(events: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Per group: the values of rank round(p / 100 * n), at least 1, and the largest.

    Equal values are summed first and ranked by running counts over ranges of values, so a
    group is spread over as many tasks as there are deals of its value range.
    """
    counts = events.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("of"), F.col(value).alias("v")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("deal", F.floor(F.log2(F.abs("v") + 1) * 8) * F.signum("v"))
    deals = counts.groupBy("of", "deal").agg(F.sum("n").alias("in_deal"))
    order = Window.partitionBy("of").orderBy("deal")
    deals = deals.select("of", "deal", (F.sum("in_deal").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("in_deal")).alias("before"), F.sum("in_deal").over(Window.partitionBy("of")).alias("total"))
    up_to = F.sum("n").over(Window.partitionBy("of", "deal").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumn("inside", up_to).join(deals, ["of", "deal"]).withColumn("upto", F.col("before") + F.col("inside"))
    pick = lambda p: F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.round(F.col("total") * p / 100)), F.col("v"))).alias(f"p{p}")
    return ranked.groupBy(F.col("of").alias(group)).agg(*map(pick, percents), F.max("v").alias("max"))


def clamped_totals(deltas: DataFrame, group: str, order: list[str], delta: str) -> DataFrame:
    """Per group: the sum of signed deltas in order (the first of it a time), never below 0 on the way: the whole sum less the least running sum, if that is negative."""
    run = running_total(deltas, group, F.date_trunc("hour", order[0]), order, delta, "run")
    return run.groupBy(group).agg((F.sum(delta) - F.least(F.lit(0), F.min("run"))).alias("total"))


def newest_by_clock(rows: DataFrame, group: str, wall: str, counter: str, node: str) -> DataFrame:
    """The row of each group with the greatest clock: wall time, then counter, then node."""
    return rows.groupBy(group).agg(F.max(F.struct(wall, counter, node)).alias("top")).select(group, f"top.{wall}", f"top.{counter}", f"top.{node}")


def fair_order(queue: DataFrame, group: str, weight: str, arrival: list[str]) -> DataFrame:
    """A backlog in the order of weighted fair queueing: each item's virtual finish is its place in its group over the group's weight; ties go to the greater weight."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*arrival))
    return queue.withColumn("finish", place / F.col(weight))
