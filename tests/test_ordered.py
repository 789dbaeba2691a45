"""Operators on ordered rows against the plain rule, where the registered SQL has a cut of its own."""

import datetime
import random

import duckdb

from stratalog.operators import ordered
from stratalog.plans import registry

SF = "/root/testdata/sf0.001"


def test_claim_conflicts_count_every_claim(spark):
    """All of lineitem, pairs formed one by one."""
    claims = f"""SELECT row_number() OVER () AS id, l_partkey % 500 AS path, l_linenumber * 10 AS first, l_suppkey % 3 = 0 AS exclusive,
        CASE WHEN l_partkey % 50 = 0 THEN 1099511627776 ELSE l_linenumber * 10 + l_quantity::BIGINT END AS stop FROM '{SF}/lineitem.parquet'"""
    want = duckdb.sql(f"""WITH c AS MATERIALIZED ({claims}) SELECT path, count(*), (SELECT count(*) FROM c a JOIN c b ON a.path = b.path AND a.id < b.id
        WHERE a.path = o.path AND a.first < b.stop AND b.first < a.stop AND (a.exclusive OR b.exclusive)) FROM c o GROUP BY path""").fetchall()
    got = [(r.path, r.claims, r.conflicts) for r in registry.QUERIES["claim_conflicts"](spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r[1] for r in got) == duckdb.sql(f"SELECT count(*) FROM '{SF}/lineitem.parquet'").fetchall()[0][0]


def kept_by_hand(items, now):
    """The reference's walk: newest first, each stage over what the stage before it left."""
    keys = {"day": lambda t: t.date(), "week": lambda t: t.isocalendar()[:2], "month": lambda t: (t.year, t.month)}
    out = set()
    for volume in {v for v, _, _ in items}:
        left = sorted(((t, i) for v, i, t in items if v == volume), reverse=True)
        for stage, most, age in (("day", 7, 7), ("week", 4, 28), ("month", 12, 372)):
            claimed, rest = set(), []
            for t, i in left:
                if len(claimed) >= most or (now - t) // datetime.timedelta(days=1) >= age or keys[stage](t) in claimed:
                    rest.append((t, i))
                else:
                    claimed.add(keys[stage](t))
                    out.add((volume, i, stage))
            left = rest
    return out


def test_retained_backups_day_week_month(spark):
    now, draw = datetime.datetime(2001, 8, 2), random.Random(5)
    hours = [draw.randrange(24 * 500) for _ in range(900)] + [0, 0, 7 * 24, 28 * 24, 372 * 24, 7 * 24 - 1, 28 * 24 - 1, 372 * 24 - 1]
    items = [(i % 3 or None, i, now - datetime.timedelta(hours=h)) for i, h in enumerate(hours)]
    # many on one day: those that the day does not keep can still claim the week and the month
    items += [(7, 2000 + h, now - datetime.timedelta(hours=h)) for h in range(1, 10)] + [(8, 3000, now - datetime.timedelta(days=400))]
    found = ordered.retained(spark.createDataFrame(items, "volume_id bigint, file_id bigint, created_at timestamp_ntz"), str(now)).collect()
    assert len(found) == len(set(found))
    assert {tuple(r) for r in found} == kept_by_hand(items, now)
    assert {r.stage for r in found if r.volume_id == 7} == {"day", "week", "month"}


def test_retained_backups_of_the_tables(spark):
    items = duckdb.sql(f"SELECT o_orderkey % 25, o_orderkey, o_orderdate FROM '{SF}/orders.parquet'").fetchall()
    found = {(r.volume_id, r.file_id, r.stage) for r in registry.QUERIES["retained_backups"](spark, SF).collect()}
    assert found == kept_by_hand(items, datetime.datetime.fromisoformat(registry.NOW_ORDERS))
