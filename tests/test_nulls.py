"""Queries on tables with null keys, times and ids against their SQL, and helper names that clash with columns."""

import duckdb
import pytest
from pyspark.sql import functions as F

from oracle import same
from swarmlens.operators import alerts, ordering, temporal
from swarmlens.plans import registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def holed(tmp_path_factory):
    """The small tables, with nulls in the events: every ninth has no user, every eleventh no type, and every seventh no time."""
    folder = tmp_path_factory.mktemp("holed")
    db = duckdb.connect()
    for t in "documents customer orders lineitem labels pages".split():
        db.execute(f"COPY (SELECT * FROM '{SMALL}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
    db.execute(f"COPY (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN ts END AS ts, CASE WHEN event_id % 9 > 0 THEN user_id END AS user_id, CASE WHEN event_id % 11 > 0 THEN event_type END AS event_type, value, props FROM '{SMALL}/events.parquet') TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", ["W1_intervals", "T1_sliding_rates", "T2_burst", "T4_coordinated", "T6_ewma_baseline", "A9_running_totals", "A13_rate_statistics", "M5_throttle", "R4_reputation_fold"])
def test_rows_without_key_or_time(spark, holed, name):
    from oracle import connect  # noqa: F401

    same_tables(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], holed)


def same_tables(spark, query, sql, folder):
    import os

    import oracle

    there = [t for t in oracle.TABLES if os.path.exists(f"{folder}/{t}.parquet")]
    kept, oracle.TABLES = oracle.TABLES, there
    try:
        same(spark, query, sql, folder)
    finally:
        oracle.TABLES = kept


def fold(rows, window, most):
    """The throttle as a plain loop."""
    out, state = {}, {}
    for rule, ts, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, r[2])):
        opened, n = state.get(rule, (None, 0))
        if not n or (ts is not None and opened is not None and ts - opened > window):
            opened, n = ts, 0
        state[rule] = (opened, n + 1)
        out[rule, i] = n + 1 <= most
    return out


def test_throttle_equals_a_fold(spark):
    import random

    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), r.choice([None, *range(0, 40_000)]) if i % 40 else None, i) for i in range(1500)]
    rows += [("dense", i // 3, 10_000 + i) for i in range(3000)] + [("edge", 300 * i, 20_000 + i) for i in range(50)] + [("untimed", None, 30_000 + i) for i in range(6)]
    frame = spark.createDataFrame(rows, "rule string, s long, id long").select("rule", F.timestamp_seconds("s").alias("ts"), "id")
    got = {(x["rule"], x["id"]): x["passed"] for x in alerts.throttled(frame, 300, 3).collect()}
    assert got == fold(rows, 300, 3)


def test_throttle_of_a_long_stretch(spark):
    """A million alerts of one rule, a second apart: one stretch without a gap, of 3322 windows of 301 seconds."""
    frame = spark.range(1_000_000).select(F.lit("r").alias("rule"), F.timestamp_seconds("id").alias("ts"), "id")
    found = alerts.throttled(frame, 300, 3)
    assert found.where((F.col("id") % 301 < 3) != F.col("passed")).count() == 0 and found.where("passed").count() == 3 * 3322 + 3


def test_helper_names_may_clash(spark):
    names = "_hour _n _before _last _carried hour part all before nth last carried own us rate n k".split()
    e = spark.createDataFrame([(1, 10 * i, i) for i in range(30)], "key long, s long, id long").select("key", F.timestamp_seconds("s").alias("ts"), "id", *[F.lit(f"own {n}").alias(n) for n in names])
    for out in (ordering.ranked(e, "key", "ts", ["id"], "place"), ordering.previous_time(e, "key", "ts", ["id"], "place"), ordering.filled_forward(e, "key", "ts", ["id"], F.col("id"), "place")):
        assert sorted(out.columns) == sorted([*e.columns, "place"]) and out.count() == 30
        assert all(out.where(F.col(n) == f"own {n}").count() == 30 for n in names[:6])
    for kind in ("bigint", "string"):  # a key column named like a helper
        keyed = e.select(F.col("key").cast(kind).alias("k"), "ts", "id")
        assert [(r["highest"], r["lowest"]) for r in temporal.rate_baseline(keyed, "k", "ts", "id").collect()] == [(30.0, 10.0)]
