"""Ranks, running sums, previous rows and carried values along a key's time, without one task for a key.

A key's rows are ordered inside hours; what passes from hour to hour is one row for
each key and hour.  A key that holds a third of the table is therefore many groups.

Every row is kept: a null key is a key like any other, rows without a time come after
all rows with one (in an hour of their own), and a null in ``order`` comes last among
ties.  Helper columns have names that no column of the input has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions.names import fresh, matched


def _orders(ts: str, order: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in (ts, *order)]


def _across(key: str, hour: str):
    """From hour to hour of a key, the rows without a time last."""
    return Window.partitionBy(key).orderBy(F.col(hour).asc_nulls_last())


def running(df: DataFrame, key: str, ts: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over each row of a key and all rows before it."""
    hour, part, all_, before = fresh(df.withColumn(name, F.lit(0)), "hour", "part", "all", "before")
    df = df.withColumn(part, value).withColumn(hour, F.date_trunc("hour", ts))
    sums = df.groupBy(key, hour).agg(F.sum(part).alias(all_))
    offsets = sums.select(key, hour, F.coalesce(F.sum(all_).over(_across(key, hour).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    inside = Window.partitionBy(key, hour).orderBy(*_orders(ts, order)).rowsBetween(Window.unboundedPreceding, 0)
    return matched(df.withColumn(name, F.sum(part).over(inside)), offsets, [key, hour]).withColumn(name, F.col(name) + F.col(before)).drop(hour, part, before)


def ranked(df: DataFrame, key: str, ts: str, order: list[str], name: str = "k") -> DataFrame:
    """``df`` with each row's number under its key, from 1, by time and ``order``."""
    return running(df, key, ts, order, F.lit(1).cast("bigint"), name)


def previous_time(df: DataFrame, key: str, ts: str, order: list[str], name: str = "previous") -> DataFrame:
    """``df`` with the time of the row before under its key (null for the first, and after a row without a time)."""
    hour, nth, last, carried = fresh(df.withColumn(name, F.lit(0)), "hour", "nth", "last", "carried")
    df = df.withColumn(hour, F.date_trunc("hour", ts))
    ends = df.groupBy(key, hour).agg(F.max(ts).alias(last))
    passed = ends.select(key, hour, F.lag(last).over(_across(key, hour)).alias(carried))
    inside = Window.partitionBy(key, hour).orderBy(*_orders(ts, order))
    timed = df.withColumn(name, F.lag(ts).over(inside)).withColumn(nth, F.row_number().over(inside))
    return matched(timed, passed, [key, hour]).withColumn(name, F.when(F.col(nth) == 1, F.col(carried)).otherwise(F.col(name))).drop(hour, nth, carried)


def filled_forward(df: DataFrame, key: str, ts: str, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the last ``value`` that is not null at or before each row of a key."""
    df = df.withColumn(name, value)
    hour, last, carried = fresh(df, "hour", "last", "carried")
    df = df.withColumn(hour, F.date_trunc("hour", ts))
    until = Window.unboundedPreceding
    place = F.struct(F.col(ts), *[x for c in order for x in (F.col(c).isNull(), F.col(c))])  # null last, as in _orders
    ends = df.groupBy(key, hour).agg(F.max_by(name, F.when(F.col(name).isNotNull(), place)).alias(last))
    passed = ends.select(key, hour, F.last(last, ignorenulls=True).over(_across(key, hour).rowsBetween(until, -1)).alias(carried))
    filled = df.withColumn(name, F.last(name, ignorenulls=True).over(Window.partitionBy(key, hour).orderBy(*_orders(ts, order)).rowsBetween(until, 0)))
    return matched(filled, passed, [key, hour]).withColumn(name, F.coalesce(name, carried)).drop(hour, carried)
