"""Temporal analysis of keyed events: sliding rates, bursts, periods, coordination, baselines.

A null key is a key like any other.  Events without a time fall into no window and no
bucket; they count as events of their key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions.names import matched
from swarmlens.functions.scores import p_value, severity
from swarmlens.operators.ordering import previous_time, ranked

MICRO = 1_000_000


def sliding_rates(events: DataFrame, key: str, ts: str, window_s: int) -> DataFrame:
    """(key, i, start_us, n, rate): windows (start, start + w), both ends open, on a grid of w / 10 from a key's first event, as long as a start is before its last.

    Each event names the at most ten windows it falls into, so windows and events meet
    in a count, not in a range join; windows without events are filled in.
    """
    w, step = window_s * MICRO, window_s * MICRO // 10
    us = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us"))
    span = us.groupBy(key).agg(F.min("us").alias("first"), F.max("us").alias("last"))
    grid = span.withColumn("m", F.expr(f"(last - first - 1) div {step}")).where("last > first").select(key, "first", F.explode(F.expr("sequence(0L, m)")).alias("i"))
    low, high = f"greatest(0L, (us - first - {w}) div {step} + if(us - first >= {w}, 1, 0))", f"least((us - first + {step - 1}) div {step} - 1, (last - first - 1) div {step})"
    hits = matched(us.where("us IS NOT NULL"), span, [key]).withColumn("low", F.expr(low)).withColumn("high", F.expr(high)).where("low <= high").select(key, F.explode(F.expr("sequence(low, high)")).alias("i"))
    counts = hits.groupBy(key, "i").agg(F.count("*").alias("n"))
    filled = matched(grid, counts, [key, "i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return filled.select(key, "i", (F.col("first") + F.col("i") * step).alias("start_us"), "n", (F.col("n") / (window_s / 60.0)).alias("rate"))


def bursts(rates: DataFrame, events: DataFrame, key: str, threshold: float = 2.0, min_events: int = 5) -> DataFrame:
    """Per key: z score of the peak, verdict, confidence, p value, and the first, peak and last start of the burst."""
    count = events.groupBy(key).agg(F.count("*").alias("n_events"))
    stats = rates.groupBy(key).agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("sigma"), F.max("rate").alias("peak"))
    peak = matched(rates, stats.select(key, "peak"), [key]).where(F.col("rate") == F.col("peak")).groupBy(key).agg(F.min("i").alias("peak_i"))
    low = matched(matched(rates, stats.select(key, "peak"), [key]), peak, [key]).where(F.col("rate") < 0.3 * F.col("peak"))
    edge = low.groupBy(key).agg(F.max(F.when(F.col("i") <= F.col("peak_i"), F.col("i") + 1)).alias("start_i"), F.min(F.when(F.col("i") >= F.col("peak_i"), F.col("i"))).alias("end_i"))
    z = F.when(F.col("sigma") > 0, (F.col("peak") - F.col("mean")) / F.col("sigma")).otherwise(0.0)
    out = matched(matched(matched(stats, count, [key]).where(F.col("n_events") >= min_events), peak, [key]), edge, [key], "left").withColumn("z", z)
    confidence = F.least(F.lit(1.0), F.abs("z") / 5) * F.least(F.lit(1.0), F.col("n_events") / (2.0 * min_events))
    return out.select(key, "n_events", "z", (F.col("z") > threshold).alias("is_burst"), confidence.alias("confidence"), p_value(F.col("z")).alias("p_value"), "start_i", "peak_i", "end_i")


def autocorrelation(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Lag-1 autocorrelation; the denominator leaves the last term out; 0 where it is 0."""
    w = Window.partitionBy(*keys).orderBy(order)
    mean = series.groupBy(*keys).agg(F.avg(value).alias("_m"))
    pairs = matched(series.withColumn("_next", F.lead(value).over(w)), mean, keys).where("_next IS NOT NULL")
    x = F.col(value) - F.col("_m")
    return pairs.groupBy(*keys).agg((F.sum(x * (F.col("_next") - F.col("_m")))).alias("_n"), F.sum(x * x).alias("_d")).select(*keys, F.when(F.col("_d") == 0, 0.0).otherwise(F.try_divide(F.col("_n"), F.col("_d"))).alias("correlation"))


def periods(events: DataFrame, key: str, ts: str, low_min: int, high_min: int) -> DataFrame:
    """(key, period_min, correlation): every period of whole minutes over counts in whole buckets, empty ones as 0."""
    us = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("us IS NOT NULL")
    span = us.groupBy(key).agg(F.min("us").alias("first"), (F.max("us") - F.min("us")).alias("length"))
    # a bucket is some whole minutes from the key's first event: events are counted by minute once, whatever the number of periods
    minutes = matched(us, span, [key]).withColumn("minute", F.expr(f"(us - first) div {60 * MICRO}L")).groupBy(key, "minute").agg(F.count("*").alias("n"))
    grid = span.withColumn("period_min", F.explode(F.sequence(F.lit(low_min), F.lit(high_min)))).withColumn("buckets", F.expr(f"length div (period_min * {60 * MICRO}L)")).where("buckets >= 2")
    cells = grid.select(key, "period_min", F.explode(F.expr("sequence(0L, buckets - 1)")).alias("bucket"))
    counts = matched(minutes, grid, [key]).withColumn("bucket", F.expr("minute div period_min")).where("bucket < buckets").groupBy(key, "period_min", "bucket").agg(F.sum("n").alias("n"))
    series = matched(cells, counts, [key, "period_min", "bucket"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("double"))
    return autocorrelation(series, [key, "period_min"], "bucket", "n")


def intervals(events: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Seconds between an event and the one before it under its key."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return previous_time(events, key, ts, [order], "_previous").withColumn("interval_s", (us(ts) - us("_previous")) / float(MICRO)).drop("_previous")


def coordination(events: DataFrame, key: str, ts: str, order: str, min_events: int = 5) -> DataFrame:
    """Score 1 / (1 + variance of the intervals); coordinated from .6 on."""
    per = intervals(events, key, ts, order).groupBy(key).agg(F.count("*").alias("n"), F.var_pop("interval_s").alias("variance")).where(F.col("n") >= min_events)
    return per.withColumn("score", 1 / (1 + F.coalesce("variance", F.lit(0.0)))).withColumn("is_coordinated", F.col("score") >= 0.6)


def periodic_patterns(events: DataFrame, key: str, ts: str, low_min: int, high_min: int, threshold: float = 0.7, min_events: int = 5) -> DataFrame:
    """(key, period_min, correlation, is_periodic, frequency, severity): keys of at least twice ``min_events`` events; frequency is events an hour."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    span = events.groupBy(key).agg(F.count("*").alias("_n"), ((F.max(us) - F.min(us)) / (3600.0 * MICRO)).alias("_hours")).where(F.col("_n") >= 2 * min_events)
    out = matched(periods(events, key, ts, low_min, high_min), span, [key])
    return out.select(key, "period_min", "correlation", (F.col("correlation") > threshold).alias("is_periodic"), F.try_divide(F.col("_n"), F.col("_hours")).alias("frequency"), severity(F.col("correlation"), F.col("_n")).alias("severity"))


def enriched(events: DataFrame, key: str, ts: str, account: str, cluster: str, window_s: int = 300) -> DataFrame:
    """What a pattern is described by: peak, mean and deviation of the rates, account diversity, accounts, clusters, and events by hour of the day."""
    rates = sliding_rates(events, key, ts, window_s).groupBy(key).agg(F.coalesce(F.max("rate"), F.lit(0.0)).alias("peak_intensity"), F.avg("rate").alias("average_intensity"), F.stddev_pop("rate").alias("variability"))
    accounts = events.groupBy(key, account).agg(F.count("*").alias("_n")).groupBy(key).agg(F.count(account).alias("accounts"), F.sum("_n").alias("events")).withColumn("account_diversity", F.col("accounts") / F.col("events"))
    clusters = events.where(F.coalesce(F.col(cluster).cast("string"), F.lit("")) != "").select(key, cluster).distinct().groupBy(key).agg(F.count("*").alias("clusters"))
    hours = events.groupBy(key, F.coalesce(F.date_format(ts, "HH"), F.lit("none")).alias("_h")).agg(F.count("*").alias("_n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_h", "_n")))).alias("by_hour"))  # 24 rows a key
    return matched(matched(matched(accounts, rates, [key], "left"), clusters, [key], "left"), hours, [key]).withColumn("clusters", F.coalesce("clusters", F.lit(0)))


def without_old(patterns: DataFrame, end: str, as_of: str, max_age_hours: int) -> DataFrame:
    """Patterns that ended ``max_age_hours`` before ``as_of`` or later."""
    return patterns.where(F.col(end) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(hours=F.lit(max_age_hours)))


def rate_baseline(events: DataFrame, key: str, ts: str, order: str, min_events: int = 10, alpha: float = 0.1) -> DataFrame:
    """(key, average, highest, lowest): after ``min_events`` events, the count of the last hour at each event, smoothed by ``alpha`` from the first one on.

    Events without a time have no last hour and are left out; a key of none but those has no row.
    The smoothed value is a sum weighted by powers of 1 - alpha, so there is no state.
    An event's last hour lies in its own hour of the clock and the one before: each
    row is sent to its own and the next one, where a window counts.
    """
    timed = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.col(ts).alias("ts"), F.col(order).alias("order"))
    numbered = ranked(timed, "key", "ts", ["order"]).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("hour", F.expr(f"us div {3600 * MICRO}L"))
    both = numbered.withColumn("own", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("hour", F.when(F.col("own"), F.col("hour")).otherwise(F.col("hour") + 1))
    inside = Window.partitionBy("key", "hour")
    nth, older = F.row_number().over(inside.orderBy("us", "k")), F.count("*").over(inside.orderBy("us").rangeBetween(Window.unboundedPreceding, -3600 * MICRO))
    rates = both.select("key", "k", "own", (nth - older).cast("double").alias("rate")).where("own").where(F.col("k") >= min_events)
    total = numbered.groupBy("key").agg(F.max("k").alias("n"))
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("k")) * F.when(F.col("k") == min_events, 1.0).otherwise(alpha)
    found = matched(rates, total, ["key"]).groupBy("key").agg(F.sum(F.col("rate") * weight).alias("average"), F.max("rate").alias("highest"), F.min("rate").alias("lowest"))
    filled = matched(total.select("key"), found, ["key"], "left").na.fill(0.0, ["average", "highest", "lowest"])
    return filled.withColumnRenamed("key", key)


def hourly(events: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, hour, n): a row for each hour (number since the epoch) from a key's first to its last one, empty ones with 0."""
    hours = events.where(F.col(ts).isNotNull()).select(F.col(key).alias("key"), F.expr(f"unix_micros(cast(`{ts}` AS timestamp)) div {3600 * MICRO}L").alias("hour"))
    counts = hours.groupBy("key", "hour").agg(F.count("*").alias("n"))
    grid = counts.groupBy("key").agg(F.min("hour").alias("first"), F.max("hour").alias("last")).select("key", F.explode(F.sequence("first", "last")).alias("hour"))
    return matched(grid, counts, ["key", "hour"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def ramps(events: DataFrame, key: str, ts: str, slack: float = 0.5, limit: float = 5.0) -> DataFrame:
    """(key, direction, start_hour, alarm_hour, peak): keys whose hourly counts have risen ("up") or fallen ("down") gradually.

    A cumulative sum adds up how far each hour is above (below) the key's mean by more than
    ``slack`` deviations, and starts again at 0 where it would be negative.  The
    first hour in which it is over ``limit`` deviations is the alarm; the ramp began after the last 0
    before it; ``peak`` is the largest sum, in deviations.  Keys of one rate have no ramp.

    Such a sum is the plain running sum less its least value so far (0 at most), so it is two
    window aggregates over one row a key and hour, and no loop.
    """
    hours = hourly(events, key, ts)
    stats = hours.groupBy("key").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sigma")).where("sigma > 0")
    way = F.explode(F.array(F.struct(F.lit("up").alias("direction"), F.lit(1).alias("sign")), F.struct(F.lit("down").alias("direction"), F.lit(-1).alias("sign"))))
    both = matched(hours, stats, ["key"]).withColumn("way", way).select("key", "hour", "sigma", "way.direction", (F.col("way.sign") * (F.col("n") - F.col("mean")) - slack * F.col("sigma")).alias("d"))
    series = Window.partitionBy("key", "direction").orderBy("hour")
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    summed = both.withColumn("sum", F.sum("d").over(so_far))
    summed = summed.withColumn("s", F.col("sum") - F.least(F.lit(0.0), F.min("sum").over(so_far)))
    summed = summed.withColumn("zero", F.last(F.when(F.col("s") == 0, F.col("hour")), ignorenulls=True).over(so_far)).withColumn("first", F.first("hour").over(so_far))
    alarm = F.when(F.col("s") > limit * F.col("sigma"), F.struct("hour", F.coalesce(F.col("zero") + 1, F.col("first")).alias("start")))
    found = summed.withColumn("alarm", alarm).groupBy("key", "direction").agg(F.min("alarm").alias("alarm"), (F.max("s") / F.first("sigma")).alias("peak")).where("alarm IS NOT NULL")
    return found.select(F.col("key").alias(key), "direction", F.col("alarm.start").alias("start_hour"), F.col("alarm.hour").alias("alarm_hour"), "peak")


def flash_mobs(events: DataFrame, key: str, ts: str, account: str, sigmas: float = 2.0, min_accounts: int = 5) -> DataFrame:
    """(key, start_hour, end_hour, n_events, accounts, new_accounts, is_flash_mob) of every burst: neighbouring hours of a key with more than ``sigmas`` deviations over its mean.

    A burst is a flash mob if it has ``min_accounts`` accounts at least and all of them were first
    seen inside it, over the events of all keys.  Events without an account count as events alone.
    """
    hours = hourly(events, key, ts)
    stats = hours.groupBy("key").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("sigma"))
    hot = matched(hours, stats, ["key"]).where(F.col("n") > F.col("mean") + sigmas * F.col("sigma")).select("key", "hour", "n")
    island = F.col("hour") - F.row_number().over(Window.partitionBy("key").orderBy("hour"))
    hot = hot.withColumn("island", island)
    bursts_ = hot.groupBy("key", "island").agg(F.min("hour").alias("start_hour"), F.max("hour").alias("end_hour"), F.sum("n").alias("n_events"))
    seen = events.where(F.col(ts).isNotNull() & F.col(account).isNotNull()).select(F.col(key).alias("key"), F.expr(f"unix_micros(cast(`{ts}` AS timestamp)) div {3600 * MICRO}L").alias("hour"), F.col(account).alias("account")).distinct()
    first = seen.groupBy("account").agg(F.min("hour").alias("first"))
    inside = matched(seen, hot.select("key", "hour", "island"), ["key", "hour"]).select("key", "island", "account").distinct().join(first, "account")
    placed = matched(inside, bursts_.select("key", "island", "start_hour"), ["key", "island"])
    crowd = placed.groupBy("key", "island").agg(F.count("*").alias("accounts"), F.count_if(F.col("first") >= F.col("start_hour")).alias("new_accounts"))
    out = matched(bursts_, crowd, ["key", "island"], "left").na.fill(0, ["accounts", "new_accounts"])
    return out.select(F.col("key").alias(key), "start_hour", "end_hour", "n_events", "accounts", "new_accounts", ((F.col("accounts") >= min_accounts) & (F.col("accounts") == F.col("new_accounts"))).alias("is_flash_mob"))
