"""Alert rules, throttling, histograms, health and text exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions.names import matched
from swarmlens.functions.scores import compare
from swarmlens.operators.graphs import written
from swarmlens.operators.ordering import filled_forward, ranked

MOST_RULES = 10_000


def matches(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Long facts (entity, metric, value) against rules (rule, metric, operator, threshold): an equi-join on the metric; rules are few, and that is checked."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        return facts.join(rules, "metric").where(compare(F.col("value"), F.col("operator"), F.col("threshold")))
    return facts.join(F.broadcast(rules), "metric").where(compare(F.col("value"), F.col("operator"), F.col("threshold")))


def _next_window(numbered: DataFrame, window_s: int) -> DataFrame:
    """(rule, k, next): the first alert later than a window after alert k; null if there is none.

    An alert asks in the stretch of a window's length after its own, where its window
    ends: alerts and questions are sorted together there.  Where none follows in that
    stretch, the rule's next stretch with alerts begins with the answer.
    """
    w = window_s * 1_000_000
    timed = numbered.where("ts IS NOT NULL").select("rule", "k", F.unix_micros("ts").alias("us"))
    here = timed.select("rule", F.expr(f"us div {w}L").alias("cell"), "us", F.lit(0).alias("asks"), "k")
    asked = timed.select("rule", F.expr(f"(us + {w}L) div {w}L").alias("cell"), (F.col("us") + w).alias("us"), F.lit(1).alias("asks"), "k")
    after = Window.partitionBy("rule", "cell").orderBy("us", "asks", "k").rowsBetween(1, Window.unboundedFollowing)
    both = here.union(asked).withColumn("next", F.first(F.when(F.col("asks") == 0, F.col("k")), ignorenulls=True).over(after))
    cells = both.groupBy("rule", "cell").agg(F.min(F.when(F.col("asks") == 0, F.col("k"))).alias("first"))
    later = Window.partitionBy("rule").orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    later = cells.select("rule", "cell", F.first("first", ignorenulls=True).over(later).alias("later"))  # one row a cell
    return matched(both.where("asks = 1"), later, ["rule", "cell"]).select("rule", "k", F.coalesce("next", "later").alias("next"))


def _openers(pointers: DataFrame) -> DataFrame:
    """(rule, k): the alerts that open a window: the first of each rule, and all that its pointers lead to, by doubling the pointers."""
    reached = written(pointers.groupBy("rule").agg(F.min("k").alias("k")))
    jumps = written(pointers.where("next IS NOT NULL"))
    while not jumps.isEmpty():
        led = matched(reached, jumps, ["rule", "k"]).select("rule", F.col("next").alias("k"))
        reached = written(reached.union(led))  # a jump of 2^i leads from the first 2^i openers to the next ones, so no opener comes twice
        onward = jumps.select("rule", F.col("k").alias("next"), F.col("next").alias("far"))
        jumps = written(matched(jumps, onward, ["rule", "next"]).select("rule", "k", F.col("far").alias("next")))
    return reached


def throttled(alerts: DataFrame, window_s: int = 300, most: int = 3) -> DataFrame:
    """(rule, ts, id, passed): a window opens at a rule's first alert, lets the first ``most`` pass, and opens anew with the first alert after its end.

    Each alert points to the one that would open the next window if it opened one itself;
    the openers are found by doubling these pointers, in as many rounds as the number of a
    rule's windows has bits, so no rule and no stretch of alerts is folded in one task.

    A null rule is a rule like any other; alerts without a time belong to their rule's last window.
    """
    numbered = written(ranked(alerts.select("rule", "ts", "id"), "rule", "ts", ["id"]))
    pointers = matched(numbered.select("rule", "k"), _next_window(numbered, window_s), ["rule", "k"], "left").select("rule", "k", "next")
    opened = matched(numbered, _openers(pointers).withColumn("opener", F.col("k")), ["rule", "k"], "left")
    filled = filled_forward(opened, "rule", "ts", ["id"], F.col("opener"), "opener")
    return filled.select("rule", "ts", "id", (F.col("k") - F.col("opener") < most).alias("passed"))


#: Metrics a rule of each kind can read, and the rule (metric, least value) where it names another one.
KINDS = {"cluster": (("cluster_size", "confidence", "unique_accounts", "tweets_per_minute"), ("cluster_size", 3.0)), "pattern": (("confidence", "event_count", "frequency"), ("confidence", 0.8)), "metric": ((), None)}


def checked(rules: DataFrame, channels: list[str]) -> DataFrame:
    """``rules`` (rule, channels) with ``fault``: null, or why a rule may not be used: no name, no channel, or a channel that is not known."""
    unknown = F.filter("channels", lambda c: ~c.isin(channels))
    fault = F.when(F.coalesce("rule", F.lit("")) == "", "no name").when(F.coalesce(F.size("channels"), F.lit(0)) <= 0, "no channel").when(F.size(unknown) > 0, F.concat(F.lit("unknown channel: "), F.get(unknown, 0)))
    return rules.withColumn("fault", fault)


def evaluated(facts: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """``matches`` of one kind of facts; a rule that names a metric of another kind falls back to the kind's own condition."""
    known, fallback = KINDS[kind]
    if fallback is None:
        return matches(facts, rules)
    own = F.col("metric").isin(list(known))
    metric, least = fallback
    rules = rules.select("rule", F.when(own, F.col("metric")).otherwise(metric).alias("metric"), F.when(own, F.col("operator")).otherwise("gte").alias("operator"), F.when(own, F.col("threshold")).otherwise(least).alias("threshold"))
    return matches(facts, rules)


def history(alerts: DataFrame, most: int = 1000) -> DataFrame:
    """The last ``most`` alerts (ts, id); the feature is the limit."""
    return alerts.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def fanned_out(alerts: DataFrame, rules: DataFrame) -> DataFrame:
    """A row for each alert (rule) and channel of its rule (rule, channels)."""
    return alerts.join(rules.select("rule", F.explode("channels").alias("channel")), "rule")


#: How a metric condition sums a stretch of time up.
AGGREGATIONS = {"sum": F.sum, "avg": F.avg, "max": F.max, "min": F.min, "count": F.count}


def aggregated(events: DataFrame, ts: str, value: str, aggregation: str, duration: str) -> DataFrame:
    """(start, value) of each stretch of ``duration``; ``rate`` is the count a second."""
    if aggregation != "rate" and aggregation not in AGGREGATIONS:
        raise ValueError(f"unknown aggregation {aggregation!r}")
    w = F.window(ts, duration)
    if aggregation == "rate":
        seconds = (F.unix_micros("w.end") - F.unix_micros("w.start")) / 1e6
        return events.groupBy(w.alias("w")).agg(F.count(value).alias("n")).select(F.col("w.start").alias("start"), (F.col("n") / seconds).alias("value"))
    return events.groupBy(w.alias("w")).agg(AGGREGATIONS[aggregation](value).cast("double").alias("value")).select(F.col("w.start").alias("start"), "value")


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """(le, n): cumulative counts for each bound, in one aggregate."""
    counts = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)])).alias("h")).select("h.le", "h.n")


def prometheus(metrics: DataFrame) -> DataFrame:
    """(line) of (name, labels map, value)."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), labels, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def records(fired: DataFrame, title: str, entity: str) -> DataFrame:
    """``fired`` (entity, rule, severity, size, confidence) as alerts: title, message, severity, status and metadata."""
    message = F.format_string(f"{title} %s: %d posts, confidence %.2f", F.col(entity).cast("string"), "size", F.round("confidence", 2))
    metadata = F.create_map(F.lit(entity), F.col(entity).cast("string"), F.lit("rule"), F.col("rule"), F.lit("size"), F.col("size").cast("string"))
    return fired.select(entity, "rule", F.concat(F.lit(f"{title}: "), "rule").alias("title"), message.alias("message"), "severity", F.lit("active").alias("status"), metadata.alias("metadata"))


def escalations(alerts: DataFrame, levels: list[tuple[int, int]], as_of: str) -> DataFrame:
    """(id, level): every level (number, seconds) that an open alert (id, ts, acknowledged_at) reached before it was acknowledged, up to ``as_of``."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), F.lit(s).cast("bigint").alias("after_s")) for n, s in levels]))
    due = F.unix_micros(F.col("ts").cast("timestamp")) + F.col("l.after_s") * 1_000_000
    until = F.coalesce(F.unix_micros(F.col("acknowledged_at").cast("timestamp")), F.unix_micros(F.to_timestamp(F.lit(as_of))))
    return alerts.withColumn("l", each).where(due <= F.least(until, F.unix_micros(F.to_timestamp(F.lit(as_of))))).select("id", F.col("l.level").alias("level"))


def prometheus_histogram(df: DataFrame, name: str, value: str, bounds: list[float]) -> DataFrame:
    """(line) of a histogram: its type, cumulative buckets, sum and count."""
    row = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.coalesce(F.round(F.sum(value), 2), F.lit(0.0)).alias("s"), F.count(value).alias("n"))
    lines = [F.lit(f"# TYPE {name} histogram"), *[F.concat(F.lit(f'{name}_bucket{{le="{b:.2f}"}} '), F.col(f"b{i}").cast("string")) for i, b in enumerate(bounds)], F.format_string(f"{name}_sum %.2f", "s"), F.concat(F.lit(f"{name}_count "), F.col("n").cast("string"))]
    return row.select(F.explode(F.array(*lines)).alias("line"))


def pattern_records(patterns: DataFrame, entity: str, kind: str) -> DataFrame:
    """Patterns (entity, event_count, confidence, frequency) as alerts."""
    message = F.format_string(f"A {kind} pattern of %d events, confidence %.2f, %.2f events an hour", "event_count", F.round("confidence", 2), F.round("frequency", 2))
    metadata = F.create_map(F.lit("pattern"), F.col(entity).cast("string"), F.lit("event_count"), F.col("event_count").cast("string"))
    return patterns.select(entity, F.concat(F.lit("Temporal pattern: "), F.col(entity).cast("string")).alias("title"), message.alias("message"), F.lit("active").alias("status"), metadata.alias("metadata"))


def metric_records(values: DataFrame, entity: str, metric: str, threshold: float) -> DataFrame:
    """Metric values (entity, value) over a threshold as alerts."""
    message = F.format_string(f"Metric {metric} has reached %.2f, over the threshold of {threshold:.2f}", F.round("value", 2))
    return values.select(entity, F.lit(f"Metric threshold exceeded: {metric}").alias("title"), message.alias("message"), F.lit("active").alias("status"))


def builtin(clusters: DataFrame, rate: DataFrame, size: int = 10, confidence: float = 0.8, spam_rate: float = 0.5) -> DataFrame:
    """(source, name, value, fires) of the engine's own alerts: each cluster, and the spam rate (one row)."""
    one = clusters.select(F.lit("cluster").alias("source"), F.col("cluster_id").cast("string").alias("name"), F.col("confidence").alias("value"), ((F.col("size") > size) & (F.col("confidence") > confidence)).alias("fires"))
    return one.union(rate.select(F.lit("spam_rate"), F.lit("all"), F.round("rate", 9), F.coalesce(F.col("rate") > spam_rate, F.lit(False))))
