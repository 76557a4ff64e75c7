"""Reputation: factors, events, the ordered fold, decay and trend."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.functions.scores import decayed
from swarmlens.operators.ordering import ranked

INITIAL, RATE, MAX_DAYS, HISTORY, SPAM, TRUSTED = 0.5, 0.1, 30, 100, 0.3, 0.7


def account_factors(accounts: DataFrame) -> DataFrame:
    """(id, factor, impact) of every factor that applies; spam activity where the column spam_tweet_count is there (and there are posts)."""
    c, ratio = F.col, F.try_divide(F.col("followers_count").cast("double"), F.col("following_count").cast("double"))
    filled = sum((F.when(F.coalesce(x, F.lit("")) != "", 0.25).otherwise(0.0) for x in ("bio", "location", "website", "profile_image_url")), F.lit(0.0))
    values = {
        "account_age": F.when(c("account_age_days") > 0, F.least(F.lit(1.0), c("account_age_days") / 365.0) * 0.2),
        "follower_ratio": F.when(ratio > 10, 0.1).when(ratio < 0.1, -0.2),
        "profile_completeness": (filled - 0.5) * 0.1,
        "verification": F.when(c("is_verified"), 0.3),
        "bot_score": c("bot_score") * -0.4,
    }
    if "spam_tweet_count" in accounts.columns:
        values["spam_activity"] = F.when(c("spam_tweet_count") > 0, F.try_divide(c("spam_tweet_count").cast("double"), c("tweet_count").cast("double")) * -0.5)
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), (F.round(v, 9) + 0.0).alias("impact")) for n, v in values.items()])  # no negative zero
    return accounts.select("id", F.explode(pairs).alias("f")).select("id", "f.factor", "f.impact").where("impact IS NOT NULL")


def content_factors(posts: DataFrame) -> DataFrame:
    """(id, factor, impact) of posts with spam_score (null: clean), is_coordinated and confidence of their cluster."""
    c = F.col
    engagement = c("retweet_count") + c("like_count") + c("reply_count")
    values = {
        "spam_detected": F.when(c("spam_score").isNotNull(), -c("spam_score")),
        "legitimate_content": F.when(c("spam_score").isNull(), 0.1),
        "engagement": F.when(engagement > 0, F.least(F.lit(1.0), engagement / 100.0) * 0.2),
        "coordinated_behavior": F.when(c("is_coordinated"), -0.4),
        "high_confidence_spam": F.when(c("confidence") > 0.8, c("confidence") * -0.3),
        "excessive_urls": F.when(F.size("urls") > 3, -0.1),
        "excessive_mentions": F.when(F.size("mentions") > 10, -0.1),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("factor"), F.round(v.cast("double"), 9).alias("impact")) for n, v in values.items()])
    return posts.select("id", F.explode(pairs).alias("f")).select("id", "f.factor", "f.impact").where("impact IS NOT NULL")


def events_of(factors: DataFrame, confidence: float) -> DataFrame:
    """Events of the factors that matter, with their type."""
    kind = F.when(F.col("factor").isin("spam_detected", "high_confidence_spam", "spam_activity"), "spam_detected").when(F.col("factor") == "legitimate_content", "legitimate_content").when(F.col("factor") == "coordinated_behavior", "coordinated_behavior").when(F.col("factor") == "bot_score", "suspicious_pattern").when(F.col("factor") == "verification", "verification_passed").otherwise("automatic_flag")
    return factors.where(F.abs("impact") > 0.01).withColumn("event_type", kind).withColumn("confidence", F.lit(confidence))


def indirect_events(posts: DataFrame) -> DataFrame:
    """(id, ts, factor, impact, confidence) for the author of each post (author_id, created_at, spam_score or null)."""
    impact = F.when(F.col("spam_score").isNotNull(), F.col("spam_score") * -0.3).otherwise(0.05)
    kind = F.when(F.col("spam_score").isNotNull(), "spam_detected").otherwise("legitimate_content")
    return posts.select(F.col("author_id").alias("id"), F.col("created_at").alias("ts"), F.concat_ws("-", kind, F.col("id").cast("string")).alias("factor"), impact.alias("impact"), F.lit(0.7).alias("confidence"))


#: Events that are folded into one step, and the step's first value: a * x + b held to [low, high].
CHUNK = 1000
_SAME = "named_struct('a', 1.0D, 'b', 0.0D, 'low', 0.0D, 'high', 1.0D)"


def _after(first: Column, a: Column, b: Column, low: Column, high: Column) -> Column:
    """The step that does ``first`` and then a * x + b held to [low, high]; such steps compose to one of their kind, as a >= 0."""
    held = lambda x: F.greatest(low, F.least(high, a * x + b))
    return F.struct((a * first["a"]).alias("a"), (a * first["b"] + b).alias("b"), held(first["low"]).alias("low"), held(first["high"]).alias("high"))


def fold(events: DataFrame) -> DataFrame:
    """(id, score, effective_weight, n): events (id, ts, factor, impact, confidence) applied in order of time, then factor.

    Events without a time have no age and are left out; a null id is an entity like any other.
    Every update lets the score decay from a day on, appends, and adds the weighted mean
    of the last hundred events of at most thirty days; the score is held to [0, 1].
    One update is a * x + b held to a range, and so is any number of them in a row:
    chunks of a thousand events are composed side by side, then a chunk's step is one
    row.  A chunk gets the hundred events before it along.
    """
    names = ["factor", "impact", "confidence"]
    e = ranked(events.where("ts IS NOT NULL").select("id", "ts", *names), "id", "ts", names).withColumn("h", F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9)
    e = e.withColumn("own", F.floor((F.col("k") - 1) / CHUNK))
    at = F.when(F.pmod(F.col("k") - 1, F.lit(CHUNK)) >= CHUNK - HISTORY, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))
    both = e.withColumn("chunk", F.explode(at))
    order = Window.partitionBy("id", "chunk").orderBy("k")
    seen = F.collect_list(F.struct("h", "impact", "confidence")).over(order.rowsBetween(1 - HISTORY, 0))
    both = both.withColumn("seen", seen).withColumn("days", (F.col("h") - F.lag("h").over(order)) / 24).where("chunk = own")
    young = F.transform(F.filter("seen", lambda x: F.col("h") - x["h"] <= MAX_DAYS * 24), lambda x: F.struct((F.exp(-(F.col("h") - x["h"]) / 168) * x["confidence"]).alias("w"), x["impact"].alias("impact")))
    both = both.withColumn("young", young).withColumn("w", F.aggregate("young", F.lit(0.0), lambda s, x: s + x["w"])).withColumn("wi", F.aggregate("young", F.lit(0.0), lambda s, x: s + x["w"] * x["impact"]))
    kept = F.when(F.col("days") >= 1, F.exp(-RATE * F.col("days"))).otherwise(1.0)
    steps = both.select("id", "chunk", "k", "w", kept.alias("kept"), F.when(F.col("w") > 0, F.col("wi") / F.col("w")).otherwise(0.0).alias("mean"))
    zero, one = F.lit(0.0), F.lit(1.0)
    # in two lambdas: what is composed first is read at several places
    composed = F.aggregate(F.array_sort(F.collect_list(F.struct("k", "kept", "mean"))), F.expr(_SAME), lambda s, x: _after(_after(s, x["kept"], INITIAL * (1 - x["kept"]), zero, one), one, x["mean"], zero, one))
    chunks = steps.groupBy("id", "chunk").agg(composed.alias("step"), F.max_by("w", "k").alias("w"), F.count("*").alias("n"))  # at most CHUNK rows each
    run = F.aggregate(F.array_sort(F.collect_list(F.struct("chunk", "step"))), F.lit(INITIAL), lambda x, c: F.greatest(c["step"]["low"], F.least(c["step"]["high"], c["step"]["a"] * x + c["step"]["b"])))
    return chunks.groupBy("id").agg(F.round(run, 9).alias("score"), F.round(F.max_by("w", "chunk"), 9).alias("effective_weight"), F.sum("n").alias("n"))  # a row for each thousand events


def statistics(scores: DataFrame) -> DataFrame:
    """One row over (entity_type, score, confidence)."""
    kind, s = F.col("entity_type"), F.col("score")
    return scores.agg(F.count("*").alias("n"), F.count_if(kind == "account").alias("accounts"), F.count_if(kind == "content").alias("contents"), F.count_if(s < SPAM).alias("spammy"), F.count_if(s > TRUSTED).alias("trusted"), F.round(F.avg("score"), 9).alias("avg_score"), F.round(F.avg("confidence"), 9).alias("avg_confidence"))


def maintained(scores: DataFrame, as_of: str) -> DataFrame:
    """``scores`` (id, score, confidence, last_update) as of a time: decayed from a day on; those idle for twice the longest age and hardly sure are dropped."""
    age = (F.unix_micros(F.to_timestamp(F.lit(as_of))) - F.unix_micros(F.col("last_update").cast("timestamp"))) / (24 * 3.6e9)
    aged = scores.withColumn("_age", age).where(~((F.col("_age") > 2 * MAX_DAYS) & (F.col("confidence") < 0.1)))
    return aged.withColumn("score", F.when(F.col("_age") >= 1, decayed(F.col("score"), F.col("_age"), RATE, INITIAL)).otherwise(F.col("score"))).drop("_age")


class Store:
    """Reputation scores as a table in buckets by id: a batch of ids reads the buckets it needs.

    A change is written as files of its own, and then becomes the store by one small file
    that names, for each bucket, the change that it was last written by.  Files of that
    kind are numbered and never overwritten: a reader takes the latest, so a
    change that breaks off leaves the store as it was, and two writers of one number
    cannot both succeed.  A change reads and writes its own buckets alone.
    """

    BUCKETS = 64

    def __init__(self, path: str):
        self.path = path

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(self.BUCKETS)).cast("int"))

    def _files(self, spark):
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return place, place.getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self, spark) -> tuple[int, dict[int, str]]:
        """The latest version's number and the folder of each bucket; -1 and nothing where there is none."""
        place, files = self._files(spark)
        numbers = [int(f.getPath().getName()[1:]) for f in files.listStatus(place) if f.getPath().getName().startswith("v")] if files.exists(place) else []
        if not numbers:
            return -1, {}
        line = spark.read.text(f"{self.path}/versions/v{max(numbers)}").first()[0]
        return max(numbers), {int(k): v for k, v in json.loads(line).items()}

    def _publish(self, spark, number: int, buckets: dict[int, str]) -> None:
        place, files = self._files(spark)
        files.mkdirs(place)
        draft = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/.draft-{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(json.dumps(buckets).encode())
        out.close()
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/v{number}")
        if files.exists(target) or not files.rename(draft, target):
            files.delete(draft, False)
            raise RuntimeError(f"version {number} was written by another")

    def _read(self, spark, buckets: dict[int, str]) -> DataFrame | None:
        folders = [f"{self.path}/data/{change}/bucket={b}" for b, change in buckets.items()]
        return spark.read.parquet(*folders) if folders else None

    def _change(self, spark, rows: DataFrame, touched: list[int], was: tuple[int, dict[int, str]]) -> None:
        """``rows`` (with bucket) become the whole of the touched buckets."""
        change = uuid.uuid4().hex
        written_ = f"{self.path}/data/{change}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(written_)
        number, before = was
        there = {r["bucket"] for r in rows.select("bucket").distinct().collect()}  # at most BUCKETS numbers
        self._publish(spark, number + 1, {b: c for b, c in before.items() if b not in touched} | {b: change for b in there})

    def _buckets_of(self, ids: DataFrame) -> list[int]:
        return sorted(r["bucket"] for r in ids.select("bucket").distinct().collect())

    def save(self, scores: DataFrame) -> None:
        """Scores (id, ...) become the store, whole."""
        spark, placed = scores.sparkSession, self._placed(scores)
        was = self.version(spark)
        self._change(spark, placed, list(was[1]), was)

    def merge(self, scores: DataFrame) -> None:
        """Scores (id, ...) replace those of their ids; all others stay."""
        spark, placed = scores.sparkSession, self._placed(scores)
        was, touched = self.version(spark), self._buckets_of(placed)
        old = self._read(spark, {b: c for b, c in was[1].items() if b in touched})
        rows = placed if old is None else placed.unionByName(self._placed(old.join(scores.select("id"), "id", "left_anti")))
        self._change(spark, rows, touched, was)

    def load(self, spark) -> DataFrame:
        return self._read(spark, self.version(spark)[1])

    def load_batch(self, ids: DataFrame) -> DataFrame:
        """The scores of some ids (id), out of their buckets."""
        wanted, (_, buckets) = self._placed(ids.select("id").distinct()), self.version(ids.sparkSession)
        touched = self._buckets_of(wanted)
        found = self._read(ids.sparkSession, {b: c for b, c in buckets.items() if b in touched})
        return (self.load(ids.sparkSession).limit(0) if found is None else found).join(wanted.select("id"), "id", "left_semi")

    def delete(self, ids: DataFrame) -> None:
        """Takes some ids out of their buckets."""
        spark, wanted = ids.sparkSession, self._placed(ids.select("id").distinct())
        was, touched = self.version(spark), self._buckets_of(wanted)
        old = self._read(spark, {b: c for b, c in was[1].items() if b in touched})
        if old is not None:
            self._change(spark, self._placed(old.join(wanted.select("id"), "id", "left_anti")), touched, was)


def batch_reputation(known: DataFrame, store: Store, ids: DataFrame, as_of: str) -> DataFrame:
    """Scores of ``ids`` as of a time: those that are known, else those of the store."""
    columns = ["id", "score", "confidence", "last_update"]
    found = known.select(columns).join(ids, "id", "left_semi")
    missing = ids.join(known.select("id"), "id", "left_anti")
    return maintained(found.unionByName(store.load_batch(missing).select(columns)), as_of)


def trend(events: DataFrame, key: str, ts: str, value: str, order: str) -> DataFrame:
    """Slope, volatility and verdict of each key's last ten values (three at least)."""
    back = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(order))
    last = events.withColumn("_b", F.row_number().over(back)).where("_b <= 10")
    per = last.groupBy(key).agg(F.regr_slope(F.col(value), -F.col("_b").cast("double")).alias("slope"), F.stddev_pop(value).alias("volatility"), F.count("*").alias("n")).where("n >= 3")
    verdict = F.when(F.col("volatility") > 0.5, "volatile").when(F.abs("slope") < 0.01, "stable").when(F.col("slope") > 0, "improving").otherwise("deteriorating")
    return per.select(key, F.round("slope", 6).alias("slope"), F.round("volatility", 6).alias("volatility"), verdict.alias("trend"))
