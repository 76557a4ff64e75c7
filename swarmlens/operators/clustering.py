"""Clusters of near duplicates that grow batch by batch: an index of buckets, and a union of components on disk.

A batch's texts meet the buckets they fall into, and each other; links join the labels
of components.  ``labels`` holds each id's label as its batch left it, ``merges`` which
label has gone into which: labels are only ever joined, so both are written once, in
batches and slots as the index's tables are, and a label's present name is found by
following merges, each time out of the slots of the labels still on their way.  Labels
found over more than one step are written again as one, which keeps the ways short.

After any number of batches ``clusters`` equals the connected components of all texts
linked in one run.  A component's name is its least id.

A text that is there already, or comes several times, is one text: its copies join the
id it was first kept under, by its digest, and are not indexed.  A text that is null has a component of its own, as
one without words to hash; rows without an id are left out; an id that comes again is the same post and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmlens.operators.graphs import connected_components, ready, written
from swarmlens.operators.index import SignatureIndex

TABLES = {"labels": "id bigint, label bigint, batch bigint, slot int", "merges": "label bigint, into bigint, batch bigint, slot int", "texts": "digest binary, id bigint, batch bigint, slot int"}


class Clusters:
    def __init__(self, spark: SparkSession, path: str, hashes: int = 128, bands: int = 16, threshold: float = 0.7, slots: int | None = None):
        ready(spark)
        self.spark, self.path, self.threshold = spark, path, threshold
        self.index = SignatureIndex(spark, f"{path}/index", hashes, bands, slots)

    def _table(self, name: str, before: int | None = None, slots: list[int] | None = None) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], TABLES[name])
        df = self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}")
        df = df if before is None else df.where(F.col("batch") < before)
        return df if slots is None else df.where(F.col("slot").isin(slots))

    def _write(self, df: DataFrame, name: str, batch: int, key: str) -> None:
        df.withColumn("slot", self.index._slot(key)).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/{name}/batch={batch}")

    def _found(self, labels: DataFrame, before: int | None = None) -> DataFrame:
        """(label, now, steps) of some labels (label), each once."""
        way = written(labels.select("label").distinct().select("label", F.col("label").alias("now"), F.lit(0).alias("steps"), F.lit(True).alias("open")))
        while True:
            on = way.where("open")
            slots = self.index.slots_of(on, "now")
            if not slots:
                return way.drop("open")
            last = self._table("merges", before, slots).groupBy(F.col("label").alias("now")).agg(F.max_by("into", "batch").alias("into"))
            moved = on.join(last, "now", "left").select("label", F.coalesce("into", "now").alias("now"), (F.col("steps") + F.col("into").isNotNull().cast("int")).alias("steps"), F.col("into").isNotNull().alias("open"))
            way = written(way.where("NOT open").union(moved))

    def add(self, posts: DataFrame, batch: int) -> None:
        """Posts (id, text) under a batch number greater than all before, or the last one again."""
        posts = written(posts.where("id IS NOT NULL").select("id", "text").groupBy("id").agg(F.max("text").alias("text")))
        known = self._table("labels", batch, self.index.slots_of(posts, "id")).select("id")
        posts = written(posts.join(known, "id", "left_anti").withColumn("digest", F.unhex(F.md5("text"))))
        texts = posts.where("text IS NOT NULL")
        first = texts.groupBy("digest").agg(F.min("id").alias("id"))
        kept = self._table("texts", batch, self.index.slots_of(first, "digest")).select("digest", F.col("id").alias("kept"))
        placed = written(first.join(kept, "digest", "left"))
        copies = texts.join(placed.select("digest", F.coalesce("kept", "id").alias("rep")), "digest").select(F.col("id").alias("a"), F.col("rep").alias("b"))
        new = placed.where("kept IS NULL").select("digest", "id")
        self._write(new, "texts", batch, "digest")
        signatures = self.index.add(texts.join(new, ["digest", "id"], "left_semi").select("id", "text"), batch)
        near = self.index.similar(signatures, self.threshold).select("a", "b")
        links = written(near.union(copies).where("a <> b").distinct())
        # the old ends of links, by their present labels
        ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        old = written(self._table("labels", batch, self.index.slots_of(ends, "id")).join(ends, "id", "left_semi").select("id", "label"))
        found = written(old.join(self._found(old, batch), "label").select("id", "label", "now", "steps"))
        name = lambda c: found.select(F.col("id").alias(c), F.col("now").alias(f"of_{c}"))
        joined = links.join(name("a"), "a", "left").join(name("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).where("a <> b").distinct()
        parts = written(connected_components(joined))
        self._write(posts.join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("label")), "labels", batch, "id")
        merged = parts.join(found.select(F.col("now").alias("id")).distinct(), "id", "left_semi").where("id <> component").select(F.col("id").alias("label"), F.col("component").alias("into"))
        # long ways are written again as one step, under this batch's own merges
        after = found.where("steps > 1").select("label", "now").distinct().join(merged.select(F.col("label").alias("now"), "into"), "now", "left").select("label", F.coalesce("into", "now").alias("into"))
        self._write(merged.union(after), "merges", batch, "label")

    def clusters(self) -> DataFrame:
        """(id, component) of every post so far."""
        labels = self._table("labels")
        return labels.join(self._found(labels), "label").select("id", F.col("now").alias("component"))
