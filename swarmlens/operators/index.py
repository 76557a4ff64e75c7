"""An index of MinHash signatures on disk: add, replace, delete, get, count, and search by the buckets of some ids.

Three tables lie under ``path``, each written in numbered batches and partitioned into
slots (``batch=.../slot=...``): ``signatures`` by id, ``buckets`` (band, key, id) by band
and key, ``dead`` by id.  A batch is written whole under its number, so one that is run
again replaces itself.  An id lives as its latest batch wrote it; a tombstone hides what
came before or with its batch.  A search reads the slots of its ids and of their
buckets, and no others: slots are partitions, and Spark prunes them.

Texts without words to hash have no signature and are not in the index; a null id or
text is not added; an id that comes twice in a batch is kept once, with its greatest text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmlens.operators import similarity as S
from swarmlens.operators.graphs import written

SIGNATURES = "id bigint, sig array<bigint>, batch bigint, slot int"
BUCKETS = "id bigint, band int, key bigint, batch bigint, slot int"
DEAD = "id bigint, batch bigint, slot int"


class SignatureIndex:
    """``slots`` is fixed when an index is made; by default it follows the session's shuffle partitions."""

    def __init__(self, spark: SparkSession, path: str, hashes: int = 128, bands: int = 16, slots: int | None = None):
        self.spark, self.path, self.hashes, self.bands = spark, path, hashes, bands
        self.slots = slots or max(16, min(1024, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def _slot(self, *of) -> Column:
        return F.pmod(F.xxhash64(*of), F.lit(self.slots)).cast("int")

    def _write(self, df: DataFrame, name: str, batch: int, slot: Column) -> None:
        df.withColumn("slot", slot).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.path}/{name}/batch={batch}")

    def table(self, name: str, slots: list[int] | None = None) -> DataFrame:
        """A table of the index, or some slots of it; without files it is empty."""
        schema = {"signatures": SIGNATURES, "buckets": BUCKETS, "dead": DEAD}[name]
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return df if slots is None else df.where(F.col("slot").isin(slots))

    def slots_of(self, df: DataFrame, *of) -> list[int]:
        """The slots that some rows lie in: at most ``slots`` numbers."""
        return sorted(r[0] for r in df.select(self._slot(*of).alias("slot")).distinct().collect())

    def add(self, docs: DataFrame, batch: int) -> DataFrame:
        """Texts (id, text) under a batch number greater than all before, or the one to be replaced; ids that are there are replaced.  Gives their signatures back."""
        once = docs.where("id IS NOT NULL AND text IS NOT NULL").groupBy("id").agg(F.max("text").alias("text"))
        signatures = written(S.minhash(once, self.hashes))
        self._write(signatures, "signatures", batch, self._slot("id"))
        self._write(S.bands(signatures, self.hashes, self.bands), "buckets", batch, self._slot("band", "key"))
        # an id whose new text has no signature is gone
        gone = once.select("id").join(signatures.select("id"), "id", "left_anti")
        if not gone.isEmpty():
            self._write(gone, "dead", batch, self._slot("id"))
        return signatures

    def delete(self, ids: DataFrame, batch: int) -> None:
        """Tombstones for some ids (id): what lies in this batch and those before it is hidden."""
        self._write(ids.select("id").distinct(), "dead", batch, self._slot("id"))

    def living(self, slots: list[int] | None = None) -> DataFrame:
        """(id, batch, sig) of the ids that are there, each as last written."""
        latest = self.table("signatures", slots).groupBy("id").agg(F.max_by("sig", "batch").alias("sig"), F.max("batch").alias("batch"))
        dead = self.table("dead", slots).groupBy("id").agg(F.max("batch").alias("died"))
        return latest.join(dead, "id", "left").where("died IS NULL OR died < batch").select("id", "batch", "sig")

    def count(self) -> int:
        return self.living().count()

    def get(self, ids: DataFrame) -> DataFrame:
        """(id, batch, sig) of those of some ids (id) that are there, out of their slots alone."""
        ids = ids.select("id").distinct()
        return self.living(self.slots_of(ids, "id")).join(ids, "id", "left_semi")

    def candidates(self, signatures: DataFrame) -> DataFrame:
        """(a, b): each of some signatures (id, sig) with every other living id that shares a bucket, out of the buckets' slots alone."""
        asked = S.bands(signatures, self.hashes, self.bands).withColumnRenamed("id", "a")
        slots = self.slots_of(asked, "band", "key")
        there = self.table("buckets", slots).select(F.col("id").alias("b"), "band", "key", "batch")
        met = asked.join(there, ["band", "key"]).where("a <> b").groupBy("a", "b").agg(F.max("batch").alias("batch"))
        return written(met)

    def similar(self, signatures: DataFrame, threshold: float) -> DataFrame:
        """(a, b, similarity): each of some signatures with every other living id at or above ``threshold`` that shares a bucket with it."""
        met = self.candidates(signatures)
        others = met.select(F.col("b").alias("id")).distinct()
        known = self.living(self.slots_of(others, "id")).join(others, "id", "left_semi")
        # a bucket that an earlier text of an id lay in is no bucket of its latest one
        sides = met.join(known.select(F.col("id").alias("b"), "batch", F.col("sig").alias("sb")), ["b", "batch"]).join(signatures.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        agree = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda z: z)) / F.lit(float(self.hashes))
        return sides.select("a", "b", agree.alias("similarity")).where(F.col("similarity") >= threshold)

    def find_similar(self, ids: DataFrame, k: int = 10, threshold: float = 0.7) -> DataFrame:
        """(id, rank, other, similarity): the ``k`` most similar of each of some ids that are there, ties to the lesser id."""
        near = self.similar(self.get(ids).select("id", "sig"), threshold)
        order = Window.partitionBy("a").orderBy(F.desc("similarity"), "b")
        return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("a").alias("id"), "rank", F.col("b").alias("other"), "similarity")
