"""An append-only trail of what was anonymised, by whom and how, that shows if a row of it was changed.

Each batch is written once, as rows (subject, field, method, actor, at, hash), under its
number.  A row's hash is over all it says and its batch.  A batch's root is over the
number of its rows and four sums of its rows' hashes, which partial sums in any order give,
so no task sees all rows; and its seal is over its root and the seal of the batch before.
``faults`` computes all of them anew: a row that was changed, added or taken out breaks its batch,
and a batch that was replaced with its root breaks the chain after it.

Null fields are kept apart from empty ones; a batch without rows has a root as well.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("subject", "field", "method", "actor", "at")
_PARTS = range(4)


def row_hash(batch: Column) -> Column:
    """A digest of a row's fields and its batch; every field comes with its length, null without."""
    said = [F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in FIELDS]
    return F.sha2(F.concat_ws("|", batch.cast("string"), *said), 256)


def _roots(rows: DataFrame) -> DataFrame:
    """(batch, n, root) of rows (batch, hash)."""
    parts = [F.sum(F.conv(F.substring("hash", 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")).alias(f"s{i}") for i in _PARTS]
    sums = rows.groupBy("batch").agg(F.count("*").alias("n"), *parts)
    return sums.select("batch", "n", F.sha2(F.concat_ws("|", "n", *[f"s{i}" for i in _PARTS]), 256).alias("root"))


def _seal(before: str, n: int, root: str) -> str:
    return hashlib.sha256(f"{before}|{n}|{root}".encode()).hexdigest()


class AuditTrail:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def seals(self) -> list:
        """(batch, n, root, seal) of every batch, in order: a row for each call of ``append``."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/seals")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return []
        return self.spark.read.parquet(f"{self.path}/seals").orderBy("batch").collect()

    def append(self, entries: DataFrame, actor: str, at: str) -> int:
        """Entries (subject, field, method) as the next batch; its number."""
        known = self.seals()
        batch, before = (known[-1]["batch"] + 1, known[-1]["seal"]) if known else (0, "")
        said = entries.select(F.col("subject").cast("string").alias("subject"), "field", "method", F.lit(actor).alias("actor"), F.lit(at).cast("timestamp").alias("at"))
        folder = f"{self.path}/rows/batch={batch}"
        said.withColumn("hash", row_hash(F.lit(batch))).write.mode("overwrite").parquet(folder)  # without its seal a batch is not there yet
        found = _roots(self.spark.read.parquet(folder).withColumn("batch", F.lit(batch))).first()
        n, root = (found["n"], found["root"]) if found else (0, "")
        self.spark.createDataFrame([(batch, n, root, _seal(before, n, root))], "batch int, n bigint, root string, seal string").coalesce(1).write.mode("append").parquet(f"{self.path}/seals")
        return batch

    def faults(self) -> list[tuple[int, str]]:
        """(batch, what is wrong) of every batch that is not as it was written."""
        rows = self.rows().withColumn("own", row_hash(F.col("batch")))
        changed = {r["batch"]: r["n"] for r in rows.where("own <> hash OR hash IS NULL").groupBy("batch").agg(F.count("*").alias("n")).collect()}  # a row a batch
        roots = {r["batch"]: (r["n"], r["root"]) for r in _roots(rows.select("batch", F.col("own").alias("hash"))).collect()}
        out, before = [], ""
        for s in self.seals():
            if s["batch"] in changed:
                out.append((s["batch"], f"{changed[s['batch']]} rows do not bear their own hash"))
            if roots.pop(s["batch"], (0, "")) != (s["n"], s["root"]):
                out.append((s["batch"], "its rows are not those that were sealed"))
            if _seal(before, s["n"], s["root"]) != s["seal"]:
                out.append((s["batch"], "its seal does not follow from the one before"))
            before = s["seal"]
        return out + [(b, "it has no seal") for b in sorted(roots)]
