"""Summaries that merge: quantile sketches for each hour, and counts observed while a query writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

#: The sketch's size, and the share of all rows that a quantile's rank may be off by at that size (99 % sure; two-sided).
SIZE, RANK_ERROR = 400, 0.01


def sketched(df: DataFrame, keys: list[Column], value: str) -> DataFrame:
    """(keys, n, sketch): a mergeable sketch of ``value`` as double for each group; nulls are left out."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SIZE)).alias("sketch"))


def merged(sketches: DataFrame, keys: list[Column]) -> DataFrame:
    """Sketches of wider groups, out of those of narrower ones; no row is read again."""
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(SIZE)).alias("sketch"))


def quantiles(sketches: DataFrame, at: list[float]) -> DataFrame:
    """The columns of ``sketches`` but the sketch, with quantile and value: a row for each quantile."""
    rows = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias("value")) for q in at]))
    return sketches.withColumn("q", rows).select(*[c for c in sketches.columns if c != "sketch"], "q.quantile", "q.value")


def observed(df: DataFrame, path: str, **metrics: Column) -> dict:
    """Write ``df`` and give back metrics that were taken on the way, without reading it twice."""
    seen = Observation()
    df.observe(seen, *[c.alias(name) for name, c in metrics.items()]).write.mode("overwrite").parquet(path)
    return seen.get
