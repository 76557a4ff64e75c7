"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of all listed rows over its
own rows.  Each document's count is the inverse of the Poisson distribution of
that mean at a number in [0, 1) hashed from seed and id (means over 16 are sums
of several smaller ones), so it is the same in every run and needs no state; the
document is exploded by its count and all copies are shuffled globally by a
hashed key.

Defined cases: sources that the weights do not list, null among them, keep rate
1; a weight of 0 drops its source; a row without an id is drawn by its text's digest
(null as the empty text), so different texts are drawn each for itself; repeated rows with one id,
or of one text without an id, have one count; an empty table gives an empty table;
input columns named like an output are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.llm.session import fresh

#: Target shares: the large source is held to six times the share of each other one.
WEIGHTS = {"src0": 0.24, **{f"src{i}": 0.04 for i in range(1, 20)}}
SEED = "mix-1"
_MOST = 16.0


def poisson_cdf(mean: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... as far as doubles tell it from 1."""
    out, term, total, k = [], math.exp(-mean), 0.0, 0
    while total + term > total or k <= mean:
        total, k = total + term, k + 1
        out.append(total)
        term *= mean / k
    return out


def _identity(docs: DataFrame, doc_id: str, text: str):
    """What a row is drawn by: its id or, without one, its text's digest."""
    found = F.col(text) if text.lower() in {c.lower() for c in docs.columns} else F.lit(None).cast("string")
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text|"), F.md5(F.coalesce(found, F.lit("")))))


def _uniform(*parts):
    """52 hashed bits as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 13), 16, 10).cast("double") / float(1 << 52)


def mix_sources(docs: DataFrame, weights: dict[str, float] = WEIGHTS, source: str = "source", doc_id: str = "doc_id", epochs: float = 1.0, seed: str = SEED, text: str = "text") -> DataFrame:
    """Copies of ``docs`` with rate, copy (from 0) and shuffle_key, in global random order."""
    session, docs = docs.sparkSession, docs.drop("rate", "copy", "shuffle_key")
    name, split, cdf, u, many, who = fresh(docs, "_source", "_parts", "_cdf", "_u", "_n", "_who")
    counts = {r[0]: r[1] for r in docs.where(F.col(source).isin(list(weights))).groupBy(source).count().collect()}  # one row a listed source
    total, whole = sum(counts.values()), sum(weights[s] for s in counts) or 1.0
    rates = {s: epochs * total * weights[s] / whole / n for s, n in counts.items()}
    rates[None] = 1.0
    rows = []
    for s, rate in rates.items():
        parts = max(1, math.ceil(rate / _MOST))
        rows.append((s, float(rate), parts, poisson_cdf(rate / parts)))
    table = session.createDataFrame(rows, f"{name} string, rate double, {split} int, {cdf} array<double>")
    listed = F.when(F.col(source).isin(list(counts)), F.col(source)) if counts else F.lit(None).cast("string")
    found = docs.withColumn(who, _identity(docs, doc_id, text)).join(F.broadcast(table), listed.eqNullSafe(F.col(name)))  # as many rows as weights
    count = F.aggregate(F.sequence(F.lit(0), F.col(split) - 1), F.lit(0), lambda n, j: n + F.size(F.filter(cdf, lambda p: p <= _uniform(F.lit(seed), F.col(who), j))))
    drawn = found.withColumn(u, _uniform(F.lit(seed), F.col(who), F.lit(0)))
    drawn = drawn.withColumn(many, F.when(F.col(split) == 1, F.size(F.filter(cdf, lambda p: p <= F.col(u)))).otherwise(count))
    copies = drawn.where(F.col(many) > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col(many) - 1)))
    keyed = copies.withColumn("shuffle_key", F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col(who), F.col("copy").cast("string"))))
    keyed = keyed.drop(name, split, cdf, u, many, who)
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    return keyed.repartition(parts, "shuffle_key").sortWithinPartitions("shuffle_key")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "source", "text", "copy", F.round("rate", 9).alias("rate"), "shuffle_key")


OP9_SQL = f"""
WITH w(source, w) AS (VALUES {", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items())}),
n AS (SELECT source, w, count(*) AS n FROM documents JOIN w USING (source) GROUP BY ALL),
r AS (SELECT source, (SELECT sum(n) FROM n) * w / (SELECT sum(w) FROM n) / n AS rate FROM n),
d AS (SELECT doc_id, d.source, text, coalesce(rate, 1.0) AS rate, ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'text|' || md5(coalesce(text, ''))) || '|0'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents d LEFT JOIN r ON d.source = r.source),
c AS (SELECT *, unnest(range(0, len(list_filter(range(0, 80), lambda k: list_sum(list_transform(range(0, k + 1), lambda i: exp(-rate) * pow(rate, i) / gamma(i + 1))) <= u)))) AS copy FROM d)
SELECT doc_id, source, text, copy::INTEGER AS copy, round(rate, 9) AS rate, md5('{SEED}|order|' || coalesce(doc_id::VARCHAR, 'text|' || md5(coalesce(text, ''))) || '|' || copy) AS shuffle_key FROM c
"""
