"""Document fingerprints by winnowing, in native expressions only.

The hashes of all k-grams of words slide under a window; each window selects its
least hash, the rightmost one on ties, and keeps its position.  Any run of
``window + k - 1`` words that two texts share therefore has a common selected
hash.  A selected value packs 33 bits of hash above 30 bits that fall with the
position, so one minimum settles hash and tie at once.

Defined cases: null text is empty text; a text without words has the empty
fingerprint, two of which are alike (1.0); fewer than k words make one k-gram;
documents follow each other by descending doc_id, then by a hash of the text,
null ids last; rows that repeat both id and text are one document in that order
and get equal results; a single document is its own next; an empty table gives an
empty table; input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmlens.llm.session import fresh

K, WINDOW = 4, 8
_POS = 30
_LOW = (1 << _POS) - 1


def words(bare: str) -> Column:
    """Runs of anything but the six ASCII white space characters, of a text trimmed of them."""
    return F.when(F.col(bare) == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def _winnowed(df: DataFrame, text: str, out: str, k: int, window: int) -> DataFrame:
    """``df`` with the selected values of a text, in order of position.

    Each step reads the column of the one before it at two places, which keeps the
    optimiser from inlining it into a lambda, where it would run for every element.
    """
    b, w, h, g = fresh(df, "_b", "_w", "_h", "_g")
    df = df.withColumn(b, F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\x0c\r")))
    df = df.withColumn(w, words(b))
    df = df.withColumn(h, F.when(F.size(w) > 0, F.transform(w, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>")))
    packed = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(*[F.get(h, i + j) for j in range(k)]), 31), _POS).bitwiseOR(F.lit(_LOW) - i)
    df = df.withColumn(g, F.when(F.size(h) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), packed)).otherwise(F.array().cast("array<bigint>")))
    least = F.transform(F.sequence(F.lit(0), F.greatest(F.size(g) - window, F.lit(0))), lambda i: F.array_min(F.slice(g, i + 1, window)))
    return df.withColumn(out, F.when(F.size(g) > 0, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>"))).drop(b, w, h, g)


def _hashes(selected: str) -> Column:
    """The distinct hashes of selected values, as ints."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftrightunsigned(x, _POS + 2).cast("int")))


def _likeness(a: str, b: str) -> Column:
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, F.lit(1.0)).otherwise(both.cast("double") / F.nullif(every, F.lit(0)))


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with fingerprint: an array of (hash, pos), pos the first word of the k-gram."""
    docs = docs.drop("fingerprint")
    (sel,) = fresh(docs, "_sel")
    df = _winnowed(docs, text, sel, k, window)
    unpack = lambda x: F.struct(F.shiftrightunsigned(x, _POS).alias("hash"), (F.lit(_LOW) - x.bitwiseAND(F.lit(_LOW))).cast("int").alias("pos"))
    return df.withColumn("fingerprint", F.transform(sel, unpack)).drop(sel)


def followers(keys: DataFrame, parts: int) -> DataFrame:
    """(id, none, th, p_id, p_none, p_th, p_half): whom each document follows, the first one follows the last.

    Only ids, hashes and lengths are sorted; the rows of each range carry their place in
    it, and what crosses from range to range is one row for each range.
    """
    order_by = [F.col("none"), F.col("id").desc(), F.col("th")]
    ranged = keys.repartitionByRange(parts, *order_by).sortWithinPartitions(*order_by)
    ranged = ranged.withColumn("at", F.monotonically_increasing_id()).checkpoint()
    last = ranged.groupBy(F.shiftrightunsigned("at", 33).alias("range")).agg(F.max("at").alias("last"))
    order = Window.orderBy("range")
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = last.select("range", F.coalesce(F.lag("last").over(order), F.last("last").over(everything)).alias("before"))  # a row for each partition
    placed = ranged.withColumn("range", F.shiftrightunsigned("at", 33)).join(F.broadcast(last), "range")
    placed = placed.withColumn("p_at", F.when(F.col("at") == F.shiftleft("range", 33), F.col("before")).otherwise(F.col("at") - 1))
    other = ranged.select(F.col("at").alias("p_at"), F.col("id").alias("p_id"), F.col("none").alias("p_none"), F.col("th").alias("p_th"), F.col("half").alias("p_half"))
    return placed.select("id", "none", "th", "n_rows", "p_at").join(other, "p_at").drop("p_at")


def compare_with_edits(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """Per document (doc_id, text): its edited text's digest, both fingerprints and their likeness, and that to the next document.

    A fingerprint is the list of its distinct hashes in order of position, joined by one
    space, so that any two rows can be compared by it; ``fingerprints`` keeps the positions.

    Texts and hashes are shuffled once by document; that exchange serves both as each
    document's own row and as its predecessor's next document.
    """
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.coalesce("doc_id", F.lit(0).cast(kind)).alias("id"), F.col("doc_id").isNull().alias("none"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    keys = docs.groupBy("id", "none", "th").agg(F.max(F.floor(F.length("text") / 2).cast("int")).alias("half"), F.count("*").alias("n_rows"))
    after = followers(keys, parts).checkpoint()
    whole = _winnowed(docs, "text", "sel", k, window).select("id", "none", "th", "text", _hashes("sel").alias("fp"))
    heads = whole.hint("merge").join(after.drop("n_rows"), ["id", "none", "th"]).select(F.col("p_id").alias("id"), F.col("p_none").alias("none"), F.col("p_th").alias("th"), F.expr("left(text, p_half)").alias("head"), F.col("fp").alias("n_fp"))
    if not after.where("n_rows > 1").isEmpty():  # repeated rows offer the same head several times
        heads = heads.dropDuplicates(["id", "none", "th"])
    both = whole.hint("merge").join(heads, ["id", "none", "th"])
    both = both.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 2) as int))"), "head"))
    both = _winnowed(both, "edited", "e_sel", k, window).withColumn("e_fp", _hashes("e_sel"))
    listed = lambda fp: F.array_join(F.col(fp).cast("array<string>"), " ")
    return both.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), listed("fp").alias("fingerprint"), listed("e_fp").alias("edited_fingerprint"),
        _likeness("fp", "e_fp").alias("near_edited"), _likeness("fp", "n_fp").alias("near_next"),
    )


def op6_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
