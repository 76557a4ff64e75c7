"""Similarity self-join of documents on word n-gram sets by MinHash banding.

Band and row counts follow from the threshold and a target recall: the most rows
a band for which enough bands reach the recall within ``most_hashes``.  Distinct
texts (16-byte MD5) are shuffled on their band hashes; every member of a band's
bucket is tied to the bucket's least text, never to all others, and the ties'
components hold all candidate pairs.  Each component is dealt into blocks of
bounded rows and bytes by hash; two blocks meet if a band value is in both, and
within such a unit the pairs that share a band are verified on their full n-gram sets.  A unit gives
back a number of links for each text and a spanning forest of the links it found,
so groups of thousands of near copies cost no row for each pair, while every link
between different texts counts.

``class_id`` is the least doc_id of all texts joined by links; ``n_links`` the
number of other distinct texts at or above the threshold; ``n_copies`` the number
of documents with the very same text.

Defined cases: a text of fewer than n words has one n-gram of all its words;
texts without words link to nothing; a null text is in a class of its own
(class_id its own id, one copy); a null doc_id never lends its id to a class that
has another; repeated rows (texts and ids alike) are copies; an empty table gives an empty table; input
columns named like an output are replaced.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmlens.llm.components import components
from swarmlens.llm.text_arrays import gram_hashes, gram_starts, mix, release, slices, tidy, words_of

N, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 256
BLOCK_ROWS, BLOCK_BYTES = 1024, 6 << 20


def choose_bands(threshold: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows a band)."""
    best = (1, 1)
    for rows in range(1, most_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-p)) if p > 1e-12 else most_hashes + 1
        if rows * bands <= most_hashes:
            best = (bands, rows)
    return best


def shingle(first: np.ndarray, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of all texts, and the n + 1 places at which each text's begin."""
    counts = np.diff(first)
    sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    places = np.append(0, np.cumsum(sizes))
    at, width = np.empty(places[-1], np.int64), np.full(places[-1], n, np.int64)
    short = np.repeat(counts < n, sizes)
    at[~short] = gram_starts(first, n)
    few = (counts < n) & (counts > 0)
    at[short], width[short] = first[:-1][few], counts[few]
    return gram_hashes(words, width, at), places


def bands_of(grams: np.ndarray, places: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of band hashes for each text that has n-grams; zeros for the others."""
    random = np.random.Generator(np.random.PCG64(7))
    factors = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    full = np.flatnonzero(np.diff(places))
    out = np.zeros((len(places) - 1, bands), np.uint64)
    if not len(full):
        return out
    starts = places[:-1][full]
    buffer = np.empty_like(grams)
    for b in range(bands):
        value = np.full(len(full), b, np.uint64)
        for r in range(rows):
            np.multiply(grams, factors[b * rows + r], out=buffer)
            np.add(buffer, shifts[b * rows + r], out=buffer)
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(buffer, starts))
        out[full, b] = value
    return out


def _signatures(docs: DataFrame, text: str, bands: int, rows: int, n: int) -> DataFrame:
    """(doc_id, key, n_bytes, bands) of every document with a text; bands is empty without words."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 512 << 10):
                data, offsets, _, _, first, words = words_of(part.column(text))
                grams, places = shingle(first, words, n)
                values = bands_of(grams, places, bands, rows)
                raw = data.tobytes()
                keys = [hashlib.md5(raw[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                packed = [v.tobytes() if m else b"" for v, m in zip(values, np.diff(places))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), pa.array(np.diff(offsets), pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "key", "n_bytes", "bands"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("key binary, n_bytes bigint, bands binary").fields])
    return docs.where(F.col(text).isNotNull()).mapInArrow(tidy(run), schema)


def _values(texts: DataFrame, bands: int, kept: str) -> DataFrame:
    """(value, and the columns ``kept``) for each band of each text."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches):
        for batch in batches:
            packed = batch.column("bands").to_pylist()
            owner = np.repeat(np.flatnonzero([len(p) > 0 for p in packed]), bands)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(packed), np.int64)), *(batch.column(c).take(pa.array(owner)) for c in names)], names=["value", *names])

    return texts.select("bands", *names).mapInArrow(run, f"value bigint, {kept}")


def _pack(n: int, bands: int, rows: int):
    def pack(table: pa.Table) -> pa.Table:
        """One row for a block: its distinct texts' n-gram sets over the block's own vocabulary, and band hashes."""
        keys = np.array([k.hex() for k in table["key"].to_pylist()])
        _, keep = np.unique(keys, return_index=True)
        table = table.take(pa.array(keep))
        grams_, places_, values = [], [0], []
        for part in slices(table.select(["key", "text"]).combine_chunks().to_batches()[0], "text", 512 << 10):
            _, _, _, _, first, words = words_of(part.column("text"))
            grams, places = shingle(first, words, n)
            values.append(bands_of(grams, places, bands, rows))
            grams_.append(grams)
            places_ += (places[1:] + places_[-1]).tolist()
        vocabulary, index = np.unique(np.concatenate(grams_), return_inverse=True)
        sets = [np.unique(index[a:b]).astype(np.int32) for a, b in zip(places_[:-1], places_[1:])]
        row = {"key": b"".join(table["key"].to_pylist()), "sizes": np.array([len(s) for s in sets], np.int32).tobytes(), "bands": np.concatenate(values).tobytes(), "vocabulary": vocabulary.tobytes()}
        row["sets"] = pa.compress(b"".join(np.diff(s, prepend=0).astype(np.int32).tobytes() for s in sets), "zstd", asbytes=True)
        first_row = table.slice(0, 1)
        return pa.table({"cell": first_row["cell"], "block": first_row["block"], "blocks": first_row["blocks"], **{k: pa.array([v], pa.binary()) for k, v in row.items()}})

    return pack


def _open(row: dict, bands: int):
    sizes = np.frombuffer(row["sizes"], np.int32)
    gaps = np.frombuffer(pa.decompress(row["sets"], int(sizes.sum()) * 4, "zstd", asbytes=True), np.int32)
    total = np.cumsum(gaps, dtype=np.int64)
    ends = np.cumsum(sizes)
    before = np.append(0, total)[ends - sizes]
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    keys = [row["key"][i : i + 16] for i in range(0, len(row["key"]), 16)]
    return keys, sizes.astype(np.int64), np.frombuffer(row["bands"], np.uint64).reshape(-1, bands), vocabulary[total - np.repeat(before, sizes)]


def _verify(bands: int, threshold: float):
    def verify(table: pa.Table) -> pa.Table:
        """Links of the unit's pairs that share a band: (key, links, null), and a spanning forest (key, 0, other)."""
        alone = table["i"][0].as_py() == table["j"][0].as_py()
        if not alone and table.num_rows == 1:  # the other block is empty; the pairs inside this one belong to its own unit
            return pa.table({"key": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.binary())})
        blocks = [_open(r, bands) for r in sorted(table.to_pylist(), key=lambda r: r["block"])]
        keys = [k for b in blocks for k in b[0]]
        sizes = np.concatenate([b[1] for b in blocks])
        values = np.concatenate([b[2] for b in blocks])
        grams = np.concatenate([b[3] for b in blocks])
        owner = np.repeat(np.arange(len(keys)), sizes)
        order = np.argsort(grams, kind="stable")
        new = np.append(True, grams[order][1:] != grams[order][:-1]) if len(order) else np.zeros(0, bool)
        df = np.diff(np.append(np.flatnonzero(new), len(order)))
        shared = np.repeat(df > 1, df)  # an n-gram of one text alone is in no intersection
        column = np.cumsum(df > 1)[np.cumsum(new) - 1][shared] - 1
        row = owner[order][shared]
        width = -(-int((df > 1).sum()) // 64)
        bits = np.zeros((len(keys), max(1, width)), np.uint64)
        np.bitwise_or.at(bits, (row, column >> 6), np.uint64(1) << (column & 63).astype(np.uint64))
        cut = len(blocks[0][0])
        lefts, rights = (np.arange(len(keys)),) * 2 if alone else (np.arange(cut), np.arange(cut, len(keys)))
        links, parent, forest = np.zeros(len(keys), np.int64), list(range(len(keys))), []

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        step = max(64, (1 << 19) // max(1, len(rights)))  # pairs at a time
        for a in range(0, len(lefts), step):
            some = lefts[a : a + step]
            low, high = np.minimum.outer(sizes[some], sizes[rights]), np.maximum.outer(sizes[some], sizes[rights])
            near = np.zeros((len(some), len(rights)), bool)
            for b in range(bands):
                near |= values[some, b][:, None] == values[rights, b][None, :]
            near &= (low >= threshold * high - 1e-9) & (low > 0)
            i, j = np.nonzero(near)
            i, j = some[i], rights[j]
            if alone:
                i, j = i[i < j], j[i < j]
            part = max(1, (4 << 20) // (8 * bits.shape[1]))
            for c in range(0, len(i), part):
                x, y = i[c : c + part], j[c : c + part]
                both = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
                good = both >= threshold * (sizes[x] + sizes[y] - both) - 1e-9
                x, y = x[good], y[good]
                links += np.bincount(x, minlength=len(keys)) + np.bincount(y, minlength=len(keys))
                pairs = np.unique(np.stack([x, y], 1), axis=0) if len(x) < 1000 else np.stack([x, y], 1)
                label = np.array([root(k) for k in range(len(keys))]) if len(x) else None
                if len(x):
                    pairs = pairs[label[pairs[:, 0]] != label[pairs[:, 1]]]
                for p, q in pairs.tolist():
                    p0, q0 = root(p), root(q)
                    if p0 != q0:
                        parent[max(p0, q0)] = min(p0, q0)
                        forest.append((p, q))
        release()
        linked = np.flatnonzero(links)
        return pa.table({
            "key": pa.array([keys[k] for k in linked] + [keys[p] for p, _ in forest], pa.binary()), "links": pa.array(links[linked].tolist() + [0] * len(forest), pa.int64()),
            "other": pa.array([None] * len(linked) + [keys[q] for _, q in forest], pa.binary()),
        })

    return verify


def near_duplicates(docs: DataFrame, text: str = "text", n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, most_hashes: int = MOST_HASHES) -> DataFrame:
    """A row for each document: doc_id, class_id, n_links, n_copies (see above), and two text keys.

    ``key`` is the digest of the document's text (null without one), ``class_key`` that of
    its class's least key: unlike class_id it tells classes apart where ids repeat.
    """
    bands, rows = choose_bands(threshold, recall, most_hashes)
    docs = docs.select("doc_id", F.col(text).alias("text"))
    signed = _signatures(docs, "text", bands, rows, n).select("doc_id", "key", "n_bytes", "bands").checkpoint()
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.max("n_bytes").alias("n_bytes"), F.max("bands").alias("bands"))

    values = _values(texts, bands, "key binary")
    hubs = values.groupBy("value").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("value", "hub")
    ties = values.join(hubs, "value").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    groups = components(ties)
    members = groups.union(groups.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("node", "key")
    plain = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n_bytes").alias("n_bytes"))
    members = members.join(plain, "key").checkpoint()
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n_bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    small = members.join(sizes.where("blocks = 1"), "root").agg(F.count("*"), F.sum("n_bytes")).first()
    cells = max(1, math.ceil((small[0] or 0) / (BLOCK_ROWS / 2)), math.ceil((small[1] or 0) / (BLOCK_BYTES / 2)))
    cell = F.when(F.col("blocks") > 1, F.hex("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(cells)).cast("string"))
    placed = members.join(sizes, "root").select("key", "rep", cell.alias("cell"), "blocks", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))

    whole = docs.where(F.col("text").isNotNull()).select(F.unhex(F.md5("text")).alias("key"), "doc_id", "text")
    if not signed.groupBy("key", "doc_id").count().where("count > 1").isEmpty():  # rows that repeat an id and a text: one of them speaks for all
        whole = whole.groupBy("key", "doc_id").agg(F.first("text").alias("text"))
    found = whole.join(placed.withColumnRenamed("key", "p_key"), (F.col("key") == F.col("p_key")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("cell", "block", "blocks", "key", "text")
    binary = "key binary, sizes binary, bands binary, vocabulary binary, sets binary"
    packed = found.groupBy("cell", "block").applyInArrow(_pack(n, bands, rows), f"cell string, block int, blocks int, {binary}").checkpoint()  # read twice: the texts are shuffled once
    # blocks of a large component meet only where a band value is in both; block numbers alone are gathered for a value
    large = signed.groupBy("key").agg(F.max("bands").alias("bands")).join(placed.where("blocks > 1").select("key", "cell", "block"), "key")
    met = _values(large, bands, "cell string, block int").groupBy("cell", "value").agg(F.collect_set("block").alias("held"))
    pairs = met.where("size(held) > 1").select("cell", F.explode("held").alias("i"), "held").select("cell", "i", F.explode("held").alias("j")).where("i < j").distinct()
    meets = pairs.select("cell", "i", "j", F.explode(F.array("i", "j")).alias("block")).join(packed, ["cell", "block"])
    names = ["cell", "i", "j", "block", "key", "sizes", "bands", "vocabulary", "sets"]
    units = packed.withColumn("i", F.col("block")).withColumn("j", F.col("block")).select(names).union(meets.select(names))
    verified = units.groupBy("cell", "i", "j").applyInArrow(_verify(bands, threshold), "key binary, links bigint, other binary").checkpoint()

    classes = components(verified.where("other IS NOT NULL").select(F.col("key").alias("a"), F.col("other").alias("b")))
    links = verified.where("links > 0").groupBy("key").agg(F.sum("links").alias("n_links"))
    texts = signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies")).join(links, "key", "left").join(classes.withColumnRenamed("node", "key"), "key", "left").withColumn("class_key", F.coalesce("root", "key"))
    ids = texts.groupBy("class_key").agg(F.min("rep").alias("class_id"))
    texts = texts.join(ids, "class_key").select("key", "class_key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = signed.select("doc_id", "key").join(texts, "key").select("doc_id", "class_id", "n_links", "n_copies", "key", "class_key")
    none = F.lit(None).cast("binary")
    alone = docs.where(F.col("text").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"), F.lit(1).cast("bigint").alias("n_copies"), none.alias("key"), none.alias("class_key"))
    return out.union(alone)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies")


OP10_SQL = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS rep, count(*) AS n_copies FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT rep, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT DISTINCT rep, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT rep, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
z AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN z x ON x.rep = a JOIN z y ON y.rep = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
c(a, b) AS (SELECT rep, rep FROM t UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a),
k AS (SELECT a AS rep, min(b) AS class_id FROM c GROUP BY a),
l AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(n_links, 0) AS n_links, coalesce(n_copies, 1) AS n_copies
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN k USING (rep) LEFT JOIN l USING (rep)
"""
