"""Exact substring deduplication with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of ``block`` words.
A repeat of ``window`` >= 2 * block - 1 words covers a whole reference block of
each of its occurrences, so probing the block index with every rolling window of
``block`` words finds at least one anchor in each occurrence.  Around the anchors
the hits are extended to all windows of ``window`` words that hold an anchor;
those are compared over the whole corpus by two 64-bit hashes of words that are
themselves hashed twice, by different byte tables, so windows are confused only if
128 bits agree by chance; the union of the windows that occur twice is the set of
maximal repeats of at least ``window`` words.

Plan: one shuffle of compressed documents, one of block hashes (about four bytes
a word), one of the windows around anchors, and bitmaps back.  No pair of
occurrences is ever formed, so a passage that a third of the documents share
costs one entry per chunk.

Defined cases: null text is empty (0 words, nothing removed, null stays null);
texts under ``window`` words lose nothing; repeated rows are occurrences of each
other; an empty table gives an empty table; input columns named like an output
are replaced.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmlens.llm import chunks as C
from swarmlens.llm.text_arrays import gram_hashes, gram_starts, span_hashes, tidy, words_of

WINDOW = 35
_BITS = 48
_JUDGED = "chunk bigint, bucket int, n int, bits binary"
_VALUES = "bucket int, chunk bigint, n int, codes binary, flags binary"


def _anchors(first: np.ndarray, words: np.ndarray, block: int):
    """Rolling windows: their word indices, 48-bit hashes, the sorted distinct hashes and their flags."""
    at = gram_starts(first, block)
    codes = gram_hashes(words, block, at) >> np.uint64(64 - _BITS)
    text = np.searchsorted(first, at, side="right") - 1
    aligned = (at - first[text]) % block == 0
    both = np.sort(codes << np.uint64(1) | aligned)
    if not len(both):
        return at, codes, both, np.zeros(0, bool), np.zeros(0, bool)
    values = both >> np.uint64(1)
    last = np.append(np.flatnonzero(values[1:] != values[:-1]), len(values) - 1)
    counts = np.diff(last, prepend=-1)
    return at, codes, values[last], (both[last] & np.uint64(1)).astype(bool), counts > 1


def _windows(spans, first, words, block, window, verdicts):
    """Windows that hold an anchor: word indices and two hashes, of words hashed twice, in the order of the hashes."""
    at, codes, values, _, _ = _anchors(first, words, block)
    hot = values[verdicts] if len(verdicts) else values[:0]
    found = np.zeros(len(words) + 1, np.int64)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, codes), len(hot) - 1)
        found[at[hot[place] == codes] + 1] = 1
    found = np.cumsum(found)
    where = gram_starts(first, window)
    where = where[found[where + window - block + 1] > found[where]]
    one = gram_hashes(words, window, where)
    two = gram_hashes(span_hashes(*spans, family=1), window, where) if len(where) else one
    order = np.lexsort((two, one))
    where, one, two = where[order], one[order], two[order]
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return where, one[new], two[new], new


def _judge_anchors(table: pa.Table) -> pa.Table:
    """A verdict for each value: in a reference block somewhere, and at two places or more."""
    rows = table.select(["chunk", "n", "codes", "flags"]).to_pylist()
    values = [C.get_sorted(r["codes"]) for r in rows]
    flags = [np.unpackbits(np.frombuffer(r["flags"], np.uint8)) for r in rows]
    aligned = np.concatenate([f[: r["n"]] for f, r in zip(flags, rows)])
    many = np.concatenate([f[r["n"] : 2 * r["n"]] for f, r in zip(flags, rows)])
    every = np.concatenate(values)
    order = np.argsort(every, kind="stable")
    every = every[order]
    at = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    sizes = np.diff(np.append(at, len(every)))
    good = (sizes + np.maximum.reduceat(many[order], at) > 1) & (np.maximum.reduceat(aligned[order], at) > 0)
    return _sent_back(table, rows, order, np.repeat(good, sizes))


def _judge_windows(table: pa.Table) -> pa.Table:
    """A verdict for each window: at two places or more."""
    rows = table.select(["chunk", "n", "codes", "flags"]).to_pylist()
    codes = [np.frombuffer(r["codes"], np.uint64) for r in rows]
    one = np.concatenate([x[: r["n"]] for x, r in zip(codes, rows)])
    two = np.concatenate([x[r["n"] :] for x, r in zip(codes, rows)])
    many = np.concatenate([C.get_bits(r["flags"], r["n"]) for r in rows])
    order = np.lexsort((two, one))
    one, two = one[order], two[order]
    at = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    sizes = np.diff(np.append(at, len(one)))
    return _sent_back(table, rows, order, np.repeat(sizes + np.maximum.reduceat(many[order].astype(np.int64), at) > 1, sizes))


def _sent_back(table, rows, order, good) -> pa.Table:
    out = np.empty(len(order), bool)
    out[order] = good
    parts = np.split(out, np.cumsum([r["n"] for r in rows])[:-1])
    return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "n": table["n"], "bits": pa.array([C.put_bits(x) for x in parts], pa.binary())})


def _values_out(chunk: int, buckets: int, bits: int, values: np.ndarray, codes, flags) -> pa.RecordBatch:
    cuts = C.cut(values, buckets, bits)
    full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "n": pa.array([int(cuts[b + 1] - cuts[b]) for b in full], pa.int32()),
        "codes": pa.array([codes(cuts[b], cuts[b + 1]) for b in full], pa.binary()), "flags": pa.array([flags(cuts[b], cuts[b + 1]) for b in full], pa.binary()),
    })


def dedup_substrings(docs: DataFrame, text: str = "text", window: int = WINDOW, chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """``docs`` with kept_text, n_words, n_removed, kept_sha256 and removed (word spans, end exclusive).

    ``kept_text`` is the text itself where nothing is removed, else the kept words joined by
    one space; ``kept_sha256`` is always that of the kept words joined by one space.
    """
    block, parts = (window + 1) // 2, C.partitions(docs)
    buckets = max(64, parts)
    added = [T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    docs = docs.drop(*[f.name for f in added])
    schema = T.StructType([*docs.schema.fields, *added])
    names = docs.columns

    def anchors(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                _, _, _, _, first, words = words_of(C.unpack(blob.as_py()).column(text))
                _, _, values, aligned, many = _anchors(first, words, block)
                yield _values_out(chunk, buckets, _BITS, values, lambda a, b: C.put_sorted(values[a:b]), lambda a, b: np.packbits(np.concatenate([aligned[a:b], many[a:b]])).tobytes())

    def windows(batches):
        for batch in batches:
            for row in C.rows_of(batch):
                data, _, starts, ends, first, words = words_of(C.unpack(row["blob"]).column(text))
                _, one, two, new = _windows((data, starts, ends), first, words, block, window, C.verdict_bits(row["anchors"]))
                starts = np.flatnonzero(new)
                many = np.diff(np.append(starts, len(new))) > 1
                yield _values_out(row["chunk"], buckets, 64, one, lambda a, b: one[a:b].tobytes() + two[a:b].tobytes(), lambda a, b: C.put_bits(many[a:b]))

    def finish(batches):
        for batch in batches:
            for row in C.rows_of(batch):
                part = C.unpack(row["blob"])
                data, offsets, starts, ends, first, words = words_of(part.column(text))
                where, _, _, new = _windows((data, starts, ends), first, words, block, window, C.verdict_bits(row["anchors"]))
                verdicts = C.verdict_bits(row["windows"])
                bad = where[verdicts[np.cumsum(new) - 1]] if len(where) else where
                cover = np.zeros(len(words) + 1, np.int64)
                np.add.at(cover, bad, 1)
                np.add.at(cover, bad + window, -1)
                gone = np.cumsum(cover)[:-1] > 0
                yield pa.RecordBatch.from_arrays([*part.columns, *_kept(part.column(text), data, offsets, starts, ends, first, gone)], names=[*names, *[f.name for f in added]])

    packed = C.pack(docs, text, chunk_bytes, parts)
    one = C.back(packed.mapInArrow(tidy(anchors), _VALUES).groupBy("bucket").applyInArrow(_judge_anchors, _JUDGED), "anchors")
    probed = packed.join(one, "chunk", "left")
    two = C.back(probed.mapInArrow(tidy(windows), _VALUES).groupBy("bucket").applyInArrow(_judge_windows, _JUDGED), "windows")
    return probed.join(two, "chunk", "left").mapInArrow(tidy(finish), schema)


def _kept(column, data, offsets, starts, ends, first, gone) -> list[pa.Array]:
    """The added columns of one chunk."""
    kept = np.flatnonzero(~gone)
    mask = np.zeros(len(data) + 1, np.int8)
    np.add.at(mask, starts[kept], 1)
    np.add.at(mask, ends[kept], -1)
    mask = np.cumsum(mask[:-1], dtype=np.int8).astype(bool)
    joined = data.copy()
    text = np.searchsorted(first, kept, side="right") - 1
    inner = ends[kept[:-1][text[:-1] == text[1:]]]  # another kept word of the text follows
    joined[inner], mask[inner] = 32, True
    place = np.append(0, np.cumsum(mask))[offsets]
    joined = joined[mask].tobytes()
    lost = np.append(0, np.cumsum(gone))[first]
    texts, n_removed = column.to_pylist(), np.diff(lost)
    plain = [joined[a:b] for a, b in zip(place[:-1], place[1:])]
    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    opens, closes = turns[::2], turns[1::2]
    spans = [[] for _ in texts]
    for a, b in zip(opens.tolist(), closes.tolist()):  # a run may pass from one text to the next
        t = int(np.searchsorted(first, a, side="right")) - 1
        while a < b:
            stop = min(b, int(first[t + 1]))
            if stop > a:
                spans[t].append({"start": a - int(first[t]), "end": stop - int(first[t])})
            a, t = max(a, stop), t + 1
    return [
        pa.array([t if not n else p.decode() for t, n, p in zip(texts, n_removed, plain)], pa.string()), pa.array(np.diff(first), pa.int64()), pa.array(n_removed, pa.int64()),
        pa.array([hashlib.sha256(p).hexdigest() for p in plain], pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("removed").alias("n_spans"))


OP1_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
g AS (SELECT r, i, array_to_string(ws[i:i+34], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
d AS (SELECT r, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
m AS (SELECT r, list(i) AS starts FROM d GROUP BY r),
t AS (SELECT w.r, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
e AS (SELECT DISTINCT r, i + k AS p FROM d, range(35) AS s(k)),
k AS (SELECT t.r, count(*) FILTER (e.p IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY t.p) FILTER (e.p IS NULL) AS kept,
  count(*) FILTER (e.p IS NOT NULL AND b.p IS NULL) AS n_spans
  FROM t LEFT JOIN e ON t.r = e.r AND t.p = e.p LEFT JOIN e b ON t.r = b.r AND t.p = b.p + 1 GROUP BY t.r)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0)::INTEGER AS n_spans
FROM w LEFT JOIN k USING (r)
"""
