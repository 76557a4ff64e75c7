"""Language identification of whole and mixed-language texts.

Words are runs of letters with the marks that follow them.  The script of a word (by code point range) narrows
the languages to those seen in that script; a word's score under a language is
the mean over n-gram orders of its character n-grams' log probabilities; a
Viterbi pass with a penalty for every switch labels the words, so spans of
another language inside a text come out as such.  The text gets the language
that holds most of its letters; its score is that share of the letters.

Training counts cover every training row: each task adds its n-grams into tables
of fixed size (``slots`` per order and language), which are summed by slice and
collected; the model's size depends on ``slots`` and the number of languages alone.
Beyond ``MOST_LANGS`` languages each has as many fewer slots, so that the whole model stays of one size.

Defined cases: null text or text without letters gives ``und`` with score 0 and
no spans; rows without a language are not learned from; without any training row
everything is ``und``; ties go to the smaller language name; repeated rows count
as often as they occur; input columns named like an output are replaced.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmlens.llm.text_arrays import mix, slices, tidy

ORDERS = (2, 3, 4)
SLOTS = 1 << 15
MOST_LANGS = 256
SWITCH = 12.0
_SLICES = 16


_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: First code points of script ranges (fixed values of the Unicode blocks): Latin, Greek, Cyrillic,
#: Armenian, Hebrew, Arabic, other South Asian and South-East Asian, Georgian, Hangul, Ethiopic and
#: others, Latin and Greek additions, kana, Han, Hangul, all else.
_SCRIPTS = np.array([0x00, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xE00, 0x10A0, 0x1100, 0x1200, 0x1E00, 0x3040, 0x3400, 0xAC00, 0xD7B0])


class _Index(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _unique(texts):
    """The distinct words of an iterable of word lists, and each list as their numbers; no list is kept."""
    index = _Index()
    ids = [np.fromiter(map(index.__getitem__, t), np.int32, len(t)) for t in texts]
    return list(index), ids


def _grams(words: list[str], slots: int):
    """For each order: slots of all n-grams of the words and the word of each."""
    codes = np.frombuffer("".join(f"\n{w.lower()}\r" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 10) - 1
    out = []
    for n in ORDERS:
        if len(codes) < n:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        h = np.zeros(len(codes) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x100000001B3) + codes[j : len(codes) - n + 1 + j]
        inside = owner[: len(h)] == owner[n - 1 :]
        out.append(((mix(h[inside]) % np.uint64(slots)).astype(np.int64), owner[: len(h)][inside]))
    return out


def _script(words: list[str]) -> np.ndarray:
    return np.searchsorted(_SCRIPTS, np.array([ord(w[0]) for w in words], np.int64), side="right") - 1


def train(docs: DataFrame, text: str = "text", lang: str = "lang", slots: int = SLOTS) -> dict | None:
    """Log probabilities of n-gram slots by language and the scripts of each language; None without training rows."""
    n_langs = docs.select(lang).distinct().count()
    slots = max(64, slots >> max(0, math.ceil(math.log2(max(1, n_langs / MOST_LANGS)))))
    size = len(ORDERS) * slots + len(_SCRIPTS)
    width = -(-size // _SLICES)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, text, 4 << 20):
                langs = part.column(lang).to_pylist()
                words, ids = _unique(_WORDS.findall(t or "") for t in part.column(text).to_pylist())
                if not words:
                    for name in set(langs):
                        held.setdefault(name, np.zeros(size))
                    continue
                grams, script, letters = _grams(words, slots), _script(words), np.array([len(w) for w in words])
                for name in set(langs):
                    total = held.setdefault(name, np.zeros(size))
                    weight = np.bincount(np.concatenate([x for x, n in zip(ids, langs) if n == name]), minlength=len(words)).astype(float)
                    for k, (slot, owner) in enumerate(grams):
                        total[k * slots : (k + 1) * slots] += np.bincount(slot, weight[owner], slots)
                    total[len(ORDERS) * slots :] += np.bincount(script, weight * letters, len(_SCRIPTS))
        for name, total in held.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * _SLICES, pa.string()), "slice": pa.array(range(_SLICES), pa.int32()), "counts": pa.array([pa.compress(total[i * width : (i + 1) * width].astype(np.int64).tobytes(), "zstd", asbytes=True) for i in range(_SLICES)], pa.binary())})

    def length(i):
        return (min(size, (i + 1) * width) - i * width) * 8

    def add(table):
        i = table["slice"][0].as_py()
        total = sum(np.frombuffer(pa.decompress(c, length(i), "zstd", asbytes=True), np.int64) for c in table["counts"].to_pylist())
        return pa.table({"lang": table["lang"][:1], "slice": table["slice"][:1], "counts": pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())})

    kind = "lang string, slice int, counts binary"
    rows = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias(text), F.col(lang).alias(lang)).mapInArrow(tidy(count), kind)
    summed = rows.groupBy("lang", "slice").applyInArrow(add, kind).collect()  # the model: rows of one language and slice
    langs = sorted({r["lang"] for r in summed})
    if not langs:
        return None
    counts = np.zeros((size, len(langs)))
    for r in summed:
        i = r["slice"]
        counts[i * width : i * width + length(i) // 8, langs.index(r["lang"])] = np.frombuffer(pa.decompress(bytes(r["counts"]), length(i), "zstd", asbytes=True), np.int64)
    table = np.empty((len(ORDERS), slots, len(langs)), np.float32)
    for k in range(len(ORDERS)):
        c = counts[k * slots : (k + 1) * slots]
        table[k] = np.log((c + 0.5) / (c.sum(axis=0) + 0.5 * slots)) / len(ORDERS)
    script = counts[len(ORDERS) * slots :]
    allowed = script >= 0.01 * np.maximum(script.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return {"langs": langs, "table": table, "allowed": allowed, "slots": slots}


def word_scores(model: dict, words: list[str]) -> np.ndarray:
    """A row for each word with its score under each language."""
    out = np.zeros((len(words), len(model["langs"])), np.float32)
    for table, (slot, owner) in zip(model["table"], _grams(words, model["slots"])):
        if len(slot):
            values = table[slot]
            at = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[owner[at]] += np.add.reduceat(values, at)
    return np.where(model["allowed"][_script(words)], out, np.float32(-1e4)) if words else out


def viterbi(scores: np.ndarray, ids: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The best label of each word of each text, all texts advancing together word by word."""
    sizes = np.array([len(x) for x in ids])
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    if not len(order):
        return [np.zeros(0, np.int32) for _ in ids]
    size = sizes[order]
    flat = np.concatenate([ids[i] for i in order])
    start = np.cumsum(size) - size
    active = np.searchsorted(-size, -np.arange(size[0]), side="left")  # texts longer than each step
    stay = np.zeros((len(flat), scores.shape[1]), bool)
    best = np.zeros(len(flat), np.int32)
    state = scores[flat[start]].astype(np.float64)
    final = np.empty_like(state)
    for t in range(1, size[0]):
        k = active[t]
        if k < len(state):
            final[k : len(state)] = state[k:]
            state = state[:k]
        at = start[:k] + t
        top = state.max(axis=1, keepdims=True)
        best[at] = state.argmax(axis=1)
        keep = state >= top - switch
        stay[at] = keep
        state = np.where(keep, state, top - switch) + scores[flat[at]]
    final[: len(state)] = state
    labels = np.zeros(len(flat), np.int32)
    now = final.argmax(axis=1).astype(np.int32)
    for t in range(size[0] - 1, 0, -1):
        k = active[t]
        at = start[:k] + t
        labels[at] = now[:k]
        now[:k] = np.where(stay[at, now[:k]], now[:k], best[at])
    labels[start] = now
    out: list = [np.zeros(0, np.int32)] * len(ids)
    for i, a, n in zip(order, start, size):
        out[i] = labels[a : a + n]
    return out


def predict(docs: DataFrame, model: dict | None, text: str = "text", switch: float = SWITCH, with_spans: bool = False) -> DataFrame:
    """``docs`` with lang_pred, score and, if asked for, lang_spans (characters, end exclusive)."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())])
    added += [T.StructField("lang_spans", T.ArrayType(span))] * with_spans
    docs = docs.drop(*[f.name for f in added])
    names = [*docs.columns, *[f.name for f in added]]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(part):
        model, texts = shared.value, [t or "" for t in part.column(text).to_pylist()]
        words, ids = _unique(_WORDS.findall(t) if model else [] for t in texts)
        letters = np.array([len(w) for w in words])
        pred, score, spans = [], [], []
        for t, x, y in zip(texts, ids, viterbi(word_scores(model, words) if model else np.zeros((0, 1)), ids, switch)):
            share = np.bincount(y, letters[x]) if len(x) else np.zeros(1)
            pred.append(model["langs"][int(share.argmax())] if len(x) else "und")
            score.append(float(share.max() / share.sum()) if len(x) else 0.0)
            if with_spans:
                found = [m.span() for m in _WORDS.finditer(t)] if len(x) else []
                turns = np.flatnonzero(np.append(True, y[1:] != y[:-1])) if len(x) else []
                spans.append([{"start": found[a][0], "end": found[b - 1][1], "lang": model["langs"][y[a]]} for a, b in zip(turns, [*turns[1:], len(y)])])
        out = [pa.array(pred, pa.string()), pa.array(score, pa.float64())]
        if with_spans:
            out.append(pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))))
        return pa.RecordBatch.from_arrays([*part.columns, *out], names=names)

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, 8 << 20):
                yield label(part)

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
