"""Language-model scoring by logistic context mixing.

Text is predicted bit by bit: five contexts (the last one to five bytes and the
bits of the byte so far) each hold exact counts of zeros and ones; their
stretched probabilities are mixed in the logistic domain by weights that a gate
selects (the place in the word, how often the contexts of three and five bytes were
seen, and the bit's place); an adaptive map by bit place and mixed probability
refines the result.  Minus the base-2 logarithms of the bits' probabilities add up
to the text's bits.  Gate and smoothing were chosen on a fifth of the training
texts (crc32 mod 5 is 2), never on held-out ones.

Counts come from every training text and grow with it: each chunk's distinct
six-byte strings (context and byte) with their numbers go to buckets by the three
bytes before the last, so that a bucket holds its contexts of three bytes and more
whole and counts them without collisions; contexts of one and two bytes are
counted over all buckets (at most 2**24 three-byte strings).  The mixing weights
and the map (some thousands of numbers) are learned in rounds over all strings of
all buckets, each by its number and with one own occurrence taken out.  A bucket
scores each of its strings once and sends the bits back to the chunks that asked,
in their order.

The unigram base needs the corpus count of every token: chunks send their
distinct tokens to hash buckets and get the counts back in the same order.

Defined cases: null text is empty text, whose only token is the end; without
training rows every bit costs one bit and the base score is 0; repeated rows
count and score each for themselves; a null id is hashed as the empty string;
input columns named like an output are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swarmlens.llm import chunks as C
from swarmlens.llm.session import fresh
from swarmlens.llm.text_arrays import mix, span_hashes, text_bytes, tidy, word_spans

#: Bytes of context of each predictor.
ORDERS = (1, 2, 3, 4, 5)
INPUTS = len(ORDERS) + 1
#: Tasks that add up the three-byte strings.
SLICES = 16


def _lower(data: np.ndarray) -> np.ndarray:
    return data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The six-byte string that ends at each byte of each text and at its end mark, and where each text's begin.

    Five zero bytes stand before a text, one after it.
    """
    texts = len(offsets) - 1
    shift = np.repeat(5 + 6 * np.arange(texts), np.diff(offsets))
    buffer = np.zeros(len(data) + 6 * texts, np.uint8)
    shift += np.arange(len(data))
    buffer[shift] = data
    del shift
    code = buffer.astype(np.uint64)
    for j in range(1, 6):
        code[j:] |= buffer[:-j].astype(np.uint64) << np.uint64(8 * j)
    keep = np.ones(len(buffer), bool)
    start = offsets[:-1] + 6 * np.arange(texts)
    for j in range(5):
        keep[start + j] = False
    return code[keep], offsets[:-1] + np.arange(texts)


def _bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each string by the three bytes before its last: whole contexts of three and more bytes are in one."""
    return (mix(codes >> np.uint64(8) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _add_up(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct codes and the sums of their counts."""
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    at = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat(counts, at) if len(at) else counts


def _nodes(codes: np.ndarray, counts: np.ndarray, o: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bit of the codes' last bytes (a row) and each code: zeros and ones after its last ``o`` bytes and the bits before."""
    masked = codes & np.uint64((1 << 8 * (o + 1)) - 1)
    order = np.argsort(masked, kind="stable")
    masked, counts = masked[order], counts[order]
    zeros, ones = np.zeros((8, len(codes)), np.int64), np.zeros((8, len(codes)), np.int64)
    for b in range(8 if len(codes) else 0):
        node = masked >> np.uint64(8 - b)
        new = np.append(True, node[1:] != node[:-1])
        at, group = np.flatnonzero(new), np.cumsum(new) - 1
        bit = (masked >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
        n1, n = np.add.reduceat(counts * bit, at), np.add.reduceat(counts, at)
        ones[b, order], zeros[b, order] = n1[group], (n - n1)[group]
    return zeros, ones


def _counts(low: tuple[np.ndarray, np.ndarray], codes: np.ndarray, counts: np.ndarray):
    """For each bit: its place, the bit, and for each order the zeros and ones of each code (all strings of a bucket).

    Orders 1 and 2 come from ``low``, the corpus count of every three-byte string.
    """
    every = []
    triples = np.unique(codes & np.uint64(0xFFFFFF))
    pairs = np.unique(triples >> np.uint64(8))
    for o in (1, 2):
        mask = np.uint64((1 << 8 * (o + 1)) - 1)
        some = slice(None) if o == 1 else np.isin(low[0] >> np.uint64(8), pairs)
        table, sums = _add_up(np.append(low[0][some], triples) & mask, np.append(low[1][some], np.zeros(len(triples), np.int64)))
        at = np.searchsorted(table, codes & mask)
        every.append(tuple(n[:, at] for n in _nodes(table, sums, o)))
    every += [_nodes(codes, counts, o) for o in ORDERS[2:]]
    for b in range(8):
        bit = (codes >> np.uint64(7 - b) & np.uint64(1)).astype(np.int64)
        yield b, bit, [n[0][b] for n in every], [n[1][b] for n in every]


#: Steps of the gate: how often the contexts of three and five bytes were seen.
_STEPS = {2: (1, 3, 11, 101), 4: (1, 2, 4, 16)}
_GATES = 6 * 5 * 5 * 8


def _places(codes: np.ndarray) -> np.ndarray:
    """How many bytes of its word stand before each code's last byte, five at most."""
    out, open_ = np.zeros(len(codes), np.int64), np.ones(len(codes), bool)
    for k in range(1, 6):
        byte = codes >> np.uint64(8 * k) & np.uint64(255)
        open_ &= (byte != 32) & ((byte < 9) | (byte > 13)) & (byte != 0)
        out += open_
    return out


_LEVELS = {o: np.searchsorted(steps, np.arange(max(steps) + 1), side="right") for o, steps in _STEPS.items()}


def _features(zeros: list[np.ndarray], ones: list[np.ndarray], b: int, place: np.ndarray):
    """Inputs of the mixer (stretched probabilities of all orders and a constant) and the gate."""
    x = np.empty((len(zeros[0]), INPUTS))
    gate = place
    for o, (n0, n1) in enumerate(zip(zeros, ones)):
        np.subtract(np.log(n1 + 0.1), np.log(n0 + 0.1), out=x[:, o])
        if o in _LEVELS:
            gate = gate * 5 + _LEVELS[o][np.minimum(n0 + n1, len(_LEVELS[o]) - 1)]
    x[:, INPUTS - 1] = 0.3
    return x, gate * 8 + b


def _squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _refine(model: dict, mixed: np.ndarray, b: int) -> np.ndarray:
    place = np.clip((mixed + 8) * 2, 0, 31.999)
    low = place.astype(np.int64)
    part = place - low
    return 0.5 * _squash(mixed) + 0.5 * (model["map"][b, low] * (1 - part) + model["map"][b, low + 1] * part)


def _examples(low, codes: np.ndarray, counts: np.ndarray, some: np.ndarray):
    """For each bit the inputs, gate, bit and weight of ``some`` of a bucket's strings, each with one of its own occurrences taken out."""
    place = _places(codes[some])
    for b, bit, zeros, ones in _counts(low, codes, counts):
        bit = bit[some]
        x, gate = _features([np.maximum(n[some] - (1 - bit), 0) for n in zeros], [np.maximum(n[some] - bit, 0) for n in ones], b, place)
        yield x, gate, bit, counts[some].astype(float)


#: Places of the symmetric matrix of the inputs.
_ROWS, _COLS = np.triu_indices(INPUTS)
#: Passes over all strings that fit the weights, and the pull of a gate's weights to their start, in occurrences.
ROUNDS, PULL = 6, 1.0


def _start() -> np.ndarray:
    weights = np.full((_GATES, INPUTS), 0.25)
    weights[:, INPUTS - 1] = 0
    return weights


def _slopes(weights: np.ndarray, x, gate, bit, weight) -> np.ndarray:
    """For each gate the loss, its slope and its curvature at the weights, summed over the examples."""
    mixed = np.einsum("ij,ij->i", weights[gate], x)
    p = _squash(mixed)
    error, curve = (bit - p) * weight, p * (1 - p) * weight
    loss = weight * np.logaddexp(0, np.where(bit == 1, -mixed, mixed))
    columns = [loss, *(error * x[:, o] for o in range(INPUTS)), *(curve * x[:, i] * x[:, j] for i, j in zip(_ROWS, _COLS))]
    return np.stack([np.bincount(gate, c, _GATES) for c in columns], axis=1)


def _hits(weights: np.ndarray, x, gate, bit, weight) -> np.ndarray:
    """For each bit place and step of the map: the ones and all."""
    mixed = np.einsum("ij,ij->i", weights[gate], x)
    place = gate % 8 * 33 + np.clip((mixed + 8) * 2 + 0.5, 0, 32).astype(np.int64)
    return np.stack([np.bincount(place, weight * bit, 264), np.bincount(place, weight, 264)], axis=1)


def _summed(strings: DataFrame, shared, weights: np.ndarray, judge) -> np.ndarray:
    """``judge`` over every training string of every bucket, summed: partitions first, then slices of the small array."""

    def run(batches):
        total = 0
        for batch in batches:
            for row in C.rows_of(batch):
                codes, counts = _get(row["codes"], row["n"], np.uint64), _get(row["counts"], row["n"], np.int64)
                some = np.flatnonzero(counts)
                for example in _examples(shared.value, codes, counts, some):
                    total = total + judge(weights, *example)
        if np.ndim(total):
            parts = np.array_split(total, 8)
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(8), pa.int32()), "sums": pa.array([x.tobytes() for x in parts], pa.binary())})

    def add(table):
        return pa.table({"slice": table["slice"][:1], "sums": pa.array([sum(np.frombuffer(x, float) for x in table["sums"].to_pylist()).tobytes()], pa.binary())})

    rows = strings.mapInArrow(tidy(run), "slice int, sums binary").groupBy("slice").applyInArrow(add, "slice int, sums binary").collect()  # eight rows of fixed size
    return np.concatenate([np.frombuffer(r["sums"], float) for r in sorted(rows, key=lambda r: r["slice"])])


def _fit_mixer(strings: DataFrame, shared, rounds: int = ROUNDS) -> dict:
    """Weights and map, learned over all strings by their numbers.

    A round sums each gate's slope and curvature over all buckets and takes a
    Newton step; where the loss has grown, the step is taken back to a quarter.
    """
    start = _start()
    weights, best, least, step = start, start, np.full(_GATES, np.inf), np.zeros(start.shape)
    for _ in range(rounds):
        sums = _summed(strings, shared, weights, _slopes).reshape(_GATES, -1)
        loss = sums[:, 0] + PULL / 2 * ((weights - start) ** 2).sum(axis=1)
        good = loss <= least
        curve = np.zeros((_GATES, INPUTS, INPUTS))
        curve[:, _ROWS, _COLS] = curve[:, _COLS, _ROWS] = sums[:, INPUTS + 1 :]
        slope = sums[:, 1 : INPUTS + 1] - PULL * (weights - start)
        newton = np.linalg.solve(curve + PULL * np.eye(INPUTS), slope[:, :, None])[:, :, 0]
        best, least = np.where(good[:, None], weights, best), np.where(good, loss, least)
        step = np.where(good[:, None], newton, step / 4)
        weights = best + step
    prior = _squash((np.arange(33) / 2 - 8))[None, :].repeat(8, 0).ravel()
    hits, size = _summed(strings, shared, best, _hits).reshape(264, 2).T
    return {"weights": best, "map": ((hits + 20 * prior) / (size + 20)).reshape(8, 33)}


def bits_of(model: dict | None, codes: np.ndarray) -> np.ndarray:
    """Base-2 logarithm of the probability of each code's last byte after its other five."""
    if model is None:
        return np.full(len(codes), -8.0)
    wanted = np.unique(_bucket(codes, model["buckets"])).tolist()
    rows = model["strings"].where(F.col("bucket").isin(wanted)).collect()  # the buckets of the codes asked for
    held = [_get(r["codes"], r["n"], np.uint64) for r in rows] + [codes]
    counts = [_get(r["counts"], r["n"], np.int64) for r in rows] + [np.zeros(len(codes), np.int64)]
    values, counts = _add_up(np.concatenate(held), np.concatenate(counts))
    return _bits(model, values, counts)[np.searchsorted(values, codes)]


def _bits(model: dict, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """bits_of all strings of a bucket."""
    total = np.zeros(len(codes))
    place = _places(codes)
    for b, bit, zeros, ones in _counts(model["low"], codes, counts):
        x, gate = _features(zeros, ones, b, place)
        p = np.clip(_refine(model, np.einsum("ij,ij->i", model["weights"][gate], x), b), 1 / 65536, 1 - 1 / 65536)
        total += np.log2(np.where(bit == 1, p, 1 - p))
    return total


def _put(x: np.ndarray) -> bytes:
    """Compressed by byte planes: sorted codes and small counts have long runs there."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _get(blob: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(pa.decompress(bytes(blob), n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T).view(kind).ravel()


def _dealt_codes(codes: np.ndarray, buckets: int):
    """A chunk's distinct strings in order of bucket and value, and where each bucket's begin."""
    bucket = _bucket(codes, buckets)
    order = np.lexsort((codes, bucket))
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def gather(packed: DataFrame, text: str, train: str, buckets: int) -> DataFrame:
    """(bucket, chunk, n, codes, counts): each chunk's distinct six-byte strings and how often its training rows hold them."""

    def send(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                part = C.unpack(blob.as_py())
                data, offsets = text_bytes(part.column(text))
                found = pa.array(_grams(_lower(data), offsets)[0]).dictionary_encode()
                codes, ids = found.dictionary.to_numpy(), found.indices.to_numpy(zero_copy_only=False)
                mine = np.repeat(np.asarray(part.column(train).to_pylist(), bool), np.diff(offsets) + 1)
                counts = np.bincount(ids[mine], minlength=len(codes)).astype(np.uint32)
                order, cuts = _dealt_codes(codes, buckets)
                codes, counts = codes[order], counts[order]
                full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                squeezed = lambda x: pa.array([_put(x[cuts[b] : cuts[b + 1]]) for b in full], pa.binary())
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "n": pa.array([int(cuts[b + 1] - cuts[b]) for b in full], pa.int32()), "codes": squeezed(codes), "counts": squeezed(counts)})

    sent = packed.mapInArrow(tidy(send), "bucket int, chunk bigint, n int, codes binary, counts binary")
    return sent.repartition(buckets, "bucket").checkpoint()


def _merged(table: pa.Table):
    """All strings that chunks sent to a bucket, and their corpus counts."""
    rows = table.select(["n", "codes", "counts"]).to_pylist()
    sent = np.concatenate([_get(r["codes"], r["n"], np.uint64) for r in rows])
    return sent, *_add_up(sent, np.concatenate([_get(r["counts"], r["n"], np.uint32) for r in rows]).astype(np.int64))


def merge(sent: DataFrame) -> DataFrame:
    """(bucket, n, codes, counts): a row for each bucket with its distinct strings and their counts."""

    def add(table):
        _, codes, counts = _merged(table)
        return pa.table({"bucket": table["bucket"][:1], "n": pa.array([len(codes)], pa.int32()), "codes": pa.array([_put(codes)], pa.binary()), "counts": pa.array([_put(counts)], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(add, "bucket int, n int, codes binary, counts binary").checkpoint()


def _triples(strings: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every three-byte string that ends a string, with its count; at most 2**24, whatever the corpus."""

    def send(batches):
        for batch in batches:
            for row in C.rows_of(batch):
                codes, counts = _get(row["codes"], row["n"], np.uint64), _get(row["counts"], row["n"], np.int64)
                codes, counts = _add_up(codes[counts > 0] & np.uint64(0xFFFFFF), counts[counts > 0])
                part = (codes % np.uint64(SLICES)).astype(np.int64)
                for i in np.unique(part).tolist():
                    at = part == i
                    yield pa.RecordBatch.from_pydict({"slice": pa.array([i], pa.int32()), "n": pa.array([int(at.sum())], pa.int32()), "codes": pa.array([_put(codes[at])], pa.binary()), "counts": pa.array([_put(counts[at])], pa.binary())})

    def add(table):
        rows = table.to_pylist()
        codes, counts = _add_up(np.concatenate([_get(r["codes"], r["n"], np.uint64) for r in rows]), np.concatenate([_get(r["counts"], r["n"], np.int64) for r in rows]))
        return pa.table({"slice": table["slice"][:1], "n": pa.array([len(codes)], pa.int32()), "codes": pa.array([_put(codes)], pa.binary()), "counts": pa.array([_put(counts)], pa.binary())})

    kind = "slice int, n int, codes binary, counts binary"
    rows = strings.mapInArrow(tidy(send), kind).groupBy("slice").applyInArrow(add, kind).collect()  # SLICES rows
    if not rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return _add_up(np.concatenate([_get(r["codes"], r["n"], np.uint64) for r in rows]), np.concatenate([_get(r["counts"], r["n"], np.int64) for r in rows]))


def train_model(packed: DataFrame, text: str, train: str, buckets: int) -> dict | None:
    """The model over the training rows of packed chunks (see chunks.pack); its strings stay in their buckets."""
    sent = gather(packed, text, train, buckets)
    strings = merge(sent)
    low = _triples(strings)
    if not len(low[0]):
        return None
    shared = strings.sparkSession.sparkContext.broadcast(low)  # at most 2**24 numbers
    return {"sent": sent, "strings": strings, "buckets": buckets, "low": low} | _fit_mixer(strings, shared)


def answer(model: dict) -> DataFrame:
    """(chunk, bucket, n, bits): the bits of each chunk's strings, in the chunk's order."""
    shared = model["sent"].sparkSession.sparkContext.broadcast({k: model[k] for k in ("low", "weights", "map")})  # at most 2**24 numbers

    def add(table):
        sent, codes, counts = _merged(table)
        bits = _bits(shared.value, codes, counts).astype(np.float32)[np.searchsorted(codes, sent)]
        back = np.split(bits, np.cumsum(table["n"].to_numpy())[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "n": table["n"], "bits": pa.array([_put(x) for x in back], pa.binary())})

    return model["sent"].groupBy("bucket").applyInArrow(add, "chunk bigint, bucket int, n int, bits binary")


def _tokens(column):
    """A chunk's distinct tokens: data, offsets, first word of each text, id of each word, a span and the hash of each id."""
    data, offsets = text_bytes(column)
    data = _lower(data)
    starts, ends, first = word_spans(data, offsets)
    found = pa.array(span_hashes(data, starts, ends)).dictionary_encode()
    ids = found.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    one = np.zeros(len(found.dictionary), np.int64)
    one[ids[::-1]] = np.arange(len(ids))[::-1]
    return data, offsets, first, ids, starts[one], ends[one], found.dictionary.to_numpy()


def _dealt(hashes, buckets):
    """Bucket of each distinct token, and the tokens' order by bucket."""
    bucket = (hashes >> np.uint64(32)).astype(np.int64) % buckets
    return bucket, np.argsort(bucket, kind="stable")


def count_tokens(packed: DataFrame, text: str, train: str, buckets: int) -> DataFrame:
    """(chunk, bucket, n, bits, known, total): for each chunk's tokens their training counts, in the chunk's order.

    A bucket's first row also has its distinct training tokens (known) and all of them (total).
    """

    def send(batches):
        for batch in batches:
            for chunk, blob in zip(batch.column("chunk").to_pylist(), batch.column("blob")):
                part = C.unpack(blob.as_py())
                data, _, first, ids, starts, ends, hashes = _tokens(part.column(text))
                mine = np.repeat(np.asarray(part.column(train).to_pylist(), bool), np.diff(first))
                counts = np.bincount(ids[mine], minlength=len(starts))
                bucket, order = _dealt(hashes, buckets)
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                raw = data.tobytes()
                tokens = [raw[a:b] for a, b in zip(starts[order].tolist(), ends[order].tolist())]
                full = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
                texts = [b"\n".join(tokens[cuts[b] : cuts[b + 1]]) for b in full]
                yield pa.RecordBatch.from_pydict({
                    "bucket": pa.array(full, pa.int32()), "chunk": pa.array([chunk] * len(full), pa.int64()), "n": pa.array([int(cuts[b + 1] - cuts[b]) for b in full], pa.int32()), "size": pa.array([len(t) for t in texts], pa.int32()),
                    "tokens": pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary()), "counts": pa.array([pa.compress(counts[order[cuts[b] : cuts[b + 1]]].astype(np.int64).tobytes(), "zstd", asbytes=True) for b in full], pa.binary()),
                })

    def add(table):
        rows = table.select(["n", "size", "tokens", "counts"]).to_pylist()
        # tokens hold no white space, so line feeds part them
        tokens = pc.list_flatten(pc.split_pattern(pa.array([pa.decompress(r["tokens"], r["size"], "zstd", asbytes=True) for r in rows], pa.large_binary()), b"\n"))
        counts = np.concatenate([np.frombuffer(pa.decompress(r["counts"], r["n"] * 8, "zstd", asbytes=True), np.int64) for r in rows])
        ids = tokens.dictionary_encode().indices.to_numpy(zero_copy_only=False)
        total = np.bincount(ids, counts).astype(np.int64)
        known = int((total > 0).sum())
        back = np.split(total[ids], np.cumsum([r["n"] for r in rows])[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "n": table["n"], "bits": pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in back], pa.binary()), "known": pa.array([known if i == 0 else 0 for i in range(len(rows))], pa.int64()), "total": pa.array([int(counts.sum()) if i == 0 else 0 for i in range(len(rows))], pa.int64())})

    return packed.mapInArrow(tidy(send), "bucket int, chunk bigint, n int, size int, tokens binary, counts binary").groupBy("bucket").applyInArrow(add, "chunk bigint, bucket int, n int, bits binary, known bigint, total bigint")


def score_documents(docs: DataFrame, train: Column, text: str = "text", chunk_bytes: int = C.CHUNK_BYTES) -> DataFrame:
    """``docs`` with n_tokens, n_known, train_tokens, base_score, score and bits_per_byte; learned from the rows where ``train`` holds."""
    added = [T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()), ("bits_per_byte", T.DoubleType()))]
    docs = docs.drop(*[f.name for f in added])
    names, schema = [*docs.columns, *[f.name for f in added]], T.StructType([*docs.schema.fields, *added])
    (mark,) = fresh(docs, "_train")
    parts = C.partitions(docs)
    buckets = max(64, parts)
    packed = C.pack(docs.withColumn(mark, F.coalesce(train, F.lit(False))), text, chunk_bytes, parts).checkpoint()

    counted = count_tokens(packed, text, mark, buckets).checkpoint()
    distinct, n_words = (x or 0 for x in counted.agg(F.sum("known"), F.sum("total")).first())
    n_texts = docs.where(train).count()
    model = train_model(packed, text, mark, buckets)
    n, v = n_words + n_texts, distinct + (n_texts > 0)
    trained = model is not None

    def run(batches):
        for batch in batches:
            for row in C.rows_of(batch):
                part = C.unpack(row["blob"])
                data, offsets, first, ids, starts, _, hashes = _tokens(part.column(text))
                _, order = _dealt(hashes, buckets)
                count = np.zeros(len(starts), np.int64)
                if len(starts):
                    got = sorted(row["counts"], key=lambda x: x["bucket"])
                    count[order] = np.concatenate([np.frombuffer(pa.decompress(x["bits"], x["n"] * 8, "zstd", asbytes=True), np.int64) for x in got])
                low = n + 0.5 * (v + 1)
                value, known = np.log10((count + 0.5) / low)[ids], (count > 0)[ids]
                value, known = np.append(0, np.cumsum(value)), np.append(0, np.cumsum(known))
                base = np.array([value[b] - value[a] for a, b in zip(first[:-1], first[1:])]) + np.log10((n_texts + 0.5) / low)
                codes, at = _grams(data, offsets)
                found = pa.array(codes).dictionary_encode()
                bits = np.full(len(found.dictionary), -8.0)
                if trained and len(bits):
                    got = sorted(row["answers"], key=lambda x: x["bucket"])
                    bits[_dealt_codes(found.dictionary.to_numpy(), buckets)[0]] = np.concatenate([_get(x["bits"], x["n"], np.float32) for x in got])
                bits = bits[found.indices.to_numpy(zero_copy_only=False)]
                total = np.add.reduceat(bits, at)
                part = part.drop_columns([mark])
                size = np.diff(offsets) + 1
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(first) + 1, pa.int64()), pa.array(known[first[1:]] - known[first[:-1]] + int(n_texts > 0), pa.int64()), pa.array([n] * part.num_rows, pa.int64()), pa.array(base), pa.array(total * np.log10(2)), pa.array(-total / size)], names=names)

    back = counted.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("counts"))
    joined = packed.join(back, "chunk", "left")
    if trained:
        joined = joined.join(answer(model).groupBy("chunk").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias("answers")), "chunk", "left")
    return joined.mapInArrow(tidy(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept out of training (a null id counts as the empty string)."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1


def op7_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").withColumn("held_out", held_out())
    return score_documents(docs, ~F.col("held_out")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
