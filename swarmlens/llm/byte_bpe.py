"""Byte-level BPE encoding and decoding with a public vocabulary.

Text is cut by the vocabulary's pattern; the distinct pieces of each megabyte of an Arrow batch
that are new to the worker are encoded together by the ``tokenizers``
library, whose BPE model is built from the rank file through the byte-to-character
table, and a bounded cache holds their ids.  Every pair of ranked tokens whose
joined bytes are ranked is a merge of that rank, so the ids are those of a plain
rank merger.  Offsets are those that the library gives for a piece, moved to the
piece's place in the text.  Decoding looks up each id's characters in the library's
vocabulary and takes them back to bytes through the reversed byte table; bytes of
a character that a cut through the ids has split decode to U+FFFD in text, while
``decode`` gives the bytes as they are, so the halves join again.

Defined cases: null text is empty text (no ids, empty bytes); an empty table
gives an empty table; repeated rows are encoded each for themselves; input
columns named like an output are replaced; no special tokens are ever produced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from swarmlens.llm.text_arrays import slices, tidy

#: Pieces kept during a task; the cache starts anew when it is full.
CACHE_PIECES = 3 << 17
#: Pieces of more characters than this do not stay in it.
CACHE_BYTES = 256


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: its own where Latin-1 prints it, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    fresh = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(fresh)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder over one rank file."""

    def __init__(self, path: str, pattern: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        table = byte_characters()
        shown = {token: "".join(table[b] for b in token) for token in ranks}
        merges = []
        for token in sorted(ranks, key=ranks.get):
            merges += [(shown[token[:i]], shown[token[i:]]) for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
        self.model = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=merges, cache_capacity=0, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        back = {c: b for b, c in enumerate(table)}
        words = self.model.get_vocab(with_added_tokens=False)
        self.tokens = [b""] * (max(words.values()) + 1)
        for word, n in words.items():
            self.tokens[n] = bytes(map(back.__getitem__, word))
        # the vocabulary's library takes \s as the Unicode property
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as little-endian unsigned 32-bit arrays."""
        cut = [self.pieces.findall(t) for t in texts]
        if len(self.cache) > CACHE_PIECES:
            self.cache.clear()
        new = list(set().union(*cut).difference(self.cache))
        for a in range(0, len(new), 20_000):
            self.cache.update(zip(new[a : a + 20_000], (np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(new[a : a + 20_000], add_special_tokens=False))))
        out = [np.frombuffer(b"".join(map(self.cache.__getitem__, pieces)), "<u4") for pieces in cut]
        for p in new:
            if len(p) > CACHE_BYTES:
                del self.cache[p]
        return out

    def offsets(self, texts: list[str]) -> list[np.ndarray]:
        """The character of its text at which each id starts, as the library gives it; ids inside one character share its index."""
        cut = [[(m.start(), m.group()) for m in self.pieces.finditer(t)] for t in texts]
        new = list({p for pieces in cut for _, p in pieces})
        starts = {p: np.array([a for a, _ in e.offsets], np.int64) for p, e in zip(new, self.model.encode_batch(new, add_special_tokens=False))}
        return [np.concatenate([np.zeros(0, np.int64), *(starts[p] + a for a, p in pieces)]) for pieces in cut]

    def decode(self, ids) -> bytes:
        """The bytes of the ids: their characters through the reversed byte table, taken back when the vocabulary was read."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


@functools.lru_cache(2)
def load(path: str | None = None, pattern: str | None = None) -> ByteBpe:
    """The encoder of a vocabulary, once for each Python worker."""
    return ByteBpe(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, text: str = "text", with_offsets: bool = False, with_ids: bool = True, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with n_tokens, ids_sha256 (little-endian 32-bit), decoded_sha256 and, if asked for, ids and offsets."""
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids + [T.StructField("offsets", T.ArrayType(T.LongType()))] * with_offsets
    docs = docs.drop(*[f.name for f in added])
    names = [*docs.columns, *[f.name for f in added]]

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                texts = [t or "" for t in part.column(text).to_pylist()]
                ids = bpe.encode(texts)
                decoded = [bpe.decode(x) for x in ids]
                out = [pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                if with_ids:
                    out.append(pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())))
                if with_offsets:
                    out.append(pa.array(bpe.offsets(texts), pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays([*part.columns, *out], names=names)
        bpe.cache.clear()  # the worker may serve other stages next

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, *added]))


def decode_documents(encoded: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``encoded`` with decoded_text; null ids give null, bytes that are no character give U+FFFD."""

    def run(batches):
        bpe = load(path, pattern)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded_text"])

    encoded = encoded.drop("decoded_text")
    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded_text", T.StringType())]))


def op2_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_documents(docs, with_ids=False).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
