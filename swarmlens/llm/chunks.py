"""Chunk tables: whole documents packed into rows of a few MB, and verdicts sent back to them.

Operators that ask "does this value occur elsewhere in the corpus" pack the
documents once into compressed chunks, send each chunk's sorted distinct values
to hash-range buckets, judge every bucket on its own, and send one bit (or
number) per value back in the same order.  A value that a third of the corpus
holds costs one entry per chunk, not one per occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.llm.text_arrays import slices, tidy

CHUNK_BYTES = 4 << 20


def partitions(df: DataFrame) -> int:
    """Partitions for what follows: never fewer than the session's or than the input's splits."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def pack(docs: DataFrame, text: str, chunk_bytes: int, parts: int) -> DataFrame:
    """Rows (chunk, blob): about ``chunk_bytes`` of text each, as compressed Arrow streams."""

    def run(batches):
        task, n, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for x in held:
                    out.write_batch(x)
            return pa.RecordBatch.from_pydict({"chunk": pa.array([task << 32 | n], pa.int64()), "blob": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

        for batch in batches:
            for part in slices(batch, text, chunk_bytes):
                if held and size + part.nbytes > 1.2 * chunk_bytes:
                    yield flush()
                    n, held, size = n + 1, [], 0
                held.append(part)
                size += part.nbytes
        if held:
            yield flush()

    return docs.mapInArrow(tidy(run), "chunk bigint, blob binary").repartition(parts, "chunk")


def unpack(blob: bytes) -> pa.RecordBatch:
    table = pa.ipc.open_stream(pa.py_buffer(blob)).read_all().combine_chunks()
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=table.schema)


def rows_of(batch: pa.RecordBatch):
    """A batch's rows as dicts, one at a time: a chunk is a few MB."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def edges(buckets: int, bits: int) -> np.ndarray:
    """Lower bounds of the equal ranges of [0, 2**bits), for contiguous slices of sorted values."""
    return np.array([-(-(b << bits) // buckets) for b in range(buckets)], np.uint64)


def cut(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """buckets + 1 positions at which the sorted values pass from bucket to bucket."""
    return np.append(np.searchsorted(values, edges(buckets, bits)), len(values))


def put_sorted(values: np.ndarray) -> bytes:
    """Sorted distinct unsigned values as gaps of four bytes each where they fit."""
    if not len(values):
        return b""
    gaps = np.diff(values)
    small = not len(gaps) or int(gaps.max()) < 1 << 32
    return (b"\0" if small else b"\1") + values[:1].tobytes() + gaps.astype(np.uint32 if small else np.uint64).tobytes()


def get_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    gaps = np.frombuffer(blob, np.uint64 if blob[0] else np.uint32, offset=9)
    out = np.empty(len(gaps) + 1, np.uint64)
    out[0] = np.frombuffer(blob, np.uint64, 1, 1)[0]
    out[1:] = gaps
    return np.cumsum(out, dtype=np.uint64)


def put_bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def get_bits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def back(verdicts: DataFrame, name: str) -> DataFrame:
    """One row for each chunk with its buckets' verdicts."""
    return verdicts.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bucket", "n", "bits"))).alias(name))


def verdict_bits(parts) -> np.ndarray:
    """All buckets' verdicts of a chunk, in the order of its sorted values."""
    parts = sorted(parts or [], key=lambda x: x["bucket"])
    return np.concatenate([get_bits(x["bits"], x["n"]) for x in parts]) if parts else np.zeros(0, bool)
