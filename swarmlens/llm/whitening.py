"""Whitening of embedding vectors from one pass of mergeable statistics.

Every component c of a vector becomes the integer x = floor(256 * c).  The fit list
holds each distinct x vector once.  Each of its partitions computes its count, exact
sums, local mean and centred scatter, batch by batch; ``merged`` joins two of them by
the pairwise formula (the scatters plus the outer product of the difference of means,
weighted by n1 * n2 / n), and treeReduce joins all, so that no task and no step of the
driver sees more than matrices of the vectors' own length.  The eigenvectors of the
covariance are found on the driver; a second pass over the fit list measures the
covariance of what was whitened by the same merging, and its largest distance from the
identity is given out with every row.

Defined cases: rows whose vector is null or holds null or non-finite components are
dropped; vectors of each length are whitened among their own length (``n`` and all
else are of that length), and one of no components gives no row; components numbered
beyond the length do not exist; a component without variance (a single distinct
vector, or a constant direction) has whitened 0, its ``explained`` is 0 if no direction
varies, and identity_error then shows the missing variance; products beyond 64 bits
leave ``deviation`` null; repeated rows and ids each give their rows; a null id stays;
an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 4
_RESULT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows with finite components only, as integers."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where("v IS NOT NULL AND size(v) > 0 AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * 256)).alias("x"))


def by_length(column) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a column of lists, for each length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(column.value_lengths())
    out = []
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        out.append((at, np.asarray(column.take(pa.array(at)).flatten()).reshape(-1, size)))
    return out


def summary(y: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred scatter of the rows of ``y``."""
    mean = y.mean(axis=0)
    centred = y - mean
    return len(y), mean, centred.T @ centred


def merged(a: tuple, b: tuple) -> tuple:
    """Count, mean and centred scatter of two disjoint sets of rows."""
    n = a[0] + b[0]
    apart = b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _joined(a: dict, b: dict) -> dict:
    """The summaries of every length of either side: (summary, exact sums)."""
    out = dict(a)
    for size, (other, sums) in b.items():
        out[size] = (merged(out[size][0], other), [p + q for p, q in zip(out[size][1], sums)]) if size in out else (other, sums)
    return out


def statistics(fit: DataFrame, change=lambda size, x: x.astype(np.float64)) -> dict:
    """{length: ((count, mean, scatter) of ``change(length, x)``, exact sums of x)} over the rows of ``fit``."""

    def local(batches):
        here: dict = {}
        for batch in batches:
            for _, x in by_length(batch.column("x")):
                size = x.shape[1]
                most = int(np.abs(x).max())
                sums = x.sum(axis=0).tolist() if most < (1 << 62) // max(1, len(x)) else [sum(column) for column in x.T.tolist()]
                here = _joined(here, {size: (summary(change(size, x)), sums)})
        for size, ((n, mean, scatter), sums) in here.items():
            yield pa.RecordBatch.from_pydict({"size": pa.array([size], pa.int32()), "n": pa.array([n], pa.int64()), "mean": [mean.tobytes()], "scatter": [scatter.tobytes()], "sums": [[str(s) for s in sums]]})

    def unpacked(r) -> dict:
        mean = np.frombuffer(r["mean"])
        return {r["size"]: ((r["n"], mean, np.frombuffer(r["scatter"]).reshape(len(mean), -1)), [int(s) for s in r["sums"]])}

    parts = fit.mapInArrow(local, "size int, n bigint, mean binary, scatter binary, sums array<string>").rdd.map(unpacked)
    return parts.treeReduce(_joined, depth=3) if not fit.isEmpty() else {}


def axes(n: int, scatter: np.ndarray, components: int) -> dict:
    """The first components of a covariance: unit vectors (columns), eigenvalues and their share of the trace."""
    covariance = scatter / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float(np.trace(covariance))
    flat = values <= max(trace, 0.0) * len(covariance) * np.finfo(float).eps  # rounding only
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)  # one of the two signs
    scale = np.where(flat, 0.0, 1 / np.sqrt(np.where(flat, 1.0, values)))
    return {"vectors": vectors, "scale": scale, "explained": np.where(flat, 0.0, values) / trace if trace > 0 else 0 * values}


def _projected(model: dict, x: np.ndarray) -> np.ndarray:
    """x - S / n on each component over the root of its eigenvalue; n * x - S is exact before it is divided."""
    n, sums = model["n"], model["sums"]
    apart = x * np.int64(n) - sums if model["narrow"] else (x.astype(object) * n - np.array(model["exact"], object)).astype(np.float64)
    return (apart / n) @ model["vectors"] * model["scale"]


def _deviation(model: dict, x: np.ndarray) -> pa.Array:
    """The exact sum over dimensions of (n * x - S)^2; null beyond 64 bits."""
    if model["narrow"]:
        apart = x * np.int64(model["n"]) - model["sums"]
        if int(np.abs(apart).max(initial=0)) ** 2 * x.shape[1] < 1 << 63:
            return pa.array((apart * apart).sum(axis=1), pa.int64())
    apart = x.astype(object) * model["n"] - np.array(model["exact"], object)
    return pa.array([s if (s := sum(c * c for c in row)) < 1 << 63 else None for row in apart.tolist()], pa.int64())


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict:
    """{length: model}: the statistics of ``fit`` (x), its components, and how far what they whiten is from the identity."""
    models = {}
    for size, ((n, _, scatter), sums) in statistics(fit).items():
        far = max(abs(s) for s in sums)
        models[size] = axes(n, scatter, components) | {"n": n, "exact": sums, "sums": np.array(sums if far < 1 << 62 else [0] * size, np.int64), "narrow": False}
    widest = {r["size"]: r["most"] for r in fit.groupBy(F.size("x").alias("size")).agg(F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("most")).collect()}  # a row a length
    for size, m in models.items():
        m["narrow"] = 2 * widest[size] * m["n"] < 1 << 62
    shared = fit.sparkSession.sparkContext.broadcast(models)  # matrices of a length by the number of components
    for size, ((n, _, scatter), _) in statistics(fit, lambda size, x: _projected(shared.value[size], x)).items():
        models[size]["identity_error"] = float(np.abs(scatter / n - np.eye(len(scatter))).max())
    return models


def whiten(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every vector and its first components."""
    rows = integers(vectors, vec_id, vector)
    fit = rows.select("x").distinct().checkpoint()  # equal vectors are merged before they are shuffled
    models = fitted(fit, components)
    shared = vectors.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            ids = batch.column("vec_id")
            for at, x in by_length(batch.column("x")):
                m = shared.value[x.shape[1]]
                k = len(m["scale"])
                repeated = pa.array(np.repeat(np.arange(len(at)), k))
                full = lambda value, kind: pa.array(np.full(len(at) * k, value), kind)
                columns = [ids.take(pa.array(at)).take(repeated), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), full(m["n"], pa.int64()), _deviation(m, x).take(repeated), pa.array(_projected(m, x).ravel()), pa.array(np.tile(m["explained"], len(at))), full(m["identity_error"], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _RESULT.split(", ")])

    return rows.mapInArrow(run, _RESULT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
