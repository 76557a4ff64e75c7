"""Approximate nearest neighbours by learned partitions.

A bounded, hash-chosen sample (``sample`` rows) gives a neighbour graph; its nodes
are parted evenly so that few edges are cut (halving along principal directions,
then rounds of capacity-bound moves to the part most neighbours are in).  A small
classifier (one hidden layer) learns each vector's distribution over the parts of
its neighbours.  Every row is put into its most probable part; a query is routed
to its most probable parts and their rows are reranked by exact inner products in
double precision.

How many parts a query searches follows from ``target_recall``: at most ``trials``
rows are compared with all rows exactly, and the least number of parts that holds
this share of their nearest is taken.  Vectors with clusters need few parts,
isotropic ones, whose neighbours lie in every direction, many; nothing is tuned by
hand.  Queries that find fewer than k rows in their parts search all parts in a
second pass.

The index holds cells of neighbouring parts, cut into blocks of about ``block``
rows by hash: small parts share a block, a part that holds a third of all rows (one
vector many times) fills many.  A query is sent once to each cell that has one of
its parts, and is compared in its blocks with the rows of its parts only.

Defined cases: vectors that are null, zero, or hold null or non-finite components
take no part; vectors of another length are searched among their own length; rows
that repeat a query's id are its own; a repeated (id, vector) is one query, but
every row is a candidate; a null id is no query and ranks after all ids; an empty
table gives an empty table; other columns play no part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NEIGHBOURS, SAMPLE, BLOCK = 20, 16384, 4096
#: Share of the nearest that the searched parts are to hold, and the rows it is measured on.
TARGET_RECALL, TRIALS = 0.93, 512
_NONE = np.iinfo(np.int64).max


def _good(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return vectors.select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v")).where("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")


def _matrix(column, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def _graph(x: np.ndarray, k: int) -> np.ndarray:
    """Each row's k nearest others."""
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        near = x[a : a + 1024] @ x.T
        near[np.arange(len(near)), a + np.arange(len(near))] = -np.inf
        out[a : a + 1024] = np.argpartition(-near, k - 1, axis=1)[:, :k]
    return out


def _balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12) -> np.ndarray:
    """A part for each row, of nearly equal sizes, with few graph edges between parts."""
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        halves = []
        for g in groups:
            y = x[g] - x[g].mean(axis=0)
            axis = np.linalg.svd(y, full_matrices=False)[2][0] if len(g) > 1 else np.ones(x.shape[1])
            order = g[np.argsort(y @ axis, kind="stable")]
            halves += [order[: len(g) // 2], order[len(g) // 2 :]]
        groups = halves
    part = np.empty(len(x), np.int64)
    for p, g in enumerate(groups):
        part[g] = p
    most = math.ceil(1.05 * len(x) / parts) + 1
    sizes = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        pull = np.zeros((len(x), parts))
        np.add.at(pull, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1)
        np.add.at(pull, (graph.ravel(), np.repeat(part, graph.shape[1])), 1)
        best = pull.argmax(axis=1)
        gain = pull[np.arange(len(x)), best] - pull[np.arange(len(x)), part]
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[part[i]] -= 1
                sizes[best[i]] += 1
                part[i] = best[i]
    return part


def _train(x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 20) -> dict:
    """A classifier with one hidden layer, by Adam on cross entropy with soft targets."""
    random = np.random.Generator(np.random.PCG64(5))
    scale = 1 / max(1e-12, np.sqrt((x**2).mean()))
    x = x * scale
    w = [random.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), random.normal(0, hidden**-0.5, (hidden, target.shape[1])), np.zeros(target.shape[1])]
    m, v, t = [0 * a for a in w], [0 * a for a in w], 0
    for epoch in range(epochs):
        order = random.permutation(len(x))
        for a in range(0, len(x), 256):
            y, z = x[order[a : a + 256]], target[order[a : a + 256]]
            h = np.maximum(y @ w[0] + w[1], 0)
            o = h @ w[2] + w[3]
            o = np.exp(o - o.max(axis=1, keepdims=True))
            d = (o / o.sum(axis=1, keepdims=True) - z) / len(y)
            dh = (d @ w[2].T) * (h > 0)
            t += 1
            for i, g in enumerate([y.T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0)]):
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.001 * (g * g - v[i])
                w[i] -= 0.003 * (1 - epoch / epochs) * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return {"w": w, "scale": scale}


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    w = model["w"]
    return np.maximum(x * model["scale"] @ w[0] + w[1], 0) @ w[2] + w[3]


def fit(valid: DataFrame, parts: int, sample: int = SAMPLE, neighbours: int = 50) -> dict | None:
    """The classifier, fitted on the ``sample`` rows whose hashes are least."""
    rows = valid.orderBy(F.xxhash64("v", "id"), "id").select("id", "v").limit(sample).toArrow()
    if not rows.num_rows:
        return None
    dim = len(rows["v"][0])
    x, first = np.unique(_matrix(rows["v"], dim), axis=0, return_index=True)  # a vector that fills the sample teaches once
    ids = np.asarray(rows["id"].combine_chunks().fill_null(_NONE))[first]
    parts = max(1, min(parts, len(x) // 16 or 1))
    parts = 1 << int(math.log2(parts))
    model = {"dim": dim, "parts": parts, "trials": x, "trial_ids": ids}
    if parts == 1:
        return model
    graph = _graph(x, min(neighbours, len(x) - 1))
    part = _balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), part[graph.ravel()]), 1.0)
    target[np.arange(len(x)), part] += 1
    target /= target.sum(axis=1, keepdims=True)
    return model | _train(x, target)


def _routes(model: dict, x: np.ndarray) -> np.ndarray:
    """Each row's parts, the most probable first."""
    if model["parts"] == 1 or not len(x):
        return np.zeros((len(x), 1), np.int32)
    return np.argsort(-_logits(model, x), axis=1, kind="stable").astype(np.int32)


def _light(model: dict) -> dict:
    """What the executors need: the classifier without the sample it was fitted on."""
    return {k: v for k, v in model.items() if k not in ("trials", "trial_ids")}


def build_index(valid: DataFrame, model: dict) -> DataFrame:
    """``valid`` with part, every row in its most probable one, and a row number that deals repeated rows out."""
    shared = valid.sparkSession.sparkContext.broadcast(_light(model))

    def run(batches):
        m = shared.value
        for batch in batches:
            part = _routes(m, _matrix(batch.column("v"), m["dim"]))[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part, pa.int32())], names=["id", "v", "part"])

    return valid.mapInArrow(run, "id bigint, v array<double>, part int").withColumn("row", F.monotonically_increasing_id())


def _top(near: np.ndarray, k: int) -> np.ndarray:
    """Places that may be among the k best of a row of scores; rounding can only add some."""
    floor = np.partition(near, -k)[-k] if len(near) > k else -np.inf
    return np.flatnonzero((near >= floor - 1e-9 * abs(floor) - 1e-300 if np.isfinite(floor) else near >= floor) & (near > -np.inf))


def probes_for(index: DataFrame, model: dict, k: int, target: float, trials: int = TRIALS) -> int:
    """The least number of parts that hold the ``target`` share of the k nearest of ``trials`` sample rows, found by comparing them with all rows."""
    if model["parts"] == 1:
        return 1
    some = np.linspace(0, len(model["trials"]) - 1, min(trials, len(model["trials"]))).astype(int)
    some = np.unique(some)
    y, ids = model["trials"][some], model["trial_ids"][some]
    shared = index.sparkSession.sparkContext.broadcast((y, ids))  # at most ``trials`` rows

    def run(batches):
        y, own = shared.value
        best_s, best_p = np.full((len(y), 0), 0.0), np.zeros((len(y), 0), np.int32)
        for batch in batches:
            near = y @ _matrix(batch.column("v"), y.shape[1]).T
            near[own[:, None] == np.asarray(batch.column("id").fill_null(_NONE))[None, :]] = -np.inf
            scores = np.concatenate([best_s, near], axis=1)
            parts = np.concatenate([best_p, np.broadcast_to(np.asarray(batch.column("part")), near.shape)], axis=1)
            if scores.shape[1] > k:
                at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, parts = np.take_along_axis(scores, at, 1), np.take_along_axis(parts, at, 1)
            best_s, best_p = scores, parts
        n = best_s.shape[1]
        if n:
            yield pa.RecordBatch.from_pydict({"trial": pa.array(np.repeat(np.arange(len(y)), n), pa.int32()), "score": pa.array(best_s.ravel()), "part": pa.array(best_p.ravel(), pa.int32())})

    order = Window.partitionBy("trial").orderBy(F.desc("score"))
    found = index.select("id", "v", "part").mapInArrow(run, "trial int, score double, part int").where("score > double('-Infinity')")
    nearest_ = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("trial", "part").collect()  # k rows a trial
    if not nearest_:
        return 1
    routes = _routes(model, y)
    rank = np.empty_like(routes)
    np.put_along_axis(rank, routes, np.broadcast_to(np.arange(model["parts"], dtype=np.int32), routes.shape), 1)
    ranks = np.sort([rank[r["trial"], r["part"]] for r in nearest_])
    return int(ranks[min(len(ranks) - 1, math.ceil(target * len(ranks)) - 1)]) + 1


def _cells(index: DataFrame, parts: int, block: int) -> tuple[list[list[int]], DataFrame]:
    """The parts of each cell, and (part, cell, blocks): a part's cell and in how many blocks the cell's rows are; never more cells than parts."""
    counts = {r["part"]: r["count"] for r in index.groupBy("part").count().collect()}  # a row for each part
    held, size = [], block + 1
    for p in range(parts):
        if n := counts.get(p, 0):
            if size + n > block:
                held.append([])
                size = 0
            held[-1].append(p)
            size += n
    rows = [(p, c, -(-sum(counts[x] for x in ps) // block)) for c, ps in enumerate(held) for p in ps]
    return held, index.sparkSession.createDataFrame(rows, "part int, cell int, blocks int")


def _route(queries: DataFrame, model: dict, probes: int, held: list[list[int]], slots: int) -> DataFrame:
    """(cell, slot, id, v, q_key, mine): each query once for each cell that has one of its parts, with those parts' places in the cell as bits."""
    where = np.zeros((len(held), model["parts"]), bool)
    for c, parts in enumerate(held):
        where[c, parts] = True
    shared = queries.sparkSession.sparkContext.broadcast((_light(model), where, held))  # at most as many cells as parts

    def run(batches):
        m, where, held = shared.value
        for batch in batches:
            routes = _routes(m, _matrix(batch.column("v"), m["dim"]))[:, :probes]
            listed = np.zeros((batch.num_rows, m["parts"]), bool)
            np.put_along_axis(listed, routes, True, 1)
            rows, cells = np.nonzero(listed.astype(np.float32) @ where.T.astype(np.float32))
            mine = [np.packbits(listed[i, held[c]]).tobytes() for i, c in zip(rows.tolist(), cells.tolist())]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), taken.column("id"), taken.column("v"), taken.column("q_key"), pa.array(mine, pa.binary())], names=["cell", "id", "v", "q_key", "mine"])

    routed = queries.select("id", "v", F.xxhash64("id", "v").alias("q_key")).mapInArrow(run, "cell int, id bigint, v array<double>, q_key bigint, mine binary")
    return routed.withColumn("slot", F.pmod("q_key", F.lit(slots)).cast("int"))


def _pack(table: pa.Table) -> pa.Table:
    """A block's rows in order of their parts."""
    table = table.sort_by("part")
    ids = np.asarray(table["id"].fill_null(_NONE).combine_chunks())
    x = np.asarray(table["v"].combine_chunks().flatten())
    parts, n = np.unique(np.asarray(table["part"]), return_counts=True)
    return pa.table({"cell": table["cell"][:1], "block": table["block"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "xs": pa.array([x.tobytes()], pa.binary()), "parts": pa.array([parts.astype(np.int32).tobytes()], pa.binary()), "sizes": pa.array([n.astype(np.int64).tobytes()], pa.binary())})


def _pack_slot(table: pa.Table) -> pa.Table:
    put = lambda c: pa.array([np.asarray(table[c].combine_chunks()).tobytes()], pa.binary())
    x = np.asarray(table["v"].combine_chunks().flatten())
    return pa.table({"cell": table["cell"][:1], "q_ids": put("id"), "q_xs": pa.array([x.tobytes()], pa.binary()), "q_keys": put("q_key"), "q_mine": pa.array([b"".join(table["mine"].to_pylist())], pa.binary())})


def _best(k: int, dim: int, held: list[list[int]]):
    def best(batches):
        """The k best rows of a block, of a query's parts there, for each of the queries that meet it."""
        for batch in batches:
            for r in batch.to_pylist():
                ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["xs"], np.float64).reshape(-1, dim)
                q, y = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_xs"], np.float64).reshape(-1, dim)
                keys = np.frombuffer(r["q_keys"], np.int64)
                names = held[r["cell"]]
                mine = np.unpackbits(np.frombuffer(r["q_mine"], np.uint8).reshape(len(q), -1), axis=1)[:, : len(names)].astype(bool)
                ends = np.cumsum(np.frombuffer(r["sizes"], np.int64))
                places = [(names.index(p), b - n, b) for p, n, b in zip(np.frombuffer(r["parts"], np.int32).tolist(), np.frombuffer(r["sizes"], np.int64).tolist(), ends.tolist())]
                out = []
                for a in range(0, len(q), 256):  # a bounded matrix of scores at a time
                    some = np.arange(a, min(a + 256, len(q)))
                    near = np.full((len(some), len(x)), -np.inf)
                    for at, start, end in places:
                        here = np.flatnonzero(mine[some, at])
                        if len(here):
                            near[here, start:end] = y[some[here]] @ x[start:end].T
                    near[q[some][:, None] == ids[None, :]] = -np.inf
                    for j, line in zip(some.tolist(), near):
                        close = _top(line, k)
                        exact = (x[close] * y[j]).sum(axis=1)  # the same order of additions in every block
                        top = np.lexsort((ids[close], -exact))[:k]
                        out.append((np.full(len(top), j), ids[close][top], exact[top]))
                which, ids_, scores = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(q[which]), pa.array(keys[which]), pa.array(ids_, mask=ids_ == _NONE), pa.array(scores)], names=["query_id", "q_key", "vec_id", "score"])

    return best


def search(queries: DataFrame, index: DataFrame, model: dict, k: int = NEIGHBOURS, probes: int = 8, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query (id, v)."""
    held, places = _cells(index, model["parts"], block)
    placed = index.join(F.broadcast(places), "part")  # as many rows as parts
    packed = placed.withColumn("block", F.pmod(F.xxhash64("id", "row"), F.col("blocks")).cast("int"))
    packed = packed.groupBy("cell", "block").applyInArrow(_pack, "cell int, block int, ids binary, xs binary, parts binary, sizes binary")
    sizes = places.select("cell", "blocks").distinct()

    def run(some: DataFrame, probes: int) -> DataFrame:
        slots = _route(some, model, probes, held, n_slots).groupBy("cell", "slot").applyInArrow(_pack_slot, "cell int, q_ids binary, q_xs binary, q_keys binary, q_mine binary")
        met = slots.join(F.broadcast(sizes), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(packed, ["cell", "block"])
        met = met.select("cell", "ids", "xs", "parts", "sizes", "q_ids", "q_xs", "q_keys", "q_mine")
        return met.mapInArrow(_best(k, model["dim"], held), "query_id bigint, q_key bigint, vec_id bigint, score double")

    queries = queries.select("id", "v").distinct()
    n_slots = -(-queries.count() // 512) or 1
    order = Window.partitionBy("query_id", "q_key").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    top = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    first = top(run(queries, probes)).checkpoint()
    if model["parts"] > probes:
        full = first.where(F.col("rank") == k).select("q_key")
        short = queries.withColumn("q_key", F.xxhash64("id", "v")).join(full, "q_key", "left_anti").select("id", "v")
        if not short.isEmpty():
            kept = first.join(full, "q_key", "left_semi").select(first.columns)
            first = kept.unionByName(top(run(short, model["parts"])))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, is_query, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEIGHBOURS, target_recall: float = TARGET_RECALL, sample: int = SAMPLE) -> DataFrame:
    """Fit, index and search: the rows where ``is_query`` holds against all rows, each vector length among its own."""
    good = _good(vectors, vec_id, vector)
    asked = _good(vectors.where(is_query & F.col(vec_id).isNotNull()), vec_id, vector)
    out = vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lengths = good.groupBy(F.size("v").alias("size")).count().orderBy("size").toLocalIterator()  # one row a vector length, one model each
    for row in list(lengths):
        valid, queries = good.where(F.size("v") == row["size"]), asked.where(F.size("v") == row["size"])
        model = fit(valid, 1 << max(0, math.ceil(math.log2(max(1.0, 2 * math.sqrt(row["count"]))))), sample)
        index = build_index(valid, model).checkpoint()
        out = out.union(search(queries, index, model, k, probes_for(index, model, k, target_recall)))
    return out


def op5_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
