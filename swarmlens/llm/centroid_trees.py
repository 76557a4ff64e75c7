"""Lloyd's rounds by two trees: one over the vectors, one over the centroids.

Vectors are packed into blocks of at most ``BLOCK`` rows.  Each block has a cover tree,
built once: a node's centre is one of its vectors, its children's centres are a net of
half its radius, and a point goes to the first centre that covers it.  Every round
builds a small cover tree over the centroids and walks both down together: a pair of
nodes is dropped if no vector of the one can be nearest to a centroid of the other, by
the distance of their centres and their radii; a vector node that one centroid alone
is left for is assigned as a whole, and its vectors are added by one difference of
running sums; what is left at the leaves is compared exactly, in integers.

Blocks are written once to the checkpoint folder.  A round sends the centroids out
(their number and length are parameters) and each partition's counts and exact sums
back, added by centroid in a shuffle; nothing else passes through the driver.

Defined cases: vectors that are null, not of ``dim`` components, or hold null or
non-finite ones are left out; a null id has no hash and comes last among the starts;
ties of the start go to the lesser id, then the lesser vector; fewer vectors than
``k`` give as many centroids; an empty table gives an empty table; centroids at one
place leave all their vectors to the smallest number, and the others empty; repeated
rows and ids are vectors of their own; components of 2**18 and more, whose integer
squares would not fit into 64 bits, are refused with an error; other columns play no
part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, ROUNDS, DIM, BLOCK = 40, 5, 64, 1024
_LARGEST = 1 << 26
#: Relative and absolute room for the rounding of square roots in bounds.
_LOOSE, _ROOM = 1 + 1e-9, 1e-6


class Tree:
    """Nodes in order of depth: centre (row), radius, children [first, last), and rows [start, end) of ``order``."""

    FIELDS = (("order", np.int32), ("centre", np.int32), ("radius", np.float64), ("first", np.int32), ("last", np.int32), ("start", np.int32), ("end", np.int32))

    def __init__(self, **fields):
        for name, kind in self.FIELDS:
            setattr(self, name, np.asarray(fields[name], kind))

    def packed(self) -> list[bytes]:
        return [getattr(self, name).tobytes() for name, _ in self.FIELDS]

    @classmethod
    def unpacked(cls, parts) -> Tree:
        return cls(**{name: np.frombuffer(p, kind) for p, (name, kind) in zip(parts, cls.FIELDS)})


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of two integer matrices, row by row."""
    apart = x.astype(np.int64) - y
    return np.einsum("ij,ij->i", apart, apart)


def cover_tree(x: np.ndarray) -> Tree:
    """A cover tree over the rows of ``x``; equal rows share a leaf."""
    f = x.astype(np.float64)
    norm = np.einsum("ij,ij->i", f, f)
    gaps = np.sqrt(np.maximum(norm[:, None] + norm[None, :] - 2 * (f @ f.T), 0))  # a block is bounded; radii are measured exactly below
    order = np.arange(len(x))
    nodes = {name: [] for name, _ in Tree.FIELDS[1:]}

    def add(centre: int, start: int, end: int) -> None:
        radius = float(np.sqrt(squares(x[order[start:end]], x[centre]).max()))
        for name, value in (("centre", centre), ("radius", radius), ("first", 0), ("last", 0), ("start", start), ("end", end)):
            nodes[name].append(value)

    add(0, 0, len(x))
    at = 0
    while at < len(nodes["centre"]):
        radius, start, end = nodes["radius"][at], nodes["start"][at], nodes["end"][at]
        if radius > 0:
            nodes["first"][at], centre, left, reach = len(nodes["centre"]), nodes["centre"][at], order[start:end].copy(), radius / 2
            while len(left):
                near = gaps[centre, left] <= reach
                near[left == centre] = True
                if near.all() and start == nodes["start"][at]:  # rounding of large numbers: measured again exactly, the farthest is out of reach
                    near = np.sqrt(squares(x[left], x[centre])) <= reach
                taken = left[near]
                order[start : start + len(taken)] = taken
                add(centre, start, start + len(taken))
                start, left = start + len(taken), left[~near]
                centre = left[0] if len(left) else -1
            nodes["last"][at] = len(nodes["centre"])
        at += 1
    return Tree(order=order, **nodes)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each count its place repeated so often, and the numbers 0, 1, ... below it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def descend(x: np.ndarray, tree: Tree, c: np.ndarray, over: Tree, least: np.ndarray, seen: list | None = None):
    """(start, end, centroid): ranges of ``tree.order`` that lie nearest to one centroid; ``least`` is the smallest number at a centroid node's place."""
    nodes, pairs = np.zeros(1, np.int64), (np.zeros(1, np.int64), np.zeros(1, np.int64))  # vector nodes; (place in nodes, centroid node)
    done = []
    while len(nodes):
        of, b = pairs
        exact = squares(x[tree.centre[nodes[of]]], c[over.centre[b]])
        if seen is not None:
            seen.append(len(of))
        apart = np.sqrt(exact.astype(np.float64))
        begin = np.searchsorted(of, np.arange(len(nodes)))
        highest = np.minimum.reduceat(apart, begin) + tree.radius[nodes]  # every vector below has a centroid within this
        kept = apart - tree.radius[nodes][of] - over.radius[b] <= highest[of] * _LOOSE + _ROOM
        of, b, exact = of[kept], b[kept], exact[kept]
        begin = np.searchsorted(of, np.arange(len(nodes)))
        counts = np.diff(np.append(begin, len(of)))
        wide = np.maximum.reduceat(over.radius[b], begin)  # the widest centroid node left
        alone = (counts == 1) & (wide == 0)
        done.append((tree.start[nodes[alone]], tree.end[nodes[alone]], least[b[begin[alone]]]))
        leaf = ~alone & (wide == 0) & (tree.radius[nodes] == 0)
        if leaf.any():
            mine = leaf[of]
            rank = np.lexsort((least[b[mine]], exact[mine], of[mine]))
            owner = of[mine][rank]
            first = rank[np.append(True, owner[1:] != owner[:-1])]
            at = nodes[of[mine][first]]
            done.append((tree.start[at], tree.end[at], least[b[mine][first]]))
        open_ = ~alone & ~leaf
        by_centroid = open_ & (wide > 0) & (wide >= tree.radius[nodes])  # the wider side is opened
        by_vector = open_ & ~by_centroid
        # centroid nodes opened under a vector node that stays; those without children stay as well
        mine = np.flatnonzero(by_centroid[of])
        fan = np.where(over.radius[b[mine]] > 0, over.last[b[mine]] - over.first[b[mine]], 1)
        owner, k = _spread(fan)
        place = np.cumsum(by_centroid) - 1
        of_1, b_1 = place[of[mine][owner]], np.where(over.radius[b[mine]][owner] > 0, over.first[b[mine]][owner] + k, b[mine][owner])
        # children of a vector node, each with all the centroid nodes left for it
        parents = np.flatnonzero(by_vector)
        child_of, k = _spread(tree.last[nodes[parents]] - tree.first[nodes[parents]])
        children = tree.first[nodes[parents]][child_of] + k
        owner, k = _spread(counts[parents][child_of])
        of_2, b_2 = owner + int(by_centroid.sum()), b[begin[parents][child_of][owner] + k]
        nodes = np.concatenate([nodes[by_centroid], children])
        pairs = np.concatenate([of_1, of_2]), np.concatenate([b_1, b_2])
    return [np.concatenate(column) for column in zip(*done)]


def centroid_tree(c: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree over the centroids, and the smallest number below each of its nodes."""
    tree = cover_tree(c)
    return tree, np.array([tree.order[a:b].min() for a, b in zip(tree.start, tree.end)])


def integers(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, x): the kept vectors, as integers."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("v")).where(f"size(v) = {dim} AND forall(v, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < double('Infinity'))")
    x = F.transform("v", lambda c: F.floor(c * 256))
    fits = F.expr(f"forall(v, c -> abs(c) < {_LARGEST // 256})")
    return rows.select("vec_id", F.when(fits, x).otherwise(F.raise_error(F.lit(f"a component of {_LARGEST // 256} or more"))).cast("array<int>").alias("x"))


def pack(rows: DataFrame, dim: int = DIM, block: int = BLOCK) -> DataFrame:
    """(ids, x, tree): blocks of at most ``block`` vectors with their cover trees."""

    def packed(ids: pa.Array, x: np.ndarray) -> pa.RecordBatch:
        put = lambda parts: pa.array([parts], pa.list_(pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([x.tobytes()], pa.binary()), put(cover_tree(x).packed())], names=["ids", "x", "tree"])

    def run(batches):
        ids, held, size = [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, block):
                part = batch.slice(a, block)
                x = np.asarray(part.column("x").flatten(), np.int32).reshape(-1, dim)
                ids.append(part.column("vec_id"))
                held.append(x)
                size += len(x)
                while size >= block:
                    all_ids, all_x = pa.concat_arrays(ids), np.concatenate(held)
                    yield packed(all_ids[:block], all_x[:block])
                    ids, held, size = [all_ids[block:]], [all_x[block:]], size - block
        if size:
            yield packed(pa.concat_arrays(ids), np.concatenate(held))

    return rows.mapInArrow(run, "ids array<bigint>, x binary, tree array<binary>")


def _opened(row: dict, dim: int) -> tuple[np.ndarray, Tree]:
    return np.frombuffer(row["x"], np.int32).reshape(-1, dim), Tree.unpacked(row["tree"])


def _moved(blocks: DataFrame, c: np.ndarray, dim: int) -> np.ndarray:
    """The centroids after one round."""
    shared = blocks.sparkSession.sparkContext.broadcast((c, *centroid_tree(c)))

    def run(batches):
        c, over, least = shared.value
        n, sums = np.zeros(len(c), np.int64), np.zeros((len(c), dim), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                x, tree = _opened(row, dim)
                start, end, nearest = descend(x, tree, c, over, least)
                running = np.concatenate([np.zeros((1, dim), np.int64), np.cumsum(x[tree.order], axis=0, dtype=np.int64)])
                np.add.at(n, nearest, end - start)
                np.add.at(sums, nearest, running[end] - running[start])
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(used, pa.int32()), "n": pa.array(n[used]), "s": pa.array(list(sums[used]), pa.list_(pa.int64()))})

    parts = blocks.select("x", "tree").mapInArrow(run, "cluster int, n bigint, s array<bigint>")
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("s")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)])
    out = c.copy()
    for r in added.collect():  # as many rows as centroids
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dim)]
    return out


def starts(rows: DataFrame, k: int = K, seed: str = "2") -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    found = rows.orderBy(order.asc_nulls_last(), F.col("vec_id").asc_nulls_last(), "x").limit(k).select("x").collect()
    return np.array([r["x"] for r in found], np.int64)


def lloyd(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM, block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the final centroids)."""
    rows = integers(vectors, vec_id, vector, dim)
    c = starts(rows, k)
    blocks = pack(rows, dim, block).checkpoint()
    for _ in range(rounds if len(c) else 0):
        c = _moved(blocks, c, dim)
    if not len(c):
        return vectors.sparkSession.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), c
    shared = vectors.sparkSession.sparkContext.broadcast((c, *centroid_tree(c)))

    def run(batches):
        c, over, least = shared.value
        for batch in batches:
            for i, row in enumerate(batch.select(["x", "tree"]).to_pylist()):
                x, tree = _opened(row, dim)
                start, end, nearest = descend(x, tree, c, over, least)
                cluster = np.empty(len(x), np.int32)
                owner, k = _spread(end - start)
                cluster[tree.order[start[owner] + k]] = nearest[owner]
                ids = batch.column("ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(squares(x, c[cluster]))], names=["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint"), c


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, rounds: int = ROUNDS, dim: int = DIM) -> DataFrame:
    """``lloyd`` with the inertia of each cluster and of all, and a digest of each centroid."""
    assigned, c = lloyd(vectors, vec_id, vector, k, rounds, dim)
    assigned = assigned.checkpoint()
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # as many rows as centroids
    told = [(j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, c[j].tolist())).encode()).hexdigest()) for j, s in sums.items()]
    table = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return assigned.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_dual_tree(spark, sf_dir: str) -> DataFrame:
    return clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_APART = "list_sum(list_transform(range(1, 65), lambda i: (a.x[i] - c.x[i]) * (a.x[i] - c.x[i])))"


def _sql() -> str:
    """The rounds written out one after the other."""
    nearest = "SELECT r, arg_min(c, {d: d, c: c}) AS c, min(d) AS d FROM (SELECT a.r, c.c, " + _APART + " AS d FROM a, {t} c) GROUP BY r"
    parts = [
        "a AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c::DOUBLE))) = 64)",
        f"t0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, vec_id NULLS LAST, x) - 1 AS c, x FROM a QUALIFY c < {K})",
    ]
    for i in range(ROUNDS):
        parts += [
            f"n{i} AS MATERIALIZED ({nearest.replace('{t}', f't{i}')})",
            f"m{i} AS (SELECT c, k, sum(a.x[k])::HUGEINT AS s, count(*)::HUGEINT AS n FROM n{i} JOIN a USING (r), range(1, 65) AS g(k) GROUP BY c, k)",
            f"l{i} AS (SELECT c, list((((s - ((s % n) + n) % n)) // n)::BIGINT ORDER BY k) AS x FROM m{i} GROUP BY c)",
            f"t{i + 1} AS MATERIALIZED (SELECT c, coalesce(l.x, t.x) AS x FROM t{i} t LEFT JOIN l{i} l USING (c))",
        ]
    parts.append(f"f AS MATERIALIZED ({nearest.replace('{t}', f't{ROUNDS}')})")
    return f"WITH {', '.join(parts)} SELECT vec_id, f.c::INTEGER AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY f.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(t.x, ',')) AS centroid_sha256 FROM f JOIN a USING (r) JOIN t{ROUNDS} t USING (c)"


OP12_SQL = _sql()
