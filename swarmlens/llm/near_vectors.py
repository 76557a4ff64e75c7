"""Near-duplicate vectors by learned binary codes and multi-index Hamming tables.

Iterative quantisation learns, on a bounded hash-chosen sample, rotations of the
principal directions under which the signs about the medians lose least; several
rotations give as many bits as the tables need.  The bits are cut into tables of
``table_bits`` each, and two vectors meet if they agree in any table.  How many tables
there are follows from ``target_recall``, measured on pairs made at exactly the
threshold: less than that share would be found by one table fewer.

Every distinct vector is indexed once.  A bucket of at most ``BUCKET`` vectors gives
those of its pairs whose whole first codes are within a Hamming distance (measured on
the same pairs); the distinct ones are compared with their original vectors, in double
precision.  Larger buckets belong to dense regions: buckets that share a vector are
joined to regions, a region's vectors are dealt into tiles, and every two tiles of a
region are compared whole by matrix products.  A unit of two tiles gives one row a
vector, its number of links and its parent in a spanning forest, so a region of any size
costs no row for each pair and every link counts.  Pairs inside one region are left to it.

Within a region all pairs are computed (not stored), which is quadratic in the distinct
vectors of the region; the rows sent grow with the region's size over the tile's.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link
with nothing; vectors of different lengths link with nothing of one another; equal
vectors are copies that link with each other, whatever their ids; a null id is after all
others and is a component's id only where no other is in it; repeated rows are vectors of
their own; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.llm.components import components
from swarmlens.operators.graphs import written

THRESHOLD, TARGET_RECALL, SAMPLE, TRIALS = 0.95, 0.999, 16384, 4096
#: Vectors of a bucket whose pairs are listed, and of a tile of a dense region at most.
BUCKET, TILE = 32, 4096
_FEWEST_BITS, _MOST_BITS, _TABLES, _SALTS = 2, 24, 1 << 16, 32
#: Rotations that are learned; where still more bits are needed, as of very few vectors, the rest are random.
LEARNED = 16


def units(column) -> np.ndarray:
    """The rows of a column of lists of one length, as doubles of length one; scaled first, so that no square overflows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten()).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def close(x: np.ndarray, y: np.ndarray, near: np.ndarray, threshold: float) -> np.ndarray:
    """near >= threshold for the products of unit rows; where rounding could decide, they are added again exactly."""
    out = near >= threshold
    for i, j in zip(*np.nonzero(np.abs(near - threshold) < 1e-13)):
        out[i, j] = math.fsum((x[i] * y[j]).tolist()) >= threshold
    return out


def _rotation(v: np.ndarray, turn: int, rounds: int = 30) -> np.ndarray:
    """An orthogonal matrix after which the signs of ``v`` are close to its values; without rounds a random one."""
    random = np.random.Generator(np.random.PCG64(turn))
    r = np.linalg.qr(random.normal(size=(v.shape[1], v.shape[1])))[0] * random.choice([-1.0, 1.0], v.shape[1])
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def _bits(model: dict, x: np.ndarray) -> np.ndarray:
    return (x - model["mean"]) @ model["project"] >= model["middle"]


def _keys(bits: np.ndarray, width: int, tables: int) -> np.ndarray:
    """Each row's numbers in the tables of ``width`` bits."""
    weights = 1 << np.arange(width, dtype=np.int64)
    return bits[:, : width * tables].reshape(len(bits), tables, width) @ weights


def fit(x: np.ndarray, rows: int, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, trials: int = TRIALS) -> dict:
    """Rotations, tables and the distance of first codes, learned from unit vectors ``x`` for ``rows`` vectors."""
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T, bias=True).reshape(x.shape[1], -1))
    axes = axes[:, ::-1][:, :64]
    v = (x - mean) @ axes
    # pairs at exactly the threshold: each some of the sample and a partner at that angle in a random direction
    random = np.random.Generator(np.random.PCG64(11))
    some = x[np.linspace(0, len(x) - 1, max(trials, 1)).astype(int)]
    aside = random.normal(size=some.shape)
    aside -= (aside * some).sum(axis=1, keepdims=True) * some
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    partner = np.where(length > 1e-9, threshold * some + math.sqrt(1 - threshold**2) * aside / np.maximum(length, 1e-9), some)
    width = min(_MOST_BITS, max(_FEWEST_BITS, math.ceil(math.log2(max(rows, 2))) - 2))  # about four vectors a bucket: fewer tables than with one
    model, bits = {"mean": mean, "project": np.zeros((x.shape[1], 0)), "middle": np.zeros(0)}, [np.zeros((len(some), 0), bool)] * 2
    found, tables, turn = np.zeros(len(some), bool), 0, 0
    while found.mean() < target_recall:
        while bits[0].shape[1] < width * (tables + 1):
            r = _rotation(v, turn, 30 if turn < LEARNED else 0)
            new = {"mean": mean, "project": axes @ r, "middle": np.median(v @ r, axis=0)}
            bits = [np.hstack([known, _bits(new, y)]) for known, y in zip(bits, (some, partner))]
            model |= {k: np.concatenate([model[k], new[k]], axis=-1) for k in ("project", "middle")}
            turn += 1
        found |= (bits[0] == bits[1])[:, tables * width : (tables + 1) * width].all(axis=1)
        tables += 1
        if tables == 96:  # too fine for this threshold: start again with wider buckets, in the end with one for all
            width, tables, found = max(0, width - 3), 0, np.zeros(len(some), bool)
    code = min(64, model["project"].shape[1])
    apart = (bits[0] != bits[1])[:, :code].sum(axis=1)
    return model | {"width": width, "tables": tables, "code": code, "radius": int(np.sort(apart)[min(len(apart) - 1, math.ceil(0.9999 * len(apart)))])}


def _codes(vectors: DataFrame, models: dict) -> DataFrame:
    """(node, code, keys): the first code and the bucket of every table; a key holds the length's number, table and bits."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # a few matrices a length

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("v").value_lengths())
            for size in np.unique(sizes).tolist():
                m, part = shared.value[size], batch.filter(pa.array(sizes == size))
                bits = _bits(m, units(part.column("v")))
                keys = _keys(bits, m["width"], m["tables"]) | (m["number"] * _TABLES + np.arange(m["tables"])) << _MOST_BITS
                code = np.zeros((len(bits), 8), np.uint8)
                packed = np.packbits(bits[:, : m["code"]], axis=1)
                code[:, : packed.shape[1]] = packed
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(code.view(np.int64).ravel()), pa.array(list(keys), pa.list_(pa.int64()))], names=["node", "code", "keys"])

    return vectors.select("node", "v").mapInArrow(run, "node bigint, code bigint, keys array<bigint>")


def _verified(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs that are linked, by their original vectors."""
    left = pairs.join(vectors.select(F.col("node").alias("a"), F.col("v").alias("x")), "a")
    both = left.join(vectors.select(F.col("node").alias("b"), F.col("v").alias("y")), "b").select("a", "b", "x", "y")

    def run(batches):
        for batch in batches:
            sizes = np.asarray(batch.column("x").value_lengths())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                x, y = units(part.column("x")), units(part.column("y"))
                near = (x * y).sum(axis=1)
                good = near >= threshold
                for i in np.flatnonzero(np.abs(near - threshold) < 1e-13):
                    good[i] = math.fsum((x[i] * y[i]).tolist()) >= threshold
                yield part.select(["a", "b"]).filter(pa.array(good))

    return both.mapInArrow(run, "a bigint, b bigint")


def _forest(linked: np.ndarray) -> np.ndarray:
    """Each place's parent in a spanning forest of a matrix of links between rows and columns, columns after the rows; -1 for roots."""
    rows, columns = linked.shape
    parent, open_ = np.full(rows + columns, -1), np.ones(rows + columns, bool)
    for root in range(rows):
        if not open_[root]:
            continue
        open_[root], stack = False, [root]
        while stack:
            at = stack.pop()
            found = rows + np.flatnonzero(linked[at] & open_[rows:]) if at < rows else np.flatnonzero(linked[:, at - rows] & open_[:rows])
            open_[found], parent[found] = False, at
            stack += found.tolist()
    return parent


def _unit(threshold: float):
    def unit(table: pa.Table) -> pa.Table:
        """Links and parents among one tile's vectors, or between two tiles'."""
        sides = [table.filter(pa.array(np.asarray(table["side"].combine_chunks()) == s)) for s in (0, 1)]
        alone = np.asarray(table["p"])[0] == np.asarray(table["q"])[0]
        x, y = units(sides[0]["v"]) if len(sides[0]) else None, None
        if alone:
            sides[1], y = sides[0], x
        elif len(sides[1]):
            y = units(sides[1]["v"])
        if x is None or y is None:
            return table.select(["node"]).slice(0, 0).append_column("links", pa.array([], pa.int64())).append_column("parent", pa.array([], pa.int64()))
        linked = np.zeros((len(x), len(y)), bool)
        for a in range(0, len(x), 512):
            linked[a : a + 512] = close(x[a : a + 512], y, x[a : a + 512] @ y.T, threshold)
        nodes, weights = [np.asarray(s["node"]) for s in sides], [np.asarray(s["w"]).astype(np.float64) for s in sides]
        if alone:
            np.fill_diagonal(linked, False)
            parent = _forest(linked)
            parent[: len(x)] = np.where(parent[: len(x)] >= 0, parent[: len(x)], -1)
        else:
            parent = _forest(linked)
        count = lambda m, w: np.concatenate([m[a : a + 512] @ w for a in range(0, len(m), 512)])
        links = count(linked, weights[1])
        every = np.concatenate(nodes)
        if not alone:
            links = np.concatenate([links, count(linked.T, weights[0])])
        else:  # a vector stands in a row and in a column: an edge for either
            links = np.concatenate([links, np.zeros(len(x))])
        return pa.table({"node": pa.array(every), "links": pa.array(links.astype(np.int64)), "parent": pa.array(every[parent], mask=parent < 0)})

    return unit


def _regions(hot: DataFrame) -> DataFrame:
    """(node, region) of the rows (node, key) of large buckets: buckets that share a vector are one region."""
    key = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    least = hot.groupBy("node").agg(F.min("key").alias("home"), F.collect_set("key").alias("keys"))  # at most one key a table
    least = written(least.select("node", key("home").alias("home"), F.transform("keys", key).alias("keys")))
    roots = components(least.select(F.col("home").alias("a"), F.explode("keys").alias("b")).where("a <> b").distinct())
    return written(least.select("node", "home").join(roots.withColumnRenamed("node", "home"), "home", "left").select("node", F.coalesce("root", "home").alias("region")))


def _dense(regions: DataFrame, vectors: DataFrame, threshold: float, tile: int) -> DataFrame:
    """(node, links, parent): a row for each unit of two tiles and each of its vectors."""
    spread = F.expr(f"greatest(least(bigint(ceil(n / 12)), {tile}), {tile // 8})")
    sizes = regions.groupBy("region").agg(F.count("*").alias("n")).select("region", F.ceil(F.col("n") / spread).cast("int").alias("tiles"))
    salted = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))  # a region can hold a third of all rows
    dealt = regions.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).join(salted, ["region", "salt"])
    placed = dealt.withColumn("t", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int")).select("node", "region", "tiles", "t").join(vectors.select("node", "v", "w"), "node")
    sent = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).select("region", F.least("t", "j").alias("p"), F.greatest("t", "j").alias("q"), F.when(F.col("j") < F.col("t"), 1).otherwise(0).alias("side"), "node", "v", "w")
    return sent.groupBy("region", "p", "q").applyInArrow(_unit(threshold), "node bigint, links bigint, parent bigint")


def link_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL, sample: int = SAMPLE, bucket: int = BUCKET, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept, n_copies) for every row."""
    session = vectors.sparkSession
    raw = F.col(vector)
    good = F.expr("v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), raw.alias("v")).withColumn("v", F.when(good, F.col("v")))
    hashed = rows.select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(7), "v")).alias("h2"))
    distinct = hashed.where("v IS NOT NULL").groupBy("h1", "h2").agg(F.first("v").alias("v"), F.count("*").alias("w"), F.min("vec_id").alias("least"))
    distinct = written(distinct.withColumn("node", F.monotonically_increasing_id()))
    lengths = distinct.groupBy(F.size("v").alias("size")).count().orderBy("size").collect()  # one row a length
    models = {}
    for i, r in enumerate(lengths):
        some = distinct.where(F.size("v") == r["size"]).orderBy("h1", "h2").select("v").limit(sample).toArrow()
        models[r["size"]] = fit(units(some["v"]), r["count"], threshold, target_recall) | {"number": i}
    codes = written(_codes(distinct, models))
    entries = codes.select(F.explode("keys").alias("key"), "node", "code")
    radius = F.get(F.array(*[F.lit(m["radius"]) for m in models.values()]), F.expr(f"int(key div {_TABLES << _MOST_BITS})")) if models else F.lit(0)
    counts = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    met = entries.join(counts.where(F.col("n") <= bucket).select(F.col("key").bitwiseXOR(F.lit(0).cast("bigint")).alias("key")), "key")
    other = met.select("key", F.col("node").alias("b"), F.col("code").alias("other"))
    pairs = met.withColumnRenamed("node", "a").join(other, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("code").bitwiseXOR(F.col("other"))) <= radius)).select("a", "b").distinct()
    hot = entries.select("key", "node").join(counts.where(F.col("n") > bucket).select(F.col("key").bitwiseXOR(F.lit(0).cast("bigint")).alias("key")), "key")
    dense = not counts.where(F.col("n") > bucket).isEmpty()
    if dense:
        regions = _regions(hot)
        a, b = (regions.select(F.col("node").alias(c), F.col("region").alias(f"of_{c}")) for c in "ab")
        pairs = pairs.join(a, "a", "left").join(b, "b", "left").where("of_a IS NULL OR of_b IS NULL OR of_a <> of_b").select("a", "b")
    linked = written(_verified(pairs, distinct, threshold))
    key = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    weight = lambda c: distinct.select(F.col("node").alias(c), "w")
    found = linked.join(weight("b"), "b").select(F.col("a").alias("node"), F.col("w").alias("links")).union(linked.join(weight("a"), "a").select(F.col("b").alias("node"), F.col("w").alias("links")))
    edges = linked.select("a", "b")
    if dense:
        inside = written(_dense(regions, distinct, threshold, tile))
        found = found.union(inside.where("links > 0").select("node", "links"))
        edges = edges.union(inside.where("parent IS NOT NULL AND parent <> node").select(F.col("node").alias("a"), F.col("parent").alias("b")))
    roots = components(edges.select(key("a").alias("a"), key("b").alias("b")))
    nodes = distinct.select("node", "h1", "h2", "w", "least", key("node").alias("at")).join(roots.withColumnRenamed("node", "at"), "at", "left").withColumn("root", F.coalesce("root", "at"))
    nodes = nodes.join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    least = nodes.groupBy("root").agg(F.min("least").alias("component")).select(F.concat("root", F.lit(b"")).alias("root"), "component")  # dealt anew, so that the nodes of a large component can be cut
    labels = written(nodes.join(least, "root").select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("links"), "component", "w"))
    told = hashed.drop("v").join(labels, ["h1", "h2"], "left")
    out = told.select("vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"), F.coalesce("w", F.lit(1)).cast("bigint").alias("n_copies"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op11_vector_dedup(spark, sf_dir: str) -> DataFrame:
    return link_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "n_links", "component_id", "kept")


OP11_SQL = f"""
WITH RECURSIVE a AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
g AS MATERIALIZED (SELECT r, vec_id, v, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS norm FROM a WHERE len(v) > 0 AND len(list_filter(v, lambda c: c IS NOT NULL AND isfinite(c))) = len(v) AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS MATERIALIZED (SELECT x.r AS a, y.r AS b, y.vec_id AS other FROM g x JOIN g y ON x.r <> y.r AND len(x.v) = len(y.v) WHERE list_dot_product(x.v, y.v) / (x.norm * y.norm) >= {THRESHOLD}),
w AS (SELECT r AS a, r AS b FROM a UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
c AS (SELECT w.a AS r, min(a.vec_id) AS component_id FROM w JOIN a ON w.b = a.r GROUP BY w.a),
n AS (SELECT a AS r, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id IS NOT DISTINCT FROM coalesce(component_id, vec_id) AS kept FROM a LEFT JOIN c USING (r) LEFT JOIN n USING (r)
"""
