"""Deterministic greedy leader clusters and connected components over edge tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ready(spark) -> None:
    """The checkpoint folder that the cluster names; a temporary one only on a single machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[\d*,\s]+\])?", context.master):
            raise ValueError("a cluster has to name a shared folder in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphs"))


#: The tables that ``written`` made, for ``forget``.
_TABLES: list[str] = []


def forget(spark) -> int:
    """Delete the tables that ``written`` made in this process, once the results that stand on them are written; how many there were."""
    gone = 0
    while _TABLES:
        place = spark._jvm.org.apache.hadoop.fs.Path(_TABLES.pop())
        gone += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the checkpoint folder, read again; ``forget`` removes such tables.

    This cuts the plan as checkpoint() does, and the planner's size estimates as well.
    A checkpointed frame keeps the estimate of the plan that it came from, and joins
    multiply estimates: in a loop their digits double with every round, until the
    driver does nothing but multiply them.
    """
    ready(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hashed_order(node: Column) -> Column:
    """An order that does not depend on how ids were given."""
    return F.struct(F.md5(node.cast("string")), node)


def shuffled(df: DataFrame) -> DataFrame:
    """The side of a join that is not to be broadcast: files of ids are small for their rows, and the driver would hold the rows as objects."""
    return df.hint("merge")


#: So many directed edges are left to one task.
LAST = 1 << 17


def _greedy(batches):
    """The nodes u of batches (u, vs), in their order, that are no neighbour of one given before."""
    seeds = set()
    for batch in batches:
        fresh = []
        for u, vs in zip(batch.column("u").to_pylist(), batch.column("vs").to_pylist()):
            if seeds.isdisjoint(vs):
                seeds.add(u)
                fresh.append(u)
        yield pa.RecordBatch.from_arrays([pa.array(fresh, batch.schema.field("u").type)], names=["u"])


def _seeds(open_: DataFrame, order, last: int) -> list[DataFrame]:
    """Tables (u) of the first maximal independent set of directed edges (u, v): rounds, until no more than ``last`` edges are undecided; one task decides those."""
    rounds = []
    while (left := open_.count()) > last:
        fresh = written(open_.groupBy("u").agg(F.min(order(F.col("v"))).alias("m")).where(order(F.col("u")) < F.col("m")).select("u"))
        gone = written(open_.join(shuffled(fresh), "u", "left_semi").select(F.col("v").alias("u")).union(fresh).distinct())
        inner = open_.join(shuffled(gone), "u", "left_anti")
        kept = written(inner.join(shuffled(gone.select(F.col("u").alias("v"))), "v", "left_anti").select("u", "v"))
        # nodes whose neighbours have all gone are seeds of their own
        rounds += [fresh, inner.select("u").distinct().join(shuffled(kept.select("u").distinct()), "u", "left_anti")]
        open_ = kept
    if left:
        nodes = open_.groupBy("u").agg(F.collect_list("v").alias("vs")).repartition(1).sortWithinPartitions(order(F.col("u")))
        rounds.append(nodes.mapInArrow(_greedy, open_.select("u").schema))
    return rounds


def leader_clusters(edges: DataFrame, order=None, last: int = LAST) -> DataFrame:
    """(id, seed): seeds are the first maximal independent set in the order of the nodes; others join their first seed neighbour.

    ``order`` is a function of the node column, by default the node itself.  In each
    round every undecided node without an undecided neighbour before it becomes a seed
    and takes its undecided neighbours out.  By ascending ids a chain takes as many
    rounds as it has nodes; by ``hashed_order`` any graph takes some multiple of the
    logarithm of its size.  Rounds write their state to the checkpoint folder; they end
    when ``last`` edges or fewer, each counted from both ends, are undecided.
    """
    ready(edges.sparkSession)
    order = order or (lambda node: node)
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct())
    if not (rounds := _seeds(both, order, last)):
        return both.select(F.col("u").alias("id"), F.col("v").alias("seed")).limit(0)
    seeds = written(reduce(DataFrame.union, rounds))
    taken = both.join(shuffled(seeds.select(F.col("u").alias("v"))), "v", "left_semi").join(shuffled(seeds), "u", "left_anti").groupBy(F.col("u").alias("id")).agg(F.min_by("v", order(F.col("v"))).alias("seed"))
    return taken.union(seeds.select(F.col("u").alias("id"), F.col("u").alias("seed")))


def _listable(shared: DataFrame, most: int) -> int:
    """The greatest size, ``most`` at least, up to which the buckets of rows (n) have together no more pairs than ``most`` / 2 for each row."""
    sizes = sorted((r["n"], r["count"]) for r in shared.groupBy("n").count().collect())  # a row for each size, under the root of twice the rows
    left, upto = sum(rows for _, rows in sizes) * most / 2, most
    for n, rows in sizes:
        if (left := left - rows * (n - 1) / 2) < 0:
            break
        upto = max(upto, n)
    return upto


def bucket_leaders(keyed: DataFrame, near, order=hashed_order, most: int = 64, listed=None, last: int = LAST) -> DataFrame:
    """(id, seed): what ``leader_clusters`` gives for the pairs that share a bucket (slot, key) of ``keyed`` (id, slot, key) and are near; ids that share no bucket are left out, those that are near to none are seeds.

    ``near`` takes candidate pairs (a, b) and gives back those that are.  Buckets of up to
    ``most`` ids list their near pairs (``listed`` of the buckets' rows, where it is given), and larger ones while
    all listed have no more than ``most`` / 2 pairs for each row, so that a node waits only for nodes that it is near to.  Still larger buckets list no pair
    but those of seeds: in each round a node that comes before all undecided ones of its large buckets and before
    all undecided ones that it is listed with is a seed, as nobody undecided that it could be near to comes before it, and
    is compared with its large buckets.  Such a bucket has one seed a round at most, so a round looks at each of its rows
    once, and n nodes that are all near each other take one round and n pairs a bucket.
    """
    counts = keyed.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = written(keyed.join(shuffled(counts), ["slot", "key"]))
    most = _listable(shared, most)
    small, every = shared.where(F.col("n") <= most).drop("n"), shared.where(F.col("n") > most).select("id", "slot", "key")
    x, y = small.alias("x"), small.alias("y")
    met = x.join(shuffled(y), (F.col("x.slot") == F.col("y.slot")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")))
    edges = written(listed(met) if listed else near(met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()))
    if every.isEmpty():
        placed = leader_clusters(edges, order, last)
        return placed.union(shared.select("id").distinct().join(shuffled(placed.select("id")), "id", "left_anti").select("id", F.col("id").alias("seed")))
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    nodes, open_, rows, seeds, held = written(shared.select("id").distinct()), both, every, [], []
    while not rows.isEmpty():
        later = open_.groupBy(F.col("u").alias("id")).agg(F.min(order(F.col("v"))).alias("m")).where(order(F.col("id")) > F.col("m")).select("id")
        firsts = rows.groupBy("slot", "key").agg(F.min_by("id", order(F.col("id"))).alias("least"))
        behind = rows.join(shuffled(firsts), ["slot", "key"]).where("id <> least").select("id")
        fresh = written(nodes.join(shuffled(later.union(behind).distinct()), "id", "left_anti"))
        asked = every.join(shuffled(fresh), "id", "left_semi").withColumnRenamed("id", "a")
        ties = written(near(asked.join(shuffled(every.withColumnRenamed("id", "b")), ["slot", "key"]).where("a <> b").select("a", "b").distinct()))
        seeds.append(fresh)
        held.append(ties)
        gone = written(fresh.union(ties.select("b")).union(open_.join(shuffled(fresh.withColumnRenamed("id", "u")), "u", "left_semi").select("v")).distinct())
        nodes = written(nodes.join(shuffled(gone), "id", "left_anti"))
        rows = written(rows.join(shuffled(gone), "id", "left_anti"))
        u, v = gone.withColumnRenamed("id", "u"), gone.withColumnRenamed("id", "v")
        open_ = written(open_.join(shuffled(u), "u", "left_anti").join(shuffled(v), "v", "left_anti").select("u", "v"))
    # what is undecided is in no large bucket any more
    seeds += [nodes.join(shuffled(open_.select(F.col("u").alias("id")).distinct()), "id", "left_anti"), *[found.withColumnRenamed("u", "id") for found in _seeds(open_, order, last)]]
    chosen = written(reduce(DataFrame.union, seeds))
    near_seeds = reduce(DataFrame.union, held).union(both.join(shuffled(chosen.withColumnRenamed("id", "u")), "u", "left_semi").select("u", "v"))
    taken = near_seeds.groupBy(F.col("b").alias("id")).agg(F.min_by("a", order(F.col("a"))).alias("seed"))
    return taken.union(chosen.select("id", F.col("id").alias("seed")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): the least id of each component, by hooking to the least neighbour and pointer jumping."""
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    labels = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")))
    while True:
        near = both.join(shuffled(labels.select(F.col("u").alias("v"), F.col("c").alias("d"))), "v").groupBy("u").agg(F.min("d").alias("d"))
        hooked = labels.join(shuffled(near), "u").select("u", F.least("c", "d").alias("n"))
        jumped = hooked.join(shuffled(hooked.select(F.col("u").alias("n"), F.col("n").alias("j"))), "n", "left").select("u", F.least("n", F.coalesce("j", "n")).alias("n"))
        after = written(labels.join(shuffled(jumped), "u").select("u", F.col("n").alias("c"), (F.col("n") != F.col("c")).alias("moved")))
        labels = after.select("u", "c")
        if after.where("moved").isEmpty():
            return labels.select(F.col("u").alias("id"), F.col("c").alias("component"))
