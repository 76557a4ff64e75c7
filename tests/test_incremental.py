"""What grows batch by batch: the index on disk, clusters, reputation, streams that fail, and paged sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from swarmlens.operators import graphs, similarity
from swarmlens.operators.clustering import Clusters
from swarmlens.operators.index import SignatureIndex
from swarmlens.sources import adapters, paged
from swarmlens.streaming import jobs, reputation

POST = "id bigint, text string"
#: Fewer than the documented numbers: plans with 128 minima take seconds to compile.
HASHES, BANDS = 16, 8


def texts(n, seed=1):
    """Groups of near copies, some bridging two groups, and copies; ids in random order."""
    r = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    out = []
    for _ in range(n):
        base = r.choices(words, k=30)
        for _ in range(r.randint(1, 4)):
            out.append(" ".join([*base[: r.choice([29, 30])], *r.choices(words, k=r.randint(0, 2))]))
    out += [out[0], out[3], out[3], "", None, "a b"]
    ids = list(range(len(out)))
    r.shuffle(ids)
    return list(zip(ids, out))


def parted(spark, rows):
    """{id: component} in one run over everything."""
    docs = spark.createDataFrame(rows, POST)
    whole = graphs.connected_components(similarity.minhash_pairs(similarity.distinct_texts(docs, "id"), HASHES, BANDS))
    component = {r["id"]: r["component"] for r in whole.collect()}
    rep = {}
    for i, t in rows:
        rep[t] = min(rep.get(t, i), i)
    return {i: i if t is None else component.get(rep[t], rep[t]) for i, t in rows}


def test_index_upkeep_and_search(spark, tmp_path):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    index = SignatureIndex(spark, str(tmp_path / "index"), HASHES, BANDS, slots=32)
    add = lambda rows, n: index.add(spark.createDataFrame(rows, POST), n)
    one = lambda i: spark.createDataFrame([(i,)], "id bigint")
    near = lambda i: [(r["rank"], r["other"]) for r in index.find_similar(one(i)).orderBy("rank").collect()]
    assert index.count() == 0
    add([(1, base), (2, base + " lambda"), (3, "something else entirely is written here"), (4, base), (5, ""), (6, None), (None, base), (1, base)], 0)
    assert index.count() == 4 and near(1) == [(1, 4), (2, 2)]
    add([(2, base + " lambda")], 1)  # added again: nothing comes twice
    assert index.count() == 4 and near(1) == [(1, 4), (2, 2)] and index.get(one(2)).count() == 1
    add([(4, "quite another text has come instead of it")], 2)  # replaced: its old buckets no longer count
    assert near(1) == [(1, 2)] and index.count() == 4
    index.delete(one(2), 3)
    assert index.get(one(2)).count() == 0 and index.count() == 3
    for _ in range(2):  # the batch is run again
        add([(2, base), (3, "")], 4)  # back again; and one whose new text has no words is gone
    assert near(1) == [(1, 2)] and index.count() == 3  # 1, 2 and 4


def test_search_reads_touched_slots_only(spark, tmp_path):
    index = SignatureIndex(spark, str(tmp_path / "index"), HASHES, BANDS, slots=128)
    index.add(spark.createDataFrame([r for r in texts(60) if r[1]], POST), 0)
    some = index.get(spark.createDataFrame([(7,)], "id bigint"))
    slots = index.slots_of(similarity.bands(some, index.hashes, index.bands), "band", "key")
    table = index.table("buckets", slots)
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert len(slots) <= index.bands and "PartitionFilters: [slot#" in plan.replace("isnotnull(", "").replace("PartitionFilters: [slot", "PartitionFilters: [slot")
    read = {r[0].rsplit("slot=", 1)[1].split("/")[0] for r in table.select(F.input_file_name()).distinct().collect()}
    everything = {r[0].rsplit("slot=", 1)[1].split("/")[0] for r in index.table("buckets").select(F.input_file_name()).distinct().collect()}
    assert read == {str(s) for s in slots} and len(read) < len(everything) / 4


def test_clusters_by_batches_equal_one_run(spark, tmp_path):
    rows = texts(25)
    clusters = Clusters(spark, str(tmp_path / "clusters"), HASHES, BANDS)
    for n in range(3):
        part = spark.createDataFrame(rows[n::3] + (rows[:5] if n == 2 else []), POST)  # some posts come again
        clusters.add(part, n)
        if n == 1:
            clusters.add(part, n)  # a batch that is run again changes nothing
            half = [r for m in range(2) for r in rows[m::3]]
            assert {r["id"]: r["component"] for r in clusters.clusters().collect()} == parted(spark, half)
    assert {r["id"]: r["component"] for r in clusters.clusters().collect()} == parted(spark, rows)


def test_clusters_that_merge_again_and_again(spark, tmp_path):
    """Chains that are joined from the high ids to the low ones: a label goes through several merges, and the way is kept short."""
    base = [f"word{i}" for i in range(40)]
    step = lambda k: " ".join(base[k:] + [f"other{j}" for j in range(k)])
    clusters = Clusters(spark, str(tmp_path / "clusters"), HASHES, BANDS)
    rows = [(100 - k, step(k)) for k in range(4)]
    for n, row in enumerate(rows):
        clusters.add(spark.createDataFrame([row], POST), n)
    found = {r["id"]: r["component"] for r in clusters.clusters().collect()}
    assert found == parted(spark, rows) and set(found.values()) == {97}
    ways = {r["label"]: r["into"] for r in clusters._table("merges").groupBy("label").agg(F.max_by("into", "batch").alias("into")).collect()}
    assert ways[100] <= 98  # its way of three merges is kept short


def plain_scores(rows):
    state, out = {}, {}
    for key, hours, factor, impact, confidence in sorted(rows, key=lambda r: (str(r[0]), *r[1:])):
        state[key], weight = reputation.applied(state.get(key, (0.5, 0, [], [], [])), hours, impact, confidence)
        out[key] = (round(state[key][0], 9), round(weight, 9), state[key][1])
    return out


def test_reputation_stream_goes_on_and_forgets(spark, tmp_path):
    r = random.Random(3)
    rows = [(r.choice([1, 2, 3, None]), float(h), "f", r.uniform(-0.2, 0.2), 0.8) for h in range(1, 900, 3)] + [(9, 1.0, "f", 0.1, 0.8)]
    frame = spark.createDataFrame(rows, "id bigint, h double, factor string, impact double, confidence double")
    events = frame.select("id", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "factor", "impact", "confidence")
    table = reputation.ScoreTable(spark, str(tmp_path / "scores"))
    cut = [events.where((F.unix_micros("ts") >= a * 3.6e9) & (F.unix_micros("ts") < b * 3.6e9)) for a, b in ((0, 300), (300, 600), (600, 1000))]
    jobs.replayed(spark, cut, str(tmp_path / "in"), lambda stream: jobs.to_sink(reputation.scores(stream, idle_days=20), table.take, str(tmp_path / "progress"), mode="update"))
    got = {x["id"]: (round(x["score"], 9), round(x["effective_weight"], 9), x["n"]) for x in table.latest().collect()}
    expected = plain_scores(rows)
    del expected[9]  # without events for twenty days
    assert got == expected
    assert spark.read.parquet(table.path).where("id = 9 AND idle").count() == 1


def test_a_failing_sink_and_query_are_tried_again(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
    calls, took = [], []

    def sink(rows, number):
        calls.append(number)
        if len(calls) < 3:
            raise OSError("not now")
        took.append(rows.count())

    jobs.restarted(lambda: jobs.to_sink(stream, sink, str(tmp_path / "cp"), attempts=2, wait_s=0.01), wait_s=0.01)
    assert took == [5] and len(calls) == 3
    with pytest.raises(Exception, match="never"):
        jobs.restarted(lambda: jobs.to_sink(stream, lambda rows, n: (_ for _ in ()).throw(OSError("never")), str(tmp_path / "cp2"), attempts=1), attempts=2, wait_s=0.01)


def test_paged_search(spark, tmp_path):
    rows = [(i // 10, str(i), f"text {i}", f"author{i % 3}", "en" if i % 2 else "de", None) for i in range(95) if not 30 <= i < 40]
    answers = spark.createDataFrame(rows, "page bigint, id string, text string, author_id string, lang string, created_at string")
    folder = str(tmp_path / "pages")
    paged.write_pages(answers, folder, 0, 9)
    paged.register(spark)
    scan = spark.read.format("paged_search").load(folder)
    assert scan.count() == 85 and scan.rdd.getNumPartitions() == 10  # a heartbeat among them
    wanted = scan.where("lang = 'en' AND author_id IN ('author1', 'author2')")
    assert {r["id"] for r in wanted.collect()} == {r[1] for r in rows if r[4] == "en" and r[3] != "author0"}
    assert spark.read.format("paged_search").option("max_results", 25).load(folder).count() == 25
    reader = paged.PagedReader({"path": folder})
    left = list(reader.pushFilters([paged.EqualTo(("lang",), "en"), paged.EqualTo(("text",), "x")]))
    assert len(left) == 1 and reader.kept == {"lang": {"en"}} and len(list(reader.read(paged.Page("page-0")))) == 5
    (tmp_path / "pages/page-10.json").write_text(json.dumps({"errors": [{"title": "too many"}], "meta": {}}))
    with pytest.raises(Exception, match="too many"):
        spark.read.format("paged_search").load(folder).collect()
    with pytest.raises(Exception, match="no page"):
        spark.read.format("paged_search").load(str(tmp_path)).collect()


def message(i, text, author="7", users=None, **more):
    users = users or [{"id": author, "username": "first"}]
    return json.dumps({"data": [{"id": str(i), "text": text, "author_id": author, **more}], "includes": {"users": users}})


def test_repeated_users_and_search_strings(spark, tmp_path):
    lines = [
        message(1, "I like Bitcoin a lot", lang="en", users=[{"id": "7", "username": "old"}, {"id": "8", "username": "x"}, {"id": "7", "username": "new"}]),
        message(2, "crypto deal of the day", lang="en"),
        message(3, "crypto deals", lang="de"),
        message(4, "bitcoins", lang="en"),
        message(5, "RT bitcoin", lang="en", referenced_tweets=[{"type": "retweeted"}]),
        message(6, "we win", lang="en", entities={"hashtags": [{"tag": "Win"}]}),
        message(7, "nobody wrote bitcoin", author="9", users=[{"id": "7", "username": "first"}]),
    ]
    (tmp_path / "page.json").write_text("\n".join(lines))
    posts = adapters.parse_stream(spark.read.text(str(tmp_path)))
    assert {r["id"]: r["username"] for r in posts.collect()} == {"1": "new", **{str(i): "first" for i in range(2, 7)}}
    ids = lambda q: sorted(r["id"] for r in adapters.search(spark, str(tmp_path), q).collect())
    assert ids("(bitcoin OR crypto) (lang:en) -is:retweet -is:reply") == ["1", "2"]
    assert ids(adapters.search_query(["crypto deal", "bitcoin"], ["win"], ["en", "de"])) == ["1", "2", "6"]
    assert ids(adapters.search_query(["crypto"])) == ["2", "3"] and ids("from:new") == ["1"] and ids("is:retweet") == ["5"]
    assert ids("") == ["1", "2", "3", "4", "5", "6"] and ids("(a+b) OR bitcoin[") == []


def test_rules_beyond_what_a_stream_takes(spark):
    rules = adapters.Rules()
    rules.add(spark.range(1000).select(F.col("id").cast("string").alias("value"), F.lit("t").alias("tag")))
    assert len(rules.get()) == 1000
    with pytest.raises(ValueError):
        rules.add(spark.range(1500).select(F.col("id").cast("string").alias("value"), F.lit("t").alias("tag")))
