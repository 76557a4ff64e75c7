"""Ramps, flash mobs, sketches, the audit trail, the store of versions, and plugins as table functions."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swarmlens.operators import audit, reputation, summaries, temporal
from swarmlens.plans.plugins import table_function


def stamped(spark, rows, kind="key string, h double, account long"):
    return spark.createDataFrame(rows, kind).withColumn("ts", F.timestamp_seconds(F.col("h") * 3600))


def test_planted_ramps_are_found(spark):
    r = random.Random(1)
    level = lambda h, key: {"flat": 20, "up": 10 + h // 10, "down": 30 - h // 10, None: 20 if h < 100 else 40}[key]
    rows = [(key, h + (i + 0.5) / 100, 1) for key in ("flat", "up", "down", None) for h in range(200) for i in range(level(h, key) + r.randint(-3, 3))] + [("flat", None, 1), ("once", 5.0, 1)]
    found = {(x["key"], x["direction"]): (x["start_hour"], x["alarm_hour"]) for x in temporal.ramps(stamped(spark, rows), "key", "ts").collect()}
    assert {("up", "up"), ("down", "down"), (None, "up")} <= set(found) and not {k for k in found if k[0] in ("flat", "once")}
    start, alarm = found[None, "up"]
    assert 95 <= start <= 101 and start < alarm < 115


def test_flash_mobs_have_new_accounts_only(spark):
    r = random.Random(2)
    rows = [(key, h + r.random(), r.randint(1, 30)) for key in ("old", "new") for h in range(100) for _ in range(3)]
    rows += [("old", 50 + r.random(), r.randint(1, 30)) for _ in range(60)] + [("new", h + r.random(), a) for h in (70, 71) for a in range(1000, 1060)] + [("new", 70.5, None)]
    found = {(x["key"], x["start_hour"]): x for x in temporal.flash_mobs(stamped(spark, rows), "key", "ts", "account").collect()}
    mob = found["new", 70]
    assert (mob["end_hour"], mob["n_events"]) == (71, 127) and mob["accounts"] > 60 and not mob["is_flash_mob"]  # the usual accounts are in it too
    assert found["old", 50]["new_accounts"] == 0
    alone = [row for row in rows if not (row[0] == "new" and 70 <= row[1] < 72 and (row[2] or 0) < 1000 and row[2] is not None)]
    assert [x["is_flash_mob"] for x in temporal.flash_mobs(stamped(spark, alone), "key", "ts", "account").where("key = 'new' AND start_hour = 70").collect()] == [True]


def test_merged_sketches_are_within_their_bound(spark):
    rows = spark.range(40_000).select((F.col("id") % 24).alias("hour"), F.expr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 1000 <> 1 THEN pmod(xxhash64(id), 100000) END").alias("value"))
    one = summaries.merged(summaries.sketched(rows, [F.col("hour")], "value"), [F.lit("all").alias("all")])
    values = sorted(x["value"] for x in rows.where("value IS NOT NULL").collect())
    for x in summaries.quantiles(one, [0.01, 0.25, 0.5, 0.9, 0.999]).collect():
        low, high = sum(v < x["value"] for v in values), sum(v <= x["value"] for v in values)
        room = summaries.RANK_ERROR * len(values) + 1
        assert x["n"] == len(values) and low <= float(x["quantile"]) * len(values) + room and high >= float(x["quantile"]) * len(values) - room


def test_the_trail_shows_what_was_changed(spark, tmp_path):
    trail = audit.AuditTrail(spark, str(tmp_path / "trail"))
    entries = lambda n: spark.range(50).select((F.col("id") + 50 * n).alias("subject"), F.when(F.col("id") > 3, "name").alias("field"), F.lit("mask").alias("method"))
    for n in range(3):
        assert trail.append(entries(n), "me", "2024-01-01 00:00:00") == n
    assert trail.faults() == [] and trail.rows().count() == 150
    part = f"{trail.path}/rows/batch=1"
    rows = spark.read.parquet(part).collect()
    schema = spark.read.parquet(part).schema
    spark.createDataFrame([r.asDict() | ({"method": "drop"} if i == 7 else {}) for i, r in enumerate(rows)], schema).write.mode("overwrite").parquet(part)
    assert {b for b, _ in trail.faults()} == {1} and len(trail.faults()) == 2
    spark.createDataFrame([r.asDict() for r in rows[:-1]], schema).write.mode("overwrite").parquet(part)  # a row taken out
    assert trail.faults() == [(1, "its rows are not those that were sealed")]
    # all of the batch and its seal replaced: the next batch's seal shows it
    seals = spark.createDataFrame([s.asDict() for s in trail.seals()], "batch int, n bigint, root string, seal string")
    own = audit._roots(trail.rows().where("batch = 1").withColumn("hash", audit.row_hash(F.col("batch")))).first()
    forged = [s.asDict() | ({"n": own["n"], "root": own["root"], "seal": audit._seal(seals.where("batch = 0").first()["seal"], own["n"], own["root"])} if s["batch"] == 1 else {}) for s in seals.collect()]
    spark.createDataFrame(forged, seals.schema).write.mode("overwrite").parquet(f"{trail.path}/seals")
    assert trail.faults() == [(2, "its seal does not follow from the one before")]


def test_a_write_that_breaks_off_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = reputation.Store(str(tmp_path / "store"))
    rows = lambda some, score: spark.createDataFrame([(i, score) for i in some], "id long, score double")
    scores = lambda: {r["id"]: r["score"] for r in store.load(spark).collect()}
    store.save(rows(range(100), 0.5))
    store.merge(rows(range(90, 110), 0.9))
    whole = {i: 0.9 if i >= 90 else 0.5 for i in range(110)}
    assert scores() == whole
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        for change in (lambda: store.save(rows([1], 0.1)), lambda: store.merge(rows([1], 0.1)), lambda: store.delete(rows([1], 0.1))):
            with pytest.raises(OSError):
                change()
    assert scores() == whole
    was = store.version(spark)
    store.delete(rows([3, 200], 0.0))
    assert scores() == {i: s for i, s in whole.items() if i != 3}
    assert {r["id"] for r in store.load_batch(rows([2, 3, 4, 500], 0.0)).collect()} == {2, 4}
    with pytest.raises(RuntimeError):  # a second writer of the same version
        store._publish(spark, was[0] + 1, was[1])


def test_table_plugin_holds_no_partition(spark):
    def step(state, batch):
        return (state[0] + batch.num_rows, max(state[1], batch.num_rows), batch.column("k")[0].as_py())

    def result(state):
        return pa.table({"k": pa.array([state[2]], pa.int64()), "n": pa.array([state[0]], pa.int64()), "largest": pa.array([state[1]], pa.int64())})

    table_function(spark, "counted", lambda: (0, 0, None), step, result, "k bigint, n bigint, largest bigint")
    spark.range(60_000).select(F.expr("if(id % 3 = 0, 0, id % 7)").alias("k")).createOrReplaceTempView("hot_rows")
    found = {r["k"]: r for r in spark.sql("SELECT * FROM counted(TABLE(hot_rows) PARTITION BY k)").collect()}
    assert sum(r["n"] for r in found.values()) == 60_000 and found[0]["n"] > 20_000 and found[0]["largest"] <= 10_000
    table_function(spark, "broken", lambda: 0, lambda state, batch: 1 / 0, result, "k bigint, n bigint, largest bigint")
    with pytest.raises(Exception, match="ZeroDivisionError"):
        spark.sql("SELECT * FROM broken(TABLE(hot_rows) PARTITION BY k)").collect()


def test_nested_settings(tmp_path, monkeypatch):
    from swarmlens.plans.config import DetectionConfig, load_config

    path = tmp_path / "c.yaml"
    assert load_config(str(path)) == DetectionConfig() == load_config(str(path))  # written, and read again
    monkeypatch.setenv("BANDS", "8")
    path.write_text("gui:\n  theme: dark\ndetection:\n  minhash_bands: ${BANDS}\n  enable_hybrid_mode: false\n  minhash_threshold: 1\n")
    assert load_config(str(path)) == DetectionConfig(minhash_bands=8, enable_hybrid_mode=False, minhash_threshold=1.0)
    for wrong in ("detection:\n  no_such: 1\n", "detection:\n  minhash_bands: many\n", "detection:\n  minhash_threshold: 2\n", "minhash_bands: true\n", "- 1\n"):
        path.write_text(wrong)
        with pytest.raises(ValueError):
            load_config(str(path))


def test_links_have_the_components_of_all_pairs(spark):
    from swarmlens.operators import graphs, similarity

    r = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    rows = []
    for g in range(12):
        base = r.choices(words, k=20)
        rows += [" ".join([*base[: r.randint(14, 20)], *r.choices(words, k=r.randint(0, 3))]) for _ in range(8)]
    docs = spark.createDataFrame(list(enumerate(dict.fromkeys(rows))), "id bigint, text string")
    parts = lambda edges: {(x["id"], x["component"]) for x in graphs.connected_components(edges).collect()}
    pairs, links = (f(docs, 16, 8, 0.5) for f in (similarity.minhash_pairs, similarity.minhash_links))
    assert parts(pairs) == parts(links) and links.count() < pairs.count()
    for table in ("minhash", "simhash"):  # leaders without listed pairs
        make, lead, args = (similarity.minhash_pairs, similarity.minhash_leaders, (16, 8, 0.5)) if table == "minhash" else (similarity.simhash_pairs, similarity.simhash_leaders, (4, 20))
        expected = {(x["id"], x["seed"]) for x in graphs.leader_clusters(make(docs, *args), graphs.hashed_order).collect()}
        got = {(x["id"], x["seed"]) for x in lead(docs, *args).collect()}
        assert expected <= got and all(i == seed for i, seed in got - expected) and len(expected) > 20
    same = spark.range(20_000).select("id", F.concat(F.lit(" ".join(words)), F.lit(" extra"), F.col("id").cast("string")).alias("text"))
    found = graphs.connected_components(similarity.minhash_links(same, 16, 8, 0.5))  # two hundred million pairs
    assert found.where("component = 0").count() == 20_000
    leaders = similarity.minhash_leaders(same, 16, 8, 0.5)
    assert leaders.select("seed").distinct().count() < 20 and leaders.count() == 20_000
    assert graphs.forget(spark) > 0 and graphs.forget(spark) == 0


def test_hmac_and_algorithm_statistics(spark):
    import hashlib
    import hmac

    from swarmlens.operators import privacy, similarity

    for key in (b"k", b"x" * 64, b"y" * 100):
        for row in spark.createDataFrame([("",), ("text",), ("\u00fc\u65e5",), (None,)], "t string").select("t", privacy.hmac(F.col("t"), key).alias("m")).collect():
            assert row["m"] == (None if row["t"] is None else hmac.new(key, row["t"].encode(), hashlib.sha256).hexdigest())
    runs = spark.createDataFrame([("a", i, i, v, 1, 0, 0, 1) for i, v in enumerate([0.0, 8.0, 4.0, 0.0, 2.0])] + [("b", 0, 0, 0.0, 0, 0, 0, 0)], "algorithm string, s long, id long, response double, tp int, fp int, tn int, fn int").withColumn("ts", F.timestamp_seconds("s"))
    found = {x["algorithm"]: (x["queries"], x["avg_response"], x["tp"], x["fn"], x["accuracy"]) for x in similarity.algorithm_statistics(runs).collect()}
    assert found == {"a": (5, 2.5, 5, 5, 0.5), "b": (1, 0.0, 0, 0, None)}
