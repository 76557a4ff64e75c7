"""Pairs of near texts found inside their buckets."""

from __future__ import annotations

import re

import pytest

from swarmlens.operators import graphs, similarity


def near_texts():
    """Groups of near and of equal signatures, short and long, and texts without words."""
    base = [f"word{i} alpha{i % 7}" for i in range(60)]
    rows = [" ".join(base[: 60 - k % 3] + [f"end{k}"] * (k % 5)) for k in range(40)]
    rows += [f"{' '.join(base[20:50])} tail{k}" for k in range(20)] + [f"{' '.join(base[:6])} {' '.join(f'x{k}y{i}' for i in range(3))}" for k in range(6)] + ["hello there you", "Hello there, you", "hello THERE you!", "", "?", "a b"]
    return list(enumerate(rows))


@pytest.mark.parametrize("part", [3, 2048])
def test_joint_pairs_against_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(similarity, "MINHASH_PART", part)
    monkeypatch.setattr(similarity, "SIMHASH_PART", part)
    docs = spark.createDataFrame(near_texts(), "id bigint, text string").selectExpr("*", "length(text) AS n")
    sig = {r["id"]: r["sig"] for r in similarity.minhash(docs, 64).collect()}
    bits = {r["id"]: r["simhash"] & (1 << 64) - 1 for r in similarity.simhash(docs).collect()}
    size = {i: len(t) for i, t in near_texts()}
    expected = set()
    for a in bits:
        for b in (b for b in bits if a < b):
            m = sum(x == y for x, y in zip(sig[a], sig[b])) / 64 if a in sig and b in sig and any(sig[a][4 * k : 4 * k + 4] == sig[b][4 * k : 4 * k + 4] for k in range(16)) else 0
            d = bin(bits[a] ^ bits[b]).count("1")
            if m >= 0.5 or d <= 3:
                expected.add((a, b, m if m >= 0.5 else None, 1 - d / 64 if d <= 3 else None, size[a]))
    assert len({(m is None, s is None) for _, _, m, s, _ in expected}) == 3, {(m is None, s is None) for _, _, m, s, _ in expected}
    found = list(map(tuple, similarity.joint_pairs(docs, 64, 16, 0.5, size="n").collect()))
    assert len(found) == len(set(found)) and set(found) == expected
    common = list(map(tuple, similarity.joint_pairs(docs, 64, 16, 0.5, common=True).collect()))
    assert sorted(common) == sorted(x[:4] for x in expected if None not in x)
    assert sorted(map(tuple, similarity.minhash_pairs(docs, 64, 16, 0.5).collect())) == sorted(x[:3] for x in expected if x[2] is not None)
    assert sorted((r["a"], r["b"], r["similarity"]) for r in similarity.simhash_pairs(docs).collect()) == sorted((x[0], x[1], x[3]) for x in expected if x[3] is not None)


@pytest.mark.parametrize("name", ["L21_hybrid_weighted", "L22_hybrid_max", "L23_hybrid_min", "L24_hybrid_adaptive", "L25_hybrid_consensus", "L26_length_weights", "L24_recorded_weights"])
def test_no_pair_meets_another(spark, name):
    """Pairs are shuffled neither to be told apart nor to be joined: near copies would cost disk by their square."""
    from swarmlens.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "FullOuter" not in plan and "Join" not in plan.split("MapInArrow")[0]
    assert not re.search(r"Aggregate \[a#\d+L?, b#", plan)


@pytest.mark.parametrize("most", [4, 512])
def test_leader_rounds_send_no_table_to_the_driver(spark, monkeypatch, most):
    """Files of ids are under the limit of broadcasts while their rows are more than a driver holds."""
    plans, written = [], graphs.written
    monkeypatch.setattr(graphs, "written", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or written(df))
    monkeypatch.setattr(similarity, "bucket_leaders", lambda keyed, near, most_=most, **rest: graphs.bucket_leaders(keyed, near, **{**rest, "most": most_, "last": 8}))
    docs = spark.createDataFrame(near_texts(), "id bigint, text string")
    leaders = similarity.simhash_leaders(docs)
    assert leaders.count() and plans
    plans.append(leaders._jdf.queryExecution().sparkPlan().toString())
    assert any("SortMergeJoin" in plan for plan in plans) and not any("Broadcast" in plan for plan in plans)


@pytest.mark.parametrize("part", [3, 256])
def test_exact_pairs_against_brute_force(spark, part):
    rows = near_texts()
    words = {i: [w for w in re.findall(r"\w+", t.lower()) if len(w) > 2] for i, t in rows}
    sets = {i: {" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)} for i, w in words.items()}
    docs = spark.createDataFrame(rows, "id bigint, text string")
    pairs = {(r["a"], r["b"]) for r in similarity.minhash_pairs(docs, 64, 16, 0.5).collect()}
    found = list(map(tuple, similarity.exact_pairs(docs, 64, 16, 0.5, part).collect()))
    assert pairs and sorted(found) == sorted((a, b, len(sets[a] & sets[b]), len(sets[a]) + len(sets[b])) for a, b in pairs)
