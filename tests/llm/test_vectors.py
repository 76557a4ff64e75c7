"""The operators on embedding vectors against brute force, and on nulls, bad components, ties, copies, lengths and empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmlens.llm import centroid_trees, near_vectors, whitening

KIND = "vec_id bigint, embedding array<float>, label int, v string, node int, x double, w int"
BAD = [None, [], [0.0] * 64, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [1.0] * 63 + [float("inf")]]


def table(spark, vectors, ids=None):
    """A table with columns named like those that operators use inside."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, "own", 2, 3.0, 4) for i, v in zip(ids or range(len(vectors)), vectors)], KIND)


def planted(seed=3):
    """Unit vectors: some alone, pairs, a chain, a loose and a tight group, copies, vectors of another length, and bad ones."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    lone = unit(r.normal(size=(300, 64)))
    loose = unit(unit(r.normal(size=64)) + r.normal(size=(150, 64)) * 0.027)  # cosines about .955
    tight = unit(unit(r.normal(size=64)) + r.normal(size=(200, 64)) * 0.005)
    chain, a, b = [], *np.linalg.qr(r.normal(size=(64, 2)))[0].T
    for i in range(20):
        chain.append(math.cos(0.3 * i / 2) * a + math.sin(0.3 * i / 2) * b)  # neighbours at cos(.15), the next but one at cos(.3) = .955
    short = unit(r.normal(size=(20, 8)))
    short[1] = short[0] * 2
    return [*map(list, [*lone, *loose, *tight, *chain, *short, lone[0], lone[0], lone[1] * 7, lone[2] * 1e30]), *BAD]


def brute_links(vectors, threshold=0.95):
    """Rows' links by all pairs."""
    good = {i: np.array(v, np.float32).astype(float) for i, v in enumerate(vectors) if v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links = {i: set() for i in range(len(vectors))}
    for size in {len(v) for v in good.values()}:
        at = [i for i in good if len(good[i]) == size]
        x = np.array([good[i] / np.abs(good[i]).max() for i in at])
        x /= np.linalg.norm(x, axis=1)[:, None]
        near = x @ x.T >= threshold
        for p, i in enumerate(at):
            links[i] = {at[q] for q in np.flatnonzero(near[p]) if q != p}
    return links


def least_reached(links, ids):
    out = {}
    for i in links:
        seen, stack = {i}, [i]
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        out[i] = min((ids[j] for j in seen if ids[j] is not None), default=None)
    return out


@pytest.mark.parametrize("bucket, tile", [(near_vectors.BUCKET, near_vectors.TILE), (4, 64), (10_000, 64)])
def test_near_vectors_equal_all_pairs(spark, bucket, tile):
    vectors = planted()
    ids = list(range(len(vectors)))
    random.Random(1).shuffle(ids)
    ids[5] = None
    links = brute_links(vectors)
    least = least_reached(links, ids)
    rows = near_vectors.link_vectors(table(spark, vectors, ids), bucket=bucket, tile=tile).collect()
    expected = {ids[i]: (len(links[i]), least[i]) for i in links}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}
    assert len(rows) == len(vectors) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
    wrong = [i for i in expected if got[i] != expected[i]]
    assert not wrong, [(i, got[i], expected[i]) for i in wrong[:5]]


def test_near_vectors_edges(spark):
    assert near_vectors.link_vectors(table(spark, BAD)).where("n_links = 0 AND component_id = vec_id AND kept AND n_copies = 1").count() == len(BAD)
    assert near_vectors.link_vectors(table(spark, [[1.0] * 64]).limit(0)).count() == 0
    one = [[1.0, 2.0]] * 50  # copies alone, in one dimension less than tables need
    rows = near_vectors.link_vectors(table(spark, one, [None] + list(range(1, 50)))).collect()
    assert {(r["n_links"], r["component_id"], r["n_copies"]) for r in rows} == {(49, 1, 50)}
    assert [r["kept"] for r in rows if r["vec_id"] is None] == [False]


def test_codes_are_balanced_and_find_pairs_at_the_threshold(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(5000, 64)) * np.linspace(2, 0.5, 64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    m = near_vectors.fit(x, len(x))
    bits = near_vectors._bits(m, x)
    assert abs(bits.mean(axis=0) - 0.5).max() < 0.01
    rotation = near_vectors._rotation((x - x.mean(axis=0)), 0)
    assert np.abs(rotation @ rotation.T - np.eye(64)).max() < 1e-9
    loss = lambda v: ((np.where(v >= 0, 1, -1) - v) ** 2).sum()
    centred = (x - x.mean(axis=0)) * 8
    assert loss(centred @ rotation) < loss(centred @ np.linalg.qr(r.normal(size=(64, 64)))[0])
    aside = r.normal(size=x.shape)
    aside -= (aside * x).sum(axis=1, keepdims=True) * x
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    keys = [near_vectors._keys(near_vectors._bits(m, z), m["width"], m["tables"]) for z in (x, y)]
    assert (keys[0] == keys[1]).any(axis=1).mean() > 0.998


def test_forest_spans_what_is_linked():
    r = np.random.default_rng(2)
    linked = r.random((60, 40)) < 0.03
    parent = near_vectors._forest(linked)
    links = {i: set(60 + np.flatnonzero(linked[i])) if i < 60 else set(np.flatnonzero(linked[:, i - 60])) for i in range(100)}
    assert all(p < 0 or p in links[i] for i, p in enumerate(parent))
    tree = {i: set() for i in links}
    for i, p in enumerate(parent.tolist()):
        if p >= 0:
            tree[i].add(p)
            tree[p].add(i)
    ids = list(range(100))
    assert least_reached(links, ids) == least_reached(tree, ids)


def brute_lloyd(rows, k, rounds=5):
    x = [(i, [math.floor(256 * c) for c in v]) for i, v in rows]
    order = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[0] or 0, r[1]))
    c = [v for _, v in order[:k]]

    def assign():
        return [min((sum((p - q) ** 2 for p, q in zip(v, w)), j) for j, w in enumerate(c)) for _, v in x]

    for _ in range(rounds):
        groups = {}
        for (_, v), (_, j) in zip(x, assign()):
            groups.setdefault(j, []).append(v)
        c = [[sum(column) // len(groups[j]) for column in zip(*groups[j])] if j in groups else w for j, w in enumerate(c)]
    out = assign()
    inertia = {j: sum(d for d, q in out if q == j) for j in range(len(c))}
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(x, out))


@pytest.mark.parametrize("block", [1024, 37])
def test_dual_tree_lloyd_equals_plain_rounds(spark, block, monkeypatch):
    r = np.random.default_rng(6)
    groups = np.concatenate([r.normal(size=64) * 0.2 + r.normal(size=(40, 64)) * s for s in (0.001, 0.02, 0.1, 0.2)])
    vectors = [list(map(float, v)) for v in np.concatenate([groups, groups[:30], np.zeros((60, 64)), np.tile(groups[100], (40, 1))]).astype(np.float32)] + [v if v is None else list(v) for v in BAD]
    ids = [None if i % 50 == 7 else i // 2 for i in range(len(vectors))]  # repeated and null ids
    monkeypatch.setattr(centroid_trees, "pack", lambda rows, dim, _, pack=centroid_trees.pack: pack(rows, dim, block))
    got = centroid_trees.clustered(table(spark, vectors, ids)).collect()
    kept = [(i, v) for i, v in zip(ids, vectors) if v and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    found = sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in got)
    assert found == brute_lloyd(kept, 40)


def test_dual_tree_edges(spark):
    assert centroid_trees.clustered(table(spark, [None, [1.0]])).count() == 0
    few = centroid_trees.clustered(table(spark, [[0.1] * 64, [-0.1] * 64, [0.1] * 64])).collect()
    assert sorted(r["distance"] for r in few) == [0, 0, 0] and len({r["cluster"] for r in few}) == 2
    with pytest.raises(Exception, match="component of"):
        centroid_trees.clustered(table(spark, [[1e9] * 64])).count()


def test_trees_cover_and_prune():
    r = np.random.default_rng(9)
    centres = r.normal(size=(40, 64)) * 60
    x = (centres[r.integers(0, 40, 1000)] + r.normal(size=(1000, 64)) * 4).astype(np.int32)
    tree = centroid_trees.cover_tree(x)
    for centre, radius, start, end in zip(tree.centre, tree.radius, tree.start, tree.end):
        members = tree.order[start:end]
        assert centre in members and (np.linalg.norm(x[members] - x[centre], axis=1) <= radius * (1 + 1e-12)).all()
    c = np.floor(centres).astype(np.int64)
    over, least = centroid_trees.centroid_tree(c)
    seen = []
    start, end, nearest = centroid_trees.descend(x, tree, c, over, least, seen)
    got = np.empty(1000, int)
    for a, b, j in zip(start, end, nearest):
        got[tree.order[a:b]] = j
    assert (got == ((x[:, None].astype(np.int64) - c) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert sum(seen) < 0.4 * 1000 * 40  # pairs of nodes measured, of all pairs


def brute_whitening(rows):
    """{id: ...} by exact integers and one covariance over all distinct vectors."""
    x = [(i, tuple(math.floor(256 * c) for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, sums, values, vectors, x


def test_whitening_equals_one_covariance(spark):
    r = np.random.default_rng(4)
    vectors = [list(map(float, v)) for v in (r.normal(size=(400, 16)) * np.linspace(3, 0.2, 16) + 5).astype(np.float32)]
    vectors += vectors[:50] + [vectors[3]] * 200  # copies weigh once
    bad = [None, [1.0] * 15 + [None], [1.0] * 15 + [float("nan")], []]
    ids = [i // 2 if i % 9 else None for i in range(len(vectors) + len(bad))]
    rows = whitening.whiten(table(spark, vectors + bad, ids).repartition(7)).collect()
    n, sums, values, axes, x = brute_whitening(list(zip(ids, vectors)))
    assert len(rows) == 4 * len(vectors) and {r["n"] for r in rows} == {n}
    expected = {}
    for i, v in x:
        expected.setdefault((i, sum((n * c - s) ** 2 for c, s in zip(v, sums))), []).append(((np.array(v) - np.array(sums) / n) @ axes[:, :4]) / np.sqrt(values[:4]))
    sign = {}
    for r in rows:
        near = [e[r["component"] - 1] for e in expected[r["vec_id"], r["deviation"]]]
        s = sign.setdefault(r["component"], 1 if any(abs(e - r["whitened"]) < 1e-9 for e in near) else -1)
        assert any(abs(s * e - r["whitened"]) < 1e-9 for e in near)
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9


def test_merged_statistics_do_not_depend_on_the_cut():
    r = np.random.default_rng(5)
    y = r.normal(size=(1000, 6)) * 3 + 1e6
    whole = whitening.summary(y)
    parts = whitening.summary(y[:1])
    for a, b in ((1, 17), (17, 600), (600, 1000)):
        parts = whitening.merged(parts, whitening.summary(y[a:b]))
    assert parts[0] == 1000 and np.abs(parts[1] - whole[1]).max() < 1e-7 and np.abs(parts[2] / whole[2] - 1).max() < 1e-6


def test_whitening_edges(spark):
    assert whitening.whiten(table(spark, [None, [], [1.0, None]])).count() == 0
    rows = whitening.whiten(table(spark, [[1.0, 2.0]] * 3 + [[1.0, 2.0, 3.0], [2.0, 2.0, 3.0]])).collect()
    assert sorted({(r["n"], r["component"], round(r["explained"], 9), abs(round(r["whitened"], 9)), r["identity_error"]) for r in rows}) == [(1, 1, 0, 0, 1), (1, 2, 0, 0, 1), (2, 1, 1, 1, 1), (2, 2, 0, 0, 1), (2, 3, 0, 0, 1)]
    assert {r["deviation"] for r in rows if r["n"] == 2} == {256**2}
    far = whitening.whiten(table(spark, [[1e12, 0.0], [-1e12, 1.0], [0.0, 2.0]])).collect()  # products beyond 64 bits
    assert len(far) == 6 and all(math.isfinite(r["whitened"]) for r in far) and {r["deviation"] for r in far if r["vec_id"] != 2} == {None}


def test_whitening_of_no_rows(spark):
    assert whitening.whiten(table(spark, [[1.0]]).where(F.lit(False))).count() == 0
