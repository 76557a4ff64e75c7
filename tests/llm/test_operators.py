"""Every operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from oracle import connect, same
from swarmlens.llm import ann, byte_bpe, fingerprints, language_id, lm_scoring, mixing, ngram_join, queries, sharding, substring_dedup, url_filter
from swarmlens.llm.components import components

SMALL = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = [f"w{i}" for i in range(300)]


def edge_documents(spark):
    random.seed(4)
    passage = " ".join(random.choices(WORDS, k=60))
    long = " ".join(random.choices(WORDS, k=30_000))
    rows = [(1, None), (2, ""), (3, "one"), (4, "one"), (5, passage), (6, "head " + passage + " tail"), (7, long), (7, long), (None, "no id at all here"), (8, "\t \n"), (9, "Ünï çödé 日本語 😀 x"), (10, passage.replace("w1 ", "w2 ", 1))]
    return spark.createDataFrame([(i, t, None if i == 3 else "en", None if i == 4 else "src0", None) for i, t in rows], KIND)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SMALL)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_substring_dedup_edges(spark):
    docs = edge_documents(spark).withColumn("kept_text", F.lit("clash"))
    rows = substring_dedup.dedup_substrings(docs, chunk_bytes=50_000).collect()
    data = [words_of(r["text"]) for r in rows]
    seen = Counter(tuple(w[i : i + 35]) for w in data for i in range(len(w) - 34))
    assert len(rows) == 12
    for r, w in zip(rows, data):
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert r["kept_text"] == (r["text"] if not gone else kept) and sum(s["end"] - s["start"] for s in r["removed"]) == len(gone)
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_byte_bpe_equals_rank_merges(spark):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = edge_documents(spark).union(spark.read.parquet(f"{SMALL}/documents.parquet")).withColumn("ids", F.lit(0))
    rows = byte_bpe.decode_documents(byte_bpe.encode_documents(docs, with_offsets=True)).collect()
    for r in rows:
        ids = plain.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["decoded_text"] == (r["text"] or "") and len(r["offsets"]) == len(ids)
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    assert byte_bpe.encode_documents(docs.limit(0)).count() == 0
    random.seed(1)
    for _ in range(500):
        text = "".join(random.choices(["=", "aa", " ", "\n", "é", "日", "1", "'s", "<|endoftext|>", "\x85", "\u3000"], k=30))
        assert byte_bpe.load().encode([text])[0].tolist() == plain.encode_ordinary(text)


def test_language_id(spark):
    rows = queries.QUERIES["op3_language_id"](spark, "/root/testdata/sf0.01").collect()
    truth = dict(connect("/root/testdata/sf0.01").sql("SELECT doc_id, lang FROM documents").fetchall())
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.97
    docs = spark.createDataFrame([(i, w and w * 40, lang) for i, (w, lang) in enumerate([("the cat sat on mats ", "en"), ("der hund und katze ", "de"), ("мир труд май ", "ru"), (None, "en"), ("no label ", None)])], "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    mixed = spark.createDataFrame([(1, "the cat sat on mats " * 5 + "der hund und katze " * 5), (2, None), (3, "12 34 !"), (4, "мир")], "doc_id bigint, text string").withColumn("score", F.lit("clash"))
    found = {r["doc_id"]: r for r in language_id.predict(mixed, model, with_spans=True).collect()}
    assert [s["lang"] for s in found[1]["lang_spans"]] == ["en", "de"] and 0.5 <= found[1]["score"] < 0.7
    assert [found[i]["lang_pred"] for i in (2, 3, 4)] == ["und", "und", "ru"] and found[2]["score"] == 0
    assert language_id.train(docs.limit(0)) is None and language_id.predict(mixed, None).first()["lang_pred"] == "und"


def test_viterbi_against_all_paths():
    random = np.random.default_rng(0)
    scores = random.normal(size=(6, 3)).astype(np.float32)
    ids = [np.array(random.integers(0, 6, n), np.int32) for n in (5, 0, 1, 4)]
    for x, y in zip(ids, language_id.viterbi(scores, ids, 0.7)):
        cost = lambda p: sum(scores[w, k] for w, k in zip(x, p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))
        best = max(cost(p) for p in np.ndindex(*[3] * len(x))) if len(x) else 0
        assert len(y) == len(x) and cost(y) == pytest.approx(best, abs=1e-5)


def test_url_filter_edges(spark):
    urls = ["http://a.b.COM/en/1", None, "", "no scheme", "http://example.com/en/7?x", "https://example.com/en/8", "x://net", "http://evilnet/de/", "http://.net/de/", "ftp://sub.example.net/de/80#f", "http://org?/es/", "http://É.org/es/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string").withColumn("host", F.lit(1))
    found = [(r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).orderBy("page_id").collect()]
    assert found[0] == ("a.b.com", "com/en/", "block") and found[1] == found[2] == found[3] == ("", None, "allow")
    assert found[4][1:] == ("example.com/en/7", "allow") and found[5][1:] == ("com/en/", "block") and found[7][1] is None and found[9][1] == "example.net/de/8" and found[10][1] is None
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    assert [(r["host"], r["rule"], r["verdict"]) for r in url_filter.judge_urls_sharded(pages, rules).orderBy("page_id").collect()] == found
    with pytest.raises(ValueError):
        url_filter.judge_urls(pages, most_bytes=10)


def test_url_index_confirms_strings():
    index = url_filter.Index(url_filter.build_index([("block", f"h{i}.com", "/") for i in range(1000)]))
    assert (index.find([f"h{i}.com\0/".encode() for i in range(1000)]) >= 0).all() and (index.find([b"x\0/"]) < 0).all()
    index.keys = np.zeros_like(index.keys) + index.keys[0]  # as if all digests collided
    assert index.find([b"other\0/"])[0] == -1


def test_ann_recall_and_edges(spark):
    rows = queries.QUERIES["op5_ann"](spark, "/root/testdata/sf0.1").collect()
    data = connect("/root/testdata/sf0.1").sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([d[0] for d in data]), np.array([d[1] for d in data], float)
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        near = x @ x[i]
        near[i] = -np.inf
        top = ids[np.lexsort((ids, -near))[:20]]
        assert len(got[ids[i]]) == 20
        hits += len(set(top) & set(got[ids[i]]))
    assert hits / (20 * len(got)) >= 0.9
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0]), (120, [1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [0.5, 0.0]), (None, [0.9, 0.0])]
    df = spark.createDataFrame(bad + good, "vec_id bigint, embedding array<double>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1.0), (0, 2, 1.0), (0, None, 0.9), (0, 2, 0.5)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def winnow(text, k=4, w=8):
    """(position of the rightmost least gram of each window), with gram identity instead of hashes."""
    words = words_of(text)
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


def test_fingerprints_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    for r in fingerprints.fingerprints(docs).collect():
        grams = winnow(r["text"])
        code = {g: h for g, h in ((grams[f["pos"]], f["hash"]) for f in r["fingerprint"])}
        assert all(code[grams[f["pos"]]] == f["hash"] for f in r["fingerprint"])
        places = [f["pos"] for f in r["fingerprint"]]
        assert places == sorted(set(places))
        last = max(len(grams) - 8, 0)
        for i in range(last + 1):  # the guarantee: a selected gram in every window
            assert any(i <= p < i + 8 for p in places)
    a = spark.createDataFrame([(1, "x " * 50)], "doc_id bigint, text string")
    assert [f["pos"] for f in fingerprints.fingerprints(a).first()["fingerprint"]] == list(range(7, 47))  # ties: the rightmost
    rows = fingerprints.compare_with_edits(edge_documents(spark).select("doc_id", "text")).collect()
    order = sorted({(r["doc_id"], r["text"] or "") for r in edge_documents(spark).collect()}, key=lambda d: (d[0] is None, -(d[0] or 0)))
    by = {}
    for (d, t), (_, n) in zip(order, order[1:] + order[:1]):
        by[d] = hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()
    assert len(rows) == 12 and all(r["edited_sha256"] == by[r["doc_id"]] and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.compare_with_edits(edge_documents(spark).select("doc_id", "text").limit(0)).count() == 0


def test_lm_scores(spark):
    rows = queries.QUERIES["op7_lm_scoring"](spark, SMALL).collect()
    docs = dict(connect(SMALL).sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    tokens = {d: [*words_of(t.translate(low)), None] for d, t in docs.items()}
    counts = Counter(t for d in docs if zlib.crc32(str(d).encode()) % 5 != 1 for t in tokens[d])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(mine), sum(counts[t] > 0 for t in mine), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in mine), rel=1e-9)
        assert r["score"] < 0
    size = sum(len(docs[r["doc_id"]].encode()) + 1 for r in rows if r["held_out"])
    assert -sum(r["score"] for r in rows if r["held_out"]) / math.log10(2) / size < 4  # bits per byte of unseen text
    edges = lm_scoring.score_documents(edge_documents(spark).withColumn("score", F.lit(1)), F.col("doc_id") < 6).collect()
    assert len(edges) == 12 and all(r["score"] < 0 for r in edges)
    none = lm_scoring.score_documents(edge_documents(spark), F.lit(False)).where("doc_id = 3").first()
    assert none["base_score"] == 0 and none["bits_per_byte"] == 8 and none["n_known"] == 0
    assert lm_scoring.score_documents(edge_documents(spark).limit(0), F.lit(True)).count() == 0


def test_lm_probabilities_sum_to_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    from swarmlens.llm import chunks

    packed = chunks.pack(docs.withColumn("t", F.lit(True)), "text", 1 << 20, 8)
    model = lm_scoring.train_model(packed, "text", "t", 64)
    context = int.from_bytes(b" the ", "big") << 8
    total = (2 ** lm_scoring.bits_of(model, np.uint64(context) + np.arange(256, dtype=np.uint64))).sum()
    assert total == pytest.approx(1, abs=1e-6)


def test_lm_counts_are_exact_whatever_the_corpus(spark):
    """Some two million distinct six-byte strings: far more nodes than a fixed table has slots."""
    random.seed(8)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-+=/"
    texts = ["".join(random.choices(letters, k=200_000)) for _ in range(10)]
    texts.append(texts[3][500:560] + texts[5][900:940])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    from swarmlens.llm import chunks

    packed = chunks.pack(docs.withColumn("t", F.col("doc_id") < 10), "text", 1 << 20, 8)
    model = lm_scoring.train_model(packed, "text", "t", 64)
    train = np.concatenate([lm_scoring._grams(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in texts[:10]])
    asked = lm_scoring._grams(np.frombuffer(texts[10].encode(), np.uint8), np.array([0, len(texts[10])]))[0]
    expected = np.zeros(len(asked))
    for k, code in enumerate(asked.tolist()):
        after = [(train[(train >> np.uint64(8) & np.uint64(256**o - 1)) == np.uint64(code >> 8 & 256**o - 1)] & np.uint64(255)).astype(int) for o in range(1, 6)]
        place = lm_scoring._places(np.array([code], np.uint64))
        for b in range(8):
            bit = code >> 7 - b & 1
            same = [a[(a | 256) >> 8 - b == (code & 255 | 256) >> 8 - b] >> 7 - b & 1 for a in after]
            x, gate = lm_scoring._features([np.array([(s == 0).sum()]) for s in same], [np.array([s.sum()]) for s in same], b, place)
            p = np.clip(lm_scoring._refine(model, (model["weights"][gate] * x).sum(axis=1), b), 1 / 65536, 1 - 1 / 65536)[0]
            expected[k] += math.log2(p if bit else 1 - p)
    assert lm_scoring.bits_of(model, asked) == pytest.approx(expected, abs=1e-9)
    scored = lm_scoring.score_documents(docs, F.col("doc_id") < 10, chunk_bytes=1 << 20).where("doc_id = 10").first()
    assert scored["score"] == pytest.approx(expected.sum() * math.log10(2), rel=1e-5)


def test_lm_weights_are_learned_from_every_string(spark):
    """At the weights the slope over all training strings is close to nothing, and the map is that of all strings."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    from swarmlens.llm import chunks

    model = lm_scoring.train_model(chunks.pack(docs.withColumn("t", F.lit(True)), "text", 1 << 20, 8), "text", "t", 64)
    rows = model["strings"].collect()
    assert sum(r["n"] for r in rows) > 1 << 17
    slope, size, hits, seen = 0, 0, np.zeros((8, 33)), np.zeros((8, 33))
    for r in rows:
        codes, counts = lm_scoring._get(r["codes"], r["n"], np.uint64), lm_scoring._get(r["counts"], r["n"], np.int64)
        for b, (x, gate, bit, weight) in enumerate(lm_scoring._examples(model["low"], codes, counts, np.arange(len(codes)))):
            mixed = (model["weights"][gate] * x).sum(axis=1)
            error = (bit - 1 / (1 + np.exp(-np.clip(mixed, -30, 30)))) * weight
            slope = slope + np.stack([np.bincount(gate, error * x[:, o], lm_scoring._GATES) for o in range(6)], axis=1)
            size = size + np.stack([np.bincount(gate, weight * abs(x[:, o]), lm_scoring._GATES) for o in range(6)], axis=1)
            place = np.clip((mixed + 8) * 2 + 0.5, 0, 32).astype(int)
            hits[b] += np.bincount(place, weight * bit, 33)
            seen[b] += np.bincount(place, weight, 33)
    assert np.abs(slope).sum() < 1e-3 * size.sum()
    prior = 1 / (1 + np.exp(8 - np.arange(33) / 2))
    assert model["map"] == pytest.approx((hits + 20 * prior) / (seen + 20), abs=1e-6)


def test_sharding_edges(spark):
    docs = edge_documents(spark).withColumn("shard", F.lit("clash"))
    rows = sharding.assign_shards(docs, limit=1000).collect()
    assert len(rows) == 12 and {r["doc_id"] for r in rows if not r["fits"]} == {7}
    shards = {}
    for r in rows:
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["n_bytes"]
    assert all(size <= 1000 or len(s) == 60 for s, size in shards.items()) and not any(a != b and b.startswith(a) for a in shards for b in shards)
    assert sharding.assign_shards(docs.limit(0)).count() == 0


def test_mixing_edges(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3000, "a").when(F.col("id") < 3900, "b").when(F.col("id") < 3950, "c").alias("source"), F.lit("x").alias("copy"))
    rows = mixing.mix_sources(docs, {"a": 1, "b": 1, "c": 2, "missing": 5}).collect()
    n = Counter(r["source"] for r in rows)
    total = 3950
    for s, share in (("a", 0.25), ("b", 0.25), ("c", 0.5)):
        assert n[s] == pytest.approx(total * share, rel=0.1)
    assert 20 < n[None] < 90 and len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mix_sources(docs, {"a": 1, "b": 0}).where("source = 'b'").count() == 0
    assert mixing.poisson_cdf(2.0)[:2] == pytest.approx([math.exp(-2), 3 * math.exp(-2)])


def test_ngram_join_edges_and_large_groups(spark):
    rows = {(r["doc_id"], r["class_id"]): r for r in ngram_join.near_duplicates(edge_documents(spark)).collect()}
    by = {d: c for d, c in rows}
    assert by[3] == by[4] == 3 and by[1] == 1 and by[2] == 2 and by[8] == 8 and by[None] is None
    assert ngram_join.near_duplicates(edge_documents(spark).limit(0)).count() == 0
    random.seed(2)
    base, texts = random.choices(WORDS, k=200), []
    for _ in range(300):
        w = list(base)
        for _ in range(random.randint(0, 5)):
            w[random.randrange(200)] = random.choice(WORDS)
        texts.append(" ".join(w))
    docs = spark.createDataFrame(list(enumerate(texts + texts[:40])), "doc_id bigint, text string")
    kept = ngram_join.BLOCK_ROWS
    ngram_join.BLOCK_ROWS = 64  # several blocks
    try:
        found = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs).collect()}
    finally:
        ngram_join.BLOCK_ROWS = kept
    sets = {t: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for t in set(texts) for w in [t.split()]}
    for i, t in enumerate(texts):
        links = sum(len(s & sets[t]) >= 0.8 * len(s | sets[t]) - 1e-9 for u, s in sets.items() if u != t)
        assert found[i]["n_links"] == links and found[i]["n_copies"] == (texts + texts[:40]).count(t)
    assert ngram_join.choose_bands(0.8, 0.9999, 256) == (31, 6)


def test_ngram_join_counts_a_pair_once_beside_empty_blocks(spark):
    random.seed(6)
    texts = []
    for g in range(24):  # groups of two to four near copies; the bytes, not the rows, ask for several blocks
        base = [f"g{g}x{k}" for k in range(60)]
        texts += [" ".join([*base[:-1], f"end{c}"]) for c in range(2 + g % 3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = ngram_join.BLOCK_BYTES
    ngram_join.BLOCK_BYTES = 500
    try:
        found = {r["doc_id"]: r for r in ngram_join.near_duplicates(docs).collect()}
    finally:
        ngram_join.BLOCK_BYTES = kept
    groups = Counter(t.split("x")[0] for t in texts)
    first = {}
    for i, t in enumerate(texts):
        g = t.split("x")[0]
        assert (found[i]["n_links"], found[i]["class_id"]) == (groups[g] - 1, first.setdefault(g, i))


def test_components_of_a_long_chain_end(spark):
    """Rounds are tables with sizes of their own: on checkpointed frames the planner's estimates grew until it did not come back."""
    key = F.unhex(F.md5(F.col("id").cast("string")))
    chain = spark.range(3000).select(key.alias("a"), F.unhex(F.md5((F.col("id") + 1).cast("string"))).alias("b"))
    found = components(chain).agg(F.count("*").alias("n"), F.countDistinct("root").alias("roots"), F.first("root").alias("root")).first()
    least = min(hashlib.md5(str(i).encode()).digest() for i in range(3001))
    assert (found["n"], found["roots"], bytes(found["root"])) == (3000, 1, least)


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = edge_documents(spark)
    one = cp.identify_language(spark, docs, SMALL)
    assert {r["doc_id"] for r in one.collect()} == {3, 4, 5, 6, 7, 9, 10, None} and one.columns == docs.columns
    two = cp.drop_near_duplicates(spark, docs, SMALL)
    # 6 and 10 share at least .8 of their shingles with 5, 4 is a copy of 3, and the rows of 7 repeat each other
    assert sorted(r["doc_id"] for r in two.where("doc_id IS NOT NULL").collect()) == [1, 2, 3, 5, 7, 8, 9] and two.where("doc_id IS NULL").count() == 1
    three = {r["doc_id"]: r for r in cp.drop_repeated_passages(spark, docs, SMALL).collect()}
    assert three[6]["text"] == "head tail" and three[6]["n_chars"] == 9 and three[3]["text"] == "one"
    out = cp.run(spark, SMALL)
    assert {"doc_id", "n_tokens", "ids_sha256"} <= set(out.columns) and out.count() > 50
