"""Whole results against plain Python, and awkward inputs: repeated and null ids, clashing names, empty tables, long texts, hot groups."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from oracle import connect
from swarmlens.llm import ann, byte_bpe, fingerprints, language_id, lm_scoring, mixing, ngram_join, queries, sharding, substring_dedup, url_filter

SMALL = "/root/testdata/sf0.001"
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside or give out.
CLASHES = "key rep kept_id nth _train _prefix leaf _key _cdf _n _u _parts _source _row rate copy shuffle_key n_words n_removed kept_text score lang_pred class_id n_links n_copies n_tokens ids depth shard fits _sel _b _w bucket chunk block value row part".split()


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def clashing(docs):
    return docs.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def own_key(doc_id, text):
    """What a row is drawn and dealt by: its id or, without one, its text's digest."""
    return str(doc_id) if doc_id is not None else "text|" + hashlib.md5((text or "").encode()).hexdigest()


def near_classes(texts):
    """A class number for each distinct text, by all pairs."""
    texts = sorted(set(texts))
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {t: find(i) for i, t in enumerate(texts)}


def plain_deduplicated(rows):
    """Of each class the row with the least id (null last), then the least text digest; null texts stay."""
    number, best = near_classes([r["text"] for r in rows if r["text"] is not None]), {}
    for r in rows:
        if r["text"] is not None:
            rank = (r["doc_id"] is None, r["doc_id"] or 0, hashlib.md5(r["text"].encode()).digest())
            if number[r["text"]] not in best or rank < best[number[r["text"]]][0]:
                best[number[r["text"]]] = (rank, r)
    return [r for _, r in best.values()] + [r for r in rows if r["text"] is None]


def plain_cut(rows):
    data = [words_of(r["text"]) for r in rows]
    seen, out = Counter(tuple(w[i : i + 35]) for w in data for i in range(len(w) - 34)), []
    for r, w in zip(rows, data):
        gone = {i + k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(35)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else r["text"]
        out.append(r | {"text": text, "n_chars": None if text is None else len(text)})
    return out


def plain_mixed(rows):
    listed = Counter(r["source"] for r in rows if r["source"] in mixing.WEIGHTS)
    total, whole, out = sum(listed.values()), sum(mixing.WEIGHTS[s] for s in listed), []
    for r in rows:
        rate = total * mixing.WEIGHTS[r["source"]] / whole / listed[r["source"]] if r["source"] in listed else 1.0
        assert rate <= 16
        u = int(hashlib.md5(f"{mixing.SEED}|{own_key(r['doc_id'], r['text'])}|0".encode()).hexdigest()[:13], 16) / 2**52
        n, term, cdf = 0, math.exp(-rate), math.exp(-rate)
        while cdf <= u:
            n += 1
            term *= rate / n
            cdf += term
        out += [r] * n
    return out


def rank_library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_pipeline_against_plain_python(spark, tmp_path):
    """All five stages on whole rows; only the label and its score are taken from the language model."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    base = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60))
    more = [(3, base, "en", "src1", 0), (7, base, "en", "src0", 0), (7, "a text that nothing else is like in any way at all", None, "src0", 1), (None, base, "en", "src0", 0), (None, "a lonely text without any number to call it by", "en", None, 2), (3, base, "en", "src1", 0), (11, None, "en", "src2", None), (12, "42 17", "en", "src2", None)]
    folder = str(tmp_path / "tables")
    docs.union(spark.createDataFrame(more, docs.schema)).write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language_id.train(docs.where(~language_id.held_out()))
    rows = [r.asDict() for r in language_id.predict(docs, model).collect()]
    kept = [{**{c: r[c] for c in docs.columns}, "lang": r["lang"] or r["lang_pred"]} for r in rows if r["lang_pred"] != "und" and r["score"] >= 0.5]
    assert len(rows) - 40 < len(kept) < len(rows)
    rows = plain_mixed(plain_cut(plain_deduplicated(kept)))
    plain, digest = rank_library(), lambda x: hashlib.sha256(x).hexdigest()
    expected = []
    for r in rows:
        ids = plain.encode_ordinary(r["text"] or "")
        expected.append((str(r["doc_id"]), str(r["source"]), str(r["lang"]), len(ids), tuple(ids), digest(np.array(ids, "<u4").tobytes()), digest((r["text"] or "").encode())))
    found = [(str(r["doc_id"]), str(r["source"]), str(r["lang"]), r["n_tokens"], tuple(r["ids"]), r["ids_sha256"], r["decoded_sha256"]) for r in cp.run(spark, folder).collect()]
    assert sorted(found) == sorted(expected)


def test_pipeline_keeps_unique_texts_of_repeated_ids(spark):
    import corpus_pipeline as cp

    base, lonely = " ".join(f"w{i}" for i in range(40)), "zz unique words of its own"
    docs = spark.createDataFrame([(3, base, "en", "a", 1), (7, base, "en", "b", 2), (7, lonely, "en", "c", 3), (None, base, "en", "d", 4), (None, "lonely and without a number", "en", "e", 5), (3, base, "en", "f", 6), (9, None, None, None, None), (9, None, None, None, None), (5, "", "x", "y", 0), (6, "", "x", "y", 0)], KIND)
    found = sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in cp.drop_near_duplicates(spark, docs, SMALL).collect())
    assert found == sorted([("3", base, "a"), ("7", lonely, "c"), ("None", "lonely and without a number", "e"), ("9", "None", "None"), ("9", "None", "None"), ("5", "", "y")])


@pytest.mark.parametrize("rows", ["none", "some"])
def test_pipeline_stages_keep_columns_of_any_name(spark, rows):
    import corpus_pipeline as cp

    passage = " ".join(f"same{i}" for i in range(50))
    docs = spark.createDataFrame([(1, "the first text " + passage, "en", "src0", 1), (2, passage + " and the second one which goes on for longer than the passage does " + " ".join(f"v{i}" for i in range(60)), None, "src1", 1), (None, None, None, None, None)], KIND)
    docs = clashing(docs if rows == "some" else docs.limit(0))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns, name
        found = out.collect()
        assert all(r[c] == f"own {c}" for r in found for c in CLASHES), name
        assert (len(found) > 0) == (rows == "some"), name
    assert cp.STAGES[-1][1](spark, docs, SMALL).count() == docs.count()


def test_operators_keep_columns_of_any_name(spark):
    docs = clashing(spark.createDataFrame([(1, "one two three", "en", "src0", 1), (None, None, None, None, None)], KIND))
    given = {"mixing": (mixing.mix_sources(docs), "rate copy shuffle_key"), "sharding": (sharding.assign_shards(docs), "n_bytes shard depth shard_bytes fits"), "lm": (lm_scoring.score_documents(docs, F.lit(True)), "n_tokens n_known train_tokens base_score score bits_per_byte"), "substring": (substring_dedup.dedup_substrings(docs), "kept_text n_words n_removed kept_sha256 removed"), "bpe": (byte_bpe.encode_documents(docs), "n_tokens ids ids_sha256 decoded_sha256"), "language": (language_id.predict(docs, None), "lang_pred score"), "fingerprints": (fingerprints.fingerprints(docs), "fingerprint")}
    for name, (out, added) in given.items():
        mine = set(added.split())
        assert set(docs.columns) - mine <= set(out.columns), name
        assert all(r[c] == f"own {c}" for r in out.collect() for c in CLASHES if c not in mine), name
    assert {r["doc_id"] for r in ngram_join.near_duplicates(docs).collect()} == {1, None}
    assert fingerprints.compare_with_edits(docs).count() == 2
    vectors = spark.createDataFrame([(20, [1.0, 0.0]), (1, [0.5, 0.5])], "vec_id bigint, embedding array<double>").select("*", *[F.lit(1).alias(c) for c in ("id", "v", "part", "row", "block", "cell", "rank", "score")])
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 0.5)]
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id bigint, url string").select("*", *[F.lit(f"own {c}").alias(c) for c in ("_row", "_h", "_p", "_k", "_salt", "host")])
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    for out in (url_filter.judge_urls(pages), url_filter.judge_urls_sharded(pages, rules)):
        r = out.first()
        assert r["_row"] == "own _row" and r["_k"] == "own _k" and r["host"] == "a.com" and r["verdict"] == "block"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_fingerprint(text, k=4, window=8):
    """Distinct 31-bit-and-sign hashes of the selected k-grams, in order, and their digest."""
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words_of(text)]
    grams = []
    for i in range(max(1, len(h) - k + 1) if h else 0):
        value = 42
        for x in h[i : i + k]:
            value = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), value)
        grams.append((value >> 31) << 30 | ((1 << 30) - 1 - i))
    picked = [min(grams[i : i + window]) for i in range(max(1, len(grams) - window + 1))] if grams else []
    out = []
    for p in dict.fromkeys(picked):
        low = p >> 32 & 0xFFFFFFFF
        low -= (1 << 32) * (low >> 31)
        if low not in out:
            out.append(low)
    return out


@pytest.mark.parametrize("table", [SMALL, "edges"])
def test_fingerprint_query_against_plain_python(spark, table):
    if table == "edges":
        rows = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "a b c d e f g h i j k l m n"), (4, "other words under one id"), (None, "x " * 40), (9, "Ünï çödé 日本語 😀 x"), (10, " ".join(f"w{i % 977}" for i in range(20_000)))]
        found = fingerprints.compare_with_edits(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    else:
        rows = connect(SMALL).sql("SELECT doc_id, text FROM documents").fetchall()
        found = queries.QUERIES["op6_fingerprints"](spark, SMALL).collect()
    rows = [(i, t or "") for i, t in rows]
    order = sorted(set(rows), key=lambda d: (d[0] is None, -(d[0] or 0), signed(xxhash.xxh64_intdigest(d[1].encode(), 42))))
    likeness = lambda a, b: 1.0 if not a and not b else len(set(a) & set(b)) / len(set(a) | set(b))
    listed = lambda x: " ".join(map(str, x))
    after = dict(zip(order, order[1:] + order[:1]))
    expected = []
    for i, t in rows:
        n = after[i, t][1]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(n)
        expected.append((str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), listed(a), listed(b), likeness(a, b), likeness(a, c)))
    mine = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in found]
    assert sorted(mine) == sorted(expected)


def brute_neighbours(ids, x, query, k=20):
    near = np.array([float((x[j] * x[query]).sum()) for j in range(len(ids))])
    near[ids == ids[query]] = -np.inf
    top = np.lexsort((ids, -near))[:k]
    return [(int(ids[j]), near[j]) for j in top if near[j] > -np.inf]


def test_ann_scores_order_and_clustered_vectors(spark):
    """Clustered vectors need a small share of the parts; every score is the inner product, best first, ties by id."""
    random_ = np.random.default_rng(3)
    centres = random_.normal(size=(40, 16)) * 3
    x = centres[random_.integers(0, 40, 6000)] + random_.normal(size=(6000, 16)) * 0.3
    x[:50] = x[7]  # ties
    ids = np.arange(6000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>")
    valid = ann._good(df, "vec_id", "embedding")
    model = ann.fit(valid, 128)
    index = ann.build_index(valid, model).checkpoint()
    probes = ann.probes_for(index, model, 20, ann.TARGET_RECALL)
    assert model["parts"] >= 64 and probes <= model["parts"] // 4
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        assert r["score"] == pytest.approx(float(x[r["query_id"]] @ x[r["vec_id"]]), abs=1e-9)
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    assert len(got) == 60 and all(v == sorted(v) and len(v) == 20 for v in got.values())
    hits = sum(len({i for i, _ in brute_neighbours(ids, x, q)} & {i for _, i in got[q]}) for q in got if q)
    assert hits / (20 * 59) >= 0.9


def test_ann_searches_each_length_among_its_own(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.9, 0.0]), (20, [1.0, 0.0, 0.0]), (21, [0.0, 1.0, 0.0]), (40, [2.0])]
    found = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 2, 0.9), (0, 2, 1, 0.5), (20, 1, 21, 0.0)]


def test_ann_one_vector_many_times(spark):
    """A third of all rows is one vector: its part is many blocks, and the smallest ids win the ties."""
    random_ = np.random.default_rng(4)
    x = random_.normal(size=(9000, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    index = ann._good(df, "vec_id", "embedding")
    model = ann.fit(index, 64)
    out = ann.search(index.where("id = 3"), ann.build_index(index, model).checkpoint(), model, 20, model["parts"], block=256).orderBy("rank").collect()
    expected = brute_neighbours(np.arange(9000), x, 3)
    assert [r["vec_id"] for r in out] == [i for i, _ in expected]


def test_language_id_letters_marks_and_many_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    random.seed(9)
    langs = [f"l{i:03}" for i in range(180)]
    texts = {n: " ".join("".join(random.choices(letters, k=6)) for _ in range(30)) for n in langs}
    docs = spark.createDataFrame([(i, texts[n], n) for i, n in enumerate(langs)], "doc_id bigint, text string, lang string")
    model = language_id.train(docs)
    asked = [(i, texts[n]) for i, n in enumerate(langs)] + [(1000, "½ ² ⅷ ①"), (1001, None), (1002, "ab " * 200_000), (1003, ""), (5, texts["l005"])]
    found = language_id.predict(spark.createDataFrame(asked, "doc_id bigint, text string"), model).collect()
    by = {r["doc_id"]: r for r in found}
    assert len(found) == len(asked) and all(by[i]["lang_pred"] == n for i, n in enumerate(langs))
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1000, 1001, 1003)) and by[1002]["lang_pred"] in langs
    assert language_id._WORDS.findall("हिन्दी naïve x1y ½ 日本") == ["हिन्दी", "naïve", "x", "y", "日本"]
    same = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id bigint, text string, lang string")
    assert language_id.predict(same, language_id.train(same)).first()["lang_pred"] == "a"  # a tie goes to the smaller name
    assert language_id.predict(docs.limit(0), model).count() == 0


def test_bpe_split_characters_at_every_cut():
    bpe, text = byte_bpe.load(), "naïve 日本語 😀👩‍🔬 ﷽ á end"
    ids = bpe.encode([text])[0]
    assert bpe.decode(ids) == text.encode()
    for cut in range(len(ids) + 1):
        left, right = bpe.decode(ids[:cut]), bpe.decode(ids[cut:])
        assert left + right == text.encode()
        assert left.decode("utf-8", "replace").rstrip("�") == text.encode()[: len(left)].decode("utf-8", "ignore")
    starts = bpe.offsets([text])[0]
    sizes = np.array([len(bpe.tokens[i]) for i in ids])
    lead = np.cumsum([(b & 0xC0) != 0x80 for b in text.encode()]) - 1
    assert len(starts) == len(ids) and starts.tolist() == lead[np.cumsum(sizes) - sizes].tolist()
    assert bpe.offsets(["", "x"])[0].tolist() == []


def test_url_filter_empty_long_and_colliding(spark):
    kind = "page_id bigint, url string"
    assert url_filter.judge_urls(spark.createDataFrame([], kind)).count() == 0
    long = "http://" + ".".join(["a"] * 300) + ".com/en/" + "x" * 500_000 + "?q"
    rows = url_filter.judge_urls(spark.createDataFrame([(1, long), (1, long), (2, None)], kind)).collect()
    assert sorted((r["page_id"], r["verdict"], r["rule"]) for r in rows if r["page_id"] == 1) == [(1, "block", "com/en/")] * 2
    rules = [("allow", "É.com", "/"), ("block", "É.com", "/")]
    page = spark.createDataFrame([(1, "http://X.É.COM/a")], kind)
    assert url_filter.judge_urls(page, rules).first()["verdict"] == "block"  # the last given
    table = spark.createDataFrame(rules[::-1], "verdict string, host string, path string")
    assert url_filter.judge_urls_sharded(page, table).first()["verdict"] == "block"
    data = url_filter.build_index([("block", f"h{i}.com", "/") for i in range(100)])
    assert url_filter._mapped(data) is url_filter._mapped(data)


def test_mixing_null_ids_and_repeated_rows(spark):
    rows = [(None, "a")] * 3 + [(5, "a")] * 4 + [(i, "a") for i in range(100, 300)]
    out = Counter(r["doc_id"] for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id bigint, source string"), {"a": 1}, epochs=2.0).collect())
    assert out[5] % 4 == 0 and out[None] % 3 == 0 and 300 < sum(out.values()) < 520


def test_rows_without_an_id_are_each_for_itself(spark):
    """Different texts without an id: the mean rate is met, shards fit, and both equal their SQL."""
    rows = [(None, "a", f"text {i}") for i in range(400)] + [(i, "a", "x") for i in range(100)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    copies = mixing.mix_sources(docs, {"a": 1}, epochs=2.0)
    counts = Counter(r["text"] for r in copies.collect() if r["doc_id"] is None)
    assert len(counts) > 300 and 650 < sum(counts.values()) < 950 and len({r["shuffle_key"] for r in copies.collect()}) == copies.count()
    shards = sharding.assign_shards(docs, limit=200).collect()
    assert all(r["fits"] for r in shards) and len({r["shard"] for r in shards}) > 15


def test_sharding_like_the_sql_at_any_depth(spark):
    """Many levels: the histogram is deeper than a tier, and one row exceeds the limit."""
    random.seed(5)
    rows = [(i, "x" * random.choice([0, 1, 10, 300])) for i in range(3000)] + [(7, "y" * 5000), (None, "z")]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), limit=400).collect()
    key = lambda i, t: int(hashlib.md5(own_key(i, t).encode()).hexdigest()[:15], 16)
    sums = Counter()
    for i, t in rows:
        for d in range(61):
            sums[d, key(i, t) >> (60 - d)] += len(t)
    for r in found:
        depth = next((d for d in range(61) if sums[d, key(r["doc_id"], r["text"]) >> (60 - d)] <= 400), None)
        assert (r["depth"], r["fits"]) == (60 if depth is None else depth, depth is not None)
        assert r["shard_bytes"] == (None if depth is None else sums[depth, key(r["doc_id"], r["text"]) >> (60 - depth)])


def test_ngram_join_null_ids_and_chained_blocks(spark):
    """A chain of near copies whose ends are unlike, many null ids of one text, and rows that repeat: links as by all pairs."""
    random.seed(12)
    w = [f"c{i}" for i in range(120)]
    chain = []
    for step in range(90):
        chain.append(" ".join(w))
        w[(step * 7) % 120] = f"n{step}"
    rows = list(enumerate(chain)) + [(None, chain[0])] * 200 + [(3, chain[3])] * 200 + [(None, "a text on its own with no number")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    kept = ngram_join.BLOCK_ROWS
    ngram_join.BLOCK_ROWS = 8
    try:
        found = ngram_join.near_duplicates(docs).collect()
    finally:
        ngram_join.BLOCK_ROWS = kept
    sets = {t: shingles(t) for _, t in rows}
    links = {t: sum(len(s & sets[t]) >= 0.8 * len(s | sets[t]) - 1e-9 for u, s in sets.items() if u != t) for t in sets}
    copies, key = Counter(t for _, t in rows), {hashlib.md5(t.encode()).digest(): t for t in sets}
    assert len(found) == len(rows)
    for r in found:
        t = key[bytes(r["key"])]
        assert (r["n_links"], r["n_copies"], r["class_id"]) == (links[t], copies[t], 0 if t in chain else None)


def test_lm_strings_and_places():
    """A string's bytes, and how many bytes of the word stand before its last one."""
    random.seed(3)
    texts = [" ".join("".join(random.choices("ab", k=random.randint(1, 14))) for _ in range(300)), "", "x" * 50, "ab\tcdefghij"]
    codes, begins = lm_scoring._grams(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *(len(t) for t in texts)]))
    places, at = lm_scoring._places(codes), 0
    for t, begin in zip(texts, begins):
        assert begin == at
        padded = b"\0" * 5 + t.encode() + b"\0"
        for p in range(5, len(padded)):
            assert int(codes[at]) == int.from_bytes(padded[p - 5 : p + 1], "big")
            assert places[at] == min(5, len(re.search(rb"[^\x20\x09-\x0D\0]*$", padded[:p]).group()))
            at += 1
    assert at == len(codes)
