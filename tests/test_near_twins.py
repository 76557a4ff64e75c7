"""The twins over near-duplicate clusters read each text for its digest and its signature, and join none with the events."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from oracle import same
from swarmlens.functions import sketches
from swarmlens.functions.sketches import PRIME, Family, _cut
from swarmlens.functions.text import extracted, has, words_apart
from swarmlens.operators import detection as D
from swarmlens.operators.similarity import FAMILY
from swarmlens.plans import analytics_queries, detection_queries, registry

SMALL = "/root/testdata/sf0.001"


def refused(*_):
    raise AssertionError("posts with their texts were joined")


@pytest.mark.parametrize("name", ["N10_near_anonymous_clusters", "M2_near_cluster_alerts", "A4_near_pattern", "P3_near_member_posts", "A8_near_account_spam", "A11_near_account_activity"])
def test_texts_meet_no_events(spark, monkeypatch, name):
    met, facts = [], detection_queries.text_facts
    monkeypatch.setattr(detection_queries, "posts", refused)
    monkeypatch.setattr(analytics_queries, "posts", refused)
    monkeypatch.setattr(detection_queries, "text_facts", lambda *where: met.append(where) or facts(*where))
    same(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], SMALL)
    assert len(met) == 1


def test_facts_give_what_texts_give(spark):
    texts = ["é" * 60, "a" * 101, "a" * 100, "see https://a.b/c @me #it", "http:// @ # at a@b", "", "éa" * 40, "mail x@y now"]
    rows = [(i, t, i % 3, f"2024-01-01 00:0{i}:00", i % 2, 0.0) for i, t in enumerate(texts)]
    whole = spark.createDataFrame(rows, "id bigint, text string, author_id bigint, at string, cluster_id bigint, bot_score double").withColumn("created_at", F.to_timestamp_ntz("at"))
    whole = whole.select("*", *[extracted(F.col("text"), k).alias(k) for k in ("urls", "mentions", "hashtags")])
    short = F.expr("CASE WHEN octet_length(text) > 100 THEN concat(substring(text, 1, 97), '...') ELSE text END")
    facts = whole.select("id", "author_id", "created_at", "cluster_id", "bot_score", F.octet_length("text").alias("_bytes"), short.alias("_short"), *[has(F.col("text"), k).cast("int").alias(f"_has_{k}") for k in ("urls", "mentions", "hashtags")])
    found = [{tuple(r) for r in D.scored(D.cluster_stats(m)).collect()} for m in (whole, facts)]
    assert found[0] == found[1] and len(found[0]) == 2


def test_texts_without_signs_have_the_same_words(spark):
    texts = ["plain, words  here", "ünï–cødé 12½ x٣", "at@you me", "#tag #", "see http://x.y z", "https:/x a://b", "", "  ", "tab\there: x_y-z"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    full = F.regexp_replace("t", r"https?://\S+|[@#]\S*|[^\p{L}\p{Nd}@#]+", " ")
    cut = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", t)
    assert all(cut(r["a"]) == r["b"].split() for r in df.select(words_apart(F.col("t")).alias("a"), full.alias("b")).collect())
    plain = df.select(words_apart(F.col("t")).alias("a"), "t").where("octet_length(t) = length(t) AND NOT contains(t, '@') AND NOT contains(t, '#') AND NOT contains(t, '://')")
    assert plain.count() == 4 and plain.where("a <> t").count() == 0  # no pattern ran


def test_words_end_at_any_other_byte_of_ascii():
    data = "one,two\x00dreï\tx9\x7f".encode()
    starts, sizes, rows = _cut(np.frombuffer(data + bytes(64), np.uint8), np.array([0, 5, len(data)]))
    assert [data[a : a + n].decode() for a, n in zip(starts, sizes)] == ["one", "t", "wo", "dreï", "x9"] and rows.tolist() == [0, 0, 1, 1, 1]


def test_least_hashes_are_exact():
    family = FAMILY + [(1, 0), (PRIME - 1, PRIME - 1), (2, PRIME - 1), (PRIME - 1, 0), (1 << 14, 3)]
    codes = np.concatenate([np.random.default_rng(5).integers(0, 1 << 28, 2000), [0, 1, 2, (1 << 28) - 1, 16383, 16384]])
    hashes = np.array([[(int(x) * a + b) % PRIME for a, b in family] for x in codes])
    assert (Family(family).least(codes, np.arange(1, len(codes) + 1)) == hashes).all()
    assert (Family(family).least(codes, np.array([700, 701, len(codes)])) == [hashes[:700].min(axis=0), hashes[700], hashes[701:].min(axis=0)]).all()
    assert Family(family).room.dtype == np.uint64  # no fraction is rounded twice


def test_words_are_hashed_once(monkeypatch):
    hashed, heads = [], sketches.heads
    monkeypatch.setattr(sketches, "heads", lambda data, starts, sizes, *words: hashed.append(len(starts)) or heads(data, starts, sizes, *words))
    words = [f"word{i % 7}" for i in range(500)]
    batch = pa.RecordBatch.from_pydict({"id": [5, 6, 7, 8], "words": [" ".join(words[:300]), "", "a bc", " ".join(words[300:])]})
    (out,) = sketches.minhashes([batch], FAMILY[:20])
    assert out.column("id").to_pylist() == [5, 8] and sum(hashed) == 7 + (299 + 199) + (298 + 198)
    for row, some in zip(out.column("sig").to_pylist(), (words[:300], words[300:])):
        codes = {int(hashlib.md5(" ".join(some[i : i + n]).encode()).hexdigest()[:7], 16) for n in (1, 2, 3) for i in range(len(some) - n + 1)}
        assert row == [min((x * a + b) % PRIME for x in codes) for a, b in FAMILY[:20]]


def test_hashes_at_both_ends_are_found():
    """Sums of cut fractions fall short, so that the least hashes may seem the greatest: codes are made whose hashes are near 0 and near PRIME."""
    family = FAMILY[:24]
    ends_of = [(h - b) * pow(a, -1, PRIME) % PRIME for a, b in family for h in [*range(150), *range(PRIME - 150, PRIME)]]
    rng = np.random.default_rng(3)
    made = np.array([x for x in ends_of if x < 1 << 28])
    codes = rng.permutation(np.concatenate([made, rng.integers(0, 1 << 28, 9000)]))
    ends = np.append(np.sort(rng.choice(np.arange(1, len(codes)), 60, replace=False)), len(codes))
    hashes = np.array([[(int(x) * a + b) % PRIME for a, b in family] for x in codes])
    found = Family(family).least(codes, ends)
    assert (found == np.minimum.reduceat(hashes, np.append(0, ends[:-1]), axis=0)).all() and (found < 150).any()
    assert all((Family(family).least(codes[:k], np.array([k])) == hashes[:k].min(axis=0)).all() for k in (1, 7, 8, 9, 4095, 4096, 4097, len(codes)))
    only = made[hashes_of(made, family[0]) > PRIME - 151]  # all of them seem to have passed one, or nearly
    assert Family(family[:1]).least(only, np.array([len(only)])).item() == hashes_of(only, family[0]).min()


def hashes_of(codes, function):
    return np.array([(int(x) * function[0] + function[1]) % PRIME for x in codes])
