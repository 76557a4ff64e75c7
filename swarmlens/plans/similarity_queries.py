"""Queries of the similarity core over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from swarmlens.functions.text import bare, long_words, shingles, weighted_features, word_runs
from swarmlens.operators import graphs
from swarmlens.operators import similarity as S
from swarmlens.operators.engine import near_clusters
from swarmlens.plans.config import DetectionConfig, heuristic_bands
from swarmlens.plans.register import query, table

CONFIG = DetectionConfig()
H, B, T = CONFIG.minhash_hashes, CONFIG.minhash_bands, CONFIG.minhash_threshold
R = H // B

_TEXTS = "t AS (SELECT min(doc_id) AS id, text FROM documents WHERE text IS NOT NULL GROUP BY text)"
_WORDS = r"""w AS (SELECT id, list_filter(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '@\S+', '', 'g'), '#\S+', '', 'g'), '[\p{L}\p{Nd}]+'), lambda x: strlen(x) >= 3) AS ws FROM t),
k AS (SELECT DISTINCT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1]), list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]))) AS token FROM w)"""
_SIG = "x AS (SELECT id, ('0x' || substr(md5(token), 1, 7))::BIGINT AS x FROM k),\nsig AS (SELECT id, [" + ", ".join(f"min((x * {a} + {b}) % {S.PRIME})" for a, b in S.FAMILY[:H]) + "] AS sig FROM x GROUP BY id)"
_BANDS = f"bands AS (SELECT id, b AS band, array_to_string(sig[b*{R}+1:b*{R}+{R}], ',') AS key FROM sig, range({B}) AS s(b))"
_MPAIRS = f"""mp AS (SELECT DISTINCT x.id AS a, y.id AS b FROM bands x JOIN bands y ON x.band = y.band AND x.key = y.key AND x.id < y.id),
m AS (SELECT a, b, len(list_filter(range(1, {H + 1}), lambda i: x.sig[i] = y.sig[i]))::DOUBLE / {H} AS similarity FROM mp JOIN sig x ON x.id = a JOIN sig y ON y.id = b),
me AS (SELECT * FROM m WHERE similarity >= {T})"""
MINHASH_OF_TEXTS = ",\n".join([_WORDS, _SIG, _BANDS, _MPAIRS])
MINHASH = f"{_TEXTS},\n{MINHASH_OF_TEXTS}"
_FEATURES = r"""f0 AS (SELECT id, regexp_extract_all(lower(text), 'https?://\S+') AS links, regexp_replace(lower(text), 'https?://\S+', ' ', 'g') AS t FROM t),
f1 AS (SELECT id, links, list_distinct(list_transform(regexp_extract_all(t, '@(\S+)', 1), lambda x: '@' || x)) AS m, list_distinct(list_transform(regexp_extract_all(t, '#(\S+)', 1), lambda x: '#' || x)) AS h, regexp_replace(regexp_replace(t, '@\S+', ' ', 'g'), '#\S+', ' ', 'g') AS b FROM f0),
f2 AS (SELECT *, regexp_extract_all(b, '[\p{L}\p{Nd}]+') AS w, regexp_extract_all(b, '\p{L}{3,}') AS r FROM f1),
f AS (SELECT id, unnest(list_concat(list_transform(links, lambda x: '__HAS_URL__'), m, h, list_filter(w, lambda x: strlen(x) >= 3), list_transform(list_filter(range(1, len(w)), lambda i: strlen(w[i]) >= 3 AND strlen(w[i+1]) >= 3), lambda i: w[i] || ' ' || w[i+1]), flatten(list_transform(r, lambda x: list_transform(range(1, length(x) - 1), lambda i: '__CHAR__' || substr(x, i, 3)))))) AS feature FROM f2)"""
_SIM = "s0 AS (SELECT id, ('0x' || substr(md5(feature), 1, 16))::UBIGINT AS h FROM f),\ns1 AS (SELECT id, " + " + ".join(f"CASE WHEN sum(((h >> {i}) & 1)::INT * 2 - 1) > 0 THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(64)) + " AS v FROM s0 GROUP BY id),\nsim AS (SELECT t.id, coalesce(v, 0)::HUGEINT AS v FROM t LEFT JOIN s1 USING (id))"
_SPAIRS = """st AS (SELECT id, v, s AS slot, (v >> (16 * s)) & 65535::HUGEINT AS key FROM sim, range(4) AS q(s)),
se AS (SELECT DISTINCT x.id AS a, y.id AS b, bit_count(xor(x.v, y.v))::INT AS distance, 1 - bit_count(xor(x.v, y.v)) / 64.0::DOUBLE AS similarity FROM st x JOIN st y ON x.slot = y.slot AND x.key = y.key AND x.id < y.id WHERE bit_count(xor(x.v, y.v)) <= 3)"""
SIMHASH = ",\n".join([_FEATURES, _SIM, _SPAIRS])


def texts(spark, sf_dir):
    return S.distinct_texts(table(spark, sf_dir, "documents"))


@query("L1_shingle_counts", f"WITH {_TEXTS},\n{_WORDS} SELECT t.id, count(token) AS n_shingles FROM t LEFT JOIN k USING (id) GROUP BY t.id")
def shingle_counts(spark, sf_dir):
    return texts(spark, sf_dir).select("id", long_words(F.col("text")).alias("words")).select("id", F.size(shingles("words")).cast("bigint").alias("n_shingles"))


@query("L10_word_counts", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{Nd}]+'))::BIGINT AS n_words FROM documents")
def word_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(word_runs(F.lower("text"))).cast("bigint").alias("n_words"))


@query("F2_entity_strip", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(lower(text), 'https?://\S+', '', 'g'), '@\S+', '', 'g'), '#\S+', '', 'g')) AS bare_md5 FROM documents")
def entity_strip(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(bare(F.col("text"))).alias("bare_md5"))


@query("L2_minhash_signature", f"WITH {_TEXTS},\n{_WORDS},\n{_SIG} SELECT id, i - 1 AS i, sig[i] AS value FROM sig, range(1, {H + 1}) AS s(i)")
def minhash_signature(spark, sf_dir):
    return S.minhash(texts(spark, sf_dir), H).select("id", F.posexplode("sig").alias("i", "value")).select("id", F.col("i").cast("bigint").alias("i"), "value")


@query("L3_band_bucket_stats", f"WITH {_TEXTS},\n{_WORDS},\n{_SIG},\n{_BANDS}, c AS (SELECT band, key, count(*) AS n FROM bands GROUP BY ALL) SELECT band::INT AS band, count(*) AS n_buckets, max(n) AS largest, count(*) FILTER (n > 1) AS n_shared FROM c GROUP BY band")
def band_stats(spark, sf_dir):
    counts = S.bands(S.minhash(texts(spark, sf_dir), H), H, B).groupBy("band", "key").count()
    return counts.groupBy("band").agg(F.count("*").alias("n_buckets"), F.max("count").alias("largest"), F.count_if(F.col("count") > 1).alias("n_shared"))


@query("L4_minhash_pairs", f"WITH {MINHASH} SELECT * FROM me")
def minhash_pairs(spark, sf_dir):
    return S.minhash_pairs(texts(spark, sf_dir), H, B, T)


@query("L30_text_membership", "SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE text IS NOT NULL")
def text_membership(spark, sf_dir):
    return S.membership(table(spark, sf_dir, "documents"))


@query("L5_exact_jaccard_pairs", f"WITH {MINHASH}, n AS (SELECT id, count(*) AS n FROM k GROUP BY id), i AS (SELECT a, b, count(*) AS n_both FROM me JOIN k x ON x.id = a JOIN k y ON y.id = b AND y.token = x.token GROUP BY ALL) SELECT a, b, round(n_both / (x.n + y.n - n_both)::DOUBLE, 9) AS jaccard FROM i JOIN n x ON x.id = a JOIN n y ON y.id = b")
def exact_jaccard(spark, sf_dir):
    """Jaccard similarity of the pairs' shingles, which are numbered where the pairs were found."""
    shared = S.exact_pairs(texts(spark, sf_dir), H, B, T)
    return shared.select("a", "b", F.round(F.col("n") / (F.col("all") - F.col("n")), 9).alias("jaccard"))


_THRESHOLDS = "(SELECT DISTINCT round(l_discount * 10, 1) AS t FROM lineitem WHERE l_discount BETWEEN 0 AND 0.1)"
_TUNED = f"SELECT t::DOUBLE AS threshold, min_by(b, (abs(1 - pow(1 - pow(t::DOUBLE, 128 / b), b) - t::DOUBLE), b))::INT AS bands, (128 / min_by(b, (abs(1 - pow(1 - pow(t::DOUBLE, 128 / b), b) - t::DOUBLE), b)))::INT AS rows FROM {_THRESHOLDS} AS s(t), (VALUES (1), (2), (4), (8), (16), (32), (64), (128)) AS d(b) GROUP BY t"


def _thresholds(spark, sf_dir):
    """The distinct discounts of line items, ten times as large, as thresholds."""
    return table(spark, sf_dir, "lineitem").where("l_discount BETWEEN 0 AND 0.1").select(F.round(F.col("l_discount") * 10, 1).cast("double").alias("threshold")).distinct()


@query("L7_optimal_params", _TUNED)
def optimal_params(spark, sf_dir):
    """The best bands and rows of 128 hashes for each threshold of a table."""
    t = F.col("threshold")
    tried = F.array(*[F.struct(F.abs(1 - F.pow(1 - F.pow(t, F.lit(128 / b)), F.lit(float(b))) - t).alias("off"), F.lit(b).alias("bands"), F.lit(128 // b).alias("rows")) for b in (1, 2, 4, 8, 16, 32, 64, 128)])
    return _thresholds(spark, sf_dir).withColumn("best", F.array_min(tried)).select("threshold", "best.bands", "best.rows")


@query("L8_heuristic_params", f"SELECT t::DOUBLE AS threshold, (CASE WHEN t >= 0.8 THEN 32 WHEN t >= 0.6 THEN 16 ELSE 8 END)::INT AS bands FROM {_THRESHOLDS} AS s(t)")
def heuristic_params(spark, sf_dir):
    """The rule of thumb for each threshold of a table."""
    t = F.col("threshold")
    bands = F.when(t >= 0.8, heuristic_bands(0.8)).when(t >= 0.6, heuristic_bands(0.6)).otherwise(heuristic_bands(0.0))
    return _thresholds(spark, sf_dir).select("threshold", bands.alias("bands"))


@query("L9_simhash_features", f"WITH {_TEXTS},\n{_FEATURES} SELECT id, count(*) AS n_occurrences, count(DISTINCT feature) AS n_features FROM f GROUP BY id")
def simhash_features(spark, sf_dir):
    long = weighted_features(texts(spark, sf_dir), "text").select("id", F.explode_outer("features").alias("feature")).where("feature IS NOT NULL").groupBy("id", "feature").agg(F.count("*").alias("weight"))
    return long.groupBy("id").agg(F.sum("weight").alias("n_occurrences"), F.count("*").alias("n_features"))


@query("L12_simhash_values", f"WITH {_TEXTS},\n{_FEATURES},\n{_SIM} SELECT id, lpad(printf('%x', v), 16, '0') AS simhash FROM sim".replace("printf('%x', v)", "to_hex(v::UBIGINT)").replace("lpad(to_hex(v::UBIGINT), 16, '0')", "lower(lpad(to_hex(v::UBIGINT), 16, '0'))"))
def simhash_values(spark, sf_dir):
    return S.simhash(texts(spark, sf_dir)).select("id", F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("simhash"))


@query("L14_simhash_pairs", f"WITH {_TEXTS},\n{SIMHASH} SELECT * FROM se")
def simhash_pairs(spark, sf_dir):
    return S.simhash_pairs(texts(spark, sf_dir))


@query("L17_simhash_bucket_stats", f"WITH {_TEXTS},\n{SIMHASH}, c AS (SELECT slot, key, count(*) AS n FROM st GROUP BY ALL) SELECT count(*) AS n_buckets, round(avg(n), 6) AS avg_bucket, max(n) AS max_bucket FROM c")
def simhash_stats(spark, sf_dir):
    counts = S.simhash_tables(S.simhash(texts(spark, sf_dir))).groupBy("slot", "key").count()
    return counts.agg(F.count("*").alias("n_buckets"), F.round(F.avg("count"), 6).alias("avg_bucket"), F.max("count").alias("max_bucket"))


_FULL = "j AS (SELECT coalesce(me.a, se.a) AS a, coalesce(me.b, se.b) AS b, coalesce(me.similarity, 0) AS m, coalesce(se.similarity, 0) AS s FROM me FULL JOIN se ON me.a = se.a AND me.b = se.b)"
_INNER = "j AS (SELECT me.a, me.b, me.similarity AS m, se.similarity AS s FROM me JOIN se ON me.a = se.a AND me.b = se.b)"


def _hybrid(name, strategy, join, value, threshold):
    @query(name, f"WITH {MINHASH},\n{SIMHASH},\n{join}, v AS (SELECT a, b, {value} AS similarity FROM j) SELECT a, b, round(similarity, 9) AS similarity FROM v WHERE similarity >= {threshold}")
    def run(spark, sf_dir):
        docs = texts(spark, sf_dir)
        edges = S.combined(S.joint_pairs(docs, H, B, T, common=strategy in ("min", "consensus")), strategy, threshold)
        return edges.withColumn("similarity", F.round("similarity", 9))


_W = S.adaptive_weights()
_hybrid("L21_hybrid_weighted", "weighted", _FULL, "0.6::DOUBLE * m + 0.4::DOUBLE * s", 0.3)
_hybrid("L22_hybrid_max", "max", _FULL, "greatest(m, s)", 0.7)
_hybrid("L23_hybrid_min", "min", _INNER, "least(m, s)", 0.7)
_hybrid("L24_hybrid_adaptive", "adaptive", _FULL, f"{_W[0]!r}::DOUBLE * m + {_W[1]!r}::DOUBLE * s", 0.3)
_hybrid("L25_hybrid_consensus", "consensus", _INNER, "(m + s) / 2", 0.7)


@query("U3_intersection", f"WITH {MINHASH},\n{SIMHASH} SELECT a, b FROM me INTERSECT SELECT a, b FROM se")
def both_algorithms(spark, sf_dir):
    docs = texts(spark, sf_dir)
    m, s = S.both_pairs(docs, H, B, T)
    return m.select("a", "b").intersect(s.select("a", "b"))


@query("U1_union_distinct", f"WITH {MINHASH},\n{SIMHASH} SELECT a, b FROM me UNION SELECT a, b FROM se")
def either_algorithm(spark, sf_dir):
    docs = texts(spark, sf_dir)
    m, s = S.both_pairs(docs, H, B, T)
    return m.select("a", "b").union(s.select("a", "b")).distinct()


@query("X2_connected_components", f"WITH RECURSIVE {MINHASH}, e AS (SELECT a, b FROM me UNION ALL SELECT b, a FROM me), c(id, r) AS (SELECT a, a FROM e UNION SELECT c.id, e.b FROM c JOIN e ON c.r = e.a) SELECT id, min(r) AS component FROM c GROUP BY id")
def components(spark, sf_dir):
    """Components of near-duplicate texts, out of links to the least text of each bucket."""
    return graphs.connected_components(S.minhash_links(texts(spark, sf_dir), H, B, T))


def leaders_sql(edges: str, prefix: str = "") -> str:
    """CTE {prefix}ld (id, seed): leader clusters of an edge table (a, b) in the order of the ids' digests."""
    x = prefix
    return f"""{x}pairs AS (SELECT a AS u, b AS v FROM {edges} UNION SELECT b, a FROM {edges}),
{x}nb AS (SELECT u AS id, row_number() OVER (ORDER BY md5(u::VARCHAR), u) AS k, list(v) AS vs FROM {x}pairs GROUP BY u),
{x}sd(k, seeds) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT n.k, CASE WHEN list_has_any(n.vs, s.seeds) THEN s.seeds ELSE list_append(s.seeds, n.id) END FROM {x}sd s JOIN {x}nb n ON n.k = s.k + 1),
{x}fs AS (SELECT unnest(arg_max(seeds, k)) AS seed FROM {x}sd),
{x}ld AS (SELECT id, id AS seed FROM {x}nb WHERE id IN (SELECT seed FROM {x}fs) UNION ALL SELECT u, arg_min(v, (md5(v::VARCHAR), v)) FROM {x}pairs WHERE u NOT IN (SELECT seed FROM {x}fs) AND v IN (SELECT seed FROM {x}fs) GROUP BY u)"""


def placed_sql(source: str, key: str, text: str, prefix: str = "") -> str:
    """CTE {prefix}nc (id, cluster_id): all rows of a table in clusters of two or more, copies by their text."""
    x = prefix
    return f"""{x}rp AS (SELECT {key} AS id, min({key}) OVER (PARTITION BY {text}) AS rep FROM {source} WHERE {text} IS NOT NULL),
{x}pl AS (SELECT {x}rp.id, coalesce(seed, rep) AS cluster_id FROM {x}rp LEFT JOIN {x}ld ON {x}ld.id = rep),
{x}nc AS (SELECT id, cluster_id FROM {x}pl QUALIFY count(*) OVER (PARTITION BY cluster_id) > 1)"""


@query("L6_leader_clusters", f"WITH RECURSIVE {MINHASH},\n{leaders_sql('me')},\n{placed_sql('documents', 'doc_id', 'text')} SELECT id AS doc_id, cluster_id AS seed, count(*) OVER (PARTITION BY cluster_id) AS size FROM nc")
def leader_clusters(spark, sf_dir):
    """Clusters of all documents: copies follow the representative of their text; single documents are none."""
    placed = near_clusters(table(spark, sf_dir, "documents"), "minhash").withColumnsRenamed({"id": "doc_id", "cluster_id": "seed"})
    return placed.join(placed.groupBy("seed").agg(F.count("*").alias("size")), "seed").select("doc_id", "seed", "size")


@query("X7_partition_local", f"WITH {MINHASH} SELECT a, b, similarity FROM me WHERE a // 250 = b // 250")
def partition_local(spark, sf_dir):
    """Pairs inside fixed batches of ids alone."""
    return S.minhash_pairs(texts(spark, sf_dir), H, B, T, batch=lambda node: F.floor(node / 250))


@query("L28_accuracy", f"""WITH {MINHASH}, p AS (SELECT DISTINCT a AS id FROM me UNION SELECT b FROM me), d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep FROM documents WHERE text IS NOT NULL),
l AS (SELECT (l.toxic = 1 OR l.quality = 0) AS truth, p.id IS NOT NULL AS found FROM labels l JOIN d USING (doc_id) LEFT JOIN p ON p.id = d.rep)
SELECT count(*) FILTER (truth AND found) AS tp, count(*) FILTER (NOT truth AND found) AS fp, count(*) FILTER (NOT truth AND NOT found) AS tn, count(*) FILTER (truth AND NOT found) AS fn, round(avg((truth = found)::INT), 9) AS accuracy FROM l""")
def accuracy(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pairs = S.minhash_pairs(S.distinct_texts(docs), H, B, T)
    found = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("found", F.lit(True))
    judged = table(spark, sf_dir, "labels").join(S.membership(docs), "doc_id").join(found, "rep", "left").select(((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("truth"), F.coalesce("found", F.lit(False)).alias("found"))
    t, f = F.col("truth"), F.col("found")
    return judged.agg(F.count_if(t & f).alias("tp"), F.count_if(~t & f).alias("fp"), F.count_if(~t & ~f).alias("tn"), F.count_if(t & ~f).alias("fn"), F.round(F.avg((t == f).cast("int")), 9).alias("accuracy"))
