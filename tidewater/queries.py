"""Registered queries of the reference engine's operators and their DuckDB oracles.

The driver's tables stand in for records: ``embeddings`` are vectors,
``documents`` texts, ``events`` memories with times and importance,
``conversations`` turns, and the star schema's keys a graph.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions import predicates as P
from tidewater.functions import vectors as V
from tidewater.operators import ann, fusion, graph, memory, search, store, text
from tidewater.operators.search import SearchOptions
from tidewater.plans.scratch import durable, scratch_path
from tidewater.streaming.subscriptions import Subscription, matches

Query = Callable[[SparkSession, str], DataFrame]

NOW = datetime(2024, 1, 31)

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Records made of the driver's tables, in Spark and in SQL.


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = "event_id"
    return table(spark, sf_dir, "events").selectExpr(
        f"{i} AS id", "ts AS created_at", f"ts + make_dt_interval(0, int({i} % 5)) AS updated_at",
        f"CASE WHEN {i} % 3 = 0 THEN ts + make_dt_interval(int({i} % 30)) END AS expires_at", f"double({i} % 11) / 10 AS importance",
        f"CASE WHEN {i} % 4 = 0 THEN 0 ELSE {i} % 6 END AS access_count",
        f"CASE WHEN {i} % 4 <> 0 THEN ts + make_dt_interval(int({i} % 7)) END AS last_accessed_at",
        f"CASE WHEN {i} % 10 <> 0 THEN event_type END AS kind", f"CASE WHEN {i} % 9 <> 0 THEN value END AS value", "props", "user_id", f"{i} % 13 = 0 AS archived",
    )


_MEM = """mem AS (SELECT event_id AS id, ts AS created_at, ts + to_hours(event_id % 5) AS updated_at,
  CASE WHEN event_id % 3 = 0 THEN ts + to_days((event_id % 30)::INTEGER) END AS expires_at, (event_id % 11)::DOUBLE / 10 AS importance,
  CASE WHEN event_id % 4 = 0 THEN 0 ELSE event_id % 6 END AS access_count,
  CASE WHEN event_id % 4 <> 0 THEN ts + to_days((event_id % 7)::INTEGER) END AS last_accessed_at,
  CASE WHEN event_id % 10 <> 0 THEN event_type END AS kind, CASE WHEN event_id % 9 <> 0 THEN value END AS value, props, user_id,
  event_id % 13 = 0 AS archived FROM events)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS id", "embedding AS vector", "label", "double(vec_id % 11) / 10 AS importance", "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(vec_id)) AS created_at",
        "vec_id % 7 AS session_id", "vec_id % 3 AS access_count", "CASE WHEN vec_id % 4 = 0 THEN array('a', 'b') WHEN vec_id % 4 = 1 THEN array('b') END AS tags",
        "CASE WHEN vec_id % 5 <> 0 THEN map('reversed', reverse(embedding)) END AS vectors", "CAST(NULL AS timestamp_ntz) AS last_accessed_at", "concat('memory ', vec_id) AS content",
    )


_VEC = """q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0),
v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label, (vec_id % 11)::DOUBLE / 10 AS importance, TIMESTAMP '2024-01-01' + to_hours(vec_id) AS created_at,
  vec_id % 7 AS session_id, vec_id % 3 AS access_count FROM embeddings),
s AS (SELECT id, label, importance, created_at, session_id, access_count, round(list_cosine_similarity(vec, q), 6) AS score FROM v, q)"""


def query_vector(spark: SparkSession, sf_dir: str, which: int = 0) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == which).select("embedding").first()[0])


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr(
        "conv_id * 1000 + turn AS id", "conv_id AS session_id", "turn", "role", "text AS content", "CASE WHEN turn > 0 THEN conv_id * 1000 + turn - 1 END AS parent_id",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(conv_id), int(turn)) AS created_at",
    )


_TURNS = """t AS (SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, turn, role, text AS content,
  TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations)"""


def knowledge(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    entities = (
        t("region").selectExpr("bigint(r_regionkey) AS id", "'region' AS type", "r_name AS name")
        .unionAll(t("nation").selectExpr("bigint(100 + n_nationkey)", "'nation'", "n_name"))
        .unionAll(t("customer").selectExpr("1000000 + c_custkey", "'customer'", "c_name"))
        .unionAll(t("supplier").selectExpr("2000000 + s_suppkey", "'supplier'", "s_name"))
    )
    edges = (
        t("nation").selectExpr("bigint(1000 + n_nationkey) AS id", "bigint(100 + n_nationkey) AS src", "bigint(n_regionkey) AS dst", "'located_in' AS type", "1D AS weight", "n_nationkey % 2 = 0 AS bidirectional")
        .unionAll(t("customer").selectExpr("10000000 + c_custkey", "1000000 + c_custkey", "bigint(100 + c_nationkey)", "'lives_in'", "double(c_custkey % 10 + 1) / 10", "c_custkey % 2 = 0"))
        .unionAll(t("supplier").selectExpr("20000000 + s_suppkey", "2000000 + s_suppkey", "bigint(100 + s_nationkey)", "'works_in'", "double(s_suppkey % 10 + 1) / 10", "s_suppkey % 2 = 0"))
    )
    return entities, edges


_GRAPH = """ent AS (SELECT r_regionkey::BIGINT AS id, 'region' AS type, r_name AS name FROM region
  UNION ALL SELECT 100 + n_nationkey, 'nation', n_name FROM nation UNION ALL SELECT 1000000 + c_custkey, 'customer', c_name FROM customer
  UNION ALL SELECT 2000000 + s_suppkey, 'supplier', s_name FROM supplier),
edge AS (SELECT (1000 + n_nationkey)::BIGINT AS id, (100 + n_nationkey)::BIGINT AS src, n_regionkey::BIGINT AS dst, 'located_in' AS type, 1.0::DOUBLE AS weight, n_nationkey % 2 = 0 AS bidirectional FROM nation
  UNION ALL SELECT 10000000 + c_custkey, 1000000 + c_custkey, 100 + c_nationkey, 'lives_in', (c_custkey % 10 + 1)::DOUBLE / 10, c_custkey % 2 = 0 FROM customer
  UNION ALL SELECT 20000000 + s_suppkey, 2000000 + s_suppkey, 100 + s_nationkey, 'works_in', (s_suppkey % 10 + 1)::DOUBLE / 10, s_suppkey % 2 = 0 FROM supplier)"""


# Filters: name, filter, SQL predicate with two-valued logic.

_T = datetime(2024, 1, 15, 12)
_FILTERS: list[tuple[str, P.Filter, str]] = [
    ("eq", P.equal("kind", "click"), "coalesce(kind = 'click', false)"),
    ("ne", P.not_equal("kind", "click"), "coalesce(kind <> 'click', true)"),
    ("in", P.any_of("kind", "click", "view"), "coalesce(kind IN ('click', 'view'), false)"),
    ("not_in", P.none_of("kind", "click", "view"), "coalesce(kind NOT IN ('click', 'view'), true)"),
    ("glob", P.glob("kind", "?[h-u]*"), "coalesce(regexp_matches(kind, '^[^/][h-u][^/]*$'), false)"),
    ("prefix", P.prefix("kind", "s"), "coalesce(starts_with(kind, 's'), false)"),
    ("suffix", P.suffix("kind", "w"), "coalesce(ends_with(kind, 'w'), false)"),
    ("contains", P.contains("kind", "ck"), "coalesce(contains(kind, 'ck'), false)"),
    ("exists", P.exists("kind"), "kind IS NOT NULL"),
    ("and", P.all_of(P.equal("kind", "view"), P.gt("value", 20)), "coalesce(kind = 'view', false) AND coalesce(value > 20, false)"),
    ("or", P.some_of(P.equal("kind", "view"), P.gt("value", 90)), "coalesce(kind = 'view', false) OR coalesce(value > 90, false)"),
    ("not", P.negate(P.gt("value", 50)), "NOT coalesce(value > 50, false)"),
    ("gt", P.gt("value", 50), "coalesce(value > 50, false)"),
    ("gte", P.gte("access_count", 3), "access_count >= 3"),
    ("lt", P.lt("value", 10), "coalesce(value < 10, false)"),
    ("lte", P.lte("access_count", 1), "access_count <= 1"),
    ("between", P.between("value", 20, 40), "coalesce(value BETWEEN 20 AND 40, false)"),
    ("created_after", P.after("created_at", _T), "created_at > TIMESTAMP '2024-01-15 12:00:00'"),
    ("created_before", P.before("created_at", _T), "created_at < TIMESTAMP '2024-01-15 12:00:00'"),
    ("updated_after", P.after("updated_at", _T), "updated_at > TIMESTAMP '2024-01-15 12:00:00'"),
    ("updated_before", P.before("updated_at", _T), "updated_at < TIMESTAMP '2024-01-15 12:00:00'"),
    ("age_older", P.older_than(timedelta(days=20), NOW), "created_at < TIMESTAMP '2024-01-11'"),
    ("age_newer", P.newer_than(timedelta(days=5), NOW), "created_at > TIMESTAMP '2024-01-26'"),
    ("not_expired", P.not_expired(NOW), "expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-31'"),
    ("expired_before", P.expired_before(NOW), "coalesce(expires_at < TIMESTAMP '2024-01-31', false)"),
    ("has_ttl", P.has_ttl(), "expires_at IS NOT NULL"),
    ("importance_above", P.gt("importance", 0.75), "importance > 0.75"),
    ("importance_below", P.lt("importance", 0.25), "importance < 0.25"),
    ("importance_between", P.between("importance", 0.3, 0.6), "importance BETWEEN 0.3::DOUBLE AND 0.6::DOUBLE"),
    ("accessed_after", P.after("last_accessed_at", _T), "coalesce(last_accessed_at > TIMESTAMP '2024-01-15 12:00:00', false)"),
    ("accessed_before", P.accessed_before(_T), "coalesce(last_accessed_at < TIMESTAMP '2024-01-15 12:00:00', true)"),
    ("never_accessed", P.never_accessed(), "last_accessed_at IS NULL"),
    ("access_count_above", P.gt("access_count", 3), "access_count > 3"),
    ("access_count_below", P.lt("access_count", 2), "access_count < 2"),
    ("typed_equality", P.negate(P.equal("kind", 42)), "true"),
    ("text_parser", P.parse_text("kind=s*"), "coalesce(regexp_matches(kind, '^s[^/]*$'), false)"),
    ("json_parser", P.all_of(*P.parse_json([{"key": "kind", "op": "neq", "value": "error"}, {"key": "value", "op": "gte", "value": 30}, {"key": "x", "op": "odd"}])), "coalesce(kind <> 'error', true) AND coalesce(value >= 30, false)"),
    ("json_path", P.exists_in("props", "$.k"), "json_exists(props, '$.k')"),
]
for _name, _f, _where in _FILTERS:
    _register(f"filter_{_name}", f"WITH {_MEM} SELECT id, kind, value FROM mem WHERE {_where}")(
        lambda spark, sf, f=_f: store.find(memories(spark, sf), f).select("id", "kind", "value")
    )


# Vector search.

def _knn(name: str, o: SearchOptions, sql: str, space: str | None = None) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df, q = records(spark, sf), query_vector(spark, sf)
        return (search.search(df, q, o) if space is None else search.search_space(df, space, q, o)).select("id", "score")

    _register(name, f"WITH {_VEC} {sql}")(run)


_TOP = "SELECT id, score FROM s {} ORDER BY score DESC, id LIMIT {}"
_knn("knn_cosine", SearchOptions(), _TOP.format("", 10))
_knn("knn_dot", SearchOptions(metric="dot"), "SELECT id, round(list_inner_product(vec, q), 6) AS score FROM v, q ORDER BY score DESC, id LIMIT 10")
_knn("knn_euclidean", SearchOptions(metric="euclidean"), "SELECT id, round(list_distance(vec, q), 6) AS score FROM v, q ORDER BY score, id LIMIT 10")
_knn("knn_euclidean_sq", SearchOptions(metric="euclidean_squared"), "SELECT id, round(list_sum(list_transform(list_zip(vec, q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS score FROM v, q ORDER BY score, id LIMIT 10")
_knn("knn_threshold", SearchOptions(k=1000, threshold=0.2), _TOP.format("WHERE score >= 0.2", 1000))
_knn("knn_filtered", SearchOptions(filters=(P.any_of("label", 1, 2, 3),)), _TOP.format("WHERE label IN (1, 2, 3)", 10))
_knn("knn_page2", SearchOptions(offset=10), _TOP.format("", "10 OFFSET 10"))
_knn("knn_limit", SearchOptions(limit=5), _TOP.format("", 5))
_knn("knn_in_session", SearchOptions(filters=(P.equal("session_id", 3),)), _TOP.format("WHERE session_id = 3", 10))
_AGE = "((epoch(TIMESTAMP '2024-01-31') - epoch(created_at)) / 864000.0)"
for _kind, _formula in (("exponential", f"pow(2.0, -{_AGE})"), ("linear", f"greatest(0.0, 1 - {_AGE})"), ("gaussian", f"exp(-0.5 * {_AGE} * {_AGE})")):
    _knn(
        f"knn_decay_{_kind}", SearchOptions(k=20, decay=_kind, half_life=864000, now=NOW),
        f", w AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 20) SELECT id, round(score * {_formula}, 6) AS score FROM w ORDER BY score DESC, id",
    )
_knn("knn_importance", SearchOptions(k=20, importance_boost=0.5), ", w AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 20) SELECT id, round(score * (1 + 0.5::DOUBLE * importance), 6) AS score FROM w ORDER BY score DESC, id")
_REV = "r AS (SELECT id, round(list_cosine_similarity(list_reverse(vec), q), 6) AS score FROM v, q WHERE id % 5 <> 0)"
_knn("knn_space", SearchOptions(), f", {_REV} SELECT id, score FROM r ORDER BY score DESC, id LIMIT 10", "reversed")


@_register("knn_batch", """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INTEGER AS rank FROM s) SELECT query_id, id, score, rank FROM r WHERE rank <= 10""")
def knn_batch(spark: SparkSession, sf: str) -> DataFrame:
    base = records(spark, sf)
    return search.knn_join(base.where("id % 50 = 0").selectExpr("id AS query_id", "vector AS query"), base, 10)


@_register("knn_access_tracking", f"WITH {_VEC}, w AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 15) SELECT v.id, (access_count + CASE WHEN w.id IS NULL THEN 0 ELSE 1 END)::BIGINT AS access_count, CASE WHEN w.id IS NOT NULL THEN TIMESTAMP '2024-01-31' END AS last_accessed_at FROM v LEFT JOIN w USING (id)")
def knn_access_tracking(spark: SparkSession, sf: str) -> DataFrame:
    df = records(spark, sf)
    hits = search.search(df, query_vector(spark, sf), SearchOptions(k=15))
    return search.track_access(df, hits, NOW).select("id", "access_count", "last_accessed_at")


@_register("recall_memory", f"WITH {_VEC}, w AS (SELECT id, score FROM s WHERE importance > 0.3 AND created_at > TIMESTAMP '2024-01-06' ORDER BY score DESC, id LIMIT 10) SELECT id, score FROM w WHERE id % 4 < 2")
def recall_memory(spark: SparkSession, sf: str) -> DataFrame:
    o = SearchOptions(filters=(P.gt("importance", 0.3), P.newer_than(timedelta(days=25), NOW)))
    return store.find(search.search(records(spark, sf), query_vector(spark, sf), o), P.has_any_tag("tags", "b", "c")).select("id", "score")


@_register("vector_kernels", "SELECT vec_id AS id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS magnitude, round(list_extract(embedding::DOUBLE[], 1) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def vector_kernels(spark: SparkSession, sf: str) -> DataFrame:
    v = F.col("vector")
    return records(spark, sf).select("id", F.round(V.magnitude(v), 6).alias("magnitude"), F.round(V.normalize(v)[0], 6).alias("first"))


# Text search.

def texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").selectExpr("doc_id AS id", "text AS content", "lang", "source")


_EDGE_SQL = text.EDGE.replace("'", "''")
_TOKENS = rf"""tok AS (SELECT doc_id AS id, lang, list_filter(list_transform(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: trim(x, '{_EDGE_SQL}')), lambda x: x <> '') AS words FROM documents)"""


def _bm25_sql(query: str) -> str:
    return f"""{_TOKENS}, dl AS (SELECT id, len(words) AS dl FROM tok WHERE len(words) > 0), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT term, count(*) AS m FROM (SELECT unnest(string_split('{query}', ' ')) AS term) GROUP BY term),
tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM tok) WHERE term IN (SELECT term FROM qt) GROUP BY id, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, round(sum(m * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN qt USING (term) JOIN df USING (term) JOIN dl USING (id), st GROUP BY id)"""


_ASK = "the with heon"


@_register("bm25_tokens", f"WITH {_TOKENS} SELECT id, len(words)::INTEGER AS n, md5(array_to_string(words, ' ')) AS digest FROM tok")
def bm25_tokens(spark: SparkSession, sf: str) -> DataFrame:
    words = text.tokens(F.col("content"))
    return texts(spark, sf).select("id", F.size(words).alias("n"), F.md5(F.array_join(words, " ")).alias("digest"))


@_register("bm25_postings", f"WITH {_TOKENS} SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM tok) GROUP BY id, term")
def bm25_postings(spark: SparkSession, sf: str) -> DataFrame:
    return text.postings(texts(spark, sf), ["content"])


def _text(name: str, query: str, sql: str, **options) -> None:
    _register(name, f"WITH {_bm25_sql(query)} {sql}")(lambda spark, sf: text.text_search(texts(spark, sf), query, ["content"], **options).select("id", "score"))


_text("bm25_search", _ASK, "SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
_text("bm25_repeated_term", "the of the", "SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
_text("bm25_page2", _ASK, "SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10 OFFSET 5", offset=5)
_text("bm25_search_filtered", "de en the la", "SELECT id, score FROM (SELECT * FROM bm ORDER BY score DESC, id LIMIT 50) w JOIN (SELECT doc_id AS id FROM documents WHERE lang = 'es') d USING (id)", k=50, filters=(P.equal("lang", "es"),))


# Fusion.

def _vector_texts(spark: SparkSession, sf: str) -> DataFrame:
    return texts(spark, sf).join(records(spark, sf).select("id", "vector", "vectors"), "id", "full")


_LEGS = """, a AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 20)),
b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20))"""
_FUSE = "SELECT id, round(sum(p), 9) AS score FROM (SELECT id, {}::DOUBLE / (60 + r) AS p FROM a UNION ALL SELECT id, {}::DOUBLE / (60 + r) FROM b) GROUP BY id ORDER BY score DESC, id LIMIT {}"


def _legs(spark: SparkSession, sf: str) -> list[DataFrame]:
    left = search.search(records(spark, sf), query_vector(spark, sf), SearchOptions(k=20))
    return [left, text.text_search(texts(spark, sf), _ASK, ["content"], 20)]


@_register("rrf", f"WITH {_VEC}, {_bm25_sql(_ASK)} {_LEGS} {_FUSE.format(1.0, 1.0, 1000)}")
def rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_legs(spark, sf))


@_register("rrf_weighted", f"WITH {_VEC}, {_bm25_sql(_ASK)} {_LEGS} {_FUSE.format(2.0, 0.5, 8)}")
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_legs(spark, sf), weights=(2.0, 0.5), top=8)


@_register("hybrid", f"WITH {_VEC}, {_bm25_sql(_ASK)} {_LEGS} {_FUSE.format(1.0, 1.0, 10)}")
def hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hybrid(_vector_texts(spark, sf), query_vector(spark, sf), _ASK, ["content"])


@_register("hybrid_weighted", f"WITH {_VEC}, {_bm25_sql(_ASK)} {_LEGS} {_FUSE.format(1.0, 3.0, 10)}")
def hybrid_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hybrid(_vector_texts(spark, sf), query_vector(spark, sf), _ASK, ["content"], vector_weight=-1, text_weight=3)


@_register("hybrid_space", f"WITH {_VEC}, {_REV}, {_bm25_sql(_ASK)} {_LEGS.replace('FROM s ', 'FROM r ')} {_FUSE.format(1.0, 1.0, 10)}")
def hybrid_space(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.hybrid(_vector_texts(spark, sf), query_vector(spark, sf), _ASK, ["content"], space="reversed")


@_register("multi_space", f"WITH {_VEC}, {_REV} {_LEGS.replace('FROM bm ', 'FROM r ')} {_FUSE.format(1.0, 1.0, 10)}")
def multi_space(spark: SparkSession, sf: str) -> DataFrame:
    q = query_vector(spark, sf)
    return fusion.multi_space(records(spark, sf), {"default": q, "reversed": q, "none": []})


# Memory.

_PAIRS = """p AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id < b.id AND round(list_cosine_similarity(a.vec, b.vec), 6) >= {}),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)"""
_CLUSTERS = f"""WITH RECURSIVE {_VEC}, {_PAIRS}, reach(id, label) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, reach.label FROM reach JOIN e ON reach.id = e.a),
lab AS (SELECT id, min(label) AS cluster_id FROM reach GROUP BY id),
m AS (SELECT lab.cluster_id, v.*, row_number() OVER (PARTITION BY cluster_id ORDER BY importance DESC, id)::INTEGER AS rank FROM lab JOIN v USING (id))"""


@_register("clusters", _CLUSTERS.format(0.40) + " SELECT cluster_id, count(*) AS size, round(avg(importance), 6) AS avg_importance, max(importance) AS importance, min(created_at) AS start, max(created_at) AS \"end\", string_agg(id, ',' ORDER BY id) AS ids FROM m WHERE rank <= 10 GROUP BY cluster_id")
def clusters(spark: SparkSession, sf: str) -> DataFrame:
    return memory.clusters(records(spark, sf), threshold=0.40).drop("centroid").withColumn("ids", F.array_join("ids", ","))


@_register("cluster_members", _CLUSTERS.format(0.35) + " SELECT cluster_id, id, rank FROM m WHERE rank <= 10")
def cluster_members(spark: SparkSession, sf: str) -> DataFrame:
    return memory.cluster_members(records(spark, sf), threshold=0.35).select("cluster_id", "id", "rank")


@_register("cluster_centroids", _CLUSTERS.format(0.40) + ", c AS (SELECT cluster_id, i, round(avg(vec[i]), 6) AS x FROM m, range(1, 65) t(i) WHERE rank <= 10 GROUP BY cluster_id, i) SELECT cluster_id, i - 1 AS pos, x FROM c")
def cluster_centroids(spark: SparkSession, sf: str) -> DataFrame:
    out = memory.clusters(records(spark, sf), threshold=0.40).select("cluster_id", F.posexplode("centroid").alias("pos", "x"))
    return out.withColumn("pos", F.col("pos").cast("long"))


@_register("consolidate", _CLUSTERS.format(0.40) + " SELECT cluster_id, string_agg('memory ' || id, '; ' ORDER BY id) AS content, max(importance) AS importance FROM m WHERE rank <= 10 GROUP BY cluster_id")
def consolidate(spark: SparkSession, sf: str) -> DataFrame:
    made, _ = memory.consolidate(records(spark, sf), lambda parts: F.array_join(parts, "; "), threshold=0.40)
    return made.select("cluster_id", "content", "importance")


@_register("consolidate_archived", _CLUSTERS.format(0.40) + " SELECT id FROM m WHERE rank <= 10")
def consolidate_archived(spark: SparkSession, sf: str) -> DataFrame:
    _, kept = memory.consolidate(records(spark, sf), lambda parts: F.array_join(parts, "; "), threshold=0.40)
    return memory.flagged(kept, "archived").select("id")


@_register("expand_consolidation", _CLUSTERS.format(0.40) + " SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY id) - 1)::INTEGER AS pos, id, label FROM m WHERE rank <= 10")
def expand_consolidation(spark: SparkSession, sf: str) -> DataFrame:
    rows = memory.clusters(records(spark, sf), threshold=0.40).select("cluster_id", "ids")
    return memory.expand(rows, records(spark, sf), "ids", "cluster_id").select("cluster_id", "pos", "id", "label")


def _episode_sql(gap: str, most: int, per: str = "") -> str:
    by = f"PARTITION BY {per}" if per else ""
    run = f"{per}, run" if per else "run"
    return f"""WITH {_MEM}, live AS (SELECT * FROM mem WHERE NOT archived),
g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER ({by} ORDER BY created_at, id) <= INTERVAL {gap} THEN 0 ELSE 1 END AS far FROM live),
r AS (SELECT *, sum(far) OVER ({by} ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS run FROM g),
c AS (SELECT *, (row_number() OVER (PARTITION BY {run} ORDER BY created_at, id) - 1) // {most} AS chunk FROM r),
ep AS (SELECT *, 'ep_' || first_value(id) OVER w AS episode_id, count(*) OVER (PARTITION BY {run}, chunk) AS size FROM c WINDOW w AS (PARTITION BY {run}, chunk ORDER BY created_at, id)),
members AS (SELECT episode_id, id, created_at FROM ep WHERE size >= 2)"""


_EPISODES = " SELECT episode_id, count(*) AS size, min(created_at) AS start, max(created_at) AS \"end\", string_agg(id, ',' ORDER BY created_at, id) AS record_ids FROM members GROUP BY episode_id"


def _episodes(spark: SparkSession, sf: str, **options) -> DataFrame:
    return memory.episode_rows(memory.episodes(memories(spark, sf), **options)).withColumn("record_ids", F.array_join("record_ids", ","))


@_register("episodes", _episode_sql("30 MINUTE", 100) + _EPISODES)
def episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _episodes(spark, sf)


@_register("episodes_per_user", _episode_sql("12 HOUR", 5, "user_id") + _EPISODES)
def episodes_per_user(spark: SparkSession, sf: str) -> DataFrame:
    return _episodes(spark, sf, gap_seconds=12 * 3600, max_records=5, per=["user_id"])


@_register("episode_records", _episode_sql("15 MINUTE", 100) + " SELECT episode_id, id FROM members")
def episode_records(spark: SparkSession, sf: str) -> DataFrame:
    return memory.episodes(memories(spark, sf), gap_seconds=900).select("episode_id", "id")


@_register("search_with_episodes", _episode_sql("30 MINUTE", 100) + f", {_VEC}, w AS (SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10) SELECT w.id, w.score, m.episode_id, coalesce((SELECT string_agg(o.id, ',' ORDER BY o.id) FROM members o WHERE o.episode_id = m.episode_id AND o.id <> w.id), '') AS siblings FROM w LEFT JOIN members m USING (id)")
def search_with_episodes(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.search(records(spark, sf), query_vector(spark, sf))
    return memory.with_siblings(hits, memory.episodes(memories(spark, sf))).withColumn("siblings", F.array_join("siblings", ","))


@_register("search_episodes", _CLUSTERS.format(0.40) + ", c AS (SELECT cluster_id, list(x ORDER BY i) AS vec FROM (SELECT cluster_id, i, round(avg(vec[i]), 6) AS x FROM m, range(1, 65) t(i) WHERE rank <= 10 GROUP BY cluster_id, i) GROUP BY cluster_id) SELECT cluster_id AS id, round(list_cosine_similarity(vec, q), 6) AS score FROM c, q ORDER BY score DESC, id LIMIT 10")
def search_episodes(spark: SparkSession, sf: str) -> DataFrame:
    centres = memory.clusters(records(spark, sf), threshold=0.40).selectExpr("cluster_id AS id", "centroid AS vector")
    return search.search(centres, query_vector(spark, sf)).select("id", "score")


@_register("session", f"WITH {_TURNS} SELECT id, turn, role, content FROM t WHERE session_id = 3")
def session(spark: SparkSession, sf: str) -> DataFrame:
    return memory.session(turns(spark, sf), 3).select("id", "turn", "role", "content")


@_register("session_stats", f"WITH {_TURNS} SELECT session_id, count(*) AS turns, min(created_at) AS first_at, max(created_at) AS last_at, count(*) FILTER (role = 'user') AS user_turns FROM t GROUP BY session_id")
def session_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = memory.session_stats(turns(spark, sf))
    return out.withColumn("user_turns", F.coalesce(F.try_element_at("roles", F.lit("user")), F.lit(0))).drop("roles")


@_register("list_sessions", f"WITH {_TURNS} SELECT DISTINCT session_id FROM t")
def list_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return memory.sessions(turns(spark, sf))


@_register("thread", f"WITH {_TURNS} SELECT id, role FROM t WHERE session_id = 5")
def thread(spark: SparkSession, sf: str) -> DataFrame:
    # The records' ids leave room for 1,000 turns a conversation; links need more.
    link = "conv_id * 1000000000L + turn"
    linked = table(spark, sf, "conversations").selectExpr(
        f"{link} AS id", f"CASE WHEN turn > 0 THEN {link} - 1 END AS parent_id", "conv_id * 1000 + turn AS record_id", "role",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, int(conv_id), int(turn)) AS created_at",
    )
    return memory.thread(linked, 5_000_000_001).select(F.col("record_id").alias("id"), "role")


@_register("cleanup_expired", f"WITH {_MEM} SELECT id FROM mem WHERE NOT coalesce(TIMESTAMP '2024-01-31' > expires_at, false)")
def cleanup_expired(spark: SparkSession, sf: str) -> DataFrame:
    return memory.cleanup_expired(memories(spark, sf), NOW).select("id")


@_register("count_expired", f"WITH {_MEM} SELECT count(*) FILTER (expires_at < TIMESTAMP '2024-01-31') AS expired FROM mem")
def count_expired(spark: SparkSession, sf: str) -> DataFrame:
    return memory.count_expired(memories(spark, sf), NOW)


@_register("ttl_on_insert", f"WITH {_MEM} SELECT id, coalesce(expires_at, TIMESTAMP '2024-01-31' + INTERVAL 2 HOUR) AS expires_at FROM mem")
def ttl_on_insert(spark: SparkSession, sf: str) -> DataFrame:
    return memory.with_expiry(memories(spark, sf), NOW, F.lit(7200)).select("id", "expires_at")


for _policy, _order in (("fifo", "created_at"), ("lru", "last_accessed_at NULLS FIRST"), ("importance", "importance, created_at")):
    _register(f"evict_{_policy}", f"WITH {_MEM}, w AS (SELECT * FROM mem ORDER BY {_order}, id LIMIT 80) SELECT id FROM w WHERE NOT archived")(
        lambda spark, sf, p=_policy: memory.evicted(memories(spark, sf), 800, p).select("id")
    )


@_register("enforce_limit", f"WITH {_MEM}, w AS (SELECT * FROM mem ORDER BY created_at, id LIMIT 80) SELECT id FROM mem WHERE id NOT IN (SELECT id FROM w WHERE NOT archived)")
def enforce_limit(spark: SparkSession, sf: str) -> DataFrame:
    return memory.enforce_limit(memories(spark, sf), 800).select("id")


@_register("archived", f"WITH {_MEM} SELECT id FROM mem WHERE (archived OR id IN (1, 2)) AND id <> 13")
def archived(spark: SparkSession, sf: str) -> DataFrame:
    df = memory.set_flag(memories(spark, sf), [1, 2], "archived", True)
    return memory.flagged(memory.set_flag(df, [13], "archived", False), "archived").select("id")


# Graph.

def _walk_sql(start: str, depth: int, where: str = "true", forth: str = "true", back: str = "true") -> str:
    return f"""WITH RECURSIVE {_GRAPH}, along AS (SELECT src AS here, dst AS there FROM edge WHERE ({where}) AND ({forth}) UNION ALL SELECT dst, src FROM edge WHERE ({where}) AND ({back})),
walk(id, depth) AS (SELECT id, 0 FROM ent WHERE id IN ({start}) UNION SELECT there, depth + 1 FROM walk JOIN along ON id = here WHERE depth < {depth}),
node AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id) SELECT id, type, depth::INTEGER AS depth FROM node JOIN ent USING (id)"""


def _walk(name: str, start: list[int], t: graph.Traversal, sql: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return graph.traverse(*knowledge(spark, sf), start, t)[0]

    _register(name, sql)(run)


_walk("traverse_d1", [100], graph.Traversal(1, None), _walk_sql("100", 1))
_walk("traverse_d2", [100, 103], graph.Traversal(2, None), _walk_sql("100, 103", 2))
_walk("traverse_typed", [1], graph.Traversal(3, None, relation_types=("located_in", "works_in")), _walk_sql("1", 3, "type IN ('located_in', 'works_in')"))
_walk("traverse_weighted", [1], graph.Traversal(2, None, min_weight=0.7), _walk_sql("1", 2, "weight >= 0.7::DOUBLE"))
_walk("traverse_outgoing", [100, 1000001], graph.Traversal(2, None, "outgoing"), _walk_sql("100, 1000001", 2, back="bidirectional"))
_walk("traverse_incoming", [0], graph.Traversal(2, None, "incoming"), _walk_sql("0", 2, forth="bidirectional"))
_walk("traverse_hidden", [0], graph.Traversal(2, None, entity_types=("customer",)), _walk_sql("0", 2) + " WHERE type = 'customer'")


@_register("neighbours", f"WITH {_GRAPH} SELECT id, type FROM edge WHERE dst = 105 OR (bidirectional AND src = 105)")
def neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbours(knowledge(spark, sf)[1], 105, "incoming").select("id", "type")


@_register("expand_search", f"WITH {_GRAPH}, {_VEC}, w AS (SELECT id + 1000000 AS id, score FROM s ORDER BY score DESC, id LIMIT 20), n AS (SELECT src AS id, dst AS o FROM edge UNION SELECT dst, src FROM edge) SELECT id, score, coalesce(string_agg(o, ',' ORDER BY o), '') AS neighbours FROM w LEFT JOIN n USING (id) GROUP BY id, score")
def expand_search(spark: SparkSession, sf: str) -> DataFrame:
    # Each vector stands for a customer; those beyond the last one have no neighbours.
    hits = search.search(records(spark, sf).withColumn("id", F.col("id") + 1_000_000), query_vector(spark, sf), SearchOptions(k=20))
    return graph.expand_search(hits, knowledge(spark, sf)[1]).withColumn("neighbours", F.array_join("neighbours", ","))


@_register("graph_stats", f"WITH {_GRAPH} SELECT 'entity' AS kind, type, count(*) AS count FROM ent GROUP BY type UNION ALL SELECT 'relationship', type, count(*) FROM edge GROUP BY type")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stats(*knowledge(spark, sf))


@_register("list_entities", f"WITH {_GRAPH} SELECT id, type, name FROM ent WHERE type = 'nation'")
def list_entities(spark: SparkSession, sf: str) -> DataFrame:
    return graph.list_entities(knowledge(spark, sf)[0], "nation")


@_register("delete_entity", f"WITH {_GRAPH} SELECT id FROM ent WHERE id <> 105 UNION ALL SELECT id FROM edge WHERE src <> 105 AND dst <> 105")
def delete_entity(spark: SparkSession, sf: str) -> DataFrame:
    entities, edges = graph.delete_entity(*knowledge(spark, sf), 105)
    return entities.select("id").unionAll(edges.select("id"))


@_register("add_relationships", f"WITH {_GRAPH} SELECT id, src, dst FROM edge UNION ALL SELECT 500000000 + n_nationkey, 100 + n_nationkey, (n_nationkey % 7)::BIGINT FROM nation WHERE n_nationkey % 7 < 5")
def add_relationships(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "nation").selectExpr("500000000L + n_nationkey AS id", "100L + n_nationkey AS src", "bigint(n_nationkey % 7) AS dst", "'near' AS type", "1D AS weight", "false AS bidirectional")
    return graph.add_relationships(*knowledge(spark, sf), new).select("id", "src", "dst")


# Store.

@_register("upsert_by_id", f"WITH {_MEM} SELECT id, CASE WHEN id % 100 = 7 THEN -1.0 ELSE value END AS value FROM mem UNION ALL SELECT 100000000 + n_nationkey, -2.0 FROM nation")
def upsert_by_id(spark: SparkSession, sf: str) -> DataFrame:
    df = memories(spark, sf).select("id", "kind", "value")
    old = df.where("id % 100 = 7").selectExpr("id", "-1D AS value")
    return store.upsert_by_id(df, old.unionAll(table(spark, sf, "nation").selectExpr("100000000L + n_nationkey", "-2D")), ["value"]).select("id", "value")


@_register("upsert_by_key", "WITH top AS (SELECT max(c_custkey) AS m FROM customer), x AS (SELECT c_mktsegment AS segment, min(c_custkey) AS id FROM customer GROUP BY 1) SELECT c_custkey AS id, CASE WHEN x.id IS NOT NULL THEN -1.0 ELSE c_acctbal END AS value FROM customer LEFT JOIN x ON x.id = c_custkey UNION ALL SELECT m + 1, -5.0 FROM top UNION ALL SELECT m + 2, -6.0 FROM top")
def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_mktsegment AS segment", "c_acctbal AS value")
    new = df.select("segment").distinct().selectExpr("segment", "-1D AS value").unionAll(spark.sql("SELECT * FROM VALUES ('new a', -5D), ('new b', -6D)"))
    return store.upsert_by_key(df, new, "segment", ["value"]).select("id", "value")


@_register("delete_where", f"WITH {_MEM} SELECT id FROM mem WHERE NOT (coalesce(kind = 'error', false) AND coalesce(value > 20, false))")
def delete_where(spark: SparkSession, sf: str) -> DataFrame:
    return store.delete_where(memories(spark, sf), P.equal("kind", "error"), P.gt("value", 20)).select("id")


@_register("update_payload", f"WITH {_MEM} SELECT id, CASE WHEN id % 2 = 0 THEN 'even' ELSE kind END AS kind FROM mem")
def update_payload(spark: SparkSession, sf: str) -> DataFrame:
    return store.update(memories(spark, sf), F.col("id") % 2 == 0, {"kind": F.lit("even")}).select("id", "kind")


@_register("set_space_vector", "SELECT vec_id AS id, CASE WHEN vec_id < 10 AND vec_id % 5 = 0 THEN 1 WHEN vec_id < 10 THEN 2 WHEN vec_id % 5 <> 0 THEN 1 END AS spaces FROM embeddings")
def set_space_vector(spark: SparkSession, sf: str) -> DataFrame:
    df = store.set_space_vector(records(spark, sf), F.col("id") < 10, "extra", F.col("vector"))
    return df.select("id", F.when(F.col("vectors").isNotNull(), F.size("vectors")).alias("spaces"))


@_register("insert_batch_ids", "SELECT vec_id AS id FROM embeddings UNION ALL SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id) FROM embeddings WHERE vec_id % 2 = 0")
def insert_batch_ids(spark: SparkSession, sf: str) -> DataFrame:
    df = records(spark, sf).select("id", "vector")
    return store.insert_batch(df, df.where("id % 2 = 0").selectExpr("id AS seq", "vector"), 64).select("id")


@_register("iterate_page", f"WITH {_MEM} SELECT id, kind FROM mem ORDER BY id LIMIT 50 OFFSET 100")
def iterate_page(spark: SparkSession, sf: str) -> DataFrame:
    return store.page(memories(spark, sf), 100, 50).select("id", "kind")


@_register("find_one", f"WITH {_MEM} SELECT id, kind FROM mem WHERE kind = 'purchase' ORDER BY id LIMIT 1")
def find_one(spark: SparkSession, sf: str) -> DataFrame:
    return store.find_one(memories(spark, sf), P.equal("kind", "purchase")).select("id", "kind")


@_register("get_record", f"WITH {_MEM} SELECT id, kind, importance FROM mem WHERE id = 77")
def get_record(spark: SparkSession, sf: str) -> DataFrame:
    return store.get(memories(spark, sf), 77).select("id", "kind", "importance")


@_register("collection_stats", "SELECT count(*) AS count, count(*) FILTER (e.vec_id IS NOT NULL) AS vector_count, count(*) FILTER (e.vec_id IS NULL) AS text_only, max(len(embedding))::INTEGER AS dimension FROM documents d FULL JOIN embeddings e ON doc_id = vec_id")
def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.collection_stats(_vector_texts(spark, sf))


@_register("space_stats", "SELECT 'default' AS space, count(*) AS count FROM embeddings UNION ALL SELECT 'reversed', count(*) FROM embeddings WHERE vec_id % 5 <> 0")
def space_stats(spark: SparkSession, sf: str) -> DataFrame:
    return store.space_stats(records(spark, sf))


@_register("validate", "SELECT coalesce(len(embedding), 0)::INTEGER AS dimension, count(*) AS rows, count(*) FILTER (e.vec_id IS NULL) AS zero_vectors FROM documents d FULL JOIN embeddings e ON doc_id = vec_id GROUP BY 1")
def validate(spark: SparkSession, sf: str) -> DataFrame:
    return store.validate(_vector_texts(spark, sf))


@_register("schema_sample", f"WITH {_MEM} SELECT 'k' AS field, 'number' AS type, count(*) AS count FROM (SELECT props FROM mem ORDER BY id LIMIT 50) WHERE json_exists(props, '$.k')")
def schema_sample(spark: SparkSession, sf: str) -> DataFrame:
    return store.schema_sample(memories(spark, sf), "props")


@_register("wal_replay", """WITH log AS (SELECT user_id AS id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), last AS (SELECT * FROM log WHERE r = 1)
SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT id FROM last) UNION ALL SELECT id, value FROM last WHERE event_type <> 'error'""")
def wal_replay(spark: SparkSession, sf: str) -> DataFrame:
    snapshot = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS value")
    log = table(spark, sf, "events").selectExpr("event_id AS seq", "CASE event_type WHEN 'error' THEN 'delete' ELSE 'put' END AS op", "user_id AS id", "value")
    return store.replay(snapshot, log)


@_register("without_content", "SELECT doc_id AS id, '' AS content, lang FROM documents")
def without_content(spark: SparkSession, sf: str) -> DataFrame:
    return search.without_content(texts(spark, sf)).select("id", "content", "lang")


@_register("subscription_matches", f"WITH {_VEC} SELECT 'near' AS subscription, id, score FROM s WHERE score >= 0.2 AND label <> 3")
def subscription_matches(spark: SparkSession, sf: str) -> DataFrame:
    sub = Subscription("near", query_vector(spark, sf), 0.2, filters=(P.not_equal("label", 3),))
    return matches(records(spark, sf), [sub]).select("subscription", "id", "score")


def _cells(spark: SparkSession, sf: str) -> ann.CellIndex:
    return ann.CellIndex.build(records(spark, sf).select("id", "vector", "label"), scratch_path(spark, "cells"))


@_register("ann_ivf")
def ann_ivf(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).search(query_vector(spark, sf)).select("id", "score")


def queries() -> dict[str, Query]:
    """One entry an operator; each takes (spark, sf_dir)."""
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return dict(_SQL)
