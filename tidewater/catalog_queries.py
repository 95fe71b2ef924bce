"""Registered queries of catalogs, inserts, text and vector indexes, turns, episodes and graphs, with their DuckDB oracles."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.catalog import Collection, CollectionOptions, Database, Profile, Space
from tidewater.functions import predicates as P
from tidewater.functions import vectors as V
from tidewater.operators import ann, graph, memory, search, store, text
from tidewater.operators.search import SearchOptions
from tidewater.plans.scratch import durable, scratch_path
from tidewater.queries import _ASK, _CLUSTERS, _GRAPH, _MEM, _TOKENS, _TURNS, _VEC, NOW, _bm25_sql, _cells, _episode_sql, _register, knowledge, memories, query_vector, records, table, texts, turns
from tidewater.sources.files import Snapshot, dump_json, ndjson, read_json
from tidewater.streaming.subscriptions import streaming_episodes


def _filled(spark: SparkSession, sf: str, options: CollectionOptions = CollectionOptions(), db: Database | None = None) -> Collection:
    """A collection of all embeddings, inserted in the order of their ids, so that a record's id is vec_id + 1."""
    c = (db or Database(spark)).create_collection("memories", options)
    c.insert(table(spark, sf, "embeddings").selectExpr("vec_id AS seq", "embedding AS vector", "label"), NOW)
    return c


# Catalog.

@_register("catalog_collections", "SELECT 'kept' AS name, 0::BIGINT AS count UNION ALL SELECT 'memories', count(*) FROM embeddings")
def catalog_collections(spark: SparkSession, sf: str) -> DataFrame:
    db = Database(spark)
    for name in ("kept", "dropped"):
        db.collection(name)
    _filled(spark, sf, db=db)
    db.drop_collection("dropped")
    return db.stats().where(F.col("name").isin(db.collections())).select("name", "count")


@_register("database_stats", "SELECT 'memories' AS name, count(*) AS count, count(*) AS vector_count, 0::BIGINT AS text_only FROM embeddings UNION ALL SELECT 'notes', count(*), 0::BIGINT, count(*) FROM documents UNION ALL SELECT NULL, (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM documents), (SELECT count(*) FROM embeddings), (SELECT count(*) FROM documents)")
def database_stats(spark: SparkSession, sf: str) -> DataFrame:
    db = Database(spark)
    _filled(spark, sf, db=db)
    db.create_collection("notes").insert_documents(table(spark, sf, "documents").selectExpr("doc_id AS seq", "text AS content"), NOW)
    return db.stats().select("name", "count", "vector_count", "text_only")


@_register("database_reload", "SELECT vec_id + 1 AS id, label FROM embeddings WHERE label <> 3")
def database_reload(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "database")
    db = Database(spark, path)
    c = _filled(spark, sf, db=db)
    db.sync()
    c.delete_where(P.equal("label", 3))
    db.close()
    return Database(spark, path, read_only=True).get_collection("memories").records.select("id", "label")


@_register("catalog_metadata", "SELECT 'owner' AS key, 'a' AS value UNION ALL SELECT 'kind', 'test'")
def catalog_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "database")
    db = Database(spark, path)
    c = db.create_collection("notes")
    c.set_metadata({"owner": "a", "old": "x"})
    c.set_metadata_value("kind", "test")
    c.delete_metadata_value("old")
    db.close()
    return spark.createDataFrame(sorted(Database(spark, path).get_collection("notes").metadata.items()), "key string, value string")


# Inserts.

@_register("insert_with_options", "SELECT vec_id + 1 AS id, CASE WHEN vec_id % 4 = 0 THEN 0.9::DOUBLE ELSE 0.25::DOUBLE END AS importance, TIMESTAMP '2024-01-31' + CASE WHEN vec_id % 3 = 0 THEN INTERVAL 10 MINUTE ELSE INTERVAL 2 HOUR END AS expires_at, TIMESTAMP '2024-01-31' AS created_at FROM embeddings")
def insert_with_options(spark: SparkSession, sf: str) -> DataFrame:
    c = Database(spark).create_collection("c")
    rows = table(spark, sf, "embeddings").selectExpr("vec_id AS seq", "embedding AS vector", "CASE WHEN vec_id % 4 = 0 THEN 0.9D END AS importance", "CASE WHEN vec_id % 3 = 0 THEN 600D END AS ttl_seconds")
    rows = rows.withColumn("importance", F.coalesce("importance", F.lit(0.25)))
    c.insert(rows, NOW, ttl=timedelta(hours=2))
    return c.records.select("id", "importance", "expires_at", "created_at")


@_register("insert_documents", "SELECT row_number() OVER (ORDER BY doc_id) AS id, text AS content, len(embedding)::INTEGER AS dimension FROM documents LEFT JOIN embeddings ON doc_id = vec_id")
def insert_documents(spark: SparkSession, sf: str) -> DataFrame:
    c = Database(spark).create_collection("c")
    rows = table(spark, sf, "documents").join(table(spark, sf, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    c.insert_documents(rows.selectExpr("doc_id AS seq", "text AS content", "embedding AS vector"), NOW)
    return c.records.select("id", "content", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dimension"))


def letters(words):
    """A small embedder: how often each of eight letters is in a text, and one."""
    low = F.lower(F.coalesce(words, F.lit("")))
    return F.array(*(F.regexp_count(low, F.lit(x)).cast("float") for x in "aeionrst"), F.lit(1.0).cast("float"))


_LETTERS = "[" + ", ".join(f"len(lower(coalesce({{0}}, ''))) - len(replace(lower(coalesce({{0}}, '')), '{x}', ''))" for x in "aeionrst") + ", 1]::DOUBLE[]"


@_register("search_text", f"WITH e AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, {_LETTERS.format('text')} AS v FROM conversations), s AS (SELECT id, round(list_cosine_similarity(v, {_LETTERS.format(chr(39) + 'rain on the stone' + chr(39))}), 6) AS score FROM e) SELECT id, score FROM s ORDER BY score DESC, id LIMIT 10")
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    c = Database(spark).create_collection("c")
    c.embedder = letters
    c.insert_text(table(spark, sf, "conversations").selectExpr("conv_id * 1000000 + turn AS seq", "text AS content"), NOW)
    return c.search_text("rain on the stone").select("id", "score")


@_register("insert_records", "SELECT vec_id + 1 AS id, CASE WHEN vec_id % 10 = 4 THEN 1 WHEN vec_id % 5 <> 0 THEN 2 ELSE 1 END AS spaces, (vec_id % 11)::DOUBLE / 10 AS importance, CASE WHEN vec_id % 10 = 4 THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-31' END AS updated_at FROM embeddings UNION ALL SELECT (SELECT max(vec_id) + 1 FROM embeddings) + 1, 1, 0.0, TIMESTAMP '2024-02-01'")
def insert_records(spark: SparkSession, sf: str) -> DataFrame:
    c = Database(spark).create_collection("c", CollectionOptions(spaces={"reversed": Space(), "other": Space()}))
    rows = records(spark, sf).selectExpr("id AS seq", "0L AS id", "map_concat(map('default', vector), coalesce(vectors, map())) AS vectors", "importance")
    c.insert_records(rows, NOW)
    again = c.records.where("id % 10 = 5").selectExpr("id AS seq", "id", "map('other', vector) AS vectors")
    c.insert_records(durable(again, "again"), NOW + timedelta(days=1))
    c.insert_records(c.records.where("id = 1").selectExpr("1L AS seq", "0L AS id", "map('', vector) AS vectors"), NOW + timedelta(days=1))
    held = F.when(F.size("vector") > 0, 1).otherwise(0) + F.when(F.col("vectors").isNotNull(), F.size("vectors")).otherwise(0)
    return c.records.select("id", held.alias("spaces"), "importance", "updated_at")


@_register("remember", "SELECT event_id AS id, (event_id % 11)::DOUBLE / 10 AS importance, NULL::TIMESTAMP AS expires_at FROM events UNION ALL SELECT (SELECT max(event_id) FROM events) + 1 + vec_id, 0.5, TIMESTAMP '2024-02-01' FROM embeddings")
def remember(spark: SparkSession, sf: str) -> DataFrame:
    df = memories(spark, sf).select("id", "created_at", "updated_at", F.lit(None).cast("timestamp_ntz").alias("expires_at"), "importance", "access_count")
    new = table(spark, sf, "embeddings").selectExpr("vec_id AS seq", "concat('note ', vec_id) AS content", "embedding AS vector", "array('note') AS tags")
    return memory.remember(df, new, NOW, ttl_hours=24).select("id", "importance", "expires_at")


@_register("forget", f"WITH {_MEM} SELECT id FROM mem WHERE NOT (coalesce(expires_at < TIMESTAMP '2024-01-31', false) AND importance < 0.5::DOUBLE AND created_at < TIMESTAMP '2024-01-21')")
def forget(spark: SparkSession, sf: str) -> DataFrame:
    return memory.forget(memories(spark, sf), NOW, only_expired=True, older_than=timedelta(days=10), below=0.5).select("id")


@_register("forget_tags", "SELECT vec_id AS id FROM embeddings WHERE vec_id % 4 <> 0")
def forget_tags(spark: SparkSession, sf: str) -> DataFrame:
    return memory.forget(records(spark, sf), NOW, tags=["a", "z"]).select("id")


@_register("clear_and_reset", "SELECT max(vec_id) + 2 AS after_clear, 1::BIGINT AS after_reset FROM embeddings")
def clear_and_reset(spark: SparkSession, sf: str) -> DataFrame:
    c, first = _filled(spark, sf), table(spark, sf, "embeddings").where("vec_id = 0").selectExpr("vec_id AS seq", "embedding AS vector")
    found = []
    for empty in (c.clear, c.reset):
        empty()
        found.append(c.insert(first, NOW).first()["id"])
    return spark.createDataFrame([tuple(found)], "after_clear long, after_reset long")


@_register("space_info", "SELECT 'default' AS space, count(*) AS count, 64 AS dimension FROM embeddings UNION ALL SELECT 'empty', 0, 0 UNION ALL SELECT 'reversed', count(*), 64 FROM embeddings WHERE vec_id % 5 <> 0")
def space_info(spark: SparkSession, sf: str) -> DataFrame:
    c = Database(spark).create_collection("c")
    c.add_space("reversed", Space(profile=Profile(model="m", dimension=64)))
    c.add_space("empty")
    c.insert_records(records(spark, sf).selectExpr("id AS seq", "0L AS id", "map_concat(map('', vector), coalesce(vectors, map())) AS vectors"), NOW)
    return c.spaces().select("space", "count", "dimension")


@_register("set_record_vector", "SELECT vec_id + 1 AS id FROM embeddings WHERE vec_id = 6")
def set_record_vector(spark: SparkSession, sf: str) -> DataFrame:
    c = _filled(spark, sf, CollectionOptions(spaces={"two": Space()}))
    c.set_record_vector(7, "two", [1.0, 2.0])
    return c.search_space("two", [1.0, 2.0]).select("id")


@_register("memory_limited_insert", "SELECT vec_id + 1 AS id FROM embeddings WHERE vec_id >= 40")
def memory_limited_insert(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "embeddings").count()
    return _filled(spark, sf, CollectionOptions(max_records=n - 40, batch=100)).records.select("id")


# Text and vector indexes.

def _text_index(spark: SparkSession, sf: str) -> text.TextIndex:
    return text.TextIndex(spark, scratch_path(spark, "text-index"), ["content"]).add(texts(spark, sf))


@_register("text_index_search", f"WITH {_bm25_sql(_ASK)} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def text_index_search(spark: SparkSession, sf: str) -> DataFrame:
    return _text_index(spark, sf).search(_ASK)


_CHANGED = _bm25_sql(_ASK).replace("FROM documents)", "FROM (SELECT doc_id, lang, CASE WHEN lang = 'es' THEN 'heon the ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE lang <> 'de'))")


@_register("text_index_update", f"WITH {_CHANGED} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 25")
def text_index_update(spark: SparkSession, sf: str) -> DataFrame:
    docs = texts(spark, sf)
    index = _text_index(spark, sf).remove(docs.where("lang = 'de'").select("id"))
    index.add(docs.where("lang = 'es'").withColumn("content", F.concat(F.lit("heon the "), F.coalesce("content", F.lit("")))))
    return index.compact(scratch_path(spark, "text-index")).search(_ASK, 25)


@_register("text_index_stats", f"WITH {_TOKENS} SELECT count(*) FILTER (len(words) > 0) AS documents, sum(len(words)) FILTER (lang <> 'fr')::BIGINT AS words FROM tok WHERE lang <> 'fr'")
def text_index_stats(spark: SparkSession, sf: str) -> DataFrame:
    index = _text_index(spark, sf).remove(texts(spark, sf).where("lang = 'fr'").select("id"))
    return index.stats().select("documents", F.round(F.col("documents") * F.col("avgdl")).cast("long").alias("words"))


@_register("ann_exact", f"WITH {_VEC} SELECT id, score FROM s WHERE label <> 4 ORDER BY score DESC, id LIMIT 10")
def ann_exact(spark: SparkSession, sf: str) -> DataFrame:
    own = records(spark, sf).select("id", "vector", "label")
    index = ann.CellIndex.build(own.where("id % 3 <> 0"), scratch_path(spark, "cells")).add(own.where("id % 3 = 0 OR label = 5"))
    gone = own.where("label IN (4, 6)").select("id")
    index.delete(gone).undelete(own.where("label = 6").select("id"))
    return index.search(query_vector(spark, sf), probe=1.0).select("id", "score")


@_register("ann_recall", "SELECT true AS enough, count(*) AS indexed FROM embeddings")
def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    index = _cells(spark, sf)
    queries = [list(r[0]) for r in records(spark, sf).where("id % 50 = 0").orderBy("id").limit(10).select("vector").collect()]
    return spark.createDataFrame([(ann.recall(index, queries) >= 0.9, index.count())], "enough boolean, indexed long")


@_register("ann_stats", "SELECT count(*) AS rows, true AS many FROM embeddings")
def ann_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf).stats().agg(F.sum("count").alias("rows"), (F.count(F.lit(1)) > 10).alias("many"))


@_register("ann_compact", "SELECT vec_id AS id FROM embeddings WHERE label <> 2")
def ann_compact(spark: SparkSession, sf: str) -> DataFrame:
    index = _cells(spark, sf)
    index.delete(records(spark, sf).where("label = 2").select("id"))
    return index.compact(scratch_path(spark, "cells")).table().select("id")


@_register("ann_euclidean", "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q WHERE label IN (1, 2) ORDER BY score, id LIMIT 10")
def ann_euclidean(spark: SparkSession, sf: str) -> DataFrame:
    index = ann.CellIndex.build(records(spark, sf).select("id", "vector", "label"), scratch_path(spark, "cells"), "euclidean")
    return index.search(query_vector(spark, sf), SearchOptions(metric="euclidean", filters=(P.any_of("label", 1, 2),)), probe=1.0).select("id", "score")


# Search.

_AGE = "((epoch(TIMESTAMP '2024-01-31') - epoch(created_at)) / 864000.0)"


@_register("knn_decay_and_importance", f"WITH {_VEC}, w AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 20) SELECT id, round(score * pow(2.0, -{_AGE}) * (1 + 0.5::DOUBLE * importance), 6) AS score FROM w ORDER BY score DESC, id")
def knn_decay_and_importance(spark: SparkSession, sf: str) -> DataFrame:
    o = SearchOptions(k=20, decay="exponential", half_life=864000, importance_boost=0.5, now=NOW)
    return search.search(records(spark, sf), query_vector(spark, sf), o).select("id", "score")


@_register("search_stream", f"WITH {_VEC} SELECT count(*) AS found, true AS within FROM (SELECT id FROM s WHERE score >= 0.1 AND label <> 3 LIMIT 25)")
def search_stream(spark: SparkSession, sf: str) -> DataFrame:
    o = SearchOptions(k=25, threshold=0.1, filters=(P.not_equal("label", 3),))
    found = search.unordered(records(spark, sf), query_vector(spark, sf), o)
    return found.agg(F.count(F.lit(1)).alias("found"), (F.min("score") >= 0.1).alias("within"))


@_register("search_explain", f"WITH {_VEC} SELECT (SELECT count(*) FROM v) AS records, count(*) AS scored, count(*) FILTER (score >= 0.1) AS within, true AS heap FROM s WHERE label <> 3")
def search_explain(spark: SparkSession, sf: str) -> DataFrame:
    e = search.explain(records(spark, sf), query_vector(spark, sf), SearchOptions(threshold=0.1, filters=(P.not_equal("label", 3),)))
    return spark.createDataFrame([(e["records"], e["scored"], e["within"], "TakeOrderedAndProject" in e["plan"])], "records long, scored long, within long, heap boolean")


@_register("truncated_content", "SELECT doc_id AS id, CASE WHEN len(text) > 200 THEN left(text, 200) || '... [200 of ' || len(text) || ' characters]' ELSE text END AS content FROM documents")
def truncated_content(spark: SparkSession, sf: str) -> DataFrame:
    return search.truncated(texts(spark, sf), most=200).select("id", "content")


@_register("filter_custom", f"WITH {_MEM} SELECT id FROM mem WHERE coalesce((id * 7) % 13 < 4 AND kind = 'view', false)")
def filter_custom(spark: SparkSession, sf: str) -> DataFrame:
    own = P.Filter(lambda df: (F.col("id") * 7 % 13 < 4) & (F.col("kind") == "view"))
    return store.find(memories(spark, sf), own).select("id")


@_register("equal_vectors", "SELECT vec_id AS id FROM embeddings WHERE embedding = (SELECT embedding FROM embeddings WHERE vec_id = 7)")
def equal_vectors(spark: SparkSession, sf: str) -> DataFrame:
    q = F.array(*map(F.lit, query_vector(spark, sf, 7))).cast("array<float>")
    return records(spark, sf).where(F.col("vector") == q).select("id")


# Turns and episodes.

@_register("insert_turns", f"WITH {_TURNS}, r AS (SELECT *, row_number() OVER (ORDER BY session_id, turn) AS n FROM t) SELECT n AS id, CASE WHEN turn > 0 THEN n - turn END AS thread_root FROM r")
def insert_turns(spark: SparkSession, sf: str) -> DataFrame:
    return _threaded(spark, sf).select("id", "thread_root")


def _threaded(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, their later halves inserted as replies to turns that are there, each turn a reply to the one before."""
    t = turns(spark, sf).selectExpr("session_id * 1000000 + turn AS seq", "session_id", "turn", "role", "content", "created_at", "CASE WHEN turn > 0 THEN session_id * 1000000 + turn - 1 END AS parent_seq")
    none = t.limit(0).selectExpr("seq AS id", "session_id", "turn", "role", "content", "created_at", "seq AS parent_id", "seq AS thread_root")
    return durable(memory.insert_turns(none, t.withColumn("parent_id", F.lit(None).cast("long"))), "turns")


@_register("thread_of_replies", "WITH r AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations), m AS (SELECT max(n) AS m FROM r) SELECT m + 1 AS id FROM m UNION ALL SELECT m + 2 FROM m UNION ALL SELECT n FROM r WHERE conv_id = 5")
def thread_of_replies(spark: SparkSession, sf: str) -> DataFrame:
    first = _threaded(spark, sf)
    last = first.where("session_id = 5").orderBy(F.desc("turn")).limit(1)
    reply = last.selectExpr("1L AS seq", "session_id", "turn + 1 AS turn", "'user' AS role", "'so' AS content", "created_at", "id AS parent_id", "CAST(NULL AS LONG) AS parent_seq")
    more = reply.unionAll(reply.selectExpr("2L", "session_id", "turn + 1", "role", "content", "created_at", "CAST(NULL AS LONG)", "1L"))
    every = memory.insert_turns(first, durable(more, "replies"))
    return memory.rooted_thread(every, first.agg(F.max("id")).first()[0] + 2).select("id")


@_register("turn_children", f"WITH {_TURNS} SELECT id - 1 AS id, id::VARCHAR AS children FROM t WHERE turn > 0")
def turn_children(spark: SparkSession, sf: str) -> DataFrame:
    return memory.children(turns(spark, sf)).withColumn("children", F.array_join("children", ","))


@_register("delete_session", f"WITH {_TURNS} SELECT id FROM t WHERE session_id <> 3")
def delete_session(spark: SparkSession, sf: str) -> DataFrame:
    return memory.delete_session(turns(spark, sf), 3).select("id")


def _store_of_episodes(spark: SparkSession, sf: str) -> DataFrame:
    none = spark.createDataFrame([], memory.EPISODE)
    own = records(spark, sf)
    for ids, title in (([1, 2, 3], "first"), ([9, 5, 7], "second"), ([3, 8], "third")):
        none = durable(memory.create_episode(none, own, ids, title), "episodes")
    return none


@_register("create_episodes", "SELECT * FROM (VALUES ('ep_1', 'first', '1,2,3', 3::BIGINT, 7200::BIGINT), ('ep_2', 'second', '5,7,9', 3, 14400), ('ep_3', 'third', '3,8', 2, 18000)) t(episode_id, title, record_ids, size, seconds)")
def create_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return memory.list_episodes(_store_of_episodes(spark, sf)).select("episode_id", "title", F.array_join("record_ids", ",").alias("record_ids"), "size", "seconds")


@_register("delete_episode", "SELECT * FROM (VALUES ('ep_1'), ('ep_3')) t(episode_id)")
def delete_episode(spark: SparkSession, sf: str) -> DataFrame:
    return memory.delete_episode(_store_of_episodes(spark, sf), "ep_2").select("episode_id")


@_register("record_episode", "SELECT 'ep_1' AS episode_id")
def record_episode(spark: SparkSession, sf: str) -> DataFrame:
    return memory.record_episode(_store_of_episodes(spark, sf), 3).select("episode_id")


@_register("search_stored_episodes", f"WITH {_VEC}, e AS (SELECT * FROM (VALUES ('ep_1', [1, 2, 3]), ('ep_2', [9, 5, 7]), ('ep_3', [3, 8])) t(episode_id, ids)), c AS (SELECT episode_id, i, round(avg(vec[i]), 6) AS x FROM e JOIN v ON list_contains(ids, v.id), range(1, 65) r(i) GROUP BY episode_id, i), m AS (SELECT episode_id, list(x ORDER BY i) AS centre FROM c GROUP BY episode_id) SELECT episode_id, round(list_cosine_similarity(centre, q), 6) AS score FROM m, q")
def search_stored_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return memory.search_episodes(_store_of_episodes(spark, sf), query_vector(spark, sf)).select("episode_id", "score")


@_register("session_windows", _episode_sql("30 MINUTE", 1_000_000_000) + " SELECT min(id) AS first_id, count(*) AS size, min(created_at) AS start FROM members GROUP BY episode_id")
def session_windows(spark: SparkSession, sf: str) -> DataFrame:
    own = memories(spark, sf).where("NOT archived").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return streaming_episodes(own).where("size >= 2").select("first_id", "size", F.col("start").cast("timestamp_ntz").alias("start"))


# Graph.

@_register("traverse_limited", f"""WITH {_GRAPH}, along AS (SELECT id AS edge, src AS here, dst AS there, 0 AS rank FROM edge UNION ALL SELECT id, dst, src, 1 FROM edge),
l0 AS (SELECT 1::BIGINT AS id, 0::BIGINT AS place),
m1 AS (SELECT there AS id, min(struct_pack(place := place, edge := edge, rank := rank)) AS via FROM l0 JOIN along ON here = l0.id GROUP BY there),
l1 AS (SELECT id, row_number() OVER (ORDER BY via, id) - 1 AS place FROM m1 WHERE id NOT IN (SELECT id FROM l0)),
m2 AS (SELECT there AS id, min(struct_pack(place := place, edge := edge, rank := rank)) AS via FROM l1 JOIN along ON here = l1.id GROUP BY there),
l2 AS (SELECT id, row_number() OVER (ORDER BY via, id) - 1 AS place FROM m2 WHERE id NOT IN (SELECT id FROM l0 UNION SELECT id FROM l1)),
n AS (SELECT id, 0 AS depth, place FROM l0 UNION ALL SELECT id, 1, place FROM l1 UNION ALL SELECT id, 2, place FROM l2)
SELECT id, depth FROM n ORDER BY depth, place LIMIT 100""")
def traverse_limited(spark: SparkSession, sf: str) -> DataFrame:
    return graph.traverse(*knowledge(spark, sf), [1], graph.Traversal(2, 0))[0].select("id", "depth")


@_register("add_entities", f"WITH {_GRAPH} SELECT id, type FROM ent UNION ALL SELECT 3000000 + p_partkey, 'part' FROM part")
def add_entities(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "part").selectExpr("3000000 + p_partkey AS id", "'part' AS type", "p_name AS name")
    return graph.add_entities(knowledge(spark, sf)[0], new).select("id", "type")


@_register("update_entity", f"WITH {_GRAPH} SELECT id, CASE WHEN id = 105 THEN 'renamed' ELSE name END AS name FROM ent")
def update_entity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.update_entity(knowledge(spark, sf)[0], 105, {"name": F.lit("renamed")}).select("id", "name")


@_register("get_entity", f"WITH {_GRAPH} SELECT id, type, name FROM ent WHERE id = 105")
def get_entity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.get_entity(knowledge(spark, sf)[0], 105)


@_register("get_relationship", f"WITH {_GRAPH} SELECT id, src, dst, type, weight FROM edge WHERE id = 1003")
def get_relationship(spark: SparkSession, sf: str) -> DataFrame:
    return graph.get_relationship(knowledge(spark, sf)[1], 1003).select("id", "src", "dst", "type", "weight")


@_register("delete_relationship", f"WITH {_GRAPH} SELECT id FROM edge WHERE id <> 1003")
def delete_relationship(spark: SparkSession, sf: str) -> DataFrame:
    return graph.delete_relationship(knowledge(spark, sf)[1], 1003).select("id")


@_register("graph_store", f"WITH {_GRAPH}, e AS (SELECT * FROM edge WHERE src <> 105 AND dst <> 105 AND id <> 1003) SELECT 'entity' AS kind, type, count(*) AS count FROM ent WHERE id <> 105 GROUP BY type UNION ALL SELECT 'relationship', type, count(*) FROM e GROUP BY type")
def graph_store(spark: SparkSession, sf: str) -> DataFrame:
    db = Database(spark)
    entities, edges = knowledge(spark, sf)
    g = db.create_graph("g")
    g.add_entities(entities)
    db.create_graph("g").add_relationships(edges)
    db.get_graph("g").delete_entity(105)
    g.delete_relationship(1003)
    return g.stats()


@_register("episode_store", _episode_sql("30 MINUTE", 50).replace("NOT archived", "true") + " SELECT episode_id, count(*) AS size FROM members GROUP BY episode_id UNION ALL SELECT 'ep_1', 2")
def episode_store(spark: SparkSession, sf: str) -> DataFrame:
    db = Database(spark)
    db.create_episode_store("e").create(records(spark, sf), [1, 2], "dropped")
    own = db.create_episode_store("e")
    own.create(records(spark, sf), [3, 4], "kept")
    live = memories(spark, sf).drop("archived").withColumn("vector", F.array(F.col("importance")))
    own.detect(live, max_records=50)
    return db.get_episode_store("e").list().select("episode_id", "size")


@_register("update_forms", "SELECT vec_id + 1 AS id, CASE WHEN vec_id = 2 THEN NULL ELSE label END AS label, CASE WHEN vec_id = 2 THEN 'x' END AS tag, CASE WHEN vec_id = 4 THEN 1.5 ELSE embedding[1]::DOUBLE END AS first, CASE WHEN vec_id IN (2, 4) THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-31' END AS updated_at FROM embeddings")
def update_forms(spark: SparkSession, sf: str) -> DataFrame:
    c, later = Database(spark).create_collection("c"), NOW + timedelta(days=1)
    c.insert(table(spark, sf, "embeddings").selectExpr("vec_id AS seq", "embedding AS vector", "label", "CAST(NULL AS STRING) AS tag"), NOW)
    c.update_payload(3, {"tag": F.lit("x")}, later)
    c.update_vector(5, [1.5] * 64, later)
    return c.records.select("id", "label", "tag", F.col("vector")[0].cast("double").alias("first"), "updated_at")


@_register("upsert_forms", "SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, CASE WHEN conv_id = 5 AND turn = 0 THEN 'changed' ELSE text END AS content FROM conversations UNION ALL SELECT (SELECT count(*) FROM conversations) + 1, 'new' UNION ALL SELECT (SELECT count(*) FROM conversations) + 2, 'by id'")
def upsert_forms(spark: SparkSession, sf: str) -> DataFrame:
    c = Database(spark).create_collection("c")
    c.insert_documents(table(spark, sf, "conversations").selectExpr("conv_id * 1000000 + turn AS seq", "text AS content", "concat(conv_id, '/', turn) AS path"), NOW)
    c.upsert_texts_by_key(spark.createDataFrame([("5/0", "changed"), ("z", "new")], "path string, content string"), "path")
    c.upsert(spark.createDataFrame([(0, "by id")], "id long, content string"), ["content"])
    return c.records.select("id", "content")


@_register("indexed_collection", f"WITH {_bm25_sql(_ASK)} SELECT id + 1 AS id, score FROM bm ORDER BY score DESC, id LIMIT 10")
def indexed_collection(spark: SparkSession, sf: str) -> DataFrame:
    c = Database(spark).create_collection("c")
    docs = table(spark, sf, "documents").selectExpr("doc_id AS seq", "text AS content")
    edge = docs.agg((F.max("seq") / 2).cast("long")).first()[0]
    c.insert_documents(docs.where(F.col("seq") <= edge), NOW)
    c.index_text(scratch_path(spark, "text-index"))
    c.insert_documents(docs.where(F.col("seq") > edge), NOW)
    return c.text_index.search(_ASK)


# Sources.

@_register("snapshot_versions", "SELECT 1 AS version, count(*) AS rows FROM customer UNION ALL SELECT 2, count(*) FROM customer WHERE c_acctbal > 0")
def snapshot_versions(spark: SparkSession, sf: str) -> DataFrame:
    s = Snapshot(spark, scratch_path(spark, "snapshot"))
    df = table(spark, sf, "customer")
    s.save(df)
    s.save(df.where("c_acctbal > 0"))
    count = lambda v: s.load(v).agg(F.lit(v).alias("version"), F.count(F.lit(1)).alias("rows"))
    return count(1).unionAll(count(2))


@_register("wal_checkpoint", """WITH log AS (SELECT user_id AS id, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), last AS (SELECT * FROM log WHERE r = 1)
SELECT c_custkey AS id, c_acctbal AS value FROM customer WHERE c_custkey NOT IN (SELECT id FROM last) UNION ALL SELECT id, value FROM last WHERE event_type <> 'error'""")
def wal_checkpoint(spark: SparkSession, sf: str) -> DataFrame:
    s = Snapshot(spark, scratch_path(spark, "snapshot"))
    s.save(table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_acctbal AS value"))
    log = table(spark, sf, "events").selectExpr("event_id AS seq", "CASE event_type WHEN 'error' THEN 'delete' ELSE 'put' END AS op", "user_id AS id", "value")
    s.append(log.where("seq % 2 = 0"))
    s.append(log.where("seq % 2 = 1"))
    s.checkpoint_at(1)
    return s.current()


@_register("json_round_trip", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS value FROM customer")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "dump")
    dump_json(table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS value"), path)
    return read_json(spark, path, "id long, name string, value double")


@_register("ndjson_lines", "SELECT n_nationkey AS id, n_name AS name FROM nation")
def ndjson_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = ndjson(table(spark, sf, "nation").selectExpr("n_nationkey AS id", "n_name AS name"))
    return lines.select(F.from_json("line", "id int, name string").alias("r")).select("r.*")


@_register("older_layout", "SELECT c_custkey AS id, NULL::VARCHAR AS segment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 1")
def older_layout(spark: SparkSession, sf: str) -> DataFrame:
    s, df = Snapshot(spark, scratch_path(spark, "snapshot")), table(spark, sf, "customer")
    s.save(df.where("c_custkey % 2 = 0").selectExpr("c_custkey AS id"))
    s.append(df.where("c_custkey % 2 = 1").selectExpr("c_custkey AS seq", "'put' AS op", "c_custkey AS id", "c_mktsegment AS segment"))
    return s.current().select("id", "segment")
