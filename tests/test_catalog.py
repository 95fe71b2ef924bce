"""Databases, collections and indexes: what is refused, what is kept, and what a plan must not hold."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.catalog import CollectionOptions, Database, Profile, Space, model_dimensions
from tidewater.functions import predicates as P
from tidewater.operators import ann, graph, memory, search, store, text
from tidewater.plans import components as comp
from tidewater.sources.files import Snapshot, load_config, parse_duration

NOW = datetime(2024, 1, 31)
VECTORS = "seq long, vector array<float>, kind string"


def ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_names_are_taken_once_and_read_only_refuses(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    db = Database(spark, path)
    c = db.create_collection("a", CollectionOptions(metric="dot", spaces={"s": Space(2)}))
    with pytest.raises(store.CollectionExists):
        db.create_collection("a")
    assert db.collection("a") is c and db.has_collection("a") and not db.has_collection("b")
    with pytest.raises(store.NotFound):
        db.get_collection("b")
    c.insert(spark.createDataFrame([(1, [1.0, 2.0], "x"), (2, [3.0, 4.0], None)], VECTORS), NOW)
    db.set_metadata_value("v", 1)
    db.close()
    again = Database(spark, path, read_only=True)
    assert again.metadata == {"v": 1} and again.collections() == ["a"]
    own = again.get_collection("a")
    assert own.metric == "dot" and own.dimension == 2 and own.has_space("s") and own.next_id == 3 and ids(own.records) == [1, 2]
    for call in (lambda: own.clear(), lambda: again.create_collection("z"), lambda: c.clear(), lambda: own.add_space("t")):
        with pytest.raises(store.ReadOnly):
            call()
    third = Database(spark, path)
    third.drop_collection("a")
    third.close()
    assert Database(spark, path).collections() == []


def test_inserts_are_all_or_nothing(spark):
    c = Database(spark).create_collection("a")
    with pytest.raises(store.EmptyVector):
        c.insert(spark.createDataFrame([(1, [1.0], "x"), (2, [], "y")], VECTORS), NOW)
    with pytest.raises(store.DimensionMismatch):
        c.insert(spark.createDataFrame([(1, [1.0], "x"), (2, [1.0, 2.0], "y")], VECTORS), NOW)
    assert c.count() == 0 and c.next_id == 1
    with pytest.raises(store.RecordError):
        c.insert(spark.createDataFrame([(1, [1.0], "x"), (1, [1.0], "y")], VECTORS), NOW)
    c.insert(spark.createDataFrame([(2, [1.0], "x"), (1, [2.0], "y")], VECTORS), NOW, ttl=timedelta(seconds=5), expires_at=NOW)
    rows = {r["id"]: r for r in c.records.collect()}
    assert rows[1]["kind"] == "y" and rows[1]["expires_at"] == NOW and rows[1]["importance"] == 0
    with pytest.raises(store.DimensionMismatch):
        c.search([1.0, 2.0])
    with pytest.raises(store.NoEmbedder):
        c.search_text("x")
    c.delete(1)
    with pytest.raises(store.NotFound):
        c.get(1)
    assert c.delete_where() == 0 and c.delete_where(P.equal("kind", "x")) == 1 and c.count() == 0


def test_records_of_spaces(spark):
    c = Database(spark).create_collection("a", CollectionOptions(spaces={"s": Space()}))
    schema = "seq long, id long, vectors map<string,array<float>>, kind string"
    with pytest.raises(store.SpaceNotFound):
        c.insert_records(spark.createDataFrame([(1, 0, {"t": [1.0]}, "x")], schema), NOW)
    with pytest.raises(store.SpaceExists):
        c.add_space("default")
    c.insert_records(spark.createDataFrame([(1, 7, {"": [1.0], "s": [1.0, 2.0]}, "x"), (2, None, {"s": []}, "y")], schema), NOW)
    assert ids(c.records) == [7, 8] and c.next_id == 9
    c._set(store.update(c.records, F.col("id") == 7, {"importance": F.lit(0.7)}), "update")
    c.insert_records(spark.createDataFrame([(1, 7, {"s": [3.0, 4.0]}, "z")], schema), NOW + timedelta(days=1))
    row = c.get(7).first()
    assert (row["importance"], row["created_at"], row["updated_at"], row["vector"], row["kind"]) == (0.7, NOW, NOW + timedelta(days=1), None, "z")
    with pytest.raises(store.DimensionMismatch):
        c.set_record_vector(7, "s", [1.0])
    c.set_profile(Profile(model="m", dimension=2), "s")
    with pytest.raises(store.ProfileMismatch):
        c.set_profile(Profile(model="n"), "s")
    assert Profile().empty and c.get_vector(7) == []


def test_reads_and_metrics(spark):
    c = Database(spark).create_collection("a")
    c.insert(spark.createDataFrame([(i, [float(i), 1.0], "x") for i in range(20)], VECTORS), NOW)
    seen = []
    c.for_each(lambda r: seen.append(r["id"]) or len(seen) < 5)
    assert len(seen) == 5 and [r["id"] for r in c.iterate(3, 4)] == [4, 5, 6, 7]
    assert len(list(c.search_stream([1.0, 0.0], search.SearchOptions(k=3, threshold=0.5)))) == 3
    c.search([1.0, 0.0], search.SearchOptions(k=2, offset=1, limit=1), track_at=NOW)
    assert ids(c.records.where("access_count = 1")) == [18, 19, 20]
    assert c.explain([1.0, 0.0])["records"] == 20 and c.db.metrics.snapshot()["insert"][0] == 1
    c.update(3, {"kind": F.lit("y")}, NOW + timedelta(hours=1))
    assert c.get(3).first()["kind"] == "y" and c.cleanup_expired(NOW) == 0
    assert model_dimensions("All-MiniLM-L6-v2:latest") == 384 and model_dimensions("x") is None


def test_a_text_index_keeps_up(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Go programming", "Learn Go language"), (2, "Python tutorial", "Python for beginners"), (3, "Go patterns", "Advanced Go design patterns"), (4, "", None)], "id long, title string, body string")
    index = text.TextIndex(spark, f"file://{tmp_path}/ix", ["title", "body"]).add(docs)
    assert ids(index.search("Go")) == [1, 3] and ids(index.search("python")) == [2] and ids(index.search("nothing here")) == []
    assert index.stats().first()["documents"] == 3
    index.add(docs.where("id = 2").withColumn("body", F.lit("now Go")))
    index.remove(docs.where("id = 1").select("id"))
    for own in (index, index.compact(f"file://{tmp_path}/iy"), text.TextIndex(spark, f"file://{tmp_path}/ix", ["title", "body"])):
        assert ids(own.search("Go")) == [2, 3] and own.stats().first()["documents"] == 2
    live = docs.where("id in (2, 3)").withColumn("body", F.when(F.col("id") == 2, F.lit("now Go")).otherwise(F.col("body")))
    assert index.search("go patterns").collect() == text.bm25(live, "go patterns", ["title", "body"]).orderBy(F.desc("score"), "id").collect()
    with pytest.raises(ValueError):
        text.TextIndex(spark, "x", [])


def test_a_search_tokenises_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, content string")
    plan = text.bm25(df, "a b", ["content"])._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan and "Scan parquet" in plan


def test_a_cell_index_on_disk(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(300, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    for metric in ("cosine", "euclidean", "dot"):
        index = ann.CellIndex.build(df.where("id < 200"), f"file://{tmp_path}/{metric}", metric).add(df.where("id >= 190"))
        o = search.SearchOptions(metric=metric)
        q = x[3].tolist()
        exact = search.search(df, q, o).select("id", "score").collect()
        assert index.count() == 300 and index.search(q, o, probe=1.0).select("id", "score").collect() == exact
        best = df.where(F.col("id") == exact[0]["id"]).select("id")
        assert ids(index.delete(best).search(q, o, probe=1.0)) == sorted(r["id"] for r in search.search(df.join(best, "id", "left_anti"), q, o).collect())
        assert index.undelete(best).count() == 300
        near = index.nearest_cells(q)
        assert len(near) == len(set(near)) == len(index.centres)
    assert ann.recall(ann.CellIndex(spark, f"file://{tmp_path}/cosine"), [v.tolist() for v in x[:5]]) >= 0.9
    found = ann.CellIndex(spark, f"file://{tmp_path}/cosine").search(x[0].tolist(), search.SearchOptions(filters=(P.gt("id", 297),)), probe=0.1)
    assert ids(found) == [298, 299]


def test_episodes_have_no_hot_task(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=i), 1 if i % 3 else 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, created_at timestamp, user long").repartition(6)
    out = memory.episodes(df, gap_seconds=60, max_records=100)
    assert sorted(r["size"] for r in memory.episode_rows(out).collect()) == [100, 100, 100]
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()
    per = memory.episode_rows(memory.episodes(df, gap_seconds=120, max_records=1000, per=["user"])).collect()
    assert sorted(r["size"] for r in per) == [200]
    per = memory.episode_rows(memory.episodes(df, gap_seconds=180, max_records=1000, per=["user"])).collect()
    assert sorted(r["size"] for r in per) == [100, 200]


def test_near_equal_vectors_do_not_make_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(memory, "BLOCK", 50)
    rng = np.random.default_rng(2)
    x = np.concatenate([np.ones((150, 4)), rng.normal(size=(60, 4))]) + rng.normal(size=(210, 4)) * 1e-3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    every, joined = memory.similar_pairs(df, 0.9), memory.similar_pairs(df, 0.9, joined=True)
    assert sorted(map(tuple, comp.components(every).collect())) == sorted(map(tuple, comp.components(joined).collect()))
    assert joined.count() < 1500 < every.count()


def test_small_and_large_graphs_have_the_same_components(spark, monkeypatch):
    r = np.random.default_rng(3)
    edges = spark.createDataFrame([tuple(map(int, r.integers(0, 200, 2))) for _ in range(150)], "a long, b long")
    small = sorted(map(tuple, comp.components(edges).collect()))
    monkeypatch.setattr(comp, "SMALL_EDGES", 0)
    assert small == sorted(map(tuple, comp.components(edges).collect())) and comp.components(edges.limit(0)).count() == 0


def test_traversal_numbers_a_level_in_many_tasks(spark):
    people = spark.createDataFrame([(i, "p") for i in range(150)], "id long, type string")
    edges = spark.createDataFrame([(i, 0, i, "t", 1.0, False) for i in range(1, 150)], "id long, src long, dst long, type string, weight double, bidirectional boolean")
    assert graph.traverse(people, edges, [0])[0].count() == 100 and graph.traverse(people, edges, [0], graph.Traversal(max_nodes=0))[0].count() == 100
    assert graph.traverse(people, edges, [0], graph.Traversal(max_nodes=None))[0].count() == 150


def test_evictions_of_any_size(spark, monkeypatch):
    df = spark.createDataFrame([(i, NOW + timedelta(days=(i * 7) % 50)) for i in range(50)], "id long, created_at timestamp")
    want = ids(memory.evicted(df, 20, batch=25))
    monkeypatch.setattr(memory, "HEAP_ROWS", 3)
    assert ids(memory.evicted(df, 20, batch=25)) == want and len(want) == 25
    assert memory.enforce_limit(df, 20, batch=25).count() == 25


def test_turns_know_their_root(spark):
    schema = "seq long, session_id long, parent_id long, parent_seq long, created_at timestamp"
    none = spark.createDataFrame([], "id long, session_id long, parent_id long, created_at timestamp")
    first = memory.insert_turns(none, spark.createDataFrame([(1, 1, None, 9, NOW), (5, 1, None, 1, NOW), (9, 1, None, None, NOW), (12, 1, 77, None, NOW)], schema))
    assert {r["id"]: r["thread_root"] for r in first.collect()} == {1: 3, 2: 3, 3: None, 4: None}
    then = memory.insert_turns(first, spark.createDataFrame([(1, 1, 2, None, NOW), (2, 1, None, 1, NOW)], schema))
    assert {r["id"]: r["thread_root"] for r in then.collect()}[6] == 3 and ids(memory.rooted_thread(then, 5)) == [1, 2, 3, 5, 6]
    with pytest.raises(store.RecordError):
        memory.insert_turns(none, spark.createDataFrame([(1, None, None, None, NOW)], schema))
    with pytest.raises(store.NotFound):
        memory.rooted_thread(then, 99)


def test_conditions_and_episodes_that_are_refused(spark):
    df = spark.createDataFrame([(1, NOW, 0.5, [1.0])], "id long, created_at timestamp_ntz, importance double, vector array<double>")
    with pytest.raises(store.RecordError):
        memory.forget(df, NOW)
    none = spark.createDataFrame([], memory.EPISODE)
    with pytest.raises(store.NotFound):
        memory.create_episode(none, df, [1, 2], "x")
    with pytest.raises(store.NotFound):
        memory.delete_episode(none, "ep_1")
    assert memory.record_episode(memory.create_episode(none, df, [1], "x"), 2).count() == 0
    assert memory.search_episodes(memory.create_episode(none, df, [1], "x"), [1.0, 2.0]).count() == 0


def test_graph_changes_that_are_refused(spark):
    people = spark.createDataFrame([(1, "p")], "id long, type string")
    edges = spark.createDataFrame([(1, 1, 1, "t", 1.0, False)], "id long, src long, dst long, type string, weight double, bidirectional boolean")
    for call in (lambda: graph.add_entities(people, people), lambda: graph.add_relationships(people, edges, edges.unionAll(edges))):
        with pytest.raises(store.RecordError):
            call()
    for call in (lambda: graph.update_entity(people, 2, {"type": F.lit("q")}), lambda: graph.delete_relationship(edges, 9), lambda: graph.get_entity(people, 9)):
        with pytest.raises(store.NotFound):
            call()


def test_upserts(spark):
    df = spark.createDataFrame([(1, "a"), (5, "b")], "id long, v string")
    new = spark.createDataFrame([(5, "c"), (0, "d"), (None, "e")], "id long, v string")
    assert sorted(map(tuple, store.upsert_by_id(df, new, ["v"]).collect())) == [(1, "a"), (5, "c"), (6, "d"), (7, "e")]
    with pytest.raises(store.RecordError):
        store.upsert_by_id(df, spark.createDataFrame([(5, "c"), (5, "d")], "id long, v string"), ["v"])


def test_a_log_keeps_what_came_during_a_checkpoint(spark, tmp_path, monkeypatch):
    s = Snapshot(spark, f"file://{tmp_path}/db")
    s.save(spark.createDataFrame([(1, "a")], "id long, v string"))
    entry = lambda i: spark.createDataFrame([(i, "put", i, f"v{i}")], "seq long, op string, id long, v string")
    s.append(entry(2))
    own = s.save
    monkeypatch.setattr(s, "save", lambda df: (own(df), s.append(entry(3)))[0])
    assert s.checkpoint() == 2
    assert ids(s.current()) == [1, 2, 3] and len(s._segments()) == 1 and s.checkpoint_at(1 << 30) is None
    odd = spark.createDataFrame([(9, None, 4, "x"), (9, None, 4, "y"), (10, "delete", 1, None)], "seq long, op string, id long, v string")
    first, again = (store.replay(s.current(), x).orderBy("id").collect() for x in (odd, odd.orderBy(F.desc("v"))))
    assert first == again and [r["id"] for r in first] == [2, 3, 4]


def test_durations_and_configuration(monkeypatch):
    assert parse_duration("1h30m") == timedelta(minutes=90) and parse_duration("-250ms") == timedelta(milliseconds=-250) and parse_duration("0") == timedelta(0)
    for bad in ("", "5", "1x", "h"):
        with pytest.raises(ValueError):
            parse_duration(bad)
    monkeypatch.setenv("TW_HOST", "here")
    assert load_config("server:\n  host: ${TW_HOST}  # where\n  port: ${TW_PORT:-80}\nname: 'x'\n") == {"server.host": "here", "server.port": "80", "name": "x"}


def test_workers_repeat_until_they_are_stopped(spark, tmp_path):
    import time

    from tidewater.streaming.subscriptions import Subscription, file_stream, matches
    from tidewater.streaming.workers import Repeating, start_cleaner, start_limiter, subscribe

    c = Database(spark).create_collection("a")
    c.insert(spark.createDataFrame([(i, [1.0, float(i)], "x") for i in range(6)], VECTORS), NOW, ttl=timedelta(hours=1))
    heard = []
    cleaner = start_cleaner(c, 0.01, lambda: NOW + timedelta(hours=2), heard.append)
    end = time.monotonic() + 60
    while not heard and time.monotonic() < end:
        time.sleep(0.05)
    cleaner.stop()
    assert heard[0] == 6 and c.count() == 0 and not cleaner.running and cleaner.error is None
    c.insert(spark.createDataFrame([(i, [1.0, float(i)], "x") for i in range(6)], VECTORS), NOW)
    limiter = start_limiter(c, 4, "fifo", 0.01, batch=10)
    while c.count() > 4 and time.monotonic() < end:
        time.sleep(0.05)
    limiter.stop()
    assert ids(c.records) == [9, 10, 11, 12]
    failing = Repeating(lambda: 1 / 0, 0.01)
    failing._thread.join(5)
    assert isinstance(failing.error, ZeroDivisionError)
    c.records.select("id", "vector").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = matches(file_stream(spark, str(tmp_path / "in"), "id long, vector array<float>"), [Subscription("s", [0.0, 1.0], 0.97)])
    seen = []
    q = subscribe(stream, lambda df, n: seen.extend(r["id"] for r in df.collect()), str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [11, 12] and not q.isActive
