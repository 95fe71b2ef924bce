"""Small fixtures with hand-computed values."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import predicates as P
from tidewater.functions import vectors as V
from tidewater.operators import ann, fusion, graph, memory, search, store, text
from tidewater.plans.components import components
from tidewater.plans.ranks import running_total
from tidewater.queries import queries
from tidewater.sources.files import Snapshot, expand_env, ndjson, read_json
from tidewater.streaming.subscriptions import Subscription, file_stream, matches, streaming_episodes

NOW = datetime(2024, 1, 31)


def ids(df):
    return [r[0] for r in df.select("id").collect()]


def test_filters_are_two_valued(spark):
    df = spark.createDataFrame([(1, "go", 42.0), (2, None, None), (3, "py", 7.0)], "id long, lang string, line double")
    assert ids(store.find(df, P.negate(P.gt("line", 10)))) == [2, 3]
    assert ids(store.find(df, P.not_equal("lang", "go"))) == [2, 3]
    assert ids(store.find(df, P.equal("line", "42"))) == []
    assert ids(store.find(df, P.some_of())) == []
    assert ids(store.find(df, P.all_of())) == [1, 2, 3]
    assert ids(store.find(df, P.any_of("lang"))) == []
    assert ids(store.find(df, P.equal("lang", None))) == [] and ids(store.find(df, P.not_equal("lang", None))) == [1, 2, 3]
    assert ids(store.delete_where(df)) == [1, 2, 3]


def test_pushdown_of_bare_predicates(spark, tmp_path):
    spark.createDataFrame([(1, "go")], "id long, lang string").write.parquet(str(tmp_path / "t"))
    df = store.find(spark.read.parquet(str(tmp_path / "t")), P.equal("lang", "go"))
    assert "EqualTo(lang,go)" in df._jdf.queryExecution().toString()


@pytest.mark.parametrize(("pattern", "name", "hit"), [("*.go", "main.go", True), ("*.go", "main.py", False), ("test_*", "test_main.go", True), ("*", "a/b", False), ("[a-c]?", "bz", True), ("[", "[", False), ("*.go", "main.go\n", False)])
def test_glob(spark, pattern, name, hit):
    df = spark.createDataFrame([(1, name)], "id long, file string")
    assert (ids(store.find(df, P.glob("file", pattern))) == [1]) is hit


def test_metrics_and_decay(spark):
    a, b = V.literal([3.0, 4.0]), V.literal([4.0, 3.0])
    r = spark.range(1).select(V.cosine(a, b), V.dot(a, b), V.euclidean_squared(a, b), V.cosine(a, V.literal([0.0, 0.0])), V.dot(a, V.literal([1.0]))).first()
    assert r[0] == pytest.approx(0.96) and r[1] == 24 and r[2] == 2 and r[3] == 0 and r[4] == 0
    half = [V.decay(F.lit(1.0), F.lit(10.0), k, 10) for k in ("exponential", "linear", "gaussian", "none")]
    assert list(spark.range(1).select(*half).first()) == pytest.approx([0.5, 0.0, np.exp(-0.5), 1.0])


def test_paging_and_limit(spark):
    df = spark.createDataFrame([(i, [i / 10.0] * 3) for i in range(10)], "id long, vector array<float>")
    first = ids(search.search(df, [0.5] * 3, search.SearchOptions(k=3)))
    assert len(first) == 3 and 0 not in first
    assert not set(first) & set(ids(search.search(df, [0.5] * 3, search.SearchOptions(k=3, offset=3))))
    assert len(ids(search.search(df, [0.5] * 3, search.SearchOptions(limit=20)))) == 10


def test_tokens(spark):
    found = spark.createDataFrame([("punctuation! marks? here.",), ("code: main.go",), ("",), (None,)], "t string").select(text.tokens(F.col("t"))).collect()
    assert [r[0] for r in found] == [["punctuation", "marks", "here"], ["code", "main.go"], [], []]


def test_rrf(spark):
    a = spark.createDataFrame([(1, 0.9), (2, 0.8)], "id long, score double")
    b = spark.createDataFrame([(2, 0.95), (3, 0.85)], "id long, score double")
    out = fusion.fuse([a, b]).collect()
    assert [r.id for r in out] == [2, 1, 3]
    assert out[0].score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)


def test_clusters(spark):
    v = [[0.9, 0.1, 0, 0], [0.85, 0.15, 0, 0], [0.95, 0.05, 0, 0], [0.1, 0.9, 0, 0], [0.15, 0.85, 0, 0], [0, 0, 1, 0]]
    df = spark.createDataFrame([(i, list(map(float, x)), 0.5, NOW, f"m{i}") for i, x in enumerate(v)], "id long, vector array<float>, importance double, created_at timestamp, content string")
    assert sorted(tuple(r.ids) for r in memory.clusters(df, threshold=0.9).collect()) == [(0, 1, 2), (3, 4)]
    made, kept = memory.consolidate(df, lambda p: F.array_join(p, "+"), threshold=0.9)
    assert sorted(r.content for r in made.collect()) == ["m0+m1+m2", "m3+m4"]
    assert ids(kept.where(~F.col("archived"))) == [5]


def test_blocks_give_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(memory, "BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(40) for j in range(i + 1, 40) if round(u[i] @ u[j], 6) >= 0.7}
    assert {tuple(r) for r in memory.similar_pairs(df, 0.7).collect()} == want


def test_episodes(spark):
    at = [0, 10, 20, 70, 80]
    df = spark.createDataFrame([(i, datetime(2024, 1, 1) + timedelta(milliseconds=m)) for i, m in enumerate(at)], "id long, created_at timestamp")
    out = memory.episode_rows(memory.episodes(df, gap_seconds=0.04)).collect()
    assert sorted(tuple(r.record_ids) for r in out) == [(0, 1, 2), (3, 4)]
    assert memory.episodes(df, gap_seconds=0.05).select("episode_id").distinct().count() == 1


def test_eviction_counts_archived_rows(spark):
    df = spark.createDataFrame([(i, datetime(2024, 1, 1 + i), i == 0) for i in range(6)], "id long, created_at timestamp, archived boolean")
    assert ids(memory.evicted(df, 4, "fifo", batch=2)) == [1]
    assert ids(memory.evicted(df, 10)) == []


def test_knn_join_runs_any_number_of_queries_in_blocks(spark, monkeypatch):
    base = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, vector array<double>")
    asked = base.selectExpr("id AS query_id", "vector AS query")
    whole = sorted(map(tuple, search.knn_join(asked, base, 3).collect()))
    monkeypatch.setattr(search, "QUERY_BLOCK", 15)
    assert len(whole) == 120 and sorted(map(tuple, search.knn_join(asked, base, 3).collect())) == whole
    monkeypatch.undo()
    many = spark.range(20_001).selectExpr("id AS query_id", "array(1D, double(id)) AS query")
    assert search.knn_join(many, spark.createDataFrame([(1, [1.0, 0.0])], "id long, vector array<double>"), 1).count() == 20_001


def test_thread(spark):
    df = spark.createDataFrame([(1, None, NOW), (2, 1, NOW), (3, 2, NOW), (4, None, NOW)], "id long, parent_id long, created_at timestamp")
    assert ids(memory.thread(df, 3)) == [1, 2, 3]


def test_thread_is_whole_whatever_its_depth(spark):
    deep = [(i, i - 1 if i else None, NOW) for i in range(1100)]
    odd = [(2000, 9999, NOW), (2001, 9999, NOW), (3000, 3001, NOW), (3001, 3000, NOW), (3002, 3001, NOW), (4000, 4000, NOW), (5000, None, NOW)]
    df = spark.createDataFrame([*deep, *odd], "id long, parent_id long, created_at timestamp")
    assert sorted(ids(memory.thread(df, 1099))) == list(range(1100))
    for start, whole in ((2000, [2000]), (3002, [3000, 3001, 3002]), (4000, [4000]), (5000, [5000]), (6000, [])):
        assert ids(memory.thread(df.where("id >= 2000"), start)) == whole


def test_thread_query_takes_a_conversation_beyond_a_thousand_turns(spark, tmp_path):
    rows = [(conv, turn, "user", "x") for conv, n in ((5, 1100), (6, 3)) for turn in range(n)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert sorted(ids(queries()["thread"](spark, str(tmp_path)))) == [5000 + i for i in range(1100)]


def test_traverse(spark):
    people = spark.createDataFrame([(1, "person"), (2, "person"), (3, "person"), (4, "company")], "id long, type string")
    edges = spark.createDataFrame([(1, 1, 2, "knows", 1.0, False), (2, 2, 3, "knows", 1.0, False), (3, 1, 4, "works_at", 0.5, False), (4, 2, 4, "works_at", 1.0, False)], "id long, src long, dst long, type string, weight double, bidirectional boolean")
    nodes, met = graph.traverse(people, edges, [1], graph.Traversal(1))
    assert ids(nodes) == [1, 2, 4] and sorted(ids(met)) == [1, 3]
    assert ids(graph.traverse(people, edges, [1], graph.Traversal(3, 2))[0]) == [1, 2]
    assert ids(graph.traverse(people, edges, [1], graph.Traversal(3, 100, entity_types=("company",)))[0]) == [4]
    assert ids(graph.traverse(people, edges, [9])[0]) == []


def test_components_of_a_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (7, 7)], "a long, b long")
    found = dict(components(e).collect())
    assert all(found[i] == 0 for i in range(31)) and found[50] == found[40] == 40


def test_running_total(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(100)], "id long, n long")
    out = running_total(df, [F.col("id")], "n").orderBy("id").collect()
    assert [r.total_before for r in out] == [sum(j % 5 for j in range(i)) for i in range(100)]


def test_ivf_recall(spark, tmp_path):
    x = np.random.default_rng(42).normal(size=(600, 16))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    index, got = ann.CellIndex.build(df, f"file://{tmp_path}/ix"), 0
    for q in x[:5]:
        got += len(set(ids(index.search(q.tolist()))) & set(ids(search.search(df, q.tolist()))))
    assert got / 50 >= 0.95


def test_snapshot_and_log(spark, tmp_path):
    s = Snapshot(spark, f"file://{tmp_path}/db")
    s.save(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"))
    s.append(spark.createDataFrame([(1, "put", 2, "c"), (2, "delete", 1, None), (3, "put", 3, "d")], "seq long, op string, id long, v string"))
    assert sorted(map(tuple, s.current().select("id", "v").collect())) == [(2, "c"), (3, "d")]
    assert s.checkpoint() == 2 and sorted(ids(s.current())) == [2, 3]


def test_json_and_environment(spark, tmp_path, monkeypatch):
    (tmp_path / "a.json").write_text('[{"id": 1, "v": [1, 2]}, {"id": 2, "v": null}]')
    df = read_json(spark, str(tmp_path / "a.json"), "id long, v array<float>", array=True)
    assert sorted(ids(df)) == [1, 2] and ndjson(df).count() == 2
    monkeypatch.setenv("TW_X", "1")
    assert expand_env("${TW_X} ${TW_Y:-2}") == "1 2"


def test_errors(spark):
    df = spark.createDataFrame([(1, [1.0])], "id long, vector array<double>")
    with pytest.raises(store.NotFound):
        store.get(df, 5)
    with pytest.raises(store.DimensionMismatch):
        store.insert_batch(df, df.selectExpr("id AS seq", "array(1D, 2D) AS vector"), 1)


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.9, 0.1], NOW), (2, [0.0, 1.0], NOW)], "id long, vector array<double>, created_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), df.schema)
    q = matches(stream, [Subscription("s", [1.0, 0.0], 0.5)]).writeStream.format("memory").queryName("hits").trigger(availableNow=True).start()
    q.awaitTermination()
    assert ids(spark.table("hits")) == [1]
    q = streaming_episodes(stream).writeStream.format("memory").queryName("eps").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("eps").first()["size"] == 2
