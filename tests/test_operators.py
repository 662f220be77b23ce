"""Operators on hand-made relations."""

import pytest
from pyspark.sql import functions as F

from engramlake.operators import graph as G
from engramlake.operators import relational as R
from engramlake.operators import retrieval as Q
from engramlake.operators import state as W
from engramlake.sources import bundles as B
from engramlake.streaming import streams as T

EDGE = "src string, dst string, rtype string, strength double, bidirectional boolean"


def edges(spark, *pairs):
    rows = [(p[0], p[1], "uses", float(p[2]) if len(p) > 2 else 1.0, False) for p in pairs]
    return spark.createDataFrame(rows, EDGE)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_page_rank(spark):
    r = as_dict(G.page_rank(edges(spark, "ab", "bc", "ca")), "node", "rank")
    assert all(v == pytest.approx(1 / 3) for v in r.values())
    r = as_dict(G.page_rank(edges(spark, "ab", "cb")), "node", "rank")
    assert sum(r.values()) == pytest.approx(1.0) and r["b"] > r["a"] == pytest.approx(r["c"])
    r = as_dict(G.page_rank(edges(spark, "ab", "bc", "cd"), seeds=["a"]), "node", "rank")
    assert r["a"] > r["b"] > r["c"] > r["d"] and sum(r.values()) == pytest.approx(1.0)
    assert G.page_rank(edges(spark)).count() == 0


def test_centrality(spark):
    b = as_dict(G.betweenness(edges(spark, "ab", "bc"), 2), "node", "score")
    assert b == {"b": pytest.approx(2.0)}
    c = {r.node: (r.harmonic, r.closeness) for r in G.closeness(edges(spark, "ab", "bc")).collect()}
    assert c == {"a": (pytest.approx(1.5), pytest.approx(2 / 3)), "b": (1.0, 1.0)}


def test_cores_and_communities(spark):
    e = edges(spark, "ab", "bc", "ca", "cd", "de")
    assert as_dict(G.core_numbers(e), "node", "core") == {"a": 2, "b": 2, "c": 2, "d": 1, "e": 1}
    two = edges(spark, "ab", "bc", "ca", "de", "ef", "fd", ("c", "d", 0.1))
    got = as_dict(G.communities(two), "node", "community")
    assert got["a"] == got["b"] == got["c"] != got["d"] == got["e"] == got["f"]
    assert as_dict(G.connected(edges(spark, "ab", "cb", "xy")), "node", "component") == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def test_long_chain_is_one_component(spark):
    e = spark.createDataFrame([(f"{i:03d}", f"{i + 1:03d}", "uses", 1.0, False) for i in range(40)], EDGE)
    assert {r.component for r in G.connected(e).collect()} == {"000"}


def test_paths(spark):
    e = edges(spark, ("a", "b", 0.5), ("b", "c", 0.5), ("c", "a", 0.5))
    assert {tuple(r.path) for r in G.paths(e, F.col("x") == "a", 5).collect()} == {("a", "b"), ("a", "b", "c")}
    assert as_dict(G.activate(e, spark.createDataFrame([("a",)], "node string"), 1), "node", "a")["b"] == pytest.approx(0.425)
    scored = spark.createDataFrame([("g", "p1", 15, 0.9), ("g", "p2", 10, 0.8), ("g", "p3", 4, 0.7)], "start string, id string, n_nodes int, score double")
    assert {r.id for r in G.prune_paths(scored, "start").collect()} == {"p1", "p3"}


def test_link_prediction(spark):
    got = as_dict(G.predict_links(edges(spark, "ab", "bc", "cd"), "a"), "candidate", "score")
    assert set(got) == {"c"}


def test_similar_names(spark):
    names = ["alpha service", "alpha servise", "beta queue", "beta queues", "gamma"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r.a, r.b) for r in R.similar_names(df, "id", "name", 0.6).collect()}
    assert got == {(0, 1), (2, 3)}


def test_self_loop_counts_once(spark):
    assert R.endpoints(edges(spark, "aa", "ab")).where("node = 'a'").count() == 2


def test_time_bounds_are_checked(spark):
    with pytest.raises(ValueError):
        R.between(spark.range(1), after="yesterday")


def ranked(spark, *rows):
    return spark.createDataFrame([("g", f"r{i}", i, s, t) for i, (s, t) in enumerate(rows, 1)], "grp string, id string, rank int, score double, content string")


def test_greedy_dedup(spark):
    df = ranked(spark, (0.9, "one two three"), (0.8, "Two three one"), (0.7, "four five"), (0.6, ""))
    assert {r.id for r in Q.greedy_dedup(df, "grp").collect()} == {"r1", "r3", "r4"}


def test_diversify(spark):
    df = ranked(spark, (0.03, "apple banana cherry"), (0.029, "apple banana cherry"), (0.01, "unrelated words here"))
    got = [r.id for r in Q.diversify(df, "grp", 3).orderBy("place").collect()]
    assert got == ["r1", "r3", "r2"]


def test_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "id string, rank int")
    b = spark.createDataFrame([("y", 1)], "id string, rank int")
    got = as_dict(Q.fuse([(a, 0.5), (b, 1.0)]), "id", "score")
    assert got == {"x": pytest.approx(0.5 / 61, abs=1e-8), "y": pytest.approx(0.5 / 62 + 1 / 61, abs=1e-8)}


def test_tombstones(spark):
    state = spark.range(100)
    with pytest.raises(ValueError):
        W.bury(state, spark.range(30))
    assert W.bury(state, spark.range(30), confirm=True).count() == 70
    children = spark.createDataFrame([(5,)], "parent long")
    assert W.bury(state, spark.range(10), children=children).count() == 91


def test_versions_fold_in_order(spark):
    puts = spark.createDataFrame([("p", 1, 0), ("p", 2, 0), ("p", 3, 1)], "path string, seq long, base long")
    assert [r.accepted for r in W.put_versions(puts).orderBy("seq").collect()] == [True, False, True]


def test_replicas_converge(spark):
    schema = "id long, content string, importance double, access_count long"
    a = spark.createDataFrame([(1, "x", 0.2, 3), (2, "y", 0.9, 1)], schema)
    b = spark.createDataFrame([(2, "z", 0.5, 4), (3, "w", 0.1, 0)], schema)
    ab, ba = W.merge_replica(a, b), W.merge_replica(b, a)
    pick = lambda df: sorted((r.id, r.importance, r.access_count) for r in df.collect())
    assert pick(ab) == pick(ba) == [(1, 0.2, 3), (2, 0.9, 4), (3, 0.1, 0)]
    assert {r.id for r in ab.where("conflict").collect()} == {2}
    with pytest.raises(ValueError):
        W.merge_replica(a, b, "other")


def test_audit_chain_shows_changes(spark):
    rows = spark.createDataFrame([(1, i, f"entry {i}") for i in range(5)], "log long, seq long, entry string")
    heads = [W.chain(r, "log", "seq", F.col("entry"), k).where("seq = 4").first().hash for r, k in ((rows, None), (rows.withColumn("entry", F.when(F.col("seq") == 2, "forged").otherwise(F.col("entry"))), None), (rows, b"key"))]
    assert len(set(heads)) == 3


def test_bundle_round_trip(spark, tmp_path):
    notes = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")], "entity string, id long, content string")
    path = f"file://{tmp_path}/bundle"
    tables = {"notes": B.nest(notes.select("entity").distinct(), notes)}
    B.write_bundle(tables, path)
    assert B.read_bundle(spark, path, ["notes"])["notes"].count() == 2
    tables["notes"].limit(1).write.mode("append").parquet(f"{path}/notes")
    with pytest.raises(ValueError):
        B.read_bundle(spark, path, ["notes"])


def test_pages(spark):
    files = spark.createDataFrame([(1, "a", 5), (1, "b", 4), (1, "c", 30), (1, "d", 1), (2, "e", 9)], "bundle int, name string, size long")
    assert as_dict(B.pages(files, 10, "bundle"), "name", "page") == {"a": 0, "b": 0, "c": 1, "d": 2, "e": 0}


def test_working_memory_expires(spark, tmp_path):
    schema = "key string, value string, ts timestamp"
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    put = lambda rows: spark.createDataFrame(rows, "key string, value string, t string").selectExpr("key", "value", "cast(t AS timestamp) AS ts").coalesce(1).write.mode("append").parquet(folder)
    put([("k", "v1", "2024-01-01 00:00:00"), ("k", "v2", "2024-01-01 00:00:10")])

    def step():
        w = T.appended(spark, folder, spark.createDataFrame([], schema).schema).withWatermark("ts", "0 seconds")
        T.run_available(T.working_memory(w, 60), lambda df, n: df.write.mode("append").parquet(out), f"{tmp_path}/checkpoint")

    step()
    put([("other", "x", "2024-01-01 01:00:00")])
    step()
    put([("other", "y", "2024-01-01 02:00:00")])
    step()
    got = [tuple(r) for r in spark.read.parquet(out).where("key = 'k'").collect()]
    assert ("k", "v2", True) in got and ("k", "v2", False) in got
