"""Global order, lineage and streams."""

import random

import pytest
from pyspark.sql import functions as F

from engramlake import lineage
from engramlake.operators import ordering as O
from engramlake.operators import relational as R
from engramlake.streaming import streams as T


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("aaaab") if i % 9 else None, rng.randrange(20), rng.randrange(5)) for i in range(500)]
    return spark.createDataFrame(rows, "id int, k string, v int, n long").repartition(7)


def test_global_rank(frame):
    got = [r.id for r in O.global_rank(frame, [F.desc("v"), F.asc("id")]).orderBy("rank").collect()]
    assert got == [r.id for r in sorted(frame.collect(), key=lambda r: (-r.v, r.id))]


def test_prefix_sums(frame):
    before = {r.id: r.before for r in O.prefix_sums(frame, [F.asc("v"), F.asc("id")], "n").collect()}
    total = 0
    for r in sorted(frame.collect(), key=lambda r: (r.v, r.id)):
        assert before[r.id] == total
        total += r.n


def test_rank_within_counts_null_keys(frame):
    got = {r.id: r.rank for r in O.rank_within(frame, ["k"], [F.asc("v"), F.asc("id")]).collect()}
    for key in ("a", "b", None):
        own = sorted((r for r in frame.collect() if r.k == key), key=lambda r: (r.v, r.id))
        assert [got[r.id] for r in own] == list(range(1, len(own) + 1))
    assert O.global_rank(frame.limit(0), [F.asc("id")]).count() == 0


def test_similar_names_match_all_pairs(spark):
    rng = random.Random(8)
    words = ["alpha", "alpine", "beta", "better", "gamma", "gamut", "delta", ""]
    rows = [(i, rng.choice("xy"), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))) for i in range(80)]
    df = spark.createDataFrame(rows, "id int, g string, name string")

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    for threshold in (0.3, 0.6, 0.9):
        for within in (None, "g"):
            want = {(a, b) for a, ga, x in rows for b, gb, y in rows if a < b and (within is None or ga == gb)
                    and grams(x) | grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) > threshold}
            got = [(r.a, r.b) for r in R.similar_names(df, "id", "name", threshold, within).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_cut_and_discard(spark):
    kept = lineage.cut(spark.range(10), "test")
    assert kept.count() == 10
    lineage.discard(kept)
    with pytest.raises(Exception):
        spark.read.parquet(kept.stored_at).count()


def test_streams_agree_with_batch(spark, small, tmp_path):
    e = spark.read.parquet(f"{small}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = f"{tmp_path}/in"
    e.repartition(3).write.parquet(folder)
    stream = T.appended(spark, folder, e.schema)
    for name, df, want in (
        ("windows", T.windowed(stream, "event_type", late="365 days"), e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))),
        ("sessions", T.sessions(stream, "user_id", late="365 days"), e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n"))),
    ):
        out = f"{tmp_path}/{name}"
        T.run_available(df, lambda b, n, out=out: b.write.mode("append").parquet(out), f"{tmp_path}/c-{name}", "complete")
        got = spark.read.schema(want.schema).parquet(out)
        assert sorted(map(str, got.distinct().collect())) == sorted(map(str, want.collect()))
