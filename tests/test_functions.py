"""Small cases worked by hand."""

import math

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from engramlake.functions import registered
from engramlake.functions import scores as S
from engramlake.functions import text as X
from engramlake.functions import vectors as V
from engramlake.operators import stats as T
from engramlake.sources import chunks, codegraph, secrets


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_wilson(spark):
    assert round(value(spark, S.wilson_lower(F.lit(1), F.lit(1))), 2) == 0.21
    assert round(value(spark, S.wilson_lower(F.lit(47), F.lit(50))), 2) == 0.84
    assert value(spark, S.wilson_lower(F.lit(0), F.lit(0))) == 0.0


def test_text(spark):
    c = lambda s: F.lit(s)
    assert value(spark, X.entropy_bits(X.words(c("a b c d")))) == 2.0
    assert value(spark, X.entropy_bits(X.words(c("")))) == 0.0
    assert value(spark, X.overlap_coefficient(c("A b c"), c("a B x y"))) == pytest.approx(2 / 3)
    assert value(spark, X.overlap_coefficient(c(""), c("a"))) == 0.0
    assert sorted(value(spark, X.trigrams(c("cat")))) == ["  c", " ca", "at ", "cat"] == X.trigrams_of("cat")
    assert value(spark, X.trigram_similarity(c("word"), "word")) == 1.0
    assert value(spark, X.normalize_mention(c("My-App_v/2.x "))) == "my app v 2 x"
    assert value(spark, X.slug(c("  Hello, World! "))) == "hello-world"
    assert value(spark, X.slug(c("!!"))) == "procedimiento"
    assert value(spark, X.negation_differs(c("it is not so"), c("it is so")))
    assert value(spark, X.classify_paragraph(c("We decided to fix it"))) == "decision"
    assert value(spark, X.classify_query(c("How does a relate"))) == "multi_hop"
    assert value(spark, X.line_of_offset(c("a\nb\nc"), F.lit(3))) == 2
    assert value(spark, X.patch_once(c("a b a"), "a", "x")) == "a b a"
    assert value(spark, X.patch_once(c("a b"), "a", "x")) == "x b"
    assert value(spark, X.rank_any(c("x y x"), ["x"])) == pytest.approx(0.1 * 1.25 / 1.64493)


def test_scores(spark):
    f = F.lit
    assert value(spark, S.gate(f(0.92))) == "reinforce" and value(spark, S.gate(f(0.75))) == "update" and value(spark, S.gate(f(0.7))) == "create"
    assert value(spark, S.contradiction(f(0.8), f(True))) == 1.0
    assert value(spark, S.npmi(f(5), f(5), f(5), f(5))) is None
    assert value(spark, S.npmi(f(2), f(2), f(2), f(4))) == pytest.approx(1.0)
    assert value(spark, S.path_score(F.array(f(0.5), f(0.5)))) == pytest.approx(0.25 / 3)
    assert value(spark, S.memory_op(f("supersedes"), f(0.4), 0.5)) == "noop"
    assert value(spark, S.newer(f(2), f("a"), f(1), f("z"))) == "local"
    assert value(spark, S.chi2_survival(f(3.841), f(1.0))) == pytest.approx(0.05, abs=0.005)
    assert value(spark, S.decay(f(1.0), f(30.0), f(30.0), f(0))) == pytest.approx(0.5, abs=0.001)
    confidence, level = S.judged_grounding(f(0.0), f(0.4))
    assert value(spark, level) == "contradicted" and value(spark, confidence) == 0.0
    assert value(spark, S.nli_decision(f(0.81), f(0.1), f(0.1))) == "supports"


def test_vectors(spark):
    a, b = F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))
    assert value(spark, V.cosine(a, b)) == pytest.approx(math.sqrt(0.5))
    assert value(spark, V.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_hash_embedding_has_unit_length():
    v = X.embed_words("one two three", 16)
    assert sum(x * x for x in v) == pytest.approx(1.0)
    assert X.embed_words("", 4) == [0.0] * 4


def test_gains(spark):
    got = spark.range(1, 5).select(T.discounted("id").alias("g")).collect()
    assert [round(r.g, 4) for r in got] == [1.0, 1.0, round(1 / math.log2(3), 4), 0.5]


def test_bootstrap():
    assert T.bootstrap_interval([]) == (0.0, 0.0, 0.0)
    assert T.bootstrap_interval([0.3]) == (0.3, 0.3, 0.3)
    mean, low, high = T.bootstrap_interval([0.0, 1.0] * 20, 500)
    assert low <= mean <= high and mean == 0.5


def test_quantiles(spark):
    df = spark.createDataFrame([(float(x),) for x in [5, 1, 2, 2, 9, 7, 3, 3, 3, 8]], "x double")
    r = T.at_rank(df, "x", [("p50", T.nearest_rank(0.5)), ("c", T.conformal_rank(0.1))]).first()
    assert (r.p50, r.c) == (3.0, 9.0)


def test_outliers_match_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4)) @ np.diag([1, 2, 3, 4])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(4)
    m = T.fit_outliers(df, "v")
    cov = np.cov(x.T)
    mu = np.trace(cov) / 4
    c = x - x.mean(0)
    away = ((cov - mu * np.eye(4)) ** 2).sum() / 4
    spread = sum((np.outer(r, r) - cov).ravel() @ (np.outer(r, r) - cov).ravel() / 4 for r in c) / 200**2
    s = min(spread, away) / away
    want = np.linalg.inv(s * mu * np.eye(4) + (1 - s) * cov + mu * 1e-6 * np.eye(4))
    assert np.allclose(m.inverse, want) and m.shrinkage == pytest.approx(s)
    assert T.fit_outliers(df.limit(10), "v") is None


def test_chunks():
    assert chunks.split_text("x" * 1800) == []
    text = "".join(f"Sentence number {i} ends here. " for i in range(200))
    parts = chunks.split_text(text)
    assert all(p.endswith(".") for p in parts[:-1]) and all(len(p) <= 1400 for p in parts)
    assert all(p in text for p in parts) and parts[-1].endswith("199 ends here.")


@given(st.text(alphabet="ab .\n", max_size=6000))
def test_chunks_lose_no_words(text):
    parts = chunks.split_text(text, 200, 30, 250)
    if parts:
        assert max(map(len, parts)) <= 200
        at = 0
        for p in parts:
            found = text.find(p, max(0, at - 60))
            assert found >= 0
            at = found + len(p)
        assert not text[at:].strip()


def test_secrets():
    out, kind, at = secrets.scan("use password=hunter22 now")
    assert (out, kind, at) == ("use password=*** now", "password field", 4)
    assert secrets.scan("password:  hunter22")[:2] == ("password:  ***", "password field")
    assert secrets.scan("git clone https://bob:s3cr3t@host/x")[0] == "git clone https://bob:***@host/x"
    assert secrets.scan("key ghp_0123456789abcdef")[1] == "github token"
    assert secrets.scan('"sk-1"')[1] is None
    assert secrets.scan("eyJabc.def.ghi")[1] == "jwt bearer token" and secrets.scan("eyJabc.def")[1] is None
    assert secrets.scan("password=short")[1] is None
    assert secrets.scan("plain text only") == ("plain text only", None, None)
    assert secrets.scan(None) == (None, None, None)


def test_codegraph(spark):
    files = spark.createDataFrame([("a.py", "import os\n\ndef f():\n    g()\n\ndef g():\n    pass\n"), ("b.rs", "use std::fs;\nfn h() { k(1); }\nfn k(x: i32) {}\n"), ("bad.py", "def (")], "path string, content string")
    found = codegraph.symbols(files)
    got = {tuple(r) for r in codegraph.edges(found).collect()}
    assert got == {("f", "g", "uses"), ("h", "k", "uses"), ("a.py", "os", "depends_on"), ("b.rs", "std::fs", "depends_on")}


def test_registered_functions(spark):
    registered.register(spark)
    r = spark.sql("SELECT round(wilson_lower(1, 1), 2) AS w, gate(0.8) AS g, was_valid_at(timestamp'2024-01-01', NULL, timestamp'2024-02-01') AS v, normalize_mention('A-b  C') AS m").first()
    assert (r.w, r.g, r.v, r.m) == (0.21, "update", True, "a b c")


def test_trigrams_of_any_text(spark):
    """The expression over whole lines gives the grams that taking words apart by position gives."""
    texts = ["", "  ", None, "a", "Ab ab", "...x--yz Ünï straße", "𝒳𝒴 ab 𠀀𠀁", "x\ny\tz", "a b\u0085c", "ı İ", "éa", "٣٤٥", "!!!", "naïve\r\nthe  the"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = d.select("t", F.array_sort(X.trigrams(F.col("t"))).alias("a"), F.array_sort(X._trigrams_by_position(F.col("t"))).alias("b")).collect()
    assert all(r.a == r.b for r in rows)
    assert {r.t: r.a for r in rows}["Ab ab"] == ["  a", " ab", "ab "]
    assert [r.a for r in rows if r.t is None] == [None]
