"""Operators over whole texts and graphs against plain versions."""

import random

from pyspark.sql import functions as F

from engramlake.functions import text as X
from engramlake.operators import graph as G
from engramlake.operators import relational as R
from engramlake.operators import retrieval as Q


def test_cut_bytes(spark):
    texts = ["", "abc", "é" * 6, "aé" * 5, "a€b€c€", "𝒳y𝒳y𝒳", None, "abcdefghij"]

    def plain(t, most):
        return None if t is None else t.encode()[:most].decode("utf-8", "ignore")

    d = spark.createDataFrame([(t,) for t in texts], "t string")
    for most in (4, 5, 6, 7, 8, 10):
        got = d.select("t", X.cut_bytes(F.col("t"), most).alias("c")).collect()
        assert [r.c for r in got] == [plain(r.t, most) for r in got]


def test_similar_long_texts(spark):
    """Pairs that differ late, share an opening only, or are alike, in groups with and without a name."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(150)]
    rows = []
    for k in range(30):
        base = rng.choices(vocabulary, k=120)
        for v in range(3):
            words = list(base)
            for _ in range(v * rng.randint(0, 12)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((len(rows), None if k % 3 == 0 else f"g{k % 3}", " ".join(words)))
    rows += [(len(rows), "g1", rows[5][2]), (len(rows) + 1, "g1", ""), (len(rows) + 2, "g1", None)]
    d = spark.createDataFrame(rows, "id long, grp string, t string")
    grams = {i: set(X.trigrams_of(t or "")) for i, _, t in rows}
    want = {(a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x == y and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) > 0.8}
    got = {(r.a, r.b) for r in R.similar_names(d, "id", "t", 0.8, within="grp").collect()}
    assert want and got == want


def test_links_of_copies(spark):
    """Copies hang on their class's least id, different texts are linked by these, and the first pairs are those of all."""
    rng = random.Random(11)
    base = ["alpha beta gamma delta", "alpha beta gamma delto", "one two three four five", "one two three four fiv", "quite another", "", None]
    rows = [(i, f"g{i % 2}" if i % 5 else None, rng.choice(base)) for i in rng.sample(range(1000), 70)]
    d = spark.createDataFrame(rows, "id long, grp string, t string")
    grams = {i: frozenset(X.trigrams_of(t or "")) for i, _, t in rows}
    least = {}
    for i, g, _ in sorted(rows):
        least.setdefault((g, grams[i]), i)
    every = sorted((a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x == y and grams[a] and grams[b] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) > 0.7)
    reps = set(least.values())
    want = {(a, b) for a, b in every if a in reps and b in reps} | {(least[g, grams[i]], i) for i, g, _ in rows if grams[i] and i not in reps}
    found = [(r.a, r.b) for r in R.similar_links(d, "id", "t", 0.7, within="grp").collect()]
    assert len(found) == len(set(found)) < len(every) and set(found) == want
    for k in (1, 7, 40, 10_000):
        assert sorted((r.a, r.b) for r in R.first_pairs(d, "id", "t", 0.7, k, within="grp").collect()) == every[:k]


def test_similar_sets_in_blocks(spark, monkeypatch):
    """Blocks of few sets, few grams as bits and few first rows give the same pairs, characters of any width included; pairs
    are compared without sending a set for each."""
    rng = random.Random(12)
    letters = "abcdeéßж漢𝒳"
    vocabulary = ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(60)]
    rows = []
    for k in range(60):
        base = rng.choices(vocabulary, k=rng.randint(1, 60))
        rows += [(3 * k + v, rng.choice(["x", None]), " ".join(base + rng.choices(vocabulary, k=v * len(base) // 12))) for v in range(3)]
    d = spark.createDataFrame(rows, "id long, grp string, t string")
    grams = {r.id: frozenset(r.g) for r in d.select("id", X.trigrams(F.col("t")).alias("g")).collect()}
    every = sorted((a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x == y and grams[a] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) > 0.7)
    assert len(every) > 20
    for block, dense, lead in ((16_384, 4096, 16), (7, 64, 1), (20, 3, 1)):
        for name, value in (("BLOCK_SETS", block), ("DENSE_GRAMS", dense), ("LEAD_WORDS", lead), ("FIRST_ROWS", block)):
            monkeypatch.setattr(R, name, value)
        found = [(r.a, r.b) for r in R.similar_names(d, "id", "t", 0.7, within="grp").collect()]
        assert sorted(found) == every
        for k in (3, 10_000):
            assert [(r.a, r.b) for r in R.first_pairs(d, "id", "t", 0.7, k, within="grp").collect()] == every[:k]


def test_first_pairs_store_no_sets(spark, monkeypatch):
    """Where the least rows have the pairs asked for, no row's set is stored; tasks keep the first pairs only, in groups, parts
    and orders of any kind, and rows of many grams are not held."""
    rng = random.Random(14)
    vocabulary = ["".join(rng.choices("abcdeéßж漢𝒳İ\u0301_", k=rng.randint(1, 6))) for _ in range(40)]
    rows = []
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.randint(1, 40))
        rows += [(rng.choice(["x", "y", None]), " ".join(base + rng.choices(vocabulary, k=v * len(base) // 14)).upper()) for v in (0, 0, 0, 1, 2)]
    rows = [(f"k{i:03d}", g, t) for i, (g, t) in enumerate(rng.sample(rows + [("x", ""), ("x", None), (None, "...")], len(rows) + 3))]
    d = spark.createDataFrame(rng.sample(rows, len(rows)) + [(None, "x", rows[5][2])], "id string, grp string, t string").repartition(3)
    grams = {r.id: frozenset(r.g or []) for r in d.select("id", X.trigrams(F.col("t")).alias("g")).collect()}
    every = sorted((a, b) for a, x, _ in rows for b, y, _ in rows if a < b and x == y and grams[a] and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) > 0.7)

    def first(k):
        return [(r.a, r.b) for r in R.first_pairs(d, "id", "t", 0.7, k, within="grp").collect()]

    whole = R._signed_classes
    monkeypatch.setattr(R, "_signed_classes", None)
    monkeypatch.setattr(R, "FIRST_ROWS", 2)
    blank = spark.createDataFrame([(0, None), (1, "..."), (2, None), (3, "ab cd"), (4, ""), (5, "cd ab")], "i long, t string")
    assert [tuple(r) for r in R.first_pairs(blank, "i", "t", 0.7, 3).collect()] == [(3, 5)]
    for least, part, k in ((1024, 100, 10_000), (20, 1, 5), (4, 100, 12)):
        monkeypatch.setattr(R, "FIRST_ROWS", least)
        monkeypatch.setattr(R, "PART_BYTES", part)
        assert first(k) == every[:k] and len(every) > 40
    monkeypatch.setattr(R, "_signed_classes", whole)
    for most, k in ((0, 30), (300, 10_000)):
        monkeypatch.setattr(R, "FIRST_GRAMS", most)
        assert first(k) == every[:k]
    assert not R.first_pairs(d.where("id < ''"), "id", "t", 0.7, 3, within="grp").count()


def test_grams_of_texts(spark):
    """Sets that tasks take apart are those of the expression, whatever the letters."""
    rng = random.Random(15)
    texts = ["", " ", "a", "A b", "...", "İıK\u0301x", "x_y-z", "a\nb\0c", "𝒳𝒳 y"] + ["".join(rng.choices(range_, k=rng.randint(0, 60))) for range_ in ("aB c.é", "ab漢ж 𝒳\u0903²Ⅷ", "".join(map(chr, range(1, 0x3000))) + " " * 4000) for _ in range(40)]
    d = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.lower("t").alias("low"), X.trigrams(F.col("t")).alias("g")).orderBy("i").collect()
    flat, sizes = R._text_codes([r.low for r in d], R._of_words(X.letters(spark)))
    flat = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in flat.tolist()]
    for r, n in zip(d, sizes.tolist()):
        assert sorted(r.g) == sorted(flat[:n])
        flat = flat[n:]
    assert not flat


def test_merge_without_entity(spark, tmp_path):
    """Notes of no entity have no duplicates, as in the SQL."""
    import duckdb

    from engramlake.plans import registry

    registry.load()
    rows = [(i, f"the same text {i // 4}", "en", None if i % 2 else "src0", 15) for i in range(1, 13)] + [(14, None, "en", "src0", None), (15, "", None, "src0", 0)]
    for name, schema, of in (("documents", "doc_id long, text string, lang string, source string, n_chars long", rows), ("labels", "doc_id long, quality int, toxic int", [(3, 1, 0)])):
        spark.createDataFrame(of, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(registry.ORACLES["s2_11_5_merge_duplicates"]).fetchall()
    got = [tuple(r) for r in registry.QUERIES["s2_11_5_merge_duplicates"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and any(r[1] == "superseded" for r in want)


def test_cosine_band_in_blocks(spark):
    """A hot group in many blocks, ties, nulls and vectors of other lengths against all pairs."""
    rng = random.Random(13)
    rows = []
    for i in range(160):
        v = [float(rng.randint(-2, 2)) for _ in range(4)]
        rows.append((i, rng.choice(["hot", "hot", "cold", None]), rng.choice([v, v, v, v, None, v[:3], [1.0, None, 0.0, 1.0], [0.0] * 4])))
    d = spark.createDataFrame(rows, "id long, grp string, v array<double>")

    def cosine(x, y):
        if x is None or y is None or None in x or None in y or len(x) != len(y):
            return 0.0
        size = (sum(a * a for a in x) * sum(b * b for b in y)) ** 0.5
        return round(sum(a * b for a, b in zip(x, y)) / size, 6) if size else 0.0

    every = {(g, a, b): cosine(x, y) for a, g, x in rows for b, h, y in rows if a != b and g == h and g is not None and 0.3 <= cosine(x, y) <= 0.85}
    for block in (7, 1000):
        got = {(r.grp, r.a, r.b): round(r.cosine, 6) for r in Q.cosine_band(d, "grp", 0.3, 0.85, block=block).collect()}
        assert got == {k: c for k, c in every.items() if k[1] < k[2]}
        got = [(r.grp, r.a, r.b) for r in Q.cosine_band(d, "grp", 0.3, 0.85, best=5, block=block).collect()]
        want = [k for g in ("hot", "cold") for k in sorted((k for k in every if k[0] == g and k[1] < k[2]), key=lambda k: (-every[k], k))[:5]]
        assert sorted(got) == sorted(want)
        got = {(r.grp, r.a, r.b): round(r.cosine, 6) for r in Q.cosine_band(d.where("id % 10 = 0"), "grp", 0.3, 0.85, others=d.where("id % 10 <> 0"), block=block).collect()}
        assert got == {k: c for k, c in every.items() if k[1] % 10 == 0 and k[2] % 10}
        got = [(r.grp, r.a, r.b) for r in Q.cosine_band(d.where("id % 10 = 0"), "grp", 0.3, 0.85, others=d.where("id % 10 <> 0"), best=2, each=True, block=block).collect()]
        some = [k for k in every if k[1] % 10 == 0 and k[2] % 10]
        want = [k for a in {k[1] for k in some} for k in sorted((k for k in some if k[1] == a), key=lambda k: (-every[k], k))[:2]]
        assert sorted(got) == sorted(want)
    none = d.where("id < 0")
    assert not Q.cosine_band(none, "grp", 0.3, 0.85, best=5).count() and not Q.cosine_band(d, "grp", 0.3, 0.85, others=none).count()


def test_keyset_pages_cover_all(spark):
    names = [f"n{i % 17:02d}" for i in range(40)] + [None]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string").groupBy("name").agg(F.min("id").alias("id"))
    seen, last = [], None
    while page := R.keyset_page(d, "name", last, 5).collect():
        seen += [r.name for r in page]
        last = seen[-1]
    assert seen == sorted(set(names[:-1]))


def graph(spark, pairs):
    return spark.createDataFrame([(a, b, 0.1 + (i % 7) / 10) for i, (a, b) in enumerate(pairs)], "src string, dst string, strength double")


def test_page_rank_is_one(spark, monkeypatch):
    rng = random.Random(5)
    e = graph(spark, [(f"n{rng.randrange(12)}", f"n{rng.randrange(12)}") for _ in range(30)] + [("n1", "end")])
    for seeds in (None, ["n1", "n2"]):
        here = {r.node: r.rank for r in G.page_rank(e, seeds, iterations=4).collect()}
        with monkeypatch.context() as m:
            m.setattr(G, "ONE_TASK_EDGES", 0)
            there = {r.node: r.rank for r in G.page_rank(e, seeds, iterations=4).collect()}
        assert here.keys() == there.keys() and all(abs(here[k] - there[k]) < 1e-12 for k in here)
        assert abs(sum(here.values()) - 1) < 1e-9


def test_betweenness_folds_trees(spark):
    """Trees, a cycle, repeated edges, a loop and several parts against counting all paths; a star of many leaves is one fold."""
    rng = random.Random(8)
    pairs = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}") for _ in range(14)] + [("n1", "n2"), ("n1", "n2"), ("n0", "n0"), ("x", "y"), ("y", "z"), ("z", "w"), ("z", "z2")]
    pairs += [(f"t{i}", f"t{rng.randrange(i)}" if i % 3 else f"n{i % 9}") for i in range(1, 14)] + [("t0", "n3"), ("t4", "t0"), ("t5", "n2"), ("t5", "n2")]
    near = {}
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            near.setdefault(x, []).append(y)

    def ways(s):
        d, count, level = {s: 0}, {s: 1}, [s]
        while level:
            following = {}
            for v in level:
                for w in near[v]:
                    if w not in d:
                        following[w] = following.get(w, 0) + count[v]
            d.update({w: d[level[0]] + 1 for w in following})
            count.update(following)
            level = list(following)
        return d, count

    found = {s: ways(s) for s in near}
    want = {}
    for s, (d, c) in found.items():
        for t in d:
            for v in d:
                dv, cv = found[v]
                if len({s, t, v}) == 3 and d[v] + dv[t] == d[t]:
                    want[v] = want.get(v, 0.0) + c[v] * cv[t] / c[t]
    n = len(near)
    got = {r.node: r.score for r in G.betweenness(graph(spark, pairs), 3).collect()}
    assert got.keys() == want.keys() and all(abs(got[v] - want[v] / ((n - 1) * (n - 2) / 2)) < 1e-9 for v in want)
    star = spark.range(30_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    assert [(r.node, round(r.score, 9)) for r in G.betweenness(star).collect()] == [(-1, 2.0)]


def test_distances_of_a_long_chain(spark):
    e = graph(spark, [(f"c{i}", f"c{i + 1}") for i in range(56)])
    d = {r.node: r.d for r in G.distances(e, spark.createDataFrame([("c0",)], "node string")).collect()}
    assert d == {f"c{i}": i for i in range(57)}


def test_core_numbers_by_peeling(spark):
    rng = random.Random(9)
    pairs = {(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(40)} | {(f"k{a}", f"k{b}") for a in range(6) for b in range(a)} | {("tail", "k0")}
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, left, k = {}, {n: set(s) for n, s in near.items()}, 0
    while left:
        n = min(left, key=lambda x: len(left[x]))
        k = max(k, len(left[n]))
        want[n] = k
        for m in left.pop(n):
            left[m].discard(n)
    assert {r.node: r.core for r in G.core_numbers(graph(spark, sorted(pairs))).collect()} == want
