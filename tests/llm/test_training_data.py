"""Operators against brute force, and their defined results for odd input."""

import random

import pytest

from engramlake.llm import decontaminate, lang_id, line_dedup, lm, packing, phrases, sharding, simhash, topk, url_filter

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "Été", "größe"]


def text(rng, n):
    return " ".join(rng.choice(WORDS) + ("\n" if rng.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out = []
    for i in range(60):
        if i % 4 == 3:
            words = out[rng.randrange(len(out))][1].split(" ")
            if len(words) > 5:
                words[rng.randrange(len(words))] = "changed"
            out.append((i, " ".join(words)))
        elif i % 7 == 6:
            out.append((i, text(rng, 10) + " " + " ".join(out[0][1].split()[:30]) + " " + text(rng, 10)))
        else:
            out.append((i, text(rng, rng.choice([0, 1, 3, 12, 40, 200]))))
    out.append((60, None))
    out.append((61, ""))
    out.append((62, "  \n \t "))
    out.append((63, "x " * 20000))
    return out


SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Extra columns whose names clash with results, a repeated row and a null id."""
    more = [(i, t, 1.5, "kept", 3, "x", True) for i, t in [*rows, rows[5], (None, rows[63][1])]]
    return spark.createDataFrame(more, "doc_id long, text string, score double, kept string, n_words int, block string, train boolean")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_lm_matches_brute_force(docs, rows):
    from pyspark.sql import functions as F

    from engramlake.llm.common import in_fold

    got = sorted(map(tuple, lm.score_texts(docs.withColumn("train", ~in_fold(F.col("doc_id"), 7, 2))).collect()))
    want = sorted(lm.brute_force(rows))
    assert [(g[0], not g[1], *g[2:5]) for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert abs(g[6] - w[6]) <= g[2] * 1.01 / lm.CODES_PER_DECADE


def test_lm_odd_input(odd, empty):
    from pyspark.sql import functions as F

    got = lm.score_texts(odd).collect()
    assert len(got) == odd.count() and all(r.n_tokens >= 1 for r in got)
    assert lm.score_texts(empty.withColumn("train", F.lit(True))).count() == 0
    nothing = lm.score_texts(odd.withColumn("train", F.lit(False))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)


def test_elias_fano_successor():
    import numpy as np

    rng = np.random.default_rng(3)
    for top, n in ((10, 5), (1000, 400), (1 << 40, 300), (50, 200)):
        v = np.sort(rng.integers(0, top, n))
        s = lm.EliasFano.of(v)
        assert (s[np.arange(n)] == v).all()
        q = rng.integers(0, top + 5, 500)
        assert (s.successor(q) == np.searchsorted(v, q, "left")).all()


def test_trie_round_trip(tmp_path):
    import numpy as np

    rng = np.random.default_rng(4)
    keys = sorted({(int(a), int(b)) for a, b in zip(rng.integers(0, 40, 500), rng.integers(0, 90, 500))})
    ctx, word = np.array([k[0] for k in keys]), np.array([k[1] for k in keys])
    code = rng.integers(0, 255, len(keys)).astype(np.uint8)
    trie = lm.Trie.build(ctx, word, code, np.arange(len(set(ctx)), dtype=np.uint8))
    path = tmp_path / "trie"
    path.write_bytes(trie.to_bytes())
    mapped = lm.Trie.open(str(path))
    found, got, _ = mapped.lookup(ctx, word)
    assert found.all() and (got == code).all()
    a, b = np.repeat(np.arange(45), 95), np.tile(np.arange(95), 45)
    found, _, _ = mapped.lookup(a, b)
    assert found.tolist() == [(x, y) in set(keys) for x, y in zip(a.tolist(), b.tolist())]


def test_phrases_match_brute_force(docs, rows):
    from pyspark.sql import functions as F

    got = phrases.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    want = phrases.brute_force(rows)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(w[2] for w in want)


def test_phrases_odd_input(odd, empty):
    got = phrases.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    last = [r for r in got if r.doc_id is None][0]
    assert last.n_removed == last.n_words  # a null id is the largest
    assert phrases.remove_repeats(empty).count() == 0


def test_urls(spark):
    rules = url_filter.RULES
    urls = ["http://a.example.net/en/x", "http://example.net/de/", "https://EXAMPLE.com/de/1?q#f", "http://x.org/fr/", "http://net", "http://net/", "nothing", None, "",
            "http://fr.org/fr", "http://example.net/en/?a=/x", "s://a.net#/en/", "http://" + "a." * 5000 + "net/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' AS host", "1 AS rule")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, rules).collect()}
    want = ["allow", "block", "block", "allow", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert [got[i][3] for i in range(len(urls))] == want
    assert got[0][:3] == ("a.example.net", "/en/x", "example.net/en/") and got[4][:2] == ("net", "") and got[7][:2] == ("", "")
    joined = {r.page_id: tuple(r)[1:] for r in url_filter.judge_by_join(pages, rules, "page_id", "url", "allow").collect()}
    assert joined == got
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_url_trie_join_and_rule_text_agree(spark):
    rng = random.Random(21)

    def some_host():
        return ".".join(rng.choice(["a", "b", "net", "Org", "", "é"]) for _ in range(rng.randrange(1, 5)))

    def some_path():
        return "/" + "".join(rng.choice("/ab") for _ in range(rng.randrange(5)))

    rules = [(rng.choice(["allow", "block"]), some_host(), some_path()) for _ in range(150)] + [("block", "", "/zz"), ("allow", "net", ""), ("block", "NET", "")]
    urls = [f"http://{some_host()}{some_path()}" for _ in range(1200)] + ["http://example.net./x", "http://.net/", "http://net./", "http://", "://", None, "http://q/zzz"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = url_filter.checked(rules)

    def judge(url):
        host, path = url_filter.split_url(url)
        fit = [(len(h), len(p), h + p, v) for v, h, p in listed if (not h or host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *max(fit)[2:]) if fit else (host, path, None, "allow")

    want = {i: judge(u) for i, u in enumerate(urls)}
    assert {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, rules).collect()} == want
    assert {r.page_id: tuple(r)[1:] for r in url_filter.judge_by_join(pages, rules, "page_id", "url", "allow").collect()} == want
    assert url_filter.UrlTrie(url_filter.RULES).match("example.net.", "/x") is None
    assert sum(v[2] is not None for v in want.values()) > 200


def test_simhash_matches_brute_force(docs, rows):
    from pyspark.sql import functions as F

    got = simhash.near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert sorted(map(tuple, got.collect())) == sorted(simhash.brute_force(rows))


def test_covering_loses_no_pair():
    import numpy as np

    rng = np.random.default_rng(5)
    for blocks, threshold in ((3, 4), (4, 7)):
        x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
        y = x.copy()
        for i in range(len(y)):
            for b in rng.choice(64, rng.integers(0, threshold + 1), replace=False):
                y[i] ^= np.uint64(1) << np.uint64(b)
        met = np.zeros(len(x), bool)
        for code in simhash.covering(threshold, blocks):
            home = code.decode(code.bits(x))
            who, anchor, _ = code.anchors(y)
            met[who[anchor == home[who]]] = True
        assert met.all()


def test_near_duplicate_stage(spark):
    rng = random.Random(11)
    base = [" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(250)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t) for i, t in enumerate(base[:10])]  # exact copies
    rows += [(200 + i, " ".join([*t.split()[:100], "edited", *t.split()[101:]])) for i, t in enumerate(base[10:20])]  # one word in 250
    rows += [(300, None), (301, ""), (None, base[0])]
    from engramlake.llm.common import materialize

    stored = materialize(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS fp", "2 AS node"), "test")
    kept = simhash.drop_near_duplicates(stored)
    assert kept.columns == ["doc_id", "text", "fp", "node"]
    assert sorted(r.doc_id for r in kept.collect()) == [*range(40), 300]
    assert simhash.drop_near_duplicates(materialize(stored.limit(0), "test")).count() == 0


def test_near_duplicate_stage_links_exactly_the_similar(spark):
    from engramlake.llm.common import materialize

    rng = random.Random(12)
    rows, hot = [], " ".join(f"hot{i}" for i in range(40))
    for i in range(240):
        words = [f"z{int(rng.paretovariate(0.7))}" if rng.random() < 0.3 else f"u{rng.randrange(5000)}" for _ in range(rng.choice([60, 200, 700]))]
        if i % 9 == 0:
            words = hot.split() + words  # an opening that many share
        share = rng.uniform(0.72, 0.98)
        n = int(len(words) * share)
        other = [words[:n], words + [f"v{rng.randrange(5000)}" for _ in range(len(words) - n)], words[: n // 2] + words[n // 2 + len(words) - n :],
                 words[len(words) - n :]][i % 4]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    rows += [(1000 + i, " ".join([*rows[4][1].split()[:i], "x", *rows[4][1].split()[i + 1 :]])) for i in range(30)]  # a large group
    rows += [(2000, "one two"), (2001, "one two"), (2002, "one two three"), (2003, "A b c d e"), (2004, "a b C d e")]

    grams = {d: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})(t.lower().split()) for d, t in rows}
    group, ids = {d: d for d in grams}, sorted(grams)
    pairs = [(a, b) for a in ids for b in ids if a < b and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8]
    assert len(pairs) > 100
    for _ in ids:
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if before == group:
            break
    stored = materialize(spark.createDataFrame(rows, SCHEMA).repartition(4), "test")
    kept = simhash.drop_near_duplicates(stored)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(group.values()))


def test_near_duplicate_candidates_grow_with_the_rows(spark):
    """Unrelated sets don't meet, however many they are; pairs just at the similarity do, and a shared key gives stars."""
    import numpy as np

    rng = np.random.default_rng(14)
    count = simhash.bands()

    def keys(h):
        return simhash.band_keys(np.unique(h), count)

    met = 0
    for n in (9, 45, 90, 450) * 100:
        h = rng.integers(0, 1 << 63, n * 10 // 9, dtype=np.uint64)
        met += bool((keys(h[:n]) == keys(h[len(h) - n :])).any())  # 8 of 10, in each size
    assert met >= 390
    alone = [(i, keys(rng.integers(0, 1 << 63, 60, dtype=np.uint64)).tolist()) for i in range(4000)]
    d = spark.createDataFrame(alone, "node long, keys array<long>").repartition(5)
    assert simhash.band_links(d, 3).count() == 0
    hot = spark.createDataFrame([(i, [7, 100 + i // 2]) for i in range(500)], "node long, keys array<long>").repartition(5)
    links = {(r.a, r.b) for r in simhash.band_links(hot, 3).collect()}
    assert len(links) <= 1500 and {a for a, _ in links} == set(range(1, 500)) and all(a > b for a, b in links)


def test_near_duplicate_stage_survives_another_dealing_of_files(spark):
    from engramlake.llm.common import materialize

    rng = random.Random(13)
    texts = [text(rng, 30) for _ in range(40)]
    stored = materialize(spark.createDataFrame([(i, texts[i % 40]) for i in range(80)], SCHEMA).repartition(8), "test")
    kept = simhash.drop_near_duplicates(stored)
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_simhash_odd_input(odd, empty):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count() and all(r.component_id is not None for r in got)
    zero = {r.component_id for r in got if r.fp == 0}
    assert zero == {min(r.doc_id for r in got if r.fp == 0)}
    assert simhash.near_duplicates(empty).count() == 0


def test_topk(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randrange(-3, 4)) / 2 for _ in range(20)]) for i in range(130)] + [
        (150, None), (200, [1.0, None] + [0.0] * 18), (250, [float("nan")] * 20), (300, [float("inf")] * 20), (None, [1.0] * 20), (350, [1.0, 2.0]), (351, [2.0, 2.0]), (400, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS rank", "'x' AS score").repartition(3)
    ok = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and x == x and abs(x) != float("inf") for x in v)]
    import math

    want = []
    for q, v in ok:
        if q % 50 == 0:
            s = sorted((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(v, w)), c) for c, w in ok if c != q and len(w) == len(v))
            want += [(q, k + 1, c, -x) for k, (x, c) in enumerate(s[:5])]
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_prunes_without_loss():
    import numpy as np

    rng = np.random.default_rng(1)
    for decay, most in ((0.9, 0.5), (1.0, 0.99)):
        c = np.floor(256 * rng.normal(size=(64, 3000)) * decay ** np.arange(64)[::-1, None]).astype(np.int64)
        q = np.ascontiguousarray(c[:, :40].T) + 1
        search = topk.Search(q, 5)
        found = [[], []]
        for part, at in enumerate((0, 1500)):  # k-th scores are carried from block to block
            own = np.where((np.arange(40) >= at) & (np.arange(40) < at + 1500), np.arange(40) - at, -1)
            found[part] = search.block(np.ascontiguousarray(c[:, at : at + 1500]), own)
        assert search.work["done"] < most * search.work["all"]
        whole = q @ c
        for i in range(40):
            want = sorted(np.delete(whole[i], i))[-5:]
            got = sorted(int(x) for part in found for x in part[i][1])[-5:]
            assert [int(x) for x in want] == got


def test_topk_prunes_the_fixture(small):
    import numpy as np
    import pyarrow.parquet as pq

    t = pq.read_table(f"{small}/embeddings.parquet")
    m = np.floor(256 * np.array(t["embedding"].to_pylist(), np.float64)).astype(np.int64)
    at = np.flatnonzero(np.array(t["vec_id"]) % 50 == 0)
    search = topk.Search(m[at], 5)
    found = search.block(np.ascontiguousarray(m.T), at)
    print("products done:", search.work["done"] / search.work["all"])
    assert search.work["done"] < search.work["all"]
    for i, row in enumerate(at):
        whole = m @ m[row]
        assert sorted(int(x) for x in found[i][1])[-5:] == sorted(int(x) for x in np.delete(whole, row))[-5:]


def test_line_dedup_matches_brute_force(docs, rows):
    got = line_dedup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(line_dedup.brute_force(rows), key=str)


def test_line_dedup_runs(spark):
    long = "a line that is long enough to count as a run of its own"
    short = ["one", "two", "three", "four five six seven eight nine ten"]
    rows = [(1, "\n".join([long, "x", *short])), (2, "\n".join(["intro", *short, "outro"])), (3, long), (4, "\n".join([long, "", long])), (5, "\n".join(short[:2]))]
    got = {r.doc_id: (r.n_removed, r.text) for r in line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {d: (n, t) for d, _, n, t in line_dedup.brute_force(rows)}
    assert got == want
    assert got[1][0] == 0 and got[2][1] == "intro\noutro" and got[3] == (1, "") and got[5][0] == 0


def test_line_dedup_repeated_rows(spark):
    """A document given several times is one document, and takes no longer."""
    doc = "\n".join(f"l{i % 7}" for i in range(60))
    other = "\n".join(["x", *(f"l{i % 7}" for i in range(3, 40)), "y"])
    want = {d: (n, t) for d, _, n, t in line_dedup.brute_force([(1, doc), (2, other)])}
    for times in (1, 2, 5):
        got = line_dedup.drop_repeated_lines(spark.createDataFrame([(1, doc)] * times + [(2, other)], SCHEMA)).collect()
        assert len(got) == times + 1
        assert all((r.n_removed, r.text) == want[r.doc_id] for r in got)


def test_line_dedup_chunks_agree(spark, monkeypatch):
    """Small chunks of the suffix array, ties and long repeated runs."""
    rng = random.Random(31)
    monkeypatch.setattr(line_dedup, "CHUNK_ROWS", 7)
    block = [f"line {rng.randrange(6)}" for _ in range(90)]
    rows = []
    for i in range(30):
        a, b = sorted((rng.randrange(90), rng.randrange(90)))
        own = [*(f"u{rng.randrange(4)}" for _ in range(rng.randrange(3))), *block[a:b], f"own {i}", *(["same"] * rng.randrange(30))]
        rows.append((i, "\n".join(own)))
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "n_lines", "n_removed", "text")
    want = line_dedup.brute_force(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(w[2] for w in want) > 300


def test_previous_runs_match_all_pairs():
    rng = random.Random(32)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 12))] for _ in range(rng.randrange(1, 6))]
        suffixes = sorted((t[i:], (d, 0, i)) for d, t in enumerate(texts) for i in range(len(t)))

        def lcp(a, b):
            return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

        common = [0] + [lcp(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
        places = [p for _, p in suffixes]
        want = [max((lcp(s, t) for t, q in suffixes if q < p), default=0) for s, p in suffixes]
        assert line_dedup.previous_runs(places, common, [], []) == want
        cut = rng.randrange(len(places) + 1)
        back, low = [], 1 << 62
        for p, c in zip(reversed(places[:cut]), reversed(common[:cut])):
            back.append((low, p))
            low = min(low, c)
        ahead, low = [], 1 << 62
        for p, c in zip(places[cut:], common[cut:]):
            low = min(low, c)
            ahead.append((low, p))
        assert line_dedup.previous_runs(places[:cut], common[:cut], [], line_dedup.stairs(ahead)) + line_dedup.previous_runs(
            places[cut:], common[cut:], line_dedup.stairs(back), []) == want


def test_line_dedup_odd_input(odd, empty):
    extra = odd.withColumnRenamed("score", "n_lines")
    got = line_dedup.drop_repeated_lines(extra).collect()
    assert len(got) == odd.count()
    assert line_dedup.drop_repeated_lines(empty).count() == 0


def test_packing(docs, rows, spark):
    check_packing(packing.pack_documents(docs).collect(), rows)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def check_packing(got, rows):
    import zlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for d, t in rows}
    seen = {}
    for r in got:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and zlib.crc32(np.array(own, "<u4").tobytes()) == r.ids_crc32
        seen.setdefault(r.doc_id, []).append(r)
    for d, full in ids.items():
        parts = sorted(seen[d], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert sum(p.length for p in parts) == len(full) and all(p.length == 2048 for p in parts[1:])
        assert len(parts) == 1 or len(full) > 2048
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(by) <= -(-total // 2048) + 1


def test_bin_completion_beats_or_meets_best_fit():
    rng = random.Random(9)
    for capacity in (50, 200):
        for _ in range(6):
            items = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(5, 60))]
            hist = {x: items.count(x) for x in items}
            plan = packing.complete_bins(hist, capacity)
            used = {}
            for filling, times in plan:
                assert sum(x * k for x, k in filling) <= capacity
                for x, k in filling:
                    used[x] = used.get(x, 0) + k * times
            assert used == hist
            bins = []
            for x in sorted(items, reverse=True):
                fit = [b for b in bins if b >= x]
                if fit:
                    bins.remove(min(fit))
                    bins.append(min(fit) - x)
                else:
                    bins.append(capacity - x)
            assert sum(t for _, t in plan) <= len(bins)
    assert packing.complete_bins({}, 10) == []


def test_bin_completion_takes_thousands_of_tiny_pieces():
    rng = random.Random(10)
    for hist in ({1: 642}, {1: 5000}, {2: 9000}, {1: 3000, 2: 3000, 3: 3000}, {1: 4000, 2000: 3, 1500: 2, 700: 5},
                 {1: 2500, 2: 800, **{rng.randrange(4, 600): rng.randrange(1, 30) for _ in range(200)}}):
        used, bins = {}, 0
        for filling, times in packing.complete_bins(hist):
            assert sum(x * k for x, k in filling) <= packing.CAPACITY
            bins += times
            for x, k in filling:
                used[x] = used.get(x, 0) + k * times
        assert used == hist
        assert bins <= -(-sum(x * n for x, n in hist.items()) // packing.CAPACITY) + 1


def test_packing_many_empty_texts(spark):
    rows = [(i, None if i % 2 else "") for i in range(3000)] + [(5000 + i, "ok") for i in range(500)] + [(9000, "w1 " * 900)]
    check_packing(packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect(), rows)


def test_tokenizers_agree(small):
    import pyarrow.parquet as pq
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(packing.vocabulary_path())
    texts = pq.read_table(f"{small}/documents.parquet")["text"].to_pylist() + ["a\u00a0b  c\t\td", "日本語 emoji 😀 ñ", "1234 5'll x_y", "", " "]
    texts += ["a<|endoftext|>b", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "<|endoftext|", "un<|endoftext|>broken\n\n<|endoftext|>  z"]
    texts += ["a" + c * 1_000_000 + "b" for c in " \n"] + ["ab" * 500_000, "\t " * 1500 + "<|endoftext|>" + "\u3000" * 3000 + "x"]
    for t in texts:
        assert enc.ids(t) == tk.encode(t, add_special_tokens=False).ids


def test_packing_odd_texts(spark):
    rows = [(0, "a<|endoftext|>b"), (1, "a" + "\n" * 1_000_000 + "b"), (2, "ab" * 200_000), (3, "<|endoftext|>" * 5000)]
    check_packing(packing.pack_documents(spark.createDataFrame(rows, SCHEMA)).collect(), rows)


def test_bin_completion_finds_the_optimum_of_small_cases():
    rng = random.Random(14)

    def least(items, capacity):
        best = len(items)

        def go(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(items):
                best = len(bins)
                return
            for room in set(bins):
                if room >= items[i]:
                    go(i + 1, sorted([*bins[: bins.index(room)], room - items[i], *bins[bins.index(room) + 1 :]]))
            go(i + 1, [*bins, capacity - items[i]])

        go(0, [])
        return best

    for _ in range(60):
        capacity = rng.choice([10, 23, 50])
        items = sorted((rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 11))), reverse=True)
        plan = packing.complete_bins({x: items.count(x) for x in items}, capacity)
        assert sum(times for _, times in plan) == least(items, capacity)


ITEMS = [(1, "w1 w2 w3"), (2, None), (3, "..."), (4, " ".join(f"w{i}" for i in range(10, 30))), (5, "The Of"), (4, "w1 w2 w3 w4")]


def test_decontamination_matches_brute_force(spark, docs, rows):
    items = [*ITEMS, (9, " ".join((rows[0][1] or "").split()[3:40])), (10, rows[20][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id")
    want = decontaminate.brute_force(rows, items)
    got = decontaminate.digest(decontaminate.scan(docs, bench))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(w[5] for w in want)
    for limit in (10, 25, 60):
        sets = decontaminate.digest(decontaminate.scan(docs, bench, limit=limit))
        assert sorted(map(tuple, sets.collect())) == sorted(want)


def test_decontamination_odd_input(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(odd, bench, keep=tuple(odd.columns))
    assert got.count() == odd.count()
    assert decontaminate.scan(empty, bench).count() == 0
    assert decontaminate.digest(decontaminate.scan(odd, bench.limit(0))).where("contaminated").count() == 0


def test_language_id(spark, small):
    got = lang_id.op9_language_id(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 40 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


def test_language_id_query_matches_a_plain_version(spark, small):
    """The query's labels and scores from the fitted potentials by sums over all label paths in logarithms."""
    import zlib

    import numpy as np

    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = lang_id.fit(docs.where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 <> 1"))
    got = {r.doc_id: r for r in lang_id.op9_language_id(spark, small).collect()}
    assert set(got) == set(rows)
    for d in sorted(rows)[::9]:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        words = lang_id._lettered(rows[d].text)
        if not words:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        e = np.array([lang_id.emissions(model.weights, [w])[0] for w in words])
        forward, backward = [model.init + e[0]], [np.zeros(len(model.labels))]
        for x in e[1:]:
            forward.append(np.logaddexp.reduce(forward[-1][:, None] + model.trans, 0) + x)
        for x in e[:0:-1]:
            backward.append(np.logaddexp.reduce(model.trans + (x + backward[-1])[None, :], 1))
        joint = np.array(forward) + np.array(backward[::-1])
        mean = np.exp(joint - np.logaddexp.reduce(joint, 1)[:, None]).mean(0)
        assert got[d].lang_pred == model.labels[int(mean.argmax())] and abs(got[d].score - mean.max()) < 1e-6


def test_language_id_sample_is_bounded_in_characters(spark):
    docs = spark.createDataFrame([(i, "ab " * 100, "x" if i % 2 else "y") for i in range(50)] + [(99, "z" * (lang_id.SAMPLE_ROW_CHARS + 1), "z")], "doc_id long, text string, lang string")
    rows = lang_id.sample_rows(docs, "doc_id", "text", "lang", 40, 3000)
    assert len(rows) == 10 and all(lang != "z" for lang, _ in rows)
    assert len(lang_id.sample_rows(docs, "doc_id", "text", "lang", 40, 1 << 20)) == 40


def test_language_id_odd_input(spark, small, odd, empty):
    model = lang_id.fit(spark.read.parquet(f"{small}/documents.parquet"), sample=60)
    got = lang_id.predict(odd, model, keep=("kept",)).collect()
    assert len(got) == odd.count()
    assert {r.lang_pred for r in got if r.doc_id in (60, 61, 62)} == {"und"}
    assert lang_id.predict(empty, model).count() == 0
    none = lang_id.fit(empty.selectExpr("*", "cast(null AS string) AS lang"))
    assert {r.lang_pred for r in lang_id.predict(odd, none).collect()} == {"und"}


def test_language_id_code_switching(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.lang: r.text for r in docs.orderBy("doc_id").collect()}
    model = lang_id.fit(docs)
    first, second = sorted(rows)[:2]
    mixed = " ".join(rows[first].split()[:30]) + " " + " ".join(rows[second].split()[:30])
    found, size, gamma = model.label_words([mixed])
    best = [model.labels[i] for i in gamma.argmax(1)]
    half = len(best) // 2
    assert best[: half - 5].count(first) > 0.8 * (half - 5) and best[half + 5 :].count(second) > 0.8 * (half - 5)


def test_forward_backward_is_exact():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for n in (1, 3, 7):
        emit, trans, init = rng.normal(size=(n, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
        begins = np.zeros(n, bool)
        begins[0] = True
        gamma, pairs, firsts, z = lang_id.marginals(emit, begins, trans, init)
        weight = {}
        for path in itertools.product(range(3), repeat=n):
            s = init[path[0]] + sum(emit[i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:]))
            weight[path] = np.exp(s)
        total = sum(weight.values())
        want = np.zeros((n, 3))
        for path, x in weight.items():
            for i, y in enumerate(path):
                want[i, y] += x / total
        assert np.allclose(gamma, want) and np.isclose(z, np.log(total)) and np.isclose(pairs.sum(), n - 1) and np.allclose(firsts, want[0])
    emit = rng.normal(size=(300, 3))
    begins = rng.random(300) < 0.05
    begins[0] = True
    whole = lang_id.marginals(emit, begins, trans, init)[0]
    cuts = [*np.flatnonzero(begins), 300]
    for a, b in zip(cuts, cuts[1:]):
        one = np.zeros(b - a, bool)
        one[0] = True
        assert np.allclose(whole[a:b], lang_id.marginals(emit[a:b], one, trans, init)[0])


def test_sharding(spark, odd, empty):
    from collections import Counter

    owner = sharding.lookup_table(sharding.shard_names(7), 101)
    assert max(Counter(owner).values()) - min(Counter(owner).values()) <= 1
    fewer = sharding.lookup_table(sharding.shard_names(6), 101)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 30  # most slots keep their shard when one leaves
    got = sharding.assign_shards(odd).collect()
    assert len(got) == odd.count() and len({r.shard for r in got if r.doc_id == 5}) == 1
    assert sharding.assign_shards(empty).count() == 0
    for bad in ((["a", "a"], 7), (["a"], 8), ([], 7)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_pipeline_stages(spark, small):
    import corpus_pipeline
    from engramlake.llm.common import materialize

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, docs, small), f"test-{name}")
        assert docs.columns == columns and docs.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    check_packing(last, [(r.doc_id, r.text) for r in docs.collect()])
    nothing = materialize(spark.read.parquet(f"{small}/documents.parquet").limit(0), "test")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, small).count() == 0


def test_pipeline_stages_keep_columns_with_clashing_names(spark, small):
    import corpus_pipeline
    from engramlake.llm.common import materialize

    extra = ["score", "lang_pred", "n_words", "spans", "items", "d", "h", "slot", "row", "node", "n_removed", "n_lines", "c0", "key", "pos", "root", "text_", "runs"]
    docs = materialize(spark.read.parquet(f"{small}/documents.parquet").selectExpr("*", *(f"concat('{c}', doc_id) AS `{c}`" for c in extra)), "test")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, small), f"test-{name}")
        assert docs.columns == columns
    rows = docs.collect()
    assert len(rows) > 50 and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() >= len(rows)
    sharded = sharding.assign_shards(docs.select("slot", "row"), "slot")
    assert sharded.columns == ["slot", "slot", "shard"] and sharded.count() == len(rows)


def test_the_largest_id_is_no_null(spark):
    from pyspark.sql import functions as F

    t = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(2**63 - 1, t), (None, t), (1, t)], SCHEMA)
    got = {r.doc_id: r.n_removed for r in phrases.remove_repeats(docs).collect()}
    assert got == {2**63 - 1: 30, None: 30, 1: 0}
    assert {r.doc_id for r in lm.score_texts(docs.withColumn("train", F.lit(True))).collect()} == {2**63 - 1, None, 1}
