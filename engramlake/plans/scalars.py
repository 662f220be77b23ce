"""Scalar functions as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.functions import text as X
from engramlake.functions import vectors as V
from engramlake.plans import model as M
from engramlake.plans.registry import query
from engramlake.plans.relational import NORM, QUERY, TERMS, arr, gram, rd, sim, tok, with_cosine
from engramlake.plans.relational import EMB, FIRST_VECTOR, OBS

CASED = r"list_filter(regexp_split_to_array({c}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
LOG = M.cte("verify_log")


def word_counts(df, key: str, text: str):
    """Entropy, words and vocabulary of each text by grouping its words: linear in the text."""
    w = df.select(key, F.explode(X.words(F.col(text))).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n"))
    per = w.groupBy(key).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("vocabulary"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return per.withColumn("entropy", F.log2("total") - F.col("s") / F.col("total"))


WORDS = f"""w AS (SELECT doc_id, x, count(*) AS n FROM (SELECT doc_id, unnest({CASED.format(c='text')}) AS x FROM documents) GROUP BY ALL),
 e AS (SELECT doc_id, sum(n)::BIGINT AS total, count(*) AS vocabulary, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM w GROUP BY doc_id)"""


@query("s2_8_1_query_entropy", f"WITH {WORDS.replace('doc_id', 'item_id').replace('documents', 'benchmark')} SELECT item_id, round(entropy, 6) AS entropy FROM e")
def query_entropy(spark, d):
    b = M.table(spark, d, "benchmark")
    return b.select("item_id", rd(X.entropy_bits(X.words(F.col("text")))).alias("entropy"))


@query("s2_8_2_information_density", f"WITH {WORDS} SELECT doc_id, round(CASE WHEN total <= 1 OR vocabulary <= 1 THEN 0.0 ELSE least(1.0, entropy / log2(vocabulary)) END, 6) AS density FROM e")
def density(spark, d):
    e = word_counts(M.dealt(spark, d, "documents"), "doc_id", "text")
    return e.select("doc_id", rd(X.density_from_counts(F.col("entropy"), F.col("total"), F.col("vocabulary"))).alias("density"))


NEXT = "FROM benchmark a JOIN benchmark b ON a.item_id + 1 = b.item_id"


def neighbours(spark, d):
    b = M.table(spark, d, "benchmark")
    return b.alias("a").join(b.withColumn("before", F.col("item_id") - 1).alias("b"), F.col("a.item_id") == F.col("b.before"))


@query("s2_8_3_overlap", f"SELECT a.item_id AS id, round(len(list_intersect({tok('a.text')}, {tok('b.text')}))::DOUBLE / least(len(list_distinct({tok('a.text')})), len(list_distinct({tok('b.text')}))), 6) AS overlap {NEXT}")
def overlap(spark, d):
    return neighbours(spark, d).select(F.col("a.item_id").alias("id"), rd(X.overlap_coefficient(F.col("a.text"), F.col("b.text"))).alias("overlap"))


def long(c: str) -> str:
    return f"list_distinct(list_filter({tok(c)}, lambda w: octet_length(encode(w)) > 2))"


@query("s2_8_4_jaccard", f"SELECT a.item_id AS id, round({sim(long('a.text'), long('b.text'))}, 6) AS jaccard {NEXT}")
def jaccard(spark, d):
    return neighbours(spark, d).select(F.col("a.item_id").alias("id"), rd(X.jaccard(X.long_tokens(F.col("a.text")), X.long_tokens(F.col("b.text")))).alias("jaccard"))


@query("s2_8_5_trigram_similarity", f"SELECT a.item_id AS id, round({sim(gram('a.text'), gram('b.text'))}, 6) AS similarity {NEXT}")
def trigram_similarity(spark, d):
    return neighbours(spark, d).select(F.col("a.item_id").alias("id"), rd(X.trigram_similarity(F.col("a.text"), F.col("b.text"))).alias("similarity"))


def tf(c: str, t: str) -> str:
    return f"len(list_filter({tok(c)}, lambda w: w = '{t}'))"


def rank_any(c: str, terms=TERMS) -> str:
    per = " + ".join(f"coalesce(list_sum(list_transform(range(1, {tf(c, t)} + 1), lambda j: 1.0::DOUBLE / (j * j))), 0.0)" for t in terms)
    return f"(({per}) * 0.1::DOUBLE / 1.64493::DOUBLE / {len(terms)})"


def cover(c: str, terms=TERMS) -> str:
    return "((" + " + ".join(tf(c, t) for t in terms) + ") * 0.1::DOUBLE)"


@query("s2_8_6_rank_any", f"SELECT doc_id, round({rank_any('text')}, 6) AS rank FROM documents")
def rank_any_query(spark, d):
    return M.table(spark, d, "documents").select("doc_id", rd(X.rank_any(F.col("text"), TERMS)).alias("rank"))


@query("s2_8_7_cover_density", f"SELECT doc_id, round({cover('text')}, 6) AS rank FROM documents")
def cover_density(spark, d):
    return M.table(spark, d, "documents").select("doc_id", rd(X.cover_density(F.col("text"), TERMS)).alias("rank"))


@query("s2_8_8_cosine", f"SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], {FIRST_VECTOR}), 6) AS cosine, round(1 - list_cosine_similarity(embedding::DOUBLE[], {FIRST_VECTOR}), 6) AS distance FROM embeddings")
def cosine(spark, d):
    e = M.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return with_cosine(spark, d, e).select("vec_id", rd(F.col("cosine")).alias("cosine"), rd(1 - F.col("cosine")).alias("distance"))


@query("s2_8_9_hash_embedding")
def hash_embedding(spark, d):
    return M.table(spark, d, "benchmark").select("item_id", X.hash_embedding(64)(F.col("text")).alias("v"))


@query("s2_8_10_mention_normalise", f"{M.cte('entities')} SELECT id, {NORM.format(c='name')} AS mention FROM entities")
def mention(spark, d):
    return M.entities(spark, d).select("id", X.normalize_mention(F.col("name")).alias("mention"))


@query("s2_8_11_entity_key", rf"{M.cte('entities')} SELECT id, lower(regexp_replace(name, '[^\p{{L}}\p{{N}}]+', '', 'g')) AS key FROM entities")
def entity_key(spark, d):
    return M.entities(spark, d).select("id", X.entity_key(F.col("name")).alias("key"))


TAGW = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_-]+'), lambda x: octet_length(encode(x)) > 2)"


@query("s2_8_12_tags", f"""WITH w AS (SELECT doc_id, unnest({TAGW}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM w WHERE w NOT IN {tuple(X.STOPWORDS)} GROUP BY ALL)
 SELECT doc_id, w AS tag, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS rank FROM c QUALIFY rank <= 5""")
def tags(spark, d):
    return top_tags(M.dealt(spark, d, "documents"), "doc_id", "text")


def top_tags(df, key: str, text: str, most: int = 5):
    """The most frequent words of each text that aren't stop words; ties in word order."""
    from engramlake.operators.relational import newest_per

    w = df.select(key, F.explode(F.split(F.lower(text), r"[^\p{L}\p{N}_-]+")).alias("tag")).where((F.octet_length("tag") > 2) & ~F.col("tag").isin(X.STOPWORDS))
    c = w.groupBy(key, "tag").agg(F.count(F.lit(1)).alias("n"))
    return newest_per(c, [key], [F.desc("n"), F.asc("tag")], most).select(key, "tag", F.col("rank").cast("long").alias("rank"))


@query("s2_8_13_chunks")
def chunk_rows(spark, d):
    from engramlake.sources.chunks import chunks

    return chunks(M.table(spark, d, "documents"), "doc_id", "text")


@query("s2_8_14_token_estimate", "SELECT doc_id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return M.table(spark, d, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("s2_8_15_line_of_offset", "SELECT doc_id, 1 + length(left(text, 500)) - length(replace(left(text, 500), chr(10), '')) AS line FROM documents")
def line_of_offset(spark, d):
    return M.table(spark, d, "documents").select("doc_id", X.line_of_offset(F.col("text"), F.lit(500)).cast("long").alias("line"))


@query("s2_8_16_entropy_weights", f"WITH {WORDS}, l AS (SELECT doc_id, 1 / (1 + exp(-2.0 * (entropy - 2.75))) AS t FROM e) SELECT doc_id, round(0.7 - 0.4 * t, 6) AS text_weight, round(0.3 + 0.4 * t, 6) AS vector_weight FROM l")
def entropy_weights(spark, d):
    e = word_counts(M.table(spark, d, "documents"), "doc_id", "text")
    t, v = S.entropy_weights(F.col("entropy"))
    return e.select("doc_id", rd(t).alias("text_weight"), rd(v).alias("vector_weight"))


@query("s2_8_17_rrf_score", f"{OBS} SELECT entity, id, round(0.7 / (60 + row_number() OVER (PARTITION BY entity ORDER BY importance DESC, id)), 8) AS score FROM observations")
def rrf_score(spark, d):
    from engramlake.plans.statistics import fusion_rank

    return fusion_rank(spark, d).select("entity", "id", rd(S.rrf(F.col("rank") - 1, 0.7), 8).alias("score"))


PRIOR = """CASE kind WHEN 'decision' THEN 0.8 WHEN 'lesson' THEN 0.75 WHEN 'error' THEN 0.7 WHEN 'solution' THEN 0.7 WHEN 'fact' THEN least(0.9, greatest(0.1, density * 0.6)) WHEN 'preference' THEN least(0.9, greatest(0.1, density * 0.6))
 WHEN 'context' THEN least(0.7, greatest(0.1, density * 0.4)) WHEN 'tool_usage' THEN least(0.7, greatest(0.1, density * 0.4)) ELSE least(0.8, greatest(0.1, density)) END"""


@query("s2_8_18_importance_prior", f"{OBS}, {WORDS}, x AS (SELECT o.id, kind, CASE WHEN total <= 1 OR vocabulary <= 1 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, entropy / log2(vocabulary)) END AS density FROM observations o JOIN e ON o.id = e.doc_id) SELECT id, round({PRIOR}, 6) AS prior FROM x")
def prior(spark, d):
    e = word_counts(M.table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("doc_id", "id")
    dens = X.density_from_counts(F.col("entropy"), F.col("total"), F.col("vocabulary"))
    return M.observations(spark, d).select("id", "kind").join(e, "id").select("id", rd(S.importance_prior(F.col("kind"), dens)).alias("prior"))


LEVEL = "CASE WHEN {c} > 0.7 THEN 'verified' WHEN {c} > 0.5 THEN 'partial' WHEN {c} > 0.3 THEN 'weak' ELSE 'unknown' END"


@query("s2_8_19_grounding", f"""{OBS}, g AS (SELECT entity, max(importance) AS m, avg(importance) AS a, count(*) AS n, count(DISTINCT origin) AS s FROM observations GROUP BY entity),
 c AS (SELECT entity, round(least(1.0, 0.45 * m + 0.25 * a + 0.20 * least(1.0, 1 - exp(-0.3 * n)) + 0.10 * s / greatest(n, 1)), 6) AS confidence FROM g) SELECT entity, confidence, {LEVEL.format(c='confidence')} AS level FROM c""")
def grounding(spark, d):
    g = M.observations(spark, d).groupBy("entity").agg(F.max("importance").alias("m"), F.avg("importance").alias("a"), F.count(F.lit(1)).alias("n"), F.countDistinct("origin").alias("s"))
    c = g.select("entity", rd(S.grounding(F.col("m"), F.col("a"), F.col("n"), F.col("s"))).alias("confidence"))
    return c.withColumn("level", S.grounding_level(F.col("confidence")))


@query("s2_8_20_judged_grounding", f"""{LOG}, g AS (SELECT entity, sum(CASE WHEN correct = 1 THEN confidence * 0.5 ELSE 0 END) AS s, sum(CASE WHEN correct = 0 THEN confidence * 0.5 ELSE 0 END) AS c FROM verify_log GROUP BY entity),
 x AS (SELECT entity, s, c, CASE WHEN s + c <= 2.220446049250313e-16 THEN 0.0 WHEN c > s THEN s / (s + c) ELSE s / (s + c) * (1 - exp(-2.0 * s)) END AS k FROM g)
 SELECT entity, round(k, 6) AS confidence, CASE WHEN s + c <= 2.220446049250313e-16 THEN 'unknown' WHEN c > s THEN 'contradicted' ELSE {LEVEL.format(c='k')} END AS level FROM x""")
def judged(spark, d):
    w = F.col("confidence") * 0.5
    g = M.verify_log(spark, d).groupBy("entity").agg(F.sum(F.when(F.col("correct") == 1, w).otherwise(0.0)).alias("s"), F.sum(F.when(F.col("correct") == 0, w).otherwise(0.0)).alias("c"))
    c, level = S.judged_grounding(F.col("s"), F.col("c"))
    return g.select("entity", rd(c).alias("confidence"), level.alias("level"))


PROBS = "p AS (SELECT doc_id AS id, ((doc_id * 7) % 101) / 100.0::DOUBLE AS e, ((doc_id * 13) % 101) / 100.0::DOUBLE AS n, ((doc_id * 29) % 101) / 100.0::DOUBLE AS c FROM documents)"


@query("s2_8_21_nli_decision", f"WITH {PROBS} SELECT id, CASE WHEN e >= 0.80 AND e > c THEN 'supports' WHEN c >= 0.60 AND c > e THEN 'contradicts' ELSE 'neutral' END AS verdict FROM p")
def nli(spark, d):
    i = F.col("doc_id")
    p = [((i * k) % 101) / 100.0 for k in (7, 13, 29)]
    return M.table(spark, d, "documents").select(i.alias("id"), S.nli_decision(*p).alias("verdict"))


@query("s2_8_22_gate", f"{OBS} SELECT id, CASE WHEN importance >= 0.92 THEN 'reinforce' WHEN importance >= 0.75 THEN 'update' ELSE 'create' END AS gate FROM observations")
def gate(spark, d):
    return M.observations(spark, d).select("id", S.gate(F.col("importance")).alias("gate"))


@query("s2_8_23_contradiction_score", f"{LOG} SELECT id, round(least(1.0, greatest(0.0, confidence * CASE WHEN correct = 0 THEN 1.5 ELSE 0.7 END)), 6) AS score FROM verify_log")
def contradiction(spark, d):
    return M.verify_log(spark, d).select("id", rd(S.contradiction(F.col("confidence"), F.col("correct") == 0)).alias("score"))


@query("s2_8_24_npmi", "WITH t AS (SELECT vec_id AS id, 2 + vec_id % 9 AS ab, 12 + vec_id % 31 AS a, 11 + vec_id % 17 AS b FROM embeddings) SELECT id, round(ln((ab / 100) / ((a / 100) * (b / 100))) / -ln(ab / 100), 6) AS npmi FROM t")
def npmi(spark, d):
    i = F.col("vec_id")
    return M.table(spark, d, "embeddings").select(i.alias("id"), rd(S.npmi(2 + i % 9, 12 + i % 31, 11 + i % 17, F.lit(100))).alias("npmi"))


@query("s2_8_25_adamic_adar_term", f"{M.cte('procedures')} SELECT id, round(1 / ln(2 + success), 6) AS term, round(least(1.0, greatest(0.01, success / (success + 1.0))), 6) AS strength FROM procedures")
def adamic(spark, d):
    s = F.col("success")
    return M.procedures(spark, d).select("id", rd(S.adamic_adar(s)).alias("term"), rd(S.saturate(s)).alias("strength"))


@query("s2_8_26_path_score", "SELECT vec_id AS id, round(list_aggregate(list_transform(embedding[1:3], lambda x: least(1.0::DOUBLE, greatest(0.01::DOUBLE, abs(x::DOUBLE)))), 'product') / 4, 10) AS score FROM embeddings")
def path_score(spark, d):
    s = F.transform(F.slice("embedding", 1, 3), lambda x: F.abs(x.cast("double")))
    return M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.round(S.path_score(s), 10).alias("score"))


@query("s2_8_27_version_pick", f"{OBS} SELECT id, CASE WHEN (access_count > id % 11) OR (access_count = id % 11 AND origin >= lang) THEN 'local' ELSE 'incoming' END AS winner, access_count = id % 11 AND origin <> lang AS concurrent FROM observations")
def version_pick(spark, d):
    a = (F.col("access_count"), F.col("origin"), F.col("id") % 11, F.col("lang"))
    return M.observations(spark, d).select("id", S.newer(*a).alias("winner"), S.concurrent(*a).alias("concurrent"))


@query("s2_8_28_patch_once", "SELECT doc_id, sha256(CASE WHEN len(string_split(text, 'ouble')) = 2 THEN replace(text, 'ouble', 'DOUBLE') ELSE text END) AS digest FROM documents")
def patch(spark, d):
    return M.table(spark, d, "documents").select("doc_id", F.sha2(X.patch_once(F.col("text"), "ouble", "DOUBLE"), 256).alias("digest"))


@query("s2_8_29_memory_op", f"{LOG} SELECT id, CASE WHEN confidence < 0.5 THEN 'noop' WHEN level IN ('verified') THEN 'update' WHEN level IN ('partial') THEN 'add' ELSE 'noop' END AS op FROM verify_log")
def memory_op(spark, d):
    verdict = F.when(F.col("level") == "verified", "supersedes").when(F.col("level") == "partial", "unrelated").otherwise("unknown")
    return M.verify_log(spark, d).select("id", S.memory_op(verdict, F.col("confidence"), 0.5).alias("op"))


@query("s2_8_30_slug", "SELECT p_partkey, CASE WHEN s = '' THEN 'procedimiento' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(lower(regexp_replace(p_name || ' / ' || p_type, '[^A-Za-z0-9]+', '-', 'g')), '^-+|-+$', '', 'g') AS s FROM part)")
def slugs(spark, d):
    return M.table(spark, d, "part").select("p_partkey", X.slug(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("s2_8_31_builtins", f"""{OBS} SELECT id, coalesce(project, 'none') AS project, nullif(kind, 'fact') AS kind, greatest(importance, 0.5) AS hi, least(importance, 0.5) AS lo, round(sqrt(importance) + power(importance, 2) + exp(importance) + ln(importance + 1), 6) AS math,
 epoch(created_at)::BIGINT AS epoch, left(entity, 3) AS head, length(content) AS chars, position('the' IN lower(content)) AS place FROM observations""")
def builtins(spark, d):
    i = F.col("importance")
    return M.observations(spark, d).select(
        "id", F.coalesce("project", F.lit("none")).alias("project"), F.nullif(F.col("kind"), F.lit("fact")).alias("kind"), F.greatest(i, F.lit(0.5)).alias("hi"), F.least(i, F.lit(0.5)).alias("lo"),
        rd(F.sqrt(i) + F.pow(i, F.lit(2)) + F.exp(i) + F.log(i + 1)).alias("math"), F.col("created_at").cast("timestamp").cast("long").alias("epoch"), F.left(F.col("entity"), F.lit(3)).alias("head"),
        F.length("content").cast("long").alias("chars"), F.instr(F.lower("content"), "the").cast("long").alias("place"))
