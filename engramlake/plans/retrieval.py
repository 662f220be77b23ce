"""Retrieval operators as named queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.functions import text as X
from engramlake.functions import vectors as V
from engramlake.operators import relational as R
from engramlake.operators import retrieval as Q
from engramlake.operators import stats as T
from engramlake.plans import model as M
from engramlake.plans.registry import query
from engramlake.plans.relational import EMB, FIRST_VECTOR, NEG, OBS, QUERY, TERMS, arr, gram, mentioned, rd, sim, stored_vector, tok, with_cosine
from engramlake.plans.scalars import LEVEL, cover, rank_any
from engramlake.plans.statistics import budget_prefix

K = 20
SIM = sim(gram("content"), arr(X.trigrams_of(QUERY)))
HIT = f"list_has_any({tok('content')}, {arr(TERMS)})"
LIVE = "kind <> 'superseded' AND trust = 'trusted'"


def live(spark, d, heavy=False):
    return R.trusted(R.active(M.observations(spark, d, heavy)))


def leg_sql(name: str, rel: str, score: str, where: str = "true", k: int = K) -> str:
    return f"{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT id, round({score}, 6) AS score FROM {rel} WHERE {where} ORDER BY score DESC, id LIMIT {k}))"


TEXT = f"tx AS (SELECT id, importance, {HIT} AS hit, {SIM} AS sim, {rank_any('content')} AS lex FROM observations WHERE {LIVE}), " + leg_sql("text_leg", "tx", "(lex + sim) * 0.7::DOUBLE + importance * 0.3::DOUBLE", "hit OR sim > 0.3")
COVER = leg_sql("cover_leg", "observations", cover("content"), f"{LIVE} AND {HIT}")
VEC = leg_sql("vector_leg", "embedded", f"list_cosine_similarity(v, {FIRST_VECTOR})", LIVE)


@query("s2_9_1_text_leg", f"{OBS}, {TEXT} SELECT id, rank, score FROM text_leg")
def text_leg(spark, d):
    return text(spark, d).select("id", F.col("rank").cast("long").alias("rank"), "score")


def text(spark, d):
    return Q.text_leg(live(spark, d, heavy=True), QUERY, TERMS, K)


def vector(spark, d):
    e = R.trusted(R.active(M.embedded(spark, d)))
    return Q.vector_leg(with_cosine(spark, d, e), F.col("cosine"), K)


def lexical(spark, d):
    return Q.cover_leg(live(spark, d, heavy=True), TERMS, K)


@query("s2_9_2_vector_leg", f"{EMB}, {VEC} SELECT id, rank, score FROM vector_leg")
def vector_leg(spark, d):
    return vector(spark, d).select("id", F.col("rank").cast("long").alias("rank"), "score")


@query("s2_9_3_cover_leg", f"{OBS}, {COVER} SELECT id, rank, score FROM cover_leg")
def cover_leg(spark, d):
    return lexical(spark, d).select("id", F.col("rank").cast("long").alias("rank"), "score")


TAG = leg_sql("tag_leg", "observations", "importance * 0.8 + 0.2", f"{LIVE} AND list_contains(tags, 'fr')")


@query("s2_9_4_tag_leg", f"{OBS}, {TEXT}, {TAG}, n AS (SELECT id, row_number() OVER (ORDER BY rank) AS r FROM tag_leg WHERE id NOT IN (SELECT id FROM text_leg)) SELECT id, rank FROM text_leg UNION ALL SELECT id, r + (SELECT max(rank) FROM text_leg) FROM n")
def tag_leg(spark, d):
    tagged = Q.leg(live(spark, d).where(F.array_contains("tags", "fr")), F.col("importance") * 0.8 + 0.2, K, "tag")
    return Q.append_absent(text(spark, d), tagged).select("id", F.col("rank").cast("long").alias("rank"))




@query("s2_9_5_entity_leg", f"{OBS}, n AS (SELECT DISTINCT entity FROM observations WHERE length(entity) >= 4 AND contains('what do we know of src12 and src3', entity)), {leg_sql('leg', '(SELECT * FROM observations JOIN n USING (entity))', 'importance', LIVE)} SELECT id, rank, score FROM leg")
def entity_leg(spark, d):
    o = live(spark, d)
    names = mentioned(o.select(F.col("entity").alias("name")).distinct(), "what do we know of src12 and src3", most=1000).select(F.col("name").alias("entity"))
    return Q.leg(o.join(F.broadcast(names), "entity"), F.col("importance"), K, "entity").select("id", F.col("rank").cast("long").alias("rank"), "score")


LEGS = f"{EMB}, {TEXT}, {COVER}, {VEC}"


def weights() -> tuple[float, float]:
    import math
    from collections import Counter

    n = Counter(QUERY.split())
    h = -sum(c / len(QUERY.split()) * math.log2(c / len(QUERY.split())) for c in n.values())
    t = 1 / (1 + math.exp(-2 * (h - 2.75)))
    return 0.7 - 0.4 * t, 0.3 + 0.4 * t


WT, WV = weights()
FUSED = f"""{LEGS}, fused AS (SELECT id, round(sum(s), 8) AS score FROM (SELECT id, {WT}::DOUBLE / (60 + rank) AS s FROM text_leg UNION ALL SELECT id, {WT}::DOUBLE / (60 + rank) FROM cover_leg
 UNION ALL SELECT id, {WV}::DOUBLE / (60 + rank) FROM vector_leg) GROUP BY id)"""


def fused(spark, d):
    return Q.fuse([(text(spark, d), WT), (lexical(spark, d), WT), (vector(spark, d), WV)])


@query("hybrid_search", f"{FUSED} SELECT f.id, f.score, o.entity, left(o.content, 200) AS snippet FROM fused f JOIN observations o ON f.id = o.id ORDER BY f.score DESC, f.id LIMIT 10")
def hybrid_search(spark, d):
    best = R.top(fused(spark, d), [F.desc("score"), F.asc("id")], 10)
    out = M.observations(spark, d).select("id", "entity", X.cut(F.col("content"), 200).alias("snippet")).join(F.broadcast(best), "id")
    return out.select("id", "score", "entity", "snippet").orderBy(F.desc("score"), "id")


@query("s2_9_6_weighted_rrf", f"{FUSED} SELECT id, score FROM fused")
def weighted_rrf(spark, d):
    return fused(spark, d)


@query("s2_9_7_equal_rrf", f"{LEGS} SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT id, rank FROM text_leg UNION ALL SELECT id, rank FROM vector_leg) GROUP BY id")
def equal_rrf(spark, d):
    return Q.fuse([(text(spark, d), 1.0), (vector(spark, d), 1.0)])


@query("s2_9_8_associative_expansion", f"""{FUSED}, seed AS (SELECT DISTINCT entity FROM observations JOIN fused USING (id)), near AS (SELECT o.id, o.entity, o.importance, row_number() OVER (PARTITION BY o.entity ORDER BY o.importance DESC, o.id) AS r
 FROM observations o JOIN seed USING (entity) WHERE o.{LIVE.replace('AND trust', 'AND o.trust')} AND o.id NOT IN (SELECT id FROM fused)) SELECT id, round(0.02 * importance, 8) AS score FROM near WHERE r <= 2""")
def expansion(spark, d):
    f = fused(spark, d)
    o = live(spark, d).select("id", "entity", "importance")
    seeds = M.observations(spark, d).select("id", "entity").join(F.broadcast(f), "id").select("entity").distinct()
    near = o.join(F.broadcast(seeds), "entity").join(F.broadcast(f.select("id")), "id", "left_anti")
    return R.newest_per(near, ["entity"], [F.desc("importance"), F.asc("id")], 2).select("id", F.round(0.02 * F.col("importance"), 8).alias("score"))


def listed(spark, d):
    """Per entity, the ten most important notes as a result list."""
    o = live(spark, d).select("entity", "id", F.col("importance").alias("score"), "content")
    return R.newest_per(o, ["entity"], [F.desc("score"), F.asc("id")], 10)


LISTED = f"""{OBS}, l AS MATERIALIZED (SELECT *, list_distinct({tok('content')}) AS t, row_number() OVER (PARTITION BY entity ORDER BY importance DESC, id) AS rank FROM observations WHERE {LIVE} QUALIFY rank <= 10)"""


@query("s2_9_9_greedy_dedup", f"""{LISTED}, w AS (SELECT entity, id, rank, t, []::VARCHAR[][] AS kept, false AS dup FROM l WHERE rank = 1
 UNION ALL SELECT entity, id, rank, t, kept, len(list_filter(kept, lambda k: len(list_intersect(k, t)) / greatest(least(len(k), len(t)), 1)::DOUBLE > 0.85::DOUBLE)) > 0
  FROM (SELECT l.entity, l.id, l.rank, l.t, CASE WHEN w.dup THEN w.kept ELSE list_append(w.kept, w.t) END AS kept FROM w JOIN l ON l.entity = w.entity AND l.rank = w.rank + 1))
 SELECT entity, id, rank::INT AS rank FROM w WHERE NOT dup""")
def greedy_dedup(spark, d):
    return Q.greedy_dedup(listed(spark, d), "entity").select("entity", "id", "rank")


@query("s2_9_10_rerank", f"{FUSED} SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, 'identity' AS reranker FROM fused")
def rerank(spark, d):
    ranked = fused(spark, d).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))
    return Q.rerank(ranked).select("id", "rank", "reranker")


GOALS = ["improve src1 notes", "the theonand ouble of les"]


@query("s2_9_11_session_boost", f"""{FUSED}, r AS (SELECT f.id, f.score, o.entity, list_distinct(list_filter({tok('content')}, lambda w: octet_length(encode(w)) > 1)) AS t FROM fused f JOIN observations o ON f.id = o.id),
 b AS (SELECT *, length(entity) >= 4 AND contains('improve src1 notes', entity) AS named, len(list_intersect(t, ['improve', 'src1', 'notes'])) / 3 AS a, len(list_intersect(t, ['the', 'theonand', 'ouble', 'of', 'les'])) / 5 AS c FROM r)
 SELECT id, round(score * CASE WHEN named THEN 1.3 WHEN a > 0 THEN 1 + 0.3 * a ELSE 1 + 0.3 * c END, 8) AS boosted FROM b""")
def boost(spark, d):
    goals = spark.range(1).select(F.posexplode(X.text_array(GOALS)).alias("place", "goal"))
    r = M.observations(spark, d).select("id", "entity", "content").join(F.broadcast(fused(spark, d)), "id")
    return Q.session_boost(r, goals).select("id", F.round("boosted", 8).alias("boosted"))


@query("s2_9_12_mmr", f"""{LISTED}, f AS (SELECT entity, id, rank, importance, list_filter(t, lambda x: octet_length(encode(x)) > 2) AS t FROM l),
 j AS MATERIALIZED (SELECT a.entity, a.id, a.rank, any_value(a.importance) AS score, list(CASE WHEN len(a.t) + len(b.t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))::DOUBLE END ORDER BY b.rank) AS near FROM f a JOIN f b ON a.entity = b.entity GROUP BY a.entity, a.id, a.rank),
 w AS (SELECT entity, NULL::BIGINT AS id, 0 AS place, list(rank ORDER BY rank) AS rest, []::BIGINT[] AS picked FROM f GROUP BY entity
  UNION ALL SELECT entity, id, place + 1, CASE WHEN i = len(rest) THEN rest[:-2] ELSE list_transform(rest[:-2], lambda r: CASE WHEN r = rank THEN rest[-1] ELSE r END) END, list_append(picked, rank)
  FROM (SELECT w.entity, j.id, w.place, w.rest, w.picked, j.rank, list_position(w.rest, j.rank) AS i, 0.7::DOUBLE * j.score - (1 - 0.7::DOUBLE) * coalesce(list_max(list_transform(w.picked, lambda p: j.near[p])), 0.0::DOUBLE) AS gain
   FROM w JOIN j ON j.entity = w.entity AND list_contains(w.rest, j.rank) WHERE w.place < 5 QUALIFY row_number() OVER (PARTITION BY w.entity ORDER BY gain DESC, i) = 1))
 SELECT entity, id, place FROM w WHERE place > 0""")
def mmr(spark, d):
    return Q.diversify(listed(spark, d), "entity", 5)


@query("s2_9_13_graph_context", f"""{M.cte('observations', 'supplies')}, t AS (SELECT src FROM supplies GROUP BY src ORDER BY sum(strength) DESC, src LIMIT 3)
 SELECT s.src, s.dst, row_number() OVER (PARTITION BY s.src ORDER BY strength DESC, dst) AS rank FROM supplies s JOIN t ON s.src = t.src QUALIFY rank <= 5""")
def graph_context(spark, d):
    s = M.supplies(spark, d)
    lead = R.top(s.groupBy("src").agg(F.sum("strength").alias("w")), [F.desc("w"), F.asc("src")], 3).select("src")
    return R.newest_per(s.join(F.broadcast(lead), "src"), ["src"], [F.desc("strength"), F.asc("dst")], 5).select("src", "dst", F.col("rank").cast("long").alias("rank"))


@query("s2_9_15_access_tracking", f"{FUSED} SELECT o.id, CASE WHEN f.id IS NULL THEN access_count ELSE access_count + 1 END AS access_count, CASE WHEN f.id IS NULL THEN last_accessed ELSE TIMESTAMP '{M.NOW}' END AS last_accessed FROM observations o LEFT JOIN fused f ON o.id = f.id")
def access(spark, d):
    hit = fused(spark, d).select("id", F.lit(True).alias("hit"))
    o = M.observations(spark, d).join(F.broadcast(hit), "id", "left")
    h = F.col("hit").isNotNull()
    return o.select("id", F.when(h, F.col("access_count") + 1).otherwise(F.col("access_count")).alias("access_count"), F.when(h, M.now().cast("timestamp_ntz")).otherwise(F.col("last_accessed").cast("timestamp_ntz")).alias("last_accessed"))


@query("s2_9_16_evidence_annotation", f"{M.cte('observations', 'verify_log')} SELECT o.id, coalesce(v.level, 'asserted') AS evidence FROM observations o LEFT JOIN verify_log v ON o.id = v.id AND v.level <> 'unknown'")
def evidence(spark, d):
    v = M.verify_log(spark, d).where("level <> 'unknown'").select("id", "level")
    return M.observations(spark, d).select("id").join(v, "id", "left").select("id", F.coalesce("level", F.lit("asserted")).alias("evidence"))


@query("s2_9_17_fresh_since", f"{FUSED} SELECT f.id FROM fused f JOIN observations o ON f.id = o.id WHERE o.created_at >= TIMESTAMP '2024-01-15'")
def fresh(spark, d):
    new = M.observations(spark, d).where(F.col("created_at") >= F.lit("2024-01-15").cast("timestamp")).select("id")
    return new.join(F.broadcast(fused(spark, d)), "id", "left_semi")


@query("s2_9_18_degradation_flags", f"{LEGS} SELECT 'text' AS leg, count(*) AS n, CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END AS status FROM text_leg UNION ALL SELECT 'vector', count(*), CASE WHEN count(*) = 0 THEN 'empty' ELSE 'ok' END FROM vector_leg")
def degradation(spark, d):
    legs = [("text", text(spark, d)), ("vector", vector(spark, d))]
    parts = [df.agg(F.lit(n).alias("leg"), F.count(F.lit(1)).alias("n")) for n, df in legs]
    u = parts[0].union(parts[1])
    return u.withColumn("status", F.when(F.col("n") == 0, "empty").otherwise("ok"))


@query("s2_9_19_abstention")
def abstention(spark, d):
    """Stored vectors as queries: those too far from the corpus are answered with a reason and no rows."""
    e = M.table(spark, d, "embeddings")
    m = T.fit_outliers(e, "embedding")
    far = T.outlier_distance(m)
    q = e.select("vec_id", far(F.col("embedding")).alias("distance"))
    limit = T.at_rank(q, "distance", [("limit", T.conformal_rank(0.05))])
    return q.crossJoin(F.broadcast(limit)).select("vec_id", F.when(F.col("distance") > F.col("limit"), "out of distribution").alias("reason"))


CLAIM = f"""{EMB}, ev AS (SELECT id, max(s) AS s FROM (SELECT id, round({SIM}, 6) AS s FROM observations WHERE {LIVE} UNION ALL SELECT id, round(list_cosine_similarity(v, {FIRST_VECTOR}), 6) FROM embedded WHERE {LIVE}) GROUP BY id HAVING max(s) >= 0.15 ORDER BY 2 DESC, id LIMIT 10),
 j AS (SELECT o.id, s, CASE WHEN o.quality = 1 THEN 'supports' WHEN o.quality = 0 THEN 'contradicts' ELSE 'neutral' END AS verdict FROM ev JOIN observations o ON ev.id = o.id ORDER BY s DESC, o.id LIMIT 5),
 g AS (SELECT coalesce(sum(s * 0.8) FILTER (verdict = 'supports'), 0) AS sup, coalesce(sum(s * 0.8) FILTER (verdict = 'contradicts'), 0) AS con FROM j), x AS (SELECT sup, con, CASE WHEN sup + con <= 2.220446049250313e-16 THEN 0.0 WHEN con > sup THEN sup / (sup + con) ELSE sup / (sup + con) * (1 - exp(-2.0 * sup)) END AS k FROM g)"""


@query("s2_9_20_claim_verification", f"{CLAIM} SELECT round(k, 6) AS confidence, CASE WHEN sup + con <= 2.220446049250313e-16 THEN 'unknown' WHEN con > sup THEN 'contradicted' ELSE {LEVEL.format(c='k')} END AS level FROM x")
def verification(spark, d):
    o = live(spark, d, heavy=True)
    near = o.select("id", rd(X.trigram_similarity(F.col("content"), QUERY)).alias("s"))
    vec = with_cosine(spark, d, R.trusted(R.active(M.embedded(spark, d)))).select("id", rd(F.col("cosine")).alias("s"))
    ev = near.union(vec).groupBy("id").agg(F.max("s").alias("s")).where("s >= 0.15")
    best = R.top(R.top(ev, [F.desc("s"), F.asc("id")], 10), [F.desc("s"), F.asc("id")], 5)
    said = M.observations(spark, d).select("id", "quality").join(F.broadcast(best), "id")
    w = F.col("s") * 0.8  # the stand-in judge: labelled quality, at a fixed confidence
    g = said.agg(F.coalesce(F.sum(F.when(F.col("quality") == 1, w)), F.lit(0.0)).alias("sup"), F.coalesce(F.sum(F.when(F.col("quality") == 0, w)), F.lit(0.0)).alias("con"))
    c, level = S.judged_grounding(F.col("sup"), F.col("con"))
    return g.select(rd(c).alias("confidence"), level.alias("level"))


@query("s2_9_21_heuristic_judge", f"{OBS} SELECT a.id AS a, b.id AS b, CASE WHEN {NEG} THEN 'contradicts' ELSE 'unknown' END AS verdict, CASE WHEN {NEG} THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence FROM observations a JOIN observations b ON a.session = b.session AND a.id + 1 = b.id")
def judge(spark, d):
    from engramlake.plans.relational import negation

    n = negation(spark, d)
    return n.select("a", "b", F.when(F.col("negated"), "contradicts").otherwise("unknown").alias("verdict"), F.when(F.col("negated"), 0.5).otherwise(0.0).alias("confidence"))


EQ = 'error {"k": 7} user 20'
ESIM = sim(gram("message"), arr(X.trigrams_of(EQ)))


@query("s2_9_22_error_search", f"{M.cte('errors')}, s AS (SELECT id, list_has_any({tok('message')}, ['k', '20']) AS hit, {ESIM} AS s, {rank_any('message', ['error', 'k', '7', 'user', '20'])} AS r FROM errors WHERE trust = 'trusted') SELECT id, round(r + s, 6) AS score FROM s WHERE hit OR s > 0.3 ORDER BY 2 DESC, id LIMIT 20")
def error_search(spark, d):
    m = F.col("message")
    s = M.errors(spark, d).where("trust = 'trusted'").select("id", X.matches_any(m, ["k", "20"]).alias("hit"), X.trigram_similarity(m, EQ).alias("s"), X.rank_any(m, ["error", "k", "7", "user", "20"]).alias("r"))
    return R.top(s.where("hit OR s > 0.3").select("id", rd(F.col("r") + F.col("s")).alias("score")), [F.desc("score"), F.asc("id")], 20)


@query("s2_9_23_decision_search", f"{OBS}, s AS (SELECT id, {HIT} AS hit, {SIM} AS s, content FROM observations WHERE kind = 'decision') SELECT id, round(s, 6) AS score FROM s WHERE hit OR s > 0.1 OR content ILIKE '%ouble%' ORDER BY 2 DESC, id LIMIT 10")
def decision_search(spark, d):
    c = F.col("content")
    s = M.observations(spark, d).where("kind = 'decision'").select("id", (X.matches_any(c, TERMS) | c.ilike("%ouble%")).alias("hit"), X.trigram_similarity(c, QUERY).alias("s"))
    return R.top(s.where("hit OR s > 0.1").select("id", rd(F.col("s")).alias("score")), [F.desc("score"), F.asc("id")], 10)


PSIM = sim(gram("name"), arr(X.trigrams_of("Supplier#000000042")))


@query("s2_9_24_procedure_search", f"{M.cte('procedures')}, n AS (SELECT * FROM (SELECT *, round({PSIM}, 6) AS s FROM procedures) ORDER BY s DESC, id LIMIT 20) SELECT id, success, failure FROM n")
def procedure_search(spark, d):
    p = M.procedures(spark, d).withColumn("s", rd(X.trigram_similarity(F.col("name"), "Supplier#000000042")))
    near = R.top(p, [F.desc("s"), F.asc("id")], 20)
    bound = S.wilson_lower(F.col("success"), F.col("success") + F.col("failure"))
    return near.orderBy(F.desc(bound), "id").select("id", "success", "failure")


@query("s2_9_25_contradiction_scan", f"""{EMB}, p AS (SELECT a.entity, a.id AS a, b.id AS b, round(list_cosine_similarity(a.v, b.v), 6) AS c, ({NEG}) AS neg FROM embedded a JOIN embedded b ON a.entity = b.entity AND a.id < b.id WHERE a.kind NOT IN ('superseded', 'tool_usage') AND b.kind NOT IN ('superseded', 'tool_usage'))
 SELECT entity, a, b, round(least(1.0, greatest(0.0, c * CASE WHEN neg THEN 1.5 ELSE 0.7 END)), 6) AS score FROM p WHERE c BETWEEN 0.3 AND 0.85 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY c DESC, a, b) <= 5""")
def contradiction_scan(spark, d):
    e = M.embedded(spark, d).where(~F.col("kind").isin("superseded", "tool_usage"))
    best = Q.cosine_band(e.select("id", "entity", "v"), "entity", 0.3, 0.85, best=5)
    said = M.observations(spark, d).select("id", "content")
    for k in ("a", "b"):
        best = best.join(said.select(F.col("id").alias(k), F.col("content").alias(f"said_{k}")), k)
    neg = X.negation_differs(F.col("said_a"), F.col("said_b"))
    return best.select("entity", "a", "b", rd(S.contradiction(F.col("cosine"), neg)).alias("score"))


@query("s2_9_26_layered_context", f"""{OBS}, l AS (SELECT 0 AS layer, id, content, created_at FROM observations WHERE session = 7 UNION ALL SELECT 1, id, content, created_at FROM observations WHERE kind = 'decision' AND importance > 0.8),
 r AS (SELECT *, coalesce(sum(length(content)) OVER (ORDER BY layer, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT layer, id, least(length(content), 8000 - before)::BIGINT AS given FROM r WHERE before < 8000""")
def layered(spark, d):
    o = M.observations(spark, d)
    l = o.where("session = 7").select(F.lit(0).alias("layer"), "id", "content").union(o.where("kind = 'decision' AND importance > 0.8").select(F.lit(1), "id", "content"))
    w = Window.orderBy("layer", "id").rowsBetween(Window.unboundedPreceding, -1)
    n = F.length("content").cast("long")
    r = l.select("layer", "id", n.alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return r.where("before < 8000").select("layer", "id", F.least("n", 8000 - F.col("before")).alias("given"))


@query("s2_9_27_alias_similarity", f"WITH s AS (SELECT s_suppkey AS id, round({sim(gram('s_name'), arr(X.trigrams_of('supplier 000000017')))}, 6) AS similarity FROM supplier) SELECT * FROM s WHERE similarity > 0.4 ORDER BY similarity DESC, id LIMIT 5")
def alias_similarity(spark, d):
    s = M.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), rd(X.trigram_similarity(F.col("s_name"), "supplier 000000017")).alias("similarity"))
    return R.top(s.where("similarity > 0.4"), [F.desc("similarity"), F.asc("id")], 5)


@query("s2_9_28_project_briefing", f"""{M.cte('observations', 'errors', 'procedures')} SELECT * FROM (SELECT 'error' AS part, id FROM errors WHERE NOT resolved AND project = 'p1' ORDER BY created_at DESC, id LIMIT 4)
 UNION ALL SELECT * FROM (SELECT 'decision', id FROM observations WHERE kind = 'decision' AND project = 'p1' ORDER BY created_at DESC, id LIMIT 4) UNION ALL SELECT * FROM (SELECT 'procedure', id FROM procedures ORDER BY success DESC, id LIMIT 5)""")
def briefing(spark, d):
    e = R.top(M.errors(spark, d).where("NOT resolved AND project = 'p1'"), [F.desc("created_at"), F.asc("id")], 4).select(F.lit("error").alias("part"), "id")
    o = R.top(M.observations(spark, d).where("kind = 'decision' AND project = 'p1'"), [F.desc("created_at"), F.asc("id")], 4).select(F.lit("decision").alias("part"), "id")
    p = R.top(M.procedures(spark, d), [F.desc("success"), F.asc("id")], 5).select(F.lit("procedure").alias("part"), "id")
    return e.union(o).union(p)


@query("s2_2_21_secret_detector")
def secrets(spark, d):
    from engramlake.sources.secrets import scan_secrets

    return scan_secrets(M.table(spark, d, "documents"), "doc_id", "text")
