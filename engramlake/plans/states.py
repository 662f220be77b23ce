"""State transitions as named queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.functions import text as X
from engramlake.operators import relational as R
from engramlake.operators import retrieval as Q
from engramlake.operators import state as W
from engramlake.plans import model as M
from engramlake.plans.registry import query
from engramlake.plans.relational import EMB, OBS, PARA, arr, gram, rd, sim
from engramlake.plans.statistics import NOW

ERR = M.cte("errors")
TRADE = M.cte("trade")
IDLE = f"epoch({NOW} - last_accessed) / 86400.0::DOUBLE"
HALF = "CASE WHEN kind IN ('fact', 'preference') THEN 30.0 WHEN kind IN ('error', 'solution') THEN 14.0 ELSE 7.0 END"
DECAY = f"CASE WHEN {{spared}} THEN importance ELSE greatest(0.01::DOUBLE, importance * exp(-0.693::DOUBLE * {IDLE} / ({HALF} * (1 + ln(1 + access_count))))) END"
SPARED = f"kind IN ('decision', 'lesson') OR {IDLE} <= 1"


def now():
    return M.now().cast("timestamp_ntz")


def state(spark, d):
    return M.observations(spark, d).withColumn("last_accessed", F.col("last_accessed").cast("timestamp_ntz")).withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query("s2_11_1_stratified_decay", f"{OBS} SELECT id, round({DECAY.format(spared=SPARED)}, 6) AS importance FROM observations")
def decay(spark, d):
    return W.decay(state(spark, d), now()).select("id", rd(F.col("importance")).alias("importance"))


@query("s2_11_2_protected_decay", f"{OBS}, safe AS (SELECT DISTINCT entity FROM observations WHERE created_at > TIMESTAMP '2024-01-30 16:00:00') SELECT id, round({DECAY.format(spared=SPARED + ' OR entity IN (SELECT entity FROM safe)')}, 6) AS importance FROM observations")
def protected_decay(spark, d):
    s = state(spark, d)
    safe = s.where(F.col("created_at") > F.lit("2024-01-30 16:00:00").cast("timestamp_ntz"))
    return W.decay(s, now(), safe).select("id", rd(F.col("importance")).alias("importance"))


@query("s2_11_3_episode_decay", f"{OBS} SELECT id, round(greatest(0.01::DOUBLE, 0.5::DOUBLE / power(1 + 0.1::DOUBLE * epoch({NOW} - created_at) / 86400.0::DOUBLE, 0.5::DOUBLE)), 6) AS importance FROM observations")
def episode_decay(spark, d):
    return W.episode_decay(state(spark, d), now()).select("id", rd(F.col("importance")).alias("importance"))


@query("s2_11_4_prune", f"{OBS} SELECT id FROM observations WHERE importance >= 0.3 OR kind IN ('decision', 'lesson')")
def prune(spark, d):
    return W.prune(state(spark, d), 0.3).select("id")


PAIRS = f"g AS (SELECT id, entity, {gram('content')} AS t FROM observations WHERE kind <> 'superseded'), p AS (SELECT a.id AS keep, b.id AS lose FROM g a JOIN g b ON a.entity = b.entity AND a.id < b.id AND {sim('a.t', 'b.t')} > 0.8 ORDER BY 1, 2 LIMIT 100)"


@query("s2_11_5_merge_duplicates", f"{OBS}, {PAIRS} SELECT id, CASE WHEN id IN (SELECT lose FROM p) THEN 'superseded' ELSE kind END AS kind, round(CASE WHEN id IN (SELECT lose FROM p) THEN importance ELSE least(1.0, importance + 0.05 * (SELECT count(*) FROM p WHERE keep = id)) END, 6) AS importance FROM observations")
def merge_duplicates(spark, d):
    o = R.active(M.contents(spark, d)).where(F.col("entity").isNotNull()).select("id", "entity", "content")
    pairs = R.first_pairs(o, "id", "content", 0.8, 100, within="entity").select(F.col("a").alias("keep"), F.col("b").alias("drop"))
    return W.merge_duplicates(state(spark, d), pairs).select("id", "kind", rd(F.col("importance")).alias("importance"))


@query("s2_11_6_retire_overload", f"{OBS} SELECT id, CASE WHEN count(*) OVER (PARTITION BY entity) > 45 AND importance < 0.05 THEN 'superseded' ELSE kind END AS kind FROM observations")
def retire(spark, d):
    return W.retire_overload(state(spark, d), 45).select("id", "kind")


@query("s2_11_7_summarise", f"{OBS} SELECT id, CASE WHEN entity = 'src1' THEN 'superseded' ELSE kind END AS kind FROM observations UNION ALL SELECT -1, 'summary'")
def summarise(spark, d):
    s = state(spark, d)
    note = spark.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit("summary").alias("kind"))
    return s.select("id", F.when(F.col("entity") == "src1", "superseded").otherwise(F.col("kind")).alias("kind")).union(note)


@query("s2_11_8_access_boost", f"{M.cte('entities')} SELECT id, round(least(1.0::DOUBLE, importance + 0.01::DOUBLE * greatest(0.1::DOUBLE, 1 - access_count / greatest(10.0::DOUBLE, access_count) * 0.8::DOUBLE) * (1 - exp(-3600.0::DOUBLE / 600.0::DOUBLE))), 8) AS boosted, round(greatest(10.0::DOUBLE, 0.85::DOUBLE * 10.0::DOUBLE + 0.15::DOUBLE * access_count), 6) AS theta, access_count + 1 AS accesses FROM entities")
def access_boost(spark, d):
    return W.access_boost(M.entities(spark, d), F.lit(3600.0), F.lit(10.0)).select("id", F.round("boosted", 8).alias("boosted"), rd(F.col("theta")).alias("theta"), "accesses")


@query("s2_11_9_neighbour_boost", f"{M.cte('entities', 'trade')}, n AS (SELECT CASE WHEN src = 'n:1' THEN dst ELSE src END AS id, max(strength) AS s FROM trade WHERE src = 'n:1' OR dst = 'n:1' GROUP BY 1) SELECT e.id, round(least(1.0, importance + 0.005 * coalesce(s, 0)), 10) AS importance FROM entities e LEFT JOIN n ON e.id = n.id")
def neighbour_boost(spark, d):
    return W.neighbour_boost(M.entities(spark, d), M.trade(spark, d), "n:1").select("id", F.round("importance", 10).alias("importance"))


STEP = "(0.05::DOUBLE / sqrt(1 + access_count / 100.0::DOUBLE))"


@query("s2_11_10_feedback", f"{OBS} SELECT id, round(CASE WHEN coalesce(quality, 1) = 1 THEN least(1.0::DOUBLE, importance + {STEP} * (1 - importance)) ELSE greatest(0.01::DOUBLE, importance - {STEP} * importance) END, 8) AS importance FROM observations")
def feedback(spark, d):
    return M.observations(spark, d).select("id", F.round(W.feedback(F.coalesce("quality", F.lit(1)) == 1), 8).alias("importance"))


@query("s2_11_11_correct_with_history", f"{OBS} SELECT id, CASE WHEN id % 9 = 0 THEN 'corrected ' || id ELSE content END AS content, CASE WHEN id % 9 = 0 THEN 1 ELSE 0 END AS changes, CASE WHEN id % 9 = 0 THEN 2 ELSE 1 END::BIGINT AS version, id % 9 <> 0 AS vector_valid FROM observations")
def correct(spark, d):
    s = M.observations(spark, d).select("id", "content", F.array().cast("array<string>").alias("history"), F.lit(1).cast("long").alias("version"), F.lit(True).alias("vector_valid"))
    put = s.where("id % 9 = 0").select("id", F.concat(F.lit("corrected "), F.col("id").cast("string")).alias("put"))
    return W.correct(s, put).select("id", "content", F.size("history").alias("changes"), "version", "vector_valid")


@query("s2_11_12_promote_quarantine", f"{OBS} SELECT id, CASE WHEN id % 21 = 0 THEN 'trusted' WHEN id % 22 = 0 THEN 'quarantined' ELSE trust END AS trust FROM observations")
def promote(spark, d):
    i = F.col("id")
    return M.observations(spark, d).select("id", F.when(i % 21 == 0, "trusted").when(i % 22 == 0, "quarantined").otherwise(F.col("trust")).alias("trust"))


@query("s2_11_13_novelty_gate", f"""{EMB}, n AS (SELECT * FROM embedded WHERE id % 10 = 0), o AS (SELECT * FROM embedded WHERE id % 10 <> 0), b AS (SELECT n.id, round(max(list_cosine_similarity(n.v, o.v)), 6) AS s FROM n JOIN o ON n.entity = o.entity GROUP BY n.id)
 SELECT n.id, CASE WHEN coalesce(s, 0) >= 0.92 THEN 'reinforce' WHEN coalesce(s, 0) >= 0.75 THEN 'update' ELSE 'insert' END AS verdict FROM n LEFT JOIN b ON n.id = b.id""")
def novelty(spark, d):
    e = M.embedded(spark, d).select("id", "entity", "v")
    # below the gate's lower bound the verdict is the same as without a note
    best = Q.cosine_band(e.where("id % 10 = 0"), "entity", 0.75, float("inf"), others=e.where("id % 10 <> 0"), best=1, each=True).select(F.col("a").alias("id"), F.col("cosine").alias("semantic"))
    return W.novelty_gate(e.where("id % 10 = 0").select("id"), best.withColumn("lexical", F.lit(0.0))).select("id", "verdict")


@query("s2_11_14_parse_paragraphs", rf"WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), '\n\s*\n')) AS p FROM documents) SELECT doc_id, count(*) AS n, count(*) FILTER ({PARA.replace('(p)', '(trim(p))')} = 'fact') AS facts FROM p WHERE octet_length(encode(trim(p))) > 10 GROUP BY doc_id")
def parse(spark, d):
    t = M.table(spark, d, "documents").select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))
    return W.split_paragraphs(t, "doc_id", "text").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "fact").alias("facts"))


@query("s2_11_15_extraction_candidates", f"{EMB}, n AS (SELECT * FROM embedded WHERE id % 10 = 0), o AS (SELECT * FROM embedded WHERE id % 10 <> 0) SELECT n.id AS a, o.id AS b, round(list_cosine_similarity(n.v, o.v), 6) AS similarity FROM n JOIN o ON n.entity = o.entity WHERE round(list_cosine_similarity(n.v, o.v), 6) BETWEEN 0.30 AND 0.85")
def extraction_candidates(spark, d):
    """The pairs a judge would be asked about; without a language model no verdict follows."""
    e = M.embedded(spark, d).select("id", "entity", "v")
    return Q.cosine_band(e.where("id % 10 = 0"), "entity", 0.30, 0.85, others=e.where("id % 10 <> 0")).select("a", "b", F.col("cosine").alias("similarity"))


INC = "i AS (SELECT src, dst, 'uses' AS rtype, strength FROM trade WHERE src < 'n:15' UNION ALL SELECT src, dst, rtype, strength FROM trade WHERE dst > 'n:2')"


@query("s2_11_16_edge_upsert", f"""{TRADE}, {INC}, g AS (SELECT src, dst, rtype, max(strength) AS s, count(*) AS n FROM i GROUP BY ALL)
 SELECT coalesce(t.src, g.src) AS src, coalesce(t.dst, g.dst) AS dst, coalesce(t.rtype, g.rtype) AS rtype, round(least(1.0, CASE WHEN t.src IS NULL THEN s + 0.1 * (n - 1) ELSE strength + 0.1 * coalesce(n, 0) END), 6) AS strength FROM trade t FULL JOIN g ON t.src = g.src AND t.dst = g.dst AND t.rtype = g.rtype""")
def edge_upsert(spark, d):
    t = M.trade(spark, d)
    new = t.where("src < 'n:15'").select("src", "dst", F.lit("uses").alias("rtype"), "strength").union(t.where("dst > 'n:2'").select("src", "dst", "rtype", "strength"))
    return W.upsert_edges(t, new).withColumn("strength", rd(F.col("strength")))


@query("s2_11_17_traversal_reinforcement", f"{TRADE} SELECT src, dst, round(CASE WHEN src = 'n:2' THEN least(1.0, strength + 0.02) ELSE strength END, 6) AS strength FROM trade")
def traversal_reinforcement(spark, d):
    return W.reinforce_from(M.trade(spark, d), "n:2").select("src", "dst", rd(F.col("strength")).alias("strength"))


@query("s2_11_18_error_pattern_boost", f"{ERR} SELECT id, round(CASE WHEN count(*) OVER (PARTITION BY error_type, user_id) >= 3 THEN least(5.0, synapse_weight + 0.1) ELSE synapse_weight END, 6) AS weight FROM errors")
def pattern_boost(spark, d):
    return W.boost_patterns(M.errors(spark, d)).select("id", rd(F.col("synapse_weight")).alias("weight"))


@query("s2_11_19_fact_supersede", f"{M.cte('facts')} SELECT id, valid_to, valid_to IS NULL AS current FROM facts")
def fact_supersede(spark, d):
    o = M.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").alias("valid_from"))
    return W.close_intervals(o, ["subject"]).select("id", "valid_to", "current")


REPL = f"{OBS}, l AS (SELECT id, content, importance, access_count FROM observations WHERE id % 3 <> 0), r AS (SELECT id, CASE WHEN id % 8 = 0 THEN content || ' (edited)' ELSE content END AS content, 1 - importance AS importance, id % 5 AS access_count FROM observations WHERE id % 4 <> 1)"


def replicas(spark, d):
    o = M.observations(spark, d).select("id", "content", "importance", "access_count")
    edited = F.when(F.col("id") % 8 == 0, F.concat("content", F.lit(" (edited)"))).otherwise(F.col("content"))
    return o.where("id % 3 <> 0"), o.where("id % 4 <> 1").select("id", edited.alias("content"), (1 - F.col("importance")).alias("importance"), (F.col("id") % 5).alias("access_count"))


@query("s2_11_20_replica_merge", f"{REPL} SELECT coalesce(l.id, r.id) AS id, sha256(coalesce(l.content, r.content)) AS content, round(greatest(l.importance, r.importance), 6) AS importance, greatest(l.access_count, r.access_count) AS access_count, coalesce(l.content <> r.content, false) AS conflict FROM l FULL JOIN r ON l.id = r.id")
def replica_merge(spark, d):
    m = W.merge_replica(*replicas(spark, d))
    return m.select("id", F.sha2("content", 256).alias("content"), rd(F.col("importance")).alias("importance"), "access_count", F.coalesce("conflict", F.lit(False)).alias("conflict"))


@query("s2_11_20_replica_overwrite", f"{REPL} SELECT coalesce(l.id, r.id) AS id, sha256(coalesce(r.content, l.content)) AS content, CASE WHEN l.content <> r.content THEN sha256(l.content) END AS previous FROM l FULL JOIN r ON l.id = r.id")
def replica_overwrite(spark, d):
    m = W.merge_replica(*replicas(spark, d), policy="overwrite")
    return m.select("id", F.sha2("content", 256).alias("content"), F.sha2("previous", 256).alias("previous"))


@query("s2_1_8_bundle_import", f"{REPL} SELECT coalesce(l.id, r.id) AS id, CASE WHEN l.id IS NULL THEN 'inserted' WHEN r.id IS NULL THEN 'kept' ELSE 'merged' END AS what FROM l FULL JOIN r ON l.id = r.id")
def bundle_import(spark, d):
    l, r = replicas(spark, d)
    j = l.alias("l").join(r.alias("r"), F.col("l.id") == F.col("r.id"), "full")
    return j.select(F.coalesce("l.id", "r.id").alias("id"), F.when(F.col("l.id").isNull(), "inserted").when(F.col("r.id").isNull(), "kept").otherwise("merged").alias("what"))


@query("s2_11_21_last_writer", f"{OBS} SELECT session, arg_max(id, {{'c': access_count, 'a': origin || '-' || id}}) AS id, max(access_count) AS counter FROM observations GROUP BY session")
def last_writer(spark, d):
    v = M.observations(spark, d).select("session", "id", F.col("access_count").alias("counter"), F.concat("origin", F.lit("-"), F.col("id").cast("string")).alias("actor"))
    return W.latest_version(v, "session").select("session", "id", "counter")


@query("s2_11_22_tombstones", f"{OBS} SELECT id FROM observations WHERE id % 23 <> 5")
def tombstones(spark, d):
    s = M.observations(spark, d).select("id")
    return W.bury(s, s.where("id % 23 = 5"))


@query("s2_11_23_conflict_resolution", f"{REPL}, c AS (SELECT l.id, l.content, r.content AS incoming, ['ours', 'theirs', 'both'][l.id // 8 % 3 + 1] AS choice FROM l JOIN r ON l.id = r.id WHERE l.content <> r.content) SELECT id, sha256(CASE WHEN choice = 'theirs' THEN incoming ELSE content END) AS content, CASE WHEN choice = 'theirs' THEN 2 ELSE 1 END::BIGINT AS version, choice <> 'theirs' AS vector_valid FROM c")
def conflict_resolution(spark, d):
    l, r = replicas(spark, d)
    c = l.join(r.select("id", F.col("content").alias("incoming")), "id").where("content <> incoming").withColumn("version", F.lit(1).cast("long"))
    choice = M.pick(["ours", "theirs", "both"], F.floor(F.col("id") / 8) % 3)
    return W.resolve(c, choice).select("id", F.sha2("content", 256).alias("content"), "version", "vector_valid")


@query("s2_11_24_versioned_put")
def versioned_put(spark, d):
    p = M.table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), (F.col("event_id") % 5).alias("base"))
    return W.put_versions(p)


@query("s2_11_24_leases")
def lease_lock(spark, d):
    r = M.table(spark, d, "events").select((F.col("event_id") % 20).cast("string").alias("path"), F.col("user_id").cast("string").alias("actor"), F.col("ts").cast("timestamp_ntz").alias("at"))
    return W.leases(r, 3600)


TRIG = "t AS (SELECT r_regionkey AS trigger, 'error {\"k\": ' || r_regionkey || '} user ' || (r_regionkey * 7) AS pattern, 5 AS max_fires, 0 AS fire_count FROM region)"


@query("s2_11_25_triggers", f"{ERR}, {TRIG}, f AS (SELECT trigger, count(*) AS n FROM errors JOIN t ON message = pattern OR {sim(gram('message'), gram('pattern'))} > 0.8 GROUP BY trigger) SELECT t.trigger, least(5, coalesce(n, 0))::BIGINT AS fire_count, coalesce(n, 0) < 5 AS live FROM t LEFT JOIN f ON t.trigger = f.trigger")
def triggers(spark, d):
    k = F.col("r_regionkey")
    t = M.table(spark, d, "region").select(k.alias("trigger"), F.concat(F.lit('error {"k": '), k.cast("string"), F.lit("} user "), (k * 7).cast("string")).alias("pattern"), F.lit(5).cast("long").alias("max_fires"), F.lit(0).cast("long").alias("fire_count"), M.now().alias("expires_at"))
    seen = M.errors(spark, d).select(F.col("message").alias("content"), F.col("created_at").alias("at"))
    return W.fire_triggers(t, seen, 0.8)


@query("s2_11_26_audit_chain", f"""{OBS}, o AS (SELECT session, list(sha256(id || ':' || content) ORDER BY id) AS ds FROM observations GROUP BY session)
 SELECT session, list_reduce(list_prepend('', ds), lambda a, x: sha256(a || x)) AS head FROM o""")
def audit_chain(spark, d):
    o = M.observations(spark, d)
    c = W.chain(o, "session", "id", F.concat(F.col("id").cast("string"), F.lit(":"), "content"))
    return c.groupBy("session").agg(F.max_by("hash", "id").alias("head"))


@query("s2_11_27_erasure", f"{OBS} SELECT id FROM observations WHERE entity <> 'src4' AND position('ouble' IN lower(content)) = 0")
def erasure(spark, d):
    return W.erase(M.observations(spark, d), "src4", "ouble").select("id")


@query("s2_11_28_rename", f"{OBS} SELECT id, CASE WHEN project = 'p1' THEN 'renamed' WHEN project IS NULL THEN 'backfilled' ELSE project END AS project FROM observations")
def rename(spark, d):
    p = F.col("project")
    return M.observations(spark, d).select("id", F.when(p == "p1", "renamed").when(p.isNull(), "backfilled").otherwise(p).alias("project"))


@query("s2_11_29_entity_merge", f"{TRADE}, e AS (SELECT CASE WHEN src IN ('n:4', 'n:8') THEN 'n:0' ELSE src END AS src, CASE WHEN dst IN ('n:4', 'n:8') THEN 'n:0' ELSE dst END AS dst, rtype, strength FROM trade) SELECT src, dst, rtype, max(strength) AS strength FROM e WHERE src <> dst GROUP BY ALL")
def entity_merge(spark, d):
    m = M.entities(spark, d).where(F.col("id").isin("n:4", "n:8")).select(F.col("id").alias("loser"), F.lit("n:0").alias("winner"))
    return W.repoint(M.trade(spark, d), m)


@query("s2_11_30_calibrate_resolve", f"{M.cte('observations', 'verify_log')}, s AS (SELECT DISTINCT entity, origin FROM observations), v AS (SELECT entity, sum(correct) AS a, count(*) - sum(correct) AS b FROM verify_log GROUP BY entity) SELECT origin, (1 + sum(a))::BIGINT AS alpha, (1 + sum(b))::BIGINT AS beta FROM s JOIN v USING (entity) GROUP BY origin")
def calibrate(spark, d):
    s = M.observations(spark, d).select("entity", "origin").distinct()
    v = M.verify_log(spark, d).groupBy("entity").agg(F.sum("correct").alias("a"), F.count_if(F.col("correct") == 0).alias("b"))
    return s.join(v, "entity").groupBy("origin").agg((1 + F.sum("a")).alias("alpha"), (1 + F.sum("b")).alias("beta"))


@query("s2_11_31_consolidation_cycle", f"""{OBS}, a AS (SELECT *, {DECAY.format(spared=SPARED)} AS i2 FROM observations) SELECT count(*) AS rows, count(*) FILTER (i2 < importance) AS decayed, count(*) FILTER (i2 < 0.05 AND kind NOT IN ('decision', 'lesson')) AS weak, round(avg(i2), 6) AS importance FROM a""")
def consolidation(spark, d):
    s = state(spark, d)
    after = W.decay(s.withColumn("before", F.col("importance")), now())
    i = F.col("importance")
    return after.agg(F.count(F.lit(1)).alias("rows"), F.count_if(i < F.col("before")).alias("decayed"), F.count_if((i < 0.05) & ~F.col("kind").isin(W.KEPT_KINDS)).alias("weak"), rd(F.avg(i)).alias("importance"))


@query("s2_11_32_reembed_backlog", f"{OBS} SELECT id FROM observations WHERE id NOT IN (SELECT vec_id FROM embeddings) AND length(content) > 1800 ORDER BY importance DESC, id LIMIT 100")
def backlog(spark, d):
    e = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))
    stale = M.observations(spark, d).where(F.length("content") > 1800).join(e, "id", "left_anti")
    return R.top(stale, [F.desc("importance"), F.asc("id")], 100).select("id")


@query("s2_11_33_session_snapshot", f"{OBS} SELECT * FROM (SELECT 'note' AS part, id FROM observations WHERE kind <> 'decision' ORDER BY created_at DESC, id DESC LIMIT 50) UNION ALL SELECT * FROM (SELECT 'decision', id FROM observations WHERE kind = 'decision' ORDER BY created_at DESC, id DESC LIMIT 20)")
def snapshot(spark, d):
    o, order = M.observations(spark, d), [F.desc("created_at"), F.desc("id")]
    a = R.top(o.where("kind <> 'decision'"), order, 50).select(F.lit("note").alias("part"), "id")
    return a.union(R.top(o.where("kind = 'decision'"), order, 20).select(F.lit("decision").alias("part"), "id"))
