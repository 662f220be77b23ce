"""Scans, filters, joins, sorts and set operations as named queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.functions import text as X
from engramlake.functions import vectors as V
from engramlake.operators import relational as R
from engramlake.operators.ordering import global_rank
from engramlake.plans import model as M
from engramlake.plans.registry import query

OBS = M.cte("observations")


def rd(c, n: int = 6):
    return F.round(c, n)


@query("s2_1_1_table_scan", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def table_scan(spark, d):
    return M.table(spark, d, "orders").where("o_totalprice > 100000").select("o_orderkey", "o_custkey", "o_totalprice")


@query("s2_1_2_partial_index_scan", f"{OBS} SELECT id, kind, importance FROM observations WHERE kind <> 'superseded' AND importance > 0.1")
def partial_index_scan(spark, d):
    return R.active(M.observations(spark, d)).where("importance > 0.1").select("id", "kind", "importance")


@query("s2_1_11_bundle_status", f"""{OBS}, a AS (SELECT count(*) AS n FROM observations), b AS (SELECT count(*) AS n FROM observations WHERE id % 10 <> 0)
 SELECT a.n AS local_rows, b.n AS bundle_rows, a.n - b.n AS missing FROM a, b""")
def bundle_status(spark, d):
    o = M.observations(spark, d)
    return o.agg(F.count(F.lit(1)).alias("local_rows"), F.count_if(F.col("id") % 10 != 0).alias("bundle_rows")).withColumn("missing", F.col("local_rows") - F.col("bundle_rows"))


@query("s2_1_14_entity_export", f"{M.cte('entities')} SELECT id, name, importance FROM entities ORDER BY importance DESC, id LIMIT 500")
def entity_export(spark, d):
    return R.top(M.entities(spark, d), [F.desc("importance"), F.asc("id")], 500).select("id", "name", "importance")


@query("s2_1_15_dashboard", f"""{M.cte('entities', 'trade')} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM trade) AS relations,
 (SELECT count(*) FROM entities WHERE id NOT IN (SELECT src FROM trade UNION ALL SELECT dst FROM trade)) AS isolated""")
def dashboard(spark, d):
    e, t = M.entities(spark, d), M.trade(spark, d)
    used = t.select("src").union(t.select("dst")).withColumnRenamed("src", "id")
    alone = e.join(used, "id", "left_anti").agg(F.count(F.lit(1)).alias("isolated"))
    return e.agg(F.count(F.lit(1)).alias("entities")).crossJoin(t.agg(F.count(F.lit(1)).alias("relations"))).crossJoin(alone)


@query("s2_1_16_resource_listing", f"{M.cte('entities')} SELECT 'memory://entity/' || id AS uri, name, importance FROM entities ORDER BY importance DESC, id LIMIT 50")
def resource_listing(spark, d):
    return R.top(M.entities(spark, d), [F.desc("importance"), F.asc("id")], 50).select(F.concat(F.lit("memory://entity/"), "id").alias("uri"), "name", "importance")


@query("s2_2_1_active_filter", f"{OBS} SELECT id, kind FROM observations WHERE kind <> 'superseded'")
def active_filter(spark, d):
    return R.active(M.observations(spark, d)).select("id", "kind")


@query("s2_2_2_trust_filter", f"{OBS} SELECT id, CASE WHEN origin = 'inference' THEN 'quarantined' ELSE trust END AS trust FROM observations WHERE trust = 'trusted'")
def trust_filter(spark, d):
    return R.trusted(M.observations(spark, d)).select("id", F.when(F.col("origin") == "inference", "quarantined").otherwise(F.col("trust")).alias("trust"))


@query("s2_2_3_project_scope", f"{OBS} SELECT id, project FROM observations WHERE project = 'p1' OR project IS NULL")
def project_scope(spark, d):
    return R.scope(M.observations(spark, d), "p1", include_unscoped=True).select("id", "project")


@query("s2_2_4_time_bounds", f"{OBS} SELECT id, created_at FROM observations WHERE created_at BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-15 12:00:00'")
def time_bounds(spark, d):
    return R.between(M.observations(spark, d), "2024-01-05", "2024-01-15 12:00:00").select("id", "created_at")


@query("s2_2_5_scope_router", f"""{M.cte('observations', 'errors', 'entities')} SELECT 'observations' AS scope, count(*) AS n FROM observations
 UNION ALL SELECT 'errors', count(*) FROM errors UNION ALL SELECT 'entities', count(*) FROM entities""")
def scope_router(spark, d):
    legs = {"observations": M.observations, "errors": M.errors, "entities": M.entities}
    parts = [leg(spark, d).agg(F.lit(name).alias("scope"), F.count(F.lit(1)).alias("n")) for name, leg in legs.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("s2_2_6_tag_filter", f"{OBS} SELECT id, round(importance * 0.8 + 0.2, 6) AS score FROM observations WHERE list_contains(tags, 'fr')")
def tag_filter(spark, d):
    return M.observations(spark, d).where(F.array_contains("tags", "fr")).select("id", rd(F.col("importance") * 0.8 + 0.2).alias("score"))


TOK = r"list_filter(regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tok(c: str) -> str:
    return TOK.format(c=c)


def gram(c: str) -> str:
    return f"list_distinct(flatten(list_transform({tok(c)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def sim(x: str, y: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 0.0 ELSE len(list_intersect({x}, {y})) / len(list_distinct(list_concat({x}, {y})))::DOUBLE END"


def arr(items) -> str:
    return "[" + ", ".join("'" + i.replace("'", "''") + "'" for i in items) + "]"


@query("s2_2_7_or_match", f"{OBS} SELECT id FROM observations WHERE list_has_any({tok('content')}, ['ouble', 'les', 'und'])")
def or_match(spark, d):
    return M.observations(spark, d).where(X.matches_any(F.col("content"), ["ouble", "les", "und"])).select("id")


QUERY = "thereaing theonand of the ouble"
TERMS = ["thereaing", "theonand", "of", "the", "ouble"]


@query("s2_2_8_trigram_threshold", f"{OBS} SELECT id, similarity FROM (SELECT id, round({sim(gram('content'), arr(X.trigrams_of(QUERY)))}, 6) AS similarity FROM observations) WHERE similarity > 0.03")
def trigram_threshold(spark, d):
    similarity = rd(X.trigram_similarity(F.col("content"), QUERY))
    return M.observations(spark, d, heavy=True).select("id", X.explode_if(similarity, lambda s: s > 0.03).alias("similarity"))


EMB = M.cte("embedded")
FIRST_VECTOR = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"


def stored_vector(spark, d, key: int = 0):
    """One stored vector as a single-row relation: the stand-in for an embedded query."""
    return M.table(spark, d, "embeddings").where(F.col("vec_id") == key).select(F.col("embedding").cast("array<double>").alias("q"))


def with_cosine(spark, d, df):
    return df.crossJoin(F.broadcast(stored_vector(spark, d))).withColumn("cosine", V.cosine(F.col("v"), F.col("q")))


@query("s2_2_9_cosine_band", f"{EMB} SELECT id, round(list_cosine_similarity(v, {FIRST_VECTOR}), 6) AS cosine FROM embedded WHERE list_cosine_similarity(v, {FIRST_VECTOR}) BETWEEN 0.1 AND 0.85")
def cosine_band(spark, d):
    return with_cosine(spark, d, M.embedded(spark, d)).where("cosine BETWEEN 0.1 AND 0.85").select("id", rd(F.col("cosine")).alias("cosine"))


@query("s2_2_10_in_list", f"{OBS} SELECT id, entity FROM observations WHERE entity IN ('src1', 'src5', 'src7')")
def in_list(spark, d):
    return M.observations(spark, d).where(F.col("entity").isin("src1", "src5", "src7")).select("id", "entity")


@query("s2_2_11_as_of", f"{M.cte('facts')} SELECT id, subject, object FROM facts WHERE valid_from <= TIMESTAMP '1996-06-30' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1996-06-30')")
def as_of(spark, d):
    t = F.lit("1996-06-30").cast("timestamp")
    return M.facts(spark, d).where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))).select("id", "subject", "object")


@query("s2_2_12_ttl_filter", f"{OBS} SELECT id, created_at + INTERVAL 7 DAYS AS expires_at FROM observations WHERE created_at + INTERVAL 7 DAYS > TIMESTAMP '{M.NOW}'")
def ttl_filter(spark, d):
    return M.observations(spark, d).select("id", (F.col("created_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at")).where(F.col("expires_at") > M.now())


@query("s2_2_13_substring", f"{OBS} SELECT id FROM observations WHERE position('ouble' IN lower(content)) > 0 OR content ILIKE '%les ait%'")
def substring(spark, d):
    return M.observations(spark, d).where((F.instr(F.lower("content"), "ouble") > 0) | F.col("content").ilike("%les ait%")).select("id")


@query("s2_2_14_null_safe_equality", f"{OBS} SELECT id FROM observations WHERE project IS NOT DISTINCT FROM NULL OR project IS NOT DISTINCT FROM 'p2'")
def null_safe(spark, d):
    return M.observations(spark, d).where(F.col("project").eqNullSafe(F.lit(None)) | F.col("project").eqNullSafe(F.lit("p2"))).select("id")


@query("s2_2_15_other_endpoint", f"{M.cte('trade')} SELECT src, dst, CASE WHEN src = 'n:1' THEN dst ELSE src END AS other FROM trade WHERE src = 'n:1' OR dst = 'n:1'")
def other_endpoint(spark, d):
    return M.trade(spark, d).where("src = 'n:1' OR dst = 'n:1'").select("src", "dst", F.when(F.col("src") == "n:1", F.col("dst")).otherwise(F.col("src")).alias("other"))


@query("s2_2_16_compact_projection", f"{OBS} SELECT id AS i, entity AS e, left(content, len(list_filter(range(1, 1201), lambda i: octet_length(encode(left(content, i))) <= 1200))) AS c FROM observations")
def compact(spark, d):
    return M.observations(spark, d).select(F.col("id").alias("i"), F.col("entity").alias("e"), X.cut_bytes(F.col("content"), 1200).alias("c"))


NEG = " OR ".join("(contains(lower(a.content), '{0}') <> contains(lower(b.content), '{0}'))".format(m.replace("'", "''")) for m in X.NEGATION_MARKERS)


@query("s2_2_17_negation_marker", f"{OBS} SELECT a.id AS a, b.id AS b, ({NEG}) AS negated FROM observations a JOIN observations b ON a.session = b.session AND a.id + 1 = b.id")
def negation(spark, d):
    o = M.observations(spark, d).select("id", "session", "content")
    a, b = o.alias("a"), o.withColumn("before", F.col("id") - 1).alias("b")
    j = a.join(b, (F.col("a.session") == F.col("b.session")) & (F.col("a.id") == F.col("b.before")))
    return j.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), X.negation_differs(F.col("a.content"), F.col("b.content")).alias("negated"))


def any_of(c: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({c}, '{p}')" for p in phrases) + ")"


PARA = "CASE " + " ".join(f"WHEN {any_of('lower(p)', keys)} THEN '{k}'" for k, keys in X.PARAGRAPH_KINDS) + " ELSE 'fact' END"


@query("s2_2_18_paragraph_classifier", f"WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) SELECT {PARA} AS kind, count(*) AS n FROM p GROUP BY 1")
def paragraphs(spark, d):
    p = M.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("p"))
    return p.groupBy(X.classify_paragraph(F.col("p")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("s2_2_19_query_classifier", f"SELECT conv_id, turn, CASE WHEN {any_of('lower(text)', X.GLOBAL_PHRASES)} THEN 'global' WHEN {any_of('lower(text)', X.HOP_PHRASES)} THEN 'multi_hop' ELSE 'factoid' END AS class FROM conversations")
def query_class(spark, d):
    return M.table(spark, d, "conversations").select("conv_id", "turn", X.classify_query(F.col("text")).alias("class"))


MENTION_QUERY = "what did NATION-3, nation_17 and the middle   east sell to Supplier#000000042 in asia"
NORM = r"trim(regexp_replace(translate(lower({c}), '-_/.', '    '), '\s+', ' ', 'g'))"


@query("s2_2_20_mention_matcher", f"""{M.cte('entities')}, m AS (SELECT name, length(name) AS n FROM entities WHERE length({NORM.format(c='name')}) >= 4
 AND contains({NORM.format(c=f"'{MENTION_QUERY}'")}, {NORM.format(c='name')})) SELECT name, row_number() OVER (ORDER BY n DESC, name) AS rank FROM m QUALIFY rank <= 8""")
def mentions(spark, d):
    return mentioned(M.entities(spark, d), MENTION_QUERY)


def mentioned(entities, text: str, most: int = 8):
    """Names of four characters or more that the query contains, longest first."""
    name = X.normalize_mention(F.col("name"))
    hits = entities.where((F.length(name) >= 4) & F.contains(X.normalize_mention(F.lit(text)), name)).select("name")
    first = R.top(hits, [F.desc(F.length("name")), F.asc("name")], most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.length("name")), F.asc("name"))).cast("long"))


KINDS = M.KINDS + ["superseded"]


@query("s2_2_22_validation", f"""{OBS} SELECT id, CASE WHEN octet_length(encode(content)) NOT BETWEEN 1 AND 10000 THEN 'length' WHEN kind NOT IN {tuple(KINDS)} THEN 'kind'
 WHEN importance < 0 OR importance > 1 THEN 'importance' ELSE 'ok' END AS verdict FROM observations""")
def validation(spark, d):
    n = F.octet_length("content")
    v = F.when((n < 1) | (n > 10000), "length").when(~F.col("kind").isin(KINDS), "kind").when((F.col("importance") < 0) | (F.col("importance") > 1), "importance").otherwise("ok")
    return M.observations(spark, d).select("id", v.alias("verdict"))


@query("s2_3_1_inner_join", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def inner_join(spark, d):
    s, n = M.table(spark, d, "supplier"), M.table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "s_name", "n_name")


@query("s2_3_2_left_join", f"{M.cte('observations', 'verify_log')} SELECT o.id, o.entity, v.level FROM observations o LEFT JOIN verify_log v ON o.id = v.id")
def left_join(spark, d):
    return M.observations(spark, d).join(M.verify_log(spark, d).select("id", "level"), "id", "left").select("id", "entity", "level")


@query("s2_3_3_self_join_similar", f"""{OBS}, g AS (SELECT id, entity, {gram('content')} AS t FROM observations WHERE kind <> 'superseded'), c AS (SELECT *, min(id) OVER (PARTITION BY entity, list_sort(t)) AS c FROM g WHERE len(t) > 0)
 SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.entity = b.entity AND a.id < b.id AND a.id = a.c AND b.id = b.c AND {sim('a.t', 'b.t')} > 0.8 UNION ALL SELECT c, id FROM c WHERE id <> c""")
def self_join(spark, d):
    o = R.active(M.observations(spark, d, heavy=True)).select("id", "entity", "content")
    return R.similar_links(o, "id", "content", 0.8, within="entity").select("a", "b")


@query("s2_3_4_similarity_join", f"""WITH g AS (SELECT p_partkey AS id, {gram('p_name')} AS t FROM part WHERE p_partkey IS NOT NULL), c AS (SELECT *, min(id) OVER (PARTITION BY list_sort(t)) AS c FROM g WHERE len(t) > 0)
 SELECT a.id AS a, b.id AS b, round({sim('a.t', 'b.t')}, 6) AS similarity FROM c a JOIN c b ON a.id < b.id AND a.id = a.c AND b.id = b.c AND {sim('a.t', 'b.t')} > 0.9 UNION ALL SELECT c, id, 1.0 FROM c WHERE id <> c""")
def similarity_join(spark, d):
    return R.similar_links(M.table(spark, d, "part"), "p_partkey", "p_name", 0.9).select("a", "b", rd(F.col("similarity")).alias("similarity"))


ERR_SIM = sim(gram("message"), arr(X.trigrams_of('error {"k": 7} user 20')))


@query("s2_3_5_point_to_all", f"""{M.cte('errors')} SELECT id, similarity FROM (SELECT id, round({ERR_SIM}, 6) AS similarity FROM errors WHERE NOT resolved) WHERE similarity > 0.3 ORDER BY similarity DESC, id LIMIT 5""")
def point_to_all(spark, d):
    e = M.errors(spark, d).where(~F.col("resolved")).select("id", rd(X.trigram_similarity(F.col("message"), 'error {"k": 7} user 20')).alias("similarity"))
    return R.top(e.where("similarity > 0.3"), [F.desc("similarity"), F.asc("id")], 5)


@query("s2_3_6_disjunctive_join", f"{M.cte('entities', 'trade')} SELECT e.id, count(t.src) AS degree FROM entities e JOIN trade t ON t.src = e.id OR t.dst = e.id GROUP BY e.id")
def disjunctive(spark, d):
    return M.entities(spark, d).select("id").join(R.endpoints(M.trade(spark, d)), F.col("id") == F.col("node")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


@query("s2_3_7_anti_join", f"{M.cte('entities', 'trade')} SELECT id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM trade WHERE src = e.id) AND NOT EXISTS (SELECT 1 FROM trade WHERE dst = e.id)")
def anti_join(spark, d):
    return M.entities(spark, d).select("id").join(R.endpoints(M.trade(spark, d)), F.col("id") == F.col("node"), "left_anti")


@query("s2_3_8_semi_join", f"{M.cte('observations', 'verify_log')} SELECT id FROM observations WHERE id IN (SELECT id FROM verify_log WHERE level = 'verified')")
def semi_join(spark, d):
    return M.observations(spark, d).select("id").join(M.verify_log(spark, d).where("level = 'verified'"), "id", "left_semi")


@query("s2_3_9_cross_one_row", f"{OBS} SELECT entity, count(*) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM observations), 6) AS share FROM observations GROUP BY entity")
def cross_one_row(spark, d):
    o = M.observations(spark, d)
    total = o.agg(F.count(F.lit(1)).alias("total"))
    return o.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("entity", "n", rd(F.col("n") / F.col("total")).alias("share"))


CO = "s AS (SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events)"


@query("s2_3_10_cooccurrence", f"WITH {CO} SELECT a.event_type AS a, b.event_type AS b, count(*) AS n FROM s a JOIN s b ON a.user_id = b.user_id AND a.day = b.day AND a.event_type < b.event_type GROUP BY ALL HAVING count(*) >= 2")
def cooccurrence(spark, d):
    s = M.table(spark, d, "events").select("user_id", "event_type", F.to_date("ts").alias("day")).distinct()
    a, b = s.alias("a"), s.alias("b")
    j = a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.day") == F.col("b.day")) & (F.col("a.event_type") < F.col("b.event_type")))
    return j.groupBy(F.col("a.event_type").alias("a"), F.col("b.event_type").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2")


@query("s2_3_11_conditional_key", f"{M.cte('entities', 'trade')} SELECT t.src, t.dst, e.name FROM trade t JOIN entities e ON e.id = CASE WHEN t.bidirectional THEN t.src ELSE t.dst END")
def conditional_key(spark, d):
    t = M.trade(spark, d).withColumn("id", F.when(F.col("bidirectional"), F.col("src")).otherwise(F.col("dst")))
    return t.join(M.entities(spark, d), "id").select("src", "dst", "name")


@query("s2_3_12_vector_cross", f"""{EMB}, p AS (SELECT a.entity AS a, b.entity AS b, list_cosine_similarity(a.v, b.v) AS c FROM embedded a JOIN embedded b ON a.entity < b.entity WHERE a.entity IN ('src1','src2','src3') AND b.entity IN ('src1','src2','src3'))
 SELECT a, b, round(avg(c), 5) AS similarity FROM p GROUP BY a, b""")
def vector_cross(spark, d):
    """The mean of all pairwise cosines is the dot product of the mean unit vectors: no pairs are formed."""
    e = M.embedded(spark, d).where(F.col("entity").isin("src1", "src2", "src3")).select("entity", "v", V.norm(F.col("v")).alias("len"))
    flat = e.select("entity", "id" if "id" in e.columns else F.lit(0).alias("id"), "len", F.posexplode("v").alias("k", "x"))
    mean = flat.groupBy("entity", "k").agg(F.avg(F.col("x") / F.col("len")).alias("m"))
    a, b = mean.alias("a"), mean.alias("b")
    j = a.join(b, (F.col("a.k") == F.col("b.k")) & (F.col("a.entity") < F.col("b.entity")))
    return j.groupBy(F.col("a.entity").alias("a"), F.col("b.entity").alias("b")).agg(rd(F.sum(F.col("a.m") * F.col("b.m")), 5).alias("similarity"))


@query("s2_3_13_nearest", f"{EMB} SELECT id, round(list_cosine_similarity(v, {FIRST_VECTOR}), 6) AS cosine FROM embedded ORDER BY 2 DESC, id LIMIT 10")
def nearest(spark, d):
    return R.top(with_cosine(spark, d, M.embedded(spark, d)).select("id", rd(F.col("cosine")).alias("cosine")), [F.desc("cosine"), F.asc("id")], 10)


@query("s2_3_14_chunk_parent_max", "SELECT conv_id, max(length(text)) AS best FROM (SELECT conv_id, text FROM conversations UNION ALL SELECT doc_id, text FROM documents) GROUP BY conv_id")
def chunk_parent(spark, d):
    c = M.table(spark, d, "conversations").select("conv_id", "text").union(M.table(spark, d, "documents").select("doc_id", "text"))
    return c.groupBy("conv_id").agg(F.max(F.length("text").cast("long")).alias("best"))


@query("s2_3_15_evidence_merge", f"{M.cte('observations', 'verify_log')} SELECT id, max(s) AS similarity FROM (SELECT id, importance AS s FROM observations UNION ALL SELECT id, confidence FROM verify_log) GROUP BY id")
def evidence_merge(spark, d):
    e = M.observations(spark, d).select("id", F.col("importance").alias("s")).union(M.verify_log(spark, d).select("id", "confidence"))
    return e.groupBy("id").agg(F.max("s").alias("similarity"))


@query("s2_3_17_unique_candidate", "WITH n AS (SELECT p_partkey, p_name || p_brand || p_type AS name FROM part), u AS (SELECT name, min(p_partkey) AS k FROM n GROUP BY name HAVING count(*) = 1) SELECT n.p_partkey, u.k FROM n JOIN u USING (name)")
def unique_candidate(spark, d):
    p = M.table(spark, d, "part").select("p_partkey", F.concat("p_name", "p_brand", "p_type").alias("name"))
    u = p.groupBy("name").agg(F.min("p_partkey").alias("k"), F.count(F.lit(1)).alias("n")).where("n = 1").select("name", "k")
    return p.join(u, "name").select("p_partkey", "k")


@query("s2_6_1_top_k", f"{OBS} SELECT id, importance FROM observations ORDER BY importance DESC, id LIMIT 10")
def top_k(spark, d):
    return R.top(M.observations(spark, d), [F.desc("importance"), F.asc("id")], 10).select("id", "importance")


@query("s2_6_2_stable_order", f"{OBS} SELECT id, row_number() OVER (ORDER BY importance DESC, id) AS rank FROM observations")
def stable_order(spark, d):
    return global_rank(M.observations(spark, d).select("id", "importance"), [F.desc("importance"), F.asc("id")]).select("id", "rank")


@query("s2_6_3_nulls_last", f"{OBS} SELECT id, quality FROM observations ORDER BY quality DESC NULLS LAST, id LIMIT 50")
def nulls_last(spark, d):
    return R.top(M.observations(spark, d), [F.desc_nulls_last("quality"), F.asc("id")], 50).select("id", "quality")


@query("s2_6_4_distance_to_point", f"{M.cte('verify_log')} SELECT id, round(abs(confidence - 0.7), 6) AS distance FROM verify_log ORDER BY 2, id LIMIT 20")
def distance_to_point(spark, d):
    return R.top(M.verify_log(spark, d).select("id", rd(F.abs(F.col("confidence") - 0.7)).alias("distance")), [F.asc("distance"), F.asc("id")], 20)


@query("s2_6_5_listings", f"{OBS} SELECT id, created_at FROM observations WHERE kind = 'decision' ORDER BY created_at DESC, id LIMIT 20")
def listings(spark, d):
    return R.top(M.observations(spark, d).where("kind = 'decision'"), [F.desc("created_at"), F.asc("id")], 20).select("id", "created_at")


@query("s2_6_6_keyset_page", f"{M.cte('entities')} SELECT id, name FROM entities WHERE name > 'KENYA' ORDER BY name, id LIMIT 250")
def keyset_page(spark, d):
    """The page of 250 names after a given one."""
    return R.keyset_page(M.entities(spark, d).select("id", "name"), "name", "KENYA", 250, tie="id")


@query("s2_6_7_offset", f"{M.cte('entities')} SELECT id FROM entities ORDER BY importance DESC, id LIMIT 10 OFFSET 20")
def offset(spark, d):
    return M.entities(spark, d).orderBy(F.desc("importance"), "id").offset(20).limit(10).select("id")


@query("s2_7_1_union_all_degree", f"{M.cte('trade')} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM trade UNION ALL SELECT dst FROM trade) GROUP BY node")
def union_all(spark, d):
    t = M.trade(spark, d)
    return t.select(F.col("src").alias("node")).union(t.select("dst")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


LEGS = f"""{M.cte('entities', 'observations', 'errors')}, legs AS (
 (SELECT 0 AS leg, id, importance AS score FROM entities ORDER BY score DESC, id LIMIT 20)
 UNION ALL (SELECT 1, id::VARCHAR, importance FROM observations ORDER BY importance DESC, id::VARCHAR LIMIT 20)
 UNION ALL (SELECT 2, id::VARCHAR, synapse_weight / 10 FROM errors ORDER BY synapse_weight / 10 DESC, id::VARCHAR LIMIT 20))"""


def ranked_legs(spark, d, k: int = 20):
    parts = [
        M.entities(spark, d).select(F.lit(0).alias("leg"), "id", F.col("importance").alias("score")),
        M.observations(spark, d).select(F.lit(1).alias("leg"), F.col("id").cast("string").alias("id"), F.col("importance").alias("score")),
        M.errors(spark, d).select(F.lit(2).alias("leg"), F.col("id").cast("string").alias("id"), (F.col("synapse_weight") / 10).alias("score")),
    ]
    tops = [R.top(p, [F.desc("score"), F.asc("id")], k) for p in parts]
    return tops[0].union(tops[1]).union(tops[2])


@query("s2_7_2_leg_concatenation", f"{LEGS} SELECT id, leg, row_number() OVER (ORDER BY leg, score DESC, id) AS rank FROM legs")
def leg_concatenation(spark, d):
    return ranked_legs(spark, d).select("id", "leg", F.row_number().over(Window.orderBy("leg", F.desc("score"), "id")).cast("long").alias("rank"))


@query("s2_7_3_vector_leg_append", f"""{EMB}, legs AS ((SELECT 0 AS leg, id, round(list_cosine_similarity(v, {FIRST_VECTOR}), 6) AS score FROM embedded WHERE kind <> 'error' ORDER BY score DESC, id LIMIT 20)
 UNION ALL (SELECT 1, id, round(list_cosine_similarity(v, {FIRST_VECTOR}), 6) AS s FROM embedded WHERE kind = 'error' ORDER BY s DESC, id LIMIT 20)) SELECT id, row_number() OVER (ORDER BY leg, score DESC, id) AS rank FROM legs""")
def vector_append(spark, d):
    e = with_cosine(spark, d, M.embedded(spark, d)).select("id", "kind", rd(F.col("cosine")).alias("score"))
    order = [F.desc("score"), F.asc("id")]
    legs = R.top(e.where("kind <> 'error'").select(F.lit(0).alias("leg"), "id", "score"), order, 20).union(R.top(e.where("kind = 'error'").select(F.lit(1).alias("leg"), "id", "score"), order, 20))
    return legs.select("id", F.row_number().over(Window.orderBy("leg", *order)).cast("long").alias("rank"))


@query("s2_7_4_global_sort", f"{LEGS} SELECT id, row_number() OVER (ORDER BY score DESC, leg, id) AS rank FROM legs")
def global_sort(spark, d):
    return ranked_legs(spark, d).select("id", F.row_number().over(Window.orderBy(F.desc("score"), "leg", "id")).cast("long").alias("rank"))


@query("s2_7_5_first_wins", f"""{OBS}, u AS (SELECT 0 AS p, id, lower(entity) || left(content, 240) AS k, importance FROM observations WHERE session = 3
 UNION ALL SELECT 1, id, lower(entity) || left(content, 240), importance FROM observations WHERE kind = 'decision' UNION ALL SELECT 2, id, lower(entity) || left(content, 240), importance FROM observations WHERE importance > 0.9),
 f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY k ORDER BY p, importance DESC, id) = 1) SELECT id, p FROM f ORDER BY p, importance DESC, id LIMIT 15""")
def first_wins(spark, d):
    o = M.observations(spark, d).select("id", "importance", "kind", "session", F.concat(F.lower("entity"), X.cut(F.col("content"), 240)).alias("k"))
    u = o.where("session = 3").withColumn("p", F.lit(0)).union(o.where("kind = 'decision'").withColumn("p", F.lit(1))).union(o.where("importance > 0.9").withColumn("p", F.lit(2)))
    first = R.newest_per(u, ["k"], [F.asc("p"), F.desc("importance"), F.asc("id")], 1)
    return R.top(first, [F.asc("p"), F.desc("importance"), F.asc("id")], 15).select("id", "p")


@query("s2_7_6_timeline", f"{M.cte('observations', 'errors')} SELECT 'note' AS what, id, created_at FROM observations UNION ALL SELECT 'error', id, created_at FROM errors")
def timeline(spark, d):
    return M.observations(spark, d).select(F.lit("note").alias("what"), "id", "created_at").union(M.errors(spark, d).select(F.lit("error"), "id", "created_at")).orderBy("created_at", "what", "id")


@query("s2_7_7_type_silos", f"""{M.cte('entities', 'trade')}, k AS (SELECT DISTINCT etype FROM entities), seen AS (SELECT DISTINCT least(a.etype, b.etype) AS a, greatest(a.etype, b.etype) AS b FROM trade JOIN entities a ON src = a.id JOIN entities b ON dst = b.id)
 SELECT x.etype AS a, y.etype AS b FROM k x JOIN k y ON x.etype < y.etype WHERE NOT EXISTS (SELECT 1 FROM seen WHERE a = x.etype AND b = y.etype)""")
def silos(spark, d):
    return R.missing_pairs(M.entities(spark, d), M.trade(spark, d), "etype")


@query("s2_7_8_token_sets", f"SELECT a.item_id AS a, b.item_id AS b, len(list_intersect({tok('a.text')}, {tok('b.text')})) AS shared, len(list_distinct(list_concat({tok('a.text')}, {tok('b.text')}))) AS total FROM benchmark a JOIN benchmark b ON a.item_id + 1 = b.item_id")
def token_sets(spark, d):
    b = M.table(spark, d, "benchmark").select("item_id", X.tokens(F.col("text")).alias("t"))
    x, y = b.alias("x"), b.withColumn("before", F.col("item_id") - 1).alias("y")
    return x.join(y, F.col("x.item_id") == F.col("y.before")).select(F.col("x.item_id").alias("a"), F.col("y.item_id").alias("b"), F.size(F.array_intersect("x.t", "y.t")).cast("long").alias("shared"), F.size(F.array_union("x.t", "y.t")).cast("long").alias("total"))
