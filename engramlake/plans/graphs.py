"""Graph operators as named queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from engramlake.operators import graph as G
from engramlake.operators import relational as R
from engramlake.plans import model as M
from engramlake.plans.registry import query
from engramlake.plans.relational import gram, rd, sim

TRADE = M.cte("trade")
ENT = M.cte("entities", "trade")


def walk(depth: int, keep: str = "") -> str:
    return f"""w AS (SELECT dst AS node, 1 AS depth, strength AS s, strength AS p, [src, dst] AS path FROM trade WHERE src = 'n:4'
 UNION ALL SELECT t.dst, w.depth + 1, t.strength, w.p * t.strength, list_append(w.path, t.dst) FROM w JOIN trade t ON t.src = w.node WHERE w.depth < {depth}{keep})"""


@query("s2_10_1_traverse", f"{TRADE}, {walk(3)} SELECT node, depth, s AS strength FROM w ORDER BY depth, s DESC, node LIMIT 50")
def traverse(spark, d):
    return G.traverse(M.trade(spark, d), "n:4", 3)


@query("s2_10_2_infer", f"{TRADE}, {walk(3)} SELECT node, depth, round(p, 8) AS strength FROM w WHERE depth > 1 ORDER BY 3 DESC, depth, node LIMIT 20")
def infer(spark, d):
    return G.infer(M.trade(spark, d), "n:4", 3)


@query("s2_10_3_explain", f"""{ENT}, w AS (SELECT src AS node, 1 AS depth, strength AS p, [dst, src] AS path FROM trade WHERE dst = 'n:2' AND rtype IN ('causes', 'related_to', 'depends_on')
 UNION ALL SELECT t.src, w.depth + 1, w.p * t.strength, list_append(w.path, t.src) FROM w JOIN trade t ON t.dst = w.node WHERE w.depth < 3 AND rtype IN ('causes', 'related_to', 'depends_on') AND NOT list_contains(w.path, t.src))
 SELECT e.name, w.depth, array_to_string(w.path, '>') AS path, round(w.p * e.importance, 8) AS plausibility FROM w JOIN entities e ON e.id = w.node""")
def explain(spark, d):
    causal = M.trade(spark, d).where(F.col("rtype").isin("causes", "related_to", "depends_on"))
    p = G.paths(causal, F.col("x") == "n:2", 3, reverse=True)
    e = M.entities(spark, d)
    return p.join(e, p.node == e.id).select("name", "depth", F.array_join("path", ">").alias("path"), F.round(F.col("strength") * F.col("importance"), 8).alias("plausibility"))


UNDIR = "u AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, strength AS w FROM trade WHERE src <> dst UNION ALL SELECT dst, src, strength FROM trade WHERE src <> dst) GROUP BY ALL)"


@query("s2_10_4_spreading_activation", f"""{TRADE}, {UNDIR}, a0 AS (SELECT 'n:1' AS node, 1.0::DOUBLE AS a),
 a1 AS (SELECT node, max(a) AS a FROM (SELECT * FROM a0 UNION ALL SELECT dst, a * 0.85::DOUBLE * least(1.0::DOUBLE, greatest(0.01::DOUBLE, w)) FROM a0 JOIN u ON src = node) GROUP BY node),
 a2 AS (SELECT node, max(a) AS a FROM (SELECT * FROM a1 UNION ALL SELECT dst, a * 0.85::DOUBLE * least(1.0::DOUBLE, greatest(0.01::DOUBLE, w)) FROM a1 JOIN u ON src = node) GROUP BY node) SELECT node, round(a, 8) AS activation FROM a2""")
def activation(spark, d):
    seeds = spark.range(1).select(F.lit("n:1").alias("node"))
    return G.activate(M.trade(spark, d), seeds).select("node", F.round("a", 8).alias("activation"))


SUP = M.cte("supplies")
BOTH = "b AS (SELECT 's' || src AS x, 'p' || dst AS y FROM supplies UNION ALL SELECT 'p' || dst, 's' || src FROM supplies)"


def bipartite(spark, d):
    s = M.supplies(spark, d)
    return s.select(F.concat(F.lit("s"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("dst").cast("string")).alias("dst"), "strength")


@query("s2_10_5_link_prediction", f"""{SUP}, {BOTH}, deg AS (SELECT x, count(*) AS n FROM b GROUP BY x), near AS (SELECT DISTINCT y FROM b WHERE x = 's1'), two AS (SELECT DISTINCT near.y AS via, b.y AS c FROM near JOIN b ON b.x = near.y WHERE b.y <> 's1' AND b.y NOT IN (SELECT y FROM near))
 SELECT c AS candidate, round(sum(1 / ln(2 + n)), 6) AS score FROM two JOIN deg ON deg.x = via GROUP BY c""")
def link_prediction(spark, d):
    return G.predict_links(bipartite(spark, d), "s1").select("candidate", rd(F.col("score")).alias("score"))


def rank_sql(share: str, n: int = 20) -> str:
    """Power iteration, one relation a round."""
    out = f"""{TRADE}, e AS (SELECT src, dst, sum(strength) AS s FROM trade GROUP BY ALL), o AS (SELECT src, sum(s) AS t FROM e GROUP BY src), p AS MATERIALIZED (SELECT e.src, dst, s / t AS p FROM e JOIN o ON e.src = o.src WHERE t > 0),
 nodes AS MATERIALIZED (SELECT node, node NOT IN (SELECT src FROM p) AS dangling, {share} AS share FROM (SELECT src AS node FROM e UNION SELECT dst FROM e)), r0 AS MATERIALIZED (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM nodes) AS rank FROM nodes)"""
    for k in range(n):
        out += f""", r{k + 1} AS MATERIALIZED (SELECT n.node, 0.15::DOUBLE * share + 0.85::DOUBLE * (coalesce(g.got, 0) + share * (SELECT coalesce(sum(rank) FILTER (dangling), 0) FROM r{k} JOIN nodes USING (node))) AS rank
 FROM nodes n LEFT JOIN (SELECT dst AS node, sum(rank * p) AS got FROM r{k} JOIN p ON src = node GROUP BY dst) g ON n.node = g.node)"""
    return out


EVERY = rank_sql("1.0::DOUBLE / (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e))")
SEEDED = rank_sql("CASE WHEN node IN ('n:1', 'n:2') THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END")
NORMAL = "z AS (SELECT node, (rank - (SELECT min(rank) FROM r20)) / ((SELECT max(rank) FROM r20) - (SELECT min(rank) FROM r20)) AS rank FROM r20)"


@query("s2_10_6_pagerank", f"{EVERY}, {NORMAL} SELECT node, round(rank, 6) AS rank FROM z")
def pagerank(spark, d):
    return G.normalised(G.page_rank(M.trade(spark, d))).select("node", rd(F.col("rank")).alias("rank"))


@query("s2_10_7_personalised_pagerank", f"{SEEDED} SELECT node, round(rank, 6) AS rank FROM r20")
def personalised(spark, d):
    return G.page_rank(M.trade(spark, d), seeds=["n:1", "n:2"]).select("node", rd(F.col("rank")).alias("rank"))


@query("s2_10_8_importance_blend", f"{EVERY.replace(TRADE, ENT, 1)}, {NORMAL} SELECT id, round(0.3 * rank + 0.7 * importance, 6) AS importance, round(least(1.0, 0.75 * rank), 6) AS energy FROM z JOIN entities ON id = node")
def blend(spark, d):
    r = G.normalised(G.page_rank(M.trade(spark, d)))
    e = M.entities(spark, d).join(r, F.col("id") == F.col("node"))
    return e.select("id", rd(0.3 * F.col("rank") + 0.7 * F.col("importance")).alias("importance"), rd(F.least(F.lit(1.0), 0.75 * F.col("rank"))).alias("energy"))


def places(spark, d):
    """Suppliers to their nations, nations to their regions, and the trade between nations."""
    s, n = M.table(spark, d, "supplier"), M.table(spark, d, "nation")
    key = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    within = s.select(key("s:", "s_suppkey").alias("src"), key("n:", "s_nationkey").alias("dst"))
    within = within.union(n.select(key("n:", "n_nationkey"), key("r:", "n_regionkey")))
    return within.union(M.trade(spark, d).select("src", "dst"))


@query("s2_10_9_betweenness")
def betweenness(spark, d):
    # sums of doubles differ in their last digits by the order of tasks, which must not break ties
    return R.top(G.betweenness(places(spark, d)).where("score > 0"), [F.desc(F.round("score", 12)), F.asc("node")], 10).select("node", rd(F.col("score")).alias("score"))


def bfs_sql(depth: int = 25) -> str:
    return f"""{TRADE}, e AS MATERIALIZED (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade WHERE bidirectional), w AS (SELECT DISTINCT src AS source, src AS node, 0 AS d FROM e
 UNION SELECT w.source, e.dst, w.d + 1 FROM w JOIN e ON e.src = w.node WHERE w.d < {depth}), s AS (SELECT source, node, min(d) AS d FROM w GROUP BY ALL)"""


@query("s2_10_10_closeness", f"{bfs_sql()} SELECT source AS node, round(coalesce(sum(1.0::DOUBLE / d) FILTER (d > 0), 0), 6) AS harmonic, round(coalesce(count(*) FILTER (d > 0) / (sum(d) FILTER (d > 0))::DOUBLE, 0), 6) AS closeness FROM s GROUP BY source")
def closeness(spark, d):
    return G.closeness(M.trade(spark, d)).select("node", rd(F.col("harmonic")).alias("harmonic"), rd(F.col("closeness")).alias("closeness"))


@query("s2_10_11_core_numbers")
def core_numbers(spark, d):
    return G.core_numbers(M.trade(spark, d))


@query("s2_10_12_communities")
def communities(spark, d):
    return G.communities(M.trade(spark, d))


@query("s2_10_13_components", f"""{TRADE}, e AS MATERIALIZED (SELECT src, dst FROM trade WHERE strength > 0.68 UNION SELECT dst, src FROM trade WHERE strength > 0.68), w AS (SELECT DISTINCT src AS node, src AS c FROM e UNION SELECT e.dst, w.c FROM w JOIN e ON e.src = w.node)
 SELECT node, min(c) AS component FROM w GROUP BY node""")
def components(spark, d):
    return G.connected(M.trade(spark, d).where("strength > 0.68"))


@query("s2_10_14_autolink", """WITH s AS (SELECT DISTINCT l_orderkey AS session, l_partkey AS entity FROM lineitem), c AS (SELECT entity, count(*) AS c FROM s GROUP BY 1), t AS (SELECT count(DISTINCT session) AS t FROM s),
 known AS (SELECT DISTINCT x.l_partkey AS a, y.l_partkey AS b FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_suppkey = y.l_suppkey AND x.l_partkey < y.l_partkey),
 p AS (SELECT x.entity AS a, y.entity AS b, count(*) AS n FROM s x JOIN s y ON x.session = y.session AND x.entity < y.entity GROUP BY ALL HAVING count(*) >= 2),
 z AS (SELECT a, b, n, CASE WHEN n < t THEN ln((n / t) / ((ca.c / t) * (cb.c / t))) / -ln(n / t) END AS v FROM (SELECT * FROM p ANTI JOIN known USING (a, b)) p JOIN c ca ON ca.entity = a JOIN c cb ON cb.entity = b, t) SELECT a, b, n, round(v, 6) AS npmi FROM z WHERE v >= 0.3""")
def autolink(spark, d):
    """Parts that orders mention together; parts that one supplier sold in one order are linked already."""
    l = M.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session"), F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("supplier"))
    x, y = l.alias("x"), l.alias("y")
    one = (F.col("x.session") == F.col("y.session")) & (F.col("x.supplier") == F.col("y.supplier")) & (F.col("x.entity") < F.col("y.entity"))
    known = x.join(y, one).select(F.col("x.entity").alias("src"), F.col("y.entity").alias("dst"))
    return G.autolink(l.select("session", "entity").distinct(), known).select("a", "b", "n", rd(F.col("npmi")).alias("npmi"))


@query("s2_10_15_path_pruning", f"""{TRADE}, p AS (SELECT dst AS node, 1 AS depth, strength AS s, [src, dst] AS path FROM trade
  UNION ALL SELECT t.dst, p.depth + 1, p.s * t.strength, list_append(p.path, t.dst) FROM p JOIN trade t ON t.src = p.node WHERE p.depth < 3 AND NOT list_contains(p.path, t.dst)),
 o AS (SELECT path[1] AS start, array_to_string(path, '>') AS id, len(path)::INT AS n_nodes, round(s / (1 + depth), 8) AS score FROM p),
 r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY start ORDER BY score DESC, id) AS n FROM o),
 w AS (SELECT start, id, n_nodes, score, n, n_nodes AS used, 1 AS kept FROM r WHERE n = 1
  UNION ALL SELECT r.start, r.id, r.n_nodes, r.score, r.n, w.used + r.n_nodes, w.kept + 1 FROM w JOIN r ON r.start = w.start AND r.n > w.n AND w.used + r.n_nodes <= 20 WHERE w.kept < 5 QUALIFY row_number() OVER (PARTITION BY w.start ORDER BY r.n) = 1)
 SELECT start, id, n_nodes, score FROM w""")
def path_pruning(spark, d):
    p = G.paths(M.trade(spark, d), F.lit(True), 3)
    scored = p.select(F.element_at("path", 1).alias("start"), F.array_join("path", ">").alias("id"), F.size("path").alias("n_nodes"), rd(F.col("strength") / (1 + F.col("depth")), 8).alias("score"))
    return G.prune_paths(scored, "start")


@query("s2_10_16_visited_bfs", f"{bfs_sql()} SELECT node, min(d) AS d FROM (SELECT node, d FROM s WHERE source = 'n:1' UNION ALL SELECT 'n:1', 0) GROUP BY node")
def visited(spark, d):
    t = M.trade(spark, d)
    e = t.select("src", "dst").union(t.where("bidirectional").select("dst", "src"))
    return G.distances(e, spark.range(1).select(F.lit("n:1").alias("node"))).select("node", "d")


@query("s2_10_17_under_connected", f"{ENT}, g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1) SELECT id, coalesce(n, 0) AS degree FROM entities LEFT JOIN g ON node = id WHERE importance > 0.4 AND coalesce(n, 0) < 3")
def under_connected(spark, d):
    g = R.endpoints(M.trade(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    e = M.entities(spark, d).where("importance > 0.4")
    return e.join(g, e.id == g.node, "left").select("id", F.coalesce("n", F.lit(0)).alias("degree")).where("degree < 3")


@query("s2_10_18_bridges", f"{TRADE}, g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1) SELECT node, degree FROM g WHERE degree > 2 ORDER BY degree DESC, node LIMIT 10")
def bridges(spark, d):
    g = R.endpoints(M.trade(spark, d)).groupBy("node").agg(F.count(F.lit(1)).alias("degree")).where("degree > 2")
    return R.top(g, [F.desc("degree"), F.asc("node")], 10)


@query("s2_10_19_merge_groups", f"""WITH RECURSIVE g AS (SELECT s_suppkey AS id, {gram('s_name')} AS t FROM supplier), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM g a JOIN g b ON a.id <> b.id AND {sim('a.t', 'b.t')} > 0.75),
 w AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.node) SELECT node, min(c) AS component FROM w GROUP BY node""")
def merge_groups(spark, d):
    names = M.table(spark, d, "supplier").select("s_suppkey", "s_name")
    pairs = R.similar_links(names, "s_suppkey", "s_name", 0.75)
    return G.merge_groups(pairs)


@query("s2_10_20_neighbourhood", f"{TRADE} SELECT 'out' AS way, dst AS other, rtype, strength FROM trade WHERE src = 'n:1' UNION ALL SELECT 'in', src, rtype, strength FROM trade WHERE dst = 'n:1'")
def neighbourhood(spark, d):
    t = M.trade(spark, d)
    return t.where("src = 'n:1'").select(F.lit("out").alias("way"), F.col("dst").alias("other"), "rtype", "strength").union(t.where("dst = 'n:1'").select(F.lit("in"), "src", "rtype", "strength"))


@query("s2_9_14_expansion_by_rank", f"{SEEDED} SELECT node, round(rank, 6) AS rank FROM r20 WHERE node NOT IN ('n:1', 'n:2') ORDER BY round(rank, 6) DESC, node LIMIT 3")
def rank_expansion(spark, d):
    r = G.page_rank(M.trade(spark, d), seeds=["n:1", "n:2"]).select("node", rd(F.col("rank")).alias("rank"))
    return R.top(r.where(~F.col("node").isin("n:1", "n:2")), [F.desc("rank"), F.asc("node")], 3)
