"""Aggregations and windows as named queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from engramlake.functions import scores as S
from engramlake.functions import text as X
from engramlake.operators import relational as R
from engramlake.operators import stats as T
from engramlake.operators.ordering import rank_within
from engramlake.plans import model as M
from engramlake.plans.registry import query
from engramlake.plans.relational import rd, tok

OBS = M.cte("observations")
LOG = M.cte("verify_log")
ERR = M.cte("errors")
NOW = f"TIMESTAMP '{M.NOW}'"


@query("s2_4_1_corpus_summary", f"""{M.cte('observations', 'entities', 'trade', 'errors')} SELECT (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM observations) AS observations, (SELECT count(*) FROM trade) AS relations,
 (SELECT count(*) FROM errors) AS errors, (SELECT count(DISTINCT session) FROM observations) AS sessions, (SELECT count(*) FROM conversations) AS episodes, 50 * ((SELECT count(*) FROM observations) + (SELECT count(*) FROM conversations)) AS tokens""")
def corpus_summary(spark, d):
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    o = M.observations(spark, d)
    out = one(M.entities(spark, d), "entities").crossJoin(one(o, "observations")).crossJoin(one(M.trade(spark, d), "relations"))
    out = out.crossJoin(one(M.errors(spark, d), "errors")).crossJoin(one(o.select("session").distinct(), "sessions")).crossJoin(one(M.table(spark, d, "conversations"), "episodes"))
    return out.withColumn("tokens", 50 * (F.col("observations") + F.col("episodes")))


@query("s2_4_2_active_stats", f"{OBS} SELECT count(*) AS total, count(*) FILTER (kind = 'superseded') AS superseded, count(*) FILTER (kind <> 'superseded') AS active FROM observations")
def active_stats(spark, d):
    k = F.col("kind")
    return M.observations(spark, d).agg(F.count(F.lit(1)).alias("total"), F.count_if(k == "superseded").alias("superseded"), F.count_if(k != "superseded").alias("active"))


@query("s2_4_3_group_counts", f"{M.cte('observations', 'entities')} SELECT kind AS what, count(*) AS n FROM observations GROUP BY kind UNION ALL SELECT etype, count(*) FROM entities GROUP BY etype")
def group_counts(spark, d):
    n = F.count(F.lit(1)).alias("n")
    return M.observations(spark, d).groupBy(F.col("kind").alias("what")).agg(n).union(M.entities(spark, d).groupBy("etype").agg(n))


@query("s2_4_4_filtered_counts", f"{OBS} SELECT entity, count(*) FILTER (kind = 'decision') AS decisions, count(*) FILTER (kind = 'lesson') AS lessons FROM observations GROUP BY entity")
def filtered_counts(spark, d):
    k = F.col("kind")
    return M.observations(spark, d).groupBy("entity").agg(F.count_if(k == "decision").alias("decisions"), F.count_if(k == "lesson").alias("lessons"))


@query("s2_4_5_distinct_counts", f"{OBS} SELECT entity, count(DISTINCT session) AS sessions, count(DISTINCT kind) AS kinds FROM observations GROUP BY entity")
def distinct_counts(spark, d):
    return M.observations(spark, d).groupBy("entity").agg(F.countDistinct("session").alias("sessions"), F.countDistinct("kind").alias("kinds"))


@query("s2_4_6_having", f"{OBS} SELECT entity, count(*) AS n FROM observations WHERE kind NOT IN ('superseded', 'tool_usage') GROUP BY entity HAVING count(*) >= 40 ORDER BY n DESC, entity LIMIT 20")
def having(spark, d):
    g = M.observations(spark, d).where(~F.col("kind").isin("superseded", "tool_usage")).groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where("n >= 40")
    return R.top(g, [F.desc("n"), F.asc("entity")], 20)


@query("s2_4_7_health", f"""{OBS} SELECT round(avg(importance), 6) AS avg_importance, count(*) FILTER ({NOW} - last_accessed > INTERVAL 20 DAYS) AS stale, count(*) FILTER (access_count = 0) AS unused,
 count(*) FILTER (id NOT IN (SELECT vec_id FROM embeddings)) AS null_embeddings FROM observations""")
def health(spark, d):
    e = M.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.lit(True).alias("has"))
    o = M.observations(spark, d).join(e, "id", "left")
    return o.agg(rd(F.avg("importance")).alias("avg_importance"), F.count_if(F.col("last_accessed") < M.now() - F.expr("INTERVAL 20 DAYS")).alias("stale"),
                 F.count_if(F.col("access_count") == 0).alias("unused"), F.count_if(F.col("has").isNull()).alias("null_embeddings"))


def ent(n: str = "n") -> str:
    return f"log2(sum({n})) - sum({n} * log2({n})) / sum({n})"


@query("s2_4_8_entropy", f"""{OBS}, c AS (SELECT kind, count(*) AS n FROM observations GROUP BY kind), e AS (SELECT entity, count(*) AS n FROM observations GROUP BY entity),
 h AS (SELECT 'kind' AS what, {ent()} AS entropy, count(*) AS k FROM c UNION ALL SELECT 'entity', {ent()}, count(*) FROM e)
 SELECT what, round(entropy, 6) AS entropy, round(entropy / greatest(log2(k), 0.001), 6) AS diversity FROM h""")
def entropy(spark, d):
    o = M.observations(spark, d)
    parts = [T.entropy(o.groupBy(c).agg(F.count(F.lit(1)).alias("n"))).select(F.lit(c).alias("what"), "entropy", "k") for c in ("kind", "entity")]
    u = parts[0].union(parts[1])
    return u.select("what", rd(F.col("entropy")).alias("entropy"), rd(F.col("entropy") / F.greatest(F.log2("k"), F.lit(0.001))).alias("diversity"))


@query("s2_4_9_resolution", f"{ERR} SELECT round(count(*) FILTER (resolved) / count(*), 6) AS rate, round(avg(epoch(resolved_at) - epoch(created_at)) / 60, 1) AS mttr_minutes FROM errors")
def resolution(spark, d):
    e = M.errors(spark, d)
    took = F.timestamp_diff("MICROSECOND", F.col("created_at"), F.col("resolved_at")) / 1e6
    return e.agg(rd(F.count_if(F.col("resolved")) / F.count(F.lit(1))).alias("rate"), F.round(F.avg(took) / 60, 1).alias("mttr_minutes"))


CUT = "TIMESTAMP '2024-01-24'"


@query("s2_4_10_drift", f"""{ERR}, a AS (SELECT error_type, count(*) AS o FROM errors WHERE created_at > {CUT} GROUP BY 1), b AS (SELECT error_type, count(*) / 4.0::DOUBLE AS e FROM errors WHERE created_at <= {CUT} GROUP BY 1),
 c AS (SELECT sum(power(o - e, 2) / e) AS chi2, greatest(count(*) - 1, 1) AS df FROM a JOIN b USING (error_type)), z AS (SELECT *, (power(chi2 / df, 1 / 3.0::DOUBLE) - (1 - 2 / (9.0::DOUBLE * df))) / sqrt(2 / (9.0::DOUBLE * df)) / sqrt(2.0::DOUBLE) AS x FROM c),
 t AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(x)) AS t FROM z), r AS (SELECT *, t * (0.254829592::DOUBLE + t * (-0.284496736::DOUBLE + t * (1.421413741::DOUBLE + t * (-1.453152027::DOUBLE + t * 1.061405429::DOUBLE)))) * exp(-x * x) AS r FROM t)
 SELECT round(chi2, 4) AS chi2, df, round(0.5 * CASE WHEN x >= 0 THEN r ELSE 2 - r END, 6) AS p FROM r""")
def drift(spark, d):
    e = M.errors(spark, d)
    cut = F.lit("2024-01-24").cast("timestamp")
    return T.drift(e.where(F.col("created_at") > cut), e.where(F.col("created_at") <= cut), "error_type").select(rd(F.col("chi2"), 4).alias("chi2"), "df", rd(F.col("p")).alias("p"))


@query("s2_4_11_density_anomalies", f"""WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), s AS (SELECT avg(n) AS m, greatest(stddev_pop(n), 1) AS sd FROM c)
 SELECT user_id, round((n - m) / sd, 6) AS z FROM c, s WHERE abs((n - m) / sd) > 2""")
def density_anomalies(spark, d):
    c = M.table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    s = c.agg(F.avg("n").alias("m"), F.greatest(F.stddev_pop("n"), F.lit(1.0)).alias("sd"))
    z = (F.col("n") - F.col("m")) / F.col("sd")
    return c.crossJoin(F.broadcast(s)).where(F.abs(z) > 2).select("user_id", rd(z).alias("z"))


@query("s2_4_12_observation_gaps", f"{OBS} SELECT entity, count(*) FILTER (kind = 'decision') = 0 AS no_decision, count(*) FILTER (kind = 'lesson') = 0 AS no_lesson FROM observations GROUP BY entity HAVING count(*) FILTER (kind = 'fact') > 3 AND (count(*) FILTER (kind = 'decision') = 0 OR count(*) FILTER (kind = 'lesson') = 0)")
def gaps(spark, d):
    k = F.col("kind")
    g = M.observations(spark, d).groupBy("entity").agg(F.count_if(k == "fact").alias("f"), (F.count_if(k == "decision") == 0).alias("no_decision"), (F.count_if(k == "lesson") == 0).alias("no_lesson"))
    return g.where("f > 3 AND (no_decision OR no_lesson)").drop("f")


BIN = "least(floor(confidence * 10), 9)::INTEGER"


@query("s2_4_13_reliability", f"{LOG} SELECT {BIN} AS bin, count(*) AS n, round(avg(confidence), 6) AS confidence, round(avg(correct), 6) AS accuracy FROM verify_log GROUP BY 1")
def reliability(spark, d):
    return T.reliability(M.verify_log(spark, d), "confidence", "correct").select("bin", "n", rd(F.col("confidence")).alias("confidence"), rd(F.col("accuracy")).alias("accuracy"))


@query("s2_4_13_calibration_error", f"""{LOG}, b AS (SELECT {BIN} AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM verify_log GROUP BY 1)
 SELECT (SELECT round(avg(power(confidence - correct, 2)), 6) FROM verify_log) AS brier, round(sum(n * abs(c - a)) / sum(n), 6) AS ece, sum(n)::BIGINT AS n FROM b""")
def calibration(spark, d):
    return T.calibration_error(M.verify_log(spark, d), "confidence", "correct").select(rd(F.col("brier")).alias("brier"), rd(F.col("ece")).alias("ece"), "n")


@query("s2_4_14_grounding_calibration", f"{LOG} SELECT level, round((sum(correct) + 1) / (count(*) + 2.0), 6) AS calibrated FROM verify_log GROUP BY level")
def grounding_calibration(spark, d):
    return M.verify_log(spark, d).groupBy("level").agg(rd((F.sum("correct") + 1) / (F.count(F.lit(1)) + 2)).alias("calibrated"))


@query("s2_4_15_source_trust", f"""{LOG}, s AS (SELECT entity, 1.0::DOUBLE + sum(correct) AS a, 1.0::DOUBLE + count(*) - sum(correct) AS b FROM verify_log GROUP BY entity)
 SELECT entity, round(a / (a + b), 6) AS trust, round(a * b / ((a + b) * (a + b) * (a + b + 1)), 8) AS variance, round(least(1.0, 2 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))), 6) AS width FROM s""")
def source_trust(spark, d):
    s = M.verify_log(spark, d).groupBy("entity").agg((1.0 + F.sum("correct")).alias("a"), (1.0 + F.count(F.lit(1)) - F.sum("correct")).alias("b"))
    mean, var, width = S.beta_posterior(F.col("a"), F.col("b"))
    return s.select("entity", rd(mean).alias("trust"), rd(var, 8).alias("variance"), rd(width).alias("width"))


def wilson(k: str, n: str) -> str:
    p = f"({k} / {n}::DOUBLE)"
    return f"CASE WHEN {n} <= 0 THEN 0.0 ELSE least(1.0, greatest(0.0, ({p} + 3.8416 / (2 * {n}) - 1.96 * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n}))) / (1 + 3.8416 / {n}))) END"


@query("s2_4_16_wilson", f"{M.cte('procedures')} SELECT id, round({wilson('success', '(success + failure)')}, 6) AS bound FROM procedures")
def wilson_bound(spark, d):
    return M.procedures(spark, d).select("id", rd(S.wilson_lower(F.col("success"), F.col("success") + F.col("failure"))).alias("bound"))


PRICES = "v AS (SELECT round(o_totalprice, 2) AS x FROM orders), s AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM v)"


@query("s2_4_17_quantiles", f"""WITH {PRICES} SELECT max(x) FILTER (r = round((n - 1) * 0.9) + 1) AS nearest, round((SELECT quantile_cont(x, 0.977) FROM v), 4) AS linear,
 max(x) FILTER (r = least(greatest(ceil((n + 1) * 0.95), 1), n)) AS conformal FROM s""")
def quantiles(spark, d):
    v = M.table(spark, d, "orders").select(F.round("o_totalprice", 2).alias("x"))
    linear = v.agg(rd(F.percentile("x", 0.977), 4).alias("linear"))
    return T.at_rank(v, "x", [("nearest", T.nearest_rank(0.9)), ("conformal", T.conformal_rank(0.05))]).crossJoin(linear)


@query("s2_4_18_shrunk_covariance")
def shrunk_covariance(spark, d):
    m = T.fit_outliers(M.table(spark, d, "embeddings"), "embedding")
    return spark.range(1).select(F.lit(m.n).alias("n"), F.lit(m.shrinkage).alias("shrinkage"), F.lit(float(m.inverse.trace())).alias("trace"))


@query("s2_4_19_outliers")
def outliers(spark, d):
    e = M.table(spark, d, "embeddings")
    m = T.fit_outliers(e, "embedding")
    far = T.outlier_distance(m)
    return e.select("vec_id", far(F.col("embedding")).alias("distance")).withColumn("outlier", F.col("distance") > T.outlier_threshold(len(m.mean)))


def pickr(q: float) -> str:
    return f"max(x) FILTER (r = round((n - 1) * {q}) + 1)"


@query("s2_4_20_distribution", f"WITH {PRICES} SELECT count(*) AS n, min(x) AS min, max(x) AS max, {pickr(0.5)} AS p50, {pickr(0.9)} AS p90, {pickr(0.95)} AS p95, {pickr(0.99)} AS p99 FROM s")
def distribution(spark, d):
    return T.distribution(M.table(spark, d, "orders").select(F.round("o_totalprice", 2).alias("x")), "x")


RANKED = f"""{OBS}, ranked AS (SELECT entity, id, coalesce(quality, 0) = 1 AS rel, row_number() OVER (PARTITION BY entity ORDER BY importance DESC, id) AS rank, sum(coalesce(quality, 0)) OVER (PARTITION BY entity) AS total FROM observations),
 q AS (SELECT entity, sum(CASE WHEN rel AND rank <= 10 THEN CASE WHEN rank <= 2 THEN 1.0::DOUBLE ELSE 1 / log2(rank) END ELSE 0 END) AS dcg, count(*) FILTER (rel AND rank <= 10) AS hits, count(*) FILTER (rank <= 10) AS shown,
  min(rank) FILTER (rel) AS first, max(total)::BIGINT AS total FROM ranked GROUP BY entity),
 m AS (SELECT entity, CASE WHEN total = 0 THEN 0.0 ELSE least(1.0, dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: CASE WHEN i <= 2 THEN 1.0::DOUBLE ELSE 1 / log2(i) END))) END AS ndcg,
  hits / shown AS precision, CASE WHEN total = 0 THEN 0.0 ELSE least(1.0, hits / total) END AS recall, coalesce(1 / first, 0.0) AS rr FROM q)"""


def ranked(spark, d):
    """Each entity is a query; its notes by importance are the ranking, labelled quality is relevance."""
    o = M.observations(spark, d).select("entity", "id", "importance", F.coalesce("quality", F.lit(0)).alias("rel"))
    total = o.groupBy("entity").agg(F.sum("rel").alias("total"))
    shown = rank_within(o, ["entity"], [F.desc("importance"), F.asc("id")])
    return shown.join(total, "entity")


def quality(spark, d):
    return T.ranking_quality(ranked(spark, d), "entity", "rank", "rel", "total")


@query("s2_4_21_ndcg", f"{RANKED} SELECT entity, round(ndcg, 6) AS ndcg FROM m")
def ndcg(spark, d):
    return quality(spark, d).select("entity", rd(F.col("ndcg")).alias("ndcg"))


@query("s2_4_22_mrr_precision_recall", f"{RANKED} SELECT round(avg(rr), 6) AS mrr, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM m")
def mrr(spark, d):
    return quality(spark, d).agg(rd(F.avg("rr")).alias("mrr"), rd(F.avg("precision")).alias("precision"), rd(F.avg("recall")).alias("recall"))


WS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: x <> ''))"


@query("s2_4_23_exact_match_f1", f"""WITH t AS (SELECT a.item_id AS id, trim(a.text) = trim(b.text) AS exact, {WS.format(c='a.text')} AS x, {WS.format(c='b.text')} AS y FROM benchmark a JOIN benchmark b ON a.item_id + 1 = b.item_id),
 i AS (SELECT *, len(list_intersect(x, y))::DOUBLE AS n FROM t) SELECT id, exact, round(CASE WHEN n = 0 THEN 0 ELSE 2 * n / (len(x) + len(y)) END, 6) AS f1 FROM i""")
def exact_match(spark, d):
    def ws(c):
        return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))

    b = M.table(spark, d, "benchmark")
    j = b.alias("a").join(b.withColumn("before", F.col("item_id") - 1).alias("b"), F.col("a.item_id") == F.col("b.before"))
    x, y = ws(F.col("a.text")), ws(F.col("b.text"))
    n = F.size(F.array_intersect(x, y))
    return j.select(F.col("a.item_id").alias("id"), (F.trim("a.text") == F.trim("b.text")).alias("exact"), rd(F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(x) + F.size(y)))).alias("f1"))


@query("s2_4_24_bootstrap")
def bootstrap(spark, d):
    rows = quality(spark, d).select("entity", "ndcg").orderBy("entity").collect()  # one score per evaluated query
    mean, low, high = T.bootstrap_interval([r.ndcg for r in rows])
    return spark.range(1).select(F.lit(mean).alias("mean"), F.lit(low).alias("low"), F.lit(high).alias("high"))


@query("s2_4_25_detectable_effect", f"{RANKED} SELECT round(2.80 * stddev_samp(ndcg) * sqrt(2.0 / count(*)), 6) AS mde, round(2.80 * stddev_samp(recall - ndcg) / sqrt(count(*)), 6) AS paired FROM m")
def detectable_effect(spark, d):
    q = quality(spark, d).withColumn("gap", F.col("recall") - F.col("ndcg"))
    a, b = T.minimum_detectable_effect(q, "ndcg"), T.minimum_detectable_effect(q, "gap", paired=True)
    return a.select(rd(F.col("mde")).alias("mde")).crossJoin(b.select(rd(F.col("mde")).alias("paired")))


@query("s2_4_26_eval_report", f"{RANKED} SELECT length(entity) AS ability, count(*) AS queries, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr FROM m GROUP BY 1")
def eval_report(spark, d):
    return quality(spark, d).groupBy(F.length("entity").cast("long").alias("ability")).agg(F.count(F.lit(1)).alias("queries"), rd(F.avg("ndcg")).alias("ndcg"), rd(F.avg("recall")).alias("recall"), rd(F.avg("rr")).alias("mrr"))


@query("s2_4_27_max_per_neighbour", f"{M.cte('trade')} SELECT CASE WHEN src = 'n:1' THEN dst ELSE src END AS other, max(strength) AS strength FROM trade WHERE src = 'n:1' OR dst = 'n:1' GROUP BY 1")
def max_per_neighbour(spark, d):
    return R.endpoints(M.trade(spark, d)).where("node = 'n:1'").groupBy("other").agg(F.max("strength").alias("strength"))


@query("s2_4_28_capped_history", f"{OBS} SELECT entity, list_slice(list(id ORDER BY created_at, id), -20, -1) AS versions FROM observations GROUP BY entity")
def capped_history(spark, d):
    newest = R.newest_per(M.observations(spark, d).select("entity", "id", "created_at"), ["entity"], [F.desc("created_at"), F.desc("id")], 20)
    s = F.array_sort(F.collect_list(F.struct("created_at", "id")))
    return newest.groupBy("entity").agg(F.transform(s, lambda x: x["id"]).alias("versions"))


TILE = f"{OBS}, t AS (SELECT *, ntile(6) OVER (PARTITION BY entity ORDER BY created_at, id) AS bucket FROM observations), b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY entity, bucket ORDER BY importance DESC, id) = 1)"


def tiles(spark, d):
    t = M.observations(spark, d).withColumn("bucket", F.ntile(6).over(Window.partitionBy("entity").orderBy("created_at", "id")))
    return R.newest_per(t, ["entity", "bucket"], [F.desc("importance"), F.asc("id")], 1)


@query("s2_4_29_ordered_string_agg", f"{TILE} SELECT entity, string_agg(left(content, 300), ' | ' ORDER BY bucket) AS notes FROM b GROUP BY entity")
def string_agg(spark, d):
    s = F.array_sort(F.collect_list(F.struct("bucket", X.cut(F.col("content"), 300).alias("c"))))
    return tiles(spark, d).groupBy("entity").agg(F.array_join(F.transform(s, lambda x: x["c"]), " | ").alias("notes"))


@query("s2_4_30_timeline_bounds", f"{OBS} SELECT entity, min(created_at) AS first, max(created_at) AS last, count(DISTINCT session) AS sessions FROM observations GROUP BY entity")
def timeline_bounds(spark, d):
    return M.observations(spark, d).groupBy("entity").agg(F.min("created_at").alias("first"), F.max("created_at").alias("last"), F.countDistinct("session").alias("sessions"))


@query("s2_4_31_counts_by_project", f"{OBS} SELECT coalesce(project, '') AS project, count(*) AS n FROM observations WHERE importance < 0.3 AND kind NOT IN ('decision', 'lesson') GROUP BY 1")
def by_project(spark, d):
    return M.observations(spark, d).where((F.col("importance") < 0.3) & ~F.col("kind").isin("decision", "lesson")).groupBy(F.coalesce("project", F.lit("")).alias("project")).agg(F.count(F.lit(1)).alias("n"))


@query("s2_4_32_session_diff", f"{OBS} SELECT session, kind, count(*) AS n FROM observations GROUP BY ALL")
def session_diff(spark, d):
    return M.observations(spark, d).groupBy("session", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("s2_4_32_reflection", f"{OBS}, l AS (SELECT id, created_at, left(content, 80) AS c FROM observations ORDER BY created_at DESC, id DESC LIMIT 12) SELECT string_agg(c, chr(10) ORDER BY created_at DESC, id DESC) AS notes FROM l")
def reflection(spark, d):
    last = R.top(M.observations(spark, d), [F.desc("created_at"), F.desc("id")], 12).select("created_at", "id", X.cut(F.col("content"), 80).alias("c"))
    s = F.reverse(F.array_sort(F.collect_list(F.struct("created_at", "id", "c"))))
    return last.agg(F.array_join(F.transform(s, lambda x: x["c"]), "\n").alias("notes"))


@query("s2_4_33_project_stats", f"{OBS} SELECT project, count(*) AS n, count(DISTINCT entity) AS entities, round(avg(importance), 6) AS importance FROM observations WHERE project IS NOT NULL GROUP BY project")
def project_stats(spark, d):
    return M.observations(spark, d).where("project IS NOT NULL").groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("entity").alias("entities"), rd(F.avg("importance")).alias("importance"))


@query("s2_5_1_top_neighbours", f"{M.cte('trade')} SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY strength DESC, dst) AS rank FROM trade WHERE src IN ('n:1', 'n:2', 'n:4') QUALIFY rank <= 5")
def top_neighbours(spark, d):
    t = M.trade(spark, d).where(F.col("src").isin("n:1", "n:2", "n:4"))
    return R.newest_per(t, ["src"], [F.desc("strength"), F.asc("dst")], 5).select("src", "dst", F.col("rank").cast("long").alias("rank"))


@query("s2_5_2_ntile_sample", f"{TILE} SELECT entity, bucket::INTEGER AS bucket, id FROM b")
def ntile_sample(spark, d):
    return tiles(spark, d).select("entity", "bucket", "id")


@query("s2_5_3_distinct_on", f"{OBS} SELECT entity, arg_max(id, {{'i': importance, 'n': -id}}) AS id FROM observations GROUP BY entity")
def distinct_on(spark, d):
    return M.observations(spark, d).groupBy("entity").agg(F.max_by("id", F.struct("importance", (-F.col("id")).alias("n"))).alias("id"))


@query("s2_5_4_retention", f"{ERR} SELECT id FROM errors QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 5")
def retention(spark, d):
    return R.newest_per(M.errors(spark, d), ["user_id"], [F.desc("created_at"), F.desc("id")], 5).select("id")


@query("s2_5_5_recent_window", f"""{OBS}, w AS (SELECT id, list(importance) OVER (PARTITION BY entity ORDER BY created_at, id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS recent FROM observations)
 SELECT id, round(least(0.98, greatest(0.80, CASE WHEN len(recent) = 0 THEN NULL ELSE list_aggregate(recent, 'quantile_cont', 0.977) END)), 6) AS reinforce FROM w WHERE len(recent) >= 5""")
def recent_window(spark, d):
    w = Window.partitionBy("entity").orderBy("created_at", "id").rowsBetween(-20, -1)
    o = M.observations(spark, d).select("id", F.array_sort(F.collect_list("importance").over(w)).alias("recent")).where(F.size("recent") >= 5)
    idx = (F.size("recent") - 1) * F.lit(0.977)
    lo = F.floor(idx).cast("int")
    at = lambda i: F.element_at("recent", i + 1)
    q = at(lo) * (1 - (idx - lo)) + at(F.least(lo + 1, F.size("recent") - 1)) * (idx - lo)
    return o.select("id", rd(S.clamp(q, 0.80, 0.98)).alias("reinforce"))


@query("s2_5_6_hash_chain", f"""{OBS}, h AS (SELECT session, id, sha256(id || ':' || content) AS own FROM observations) SELECT session, id, own, lag(own, 1, '') OVER (PARTITION BY session ORDER BY id) AS prev FROM h""")
def hash_chain(spark, d):
    h = M.observations(spark, d).select("session", "id", F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), "content"), 256).alias("own"))
    return h.withColumn("prev", F.lag("own", 1, "").over(Window.partitionBy("session").orderBy("id")))


COST = "ceil(length(content) / 4)::BIGINT"


@query("s2_5_7_token_budget", f"""{OBS}, t AS (SELECT session, id, {COST} AS tokens, coalesce(sum({COST}) OVER (PARTITION BY session ORDER BY importance DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM observations)
 SELECT session, id, least(tokens, 1000 - before)::BIGINT AS given FROM t WHERE before < 1000""")
def token_budget(spark, d):
    return budget_prefix(M.observations(spark, d), ["session"], [F.desc("importance"), F.asc("id")], 1000).select("session", "id", "given")


def budget_prefix(df, keys, order, tokens: int):
    """Rows until the budget is used; the last one gets what is left."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    t = df.withColumn("tokens", X.token_estimate(F.col("content")))
    t = t.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return t.where(F.col("before") < tokens).withColumn("given", F.least("tokens", F.lit(tokens) - F.col("before")))


@query("s2_5_8_rank_for_fusion", f"{OBS} SELECT entity, id, row_number() OVER (PARTITION BY entity ORDER BY importance DESC, id) AS rank FROM observations")
def fusion_rank(spark, d):
    o = M.observations(spark, d).select("entity", "id", "importance")
    return rank_within(o, ["entity"], [F.desc("importance"), F.asc("id")]).select("entity", "id", "rank")
