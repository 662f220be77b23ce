"""Sources, sinks, streams and the API catalogue as named queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from engramlake.functions import registered
from engramlake.lineage import shared_dir
from engramlake.operators import relational as R
from engramlake.plans import model as M
from engramlake.plans.registry import query
from engramlake.plans.relational import OBS, rd
from engramlake.sources import bundles as B
from engramlake.sources import codegraph as C
from engramlake.streaming import streams as T


def scratch(spark, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@query("s2_1_3_jsonl_reader", "SELECT text AS query, [item_id::VARCHAR] AS relevant_ids FROM benchmark")
def jsonl_reader(spark, d):
    path = scratch(spark, "eval")
    M.table(spark, d, "benchmark").select(F.col("text").alias("query"), F.array(F.col("item_id").cast("string")).alias("relevant_ids")).write.json(path)
    return B.read_eval(spark, path).select("query", "relevant_ids")


@query("s2_1_4_builtin_eval", "SELECT 3::BIGINT AS questions, 1::BIGINT AS abstain")
def builtin_eval(spark, d):
    return B.builtin_eval(spark).agg(F.count(F.lit(1)).alias("questions"), F.count_if("abstain").alias("abstain"))


@query("s2_1_5_bundle_export", f"{OBS} SELECT entity, count(*) AS n, min(id) AS first FROM observations GROUP BY entity")
def bundle_export(spark, d):
    """Written, read back against its manifest, and unnested again."""
    o = M.observations(spark, d).select("entity", "id", "kind", "importance", "content")
    path = scratch(spark, "bundle")
    B.write_bundle({"entities": B.nest(o.select("entity").distinct(), o)}, path)
    back = B.read_bundle(spark, path, ["entities"])["entities"]
    return back.select("entity", F.explode("observations").alias("o")).groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.min("o.id").alias("first"))


@query("s2_1_6_embedding_blob", "SELECT vec_id, len(embedding)::BIGINT AS dims FROM embeddings")
def embedding_blob(spark, d):
    path = scratch(spark, "vectors")
    M.table(spark, d, "embeddings").select("vec_id", "embedding").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("dims"))


@query("s2_1_7_compression", "SELECT count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents")
def compression(spark, d):
    path = scratch(spark, "zstd")
    M.table(spark, d, "documents").write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("s2_1_9_bundle_validate", f"{OBS} SELECT 'repeated id' AS problem, 0 AS n UNION ALL SELECT 'null id', 0 UNION ALL SELECT 'unknown kind', count(*) FILTER (kind = 'superseded') FROM observations")
def bundle_validate(spark, d):
    return B.validate(M.observations(spark, d), M.KINDS)


@query("s2_1_10_paged_pull", """WITH RECURSIVE f AS MATERIALIZED (SELECT source, lpad(doc_id::VARCHAR, 12, '0') AS name, octet_length(encode(text))::BIGINT AS size, row_number() OVER (PARTITION BY source ORDER BY lpad(doc_id::VARCHAR, 12, '0')) AS n FROM documents),
 w AS (SELECT source, name, size, n, 0 AS page, size AS used FROM f WHERE n = 1
  UNION ALL SELECT source, name, size, n, CASE WHEN turn THEN page + 1 ELSE page END, CASE WHEN turn THEN size ELSE used + size END FROM (SELECT f.*, w.page, w.used, w.used > 0 AND w.used + f.size > 100000 AS turn FROM w JOIN f ON f.source = w.source AND f.n = w.n + 1))
 SELECT source, name, size, page FROM w""")
def paged_pull(spark, d):
    f = M.table(spark, d, "documents").select("source", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), F.octet_length("text").cast("long").alias("size"))
    return B.pages(f, 100_000, "source")


@query("s2_1_12_source_tree")
def source_tree(spark, d):
    """Symbols of this package's own sources."""
    import os

    import engramlake

    return C.symbols(C.read_tree(spark, "file://" + os.path.dirname(os.path.abspath(engramlake.__file__)))).groupBy("what").agg(F.count(F.lit(1)).alias("n"))


@query("s2_11_34_codegraph_edges")
def codegraph_edges(spark, d):
    import os

    import engramlake

    found = C.symbols(C.read_tree(spark, "file://" + os.path.dirname(os.path.abspath(engramlake.__file__))))
    return C.edges(found).groupBy("rtype").agg(F.count(F.lit(1)).alias("n"))


@query("s2_1_13_markdown_vault", f"""{M.cte('entities', 'trade')}, l AS (SELECT src, list_sort(list('- ' || rtype || ' [[' || name || ']]')) AS links FROM trade JOIN entities ON dst = id GROUP BY src)
 SELECT id, '# ' || name || chr(10) || coalesce(array_to_string(links, chr(10)), '') AS note FROM entities LEFT JOIN l ON src = id""")
def vault(spark, d):
    return B.wikilinks(M.entities(spark, d), M.trade(spark, d))


@query("s2_3_16_recursive_join", f"""{M.cte('trade')}, w AS (SELECT 'n:4' AS node, 0 AS depth UNION SELECT t.dst, w.depth + 1 FROM w JOIN trade t ON t.src = w.node WHERE w.depth < 4) SELECT node, min(depth) AS depth FROM w GROUP BY node""")
def recursive_join(spark, d):
    """Levels are unrolled joins: recursion with UNION (distinct) isn't offered, and UNION ALL repeats rows."""
    from engramlake.operators.graph import distances

    start = spark.range(1).select(F.lit("n:4").alias("node"))
    return distances(M.trade(spark, d), start, most=4).select("node", F.col("d").alias("depth"))


@query("s2_13_registered_functions", "SELECT s_suppkey, round(0.5 / (60 + s_suppkey), 8) AS rrf, round(1 / ln(2 + s_suppkey), 6) AS aa, CASE WHEN s_suppkey % 100 >= 92 THEN 'reinforce' WHEN s_suppkey % 100 >= 75 THEN 'update' ELSE 'create' END AS gate FROM supplier")
def registered_functions(spark, d):
    registered.register(spark)
    return M.table(spark, d, "supplier").select("s_suppkey", F.expr("round(rrf_score(0.5D, s_suppkey), 8)").alias("rrf"), F.expr("round(adamic_adar(s_suppkey), 6)").alias("aa"), F.expr("gate(s_suppkey % 100 / 100D)").alias("gate"))


def collected(spark, stream, label: str, mode: str = "append"):
    """Runs a stream over what is there and returns what its last batches wrote."""
    out = scratch(spark, label)
    T.run_available(stream, lambda df, n: df.withColumn("__batch", F.lit(n)).write.mode("append").parquet(out), scratch(spark, "stream"), mode)
    return spark.read.parquet(out)


def event_stream(spark, d):
    """The events table as a folder of files that a stream reads."""
    folder = scratch(spark, "events")
    e = M.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(4, "event_id").write.parquet(folder)
    return T.appended(spark, folder, e.schema)


@query("s2_12_1_change_notification", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def change_notification(spark, d):
    got = collected(spark, event_stream(spark, d), "changes")
    return got.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("ids"))


@query("s2_12_4_scheduled_consolidation", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def scheduled(spark, d):
    got = collected(spark, event_stream(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")), "consolidated", "complete")
    last = got.agg(F.max("__batch").alias("__batch"))
    return got.join(F.broadcast(last), "__batch", "left_semi").select("event_type", "n")


@query("s2_12_5_ttl_expiry", "SELECT user_id AS key, true AS live FROM events GROUP BY 1")
def ttl_expiry(spark, d):
    w = event_stream(spark, d).select(F.col("user_id").alias("key"), F.col("event_type").alias("value"), "ts").withWatermark("ts", "365 days")
    return collected(spark, T.working_memory(w, 86_400), "wm").where("live").select("key", "live").distinct()


@query("s2_12_6_reinforcement_stream", "SELECT user_id, count(*) AS accesses FROM events GROUP BY 1")
def reinforcement(spark, d):
    got = collected(spark, T.access_counts(event_stream(spark, d), "user_id", late="365 days"), "access", "update")
    return got.groupBy("user_id").agg(F.max("accesses").alias("accesses"))


@query("s2_12_2_deduplicated_stream", "SELECT count(*) AS n FROM events")
def deduplicated(spark, d):
    return collected(spark, T.deduplicated(event_stream(spark, d), "event_id", late="365 days"), "dedup").agg(F.count(F.lit(1)).alias("n"))


@query("s2_12_7_session_windows", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events)
 SELECT user_id, sum(new)::BIGINT AS sessions FROM s GROUP BY user_id""")
def session_windows(spark, d):
    """The batch form; :func:`engramlake.streaming.streams.sessions` is the stream's."""
    e = M.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))
