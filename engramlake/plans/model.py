"""The memory model over the fixture tables, and the same relations as SQL for checks.

Each function gives a relation; ``SQL`` holds its statement.  ``cte("observations")`` is a WITH list for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
KINDS = ["fact", "decision", "lesson", "preference", "error", "solution", "context", "tool_usage"]
SOURCES = ["agent", "error_detection", "user", "consolidation", "inference"]
RELATIONS = ["uses", "causes", "implements", "depends_on", "related_to"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for expressions that cost much more than reading: one of at most a single split, which may be one row
    group and so one task, is dealt to all cores; larger ones are read as they are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    stored = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    df = table(spark, sf_dir, name)
    return df.repartition(spark.sparkContext.defaultParallelism) if stored <= most else df


def now():
    return F.lit(NOW).cast("timestamp")


def pick(options: list[str], index):
    return F.element_at(F.array(*(F.lit(o) for o in options)), (index + 1).cast("int"))


def kind(i):
    return F.when(i % 13 == 0, "superseded").otherwise(pick(KINDS, i % 8))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of the observations, for costly expressions.  The labels are not joined, which would send every text."""
    i = F.col("doc_id")
    return dealt(spark, sf_dir, "documents").select(i.alias("id"), F.col("source").alias("entity"), F.col("text").alias("content"), kind(i).alias("kind"))


def observations(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """``heavy``: the contents go through costly expressions, see :func:`dealt`."""
    d = (dealt if heavy else table)(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    i = F.col("doc_id")
    created = F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(doc_id % 30 as int), cast(doc_id % 24 as int))")
    return d.join(labels, "doc_id", "left").select(
        i.alias("id"), F.col("source").alias("entity"), F.col("text").alias("content"), "lang",
        kind(i).alias("kind"),
        pick(SOURCES, i % 5).alias("origin"), ((i * 37) % 100 / 100.0).alias("importance"), (i % 17).alias("access_count"),
        created.alias("created_at"), (created + F.expr("make_interval(0, 0, 0, cast(doc_id % 5 as int))")).alias("last_accessed"),
        F.when(F.col("toxic") == 1, "quarantined").otherwise("trusted").alias("trust"),
        F.when(i % 4 != 0, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("project"),
        F.floor(i / 10).alias("session"), F.array("lang", "source").alias("tags"), "quality")


def verify_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with a stated confidence and what came of them."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    c = ((F.col("doc_id") * 7) % 101) / 100.0
    level = F.when(c > 0.7, "verified").when(c > 0.5, "partial").when(c > 0.3, "weak").otherwise("unknown")
    return l.select(F.col("doc_id").alias("id"), F.col("source").alias("entity"), c.alias("confidence"), level.alias("level"), F.col("quality").alias("correct"))


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    i = F.col("event_id")
    return e.select(
        i.alias("id"), "user_id", F.col("ts").alias("created_at"), F.concat(F.lit("type"), (i % 6).cast("string")).alias("error_type"),
        F.concat(F.lit("error "), "props", F.lit(" user "), F.col("user_id").cast("string")).alias("message"),
        F.when(i % 3 == 0, F.concat(F.lit("fix "), i.cast("string"))).alias("solution"), (i % 3 == 0).alias("resolved"),
        F.when(i % 3 == 0, F.col("ts") + F.expr("make_interval(0, 0, 0, 0, 0, cast(event_id % 600 as int))")).alias("resolved_at"),
        F.when(i % 4 != 0, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("project"),
        F.when(i % 7 == 0, "quarantined").otherwise("trusted").alias("trust"), (1.0 + (i % 40) / 10.0).alias("synapse_weight"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"), F.lit("concept").alias("etype"), F.col("n_nationkey").cast("long").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s:"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), F.lit("technology").alias("etype"), F.col("s_suppkey").alias("k"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), F.lit("project").alias("etype"), F.col("r_regionkey").cast("long").alias("k"))
    return n.union(s).union(r).select("id", "name", "etype", (((F.col("k") * 29) % 100) / 100.0).alias("importance"), (F.col("k") % 13).alias("access_count"))


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed typed edges between nations: goods of a supplier's nation sold to a customer's nation."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    a, b = F.col("s_nationkey"), F.col("c_nationkey")
    sold = l.join(o, l.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(s, F.col("l_suppkey") == s.s_suppkey)
    sold = sold.where(a != b).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return sold.select(
        F.concat(F.lit("n:"), a.cast("string")).alias("src"), F.concat(F.lit("n:"), b.cast("string")).alias("dst"), pick(RELATIONS, (a + b) % 5).alias("rtype"),
        F.round(F.col("n") / (F.col("n") + 50), 6).alias("strength"), ((a + b) % 7 == 0).alias("bidirectional"))


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted edges from suppliers to parts."""
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return l.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.least(F.lit(1.0), F.col("n") / 10.0).alias("strength"), "n")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order status as a fact with a validity interval."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("subject"), F.col("o_orderstatus").alias("object"),
                    F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))


def procedures(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") != "R").alias("success"), F.count_if(F.col("l_returnflag") == "R").alias("failure"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    return s.join(l, s.s_suppkey == l.l_suppkey, "left").select(
        F.col("s_suppkey").alias("id"), "name", F.coalesce("success", F.lit(0)).alias("success"), F.coalesce("failure", F.lit(0)).alias("failure"))


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that have a vector."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return observations(spark, sf_dir).join(v, "id")


def _list(options: list[str]) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


SQL = {
    "observations": f"""
 SELECT d.doc_id AS id, d.source AS entity, d.text AS content, d.lang,
  CASE WHEN d.doc_id % 13 = 0 THEN 'superseded' ELSE ({_list(KINDS)})[d.doc_id % 8 + 1] END AS kind,
  ({_list(SOURCES)})[d.doc_id % 5 + 1] AS origin, ((d.doc_id * 37) % 100) / 100.0::DOUBLE AS importance, d.doc_id % 17 AS access_count,
  TIMESTAMP '2024-01-01' + to_days((d.doc_id % 30)::INT) + to_hours((d.doc_id % 24)::INT) AS created_at,
  TIMESTAMP '2024-01-01' + to_days((d.doc_id % 30)::INT) + to_hours((d.doc_id % 24)::INT) + to_days((d.doc_id % 5)::INT) AS last_accessed,
  CASE WHEN l.toxic = 1 THEN 'quarantined' ELSE 'trusted' END AS trust,
  CASE WHEN d.doc_id % 4 <> 0 THEN 'p' || (d.doc_id % 3) END AS project, d.doc_id // 10 AS session, [d.lang, d.source] AS tags, l.quality
 FROM documents d LEFT JOIN labels l USING (doc_id)""",
    "verify_log": """
 SELECT id, entity, confidence, CASE WHEN confidence > 0.7 THEN 'verified' WHEN confidence > 0.5 THEN 'partial' WHEN confidence > 0.3 THEN 'weak' ELSE 'unknown' END AS level, correct
 FROM (SELECT doc_id AS id, source AS entity, ((doc_id * 7) % 101) / 100.0::DOUBLE AS confidence, quality AS correct FROM labels JOIN documents USING (doc_id))""",
    "errors": """
 SELECT event_id AS id, user_id, ts AS created_at, 'type' || (event_id % 6) AS error_type, 'error ' || props || ' user ' || user_id AS message,
  CASE WHEN event_id % 3 = 0 THEN 'fix ' || event_id END AS solution, event_id % 3 = 0 AS resolved,
  CASE WHEN event_id % 3 = 0 THEN ts + to_minutes(event_id % 600) END AS resolved_at,
  CASE WHEN event_id % 4 <> 0 THEN 'p' || (event_id % 3) END AS project, CASE WHEN event_id % 7 = 0 THEN 'quarantined' ELSE 'trusted' END AS trust,
  1.0::DOUBLE + (event_id % 40) / 10.0::DOUBLE AS synapse_weight
 FROM events WHERE event_type = 'error'""",
    "entities": """
 SELECT id, name, etype, ((k * 29) % 100) / 100.0::DOUBLE AS importance, k % 13 AS access_count FROM (
  SELECT 'n:' || n_nationkey AS id, n_name AS name, 'concept' AS etype, n_nationkey::BIGINT AS k FROM nation
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'technology', s_suppkey FROM supplier
  UNION ALL SELECT 'r:' || r_regionkey, r_name, 'project', r_regionkey::BIGINT FROM region)""",
    "trade": f"""
 SELECT 'n:' || a AS src, 'n:' || b AS dst, ({_list(RELATIONS)})[(a + b) % 5 + 1] AS rtype, round(n / (n + 50), 6) AS strength, (a + b) % 7 = 0 AS bidirectional
 FROM (SELECT s_nationkey AS a, c_nationkey AS b, count(*)::DOUBLE AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
       JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
       WHERE s_nationkey <> c_nationkey GROUP BY ALL)""",
    "supplies": """
 SELECT l_suppkey AS src, l_partkey AS dst, least(1.0::DOUBLE, count(*) / 10.0::DOUBLE) AS strength, count(*) AS n FROM lineitem GROUP BY ALL""",
    "facts": """
 SELECT o_orderkey AS id, o_custkey AS subject, o_orderstatus AS object, o_orderdate AS valid_from,
  lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders""",
    "procedures": """
 SELECT s_suppkey AS id, s_name AS name, coalesce(success, 0) AS success, coalesce(failure, 0) AS failure FROM supplier LEFT JOIN
  (SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R') AS success, count(*) FILTER (l_returnflag = 'R') AS failure FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""",
    "embedded": """
 SELECT o.*, embedding::DOUBLE[] AS v FROM observations o JOIN embeddings ON vec_id = id""",
}


def cte(*names: str) -> str:
    need = [n for n in SQL if n in names or (n == "observations" and "embedded" in names)]
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in need)
