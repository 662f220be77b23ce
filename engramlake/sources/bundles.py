"""Bundles: the memory as files that replicas exchange, and reading them back.

An export is a folder of relations (notes nested in their entities, edges, errors, tombstones) and a manifest
relation with counts and a digest that doesn't depend on row order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA_VERSION = 1


def nest(entities: DataFrame, observations: DataFrame, key: str = "entity") -> DataFrame:
    """One row per entity with its notes as a sorted array of structs."""
    notes = observations.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in observations.columns if c != key]))).alias("observations"))
    return entities.join(notes, key, "left")


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): SHA-256 over row digests in sorted order, combined per leading byte so that no task sees all rows."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    per = df.select(row.alias("h")).groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda s: s["h"]), ""), 256)
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), whole.alias("digest"))


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [digest(df).select(F.lit(name).alias("table"), "rows", "digest") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write_bundle(tables: dict[str, DataFrame], path: str, compression: str = "zstd") -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", compression).parquet(f"{path}/{name}")
    manifest(tables).write.mode("overwrite").json(f"{path}/manifest")


def read_bundle(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The bundle's relations; raises if a table's rows or digest differ from the manifest."""
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    said = {r.table: (r.rows, r.digest) for r in spark.read.schema("table string, rows long, digest string").json(f"{path}/manifest").collect()}
    for name, df in tables.items():
        own = digest(df).first()
        if said.get(name) != (own.rows, own.digest):
            raise ValueError(f"table {name} of the bundle doesn't match its manifest")
    return tables


def validate(observations: DataFrame, kinds: list[str]) -> DataFrame:
    """(problem, n): null or repeated ids, and unknown kinds."""
    repeated = observations.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit("repeated id").alias("problem"), F.count(F.lit(1)).alias("n"))
    rows = observations.agg(F.count_if(F.col("id").isNull()).alias("a"), F.count_if(~F.col("kind").isin(kinds)).alias("b"))
    other = rows.select(F.explode(F.array(F.struct(F.lit("null id").alias("problem"), F.col("a").alias("n")), F.struct(F.lit("unknown kind").alias("problem"), F.col("b").alias("n")))).alias("s")).select("s.*")
    return repeated.union(other)


def pages(files: DataFrame, budget: int, bundle: str) -> DataFrame:
    """(bundle, name, size, page): each bundle's files in name order, page after page within a byte budget; a page
    takes at least one file.

    The reset at each page makes this sequential within a bundle; a list has one row per file, and bundles are
    paged side by side."""
    import pandas as pd

    def run(p: pd.DataFrame) -> pd.DataFrame:
        page, used, out = 0, 0, []
        for own, name, size in p.sort_values("name")[[bundle, "name", "size"]].itertuples(index=False):
            if used and used + size > budget:
                page, used = page + 1, 0
            used += size
            out.append((own, name, size, page))
        return pd.DataFrame(out, columns=[bundle, "name", "size", "page"])

    kind = files.schema[bundle].dataType.simpleString()
    return files.groupBy(bundle).applyInPandas(run, f"{bundle} {kind}, name string, size long, page int")


def wikilinks(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, note): one markdown note per entity with links to its neighbours in order."""
    names = entities.select(F.col("id").alias("dst"), F.col("name").alias("to"))
    links = edges.join(names, "dst").groupBy("src").agg(F.array_sort(F.collect_list(F.concat(F.lit("- "), "rtype", F.lit(" [["), "to", F.lit("]]")))).alias("links"))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col("name")), F.array_join(F.coalesce("links", F.array().cast("array<string>")), "\n"))
    return entities.join(links, entities.id == links.src, "left").select("id", body.alias("note"))


EVAL_SCHEMA = "query string, relevant_ids array<string>, relevant_markers array<string>, relevant array<string>, expected_answer string, ability string, question_type string, abstain boolean, gold_entities array<string>, question_class string"


def read_eval(spark: SparkSession, path: str) -> DataFrame:
    """Retrieval questions, one JSON object a line; lines without a query are dropped as malformed."""
    return spark.read.schema(EVAL_SCHEMA).json(path).where(F.col("query").isNotNull())


def builtin_eval(spark: SparkSession) -> DataFrame:
    """A fixed handful of questions for smoke runs."""
    rows = [("what do we know of src1", ["1"], "recall", False), ("which supplier is named Supplier#000000003", ["s:3"], "factoid", False), ("who walked on mars", [], "abstain", True)]
    literal = F.array(*(F.struct(F.lit(q).alias("query"), F.array(*(F.lit(i) for i in ids)).cast("array<string>").alias("relevant_ids"), F.lit(a).alias("ability"), F.lit(x).alias("abstain")) for q, ids, a, x in rows))
    return spark.range(1).select(F.inline(literal))
