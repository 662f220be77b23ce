"""Global order without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engramlake.lineage import cut


def prefix_sums(df: DataFrame, order: list[Column], amount: str, into: str = "before") -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows that stand before a row in ``order``, which must be total.

    Rows are dealt by ranges of the order and stored; each range sums on its own, and the ranges' totals, one row
    for each range, give what stands before a range."""
    spark = df.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    totals = ranged.groupBy("__part").agg(F.sum(amount).alias("__sum"))
    start = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("__part", F.coalesce(F.sum("__sum").over(start), F.lit(0)).alias("__start"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("__own", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return own.join(F.broadcast(starts), "__part").withColumn(into, F.col("__start") + F.col("__own")).drop("__part", "__start", "__own")


def global_rank(df: DataFrame, order: list[Column], into: str = "rank") -> DataFrame:
    """1-based ranks of all rows in a total order."""
    return prefix_sums(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", into).withColumn(into, F.col(into) + 1).drop("__one")


def rank_within(df: DataFrame, keys: list[str], order: list[Column], into: str = "rank") -> DataFrame:
    """1-based ranks of all rows of each key in a total order; a hot key is spread over ranges like any other."""
    ranked = global_rank(df, [*(F.asc(k) for k in keys), *order], "__rank")
    first = ranked.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__rank").alias("__first"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    out = ranked.join(first, same).withColumn(into, F.col("__rank") - F.col("__first") + 1)
    return out.drop("__rank", "__first", *[f"__{k}" for k in keys])
