"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramlake.lineage import discard
from engramlake.llm.common import materialize


def components(edges: DataFrame, label: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest node of its component, itself included
    as (root, root).  Self-loops and repeated edges do no harm; no edges give no rows.

    A round is a minimum per node, which combines before it is shuffled, and equi-joins whose hot side adaptive
    execution can split; each round's edges are written to the shared folder.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = materialize(e, label)
    for _ in range(max_rounds):
        # stored, so that the joins below are plain and a hot node can be split
        least = materialize(e.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("c")), label)
        unsettled = least.where("c > 1").select("n").union(e.join(least, e.lo == least.n, "left_semi").select("lo"))
        if not unsettled.limit(1).count():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        # large star: every node above u hangs on the least neighbour of u
        large = materialize(e.join(least, e.lo == least.n, "left").select("hi", F.coalesce("m", "lo").alias("lo")).distinct(), label)
        discard(e)
        discard(least)
        least = materialize(large.groupBy(F.col("hi").alias("n")).agg(F.min("lo").alias("m")), label)
        # small star: a node and its lower neighbours hang on the least of them
        near = large.join(least, large.hi == least.n)
        new = near.select("hi", F.col("m").alias("lo")).union(near.where("lo > m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))).distinct()
        e = materialize(new, label)
        discard(large)
        discard(least)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
