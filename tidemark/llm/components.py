"""Connected components of an edge table by alternating large-star and small-star steps.

Edges stay in DataFrames; each round is written to the shared folder, which cuts lineage. A node of very many edges costs
its own edges in a map-side minimum and a join that adaptive execution can split, never a list of its neighbours. Spark may
broadcast ``FEW`` edges, which spares one task the edges of a hub, but no more: the driver's memory does not grow with them.

Edges with a null end are left out, loops and repeated edges do no harm, other columns are ignored, no edges give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Rounds grow with the logarithm of the longest path; this many mean a defect, and the job stops with an error.
MOST_ROUNDS = 60
#: Edges up to which a round's joins are left to Spark; with more they are by sort and merge.
FEW = 50_000


def _stars(both: DataFrame, few: bool) -> DataFrame:
    """u, v with the smallest of u and its neighbours as ``least``."""
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least"))
    return both.join(least if few else least.hint("merge"), "u")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge. Loops and repeated edges do no harm."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "edges")
    few, before = now.count() <= FEW, None
    for _ in range(MOST_ROUNDS):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both, few).where("v > u and v != least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        # each node's smaller neighbours, and the node itself, go to the smallest of them
        small = _stars(large.distinct(), few)
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.*").where("u != v")
        now = written(small.distinct(), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        few, before = mark[0] <= FEW, mark
    else:
        raise RuntimeError(f"no fixed point after {MOST_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
