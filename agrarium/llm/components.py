"""Connected components of an edge table, by alternating large and small stars.

Every round is a few joins and aggregations; nothing is gathered per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrarium.llm.rows import saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a long, b long); root is the least node reachable.

    Loops, repeated edges and either direction are fine; edges with nulls are
    ignored; no edges give no rows.
    """
    stars = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct())
    before = None
    while True:
        stars = saved(_small(_large(stars)))
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("child", "parent").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = stars.select(F.col("child").alias("node"), F.col("parent").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _large(stars: DataFrame) -> DataFrame:
    """Links each node's larger neighbours to the least of its neighbours and itself."""
    both = stars.select(F.col("child").alias("node"), F.col("parent").alias("near")).unionByName(stars.select(F.col("parent").alias("node"), F.col("child").alias("near")))
    least = saved(both.groupBy("node").agg(F.least("node", F.min("near")).alias("least")))
    return both.where("near > node").join(least, "node").select(F.col("near").alias("child"), F.col("least").alias("parent")).where("child <> parent").distinct()


def _small(stars: DataFrame) -> DataFrame:
    """Links each node and its smaller neighbours to the least of them."""
    stars = saved(stars)
    least = saved(stars.groupBy("child").agg(F.min("parent").alias("least")))
    moved = stars.join(least, "child").select(F.col("parent").alias("child"), F.col("least").alias("parent"))
    return moved.unionByName(least.select("child", F.col("least").alias("parent"))).where("child <> parent").distinct()
