"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node of the edges (a, b); the label is the component's least node.

    Each round attaches the larger neighbours of a node to the least node it knows (large star),
    then the smaller ones (small star); O(log^2) rounds suffice on any graph. Rounds are written
    to the shared folder. Only one count a round reaches the driver.
    """
    pairs = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    while True:
        both = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lowest, "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                      F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u != v")
            .distinct()
        )
        found = stored(small)
        changed = found.join(pairs, ["u", "v"], "left_anti").limit(1).count()
        if not changed and found.count() == pairs.count():
            break
        pairs = found
    leaves = pairs.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return leaves.unionAll(leaves.select(F.col("label").alias("node"), "label").distinct())
