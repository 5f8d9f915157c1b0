"""Connected components by alternating large-star and small-star steps; nothing is gathered on the driver but two numbers a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegrid.session import discard, materialise, tidy


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) of any order to (id, component): component is the smallest id reachable; ids without an edge are not listed.

    Each round is two aggregations with map-side minimum and two joins on the node, so a node with very many edges costs no
    task more than AQE's skew split leaves; the edge set never grows. The table of a round is written to the shared folder.
    Raises if the edges still change after max_rounds (the rounds needed are about the logarithm of the largest component)."""
    step = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "cc")
    seen = None
    spark = edges.sparkSession
    for _ in range(max_rounds):
        with tidy(spark):
            found = step.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum((F.xxhash64("v", "u") % 1_000_003).cast("decimal(38,0)"))).first()
        if tuple(found) == seen or not found[0]:
            return step.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
                step.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = tuple(found)
        both = step.unionByName(step.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        spent, step = step, materialise(small.select("e.u", "e.v").filter("u <> v").distinct(), "cc")
        discard(spent)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
