"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is an aggregation by node and a join on it, in which a node of very many links is sent to the links instead
of meeting them in one task. Links are written to the shared folder after every round, which also ends their lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, spread_join, stored


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """links (u, v) -> the links of the next step; ``large`` hangs larger neighbours on the least one, else smaller ones."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    near = spread_join(both, least, ["u"], "_n", total)
    if large:
        moved = near.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (u, v), any order and repeated -> (node, root), a row per linked node; root is the component's least node."""
    spark = links.sparkSession
    links, path = stored(links.filter(F.col("u") != F.col("v")).distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if not state["n"] or (state["n"], state["x"]) == seen:
            roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
        seen = (state["n"], state["x"])
        after, new = stored(_star(_star(links, True, 2 * state["n"]), False, state["n"]), "links")
        forget(spark, path)
        links, path = after, new
