"""Connected components of a link table, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxflow.llm.scratch import Scratch


def connected_components(links: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """(node, component): every node of ``links(a, b)`` with the least node it reaches.

    Large-star and small-star rounds (Kiveris et al. 2014) until the edges stop
    changing.  Each round aggregates to the least neighbour before it joins, and
    is written to the shared folder, so that lineage stays short.  An empty link
    table gives an empty result.
    """
    edges = scratch.write(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{label}-0"
    )
    state, step = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # from here on u is the greater end, so no u has many rows; one exchange serves the minimum and the join
        large = large.where("u <> v").repartition("u")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        )
        small = small.select("e.u", "e.v").where("u <> v").distinct()
        step += 1
        edges = scratch.write(small, f"{label}-{step}")
        total = edges.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if state == (total["n"], total["h"]):
            break
        state = (total["n"], total["h"])
        if step > 1:
            scratch.drop(f"{label}-{step - 2}")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
