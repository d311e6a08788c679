"""Connected components of a table of links, as DataFrame joins.

Large-star and small-star steps alternate until no edge changes: every edge then points from a vertex to the smallest
vertex of its component. A step joins edges with the smallest neighbour of each vertex; minima are pre-aggregated, and
the joins are plain sort-merge joins, which Spark splits where one vertex has very many edges. Each step is written to
the shared folder, so lineage stays short and a lost executor costs one step; only the result stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.functions.storage import scratch, stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    met = both.join(least, "u")
    if large:  # larger neighbours move to the smallest one
        return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) of every vertex that has a link to another one; component_id is the smallest id reachable."""
    with scratch():
        edges = stored(
            links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges")
        last = None
        while True:
            with scratch():
                edges = stored(_star(stored(_star(edges, True), "edges"), False), "edges", out=True)
            state = edges.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
            if state == last:
                break
            last = state
        roots = edges.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("id"), F.col("v").alias("component_id"))
        return stored(edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(roots), "components", out=True)
