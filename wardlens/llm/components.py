"""Connected components of a link table, by alternating large and small stars.

Each round rewires every link to the smallest neighbour known, until all components are
stars around their smallest node; the number of rounds grows with the logarithm of the
table. A round is a grouped minimum and a join, and is written to the shared folder, so
lineage stays short and a lost executor costs a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.session import scratch_path


def _star(links: DataFrame, larger: bool) -> DataFrame:
    """Links (u, v), v < u, rewired to the smallest node near u."""
    near = links.select("u", "v")
    if larger:
        near = near.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = near.join(least, "u")
    moved = joined.where("v > u") if larger else joined.where("v != m")
    out = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        out = out.union(least.select("u", F.col("m").alias("v")))
    return out.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node of its component, for each node that has a link.

    ``links`` has two whole-number columns; direction, repeats and links to oneself don't
    matter. Nulls are no nodes.
    """
    spark = links.sparkSession
    one, two = links.columns
    path = scratch_path(spark, "links")
    links = links.where(F.col(one) != F.col(two)).select(F.greatest(one, two).alias("u"), F.least(one, two).alias("v")).distinct()
    before = None
    for step in range(200):
        links.write.parquet(f"{path}/{step}")
        links = spark.read.parquet(f"{path}/{step}")
        now = tuple(links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
        links = _star(_star(links, larger=True), larger=False)
    else:
        raise RuntimeError("the components of the links did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
