"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.llm.scratch import drop, stage


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """The smallest node that each node reaches: columns ``node`` and ``component`` (long).

    Nodes that are the smallest of their component have no row. Edges with a null end and
    loops count as none; repeated edges are allowed. Rounds of large-star and small-star
    steps turn every component into a star; each is a minimum by node and a join, so the edges
    of a hub are never gathered, and each round is written before the next one reads it.
    """
    u, v = F.col("u"), F.col("v")
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y"))
    now, path = stage(pairs.where(F.col("x") & F.col("y") & (u != v)).select("u", "v").distinct(), "edges")
    seen = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(v > u).select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(v != F.col("m")).select(v.alias("u"), F.col("m").alias("v"))
        after, new_path = stage(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges")
        drop(now.sparkSession, path)
        now, path = after, new_path
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            return now.select(u.alias("node"), v.alias("component"))
        seen = mark
