"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.llm.common import drop_materialized, materialize


def _written(df: DataFrame) -> tuple[DataFrame, tuple]:
    out = materialize(df, "links")
    return out, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a long, b long) that is not a root itself; root is the smallest node of the component.

    Nulls and self links are ignored; repeated links count once; no links give no rows. Each step is a grouped minimum (combined before
    the shuffle) and one equi-join whose hot keys Spark can split; its result is written to the shared folder, so no lineage grows
    and nothing but two numbers a step comes to the driver. Steps needed grow with the logarithm of the number of nodes.
    """
    spark = links.sparkSession
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, seen = _written(links)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after, now = _written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        drop_materialized(edges)
        edges = after
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
