"""Connected components of link tables that stay distributed."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplescope.llm import _common as C


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A stored table (node, root) of each node in `links`; root is the least node that can be reached.

    Large-star and small-star steps take turns until the links are stars around their least nodes. A step
    sends each node's least neighbour to its neighbours; that is a sum by key and a join whose skewed keys
    can be split, and its rows are at most those of the links. A link of a node with itself makes it a root.
    """
    given = C.store(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    edges, before = given.filter("u <> v"), None
    last: list[DataFrame] = []
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = C.store(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = C.store(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        lower = C.store(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(lower, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lower.select("u", F.col("m").alias("v")))
        edges = C.store(small.distinct(), "small")
        C.drop(least, large, lower, *last)
        last = [edges]
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())
        if now == before:
            break
        before = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    alone = given.filter("u = v").select(F.col("u").alias("node"))
    roots = edges.select(F.col("v").alias("node")).unionByName(alone).distinct()
    out = C.store(found.unionByName(roots.join(found.select("node"), "node", "left_anti").withColumn("root", F.col("node"))), "components")
    C.drop(given, *last)
    return out
