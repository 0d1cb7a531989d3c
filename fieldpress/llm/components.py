"""Connected components by alternating large and small stars (Kiveris et al., 2014), on narrow edge tables.

No node's neighbours are gathered: a star is a minimum per node and a join, both of which Spark spreads.
Each round's edges are a table in the shared folder, so that lineage stays short and executors may be lost; those of the
round before are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (a, b): root is the smallest node that can be reached. Only nodes with an edge to another one; null ends are left out."""
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, "edges")
    state = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        stars = written(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "stars")
        large = both.join(stars, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(stars)
        discard(old)
        before, state = state, _state(e)
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(xxhash64(v, u, 7))")).first())
