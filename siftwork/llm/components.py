"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import checkpointed


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each linked node can reach.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller ones on
    the smallest of them, so a path's length shrinks by a constant factor and the links never outnumber
    those given by more than the nodes. Every round is cut into the checkpoint folder. Rows with a null
    end are ignored; nodes without links are not returned.
    """
    pairs = links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    pairs = checkpointed(pairs.distinct())
    if pairs.isEmpty():
        return pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component"))
    while True:
        both = pairs.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(
            pairs.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
        )
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # large star: neighbours above the node hang on the smallest one around it
        large = (
            pairs.join(least, F.col("lo") == F.col("u"))
            .select(F.col("m").alias("lo"), "hi")
            .where("lo <> hi")
            .distinct()
        )
        # small star: a node and its smaller neighbours hang on the smallest of them
        below = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.join(below, F.col("hi") == F.col("u")).select("lo", "hi", "m")
        after = (
            small.select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
            .union(small.select(F.col("m").alias("lo"), "hi"))
            .where("lo <> hi")
            .distinct()
        )
        after = checkpointed(after)
        # stars are reached when no node is at once a leaf and a centre, and no leaf has two centres
        leaves = after.groupBy("hi").agg(F.count("*").alias("n"))
        twice = leaves.where("n > 1").limit(1).count()
        deep = after.select("lo").distinct().join(leaves, F.col("lo") == F.col("hi"), "left_semi").limit(1).count()
        pairs = after
        if not twice and not deep:
            break
    centres = pairs.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return pairs.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(centres)
