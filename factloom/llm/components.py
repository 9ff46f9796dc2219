"""Connected components of links that are spread over the cluster: alternating large-star and small-star rounds.

Each round sends every node to the least node it knows; counts are pre-aggregated, so a node with very many links is only
a skewed join, which Spark splits. Every round is a written table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop_written, written


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for links (a, b) of longs: the least node of each component. Only linked nodes have rows; nulls and loops are dropped."""
    step = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "links")
    state = _state(step)
    while state[0]:
        both = step.union(step.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a > b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").union(least.select("a", F.col("m").alias("b")))
        after = written(small.distinct(), "links")
        drop_written(step)
        step, before, state = after, state, _state(after)
        if state == before:
            break
    # in a fixed point every node that is not least points at the least node, and only there
    return step.select(F.col("a").alias("node"), F.col("b").alias("component")).union(step.select("b", "b").distinct())
