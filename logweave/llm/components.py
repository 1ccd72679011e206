"""Connected components of a link table, by alternating large and small stars.

Every round is a few aggregations keyed by document; nothing is gathered on the driver but a count of changed
links. Hot nodes are no problem: a star keeps one link a member, and the few nodes that hold a large share of all links are
joined by broadcast (``join_groups``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_groups, written

MAX_ROUNDS = 40


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``links``; the component is its smallest id. Null ends are ignored."""
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    edges = written(edges, "links")
    n, before = edges.count(), None
    for _ in range(MAX_ROUNDS):
        # large star: everything larger than a node joins the node's smallest neighbour
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        both = edges.select("u", "v").unionByName(upward)
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")), "stars")
        large = join_groups(upward, least.where("n > 0"), "u", "n", n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours join the smallest of them; a node has few of those
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(smallest, "u")
        small = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(smallest.select("u", F.col("m").alias("v")))
        old, edges = edges, written(small.where("u != v").distinct(), "links")
        discard(old, least)
        n, told = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == (n, told):
            break
        before = (n, told)
    else:
        raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
