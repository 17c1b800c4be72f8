"""Connected components of a table of links, by alternating star contractions.

Large star: every node links its larger neighbours to its smallest one. Small star: every
node links its smaller neighbours, and itself, to its smallest one. Both keep the
components; when nothing changes each component is a star around its smallest node. Each
round is two aggregates and two joins, which shuffle only if the smallest neighbours are too many to
be broadcast; no group of neighbours is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajmill.llm.shared import remove, small, store


def _summary(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("bigint"))
    ).first()
    return tuple(row)


def _to_smallest(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """The other end of each edge, linked to the smallest neighbour of this end."""
    return edges.join(small(smallest), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links between long ids -> (id, component) of all ids with a link to another id:
    component is the smallest id that can be reached. Null ids have no link."""
    edges = store(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct(),
        "links",
    )
    known = _summary(edges)
    while known[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = store(
            both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "smallest"
        )
        large = store(_to_smallest(both.where("b > a"), low), "large-star")
        low2 = store(large.groupBy("a").agg(F.min("b").alias("m")), "smallest")
        lower = _to_smallest(large, low2).where("a <> b")
        after = store(lower.unionByName(low2.withColumnRenamed("m", "b")).distinct(), "links")
        found = _summary(after)
        for old in (edges, low, large, low2):
            remove(old)
        edges, same, known = after, found == known, found
        if same:
            break
    stars = edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("id"), "component").distinct())
