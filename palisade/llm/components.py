"""Connected components of a graph given by its links, by alternating stars.

A large-star step links the larger neighbours of every node to the smallest of all its neighbours, a
small-star step the smaller ones; both keep components together, and after a few rounds every node
hangs on the smallest of its component. A step is a minimum per node, with partial sums, joined back
to the links; joins by a node with very many links can be split. The links of a round are written to
the shared folder, so a lost executor repeats one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.session import stored


def components(links: DataFrame, purpose: str = "components") -> DataFrame:
    """Links ``a, b`` (long) -> ``node, root`` for every node but the roots, root the smallest."""
    edges = stored(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        purpose,
    )
    before = _state(edges)
    while True:
        edges = stored(_star(_star(edges, large=True), large=False), purpose)
        now = _state(edges)
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    ).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """``edges`` has each link once, with a > b, and so has the result."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = (
            edges.join(least, "a")
            .select(F.explode(F.array(
                F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))
            )).alias("e")).select("e.a", "e.b")
        )
    return moved.where("a <> b").distinct()
