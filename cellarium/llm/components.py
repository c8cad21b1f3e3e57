"""Connected components over an edge table, by alternating large and small stars.

Every round is two aggregations and two joins, all keyed by node; hot nodes are
pre-aggregated (``min``) and their joins are left to the skew handling of adaptive
execution. Each round is written to the shared folder, so a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One star step over edges (a > b). Large: each node's larger neighbours go to its least one."""
    both = edges if small else edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    if small:
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.union(least.select("a", F.col("m").alias("b")))
    else:
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges(a long, b long)`` to ``(node, root)``: the least node reachable, for nodes with an edge.

    Self links and repeated links are ignored; an empty table gives an empty table. It ends
    when a round changes nothing, which is known by count and checksum. ``rows``: about how many
    edges there are; only the evenly dealt last step of a round (distinct edges) is written in as many files as they are worth.
    """
    now = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
        rows,
    )
    stamp = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == stamp or not seen[0]:
            break
        stamp = seen
        now = cut(_star(_star(now, False), True), "edges", seen[0])
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root"))
    ).distinct()
