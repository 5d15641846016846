"""Connected components of a link table, by contraction of the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of ``links`` (a, b); root is the smallest node of its component.

    Each round points every node at its smallest neighbour (or itself), follows the pointers three steps,
    renames the edges' ends and drops loops and repeats. Sums over a hot node are partial minima, never a
    list of its neighbours. Rounds go on until no edge is left; null ends and loops are no links.
    An empty table gives an empty result.
    """
    edges = materialize(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = edges.schema["a"].dataType.simpleString()
    roots = None
    while not edges.isEmpty():
        ends = edges.select(F.col("a").alias("node"), "b").unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("b")))
        up = materialize(ends.groupBy("node").agg(F.least("node", F.min("b")).alias("up")))
        for _ in range(2):
            over = up.select(F.col("node").alias("mid"), F.col("up").alias("top"))
            nearer = materialize(up.join(over, up["up"] == over["mid"]).select("node", F.col("top").alias("up")))
            release(up)
            up = nearer
        if roots is None:
            now = up.select("node", F.col("up").alias("root"))
        else:
            to = up.select(F.col("node").alias("root"), "up")
            now = roots.join(to, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
        now = materialize(now)
        ua, ub = up.select(F.col("node").alias("a"), F.col("up").alias("ua")), up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        left = edges.join(ua, "a").join(ub, "b").filter("ua <> ub")
        left = materialize(left.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
        for old in [x for x in (edges, up, roots) if x is not None]:
            release(old)
        edges, roots = left, now
    return roots if roots is not None else edges.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
