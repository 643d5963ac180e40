"""Connected components by contraction, and joins to one row a key, in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.sources.shared import written


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (columns a, b; any order, repeats and loops allowed); root is the smallest node reachable.

    Each round points every node at its smallest neighbour, follows that pointer once more, and
    replaces nodes by what they point at; links inside a group vanish. Only aggregations with
    map-side combine and joins against unique keys are used, and every round is stored.
    """
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    roots = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        point = written(point, "pointers")
        point = written(point.join(point.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.col("far").alias("root")), "pointers")
        if roots is None:
            roots = point
        else:
            roots = written(roots.join(point.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("root")), "roots")
        moved = edges.join(point.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(point.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if roots is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots


def join_unique(rows: DataFrame, known: DataFrame, keys: list[str], weight: str, total: int, share: int = 512) -> DataFrame:
    """Inner join of ``rows`` to ``known``, which has one row a key and in ``weight`` how many of the ``total`` rows hold it.

    Keys that hold more than one in ``share`` rows (fewer than ``share`` keys, whatever the size) are
    broadcast, so that no key sends its rows to one task; the others are joined by shuffling. Both
    inputs are read twice. ``weight`` is left out.
    """
    hot = F.broadcast(known.where(F.col(weight) * share > total))
    cold = known.where(F.col(weight) * share <= total)
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys)).drop(weight)
