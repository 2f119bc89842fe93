"""Connected components of an edge table by hooking to the smallest neighbour and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofold.llm.common import cut, drop_cuts


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node of an edge: root is the smallest node of its component.

    Each round hooks every node to its smallest neighbour, follows those pointers to their ends
    by doubling, and renames the edges' ends; what remains joins different trees only, so few
    rounds do. The work is in joins and partially aggregated minima over edges; no component is
    ever gathered in one place. Every round is cut to the shared folder.
    """
    left = cut(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "edges")
    label: DataFrame | None = None
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "parents")
        while True:  # follow pointers to their ends
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            after = cut(parent.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("next"), (F.coalesce("up", "root") != F.col("root")).alias("moved")), "parents")
            drop_cuts(parent.sparkSession, parent)
            parent = after.select("node", F.col("next").alias("root"))
            if after.where("moved").isEmpty():
                break
        ends_a = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        ends_b = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        renamed = cut(left.join(ends_a, "a").join(ends_b, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        if label is None:
            label = parent
        else:
            up = parent.select(F.col("node").alias("root"), F.col("root").alias("up"))
            older = label
            label = cut(label.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
            drop_cuts(left.sparkSession, older)
        drop_cuts(left.sparkSession, left)
        left = renamed
    if label is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return label
