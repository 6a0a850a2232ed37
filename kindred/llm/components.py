"""Connected components of an edge table that may hold one giant group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.session import cut, cut_counting


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, comp`` for every end of ``edges`` (a, b); ``comp`` is the least node of the component.

    Each round every node hooks to its least neighbour, pointers are doubled
    until they reach a root, and the edges between roots make the next, smaller
    graph. A minimum per node is combined before the shuffle; joins have one
    row per node on one side, so a hot root is a skewed join that Spark splits.
    Nulls and loops are dropped; an empty table gives an empty table.
    """
    live, left = cut_counting(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges")
    comp = live.selectExpr("a as node", "b as comp").limit(0)
    first = True
    while left:
        both = live.union(live.select("b", "a"))
        parents = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("p")).selectExpr(
            "node", "least(node, p) as p"), "hook")
        while True:
            above = parents.selectExpr("node as p", "p as up")
            parents, moved = cut_counting(
                parents.join(above, "p").selectExpr("node", "up as p", "up <> p as moved"), "jump", "moved")
            parents = parents.drop("moved")
            if not moved:
                break
        if first:
            comp, first = parents.selectExpr("node", "p as comp"), False
        else:
            step = parents.selectExpr("node as comp", "p as next")
            comp = comp.join(step, "comp", "left").selectExpr("node", "coalesce(next, comp) as comp")
        to_a = parents.selectExpr("node as a", "p as ra")
        to_b = parents.selectExpr("node as b", "p as rb")
        live, left = cut_counting(
            live.join(to_a, "a").join(to_b, "b").where("ra <> rb")
            .selectExpr("least(ra, rb) as a", "greatest(ra, rb) as b").distinct(), "edges")
        comp = cut(comp, "comp")
    return comp
