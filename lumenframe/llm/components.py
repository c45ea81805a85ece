"""Connected components of an edge table, by contraction in rounds with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import common
from lumenframe.llm.common import is_crowded, join_unique, save

def _follow(table: DataFrame, key: str, pointers: DataFrame, goes: str, crowded: bool) -> DataFrame:
    """table with a column `goes`: where its node in `key` points (pointers: u, to). A hub may be in a third of all rows."""
    return join_unique(table, pointers.select(F.col("u").alias(key), F.col("to").alias(goes)), [key], crowded=crowded)


def _roots(pointers: DataFrame) -> DataFrame:
    """(u, to) with every pointer at the root of its tree: a pointer takes over its target's until none changes."""
    crowded = is_crowded(pointers.groupBy("to").count(), "count")
    while True:
        jumped = _follow(pointers, "to", pointers, "further", crowded).select("u", F.col("further").alias("to"), (F.col("to") != F.col("further")).cast("int").alias("moved"))
        jumped = save(jumped, "pointers")
        pointers = jumped.select("u", "to")
        state = jumped.groupBy("to").agg(F.count("*").alias("n"), F.max("moved").alias("m")).agg(F.max("n"), F.max("m")).head()  # one row
        if not state[1]:
            return pointers
        crowded = state[0] > common.HOT


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable by edges (a, b); only nodes with an edge to another have a row.

    In each round every node points to the least of its neighbours' least neighbours, itself being one of them.  Pointers
    go to smaller nodes only, so they form trees; pointer jumping takes them to the roots, halving depths, and edges
    follow.  All neighbours of a root have it as their least neighbour, so each root has a neighbour that no other root
    has and that is none itself: at least half of the nodes that still have edges vanish.  That makes O(log n) rounds of
    O(log depth) jumps, for a path of n nodes too.  Each step is written and read back, so plans stay short and a
    lost executor costs one step; only emptiness and greatest counts reach the driver, and no neighbourhood is gathered.
    Null ends have no edge.  No edges: no rows.
    """
    edges = save(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
        least = save(both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("degree")).select("u", F.least("u", "v").alias("to"), "degree"), "least")
        crowded = is_crowded(least, "degree")
        least = _roots(save(_follow(both, "v", least, "far", crowded).groupBy("u").agg(F.min("far").alias("to")), "pointers"))
        if label is None:
            label = least.toDF("node", "component")
        else:  # a component without edges left keeps its label
            still = least.unionAll(label.select("component").distinct().join(least.select(F.col("u").alias("component")), "component", "left_anti").select("component", F.col("component").alias("to")))
            label = save(_follow(label, "component", still, "further", is_crowded(label.groupBy("component").count(), "count")).select("node", F.col("further").alias("component")), "labels")
        moved = _follow(_follow(edges, "a", least, "to_a", crowded), "b", least, "to_b", crowded).where("to_a <> to_b")
        edges = save(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) if label is None else label
