"""Connected components of a graph in a table of edges, by contraction.

Each round every vertex points at its smallest neighbour if that is smaller than itself; pointers are doubled, edges are
relabelled by them, and loops and repeats go. Edges are summed up by key before they are shuffled, tables of a round are
written to the shared folder, and joins on them may be split where a vertex has very many edges. Nothing is collected.
A round at least halves the vertices, and shortens paths fourfold; the smallest id of a component is what remains of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored

#: Doublings of the pointers in a round.
DOUBLINGS = 2


def components(edges: DataFrame) -> DataFrame:
    """From (a, b), in any order, repeated or not: (id, component) of every vertex of an edge between two vertices; component is the smallest id."""
    edges = edges.where("a <> b")
    edges = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    maps = []
    while not edges.isEmpty():
        pointer = edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to"))
        for _ in range(DOUBLINGS):
            pointer = stored(pointer)
            onward = pointer.select(F.col("a").alias("to"), F.col("to").alias("further"))
            pointer = pointer.join(onward, "to").select("a", F.col("further").alias("to"))
        pointer = stored(pointer)
        maps.append(pointer)
        left, right = pointer.select("a", F.col("to").alias("x")), pointer.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = stored(edges.join(left, "a").join(right, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    labels = maps[0].select(F.col("a").alias("id"), F.col("to").alias("component"))
    for later in maps[1:]:
        labels = labels.join(later, labels["component"] == later["a"], "left").select("id", F.coalesce("to", "component").alias("component"))
    return stored(labels)
