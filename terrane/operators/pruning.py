"""Pruning long edges of a graph without taking it apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..checkpoints import cut
from ..functions.ranks import running
from ..graph import Graph
from .fixpoint import components


def prune_long_edges(graph: Graph, share: float = 0.5) -> Graph:
    """The graph without the edges among the longest `share` whose ends stay connected without them, tried from the longest.

    Tried are the edges at least as long as the one at place floor(share m) by falling length (none for 0, all for 1); of
    equally long ones that of smaller ends is tried first. What is kept of them is a minimum spanning forest of the
    parts that the shorter edges leave, found in rounds in which every part takes its first edge to another one.
    """
    once = cut(graph.edges.filter("src < dst").select("src", "dst", "len"))
    m = once.count()
    if share <= 0 or not m:
        return graph
    ranked = running(once, [F.col("len").desc()], {"place": F.lit(1)})
    place = m if share >= 1 else min(int(m * share) + 1, m)
    bound = ranked.filter(F.col("place") >= place).agg(F.max("len")).first()[0]
    light = once.filter(F.col("len") < bound)
    label = cut(components(graph.vertices, light))
    heavy = once.filter(F.col("len") >= bound).select("src", "dst", F.struct("len", (-F.col("src")).alias("s"), (-F.col("dst")).alias("d")).alias("k"))
    kept = light
    while True:
        # Parts are looked up anew: a table carried through the rounds would carry ever more inferred constraints.
        a, b = label.select(F.col("v").alias("src"), F.col("component").alias("a")), label.select(F.col("v").alias("dst"), F.col("component").alias("b"))
        open_ = cut(heavy.join(a, "src").join(b, "dst").filter("a <> b").select("a", "b", "k"))
        if open_.isEmpty():
            break
        sides = open_.union(open_.select("b", "a", "k"))
        best = cut(sides.groupBy("a").agg(F.min(F.struct("k", "b")).alias("m")).select("a", "m.b", "m.k"))
        kept = cut(kept.union(best.select((-F.col("k.s")).alias("src"), (-F.col("k.d")).alias("dst"), F.col("k.len").alias("len"))).distinct())
        joined = components(sides.select(F.col("a").alias("v")).distinct(), best.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        joined = joined.select(F.col("v").alias("component"), F.col("component").alias("next"))
        label = cut(label.join(joined, "component", "left").select("v", F.coalesce("next", "component").alias("component")))
    return Graph(graph.vertices, kept.union(kept.selectExpr("dst", "src", "len")))


def radius_neighbours(graph: Graph, starts: DataFrame, radius: float) -> DataFrame:
    """(ref, v, dist): the vertices within a distance of each of starts (v), itself included."""
    from .fixpoint import distances

    return distances(graph.edges, starts.select(F.col("v").alias("ref"), "v"), reach=radius).select("ref", "v", "dist")
