"""Comparing graphs: summaries as distributions, their divergence, edit distance, and the modularity of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph, degrees
from .fixpoint import components


def _shares(counts: DataFrame, key: str) -> DataFrame:
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(F.col(key).cast("string").alias("bin"), (F.col("n") / F.col("total")).alias("share"))


def degree_distribution(graph: Graph) -> DataFrame:
    """(bin, share): shares of vertices by degree."""
    return _shares(degrees(graph).groupBy("degree").agg(F.count("*").alias("n")), "degree")


def component_distribution(graph: Graph) -> DataFrame:
    """(bin, share): shares of vertices by the size of their component."""
    size = components(graph.vertices, graph.edges).groupBy("component").agg(F.count("*").alias("size"))
    return _shares(size.groupBy("size").agg(F.sum("size").alias("n")), "size")


def label_distribution(graph: Graph, labels: DataFrame) -> DataFrame:
    """(bin, share): shares of edges by the labels (v, label) of their ends, as `A|B` in order."""
    a, b = labels.select(F.col("v").alias("src"), F.col("label").alias("a")), labels.select(F.col("v").alias("dst"), F.col("label").alias("b"))
    pairs = graph.edges.filter("src < dst").join(a, "src").join(b, "dst").select(F.concat_ws("|", F.least("a", "b"), F.greatest("a", "b")).alias("pair"))
    return _shares(pairs.groupBy("pair").agg(F.count("*").alias("n")), "pair")


def length_distributions(first: Graph, second: Graph, bins: int) -> tuple[DataFrame, DataFrame]:
    """Two tables (bin, share): shares of edges by equal bins of length (from 0) over the range of both graphs' lengths."""
    both = first.edges.select("len").union(second.edges.select("len")).agg(F.min("len").alias("lo"), F.max("len").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("len") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    out = (g.edges.filter("src < dst").crossJoin(F.broadcast(both)).groupBy(place.alias("place")).agg(F.count("*").alias("n")) for g in (first, second))
    return tuple(_shares(c, "place") for c in out)


def divergence(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row (divergence): the Jensen-Shannon divergence, in nats, of two distributions (bin, share)."""
    p, q = first.select("bin", F.col("share").alias("p")), second.select("bin", F.col("share").alias("q"))
    j = p.join(q, "bin", "full").na.fill(0.0, ["p", "q"]).withColumn("m", (F.col("p") + F.col("q")) / 2)
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.col("m")) / 2).otherwise(0.0)
    return j.agg(F.coalesce(F.sum(half("p") + half("q")), F.lit(0.0)).alias("divergence"))


def edit_distance(first: Graph, second: Graph, edge_cost: float = 1.0, length_factor: float = 1.0) -> DataFrame:
    """One row (distance): edge_cost for each edge that one graph has only, length_factor times the difference of lengths for
    each that both have."""
    a, b = (g.edges.filter("src < dst").select("src", "dst", F.col("len").alias(c)) for g, c in ((first, "x"), (second, "y")))
    cost = F.when(F.col("x").isNull() | F.col("y").isNull(), F.lit(edge_cost)).otherwise(F.abs(F.col("x") - F.col("y")) * length_factor)
    return a.join(b, ["src", "dst"], "full").agg(F.coalesce(F.sum(cost), F.lit(0.0)).alias("distance"))


def modularity(graph: Graph, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (clusters, modularity) of labels (v, label): the share of edges within clusters, less the resolution times what
    degrees alone would give."""
    e = graph.edges.select("src", "dst").join(labels.select(F.col("v").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("v").alias("dst"), F.col("label").alias("b")), "dst")
    per = e.groupBy(F.col("a").alias("label")).agg(F.count("*").alias("d"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("inner"))
    total = per.agg(F.sum("d").alias("m"))
    q = F.col("inner") / F.col("m") - resolution * F.pow(F.col("d") / F.col("m"), 2)
    return per.crossJoin(F.broadcast(total)).agg(F.count("*").alias("clusters"), F.sum(q).alias("modularity"))
