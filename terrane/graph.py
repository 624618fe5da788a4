"""The data model: a weighted undirected graph and scalar fields, as plain DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from .checkpoints import cut


class GraphError(ValueError):
    """A rule of the graph or a field is broken; `rule` names it and `rows` counts the rows that break it."""

    def __init__(self, rule: str, rows: int):
        super().__init__(f"{rule}: {rows} rows")
        self.rule, self.rows = rule, rows


@dataclass(frozen=True)
class Graph:
    """vertices(v long) and edges(src long, dst long, len double), each edge stored in both directions.

    Isolated vertices are in `vertices` only. A field is a DataFrame (v long, y double); many fields are
    (v, feature, value); draws are (v, feature, draw, value).
    """

    vertices: DataFrame
    edges: DataFrame

    def cut(self) -> Graph:
        """The same graph, written out, so that what follows does not build it again."""
        return Graph(cut(self.vertices), cut(self.edges))


def from_edges(undirected: DataFrame, vertices: DataFrame | None = None) -> Graph:
    """A graph from edges given once (a, b, len); repeated edges collapse to the shortest."""
    both = undirected.selectExpr("a as src", "b as dst", "len").union(undirected.selectExpr("b", "a", "len"))
    edges = both.groupBy("src", "dst").agg(F.min("len").alias("len"))
    ends = edges.select(F.col("src").alias("v")).distinct()
    return Graph(ends if vertices is None else vertices.select("v").union(ends).distinct(), edges)


def validate(graph: Graph, tolerance: float = 1.5e-8) -> None:
    """Check the rules of a graph, each as one relational query; raises GraphError."""
    e = graph.edges
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("len").alias("back"))
    rules = {
        "a vertex id is null or below 0": graph.vertices.filter("v is null or v < 0"),
        "a vertex id repeats": graph.vertices.groupBy("v").count().filter("count > 1"),
        "an edge joins a vertex to itself": e.filter("src = dst"),
        "a neighbour repeats": e.groupBy("src", "dst").count().filter("count > 1"),
        "a length is null, below 0 or not finite": e.filter("len is null or isnan(len) or len < 0 or len = double('inf')"),
        "an edge end is not a vertex": e.join(graph.vertices, e.src == graph.vertices.v, "left_anti"),
        "an edge has no reverse of its length": e.join(back, ["src", "dst"], "left").filter(f"back is null or abs(len - back) > {tolerance} * greatest(1, abs(len))"),
    }
    if not graph.vertices.take(1):
        raise GraphError("the graph has no vertex", 0)
    for rule, rows in rules.items():
        n = rows.count()
        if n:
            raise GraphError(rule, n)


def validate_field(graph: Graph, field: DataFrame) -> None:
    """A field has one finite value for each vertex."""
    wrong = graph.vertices.join(field, "v", "full").groupBy("v").agg(F.count("*").alias("n"), F.max(F.expr("y is null or isnan(y) or abs(y) = double('inf')")).alias("bad"))
    n = wrong.filter("n > 1 or bad").count()
    if n:
        raise GraphError("a vertex has no finite value, or two", n)


def degrees(graph: Graph) -> DataFrame:
    """(v, degree, mean_len, min_len)"""
    per = graph.edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"), F.avg("len").alias("mean_len"), F.min("len").alias("min_len"))
    return graph.vertices.join(per, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"), "mean_len", "min_len")
