"""Fix-points: connected components, pointer jumping, and shortest paths by bounded rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import cut
from ..graph import Graph


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(v, component): the smallest vertex reachable by links (src, dst), which need only one direction.

    Rounds of taking the smallest label among neighbours, each followed by a jump to the label's own label, so long
    chains halve; a round is two partially aggregated minima.
    """
    both = cut(links.select("src", "dst").union(links.select("dst", "src")).filter("src <> dst").distinct())
    label = cut(vertices.select("v", F.col("v").alias("c")))
    while True:
        around = both.join(label, both.dst == label.v).groupBy(F.col("src").alias("v")).agg(F.min("c").alias("m"))
        lower = label.join(around, "v", "left").select("v", "c", F.least("c", F.coalesce("m", "c")).alias("m"))
        # A vertex that hears of a smaller label also tells its old label, which is a vertex of its component.
        told = lower.groupBy(F.col("c").alias("v")).agg(F.min("m").alias("t"))
        step = lower.join(told.withColumnRenamed("v", "c"), "c").select("v", F.col("c").alias("old"), F.least("m", "t").alias("c"))
        jump = step.select(F.col("v").alias("__v"), F.col("c").alias("__c"))
        after = cut(step.join(jump, step.c == jump["__v"]).select("v", "old", F.least("c", "__c").alias("c")))
        label = after.select("v", "c")
        if after.filter("old <> c").isEmpty():
            return label.select("v", F.col("c").alias("component"))


def roots(pointers: DataFrame, v: str = "v", to: str = "next") -> DataFrame:
    """(v, root, steps): where following `to` ends; a null pointer is a root. Steps double each round, so rounds are few.

    Pointers must not form a cycle.
    """
    at = pointers.select(F.col(v).alias("v"), F.coalesce(F.col(to), F.col(v)).alias("root"), F.when(F.col(to).isNull(), 0).otherwise(1).cast("long").alias("steps"))
    at = cut(at)
    while True:
        far = at.select(F.col("v").alias("__v"), F.col("root").alias("__r"), F.col("steps").alias("__s"))
        after = cut(at.join(far, at.root == far["__v"]).select("v", F.col("root").alias("old"), F.col("__r").alias("root"), (F.col("steps") + F.when(F.col("root") != F.col("v"), F.col("__s")).otherwise(0)).alias("steps")))
        at = after.select("v", "root", "steps")
        if after.filter("old <> root").isEmpty():
            return at


def jumps(pointers: DataFrame, v: str = "v", to: str = "next") -> list[DataFrame]:
    """Tables (v, to) of 1, 2, 4, 8 .. steps along `to`, until no vertex has so many; vertices with fewer are left out.

    Pointers must not form a cycle. There are as many tables as the longest walk's length has binary digits.
    """
    out = []
    at = cut(pointers.filter(F.col(to).isNotNull()).select(F.col(v).alias("v"), F.col(to).alias("to")))
    while not at.isEmpty():
        out.append(at)
        far = at.select(F.col("v").alias("to"), F.col("to").alias("far"))
        at = cut(at.join(far, "to").select("v", F.col("far").alias("to")))
    return out


def walked(steps: list[DataFrame], starts: DataFrame) -> DataFrame:
    """(v): all vertices on the walks from starts (v), themselves included, by tables of jumps()."""
    at = starts.select("v").distinct()
    for step in steps:
        at = cut(at.union(at.join(step, "v").select(F.col("to").alias("v"))).distinct())
    return at


def walks(steps: list[DataFrame], starts: DataFrame) -> DataFrame:
    """(start, pos, v): the walk from each of starts (v), itself at position 0, by tables of jumps().

    Each round doubles the part of the walks that is known, so long walks take few rounds.
    """
    at = starts.select(F.col("v").alias("start"), F.lit(0).cast("long").alias("pos"), "v")
    for k, step in enumerate(steps):
        on = at.join(step, "v").select("start", (F.col("pos") + (1 << k)).alias("pos"), F.col("to").alias("v"))
        at = cut(at.union(on))
    return at


def distances(edges: DataFrame, starts: DataFrame, reach: float | None = None, hops: int | None = None) -> DataFrame:
    """(ref, v, dist, pred): shortest distances from starts (ref, v), by rounds over the frontier.

    Only rows that got shorter go into the next round; distances beyond `reach` and rounds beyond `hops` are not searched.
    Ties take the smaller predecessor.
    """
    best = cut(starts.select("ref", "v", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred")))
    front, n = best, 0
    while hops is None or n < hops:
        out = front.join(edges, front.v == edges.src).select("ref", F.col("dst").alias("v"), (F.col("dist") + F.col("len")).alias("dist"), F.col("src").alias("pred"))
        if reach is not None:
            out = out.filter(F.col("dist") <= reach)
        out = out.groupBy("ref", "v").agg(F.min(F.struct("dist", "pred")).alias("b")).select("ref", "v", "b.dist", "b.pred")
        known = best.select("ref", "v", F.col("dist").alias("d0"), F.col("pred").alias("p0"))
        shorter = out.join(known, ["ref", "v"], "left").filter("d0 is null or dist < d0 or (dist = d0 and pred < p0)").select("ref", "v", "dist", "pred")
        front = cut(shorter)
        if front.isEmpty():
            break
        rank = Window.partitionBy("ref", "v").orderBy("dist", F.col("pred").asc_nulls_first())
        best = cut(best.union(front).withColumn("rn", F.row_number().over(rank)).filter("rn = 1").drop("rn"))
        n += 1
    return best


def hops(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(ref, v, hop): breadth-first levels from starts (ref, v)."""
    unit = edges.select("src", "dst", F.lit(1.0).alias("len"))
    return distances(unit, starts, hops=most).select("ref", "v", F.col("dist").cast("int").alias("hop"))


def nearest_source(graph: Graph, sources: DataFrame) -> DataFrame:
    """(v, source, dist): the nearest of sources (v, rank) to each vertex that has one; ties by the smaller rank."""
    best = cut(sources.select("v", F.struct(F.lit(0.0).alias("dist"), F.col("rank"), F.col("v").alias("source")).alias("b")))
    front = best
    while True:
        out = front.join(graph.edges, front.v == graph.edges.src).select(F.col("dst").alias("v"), F.struct((F.col("b.dist") + F.col("len")).alias("dist"), F.col("b.rank"), F.col("b.source")).alias("b"))
        out = out.groupBy("v").agg(F.min("b").alias("b"))
        known = best.select("v", F.col("b").alias("b0"))
        front = cut(out.join(known, "v", "left").filter("b0 is null or b < b0").select("v", "b"))
        if front.isEmpty():
            return best.select("v", "b.source", "b.dist")
        best = cut(best.union(front).groupBy("v").agg(F.min("b").alias("b")))


def nearest(edges: DataFrame, starts: DataFrame, n: int) -> DataFrame:
    """(ref, v, dist, pred): the n vertices nearest to each start by (distance, vertex), itself included.

    Each round keeps the n best so far. That loses none: a vertex that belongs to the result is reached at its
    final distance through vertices that belong to it too, and then fewer than n can be nearer.
    """
    rank = Window.partitionBy("ref").orderBy("dist", "v")
    best = cut(starts.select("ref", "v", F.lit(0.0).alias("dist"), F.lit(None).cast("long").alias("pred")))
    front = best
    while True:
        out = front.join(edges, front.v == edges.src).select("ref", F.col("dst").alias("v"), (F.col("dist") + F.col("len")).alias("dist"), F.col("src").alias("pred"))
        every = best.withColumn("new", F.lit(False)).union(out.withColumn("new", F.lit(True)))
        every = every.groupBy("ref", "v").agg(F.min(F.struct("dist", "new", "pred")).alias("b")).select("ref", "v", "b.dist", "b.pred", "b.new")
        after = cut(every.withColumn("rn", F.row_number().over(rank)).filter(F.col("rn") <= n).drop("rn"))
        front, best = after.filter("new").drop("new"), after.drop("new")
        if front.isEmpty():
            return best
