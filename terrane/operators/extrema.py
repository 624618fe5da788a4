"""Local extrema: tests, labels, hop indices, radii and spurious ones."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import cut
from ..graph import Graph
from .fixpoint import nearest


def edge_values(graph: Graph, field: DataFrame) -> DataFrame:
    """(src, dst, len, ys, yd): each directed edge with the field at its ends."""
    a, b = field.select(F.col("v").alias("src"), F.col("y").alias("ys")), field.select(F.col("v").alias("dst"), F.col("y").alias("yd"))
    return graph.edges.join(a, "src").join(b, "dst").select("src", "dst", "len", "ys", "yd")


def edge_length_quantile(graph: Graph, q: float) -> DataFrame:
    """One row (threshold): the type-7 quantile of undirected lengths; infinite for q >= 1, 0 without edges."""
    if q >= 1:
        return graph.edges.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"))
    return graph.edges.filter("src < dst").agg(F.coalesce(F.expr(f"percentile(len, {q}D)"), F.lit(0.0)).alias("threshold"))


def strict_extrema(graph: Graph, field: DataFrame, isolated_minimum: bool = True) -> DataFrame:
    """(v, y, is_min, is_max): no neighbour at or below, at or above. An isolated vertex is a minimum, or neither."""
    near = edge_values(graph, field).groupBy(F.col("src").alias("v")).agg(F.min("yd").alias("lo"), F.max("yd").alias("hi"))
    alone = F.lit(isolated_minimum)
    return field.join(near, "v", "left").select("v", "y", F.coalesce(F.col("lo") > F.col("y"), alone).alias("is_min"), F.coalesce(F.col("hi") < F.col("y"), F.lit(False)).alias("is_max"))


def weak_extrema(graph: Graph, field: DataFrame) -> DataFrame:
    """As strict_extrema, but neighbours of equal value do not count against a vertex; isolated vertices are neither."""
    near = edge_values(graph, field).groupBy(F.col("src").alias("v")).agg(F.min("yd").alias("lo"), F.max("yd").alias("hi"))
    return field.join(near, "v").select("v", "y", (F.col("lo") >= F.col("y")).alias("is_min"), (F.col("hi") <= F.col("y")).alias("is_max"))


def extrema_table(graph: Graph, field: DataFrame) -> DataFrame:
    """(v, type, y) of strict extrema of vertices with neighbours."""
    e = strict_extrema(graph, field, isolated_minimum=False)
    return e.filter("is_min or is_max").select("v", F.when(F.col("is_max"), "max").otherwise("min").alias("type"), "y")


def relabel(extrema: DataFrame) -> DataFrame:
    """Add label: M1, M2 .. for maxima by falling value, m1, m2 .. for minima by rising value; ties by vertex."""
    by = Window.partitionBy("type").orderBy(F.when(F.col("type") == "max", -F.col("y")).otherwise(F.col("y")), "v")
    return extrema.withColumn("label", F.concat(F.when(F.col("type") == "max", "M").otherwise("m"), F.row_number().over(by).cast("string")))


def neighbour_share(graph: Graph, field: DataFrame, density: DataFrame | None = None) -> DataFrame:
    """(v, maxp, minp): density share of neighbours below and above the vertex; null without neighbours or density."""
    e = edge_values(graph, field)
    rho = F.lit(1.0)
    if density is not None:
        e, rho = e.join(density.select(F.col("v").alias("dst"), F.col("density").alias("rho")), "dst"), F.col("rho")
    share = lambda c: F.when(F.sum(rho) > 2.220446049250313e-16, F.sum(F.when(c, rho).otherwise(0.0)) / F.sum(rho))
    per = e.groupBy(F.col("src").alias("v")).agg(share(F.col("yd") < F.col("ys")).alias("maxp"), share(F.col("yd") > F.col("ys")).alias("minp"))
    return graph.vertices.join(per, "v", "left").select("v", "maxp", "minp")


def _violates(kind: str, other: str, own: str) -> str:
    return f"({kind} = 'max' and {other} >= {own}) or ({kind} = 'min' and {other} <= {own})"


def hop_index(graph: Graph, field: DataFrame, extrema: DataFrame, most: int | None = None) -> DataFrame:
    """(v, type, y, hop_idx): the first hop with a vertex that is not below a maximum (above a minimum); null if none
    (or, where `most` hops are named, none within these).

    Levels are searched only for extrema that have met none yet, and vertices of their last level only go on.
    """
    open_ = extrema.select(F.col("v").alias("ref"), "type", F.col("y").alias("own"))
    found = []
    seen = front = cut(open_.select("ref", F.col("ref").alias("v")))
    for h in count(1) if most is None else range(1, most + 1):
        nxt = front.join(graph.edges, front.v == graph.edges.src).select("ref", F.col("dst").alias("v")).distinct()
        nxt = cut(nxt.join(seen, ["ref", "v"], "left_anti"))
        if nxt.isEmpty():
            break
        hit = nxt.join(field, "v").join(open_, "ref").filter(_violates("type", "y", "own")).select("ref").distinct().withColumn("hop_idx", F.lit(h))
        found.append(cut(hit))
        open_ = open_.join(found[-1], "ref", "left_anti")
        front = nxt.join(found[-1], "ref", "left_anti")
        seen = cut(seen.join(found[-1], "ref", "left_anti").union(front))
        if h % 16 == 0:  # Long searches keep short plans.
            open_, found = cut(open_), [cut(reduce(DataFrame.union, found))]
    out = extrema.select("v", "type", "y")
    if not found:
        return out.withColumn("hop_idx", F.lit(None).cast("int"))
    every = reduce(DataFrame.union, found)
    return out.join(every.select(F.col("ref").alias("v"), "hop_idx"), "v", "left").select("v", "type", "y", "hop_idx")


def hop_neighbourhoods(graph: Graph, indexed: DataFrame) -> DataFrame:
    """(ref, v, hop, boundary) for extrema with a hop index: vertices within hop_idx, those at hop_idx being the boundary."""
    front = cut(indexed.filter("hop_idx is not null").select(F.col("v").alias("ref"), "v", "hop_idx"))
    levels, before = [front.withColumn("hop", F.lit(0))], None
    for h in count(1):
        nxt = front.filter(F.col("hop_idx") >= h).join(graph.edges, F.col("v") == F.col("src")).select("ref", F.col("dst").alias("v"), "hop_idx").distinct()
        # Edges go both ways, so what a level leads to is in it, in the one before or new.
        nxt = nxt.join(front, ["ref", "v"], "left_anti")
        nxt = cut(nxt if before is None else nxt.join(before, ["ref", "v"], "left_anti"))
        if nxt.isEmpty():
            break
        levels.append(nxt.withColumn("hop", F.lit(h)))
        before, front = front, nxt
    return reduce(DataFrame.union, levels).select("ref", "v", "hop", (F.col("hop") == F.col("hop_idx")).alias("boundary"))


def classify_spurious(indexed: DataFrame, method: str = "threshold", threshold: float = 2, level: float = 0.25) -> DataFrame:
    """Add spurious: hop_idx <= threshold; at or below a quantile; below the lower IQR fence; or the first two together.

    Extrema without a hop index (global ones) never are, nor is a single extremum.
    """
    every = indexed.agg(F.expr(f"percentile(hop_idx, {level}D)").alias("__q"), F.expr("percentile(hop_idx, 0.25D)").alias("__a"), F.expr("percentile(hop_idx, 0.75D)").alias("__b"), F.count("*").alias("__n"))
    h = F.col("hop_idx")
    rules = {
        "threshold": h <= threshold,
        "quantile": h <= F.col("__q"),
        "outlier": h < F.col("__a") - 1.5 * (F.col("__b") - F.col("__a")),
        "combined": (h <= threshold) & (h <= F.col("__q")),
    }
    return indexed.crossJoin(F.broadcast(every)).withColumn("spurious", F.coalesce(rules[method] & (F.col("__n") > 1), F.lit(False))).drop("__q", "__a", "__b", "__n")


def retained_by_threshold(indexed: DataFrame, thresholds: list[int]) -> DataFrame:
    """(threshold, n_max, n_min, values): extrema whose hop index is over each threshold (or null)."""
    t = F.explode(F.array(*map(F.lit, thresholds)))
    kept = indexed.withColumn("threshold", t).filter("hop_idx is null or hop_idx > threshold")
    count = lambda k: F.count(F.when(F.col("type") == k, 1))
    return kept.groupBy("threshold").agg(count("max").alias("n_max"), count("min").alias("n_min"), F.array_sort(F.collect_list("y")).alias("values"))


def suggest_threshold(indexed: DataFrame, expected: int, most: int = 10) -> DataFrame:
    """(threshold, retained, off, best) for thresholds 0 to most; best is nearest to the expected number, smallest first.

    Extrema without a hop index are not counted.
    """
    t = F.explode(F.sequence(F.lit(0), F.lit(most)))
    per = indexed.filter("hop_idx is not null").withColumn("threshold", t).groupBy("threshold").agg(F.sum((F.col("hop_idx") > F.col("threshold")).cast("long")).alias("retained"))
    per = per.withColumn("off", F.abs(F.col("retained") - expected))
    return per.withColumn("best", F.row_number().over(Window.orderBy("off", "threshold")) == 1)


def index_distribution(indexed: DataFrame) -> DataFrame:
    """(hop_idx, n, share_at_most, gap): counts per hop index, their cumulative share and the gap to the next lower one."""
    per = indexed.filter("hop_idx is not null").groupBy("hop_idx").agg(F.count("*").alias("n"))
    by = Window.orderBy("hop_idx")
    return per.select("hop_idx", "n", (F.sum("n").over(by) / F.sum("n").over(Window.partitionBy())).alias("share_at_most"), (F.col("hop_idx") - F.lag("hop_idx").over(by)).alias("gap"))


def local_extrema(graph: Graph, field: DataFrame, min_size: int = 1) -> DataFrame:
    """(v, type, y, n_basin): weak extrema that stay so over their nearest min_size vertices (themselves included).

    Ties in distance are taken by vertex. An extremum whose nearest vertices hold a violation, or that reaches fewer vertices, is left out.
    """
    e = weak_extrema(graph, field)
    both = e.filter("is_max").select("v", F.lit("max").alias("type"), "y").union(e.filter("is_min").select("v", F.lit("min").alias("type"), "y"))
    if min_size <= 1:
        return both.withColumn("n_basin", F.lit(1).cast("long"))
    starts = both.select(F.col("v").alias("ref"), "v").distinct()
    near = nearest(graph.edges, starts, min_size).join(field.withColumnRenamed("y", "yv"), "v")
    bad = F.expr("(type = 'max' and yv > y) or (type = 'min' and yv < y)")
    per = both.withColumnRenamed("v", "ref").join(near, "ref").groupBy("ref", "type", "y").agg(F.count("*").alias("n_basin"), F.max(bad).alias("bad"))
    return per.filter((F.col("n_basin") == min_size) & ~F.col("bad")).select(F.col("ref").alias("v"), "type", "y", "n_basin")


def radius_extrema(graph: Graph, field: DataFrame, max_radius: float, min_size: int, maxima: bool = True) -> DataFrame:
    """(v, y, radius, size): vertices whose nearest vertices within max_radius, by (distance, vertex), are strictly below
    (above) until the first violation, at least min_size (1 or more) of them; radius is the distance of the last of these.

    Every vertex is tried, not only local extrema: a violation may lie behind a long edge. A search goes on from
    vertices that are below only and ends at the distance of the nearest violation, so it stays small: a vertex before
    the first violation has none on its shortest path.
    """
    values = field.select("v", F.col("y").alias("yv"))
    bad = F.col("yv") >= F.col("own") if maxima else F.col("yv") <= F.col("own")
    best = cut(field.select(F.col("v").alias("ref"), "v", F.lit(0.0).alias("dist"), F.col("y").alias("own"), F.lit(False).alias("bad"), F.lit(True).alias("new")))
    one = Window.partitionBy("ref", "v").orderBy("dist", "new")
    every = Window.partitionBy("ref")
    while True:
        out = best.filter("new and not bad").select("ref", "v", "dist", "own").join(graph.edges, F.col("v") == F.col("src")).select("ref", F.col("dst").alias("v"), (F.col("dist") + F.col("len")).alias("dist"), "own")
        out = out.filter((F.col("dist") <= max_radius) & (F.col("v") != F.col("ref"))).groupBy("ref", "v", "own").agg(F.min("dist").alias("dist"))
        out = out.join(values, "v").select("ref", "v", "dist", "own", bad.alias("bad"), F.lit(True).alias("new"))
        both = best.withColumn("new", F.lit(False)).unionByName(out).withColumn("rn", F.row_number().over(one)).filter("rn = 1").drop("rn")
        best = cut(both.withColumn("limit", F.min(F.when(F.col("bad"), F.col("dist"))).over(every)).filter("limit is null or dist <= limit").drop("limit"))
        if best.filter("new").isEmpty():
            break
    upto = Window.partitionBy("ref").orderBy("dist", "v")
    good = best.filter("v <> ref").withColumn("failed", F.max(F.col("bad").cast("int")).over(upto)).filter("failed = 0")
    return good.groupBy(F.col("ref").alias("v"), F.col("own").alias("y")).agg(F.max("dist").alias("radius"), F.count("*").alias("size")).filter(F.col("size") >= min_size)


def probable_radius(graph: Graph, field: DataFrame, density: DataFrame, p: float, maxima: bool = True, max_hop: int | None = None) -> DataFrame:
    """(v, y, hop_radius): the last hop up to which the density share of vertices below (above) stays at least p.

    Strict local extrema only; null for vertices within 1e-14 of the global extremum, whose radius is unbounded. A search
    ends where the share falls below p or the density met is 0, or at max_hop if that is named; one that runs out of
    vertices counts the hop that finds none.
    """
    e = strict_extrema(graph, field, isolated_minimum=False).filter("is_max" if maxima else "is_min").select("v", "y")
    top = field.agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
    e = cut(e.crossJoin(F.broadcast(top)).withColumn("global", F.abs(F.col("y") - F.col("hi" if maxima else "lo")) <= 1e-14 * F.greatest(F.abs("hi"), F.abs("lo"))).select("v", "y", "global"))
    from .dense import share_radius

    ends = graph.edges.select(F.col("src").alias("v")).union(graph.edges.select("dst"))
    values = field.select("v", "y").join(density.select("v", "density"), "v")
    nodes = graph.vertices.select("v").union(ends).distinct().join(values, "v", "left").select("v", "y", F.col("density").cast("double").alias("density"))
    last = share_radius(e.filter("not global"), nodes, graph.edges, p, maxima, max_hop)
    return e.join(last, "v", "left").select("v", "y", F.when(~F.col("global"), F.coalesce("r", F.lit(0))).alias("hop_radius"))
