"""Gradient flow: next vertices, modulation, plateaus, single-owner basins, trajectories and coverage."""

from __future__ import annotations

from math import factorial

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import cut
from ..graph import Graph
from .extrema import edge_length_quantile, edge_values, strict_extrema
from .fixpoint import components, jumps, roots, walked, walks

#: Cells of lengths (216 bytes each) that are broadcast at most.
_CELLS = 1 << 15


def length_weight(graph: Graph, bandwidth: float = -1.0, bins: int | None = None) -> DataFrame:
    """(src, dst, w): Gaussian density of undirected edge lengths at each edge, over its largest value.

    The bandwidth is 1.06 sd m^-0.2 if not given. The sum over all edges goes by moments of cells, so work is in proportion
    to the edges. `bins` sums over that many equal bins of length instead.
    """
    e = graph.edges.filter("src < dst").select("src", "dst", "len")
    stat = e.agg(F.stddev_samp("len").alias("sd"), F.count("*").alias("m"), F.min("len").alias("lo"), F.max("len").alias("hi"))
    h = F.lit(bandwidth) if bandwidth > 0 else F.greatest(1.06 * F.coalesce("sd", F.lit(0.0)) * F.pow(F.col("m").cast("double"), -0.2), F.lit(1e-300))
    stat = stat.withColumn("h", h)
    if bins is None:
        dens = cut(_densities(e, cut(stat)))
        return _both(e.join(dens.crossJoin(F.broadcast(dens.agg(F.max("d").alias("top")))), "len").select("src", "dst", (F.col("d") / F.col("top")).alias("w")))
    width = (F.col("hi") - F.col("lo")) / bins
    at = e.crossJoin(F.broadcast(stat)).withColumn("bin", F.least(F.floor((F.col("len") - F.col("lo")) / F.greatest(width, F.lit(1e-300))), F.lit(bins - 1)))
    at = at.groupBy("bin").agg(F.count("*").cast("double").alias("c"), F.avg("len").alias("x"))
    d = at.select(F.col("x").alias("len")).crossJoin(F.broadcast(at.select("x", "c"))).crossJoin(F.broadcast(stat.select("h")))
    dens = d.groupBy("len").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("len") - F.col("x")) / F.col("h"), 2))).alias("d"))
    dens = dens.withColumn("w", F.col("d") / F.max("d").over(Window.partitionBy())).select("len", "w")
    grid = at.select("bin", F.col("x").alias("len")).join(dens, "len").select("bin", "w")
    return _both(e.crossJoin(F.broadcast(stat)).withColumn("bin", F.least(F.floor((F.col("len") - F.col("lo")) / F.greatest(width, F.lit(1e-300))), F.lit(bins - 1))).join(grid, "bin").select("src", "dst", "w"))


def _both(once: DataFrame) -> DataFrame:
    return once.union(once.selectExpr("dst", "src", "w"))


def _densities(e: DataFrame, stat: DataFrame) -> DataFrame:
    """(len, d): the sum of exp(-(len - x)^2 / 2 h^2) over all x of e (len), for each distinct len; stat has h, lo and hi in one row.

    Lengths meet cells one bandwidth wide, not each other: with t and s the distances of len and x from the middle of x's cell in
    bandwidths, the term is exp(-t^2/2) exp(-s^2/2) sum (ts)^k / k!, so a cell is its 26 moments. Since |s| <= 1/2, the
    powers left out are under 1e-21 of a term of 1, and cells over 12 bandwidths away under 1e-28; each sum has a term of 1.
    """
    powers, reach = 26, 12
    at = e.groupBy("len").agg(F.count("*").cast("double").alias("c")).crossJoin(F.broadcast(stat.select("h", "lo", "hi")))
    h = stat.first()
    if h["m"] and (h["hi"] - h["lo"]) / h["h"] > 2.0**40:  # Cells that a double cannot number: a bandwidth far below all gaps but those of rounding.
        x = at.select(F.col("len").alias("x"), "c")
        d = at.select("len", "h").crossJoin(x)
        return d.groupBy("len").agg(F.sum(F.col("c") * F.exp(-0.5 * F.pow((F.col("len") - F.col("x")) / F.col("h"), 2))).alias("d"))
    middle = lambda cell: F.col("lo") + F.col(cell) * F.col("h")
    at = cut(at.withColumn("cell", F.rint((F.col("len") - F.col("lo")) / F.col("h")).cast("long")))
    near = at.withColumn("s", (F.col("len") - middle("cell")) / F.col("h"))
    for k in range(powers):
        near = near.withColumn(f"p{k}", F.col("c") * F.exp(-0.5 * F.col("s") * F.col("s")) if k == 0 else F.pow("s", F.lit(float(k))) * F.col("p0") / F.lit(float(factorial(k))))
    cells = cut(near.groupBy(F.col("cell").alias("other")).agg(*(F.sum(f"p{k}").alias(f"p{k}") for k in range(powers))))
    # Spark takes the size of ask for that of at, 25 times too small, and would broadcast it. Of the default bandwidth there are
    # under 3 m^0.47 cells that hold a length.
    cells = F.broadcast(cells) if cells.count() <= _CELLS else cells.hint("merge")
    ask = at.withColumn("other", F.explode(F.sequence(F.col("cell") - reach, F.col("cell") + reach)))
    ask = ask.join(cells, "other").withColumn("t", (F.col("len") - middle("other")) / F.col("h"))
    series = F.col(f"p{powers - 1}")
    for k in reversed(range(powers - 1)):
        series = series * F.col("t") + F.col(f"p{k}")
    return ask.groupBy("len").agg(F.sum(F.exp(-0.5 * F.col("t") * F.col("t")) * series).alias("d"))


def default_density(graph: Graph) -> DataFrame:
    """(v, density): one over the nearest edge's length, scaled by its largest value."""
    d = lambda rows: rows.agg((1.0 / F.greatest(F.min("len"), F.lit(1e-300))).alias("d"))
    top = d(graph.edges.groupBy()).withColumnRenamed("d", "top")
    return d(graph.edges.groupBy(F.col("src").alias("v"))).crossJoin(F.broadcast(top)).select("v", (F.col("d") / F.col("top")).alias("density"))


def next_vertex(graph: Graph, field: DataFrame, up: bool = True, modulation: str = "closest", q: float = 0.9, fallback: str = "allow_and_flag", density: DataFrame | None = None, bins: int | None = None) -> DataFrame:
    """(v, next, len, long_edge): where the flow goes from each vertex; next is null at its ends.

    `closest`: the shortest strictly improving edge up to the q-quantile of lengths, ties to the smallest vertex; where
    there is none, the shortest improving one of any length, flagged (not if fallback is `forbid`). Other modulations
    (`none`, `density`, `edgelen`, `density_edgelen`) take the best gain times weights among edges up to the quantile, ties to the
    smallest vertex, without a fallback. `bins` is that of length_weight().
    """
    e = edge_values(graph, field).withColumn("gain", F.col("yd") - F.col("ys") if up else F.col("ys") - F.col("yd")).filter("gain > 0")
    e = e.crossJoin(F.broadcast(edge_length_quantile(graph, q)))
    if modulation == "closest":
        if fallback == "forbid":
            e = e.filter("len <= threshold")
        best = e.groupBy(F.col("src").alias("v")).agg(F.min(F.struct(F.col("len") > F.col("threshold"), "len", "dst")).alias("b"))
        pick = best.select("v", F.col("b.dst").alias("next"), F.col("b.len").alias("len"), F.col("b.col1").alias("long_edge"))
    else:
        e = e.filter("len <= threshold").withColumn("score", F.col("gain"))
        if "density" in modulation:
            rho = default_density(graph) if density is None else density
            e = e.join(rho.select(F.col("v").alias("dst"), "density"), "dst").withColumn("score", F.col("score") * F.col("density"))
        if "edgelen" in modulation:
            e = e.join(length_weight(graph, bins=bins), ["src", "dst"]).withColumn("score", F.col("score") * F.col("w"))
        best = e.groupBy(F.col("src").alias("v")).agg(F.min(F.struct((-F.col("score")).alias("s"), "dst", "len")).alias("b"))
        pick = best.select("v", F.col("b.dst").alias("next"), F.col("b.len").alias("len"), F.lit(False).alias("long_edge"))
    return graph.vertices.join(pick, "v", "left").select("v", "next", "len", F.coalesce("long_edge", F.lit(False)).alias("long_edge"))


def flow_basins(graph: Graph, field: DataFrame, up: bool = True, modulation: str = "closest", q: float = 0.9, density: DataFrame | None = None) -> DataFrame:
    """(v, root, steps): the one extremum that each vertex's flow ends at."""
    return roots(next_vertex(graph, field, up, modulation, q, density=density).select("v", "next"))


def steepest(graph: Graph, field: DataFrame, up: bool = True) -> DataFrame:
    """(v, next): the neighbour of best strict gain, ties to the smallest vertex; null at extrema."""
    return next_vertex(graph, field, up, "none", 1.0).select("v", "next")


def plateaus(graph: Graph, field: DataFrame) -> DataFrame:
    """(v, plateau): connected vertices of equal value share the smallest of them."""
    same = edge_values(graph, field).filter("ys = yd").select("src", "dst")
    return components(graph.vertices, same).withColumnRenamed("component", "plateau")


def plateau_flow(graph: Graph, field: DataFrame, up: bool = True, q: float = 0.9, fallback: str = "allow_and_flag") -> tuple[DataFrame, DataFrame]:
    """Flow over contracted plateaus: (vertices, plateaus).

    plateaus: (plateau, source, target, len, root): the outgoing edge of a plateau by (length, target, source) among strictly
    improving ones, short ones first; null for terminal plateaus; root is the representative of the last plateau.
    vertices: (v, plateau, next, root): vertices of a plateau step to its source by the fewest hops within it, ties to the
    smallest vertex, the source steps out; those of a terminal plateau step to its representative.
    """
    p = cut(plateaus(graph, field))
    e = edge_values(graph, field).crossJoin(F.broadcast(edge_length_quantile(graph, q)))
    a, b = p.select(F.col("v").alias("src"), F.col("plateau").alias("ps")), p.select(F.col("v").alias("dst"), F.col("plateau").alias("pd"))
    e = cut(e.join(a, "src").join(b, "dst"))
    out = e.filter("yd > ys" if up else "yd < ys")
    if fallback == "forbid":
        out = out.filter("len <= threshold")
    best = out.groupBy(F.col("ps").alias("plateau")).agg(F.min(F.struct((F.col("len") > F.col("threshold")).alias("long"), "len", "dst", "src", "pd")).alias("b"))
    tops = p.select("plateau").distinct().join(best, "plateau", "left").select("plateau", F.col("b.src").alias("source"), F.col("b.dst").alias("target"), F.col("b.len").alias("len"), F.col("b.pd").alias("to"))
    tops = cut(tops)
    ends = roots(tops, "plateau", "to").select(F.col("v").alias("plateau"), "root")
    tops = cut(tops.join(ends, "plateau"))
    anchor = tops.select("plateau", F.coalesce("source", "plateau").alias("anchor"))
    inside = e.filter("ps = pd").select("src", "dst")
    from .fixpoint import distances

    starts = anchor.select(F.col("plateau").alias("ref"), F.col("anchor").alias("v"))
    walk = distances(inside.withColumn("len", F.lit(1.0)), starts).select(F.col("ref").alias("plateau"), "v", "pred")
    vs = p.join(walk, ["v", "plateau"], "left").join(tops, "plateau")
    step = F.when(F.col("v") == F.coalesce("source", "plateau"), F.col("target")).otherwise(F.col("pred"))
    return vs.select("v", "plateau", step.alias("next"), "root"), tops.select("plateau", "source", "target", "len", "root")


def _paths(steps: list[DataFrame], seeds: DataFrame) -> DataFrame:
    """(seed, path) from each of seeds (v), by tables of jumps()."""
    on = walks(steps, seeds.select("v")).groupBy(F.col("start").alias("seed"))
    return on.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("path"))


def trajectories(pointers: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, path): vertices from each seed along (v, next) to its end, however long, by rounds that double."""
    return _paths(jumps(pointers), seeds)


def trajectory_membership(graph: Graph, field: DataFrame, modulation: str = "closest", q: float = 0.9, symmetric: bool = True) -> tuple[DataFrame, DataFrame]:
    """Trajectory flow: (trajectories, membership).

    Each minimum ascends; each maximum descends (if symmetric); each vertex that none of these paths covers, by rising
    value, descends and ascends, and the two ends join, unless a vertex before it has covered it. Only paths whose ends
    are a true minimum and a true maximum count and cover. The paths (traj_id, the seed; min, max, path, total_change)
    give every vertex on them to both ends' basins: membership (v, direction, extremum).

    The order of the last kind needs no pass over the vertices: a joined path covers what is above its seed on the way up
    (what is below it came earlier). So a vertex is covered before its turn if and only if, among the vertices
    whose ascent leads through it, there is one that was open and has true ends: the lowest such one is a seed.
    """
    e = cut(strict_extrema(graph, field, isolated_minimum=False))
    up = cut(next_vertex(graph, field, True, modulation, q).select("v", "next"))
    down = cut(next_vertex(graph, field, False, modulation, q).select("v", "next"))
    rise, fall = jumps(up), jumps(down)
    tops = e.filter("is_max").select(F.col("v").alias("max"), F.col("y").alias("y1"))
    lows = e.filter("is_min").select(F.col("v").alias("min"), F.col("y").alias("y0"))
    ends = roots(up).select("v", F.col("root").alias("max")).join(roots(down).select("v", F.col("root").alias("min")), "v")
    ends = cut(ends.join(tops, "max").join(lows, "min").select("v", "min", "max", (F.col("y1") - F.col("y0")).alias("total_change")))
    first = ends.filter("v = min").select("v")
    second = ends.filter("v = max").select("v") if symmetric else first.limit(0)
    covered = walked(rise, first).union(walked(fall, second))
    left = cut(ends.select("v").join(covered, "v", "left_anti"))
    above = walked(rise, left.join(rise[0], "v").select(F.col("to").alias("v"))) if rise else left.limit(0)
    third = cut(left.join(above, "v", "left_anti"))
    ascents = _paths(rise, first.union(third))
    descents = _paths(fall, second.union(third)).select("seed", F.reverse("path").alias("fall"))
    whole = ascents.join(descents, "seed", "full").select("seed", F.when(F.col("fall").isNull(), F.col("path")).when(F.col("path").isNull(), F.col("fall")).otherwise(F.concat("fall", F.expr("slice(path, 2, size(path))"))).alias("path"))
    ok = cut(whole.join(ends, whole.seed == ends.v).select(F.col("seed").alias("traj_id"), "min", "max", "path", "total_change"))
    on = ok.select("min", "max", F.explode("path").alias("v"))
    member = on.select("v", F.lit("max").alias("direction"), F.col("max").alias("extremum")).union(on.select("v", F.lit("min"), "min")).distinct()
    return ok, member


def uncovered(graph: Graph, field: DataFrame, membership: DataFrame) -> DataFrame:
    """(v, kind): vertices in no basin, with kind lmax, lmin or regular."""
    e = strict_extrema(graph, field, isolated_minimum=False)
    return e.join(membership.select("v").distinct(), "v", "left_anti").select("v", F.when(F.col("is_max"), "lmax").when(F.col("is_min"), "lmin").otherwise("regular").alias("kind"))


def through_cell(paths: DataFrame, v: int, low: int, high: int) -> DataFrame:
    """The first stored path (by traj_id) from a minimum to a maximum that holds a vertex; no row if there is none."""
    return paths.filter((F.col("min") == low) & (F.col("max") == high) & F.array_contains("path", v)).orderBy("traj_id").limit(1)


def densest_path(paths: DataFrame, density: DataFrame) -> DataFrame:
    """(traj_id, mean_density): the path of largest mean density, ties to the smallest id."""
    on = paths.select("traj_id", F.explode("path").alias("v")).join(density, "v")
    return on.groupBy("traj_id").agg(F.avg("density").alias("mean_density")).orderBy(F.col("mean_density").desc(), "traj_id").limit(1)


