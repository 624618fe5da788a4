"""Distances, corridors, monotone graphs and reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import cut
from ..graph import Graph
from .extrema import edge_length_quantile, edge_values
from .fixpoint import components, distances, nearest_source
from .flow import trajectories


def _one(spark, v: int) -> DataFrame:
    return spark.createDataFrame([(v, v)], "ref long, v long")


def shortest_path(graph: Graph, start: int, end: int) -> DataFrame:
    """(position, v, dist): a shortest path; ties go through the smaller predecessor. No row if there is none."""
    d = distances(graph.edges, _one(graph.edges.sparkSession, start)).select("v", "dist", "pred")
    seed = d.filter(F.col("v") == end).select("v")
    line = trajectories(d.select("v", F.col("pred").alias("next")), seed)
    return line.select(F.posexplode(F.reverse("path")).alias("position", "v")).join(d, "v").select("position", "v", "dist")


def through_waypoints(graph: Graph, waypoints: list[int]) -> DataFrame:
    """(position, v): shortest paths between waypoints in a row, joints once."""
    out = None
    for k, (a, b) in enumerate(zip(waypoints, waypoints[1:])):
        leg = shortest_path(graph, a, b).filter("position > 0" if k else "true").select(F.lit(k).alias("leg"), "position", "v")
        out = leg if out is None else out.union(leg)
    return out.select((F.row_number().over(Window.orderBy("leg", "position")) - 1).alias("position"), "v")


def distances_to_vertex(graph: Graph, paths: DataFrame, target: int) -> DataFrame:
    """(traj_id, dist): distance of each path to a vertex."""
    d = distances(graph.edges, _one(graph.edges.sparkSession, target)).select("v", "dist")
    return paths.select("traj_id", F.explode("path").alias("v")).join(d, "v").groupBy("traj_id").agg(F.min("dist").alias("dist"))


def distances_to_path(graph: Graph, path: DataFrame) -> DataFrame:
    """(v, source, dist): distance of vertices to a path (position, v) and the path vertex it is from, ties by position."""
    return nearest_source(graph, path.groupBy("v").agg(F.min("position").alias("rank")))


def tube_lens(graph: Graph, start: int, end: int, relative_radius: float = 0.1, excess_tol: float | None = None) -> DataFrame:
    """(v, on_path, t, t_harmonic, dist, excess, in_excess): vertices near a shortest path and between its ends.

    Kept are those within relative_radius times the length L of the path and at most L from either end. t = (L + d(s, v) - d(v, e)) / 2L,
    excess = d(s, v) + d(v, e) - L; t_harmonic is the mean of neighbours in the corridor, weighted by 1 / length, with the path
    held at its arc positions.
    """
    spark = graph.edges.sparkSession
    path = cut(shortest_path(graph, start, end))
    length = path.agg(F.max("dist")).first()[0]
    if length is None:
        return spark.createDataFrame([], "v long, on_path boolean, t double, t_harmonic double, dist double, excess double, in_excess boolean")
    ds = distances(graph.edges, _one(spark, start), reach=length).select("v", F.col("dist").alias("ds"))
    de = distances(graph.edges, _one(spark, end), reach=length).select("v", F.col("dist").alias("de"))
    tube = distances_to_path(graph, path).filter(F.col("dist") <= relative_radius * length).select("v", "dist")
    arc = path.select("v", (F.col("dist") / length).alias("arc"))
    c = tube.join(ds, "v").join(de, "v").join(arc, "v", "left")
    c = cut(c.select("v", F.col("arc").isNotNull().alias("on_path"), "arc", ((length + F.col("ds") - F.col("de")) / (2 * length)).alias("t"), "dist", (F.col("ds") + F.col("de") - length).alias("excess")))
    h = harmonic_extension(graph, c.select("v", F.col("arc").alias("value")))
    tol = F.lit(None).cast("boolean") if excess_tol is None else F.col("excess") <= excess_tol
    return c.join(h, "v", "left").select("v", "on_path", "t", F.col("value").alias("t_harmonic"), "dist", "excess", tol.alias("in_excess"))


def harmonic_extension(graph: Graph, region: DataFrame, tolerance: float = 1e-12, rounds: int = 100_000, method: str = "harmonic") -> DataFrame:
    """(v, value): region (v, value) with its null values replaced by an extension of those given, which stay.

    `harmonic`: each is the mean of its neighbours in the region, weighted by 1 / length. `biharmonic`: the square of that operator
    vanishes instead, which bends less at the given values. `weighted_mean`: rounds that give a vertex the weighted mean of the
    neighbours that have a value by then, ring by ring. `boundary_smoothed`: harmonic, then one such mean over the vertices next
    to given ones. A part of the region without any given value stays null. Each connected part of the region is
    solved in one task, by conjugate gradients over its edges whatever its size, until the residual has fallen to the
    tolerance times its first size; more than `rounds` of them are an error.
    """
    ids = region.select("v")
    e = graph.edges.join(ids.withColumnRenamed("v", "src"), "src", "left_semi").join(ids.withColumnRenamed("v", "dst"), "dst", "left_semi")
    part = cut(components(ids, e))
    rows = e.select(F.col("src").alias("v"), F.col("dst"), F.col("len"), F.lit(None).cast("double").alias("value"))
    rows = rows.union(region.select("v", F.lit(None).cast("long"), F.lit(None).cast("double"), "value"))

    def solve(table):
        import numpy as np
        import pyarrow as pa

        dst = table["dst"].to_numpy(zero_copy_only=False)
        node = np.isnan(dst.astype("float64"))
        v = table["v"].to_numpy()
        ids, value = v[node], table["value"].to_numpy(zero_copy_only=False)[node].astype("float64")
        order = np.argsort(ids)
        ids, value = ids[order], value[order]
        a, b = np.searchsorted(ids, v[~node]), np.searchsorted(ids, dst[~node].astype("int64"))
        w = 1.0 / np.maximum(table["len"].to_numpy(zero_copy_only=False)[~node].astype("float64"), 1e-12)
        free = np.isnan(value)
        total = np.bincount(a, w, len(ids))
        if free.any() and not free.all():
            if method == "weighted_mean":
                while free.any():
                    told = ~free[b] & free[a]
                    weight = np.bincount(a[told], w[told], len(ids))
                    sums = np.bincount(a[told], w[told] * value[b[told]], len(ids))
                    reached = free & (weight > 0)
                    if not reached.any():
                        break
                    value[reached] = sums[reached] / weight[reached]
                    free = free & ~reached
            else:
                laplace = lambda x: total * x - np.bincount(a, w * x[b], len(ids))
                # The system is symmetric: L for harmonic, L D^-1 L for biharmonic, on the free vertices.
                apply = laplace if method != "biharmonic" else lambda x: laplace(laplace(x) / np.maximum(total, 1e-300))
                scale = np.where(free, total, 0.0)
                x = np.where(free, value[~free].mean(), np.nan_to_num(value))
                r = np.where(free, -apply(x), 0.0)
                z = np.divide(r, scale, out=np.zeros_like(r), where=scale > 0)
                p, rz, goal = z, r @ z, tolerance * np.sqrt((r * r).sum())
                for _ in range(rounds):
                    if np.sqrt((r * r).sum()) <= goal:
                        break
                    ap = np.where(free, apply(p), 0.0)
                    step = rz / (p @ ap)
                    x, r = x + step * p, r - step * ap
                    z = np.divide(r, scale, out=np.zeros_like(r), where=scale > 0)
                    rz, old = r @ z, rz
                    p = z + rz / old * p
                else:
                    raise ArithmeticError(f"no extension to {tolerance:g} in {rounds} rounds")
                value = x
            if method == "boundary_smoothed":
                edge = np.zeros(len(ids), bool)
                edge[a[free[a] & ~free[b]]] = True
                mean = np.bincount(a, w * value[b], len(ids)) / np.maximum(total, 1e-300)
                value[edge] = 0.5 * value[edge] + 0.5 * mean[edge]
        return pa.table({"v": pa.array(ids, pa.int64()), "value": pa.array(value, pa.float64(), mask=np.isnan(value))})

    return rows.join(part, "v").groupBy("component").applyInArrow(lambda t: solve(t.drop_columns(["component"])), "v long, value double")


# Monotone graphs


def monotone_edges(graph: Graph, field: DataFrame, q: float = 1.0, up: bool = True) -> DataFrame:
    """(src, dst, len): edges to strictly higher (lower) neighbours, up to the q-quantile of lengths."""
    e = edge_values(graph, field).crossJoin(F.broadcast(edge_length_quantile(graph, q)))
    return e.filter("len <= threshold").filter("yd > ys" if up else "yd < ys").select("src", "dst", "len")


def madag(graph: Graph, field: DataFrame, source: int, q: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of the monotone ascending graph that a vertex reaches.

    vertices: (v, y, from_source, to_sink, is_sink): numbers of ascending paths from the source and on to any sink, as exact
    decimals. Numbers of paths grow exponentially; one of over 38 digits is an arithmetic overflow error.
    """
    e = cut(monotone_edges(graph, field, q).select("src", "dst"))
    spark = e.sparkSession
    big = "decimal(38,0)"
    front = spark.createDataFrame([(source,)], "v long").select("v", F.lit(1).cast(big).alias("c"))
    total = front = cut(front)
    while True:
        # paths one edge longer, counted per end; a path of a vertex is met once, by its length
        front = cut(front.join(e, front.v == e.src).groupBy(F.col("dst").alias("v")).agg(F.sum("c").cast(big).alias("c")))
        if front.isEmpty():
            break
        total = cut(total.union(front).groupBy("v").agg(F.sum("c").cast(big).alias("c")))
    reach = total.select("v")
    inner = cut(e.join(reach.withColumnRenamed("v", "src"), "src", "left_semi"))
    sinks = reach.join(inner.select(F.col("src").alias("v")).distinct(), "v", "left_anti")
    back = cut(sinks.select("v", F.lit(1).cast(big).alias("c")))
    after = back
    while True:
        back = cut(back.join(inner, back.v == inner.dst).groupBy(F.col("src").alias("v")).agg(F.sum("c").cast(big).alias("c")))
        if back.isEmpty():
            break
        after = cut(after.union(back).groupBy("v").agg(F.sum("c").cast(big).alias("c")))
    vs = total.withColumnRenamed("c", "from_source").join(after.withColumnRenamed("c", "to_sink"), "v").join(field, "v").join(sinks.withColumn("s", F.lit(True)), "v", "left")
    return vs.select("v", "y", "from_source", "to_sink", F.coalesce("s", F.lit(False)).alias("is_sink")), inner


def paths_to(vertices: DataFrame, edges: DataFrame, sink: int) -> DataFrame:
    """(v, paths): ascending paths from the source through v to one sink; vertices on none are left out."""
    big = "decimal(38,0)"
    back = cut(vertices.filter(F.col("v") == sink).select("v", F.lit(1).cast(big).alias("c")))
    after = back
    while True:
        back = cut(back.join(edges, back.v == edges.dst).groupBy(F.col("src").alias("v")).agg(F.sum("c").cast(big).alias("c")))
        if back.isEmpty():
            break
        after = cut(after.union(back).groupBy("v").agg(F.sum("c").cast(big).alias("c")))
    return vertices.join(after, "v").select("v", (F.col("from_source") * F.col("c")).cast(big).alias("paths"))


def madag_cells(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(sink, value, trajectories): a cell per sink; its path count from the source."""
    return vertices.filter("is_sink").select(F.col("v").alias("sink"), F.col("y").alias("value"), F.col("from_source").alias("trajectories"))


def bottlenecks(vertices: DataFrame, edges: DataFrame, source: int, sink: int, least: float = 0.5) -> DataFrame:
    """(v, share): inner vertices that carry at least a share of the paths from source to sink."""
    p = paths_to(vertices, edges, sink)
    total = p.filter(F.col("v") == sink).select(F.col("paths").alias("total"))
    j = p.filter((F.col("v") != sink) & (F.col("v") != source)).crossJoin(F.broadcast(total))
    return j.select("v", (F.col("paths").cast("double") / F.col("total").cast("double")).alias("share")).filter(F.col("share") >= least)


def enumerate_paths(edges: DataFrame, source: int, sink: int, most: int = 10_000) -> DataFrame:
    """(path): the ascending paths from source to sink if there are at most `most` of them, else no row (they are counted only)."""
    spark = edges.sparkSession
    at = spark.createDataFrame([(source, [source])], "at long, path array<long>")
    done = spark.createDataFrame([], "path array<long>")
    while True:
        at = cut(at.join(edges, at["at"] == edges.src).select(F.col("dst").alias("at"), F.array_append("path", F.col("dst")).alias("path")))
        if at.isEmpty():
            return done
        done = cut(done.union(at.filter(F.col("at") == sink).select("path")))
        if done.count() > most:
            return done.limit(0)


# Reachability


def geodesic_basins(graph: Graph, field: DataFrame, extrema: DataFrame, q: float = 0.9) -> DataFrame:
    """(extremum, type, v, hop, dist, pred): geodesic reachability basins of extrema (v, type).

    From an extremum vertices are settled by (distance, vertex); one is accepted if the edge that it is reached by goes strictly
    down (up for minima) and is no longer than the q-quantile; others are rejected for good and block. All searches run
    side by side, rows dealt by extremum and vertex: a round settles, of each search, every vertex at a distance that no
    open vertex can undercut by its shortest edge. Of equally long ways the one from the vertex settled first counts.
    """
    values = field.select("v", "y")
    e = edge_values(graph, field).crossJoin(F.broadcast(edge_length_quantile(graph, q)))
    e = cut(e.select(F.col("src").alias("from"), "dst", "len", (F.col("len") <= F.col("threshold")).alias("short"), F.signum(F.col("yd") - F.col("ys")).alias("rise")))
    least = cut(values.join(e.groupBy(F.col("from").alias("v")).agg(F.min("len").alias("least")), "v", "left").select("v", F.coalesce("least", F.lit(0.0)).alias("least")))
    none = F.lit(None)
    first = F.struct(F.lit(0.0).alias("dist"), none.cast("double").alias("before"), none.cast("long").alias("pred"), F.lit(0).alias("hop"), F.lit(True).alias("good"))
    open_ = cut(extrema.select(F.col("v").alias("ref"), "type", "v", first.alias("b")))
    key, done, out, rounds = ["ref", "type", "v"], None, None, 0
    while True:
        reach = open_.join(least, "v").withColumn("limit", F.min(F.col("b.dist") + F.col("least")).over(Window.partitionBy("ref", "type")))
        now = cut(reach.select(*key, "b", (F.col("b.dist") <= F.col("limit")).alias("settled")))
        new = now.filter("settled").drop("settled")
        done = new.select(*key) if done is None else done.union(new.select(*key))
        out = new.filter("b.good") if out is None else out.union(new.filter("b.good"))
        good = (F.col("short")) & F.when(F.col("type") == "max", F.col("rise") < 0).otherwise(F.col("rise") > 0)
        way = F.struct((F.col("b.dist") + F.col("len")).alias("dist"), F.col("b.dist").alias("before"), F.col("from").alias("pred"), (F.col("b.hop") + 1).alias("hop"), good.alias("good"))
        far = new.filter("b.good").withColumnRenamed("v", "from").join(e, "from").select("ref", "type", F.col("dst").alias("v"), way.alias("b"))
        far = far.join(done, key, "left_anti")
        rounds += 1
        if rounds % 8 == 0:  # Long searches keep short plans.
            done, out = cut(done), cut(out)
        open_ = cut(now.filter("not settled").drop("settled").union(far).groupBy(*key).agg(F.min("b").alias("b")))
        if open_.isEmpty():
            return out.select(F.col("ref").alias("extremum"), "type", "v", "b.hop", "b.dist", "b.pred")


def terminals(graph: Graph, field: DataFrame, basins: DataFrame) -> DataFrame:
    """(extremum, type, v): basin vertices (extremum, type, v) without a neighbour in the basin beyond them (lower for maxima)."""
    e = edge_values(graph, field)
    b = basins.select("extremum", "type", "v").distinct()
    inside = e.join(b.withColumnRenamed("v", "src"), "src").join(b.withColumnRenamed("v", "dst"), ["dst", "extremum", "type"])
    beyond = inside.filter("(type = 'max' and yd < ys) or (type = 'min' and yd > ys)").select("extremum", "type", F.col("src").alias("v")).distinct()
    return b.join(beyond, ["extremum", "type", "v"], "left_anti")


def spurious_tree(root: int, kind: str, basins: DataFrame, spurious: DataFrame, extrema: DataFrame) -> DataFrame:
    """(level, parent, v, type, leaf): extrema of the opposite type inside a spurious extremum's basin are its children, those that
    are not spurious are leaves; each extremum is met once, on the first level that has it, from the smallest parent.

    basins: (extremum, type, v); spurious: (v, type); extrema: (v, type). The tree's class is by the types of its leaves.
    """
    spark = basins.sparkSession
    bad = spurious.select("v", F.col("type"), F.lit(True).alias("bad"))
    inside = basins.select(F.col("extremum").alias("parent"), F.col("type").alias("ptype"), "v").join(extrema.select("v", "type"), "v").filter("type <> ptype")
    inside = cut(inside.join(bad, ["v", "type"], "left").select("parent", "ptype", "v", "type", F.coalesce("bad", F.lit(False)).alias("bad")))
    out = cut(spark.createDataFrame([(0, None, root, kind, False)], "level int, parent long, v long, type string, leaf boolean"))
    front, level = out, 0
    while True:
        level += 1
        nxt = front.filter("not leaf").select(F.col("v").alias("parent"), F.col("type").alias("ptype")).join(inside, ["parent", "ptype"])
        nxt = nxt.groupBy("v", "type").agg(F.min("parent").alias("parent"), F.first("bad").alias("bad")).join(out.select("v", "type"), ["v", "type"], "left_anti")
        front = cut(nxt.select(F.lit(level).alias("level"), "parent", "v", "type", (~F.col("bad")).alias("leaf")))
        if front.isEmpty():
            return out
        out = cut(out.union(front))


def smooth_spurious(graph: Graph, field: DataFrame, threshold: int = 2, method: str = "harmonic", rounds: int = 5, most: int = 32) -> tuple[DataFrame, list[dict]]:
    """(field, log): a field without extrema of hop index up to a threshold, as far as rounds of smoothing go.

    A round lets go of the values within (not at) the hop index of every such extremum and extends the others into the gap.
    The log has for each round the number of such extrema before it.
    """
    from .extrema import extrema_table, hop_index, hop_neighbourhoods

    log = []
    for k in range(rounds):
        low = cut(hop_index(graph, field, extrema_table(graph, field), most).filter(F.col("hop_idx") <= threshold))
        log.append({"round": k, "spurious": low.count()})
        if not log[-1]["spurious"]:
            break
        inner = hop_neighbourhoods(graph, low).filter("not boundary").select("v").distinct().withColumn("gap", F.lit(True))
        region = field.join(inner, "v", "left").select("v", F.when(F.col("gap").isNull(), F.col("y")).alias("value"))
        new = harmonic_extension(graph, region, method=method)
        field = cut(new.join(field, "v").select("v", F.coalesce("value", "y").alias("y")))
    return field, log


def constrained_flow(graph: Graph, core: Graph, field: DataFrame, reach: float) -> DataFrame:
    """(v, next): the best strict gain among vertices that a shortest path in the core graph of length up to `reach` leads to
    with values that rise at every step; ties to the nearer, then the smaller vertex.

    Searches from every vertex: in a task from a block of vertices, in arrays beside all edges.
    """
    from .dense import best_on_rising_shortest

    ends = core.edges.select(F.col("src").alias("v")).union(core.edges.select("dst"))
    nodes = graph.vertices.select("v").union(core.vertices.select("v")).union(ends).distinct().join(field.select("v", "y"), "v", "left")
    best = best_on_rising_shortest(graph.vertices, nodes, core.edges, reach)
    return graph.vertices.join(best, "v", "left").select("v", "next")


def scale_flow(graph: Graph, field: DataFrame, scale: float, up: bool = True) -> DataFrame:
    """(v, next): the vertex of best value within a distance `scale` if it improves on v's own, ties to the nearer, then smaller.

    Vertices u travel outwards; of those that reach a vertex only they go on that no u of better value (or of equal value and
    smaller id) reaches as near, which is some log n of them a vertex: what such a better one reaches, it reaches as near.
    """
    value = F.col("y") if up else -F.col("y")
    best = cut(graph.vertices.select("v").join(field, "v").filter("y is not null").select("v", F.col("v").alias("u"), value.alias("y"), F.lit(0.0).alias("dist")))
    front = best
    before = Window.partitionBy("v").orderBy("dist", F.desc("y"), "u", "new").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        out = front.join(graph.edges, front.v == graph.edges.src).select(F.col("dst").alias("v"), "u", "y", (F.col("dist") + F.col("len")).alias("dist"))
        out = out.filter(F.col("dist") <= scale).groupBy("v", "u", "y").agg(F.min("dist").alias("dist"))
        every = best.withColumn("new", F.lit(False)).union(out.withColumn("new", F.lit(True)))
        rank = F.struct("y", -F.col("u"))
        after = cut(every.withColumn("rank", rank).withColumn("above", F.max("rank").over(before)).filter("above is null or rank > above").drop("rank", "above"))
        front, best = after.filter("new").drop("new"), after.drop("new")
        if front.isEmpty():
            break
    own = field.select("v", value.alias("own"))
    best = best.join(own, "v").filter("y > own").groupBy("v").agg(F.min(F.struct((-F.col("y")).alias("s"), "dist", "u")).alias("b"))
    return graph.vertices.join(best, "v", "left").select("v", F.col("b.u").alias("next"))


def cell_path(up: DataFrame, down: DataFrame, v: int) -> DataFrame:
    """(position, v): the walk from a minimum through v to a maximum along next-vertex tables (v, next)."""
    seed = up.filter(F.col("v") == v).select("v")
    rise, fall = trajectories(up, seed), trajectories(down, seed)
    whole = rise.withColumnRenamed("path", "p").join(fall, "seed").select(F.concat(F.reverse("path"), F.expr("slice(p, 2, size(p))")).alias("path"))
    return whole.select(F.posexplode("path").alias("position", "v"))
