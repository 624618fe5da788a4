"""Basin tables: refinement stages, overlap clusters, expansion, cells, flow graph and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ranks import running
from ..graph import Graph, degrees
from .fixpoint import components, hops, nearest_source


def basin_table(field: DataFrame, membership: DataFrame) -> DataFrame:
    """(direction, extremum, value, size): one row per basin of membership (v, direction, extremum)."""
    per = membership.groupBy("direction", "extremum").agg(F.countDistinct("v").alias("size"))
    return per.join(field.select(F.col("v").alias("extremum"), F.col("y").alias("value")), "extremum").select("direction", "extremum", "value", "size")


def keep(membership: DataFrame, good: DataFrame) -> DataFrame:
    """Membership of the given extrema (extremum) only."""
    return membership.join(good.select("extremum").distinct(), "extremum", "left_semi")


def filter_relative(basins: DataFrame, field: DataFrame, least_max: float = 1.1, most_min: float = 0.9) -> DataFrame:
    """Basins whose extremum over the field's mean is at least (maxima) or at most (minima) a bound; adds relative."""
    b = basins.crossJoin(F.broadcast(field.agg(F.avg("y").alias("__mean")))).withColumn("relative", F.col("value") / F.col("__mean")).drop("__mean")
    return b.filter((F.col("direction") == "max") & (F.col("relative") >= least_max) | (F.col("direction") == "min") & (F.col("relative") <= most_min))


def overlap_distances(membership: DataFrame) -> DataFrame:
    """(direction, a, b, distance): 1 - common / smaller size, for basins a < b that share a vertex."""
    m = membership.select("v", "direction", "extremum").distinct()
    size = m.groupBy("direction", "extremum").agg(F.count("*").alias("n"))
    a, b = m.select("v", "direction", F.col("extremum").alias("a")), m.select("v", "direction", F.col("extremum").alias("b"))
    both = a.join(b, ["v", "direction"]).filter("a < b").groupBy("direction", "a", "b").agg(F.count("*").alias("common"))
    na, nb = size.select("direction", F.col("extremum").alias("a"), F.col("n").alias("na")), size.select("direction", F.col("extremum").alias("b"), F.col("n").alias("nb"))
    return both.join(na, ["direction", "a"]).join(nb, ["direction", "b"]).select("direction", "a", "b", (1 - F.col("common") / F.least("na", "nb")).alias("distance"))


def cluster_basins(basins: DataFrame, membership: DataFrame, threshold: float) -> DataFrame:
    """(direction, extremum, cluster, representative): single linkage of overlap distances below a threshold.

    The representative has the best extremum value, then the smallest vertex. A vertex may be extremum in one direction only.
    """
    links = overlap_distances(membership).filter(F.col("distance") < threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    part = components(basins.select(F.col("extremum").alias("v")), links).withColumnRenamed("v", "extremum")
    j = basins.join(part, "extremum")
    best = Window.partitionBy("direction", "component").orderBy(F.when(F.col("direction") == "max", -F.col("value")).otherwise(F.col("value")), "extremum")
    return j.select("direction", "extremum", F.col("component").alias("cluster"), F.first("extremum").over(best).alias("representative"))


def merge_clusters(membership: DataFrame, clusters: DataFrame) -> DataFrame:
    """Membership of the representatives: the union of their clusters' supports."""
    r = clusters.select("direction", "extremum", "representative")
    return membership.join(r, ["direction", "extremum"]).select("v", "direction", F.col("representative").alias("extremum")).distinct()


def geometry(graph: Graph, k: int = 2) -> DataFrame:
    """(v, p_mean_nbrs, p_mean_hopk, p_degree): share of vertices at or below its mean neighbour length, at or below its
    mean distance (in hops' path lengths) to vertices k hops off, and with at least its degree."""
    from .fixpoint import distances

    d = degrees(graph)
    starts = graph.vertices.select(F.col("v").alias("ref"), "v")
    ring = hops(graph.edges, starts, most=k).filter(F.col("hop") == k)
    far = distances(graph.edges, starts, hops=k).join(ring, ["ref", "v"]).groupBy(F.col("ref").alias("v")).agg(F.avg("dist").alias("mean_hopk"))
    j = d.join(far, "v", "left")
    n = j.agg(F.count("*").alias("n"))
    for name, by in (("p_mean_nbrs", F.col("mean_len").asc()), ("p_mean_hopk", F.col("mean_hopk").asc()), ("p_degree", F.col("degree").desc())):
        j = running(j, [by], {name: F.lit(1)})
    return j.crossJoin(F.broadcast(n)).select("v", *((F.col(c) / F.col("n")).alias(c) for c in ("p_mean_nbrs", "p_mean_hopk", "p_degree")))


def filter_geometry(basins: DataFrame, shares: DataFrame, nbrs: float = 0.9, hopk: float = 0.9, degree: float = 0.9) -> DataFrame:
    """Basins whose extremum has shares below, below, and at most the bounds."""
    ok = shares.filter((F.col("p_mean_nbrs") < nbrs) & (F.col("p_mean_hopk") < hopk) & (F.col("p_degree") <= degree))
    return basins.join(ok.select(F.col("v").alias("extremum")), "extremum", "left_semi")


def filter_support(basins: DataFrame, membership: DataFrame, size: int = 1, paths: DataFrame | None = None, n_paths: int = 0, mass: DataFrame | None = None, share: float = 0.0) -> DataFrame:
    """Basins of at least a size, a number of trajectories and a share of all mass (which must be given for the last)."""
    out = basins.filter(F.col("size") >= size)
    if n_paths:
        n = paths.select(F.lit("max").alias("direction"), F.col("max").alias("extremum")).union(paths.select(F.lit("min"), "min")).groupBy("direction", "extremum").count()
        out = out.join(n.filter(F.col("count") >= n_paths), ["direction", "extremum"], "left_semi")
    if share:
        if mass is None:
            raise ValueError("a share of mass needs vertex masses")
        per = membership.join(mass, "v").groupBy("direction", "extremum").agg(F.sum("mass").alias("m")).crossJoin(F.broadcast(mass.agg(F.sum("mass").alias("t"))))
        out = out.join(per.filter(F.col("m") / F.col("t") >= share), ["direction", "extremum"], "left_semi")
    return out


def expand_to_cover(graph: Graph, membership: DataFrame, direction: str) -> DataFrame:
    """(v, extremum, dist): uncovered vertices join the basin of the nearest covered one, by (distance, vertex).

    Where basins overlap, the largest extremum id labels a covered vertex. Vertices that reach no covered one are left out.
    """
    cover = membership.filter(F.col("direction") == direction).groupBy("v").agg(F.max("extremum").alias("extremum"))
    near = nearest_source(graph, cover.select("v", F.col("v").alias("rank")))
    return near.join(cover.withColumnRenamed("v", "source"), "source").select("v", "extremum", "dist")


def primary(basins: DataFrame, membership: DataFrame) -> DataFrame:
    """(v, direction, extremum): of a vertex's basins the one of best extremum value, then of the smallest vertex."""
    j = membership.join(basins.select("direction", "extremum", "value"), ["direction", "extremum"])
    by = Window.partitionBy("v", "direction").orderBy(F.when(F.col("direction") == "max", -F.col("value")).otherwise(F.col("value")), "extremum")
    return j.withColumn("rn", F.row_number().over(by)).filter("rn = 1").select("v", "direction", "extremum")


def boundary(graph: Graph, members: DataFrame) -> DataFrame:
    """(v): members (v) with a neighbour outside."""
    out = graph.edges.join(members.select(F.col("v").alias("dst")), "dst", "left_anti")
    return out.join(members.select(F.col("v").alias("src")), "src", "left_semi").select(F.col("src").alias("v")).distinct()


def flow_graph(membership: DataFrame, min_common: int = 1, kind: str = "all") -> DataFrame:
    """(a_dir, a, b_dir, b, common, weight): basins that share vertices, with Dice weight 2 common / (sizes).

    kind: `all`, `ms_only` (a maximum's and a minimum's) or `same_type`. Each pair once, maxima first, then by id.
    """
    m = membership.select("v", "direction", "extremum").distinct()
    size = m.groupBy("direction", "extremum").agg(F.count("*").alias("n"))
    a = m.select("v", F.col("direction").alias("a_dir"), F.col("extremum").alias("a"))
    b = m.select("v", F.col("direction").alias("b_dir"), F.col("extremum").alias("b"))
    j = a.join(b, "v").filter("a_dir < b_dir or (a_dir = b_dir and a < b)")
    j = {"all": j, "ms_only": j.filter("a_dir <> b_dir"), "same_type": j.filter("a_dir = b_dir")}[kind]
    c = j.groupBy("a_dir", "a", "b_dir", "b").agg(F.count("*").alias("common")).filter(F.col("common") >= min_common)
    sa, sb = size.select(F.col("direction").alias("a_dir"), F.col("extremum").alias("a"), F.col("n").alias("na")), size.select(F.col("direction").alias("b_dir"), F.col("extremum").alias("b"), F.col("n").alias("nb"))
    return c.join(sa, ["a_dir", "a"]).join(sb, ["b_dir", "b"]).select("a_dir", "a", "b_dir", "b", "common", (2.0 * F.col("common") / (F.col("na") + F.col("nb"))).alias("weight"))


def flow_cells(membership: DataFrame, min_size: int = 1) -> DataFrame:
    """(max_id, min_id, size): cells of a maximum's and a minimum's basin of at least a size."""
    hi = membership.filter("direction = 'max'").select("v", F.col("extremum").alias("max_id"))
    lo = membership.filter("direction = 'min'").select("v", F.col("extremum").alias("min_id"))
    return hi.join(lo, "v").groupBy("max_id", "min_id").agg(F.countDistinct("v").alias("size")).filter(F.col("size") >= min_size)


def contingency(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) for every pair of labels, absent ones as 0."""
    n = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    every = labels.select(F.col(a).alias("a")).distinct().crossJoin(labels.select(F.col(b).alias("b")).distinct())
    return every.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n"))


def summary(graph: Graph, basins: DataFrame, field: DataFrame) -> DataFrame:
    """Ranked summary: direction, rank, label, extremum, value, relative, size, degree."""
    j = basins.crossJoin(F.broadcast(field.agg(F.avg("y").alias("mean")))).join(degrees(graph).select(F.col("v").alias("extremum"), "degree"), "extremum")
    by = Window.partitionBy("direction").orderBy(F.when(F.col("direction") == "max", -F.col("value")).otherwise(F.col("value")), "extremum")
    j = j.withColumn("rank", F.row_number().over(by))
    return j.select("direction", "rank", F.concat(F.when(F.col("direction") == "max", "M").otherwise("m"), F.col("rank").cast("string")).alias("label"), "extremum", "value", (F.col("value") / F.col("mean")).alias("relative"), "size", "degree")


def cell_values(labels: DataFrame, field: DataFrame) -> DataFrame:
    """(cell, n, mean, low, high, median) of a field over cells (v, cell)."""
    return labels.join(field, "v").groupBy("cell").agg(F.count("*").alias("n"), F.avg("y").alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.median("y").alias("median"))


def carriers(values: DataFrame, members: DataFrame, above: float = 0.0) -> DataFrame:
    """(feature, carriers, share): members (v) with a value above a bound, most first."""
    j = values.join(members.select("v"), "v", "left_semi").filter("value is not null")
    return j.groupBy("feature").agg(F.sum((F.col("value") > above).cast("long")).alias("carriers"), F.avg((F.col("value") > above).cast("double")).alias("share")).orderBy(F.col("carriers").desc(), "feature")


def profile(values: DataFrame, top: int = 5) -> DataFrame:
    """(v, rank, feature, value): the largest positive features of each vertex, ties by name."""
    by = Window.partitionBy("v").orderBy(F.col("value").desc(), "feature")
    return values.filter("value > 0").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= top).select("v", "rank", "feature", "value")


def longest_run(rows: DataFrame, group: str, order: list[str], flag: str) -> DataFrame:
    """(group, start, length): the first longest run of true flags in order, start counted from 1; groups without any are left out."""
    by = Window.partitionBy(group).orderBy(*order)
    r = rows.withColumn("i", F.row_number().over(by)).filter(F.col(flag)).withColumn("island", F.col("i") - F.row_number().over(by))
    runs = r.groupBy(group, "island").agg(F.min("i").alias("start"), F.count("*").alias("length"))
    best = Window.partitionBy(group).orderBy(F.col("length").desc(), "start")
    return runs.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(group, "start", "length")


def filter_cells(cells: DataFrame, min_size: int | None = None, max_size: int | None = None, min_paths: int | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Cells (.., size, paths) within bounds of size, number of paths, and type-7 quantiles of size."""
    out = cells
    if low is not None or high is not None:
        q = cells.agg(F.expr(f"percentile(size, {low or 0.0}D)").alias("__lo"), F.expr(f"percentile(size, {1.0 if high is None else high}D)").alias("__hi"))
        out = out.crossJoin(F.broadcast(q)).filter("size >= __lo and size <= __hi").drop("__lo", "__hi")
    for bound, test in ((min_size, "size >= {}"), (max_size, "size <= {}"), (min_paths, "paths >= {}")):
        if bound is not None:
            out = out.filter(test.format(int(bound)))
    return out


def short_labels(profiles: DataFrame, least: float) -> DataFrame:
    """(v, label): initials of the first two words of each feature at or above `least` (of the top one if none), top first.

    profiles: (v, rank, feature, value). Labels that coincide grow by the next feature's initials until they differ or run out.
    """
    word = lambda k: F.substring(F.coalesce(F.get(F.split("feature", "_"), F.lit(k)), F.lit("")), 1, 1)
    p = profiles.withColumn("s", F.concat(word(0), word(1)))
    listed = p.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("rank", "s"))).alias("all"), F.greatest(F.sum((F.col("value") >= least).cast("int")), F.lit(1)).alias("n"))
    at = listed.select("v", F.transform("all", lambda x: x["s"]).alias("all"), "n")
    most = at.agg(F.max(F.size("all"))).first()[0] or 0
    for _ in range(most):
        label = F.concat_ws("", F.slice("all", F.lit(1), F.col("n")))
        at = at.withColumn("label", label).withColumn("same", F.count("*").over(Window.partitionBy("label")))
        at = at.select("v", "all", F.when((F.col("same") > 1) & (F.col("n") < F.size("all")), F.col("n") + 1).otherwise(F.col("n")).alias("n"))
    return at.select("v", F.concat_ws("", F.slice("all", F.lit(1), F.col("n"))).alias("label"))


def extremality_summary(graph: Graph, field: DataFrame, scores: DataFrame, top: float = 0.95, least_degree: float = 0.1) -> DataFrame:
    """(v, type, label, y, score, degree): vertices whose score (v, maxp, minp) is in the top share and whose degree is not in the lowest."""
    d = degrees(graph).select("v", "degree")
    q = scores.join(d, "v").agg(F.expr(f"percentile(maxp, {top}D)").alias("qa"), F.expr(f"percentile(minp, {top}D)").alias("qi"), F.expr(f"percentile(degree, {least_degree}D)").alias("qd"))
    j = scores.join(d, "v").join(field, "v").crossJoin(F.broadcast(q)).filter("degree >= qd")
    hi = j.filter("maxp >= qa").select("v", F.lit("max").alias("type"), "y", F.col("maxp").alias("score"), "degree")
    out = hi.union(j.filter("minp >= qi").select("v", F.lit("min").alias("type"), "y", F.col("minp").alias("score"), "degree"))
    by = Window.partitionBy("type").orderBy(F.when(F.col("type") == "max", -F.col("y")).otherwise(F.col("y")), "v")
    return out.withColumn("label", F.concat(F.when(F.col("type") == "max", "M").otherwise("m"), F.row_number().over(by).cast("string"))).select("v", "type", "label", "y", "score", "degree")


def refinement_report(stages: list[dict]) -> str:
    """A line of text for each stage of a refinement."""
    return "\n".join(f"{s['stage']}: {s['before']} basins before, {s['after']} after" for s in stages)
