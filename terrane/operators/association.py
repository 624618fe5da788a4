"""Association of two fields on a graph: local correlation and slope, polarity, overlap, and inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalars import HALF, edge_difference, sigmoid, winsorized
from ..functions.ranks import running
from ..graph import Graph

_TINY = 1e-10


def hop_graph(graph: Graph, radius: int, unit: bool = False) -> Graph:
    """Edges to all vertices within so many hops; lengths are shortest over such paths, or 1."""
    if radius <= 1:
        return graph
    edges = graph.edges
    for _ in range(radius - 1):
        b = graph.edges.select(F.col("src").alias("dst"), F.col("dst").alias("d2"), F.col("len").alias("l2"))
        far = edges.join(b, "dst").filter("src <> d2").select("src", F.col("d2").alias("dst"), (F.col("len") + F.col("l2")).alias("len"))
        edges = edges.union(far).groupBy("src", "dst").agg(F.min("len").alias("len"))
    return Graph(graph.vertices, edges.withColumn("len", F.lit(1.0)) if unit else edges)


def adaptive_epsilon(values: DataFrame, column: str) -> DataFrame:
    """One row (epsilon): 1e-6 of the least positive value, or 1e-6."""
    return values.agg(F.coalesce(F.min(F.when(F.col(column) > 0, F.col(column))) * 1e-6, F.lit(1e-6)).alias("epsilon"))


def _differences(graph: Graph, y: DataFrame, z: DataFrame, y_kind: str, z_kind: str, epsilon: float = 0.0) -> DataFrame:
    """(src, dst, len, feature, dy, dz) for each directed edge and feature of z (v, feature, value)."""
    ends = lambda f, c, end, names: f.select(F.col("v").alias(end), *(F.col(a).alias(b) for a, b in names))
    e = graph.edges.join(ends(y, "y", "src", [("y", "ys")]), "src").join(ends(y, "y", "dst", [("y", "yd")]), "dst")
    e = e.join(ends(z, "z", "src", [("feature", "feature"), ("value", "zs")]), "src").join(ends(z, "z", "dst", [("feature", "feature"), ("value", "zd")]), ["dst", "feature"])
    ey = ez = F.lit(epsilon)
    if y_kind == "logratio" and epsilon <= 0:
        e, ey = e.crossJoin(F.broadcast(adaptive_epsilon(y, "y").withColumnRenamed("epsilon", "ey"))), F.col("ey")
    if z_kind == "logratio" and epsilon <= 0:
        e, ez = e.crossJoin(F.broadcast(adaptive_epsilon(z, "value").withColumnRenamed("epsilon", "ez"))), F.col("ez")
    return e.select("src", "dst", "len", "feature", edge_difference(F.col("yd"), F.col("ys"), y_kind, ey).alias("dy"), edge_difference(F.col("zd"), F.col("zs"), z_kind, ez).alias("dz"))


def lcor_matrix(graph: Graph, y: DataFrame, z: DataFrame, kind: str = "derivative", y_diff: str = "difference", z_diff: str = "difference",
                epsilon: float = 0.0, winsor: float = 0.0, hop_radius: int = 1, edges: bool = False) -> DataFrame:
    """(v, feature, lcor): per vertex, the correlation of edge differences of y (v, y) and each feature of z (v, feature, value).

    Edges weigh 1 (`unit`, `sign`) or 1 / len^2 (`derivative`, which leaves out lengths up to 1e-10). The value is 0 where a root
    of the sums of squares is at most 1e-10, and is clamped to [-1, 1]. With `winsor` q, differences are clipped to the
    floor(n q)-th and ceil(n (1 - q))-th smallest of all directed differences of their field. `edges` returns the weighted
    edge table instead (src, dst, feature, dy, dz, w). One edge join serves all features.
    """
    d = _differences(hop_graph(graph, hop_radius, kind != "derivative"), y, z, y_diff, z_diff, epsilon)
    if kind == "derivative":
        d = d.filter(F.col("len") > _TINY).withColumn("w", 1 / (F.col("len") * F.col("len")))
    else:
        d = d.withColumn("w", F.lit(1.0))
    if 0 < winsor < 0.5:
        for c in ("dy", "dz"):
            # order statistics by exact ranks within each feature; counts per distinct value keep the window small
            per = d.groupBy("feature", c).agg(F.count("*").alias("c"))
            upto = Window.partitionBy("feature").orderBy(c)
            per = per.withColumn("upto", F.sum("c").over(upto)).withColumn("n", F.sum("c").over(Window.partitionBy("feature")))
            low = F.least(F.floor(F.col("n") * winsor), F.col("n") - 1)
            high = F.least(F.ceil(F.col("n") * (1 - winsor)) - 1, F.col("n") - 1)
            bounds = per.groupBy("feature").agg(F.min(F.when(F.col("upto") > low, F.col(c))).alias("lo"), F.min(F.when(F.col("upto") > high, F.col(c))).alias("hi"))
            d = d.join(bounds, "feature").withColumn(c, winsorized(F.col(c), F.col("lo"), F.col("hi"))).drop("lo", "hi")
    if edges:
        return d.select("src", "dst", "feature", "dy", "dz", "w")
    s = d.groupBy(F.col("src").alias("v"), "feature").agg(
        F.sum(F.col("w") * F.col("dy") * F.col("dz")).alias("n"), F.sqrt(F.sum(F.col("w") * F.col("dy") * F.col("dy"))).alias("a"), F.sqrt(F.sum(F.col("w") * F.col("dz") * F.col("dz"))).alias("b")
    )
    r = F.when((F.col("a") > _TINY) & (F.col("b") > _TINY), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("n") / (F.col("a") * F.col("b"))))).otherwise(0.0)
    every = z.select("v", "feature")
    return every.join(s, ["v", "feature"], "left").select("v", "feature", F.coalesce(r, F.lit(0.0)).alias("lcor"))


def one_feature(field: DataFrame) -> DataFrame:
    """A field (v, y) as (v, feature, value)."""
    return field.select("v", F.lit("z").alias("feature"), F.col("y").alias("value"))


def lcor(graph: Graph, y: DataFrame, z: DataFrame, **options) -> DataFrame:
    """(v, lcor) of two fields; options as for lcor_matrix."""
    return lcor_matrix(graph, y, one_feature(z), **options).select("v", "lcor")


def lcor_pairs(graph: Graph, fields: DataFrame, kind: str = "derivative") -> DataFrame:
    """(v, a, b, lcor) for all pairs a < b of features of fields (v, feature, value)."""
    e = graph.edges
    s = fields.select(F.col("v").alias("src"), F.col("feature").alias("f"), F.col("value").alias("x"))
    t = fields.select(F.col("v").alias("dst"), F.col("feature").alias("f"), F.col("value").alias("x2"))
    e = e.join(s, "src").join(t, ["dst", "f"]).select("src", "dst", "len", "f", (F.col("x2") - F.col("x")).alias("d"))
    e = e.filter(F.col("len") > _TINY).withColumn("w", 1 / (F.col("len") * F.col("len"))) if kind == "derivative" else e.withColumn("w", F.lit(1.0))
    # per vertex and edge the features stand in one row, so pairs are formed inside it and never shuffled apart
    row = e.groupBy("src", "dst", "w").agg(F.array_sort(F.collect_list(F.struct("f", "d"))).alias("fs"))
    pair = row.select("src", "w", F.explode("fs").alias("a"), "fs").select("src", "w", "a", F.explode("fs").alias("b")).filter("a.f < b.f")
    g = pair.groupBy(F.col("src").alias("v"), F.col("a.f").alias("a"), F.col("b.f").alias("b")).agg(
        F.sum(F.expr("w * a.d * b.d")).alias("n"), F.sqrt(F.sum(F.expr("w * a.d * a.d"))).alias("sa"), F.sqrt(F.sum(F.expr("w * b.d * b.d"))).alias("sb")
    )
    r = F.when((F.col("sa") > _TINY) & (F.col("sb") > _TINY), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("n") / (F.col("sa") * F.col("sb"))))).otherwise(0.0)
    return g.select("v", "a", "b", r.alias("lcor"))


def lslope(graph: Graph, y: DataFrame, z: DataFrame, kind: str = "slope", y_diff: str = "difference", z_diff: str = "difference", epsilon: float = 0.0,
           alpha: float = 0.0, sigmoid_kind: str = "tanh", up: bool = True) -> DataFrame:
    """(v, slope, neighbour, dy, dz, is_extremum): along the edge of best gain in y, ties to the smallest vertex.

    `slope` is dz / dy, `sign` the sign of dz, `normalized` a sigmoid of alpha times the slope, where alpha (if not given) makes the
    median absolute slope one half. Vertices without a gain, or with one up to 1e-10, are extrema with slope 0.
    """
    d = _differences(graph, y, one_feature(z), y_diff, z_diff, epsilon)
    gain = F.col("dy") if up else -F.col("dy")
    best = d.filter(gain > 0).groupBy(F.col("src").alias("v")).agg(F.min(F.struct((-gain).alias("g"), "dst", "dy", "dz")).alias("b"))
    out = y.select("v").join(best, "v", "left").select("v", F.col("b.dst").alias("neighbour"), F.coalesce("b.dy", F.lit(0.0)).alias("dy"), F.coalesce("b.dz", F.lit(0.0)).alias("dz"))
    out = out.withColumn("is_extremum", F.col("neighbour").isNull() | (F.abs("dy") <= _TINY))
    raw = F.when(~F.col("is_extremum"), F.col("dz") / F.col("dy"))
    if kind == "sign":
        value = F.when(~F.col("is_extremum"), F.signum("dz")).otherwise(0.0)
    elif kind == "slope":
        value = F.coalesce(raw, F.lit(0.0))
    else:
        if alpha <= 0:
            med = out.agg(F.median(F.abs(raw)).alias("med"))
            out = out.crossJoin(F.broadcast(med)).withColumn("alpha", HALF[sigmoid_kind] / F.when(F.col("med") < _TINY, 1.0).otherwise(F.coalesce("med", F.lit(1.0))))
        else:
            out = out.withColumn("alpha", F.lit(alpha))
        value = F.coalesce(sigmoid(F.col("alpha") * raw, sigmoid_kind), F.lit(0.0))
    return out.select("v", value.alias("slope"), "neighbour", "dy", "dz", "is_extremum")


def neighbourhood_slope(graph: Graph, y: DataFrame, z: DataFrame, kind: str = "derivative", y_diff: str = "difference", z_diff: str = "difference", epsilon: float = 0.0) -> DataFrame:
    """(v, slope, sd_y, sd_z, lcor): regression of z differences on y differences over a vertex's edges."""
    d = lcor_matrix(graph, y, one_feature(z), kind, y_diff, z_diff, epsilon, edges=True)
    s = d.groupBy(F.col("src").alias("v")).agg(F.sum(F.expr("w * dy * dz")).alias("n"), F.sum(F.expr("w * dy * dy")).alias("yy"), F.sum(F.expr("w * dz * dz")).alias("zz"))
    root = F.sqrt(F.col("yy")), F.sqrt(F.col("zz"))
    r = F.when((root[0] > _TINY) & (root[1] > _TINY), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("n") / (root[0] * root[1])))).otherwise(0.0)
    per = s.select("v", F.when(F.col("yy") > _TINY, F.col("n") / F.col("yy")).otherwise(0.0).alias("slope"), root[0].alias("sd_y"), root[1].alias("sd_z"), r.alias("lcor"))
    return y.select("v").join(per, "v", "left").na.fill(0.0)


def permutation_test(graph: Graph, y: DataFrame, z: DataFrame, statistic: str = "mean.abs", times: int = 99, seed: int = 1, **options) -> DataFrame:
    """(feature, observed, p_value, p_adjusted): statistic of lcor per feature against fields with permuted vertices.

    Permutations are ranks of seeded hashes, so reruns agree. p = (1 + permuted values at least as large) / (times + 1),
    adjusted by Benjamini and Hochberg.
    """
    stat = {"mean.abs": F.avg(F.abs("lcor")), "mean": F.avg("lcor"), "max.abs": F.max(F.abs("lcor"))}[statistic]
    place = running(z.select("v").distinct(), ["v"], {"i": F.lit(1)})
    draws = place.crossJoin(F.broadcast(place.sparkSession.range(1, times + 1).withColumnRenamed("id", "draw"))).withColumn("h", F.xxhash64(F.lit(seed), "draw", "v"))
    # Every draw has as many rows, so a rank over all of them gives the rank in each.
    draws = running(draws, ["draw", "h", "v"], {"j": F.lit(1)}).withColumn("i", F.col("j") - (F.col("draw") - 1) * place.count())
    moved = draws.select("draw", F.col("v").alias("to"), "i").join(place, "i").join(z, "v")
    null = moved.select(F.col("to").alias("v"), F.concat_ws("\x1f", F.col("draw").cast("string"), "feature").alias("feature"), "value")
    seen = lcor_matrix(graph, y, z, **options).groupBy("feature").agg(stat.alias("observed"))
    drawn = lcor_matrix(graph, y, null, **options).groupBy("feature").agg(stat.alias("s")).withColumn("feature", F.element_at(F.split("feature", "\x1f"), 2))
    p = seen.join(drawn, "feature").groupBy("feature", "observed").agg(((1 + F.sum((F.col("s") >= F.col("observed")).cast("int"))) / (times + 1.0)).alias("p_value"))
    return adjusted(p, "p_value")


def adjusted(rows: DataFrame, p: str) -> DataFrame:
    """Add p_adjusted by Benjamini and Hochberg."""
    by = Window.orderBy(p)
    ranked = rows.withColumn("__r", F.count("*").over(by.rangeBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.count("*").over(Window.partitionBy()))
    return ranked.withColumn("p_adjusted", F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(by.rangeBetween(0, Window.unboundedFollowing)))).drop("__r", "__n")


def lcor_posterior(graph: Graph, y: DataFrame, draws: DataFrame, level: float = 0.95, **options) -> DataFrame:
    """(v, feature, mean, sd, low, high) of lcor over draws (v, feature, draw, value) of the second field."""
    z = draws.select("v", F.concat_ws("\x1f", F.col("draw").cast("string"), "feature").alias("feature"), "value")
    got = lcor_matrix(graph, y, z, **options).withColumn("feature", F.element_at(F.split("feature", "\x1f"), 2))
    return got.groupBy("v", "feature").agg(
        F.avg("lcor").alias("mean"), F.stddev_samp("lcor").alias("sd"), F.expr(f"percentile(lcor, {(1 - level) / 2}D)").alias("low"), F.expr(f"percentile(lcor, {(1 + level) / 2}D)").alias("high")
    )


# Membership, cells and polarity


def membership_weights(membership: DataFrame) -> DataFrame:
    """(v, direction, extremum, weight): one over the number of a vertex's basins in that direction."""
    return membership.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("v", "direction")))


def cells(weights: DataFrame) -> DataFrame:
    """(v, max_id, min_id, weight): pairs of basins that hold a vertex, weighing the product of its weights."""
    hi = weights.filter("direction = 'max'").select("v", F.col("extremum").alias("max_id"), F.col("weight").alias("wh"))
    lo = weights.filter("direction = 'min'").select("v", F.col("extremum").alias("min_id"), F.col("weight").alias("wl"))
    return hi.join(lo, "v").select("v", "max_id", "min_id", (F.col("wh") * F.col("wl")).alias("weight"))


def polarity(field: DataFrame, weights: DataFrame, scale: str = "value", epsilon: float = 1e-10) -> DataFrame:
    """(v, theta, polarity, range): a vertex's place in the value range of its cells, weighted; null if it has no such cell.

    `value`: (y - min) / (max - min + epsilon), clamped; flat cells are skipped. `rank`: average rank in the cell, of vertices of
    exactly equal value, over its size - 1; cells of one vertex are skipped.
    """
    c = cells(weights).join(field, "v")
    hi, lo = field.select(F.col("v").alias("max_id"), F.col("y").alias("hi")), field.select(F.col("v").alias("min_id"), F.col("y").alias("lo"))
    c = c.join(hi, "max_id").join(lo, "min_id").withColumn("range", F.col("hi") - F.col("lo"))
    if scale == "value":
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("y") - F.col("lo")) / (F.col("range") + epsilon)))
        c = c.withColumn("t", F.when(F.col("range") >= epsilon, t))
    else:
        by, whole = Window.partitionBy("max_id", "min_id").orderBy("y"), Window.partitionBy("max_id", "min_id")
        c = c.withColumn("n", F.count("*").over(whole)).withColumn("first", F.rank().over(by) - 1).withColumn("same", F.count("*").over(Window.partitionBy("max_id", "min_id", "y")))
        c = c.withColumn("t", F.when(F.col("n") >= 2, (F.col("first") + (F.col("same") - 1) / 2.0) / (F.col("n") - 1)))
    per = c.filter("t is not null").groupBy("v").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("t")).alias("t"), F.sum(F.col("weight") * F.col("range")).alias("r")).filter(F.col("w") > epsilon)
    theta = F.col("t") / F.col("w")
    return field.select("v").join(per.select("v", theta.alias("theta"), (2 * theta - 1).alias("polarity"), (F.col("r") / F.col("w")).alias("range")), "v", "left")


def overlap(y_weights: DataFrame, z_weights: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """(y_dir, y_id, z_dir, z_id, overlap): mass-weighted soft contingency of basins, present pairs only."""
    a = y_weights.select("v", F.col("direction").alias("y_dir"), F.col("extremum").alias("y_id"), F.col("weight").alias("wy"))
    b = z_weights.select("v", F.col("direction").alias("z_dir"), F.col("extremum").alias("z_id"), F.col("weight").alias("wz"))
    j, m = a.join(b, "v"), F.lit(1.0)
    if mass is not None:
        j, m = j.join(mass.select("v", "mass"), "v"), F.col("mass")
    return j.groupBy("y_dir", "y_id", "z_dir", "z_id").agg(F.sum(m * F.col("wy") * F.col("wz")).alias("overlap"))


def deviation(overlaps: DataFrame) -> DataFrame:
    """Dense (y_dir, y_id, z_dir, z_id, overlap, expected, delta, zeta) per pair of directions, absent pairs as 0."""
    rows = overlaps.groupBy("y_dir", "y_id", "z_dir").agg(F.sum("overlap").alias("r"))
    cols = overlaps.groupBy("y_dir", "z_dir", "z_id").agg(F.sum("overlap").alias("c"))
    total = overlaps.groupBy("y_dir", "z_dir").agg(F.sum("overlap").alias("t"))
    every = rows.join(cols, ["y_dir", "z_dir"]).join(total, ["y_dir", "z_dir"]).join(overlaps, ["y_dir", "y_id", "z_dir", "z_id"], "left")
    e = F.col("r") * F.col("c") / F.col("t")
    room = e * (1 - F.col("r") / F.col("t")) * (1 - F.col("c") / F.col("t"))
    o = F.coalesce("overlap", F.lit(0.0))
    return every.select("y_dir", "y_id", "z_dir", "z_id", o.alias("overlap"), e.alias("expected"), (o - e).alias("delta"), F.when(room > 1e-15, (o - e) / F.sqrt(room)).otherwise(0.0).alias("zeta"))


def vertex_association(pol_y: DataFrame, pol_z: DataFrame) -> DataFrame:
    """(v, a_pol, s_pol): product of polarities and its sign with a dead zone of 1e-10; null if either is."""
    j = pol_y.select("v", F.col("polarity").alias("p")).join(pol_z.select("v", F.col("polarity").alias("q")), "v")
    a = F.col("p") * F.col("q")
    return j.select("v", a.alias("a_pol"), F.when(a > _TINY, 1).when(a < -_TINY, -1).when(a.isNotNull(), 0).cast("int").alias("s_pol"))


def global_association(assoc: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """One row (a_pol, kappa_pol, n): mass-weighted means of product and sign over vertices that have both."""
    j, m = assoc.filter("a_pol is not null"), F.lit(1.0)
    if mass is not None:
        j, m = j.join(mass.select("v", "mass"), "v"), F.col("mass")
    return j.agg((F.sum(m * F.col("a_pol")) / F.sum(m)).alias("a_pol"), (F.sum(m * F.col("s_pol")) / F.sum(m)).alias("kappa_pol"), F.count("*").alias("n"))


def basin_character(weights: DataFrame, other_polarity: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """(direction, extremum, chi, mass): mean polarity of the other field over a basin."""
    j, m = weights.join(other_polarity.filter("polarity is not null").select("v", "polarity"), "v"), F.lit(1.0)
    if mass is not None:
        j, m = j.join(mass.select("v", "mass"), "v"), F.col("mass")
    w = m * F.col("weight")
    return j.groupBy("direction", "extremum").agg(F.when(F.sum(w) > 1e-15, F.sum(w * F.col("polarity")) / F.sum(w)).otherwise(0.0).alias("chi"), F.sum(w).alias("mass"))


def edge_concordance(graph: Graph, y: DataFrame, z: DataFrame) -> DataFrame:
    """One row (concordant, discordant, tied) over undirected edges, by the signs of both differences."""
    d = _differences(graph, y, one_feature(z), "difference", "difference").filter("src < dst")
    s = F.signum("dy") * F.signum("dz")
    return d.agg(F.count(F.when(s > 0, 1)).alias("concordant"), F.count(F.when(s < 0, 1)).alias("discordant"), F.count(F.when(s == 0, 1)).alias("tied"))

