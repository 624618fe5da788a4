"""The basin complex of a field: one call, five methods, the same tables."""

from __future__ import annotations

from dataclasses import dataclass, field as _field

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import cut
from ..graph import Graph, validate, validate_field
from ..operators import basins as B, extrema as X, flow as W, merge_tree as M, paths as P
from ..operators.association import membership_weights
from ..operators.fixpoint import roots
from ..operators.tolerant import Tolerance, tolerant_basins

METHODS = ("trajectory_flow", "superlevel_merge_tree", "geodesic_reachability", "rtcb", "overlap_cell_complex")


@dataclass(frozen=True)
class BasinComplex:
    """The tables of a complex. Ids are text of fixed width: plateau_%08d, basin_max_v%08d, merge_max_%08d.

    extrema, basins, membership and assignment always exist; merges, trajectories and cells are None where the method has none.
    refinement has a row per stage that was asked for, with the numbers of basins before and after it.
    """

    method: str
    direction: str
    extrema: DataFrame
    basins: DataFrame
    membership: DataFrame
    assignment: DataFrame
    merges: DataFrame | None = None
    trajectories: DataFrame | None = None
    cells: DataFrame | None = None
    refinement: list[dict] = _field(default_factory=list)

    def basin(self, basin_id: str) -> DataFrame:
        """One basin's row."""
        return self.basins.filter(F.col("basin_id") == basin_id)

    def vertices(self, basin_id: str) -> DataFrame:
        """(v) of a basin."""
        return self.membership.filter(F.col("basin_id") == basin_id).select("v").distinct()

    def without_label(self, old: str, new: str) -> BasinComplex:
        """The same complex with one basin renamed in every table."""
        swap = lambda t: t if t is None else t.select(*(F.when(F.col(c) == old, new).otherwise(F.col(c)).alias(c) if c.endswith("basin_id") else F.col(c) for c in t.columns))
        return BasinComplex(self.method, self.direction, self.extrema, swap(self.basins), swap(self.membership), swap(self.assignment), swap(self.merges), self.trajectories, self.cells, self.refinement)

    def as_views(self, prefix: str) -> None:
        """Register the tables as temporary views."""
        for name in ("extrema", "basins", "membership", "assignment", "merges", "trajectories", "cells"):
            table = getattr(self, name)
            if table is not None:
                table.createOrReplaceTempView(f"{prefix}_{name}")


def _basin_id(direction, extremum):
    return F.format_string("basin_%s_v%08d", direction, extremum)


def _refined(graph, field, member, stages):
    """Run the stages that were asked for in their fixed order; returns membership and a record of each."""
    record = []

    def run(name, keep):
        nonlocal member
        before = member.select("direction", "extremum").distinct().count()
        member = cut(keep(B.basin_table(field, member)))
        record.append({"stage": name, "parameters": stages[name], "before": before, "after": member.select("direction", "extremum").distinct().count()})

    def some(ok):
        return member.join(ok.select("direction", "extremum"), ["direction", "extremum"], "left_semi")

    if "relative" in stages:
        run("relative", lambda b: some(B.filter_relative(b, field, *stages["relative"])))
    for d in ("max", "min"):
        if f"cluster_{d}" in stages:
            t = stages[f"cluster_{d}"]

            def cluster(b, d=d, t=t):
                own = member.filter(F.col("direction") == d)
                return B.merge_clusters(own, B.cluster_basins(b.filter(F.col("direction") == d), own, t)).unionByName(member.filter(F.col("direction") != d).select("v", "direction", "extremum"))

            run(f"cluster_{d}", cluster)
    if "geometric" in stages:
        run("geometric", lambda b: some(B.filter_geometry(b, B.geometry(graph), *stages["geometric"])))
    if "support" in stages:
        run("support", lambda b: some(B.filter_support(b, member, stages["support"])))
    if stages.get("expand"):

        def expand(_):
            out = member
            for d in ("max", "min"):
                more = B.expand_to_cover(graph, member, d).join(member.filter(F.col("direction") == d).select("v").distinct(), "v", "left_anti")
                out = out.unionByName(more.select("v", F.lit(d).alias("direction"), "extremum"))
            return out

        run("expand", expand)
    return member, record


def basin_complex(graph: Graph, field: DataFrame, method: str = "trajectory_flow", direction: str = "both", *, modulation: str = "closest", q: float = 0.9,
                  tolerance: Tolerance | None = None, mass: DataFrame | None = None, cluster: float = 0.1, stages: dict | None = None, check: bool = True) -> BasinComplex:
    """Build a complex. direction is `max`, `min` or `both`.

    stages may have, in the order in which they run: relative (least_max, most_min), cluster_max and cluster_min (overlap distance),
    geometric (three shares), support (size), expand (true). mass (v, mass) adds masses normalised to one; without it they are null.
    """
    if method not in METHODS:
        raise ValueError(f"no such method: {method}")
    if check:
        validate(graph)
        validate_field(graph, field)
    kinds = {"max": ["max"], "min": ["min"], "both": ["max", "min"]}[direction]
    field = cut(field.select("v", "y"))
    plateau = cut(W.plateaus(graph, field))
    merges = trajectories = cells = own = None
    ends = X.extrema_table(graph, field)
    if method == "trajectory_flow":
        if plateau.filter("v <> plateau").isEmpty():
            trajectories, member = W.trajectory_membership(graph, field, modulation, q)
        else:
            flows = [W.plateau_flow(graph, field, k == "max", q)[0].select("v", F.lit(k).alias("direction"), F.col("root").alias("extremum")) for k in ("max", "min")]
            member = flows[0].union(flows[1])
        up, down = (roots(W.next_vertex(graph, field, k, modulation, q)).select("v", "root") for k in (True, False))
        own = up.select("v", F.lit("max").alias("direction"), F.col("root").alias("extremum")).union(down.select("v", F.lit("min"), "root"))
    elif method == "superlevel_merge_tree":
        parts = []
        for k in kinds:
            events, basins, assigned = M.merge_tree(graph, field, k == "max")
            parts.append((k, events, basins, assigned, M.supports(basins, assigned)))
        side = lambda i, cols: _union([p[i].select(F.lit(p[0]).alias("direction"), *cols) for p in parts])
        member = side(4, ["v", F.col("basin").alias("extremum")]).select("v", "direction", "extremum")
        own = side(3, ["v", F.col("basin").alias("extremum")]).select("v", "direction", "extremum")
        merges = side(1, ["losing", "surviving", "plateau", "level", "birth", "persistence", "status"])
        number = F.row_number().over(Window.partitionBy("direction").orderBy(F.when(F.col("direction") == "max", -F.col("level")).otherwise(F.col("level")), "plateau", "losing"))
        merges = merges.select(
            F.format_string("merge_%s_%08d", "direction", number).alias("event_id"), "direction", _basin_id("direction", "losing").alias("losing_basin_id"), _basin_id("direction", "surviving").alias("surviving_basin_id"),
            F.format_string("plateau_%08d", "plateau").alias("merge_plateau_id"), F.col("level").alias("merge_level"), F.col("birth").alias("birth_level"), F.col("level").alias("death_level"), "persistence", F.col("status").alias("event_status"),
        )
    elif method == "rtcb":
        member = tolerant_basins(graph, field, ends, tolerance or Tolerance(n_min=max(20, int(graph.vertices.count() ** 0.5 + 0.999))), q).select("v", F.col("type").alias("direction"), "extremum")
    else:
        member = P.geodesic_basins(graph, field, ends, q if method == "geodesic_reachability" else 1.0).select("v", F.col("type").alias("direction"), "extremum")
    member = cut(member.filter(F.col("direction").isin(kinds)).distinct())
    raw = B.basin_table(field, member)
    stages = dict(stages or {})
    if method == "overlap_cell_complex":
        stages |= {f"cluster_{k}": cluster for k in kinds}
    kept, record = _refined(graph, field, member, stages)
    if method == "overlap_cell_complex":
        cells = B.flow_graph(kept, 1)
    table = B.basin_table(field, kept)
    if own is None:
        own = B.primary(table, kept)
    own = own.join(table.select("direction", "extremum"), ["direction", "extremum"], "left_semi").filter(F.col("direction").isin(kinds))

    alive = table.select("direction", "extremum", F.lit(True).alias("kept"), F.col("size").alias("retained_support_size"))
    first = own.groupBy("direction", "extremum").agg(F.count("*").alias("primary_support_size"))
    basins = raw.join(alive, ["direction", "extremum"], "left").join(first, ["direction", "extremum"], "left")
    if mass is not None:
        share = mass.select("v", (F.col("mass") / F.sum("mass").over(Window.partitionBy())).alias("m"))
        weigh = lambda t, c: t.join(share, "v").groupBy("direction", "extremum").agg(F.sum("m").alias(c))
        basins = basins.join(weigh(member, "raw_support_mass"), ["direction", "extremum"], "left").join(weigh(own, "primary_support_mass"), ["direction", "extremum"], "left")
    else:
        none = F.lit(None).cast("double")
        basins = basins.withColumn("raw_support_mass", none).withColumn("primary_support_mass", none)
    retained = F.coalesce("kept", F.lit(False))
    basins = basins.select(
        _basin_id("direction", "extremum").alias("basin_id"), F.format_string("plateau_%08d", "extremum").alias("extremum_id"), F.col("direction").alias("type"), F.lit(method).alias("method"), retained.alias("retained"),
        F.col("extremum").alias("extremum_vertex"), F.col("value").alias("extremum_value"), F.col("size").alias("raw_support_size"), "retained_support_size", F.coalesce("primary_support_size", F.lit(0)).alias("primary_support_size"),
        "raw_support_mass", "primary_support_mass", F.when(retained, "retained").otherwise("removed").alias("retention_status"),
    )
    if merges is not None:
        life = _union([p[2].select(F.lit(p[0]).alias("type"), F.col("basin").alias("extremum_vertex"), F.col("birth").alias("birth_level"), F.col("death").alias("death_level"), "persistence", _basin_id(F.lit(p[0]), F.col("parent")).alias("parent_basin_id"), F.col("parent")) for p in parts])
        basins = basins.join(life.withColumn("parent_basin_id", F.when(F.col("parent").isNotNull(), F.col("parent_basin_id"))).drop("parent"), ["type", "extremum_vertex"], "left")
    size = plateau.groupBy("plateau").agg(F.array_sort(F.collect_list("v")).alias("plateau_vertices"))
    at = raw.select("direction", "extremum", "value").join(plateau.select(F.col("v").alias("extremum"), "plateau"), "extremum").join(size, "plateau").join(alive, ["direction", "extremum"], "left")
    extrema = at.select(
        F.format_string("plateau_%08d", "extremum").alias("extremum_id"), F.col("direction").alias("type"), F.col("extremum").alias("representative_vertex"), F.col("value").alias("extremum_value"), F.format_string("plateau_%08d", "plateau").alias("plateau_id"),
        "plateau_vertices", F.size("plateau_vertices").alias("n_plateau_vertices"), retained.alias("is_retained"), F.when(retained, "retained").otherwise("removed").alias("retention_status"),
    )
    weights = membership_weights(kept)
    first = own.select("v", "direction", "extremum", F.lit(True).alias("p"))
    membership = weights.join(first, ["v", "direction", "extremum"], "left").select("v", "direction", _basin_id("direction", "extremum").alias("basin_id"), F.col("weight").alias("membership_weight"), F.coalesce("p", F.lit(False)).alias("is_primary"))
    assignment = own.select("v", "direction", _basin_id("direction", "extremum").alias("basin_id"), F.lit(1.0).alias("assignment_weight"), F.col("extremum").alias("root_vertex"))
    return BasinComplex(method, direction, extrema, basins, membership, assignment, merges, trajectories, cells, record)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
