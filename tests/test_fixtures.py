"""Hand-made graphs with known results, and properties that any result has."""

import math
import random

import pytest
from pyspark.sql import functions as F

from terrane.graph import Graph, GraphError, degrees, from_edges, validate, validate_field
from terrane.operators import association as A, basins as B, extrema as X, flow as W, grid as G, merge_tree as M, paths as P
from terrane.operators.fixpoint import components, distances, roots
from terrane.sources import graphs


def graph(spark, edges, vertices=None):
    rows = spark.createDataFrame([(a, b, float(w)) for a, b, *r in edges for w in (r or [1.0])], "a long, b long, len double")
    return from_edges(rows, None if vertices is None else spark.createDataFrame([(v,) for v in vertices], "v long"))


def field(spark, values, first=1):
    return spark.createDataFrame([(i + first, float(y)) for i, y in enumerate(values)], "v long, y double")


def as_dict(df, key="v", value=None):
    return {r[key]: (r[value] if value else tuple(r)) for r in df.collect()}


GRID = [(1, 2), (2, 3), (4, 5), (5, 6), (7, 8), (8, 9), (1, 4), (4, 7), (2, 5), (5, 8), (3, 6), (6, 9)]


def test_lcor_over_two_hops(spark):
    g, y, z = graph(spark, [(1, 2, 1), (2, 3, 2)]), field(spark, [1, 2, 4]), field(spark, [2, 3, 1])
    unit = as_dict(A.lcor(g, y, z, kind="unit", hop_radius=2), value="lcor")
    assert [unit[v] for v in (1, 2, 3)] == pytest.approx([-0.4472136, -0.6, -0.8682431], abs=1e-6)
    der = as_dict(A.lcor(g, y, z, hop_radius=2), value="lcor")
    assert [der[v] for v in (1, 2, 3)] == pytest.approx([0.4472136, 0, -0.8944272], abs=1e-6)


def test_tube_lens_corridor(spark):
    g = graph(spark, [(1, 2), (1, 7), (2, 3), (2, 5), (2, 6), (3, 4), (3, 5)])
    got = as_dict(P.tube_lens(g, 1, 4, 0.4, 0.5))
    assert set(got) == {1, 2, 3, 4, 5, 6}
    third = 1 / 3
    for v, t, dist, excess in [(1, 0, 0, 0), (2, third, 0, 0), (3, 2 * third, 0, 0), (4, 1, 0, 0), (5, 0.5, 1, 1), (6, third, 1, 2)]:
        r = got[v]
        assert r[1] == (v <= 4) and r[2] == pytest.approx(t) and r[3] == pytest.approx(t) and r[4] == dist and r[5] == pytest.approx(excess) and r[6] == (v <= 4)
    path = P.shortest_path(g, 1, 4).orderBy("position").collect()
    assert [r.v for r in path] == [1, 2, 3, 4]
    assert [r.v for r in P.through_waypoints(g, [7, 2, 4]).orderBy("position").collect()] == [7, 1, 2, 3, 4]


def test_closest_neighbour_ties(spark):
    g = graph(spark, [(1, 2), (1, 3), (2, 4), (3, 5)])
    assert as_dict(W.next_vertex(g, field(spark, [0, 1, 1.1, 3, 2.8])), value="next") == {1: 2, 2: 4, 3: 5, 4: None, 5: None}


def test_terminal_plateau(spark):
    g, y = graph(spark, [(1, 2), (2, 3), (2, 4), (3, 4), (4, 5)]), field(spark, [0, 2, 2, 2, 0])
    vs, ps = W.plateau_flow(g, y)
    assert set(as_dict(vs, value="root").values()) == {2}
    assert {v for v, p in as_dict(vs, value="plateau").items() if p == 2} == {2, 3, 4}


@pytest.mark.parametrize(
    ("edges", "values", "source", "target"),
    [
        ([(1, 2, 1), (2, 3, 1), (2, 4, 2), (3, 5, 1)], [0, 1, 1, 3, 2.5], 3, 5),
        ([(1, 2), (2, 3), (2, 5), (3, 4), (3, 5)], [0, 1, 1, 2, 2], 3, 4),
        ([(1, 2), (2, 3), (2, 4), (3, 4)], [0, 1, 1, 2], 2, 4),
    ],
)
def test_plateau_leaves_by_length_target_source(spark, edges, values, source, target):
    _, ps = W.plateau_flow(graph(spark, edges), field(spark, values))
    row = next(r for r in ps.collect() if r.plateau == 2)
    assert (row.source, row.target) == (source, target)


def test_plateau_walk_ends_at_the_exit(spark):
    vs, _ = W.plateau_flow(graph(spark, [(1, 2, 1), (2, 3, 1), (2, 4, 2), (3, 5, 1)]), field(spark, [0, 1, 1, 3, 2.5]))
    got = as_dict(vs)
    assert got[2][2] == 3 and got[3][2] == 5 and got[2][3] == got[3][3] == 5


def test_hop_index_without_a_bound(spark):
    n = 68
    g = graph(spark, [(i, i + 1, 1.0) for i in range(1, n)])
    y = field(spark, [10.0, *(float(x) / 100 for x in range(n - 2)), 20.0])
    got = {r.v: r.hop_idx for r in X.hop_index(g, y, spark.createDataFrame([(1, "max", 10.0), (n, "max", 20.0)], "v long, type string, y double")).collect()}
    assert got == {1: n - 1, n: None}


def test_grid_plateau_and_persistence(spark):
    g, y = graph(spark, GRID), field(spark, [4, 4, 1, 2, 0, 1, 1, 2, 3])
    assert as_dict(W.plateaus(g, y), value="plateau")[2] == 1
    for up in (True, False):
        _, basins, assigned = M.merge_tree(g, y, up)
        for r in basins.collect():
            assert r.persistence >= 0 and r.persistence == pytest.approx(r.birth - r.death if up else r.death - r.birth)
        assert {r.v for r in assigned.collect()} == set(range(1, 10))


def test_elder_tie(spark):
    events, basins, _ = M.merge_tree(graph(spark, [(1, 2), (2, 3)]), field(spark, [3, 1, 3]))
    (e,) = events.collect()
    assert (e.losing, e.surviving, e.status, e.level) == (3, 1, "elder_tie", 1.0)


def test_one_saddle_takes_all(spark):
    events, _, _ = M.merge_tree(graph(spark, [(1, 4), (2, 4), (3, 4)]), field(spark, [4, 3, 2, 0]))
    got = sorted((e.losing, e.surviving, e.plateau) for e in events.collect())
    assert got == [(2, 1, 4), (3, 1, 4)]


def test_forest_has_a_root_each(spark):
    g = graph(spark, [(1, 2), (3, 4)], range(1, 6))
    _, basins, assigned = M.merge_tree(g, field(spark, [3, 0, 3, 0, 2]))
    assert sorted(r.persistence for r in basins.collect()) == [0, 3, 3]
    assert as_dict(assigned, value="basin")[5] == 5


def test_cut_includes_equality(spark):
    g, y = graph(spark, [(1, 4), (2, 4), (3, 4)]), field(spark, [5, 4, 3, 1])
    assert sorted((r.extremum, r["size"]) for r in M.cut_tree(g, y, 1.0)[0].collect()) == [(1, 4)]
    assert sorted(r.extremum for r in M.cut_tree(g, y, 3.0)[0].collect()) == [1, 2, 3]


def _union_find_tree(n, edges, y):
    """Events by processing every plateau of the whole graph in order."""
    near = {v: set() for v in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    rep, todo = {}, list(range(n))
    for v in todo:
        if v not in rep:
            stack = [v]
            rep[v] = v
            while stack:
                for u in near[stack.pop()]:
                    if u not in rep and y[u] == y[v]:
                        rep[u] = v
                        stack.append(u)
    up, birth, out, own = {}, {}, [], {}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for p in sorted(set(rep.values()), key=lambda p: (-y[p], p)):
        members = [v for v in range(n) if rep[v] == p]
        met = {root(rep[u]) for v in members for u in near[v] if rep[u] in up and rep[u] != p}
        up[p] = p
        if not met:
            birth[p] = y[p]
        else:
            eldest = min(met, key=lambda s: (-birth[s], s))
            up[p] = eldest
            for s in met - {eldest}:
                out.append((s, eldest, p, y[p]))
                up[s] = eldest
        for v in members:
            own[v] = root(p)
    return sorted(out), own


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_reduced_merge_tree_equals_the_whole_one(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(i, rng.randrange(i)) for i in range(1, n) if rng.random() < 0.9] + [(rng.randrange(n), rng.randrange(n)) for _ in range(30)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    y = [rng.randint(0, 9) for _ in range(n)]
    events, basins, assigned = M.merge_tree(graph(spark, edges, range(n)), field(spark, y, 0))
    want, own = _union_find_tree(n, edges, y)
    assert sorted((e.losing, e.surviving, e.plateau, e.level) for e in events.collect()) == want
    assert as_dict(assigned, value="basin") == own
    held = M.supports(basins, assigned).groupBy("basin").count().collect()
    sizes = {r.basin: r["count"] for r in held}
    for s, t, *_ in want:
        assert sizes[t] > sizes[s]
    places = [r.x for r in M.layout(basins).collect()]
    assert sorted(places) == list(range(1, basins.count() + 1))


def test_isolated_vertices(spark):
    g, y = graph(spark, [(1, 2)], [1, 2, 3]), field(spark, [1, 2, 5])
    got = as_dict(X.strict_extrema(g, y))
    assert got[3][2:] == (True, False)
    assert as_dict(X.strict_extrema(g, y, False))[3][2:] == (False, False)
    assert as_dict(X.neighbour_share(g, y))[3][1:] == (None, None)
    assert as_dict(degrees(g))[3][1] == 0


def test_validation(spark):
    g = graph(spark, [(1, 2)])
    validate(g)
    validate_field(g, field(spark, [1, 2]))
    with pytest.raises(GraphError):
        validate_field(g, field(spark, [1, float("nan")]))
    with pytest.raises(GraphError, match="itself"):
        validate(Graph(g.vertices, g.edges.union(spark.createDataFrame([(1, 1, 1.0)], "src long, dst long, len double"))))
    with pytest.raises(GraphError, match="reverse"):
        validate(Graph(g.vertices, g.edges.filter("src = 1")))
    with pytest.raises(GraphError, match="no vertex"):
        validate(Graph(g.vertices.limit(0), g.edges.limit(0)))


def test_fixpoints_against_plain_loops(spark):
    rng = random.Random(3)
    n = 60
    edges = [(i, rng.randrange(i), rng.randint(1, 9)) for i in range(1, n) if i % 13] + [(rng.randrange(n), (rng.randrange(n - 1) + 1), rng.randint(1, 9)) for _ in range(20)]
    edges = [(a, b, w) for a, b, w in edges if a != b]
    g = graph(spark, edges, range(n))
    near = {}
    for r in g.edges.collect():
        near.setdefault(r.src, []).append((r.dst, r.len))
    part = as_dict(components(g.vertices, g.edges), value="component")
    dist = {}
    for s in (0, 5):
        d = {s: 0.0}
        for _ in range(n):
            for v in list(d):
                for u, w in near.get(v, ()):
                    d[u] = min(d.get(u, math.inf), d[v] + w)
        dist[s] = d
        assert {v for v in part if part[v] == part[s]} == set(d)
    starts = spark.createDataFrame([(0, 0), (5, 5)], "ref long, v long")
    got = distances(g.edges, starts).collect()
    assert {(r.ref, r.v): r.dist for r in got} == {(s, v): x for s in dist for v, x in dist[s].items()}
    chain = spark.createDataFrame([(i, i + 1 if i < 37 else None) for i in range(38)], "v long, next long")
    assert {(r.v, r.root, r.steps) for r in roots(chain).collect()} == {(i, 37, 37 - i) for i in range(38)}


def test_geodesic_basin_blocks_at_a_break(spark):
    g, y = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 5)]), field(spark, [5, 4, 4.5, 1, 0])
    e = spark.createDataFrame([(1, "max")], "v long, type string")
    b = P.geodesic_basins(g, y, e, 1.0)
    assert sorted(r.v for r in b.collect()) == [1, 2]
    assert [r.v for r in P.terminals(g, y, b).collect()] == [2]


def test_monotone_graph_counts_paths(spark):
    g, y = graph(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (2, 6)]), field(spark, [0, 1, 1.5, 2, 3, 9])
    vs, e = P.madag(g, y, 1)
    assert {r.v: int(r.from_source) for r in vs.collect()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1}
    assert {r.sink: int(r.trajectories) for r in P.madag_cells(vs, e).collect()} == {5: 2, 6: 1}
    assert {r.v: r.share for r in P.bottlenecks(vs, e, 1, 5, 0.5).collect()} == {2: 0.5, 3: 0.5, 4: 1.0}
    assert sorted(r.path for r in P.enumerate_paths(e, 1, 5).collect()) == [[1, 2, 4, 5], [1, 3, 4, 5]]
    assert P.enumerate_paths(e, 1, 5, most=1).collect() == []


def test_every_vertex_is_covered_by_trajectories(spark):
    g, y = graph(spark, GRID), field(spark, [4, 3.9, 1, 2, 0, 1.1, 1.2, 2.1, 3])
    paths, member = W.trajectory_membership(g, y, q=1.0)
    ends = as_dict(X.strict_extrema(g, y, False))
    for r in paths.collect():
        vals = [ends[v][1] for v in r.path]
        assert vals == sorted(vals) and ends[r.path[0]][2] and ends[r.path[-1]][3]
    w = A.membership_weights(member).groupBy("v", "direction").agg(F.sum("weight").alias("s")).collect()
    assert all(r.s == pytest.approx(1) for r in w)
    assert {r.v for r in member.collect()} | {r.v for r in W.uncovered(g, y, member).collect()} == set(range(1, 10))
    assert W.through_cell(paths, 5, 5, 1).count() <= 1


def test_association_bounds(spark):
    g, y, z = graph(spark, GRID), field(spark, [4, 3.9, 1, 2, 0, 1.1, 1.2, 2.1, 3]), field(spark, [1, 2, 3, 4, 5, 6, 7, 8, 9.5])
    for kind in ("derivative", "unit"):
        assert all(-1 <= r.lcor <= 1 for r in A.lcor(g, y, z, kind=kind).collect())
        assert all(r.lcor == pytest.approx(1) for r in A.lcor(g, y, y, kind=kind).collect())
    own = W.steepest(g, y)
    up = roots(own).select("v", F.lit("max").alias("direction"), F.col("root").alias("extremum"))
    down = roots(W.steepest(g, y, False)).select("v", F.lit("min").alias("direction"), F.col("root").alias("extremum"))
    w = A.membership_weights(up.union(down))
    for scale in ("value", "rank"):
        p = A.polarity(y, w, scale)
        assert all(r.polarity is None or -1 <= r.polarity <= 1 for r in p.collect())
        assert A.global_association(A.vertex_association(p, p)).first().a_pol > 0
    d = A.deviation(A.overlap(w, w))
    assert abs(d.agg(F.sum("delta")).first()[0]) < 1e-9
    t = A.permutation_test(g, y, A.one_feature(z), times=19)
    (r,) = t.collect()
    assert 1 / 20 <= r.p_value <= 1 and r.p_adjusted >= r.p_value
    assert A.permutation_test(g, y, A.one_feature(z), times=19).collect() == t.collect()


def test_slope_of_a_multiple(spark):
    g, y = graph(spark, GRID), field(spark, [4, 3.9, 1, 2, 0, 1.1, 1.2, 2.1, 3])
    z = y.withColumn("y", F.col("y") * -2)
    for r in A.lslope(g, y, z).collect():
        assert r.slope == (0 if r.is_extremum else pytest.approx(-2))
    for r in A.neighbourhood_slope(g, y, z).collect():
        assert r.slope == pytest.approx(-2) and r.lcor == pytest.approx(-1)
    s = sorted(abs(r.slope) for r in A.lslope(g, y, z, "normalized", sigmoid_kind="arctan").collect() if not r.is_extremum)
    assert s == pytest.approx([0.5] * len(s))


def test_expansion_and_boundary(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 5)], range(1, 7))
    m = spark.createDataFrame([(1, "max", 1), (5, "max", 5)], "v long, direction string, extremum long")
    got = as_dict(B.expand_to_cover(g, m, "max"), value="extremum")
    assert got == {1: 1, 2: 1, 3: 1, 4: 5, 5: 5}
    assert sorted(r.v for r in B.boundary(g, spark.createDataFrame([(1,), (2,), (3,)], "v long")).collect()) == [3]


def test_spurious_tree_alternates(spark):
    basins = spark.createDataFrame([(1, "max", 2), (1, "max", 3), (2, "min", 4), (2, "min", 1)], "extremum long, type string, v long")
    spurious = spark.createDataFrame([(1, "max"), (2, "min")], "v long, type string")
    extrema = spark.createDataFrame([(1, "max"), (2, "min"), (3, "min"), (4, "max")], "v long, type string")
    got = sorted(tuple(r) for r in P.spurious_tree(1, "max", basins, spurious, extrema).select("level", "v", "leaf").collect())
    assert got == [(0, 1, False), (1, 2, False), (1, 3, True), (2, 4, True)]


def test_grid_walks_meet_in_cells(spark):
    values = G.evaluate(G.create_grid(spark, 9), F.expr("sin(5 * x) * cos(4 * y)"))
    cells = {(r.i, r.j): r for r in G.cells(values, 9).collect()}
    end = G.walk(values, 9, 4, 5).orderBy(F.col("position").desc()).first()
    assert cells[4, 5].max_v == (end.i - 1) * 9 + end.j
    assert cells[1, 1].cell == 1 and len(cells) == 81


def test_sources(spark, tmp_path):
    g = graphs.from_adjacency(spark, [[2], [1, 3], [2]], [[1.0], [1.0, 2.0], [2.0]])
    validate(g)
    assert graphs.grid_graph(spark, 4).edges.count() == 48
    (tmp_path / "m.csv").write_text("1,2\n3,4\n")
    assert [r.c2 for r in graphs.read_matrix(spark, str(tmp_path / "m.csv")).orderBy("row").collect()] == [2.0, 4.0]
    graphs.write_table(g.edges, str(tmp_path / "e"), "csv")
    assert spark.read.csv(str(tmp_path / "e"), header=True).count() == 4
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "vec_id long, embedding array<double>")
    graphs._BLOCK, old = 16, graphs._BLOCK
    try:
        got = {(r.src, r.dst): r.len for r in graphs.neighbours(rows, 3).collect()}
    finally:
        graphs._BLOCK = old
    for i in range(40):
        want = sorted((math.dist((i % 7, i % 5), (j % 7, j % 5)), j) for j in range(40) if j != i)[:3]
        assert {(i, j): d for d, j in want} == {k: d for k, d in got.items() if k[0] == i}
