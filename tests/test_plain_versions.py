"""Searches and flows against plain sequential versions on many random graphs, laid side by side as one."""

import random
from collections import defaultdict

import numpy as np
import pytest

from terrane.graph import from_edges
from terrane.operators import extrema as X, flow as W, paths as P


def _many(spark, seed, count, size=30, k=3):
    """(graph, field, adjacency, values) of `count` random graphs of nearest neighbours."""
    rng = random.Random(seed)
    near, value = defaultdict(dict), {}
    for g in range(count):
        at = [(rng.random(), rng.random()) for _ in range(size)]
        for i, p in enumerate(at):
            value[g * 100 + i] = rng.random()
            d = sorted((((p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2) ** 0.5, j) for j, q in enumerate(at) if j != i)
            for w, j in d[:k]:
                near[g * 100 + i][g * 100 + j] = near[g * 100 + j][g * 100 + i] = w
    rows = [(a, b, w) for a, n in near.items() for b, w in n.items() if a < b]
    graph = from_edges(spark.createDataFrame(rows, "a long, b long, len double")).cut()
    return graph, spark.createDataFrame(list(value.items()), "v long, y double"), near, value


def _sequential(near, y, q, symmetric, forbid_long):
    """Seeds in their order, one after another, with a set of covered vertices: membership and seeds that count."""
    limit = np.quantile([w for a, n in near.items() for b, w in n.items() if a < b], q) if q < 1 else float("inf")

    def step(v, sign):
        better = [(w > limit, w, u) for u, w in near[v].items() if (y[u] - y[v]) * sign > 0]
        if forbid_long:
            gains = [((y[v] - y[u]) * sign, u) for long, _, u in better if not long]
            return min(gains)[1] if gains else None
        return min(better)[2] if better else None

    def walk(v, sign):
        out = [v]
        while (n := step(out[-1], sign)) is not None:
            out.append(n)
        return out

    tops = {v for v in y if near[v] and all(y[u] < y[v] for u in near[v])}
    lows = {v for v in y if near[v] and all(y[u] > y[v] for u in near[v])}
    covered, member, seeds = set(), set(), {}

    def take(seed, path):
        if path[0] in lows and path[-1] in tops:
            covered.update(path)
            member.update((v, "min", path[0]) for v in path)
            member.update((v, "max", path[-1]) for v in path)
            seeds[seed] = path

    for v in sorted(lows, key=y.get):
        take(v, walk(v, 1))
    if symmetric:
        for v in sorted(tops, key=y.get, reverse=True):
            take(v, walk(v, -1)[::-1])
    for v in sorted(set(y) - covered, key=y.get):
        if v not in covered:
            take(v, walk(v, -1)[:0:-1] + walk(v, 1))
    return member, seeds


@pytest.mark.parametrize(("q", "symmetric", "modulation"), [(1.0, True, "closest"), (0.8, True, "closest"), (1.0, False, "closest"), (0.6, True, "none")])
def test_trajectories_equal_the_sequential_order(spark, q, symmetric, modulation):
    graph, field, near, y = _many(spark, 7, 200)
    paths, member = W.trajectory_membership(graph, field, modulation, q, symmetric)
    want, seeds = _sequential(near, y, q, symmetric, modulation == "none")
    assert {tuple(r) for r in member.select("v", "direction", "extremum").collect()} == want
    got = {r.traj_id: r for r in paths.collect()}
    assert {k: r.path for k, r in got.items()} == seeds
    assert all(r.min == r.path[0] and r.max == r.path[-1] and r.total_change == pytest.approx(y[r.max] - y[r.min]) for r in got.values())


def _distances(near, start):
    import heapq

    out, heap = {}, [(0.0, start)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in out:
            out[v] = d
            for u, w in near[v].items():
                if u not in out:
                    heapq.heappush(heap, (d + w, u))
    return out


@pytest.mark.parametrize("maxima", [True, False])
def test_radius_extrema_equal_a_plain_scan(spark, maxima):
    graph, field, near, y = _many(spark, 3, 12)
    sign = 1 if maxima else -1
    for radius, size in ((0.25, 2), (9.0, 5)):
        want = {}
        for v in y:
            run = []
            for d, u in sorted((d, u) for u, d in _distances(near, v).items() if u != v and d <= radius):
                if (y[u] - y[v]) * sign >= 0:
                    break
                run.append(d)
            if len(run) >= size:
                want[v] = (pytest.approx(run[-1]), len(run))
        got = {r.v: (r.radius, r.size) for r in X.radius_extrema(graph, field, radius, size, maxima).collect()}
        assert got == want and want


def test_a_violation_behind_a_long_edge_ends_the_search_only(spark):
    g = from_edges(spark.createDataFrame([(0, 1, 1.0), (0, 2, 1.0), (0, 3, 100.0)], "a long, b long, len double"))
    y = spark.createDataFrame([(0, 5.0), (1, 1.0), (2, 2.0), (3, 9.0)], "v long, y double")
    assert [tuple(r) for r in X.radius_extrema(g, y, 5.0, 2).collect()] == [(0, 5.0, 1.0, 2)]


def _hop_radius(near, y, rho, v, p):
    seen, level, t, s, hop, last = {v}, [v], 0.0, 0.0, 0, 0
    while level:
        level = sorted({u for x in level for u in near[x]} - seen)
        seen.update(level)
        hop += 1
        t += sum(rho[u] for u in level)
        s += sum(rho[u] for u in level if y[u] < y[v])
        if t == 0 or s / t < p:
            return last
        last = hop
    return last


def test_probable_radius_equals_a_plain_search(spark):
    graph, field, near, y = _many(spark, 5, 12)
    rho = {v: 1.0 + v % 4 for v in y}
    density = spark.createDataFrame(list(rho.items()), "v long, density double")
    tops = {v for v in y if all(y[u] < y[v] for u in near[v])}
    best = max(y.values())
    for p in (0.5, 0.9):
        want = {v: None if y[v] == best else _hop_radius(near, y, rho, v, p) for v in tops}
        assert {r.v: r.hop_radius for r in X.probable_radius(graph, field, density, p).collect()} == want
    short = X.probable_radius(graph, field, density, 0.5, max_hop=1).collect()
    assert {r.hop_radius for r in short} <= {None, 0, 1}


def test_chains_come_back_whole(spark):
    n = 20_000
    steps = spark.range(n - 1).selectExpr("id as v", "id + 1 as next").union(spark.createDataFrame([(n - 1, None)], "v long, next long"))
    (row,) = W.trajectories(steps, spark.createDataFrame([(0,)], "v long")).collect()
    assert row.path == list(range(n))
    m = 30
    rows = [(i, i + 1, 1.0) for i in range(m)]
    g = from_edges(spark.createDataFrame(rows, "a long, b long, len double")).cut()
    y = spark.createDataFrame([(0, 10.0), *((i, float(m - i) / m) for i in range(1, m)), (m, 11.0)], "v long, y double")
    assert {r.v: r.hop_idx for r in X.hop_index(g, y, X.extrema_table(g, y)).collect()}[0] == m


def test_sized_extrema_equal_a_plain_scan(spark):
    graph, field, near, y = _many(spark, 9, 8)
    want = set()
    for v in y:
        close = sorted((d, u) for u, d in _distances(near, v).items())[:7]
        for kind, sign in (("max", 1), ("min", -1)):
            if len(close) == 7 and all((y[u] - y[v]) * sign <= 0 for _, u in close) and all((y[u] - y[v]) * sign <= 0 for u in near[v]):
                want.add((v, kind))
    assert {(r.v, r.type) for r in X.local_extrema(graph, field, 7).collect()} == want


def test_flows_over_distances_equal_a_plain_scan(spark):
    graph, field, near, y = _many(spark, 11, 6)
    want, held = {}, {}
    for v in y:
        d = _distances(near, v)
        best = [(-(y[u] - y[v]), d[u], u) for u in d if d[u] <= 0.3 and y[u] > y[v]]
        want[v] = min(best)[2] if best else None
        rise = _distances({a: {b: w for b, w in n.items() if y[b] > y[a]} for a, n in near.items()}, v)
        best = [(-y[u], d[u], u) for u in rise if u != v and d[u] <= 0.5 and rise[u] <= min(0.5, d[u] + 1e-12)]
        held[v] = min(best)[2] if best else None
    assert {r.v: r.next for r in P.scale_flow(graph, field, 0.3).collect()} == want
    assert {r.v: r.next for r in P.constrained_flow(graph, graph, field, 0.5).collect()} == held


def _reached(near, y, start, sign, limit):
    """Settled by (distance, vertex); rejected ones block."""
    import heapq

    heap, settled, best, out = [(0.0, start, None, 0, 0.0)], set(), {start: 0.0}, {}
    while heap:
        d, v, pred, hop, step = heapq.heappop(heap)
        if v in settled:
            continue
        settled.add(v)
        if pred is not None and not (step <= limit and (y[pred] - y[v]) * sign > 0):
            continue
        out[v] = (hop, d, pred)
        for u, w in near[v].items():
            if u not in settled and d + w < best.get(u, float("inf")):
                best[u] = d + w
                heapq.heappush(heap, (d + w, u, v, hop + 1, w))
    return out


def test_geodesic_basins_equal_a_plain_search(spark):
    graph, field, near, y = _many(spark, 13, 12, size=40, k=5)
    limit = np.quantile([w for a, n in near.items() for b, w in n.items() if a < b], 0.8)
    ends = X.extrema_table(graph, field)
    want = {}
    for r in ends.collect():
        for v, (hop, d, pred) in _reached(near, y, r.v, 1 if r.type == "max" else -1, limit).items():
            want[r.v, r.type, v] = (hop, pytest.approx(d), pred)
    got = P.geodesic_basins(graph, field, ends.select("v", "type"), 0.8).collect()
    assert {(r.extremum, r.type, r.v): (r.hop, r.dist, r.pred) for r in got} == want and len(got) == len(want)


def test_extensions_solve_their_systems(spark):
    graph, field, near, y = _many(spark, 15, 3, size=40, k=4)
    given = {v: y[v] for v in y if v % 100 % 5 == 0}
    region = spark.createDataFrame([(v, given.get(v)) for v in y], "v long, value double")
    ids = sorted(y)
    place = {v: i for i, v in enumerate(ids)}
    weight = np.zeros((len(ids), len(ids)))
    for v, n in near.items():
        for u, w in n.items():
            weight[place[v], place[u]] = 1 / w
    degree = weight.sum(axis=1)
    free = np.array([v not in given for v in ids])
    known = np.array([given.get(v, 0.0) for v in ids])
    laplace = np.diag(degree) - weight
    for method, system in (("harmonic", laplace), ("biharmonic", laplace @ np.diag(1 / degree) @ laplace)):
        got = {r.v: r.value for r in P.harmonic_extension(graph, region, method=method).collect()}
        # Parts without a given value stay null; here every part has one.
        want = known.copy()
        want[free] = np.linalg.solve(system[np.ix_(free, free)], -system[np.ix_(free, ~free)] @ known[~free])
        assert [got[v] for v in ids] == pytest.approx(want.tolist(), abs=1e-7)
    plain = {r.v: r.value for r in P.harmonic_extension(graph, region).collect()}
    smooth = {r.v: r.value for r in P.harmonic_extension(graph, region, method="boundary_smoothed").collect()}
    for v in ids:
        if v in given or not any(u in given for u in near[v]):
            assert smooth[v] == pytest.approx(plain[v])
        else:
            mean = sum(plain[u] / w for u, w in near[v].items()) / sum(1 / w for w in near[v].values())
            assert smooth[v] == pytest.approx((plain[v] + mean) / 2)
    ring, left = dict(given), set(ids) - set(given)
    while left:
        new = {v: sum(ring[u] / w for u, w in near[v].items() if u in ring) / sum(1 / w for u, w in near[v].items() if u in ring) for v in left if any(u in ring for u in near[v])}
        if not new:
            break
        ring |= new
        left -= set(new)
    got = {r.v: r.value for r in P.harmonic_extension(graph, region, method="weighted_mean").collect()}
    assert all(got[v] == pytest.approx(ring[v]) if v in ring else got[v] is None for v in ids)
