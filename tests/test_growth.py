"""Work that grows with the table, not with its square, against plain versions."""

import time

import numpy as np
import pandas as pd

from terrane.graph import from_edges
from terrane.operators import extrema as X, flow as W, nerve as N, paths as P
from terrane.sources import graphs


def _plan(df):
    return df._jdf.queryExecution().toString()


def _lengths(spark, x):
    rows = spark.createDataFrame([(2 * i, 2 * i + 1, float(d)) for i, d in enumerate(x)], "a long, b long, len double")
    return from_edges(rows).cut()


def test_nearest_rows_of_several_blocks_equal_a_plain_search(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (2300, 3)).astype("float32")  # many equal rows and distances
    ids = rng.permutation(10_000)[: len(x)]
    rows = spark.createDataFrame([(int(v), [float(c) for c in e]) for v, e in zip(ids, x)], "vec_id long, embedding array<float>")
    want = set()
    for i in range(len(x)):
        d = np.sqrt(((x.astype("float64") - x[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids, d))
        want |= {(int(ids[i]), int(ids[j]), float(d[j])) for j in best[best != i][:5]}
    assert {tuple(r) for r in graphs.neighbours(rows, 5).collect()} == want


def test_nearest_rows_by_single_precision_are_exact():
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 16))
    close = base.copy()
    close[::2] = base[0] + 1e-7 * rng.normal(size=(750, 16))  # closer than single precision tells
    ids = rng.permutation(9000)[: len(base)]
    for x in (base, close, base + 1e5, 1e-25 * base, 1e20 * base):
        d = np.sqrt(((x[:700, None] - x[None, 700:]) ** 2).sum(axis=2))
        got = graphs._nearest(x[:700], ids[:700], x[700:], ids[700:], 5)
        order = np.array([np.lexsort((ids[700:], row))[:5] for row in d])
        assert np.array_equal(got[1].reshape(-1, 5), ids[700:][order]) and np.allclose(got[2].reshape(-1, 5), np.take_along_axis(d, order, 1), rtol=1e-12, atol=0)
        assert np.array_equal(got[0], np.repeat(np.arange(700), 5))


def test_nearest_rows_among_many_copies_take_no_pairs(spark):
    """Copies with each other are 4e8 pairs here."""
    n = 20_000
    rows = spark.range(n).selectExpr("id as vec_id", "transform(sequence(0, 31), i -> if(id % 100 = 7, cast(id * 32 + i as float), 1f)) as embedding")
    began = time.time()
    got = graphs.neighbours(rows, 3).collect()
    assert time.time() - began < 40
    near = {}
    for r in got:
        near.setdefault(r.src, []).append((r.len, r.dst))
    assert len(got) == 3 * n
    for v in (0, 1, 2, 3, 4, 5, 12_345, 19_999):
        assert sorted(near[v]) == [(0.0, u) for u in range(5) if u != v][:3]
    assert [u for _, u in sorted(near[10_007])] == [9_907, 10_107, 9_807]


def test_density_of_lengths_equals_the_plain_sum(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(3, 0.2, 300), rng.normal(9, 0.01, 200), [1e-3, 4e3], np.full(20, 3.0)])
    g = _lengths(spark, x)
    for bandwidth in (-1.0, 0.003, 50.0, 1e-14):
        h = bandwidth if bandwidth > 0 else 1.06 * x.std(ddof=1) * len(x) ** -0.2
        d = np.exp(-0.5 * ((x[:, None] - x) / h) ** 2).sum(axis=1)
        got = {r.src: r.w for r in W.length_weight(g, bandwidth).filter("src < dst").collect()}
        assert np.allclose([got[2 * i] for i in range(len(x))], d / d.max(), rtol=1e-11, atol=0)
    assert {r.w for r in W.length_weight(_lengths(spark, [2.0, 2.0])).collect()} == {1.0}
    assert {r.w for r in W.length_weight(_lengths(spark, [2.0])).collect()} == {1.0}
    assert W.length_weight(_lengths(spark, [2.0]), 1.0).count() == 2


def test_density_of_many_lengths_takes_no_pairs(spark):
    """Each length against each other are 4e10 pairs here."""
    m = 200_000
    x = np.random.default_rng(6).gamma(4.0, 1.0, m)
    g = from_edges(spark.createDataFrame(pd.DataFrame({"a": 2 * np.arange(m), "b": 2 * np.arange(m) + 1, "len": x}))).cut()
    began = time.time()
    got = {r.src // 2: r.w for r in W.length_weight(g).filter("src < dst and src % 2000 = 0").collect()}
    assert time.time() - began < 90
    h = 1.06 * x.std(ddof=1) * m**-0.2
    some = sorted(got)
    d = np.array([np.exp(-0.5 * ((x[i] - x) / h) ** 2).sum() for i in some])
    w = np.array([got[i] for i in some])
    assert np.allclose(w / w[0], d / d[0], rtol=1e-10, atol=0)


def test_density_of_lengths_broadcasts_no_lengths(spark, monkeypatch):
    """Lengths times cells are 500,000 rows here, which Spark takes for as few bytes as the lengths."""
    m = 20_000
    x = np.random.default_rng(10).gamma(4.0, 1.0, m)
    g = from_edges(spark.createDataFrame(pd.DataFrame({"a": 2 * np.arange(m), "b": 2 * np.arange(m) + 1, "len": x}))).cut()
    plans, real = [], W.cut
    monkeypatch.setattr(W, "cut", lambda df: (plans.append(_plan(df)), real(df))[1])
    some = list(range(0, m, 500))
    for most in (W._CELLS, 0):
        monkeypatch.setattr(W, "_CELLS", most)
        got = {r.src // 2: r.w for r in W.length_weight(g).filter("src < dst and src % 1000 = 0").collect()}
        h = 1.06 * x.std(ddof=1) * m**-0.2
        d = np.array([np.exp(-0.5 * ((x[i] - x) / h) ** 2).sum() for i in some])
        assert np.allclose([got[i] / got[0] for i in some], d / d[0], rtol=1e-10, atol=0)
    assert not [p for p in plans if "Generate" in p and "BuildLeft" in p]


def _scored(spark):
    rng = np.random.default_rng(7)
    at = rng.random((40, 2))
    rows = [(i, j, float(np.hypot(*(at[i] - at[j])))) for i in range(40) for j in range(i) if np.hypot(*(at[i] - at[j])) < 0.35]
    y = rng.random(40)
    near = {}
    for a, b, d in rows:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = d
    x = np.array([d for _, _, d in rows])
    h = 1.06 * x.std(ddof=1) * len(x) ** -0.2
    dens = {d: np.exp(-0.5 * ((x - d) / h) ** 2).sum() for d in x}
    rho = {v: 1 / min(n.values()) for v, n in near.items()}
    g = from_edges(spark.createDataFrame(rows, "a long, b long, len double")).cut()
    return g, spark.createDataFrame([(i, float(c)) for i, c in enumerate(y)], "v long, y double"), near, y, dens, rho, np.quantile(x, 0.9)


def _best(near, y, q, score):
    out = {}
    for v, n in near.items():
        up = [(-(y[u] - y[v]) * score(u, d), u) for u, d in n.items() if y[u] > y[v] and d <= q]
        out[v] = min(up)[1] if up else None
    return out


def test_flow_by_density_and_length_has_no_window_over_all_vertices(spark):
    g, field, near, y, dens, rho, q = _scored(spark)
    got = W.next_vertex(g, field, True, "density_edgelen")
    assert {r.v: r.next for r in got.collect()} == _best(near, y, q, lambda u, d: rho[u] * dens[d])
    assert "Window" not in _plan(got)
    assert max(r.density for r in W.default_density(g).collect()) == 1.0


def test_flow_by_length_has_no_window_over_all_lengths(spark):
    g, field, near, y, dens, _, q = _scored(spark)
    got = W.next_vertex(g, field, True, "edgelen")
    assert {r.v: r.next for r in got.collect()} == _best(near, y, q, lambda u, d: dens[d])
    assert "Window" not in _plan(got)


def _flow_of_pairs(spark, monkeypatch, modulation):
    """The flow of 20,000 pairs upwards is right, and the plans of what it writes, and its own, broadcast no lengths times cells."""
    m = 20_000
    x = np.random.default_rng(11).gamma(4.0, 1.0, m)
    g = from_edges(spark.createDataFrame(pd.DataFrame({"a": 2 * np.arange(m), "b": 2 * np.arange(m) + 1, "len": x}))).cut()
    plans, real = [], W.cut
    monkeypatch.setattr(W, "cut", lambda df: (plans.append(_plan(df)), real(df))[1])
    flow = W.next_vertex(g, g.vertices.selectExpr("v", "cast(v as double) as y"), True, modulation)
    short = x <= np.quantile(x, 0.9)
    assert {r.v: r.next for r in flow.collect()} == {2 * i: 2 * i + 1 if short[i] else None for i in range(m)} | {2 * i + 1: None for i in range(m)}
    assert not [p for p in [*plans, _plan(flow)] if "Generate" in p and "BuildLeft" in p]


def test_flow_by_density_and_length_broadcasts_no_lengths(spark, monkeypatch):
    _flow_of_pairs(spark, monkeypatch, "density_edgelen")


def test_flow_by_length_broadcasts_no_lengths(spark, monkeypatch):
    _flow_of_pairs(spark, monkeypatch, "edgelen")


def _rows_written(monkeypatch):
    """Rows of each table that searches write between rounds."""
    from terrane.operators import extrema, fixpoint, paths

    sizes, real = [], fixpoint.cut

    def counted(df):
        out = real(df)
        sizes.append(out.count())
        return out

    for module in (extrema, fixpoint, paths):
        monkeypatch.setattr(module, "cut", counted)
    return sizes


def _points(spark, n, seed, k=6):
    """A graph of random points with few, often equal values: (graph, field, adjacency, values)."""
    rng = np.random.default_rng(seed)
    at, y = rng.random((n, 3)), rng.integers(0, n // 3, n) / 8.0
    near = {i: {} for i in range(n)}
    for i in range(n):
        d = np.sqrt(((at - at[i]) ** 2).sum(axis=1))
        for j in np.argsort(d)[1 : k + 1]:
            near[i][int(j)] = near[int(j)][i] = round(float(d[j]) * 1024) / 1024  # sums are exact in any order
    rows = [(a, b, w) for a in near for b, w in near[a].items() if a < b]
    return from_edges(spark.createDataFrame(rows, "a long, b long, len double")).cut(), spark.createDataFrame([(i, float(c)) for i, c in enumerate(y)], "v long, y double"), near, y


def _shortest(near, v):
    import heapq

    dist, heap = {v: 0.0}, [(0.0, v)]
    while heap:
        d, a = heapq.heappop(heap)
        if d == dist[a]:
            for b, w in near[a].items():
                if d + w < dist.get(b, float("inf")):
                    dist[b] = d + w
                    heapq.heappush(heap, (d + w, b))
    return dist


def test_constrained_flow_over_a_whole_graph_writes_no_pairs(spark, monkeypatch):
    n = 400
    g, field, near, y = _points(spark, n, 1)
    rising = {a: {b: w for b, w in near[a].items() if y[b] > y[a]} for a in near}
    want = {}
    for reach in (float("inf"), 0.4):
        for v in near:
            d, rise = _shortest(near, v), _shortest(rising, v)
            ok = [(-y[u], d[u], u) for u in rise if u != v and rise[u] <= d[u] + 1e-12 and rise[u] <= reach]
            want[reach, v] = min(ok)[2] if ok else None
    sizes = _rows_written(monkeypatch)
    got = {(reach, r.v): r.next for reach in (float("inf"), 0.4) for r in P.constrained_flow(g, g, field, reach).collect()}
    assert got == want and max(sizes, default=0) <= 20 * n


def test_constrained_flow_searches_no_whole_graph_from_every_vertex(spark):
    """Every vertex's distances to all others are 2e8 here."""
    m = 24
    n, rng = m**3, np.random.default_rng(12)
    at = np.arange(n).reshape(m, m, m)
    a, b = (np.concatenate([np.delete(at, k, axis=axis).ravel() for axis in range(3)]) for k in (m - 1, 0))
    w = rng.integers(512, 1024, len(a)) / 1024  # sums are exact in any order
    y = rng.permutation(n) / 8.0
    g = from_edges(spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "len": w}))).cut()
    began = time.time()
    got = {r.v: r.next for r in P.constrained_flow(g, g, spark.createDataFrame(pd.DataFrame({"v": np.arange(n), "y": y})), float("inf")).collect()}
    assert time.time() - began < 40
    near = {v: {} for v in range(n)}
    for i, j, d in zip(a.tolist(), b.tolist(), w.tolist()):
        near[i][j] = near[j][i] = d
    rising = {i: {j: d for j, d in x.items() if y[j] > y[i]} for i, x in near.items()}
    for v in range(0, n, 300):
        d, rise = _shortest(near, v), _shortest(rising, v)
        ok = [(-y[u], d[u], u) for u in rise if u != v and rise[u] <= d[u] + 1e-12]
        assert got[v] == (min(ok)[2] if ok else None)


def test_constrained_flow_along_ways_far_beyond_their_ends_surroundings(spark):
    """A ring that rises all along: half of it is a shortest way."""
    n = 1200
    g = from_edges(spark.createDataFrame([(i, (i + 1) % n, 1.0) for i in range(n)], "a long, b long, len double"))
    got = {r.v: r.next for r in P.constrained_flow(g, g, g.vertices.selectExpr("v", "cast(v as double) as y"), float("inf")).collect()}
    assert got == {v: min(n - 1, v + n // 2) for v in range(1, n - 1)} | {0: n - 1, n - 1: None}


def test_constrained_flow_of_odd_vertices(spark):
    """Vertices outside the core graph and without a value go nowhere, and nothing goes to the latter."""
    core = from_edges(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0)], "a long, b long, len double"))
    whole = from_edges(spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0)], "a long, b long, len double"))
    field = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None), (4, 9.0)], "v long, y double")
    assert {r.v: r.next for r in P.constrained_flow(whole, core, field, 10.0).collect()} == {1: 2, 2: None, 3: None, 4: None}


def test_scale_flow_over_a_whole_graph_writes_no_pairs(spark, monkeypatch):
    n = 400
    g, field, near, y = _points(spark, n, 2)
    sizes = _rows_written(monkeypatch)
    for scale, sign in ((float("inf"), 1), (0.4, 1), (0.4, -1)):
        want = {}
        for v in near:
            ok = [(-sign * y[u], d, u) for u, d in _shortest(near, v).items() if d <= scale and sign * y[u] > sign * y[v]]
            want[v] = min(ok)[2] if ok else None
        assert {r.v: r.next for r in P.scale_flow(g, field, scale, sign > 0).collect()} == want
    assert max(sizes) <= 20 * n


def test_hop_neighbourhoods_stop_at_their_own_index(spark, monkeypatch):
    """A path; the end's index is 20, all others' is 2."""
    g = from_edges(spark.createDataFrame([(i, i + 1, 1.0) for i in range(40)], "a long, b long, len double")).cut()
    index = {i: 2 for i in range(1, 40)} | {0: 20, 40: None}
    indexed = spark.createDataFrame([(i, "max", 1.0, h) for i, h in index.items()], "v long, type string, y double, hop_idx int")
    sizes = _rows_written(monkeypatch)
    got = {tuple(r) for r in X.hop_neighbourhoods(g, indexed).select("ref", "v", "hop", "boundary").collect()}
    assert got == {(i, j, abs(i - j), abs(i - j) == h) for i, h in index.items() if h is not None for j in range(41) if abs(i - j) <= h}
    assert max(sizes) <= 2 * 41
    none = X.hop_neighbourhoods(g, indexed.filter("hop_idx is null"))
    assert none.count() == 0 and none.columns == ["ref", "v", "hop", "boundary"]


def test_simplices_are_counted_without_making_them(spark):
    from math import comb

    rng = np.random.default_rng(3)
    rows = [(i, int(j), 1.0) for i in range(60) for j in rng.choice(60, 4 if i else 14, replace=False) if i != j]
    near = spark.createDataFrame(rows, "src long, dst long, len double")
    for dim in (1, 3):
        assert {tuple(r) for r in N.nerve_counts(near, dim).collect()} == {tuple(r) for r in N.simplex_counts(N.nerve(near, dim)).collect()}
    star = spark.createDataFrame([(i, 0, 1.0) for i in range(1, 401)] + [(0, 1, 1.0)], "src long, dst long, len double")
    assert {tuple(r) for r in N.nerve_counts(star, 3).collect()} == {(d, comb(401, d + 1)) for d in range(4)}  # over 1e9 of the last
    pair = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, len double")
    assert {tuple(r) for r in N.nerve_counts(pair, 3).collect()} == {(0, 2), (1, 1), (2, 0), (3, 0)}


def test_probable_radius_over_a_whole_graph_writes_no_pairs(spark, monkeypatch):
    from test_plain_versions import _hop_radius

    n = 400
    g, _, near, _ = _points(spark, n, 9, k=4)
    y = {v: float(c) for v, c in enumerate(np.random.default_rng(9).random(n))}
    rho = {v: float(v % 3) for v in y}  # some weigh nothing
    field, density = spark.createDataFrame(list(y.items()), "v long, y double"), spark.createDataFrame(list(rho.items()), "v long, density double")
    sizes = _rows_written(monkeypatch)
    for p, sign in ((0.05, 1), (0.8, 1), (0.6, -1)):
        own = {v: sign * c for v, c in y.items()}
        tops = [v for v in y if all(own[u] < own[v] for u in near[v])]
        want = {v: None if own[v] == max(own.values()) else _hop_radius(near, own, rho, v, p) for v in tops}
        assert {r.v: r.hop_radius for r in X.probable_radius(g, field, density, p, sign > 0).collect()} == want
    assert max(sizes) <= 20 * n
