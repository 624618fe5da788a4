"""Communities, partitions, spectra, charts, the nerve, shared neighbours, linear models and ragged files against numpy and plain Python."""

import itertools
import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.functions import models, scalars, stats
from terrane.graph import from_edges
from terrane.operators import charts, clusters, comparison, nerve as N, spectrum
from terrane.sources import graphs


def _graph(spark, pairs, n):
    return from_edges(spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a long, b long, len double"), spark.range(n).withColumnRenamed("id", "v")).cut()


def _points(spark, n=30, p=3, seed=4):
    x = np.random.default_rng(seed).normal(size=(n, p))
    rows = spark.createDataFrame([(i, [float(c) for c in x[i]]) for i in range(n)], "vec_id long, embedding array<double>")
    return x, rows


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    groups = [i // 12 for i in range(48)]
    pairs = [(a, b) for a, b in itertools.combinations(range(48), 2) if rng.random() < (0.7 if groups[a] == groups[b] else 0.02)]
    return _graph(spark, pairs, 50), groups, pairs


def test_planted_communities_are_found(spark, planted):
    g, groups, _ = planted
    got = {r.v: r.cluster for r in clusters.communities(g).collect()}
    assert [got[v] for v in range(48)] == [12 * k for k in groups] and got[48] == 48 and got[49] == 49


def test_no_merge_of_two_communities_pays(spark, planted):
    g, _, pairs = planted
    one = clusters.communities(g, 3.0)
    c = {r.v: r.cluster for r in one.collect()}
    m, t = 2 * len(pairs), Counter()
    for a, b in pairs:
        t[c[a]] += 1
        t[c[b]] += 1
    across = Counter(tuple(sorted((c[a], c[b]))) for a, b in pairs if c[a] != c[b])
    assert across and all(2 * w / m - 2 * 3.0 * t[a] * t[b] / m**2 <= 1e-9 for (a, b), w in across.items())
    assert sorted(c) == list(range(50)) and all(min(v for v in c if c[v] == k) == k for k in set(c.values()))
    star = _graph(spark, [(0, i) for i in range(1, 40)], 40)
    assert {r.cluster for r in clusters.communities(star, 0.5).collect()} == {0}
    assert clusters.communities(_graph(spark, [], 3)).count() == 3


def test_scan_and_consensus(spark, planted):
    rows, runs = clusters.scan_resolutions(planted[0], [4.0, 1.0])
    rows = sorted(rows.collect(), key=lambda r: r.resolution)
    assert [r.resolution for r in rows] == [1.0, 4.0] and rows[0].adjusted_rand is None
    assert rows[0].clusters < rows[1].clusters and 0 < rows[1].adjusted_rand < 1
    runs = runs.union(runs.filter("run = 0").selectExpr("2", "v", "cluster"))
    got = {r.run: r.stability for r in clusters.consensus(runs).collect()}
    assert got[0] == got[2] == pytest.approx((2 + rows[1].adjusted_rand) / 3) and got[1] < got[0]


def test_similarity_of_partitions(spark):
    rng = random.Random(1)
    a, b = [rng.randrange(4) for _ in range(80)], [rng.randrange(3) for _ in range(80)]
    runs = spark.createDataFrame([(r, v, c) for r, cs in enumerate((a, b, a, [0] * 80, [7] * 80)) for v, c in enumerate(cs)], "run int, v long, cluster long")
    got = {(r["first"], r["second"]): r for r in clusters.similarities(runs).collect()}
    assert len(got) == 10
    pairs = list(itertools.combinations(range(80), 2))
    same = sum(a[i] == a[j] and b[i] == b[j] for i, j in pairs)
    sa, sb = sum(a[i] == a[j] for i, j in pairs), sum(b[i] == b[j] for i, j in pairs)
    chance = sa * sb / len(pairs)
    entropy = lambda xs: -sum(n / 80 * math.log(n / 80) for n in Counter(xs).values())
    both, ha, hb = entropy(list(zip(a, b))), entropy(a), entropy(b)
    row = got[0, 1]
    assert row.adjusted_rand == pytest.approx((same - chance) / ((sa + sb) / 2 - chance))
    assert row.nmi == pytest.approx(2 * (ha + hb - both) / (ha + hb)) and row.vi == pytest.approx(2 * both - ha - hb)
    assert got[0, 2].adjusted_rand == pytest.approx(1) and got[0, 2].vi == pytest.approx(0)
    assert (got[3, 4].adjusted_rand, got[3, 4].nmi, got[3, 4].vi) == (1, 1, 0)


@pytest.mark.parametrize("normalized", [True, False])
def test_spectrum_equals_numpy(spark, normalized):
    rng = random.Random(5)
    n = 36
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(80)})
    w = np.zeros((n + 1, n + 1))
    for a, b in pairs:
        w[a, b] = w[b, a] = 1.0
    d = w.sum(axis=1)
    inv = np.where(d > 0, 1 / np.sqrt(np.maximum(d, 1)), 0)
    full = np.diag((d > 0) * 1.0) - inv[:, None] * w * inv if normalized else np.diag(d) - w
    values, vectors = spectrum.eigenvectors(_graph(spark, pairs, n + 1), 4, normalized=normalized)
    want = np.linalg.eigvalsh(full)[:4]
    assert [r.value for r in values.orderBy("rank").collect()] == pytest.approx(list(want), abs=1e-7)
    x = np.zeros((n + 1, 4))
    for r in vectors.collect():
        x[r.v, r["rank"]] = r.x
    assert np.abs(full @ x - x * want).max() < 1e-6 and np.abs(x.T @ x - np.eye(4)).max() < 1e-6
    assert all(x[np.abs(x[:, k]).round(9).argmax(), k] > 0 for k in range(4))


def test_angles_follow_a_ring(spark):
    n = 20
    order = random.Random(2).sample(range(n), n)
    angle = {r.v: r.angle for r in spectrum.circular_coordinates(_graph(spark, [(order[i], order[(i + 1) % n]) for i in range(n)], n)).collect()}
    gaps = [(angle[order[(i + 1) % n]] - angle[order[i]]) % (2 * math.pi) for i in range(n)]
    assert all(g == pytest.approx(gaps[0], abs=1e-5) for g in gaps) and min(gaps[0], 2 * math.pi - gaps[0]) == pytest.approx(2 * math.pi / n, abs=1e-5)


@pytest.mark.parametrize(("centre", "dim"), [("mean", 0), ("anchor", 2)])
def test_charts_equal_numpy(spark, centre, dim):
    x, rows = _points(spark)
    near = graphs.neighbours(rows, 6)
    for r in charts.local_charts(rows, near, dim, 0.8, centre).collect():
        d = np.sqrt(((x - x[r.v]) ** 2).sum(axis=1))
        members = sorted(np.lexsort((np.arange(30), d))[:7])
        assert r.members == members
        local = x[members]
        c = local - (x[r.v] if centre == "anchor" else local.mean(axis=0))
        s = np.sqrt(np.maximum(np.linalg.eigvalsh(c.T @ c)[::-1], 0))
        assert r.singular == pytest.approx(list(s))
        shares = np.cumsum(s**2) / (s**2).sum()
        assert r.dim == (dim or int(np.argmax(shares >= 0.8)) + 1) and r.ratio == pytest.approx(shares[r.dim - 1])
        basis = np.array(r.basis)
        assert np.abs(c.T @ c @ basis.T - basis.T * s[: r.dim] ** 2).max() < 1e-8 and all(b[np.abs(b).argmax()] > 0 for b in basis)
        assert np.abs(np.array(r.coordinates) - (local - x[r.v]) @ basis.T).max() < 1e-9


def test_nerve_and_shared_neighbours(spark):
    x, rows = _points(spark, 18, 2)
    near = graphs.neighbours(rows, 4).cache()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    cover = [set(np.lexsort((np.arange(18), d[i]))[:5]) for i in range(18)]
    pairs = list(itertools.combinations(range(18), 2))
    shared = {(a, b): min(d[a, c] + d[b, c] for c in cover[a] & cover[b]) for a, b in pairs if cover[a] & cover[b]}
    got = {(r.a, r.b): r for r in graphs.shared_edges(near).collect()}
    assert {k: r.len for k, r in got.items()} == pytest.approx(shared) and all(r.common == len(cover[a] & cover[b]) for (a, b), r in got.items())
    assert {(r.a, r.b) for r in graphs.mutual_edges(near).collect()} == {(a, b) for a, b in pairs if a in cover[b] and b in cover[a]}
    area = lambda t: (lambda p, q, r: math.sqrt(max(0.0, (s := (p + q + r) / 2) * (s - p) * (s - q) * (s - r))))(*(shared[e] for e in itertools.combinations(t, 2)))
    want = {(v,): 1.0 for v in range(18)} | shared
    for t in itertools.combinations(range(18), 3):
        if set.intersection(*(cover[v] for v in t)):
            want[t] = area(t)
    for t in itertools.combinations(range(18), 4):
        if set.intersection(*(cover[v] for v in t)):
            side = sum(shared[e] for e in itertools.combinations(t, 2)) / 6
            want[t] = sum(area(f) for f in itertools.combinations(t, 3)) / 4 * side * math.sqrt(6) / 9
    simplices = N.nerve(near, 3)
    assert {tuple(r.vertices): r.weight for r in simplices.collect()} == pytest.approx(want, abs=1e-7)
    assert {r.dim: r.n for r in N.simplex_counts(simplices).collect()} == Counter(len(t) - 1 for t in want)


def test_lines_of_groups(spark):
    rng = random.Random(8)
    rows = [(g, rng.random(), rng.random(), rng.random() + 0.1) for g in (1, 1, 1, 1, 1, 2, 2, 2, None, None, None)] + [(3, 1.0, 5.0, 1.0), (4, 2.0, 1.0, 1.0), (4, 2.0, 3.0, 3.0), (5, 1.0, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "g long, x double, y double, w double")
    got = models.weighted_line(df, "g", F.col("x"), F.col("y"), F.col("w")).collect()
    assert len(got) == len(rows)
    fit = lambda rs: np.polyfit([r[1] for r in rs], [r[2] for r in rs], 1, w=[math.sqrt(r[3]) for r in rs])
    for r in got:
        group = [q for q in rows if q[0] == r.g]
        if r.g in (1, 2, None):
            assert (r.slope, r.fitted) == pytest.approx((fit(group)[0], float(np.polyval(fit(group), r.x))))
            left = [q for q in group if q != (r.g, r.x, r.y, r.w)]
            assert r.loo_error == pytest.approx(float(np.polyval(fit(left), r.x) - r.y) ** 2, rel=1e-6)
        elif r.g == 3:
            assert (r.slope, r.fitted, r.loo_error) == (0, 5, None)
        elif r.g == 4:
            assert (r.slope, r.fitted) == (0, 2.5) and r.loo_error == pytest.approx(4.0)
        else:
            assert (r.slope, r.fitted, r.loo_error) == (None, None, None)


def test_proportions(spark):
    rows = [("a", "y")] * 12 + [("a", "n")] * 8 + [("b", "y")] * 5 + [("b", "n")] * 15 + [("c", "n")] * 4 + [("c", None)]
    got = {r.level: r for r in stats.proportions(spark.createDataFrame(rows, "g string, x string"), "g", "x", "y").collect()}
    assert {k: (r.n, r.successes, r.share) for k, r in got.items()} == {"a": (20, 12, 0.6), "b": (20, 5, 0.25), "c": (4, 0, 0.0)}
    expect = 17 * 20 / 44
    chi = (12 - expect - 0.5) ** 2 * sum(1 / (r * c / 44) for r in (17, 27) for c in (20, 24))
    assert got["a"].chi_sq == pytest.approx(chi) and got["a"].p_value == pytest.approx(math.erfc(math.sqrt(chi / 2)))
    one = stats.proportions(spark.createDataFrame(rows, "g string, x string"), "g", "x", "y", 0.5).filter("level = 'b'").first()
    assert one.chi_sq == pytest.approx(4.5**2 / 10 * 2) and one.p_value == pytest.approx(math.erfc(math.sqrt(one.chi_sq / 2)))


def test_ragged_files_and_names(spark, tmp_path):
    lists = [[3, -1], [], [7]]
    (tmp_path / "lists.bin").write_bytes(struct.pack("<Q", 3) + b"".join(struct.pack(f"<Q{len(x)}i", len(x), *x) for x in lists))
    got = sorted((r.row, r.pos, r.value) for r in graphs.read_ragged(spark, str(tmp_path)).collect())
    assert got == [(i, j, v) for i, x in enumerate(lists) for j, v in enumerate(x)]
    names = spark.createDataFrame([("Compound A/B + C's metabolite*",), ("a,b (c): d",)], "s string")
    assert [r[0] for r in names.select(scalars.standardised(F.col("s"))).collect()] == ["Compound_A_B__Cs_metabolite", "a_b_c_d"]
