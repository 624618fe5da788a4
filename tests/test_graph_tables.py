"""Pruning, comparison and running sums against plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terrane.functions import stats
from terrane.functions.ranks import running
from terrane.graph import from_edges
from terrane.operators import association as A, comparison as C, pruning


def _graph(spark, rows, n):
    return from_edges(spark.createDataFrame(rows, "a long, b long, len double"), spark.range(n).withColumnRenamed("id", "v")).cut()


def _random(seed, n=60, m=170):
    rng = random.Random(seed)
    pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
    return [(a, b, float(rng.randint(1, 40))) for a, b in pairs]


def _connected(edges, a, b):
    seen, todo = {a}, [a]
    while todo:
        v = todo.pop()
        for x, y in edges:
            for s, t in ((x, y), (y, x)):
                if s == v and t not in seen:
                    seen.add(t)
                    todo.append(t)
    return b in seen


@pytest.mark.parametrize(("seed", "share"), [(2, 0.9), (4, 0.0)])
def test_long_edges_go_one_by_one(spark, seed, share):
    rows = _random(seed)
    left = {(a, b): w for a, b, w in rows}
    falling = sorted(rows, key=lambda r: (-r[2], r[0], r[1]))
    bound = falling[min(int(len(rows) * share), len(rows) - 1)][2] if 0 < share < 1 else (0 if share else math.inf)
    for a, b, w in falling:
        if w >= bound:
            del left[a, b]
            if not _connected(left, a, b):
                left[a, b] = w
    got = pruning.prune_long_edges(_graph(spark, rows, 60), share).edges.filter("src < dst").collect()
    assert {(r.src, r.dst): r.len for r in got} == left


def test_summaries_of_small_graphs(spark):
    g = _graph(spark, [(0, 1, 0.2), (1, 2, 0.8)], 4)
    shares = lambda t: {r.bin: r.share for r in t.collect()}
    assert shares(C.degree_distribution(g)) == {"0": 0.25, "1": 0.5, "2": 0.25}
    assert shares(C.component_distribution(g)) == {"1": 0.25, "3": 0.75}
    labels = spark.createDataFrame([(0, "A"), (1, "A"), (2, "B")], "v long, label string")
    assert shares(C.label_distribution(g, labels)) == {"A|A": 0.5, "A|B": 0.5}
    one, two = C.length_distributions(g, g, 4)
    assert C.divergence(one, two).first()[0] == 0
    other = _graph(spark, [(0, 1, 0.5)], 4)
    assert C.edit_distance(g, other, 2.0, 10.0).first()[0] == pytest.approx(3 + 2)
    assert C.modularity(g, labels).first().modularity == pytest.approx(2 / 4 - (3 / 4) ** 2 + 0 - (1 / 4) ** 2)
    p, q = {"0": 0.25, "1": 0.5, "2": 0.25}, {"0": 0.5, "1": 0.5}
    want = sum(x / 2 * math.log(x / ((p.get(k, 0) + q.get(k, 0)) / 2)) for d in (p, q) for k, x in d.items() if x)
    assert C.divergence(C.degree_distribution(g), C.degree_distribution(other)).first()[0] == pytest.approx(want)


def test_running_sums_cross_ranges(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, *range(20)]), rng.randint(1, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "i long, x int, w long").repartition(5)
    got = {r.i: (r.n, r.s) for r in running(df, [F.col("x").asc()], {"n": F.lit(1), "s": F.col("w")}).collect()}
    key = lambda x: (x is not None, x or 0)
    for i, x, _ in rows:
        upto = [r for r in rows if key(r[1]) <= key(x)]
        assert got[i] == (len(upto), sum(r[2] for r in upto))
    assert running(df.limit(0), ["x"], {"n": F.lit(1)}).collect() == []
    mean = {r.i: r.running_mean for r in stats.running_mean(df, "i", "w", 3).collect()}
    for i in range(300):
        near = [r[2] for r in rows[max(0, i - 3) : i + 4]]
        assert mean[i] == pytest.approx(sum(near) / len(near))


def test_permuted_fields_hold_every_value_once(spark, monkeypatch):
    n = 40
    g = _graph(spark, [(i, (i + k) % n, 1.0) for i in range(n) for k in (1, 2)], n)
    rng = random.Random(4)
    value = [rng.random() for _ in range(n)]
    y = spark.createDataFrame(list(enumerate(value)), "v long, y double")
    z = A.one_feature(y)
    seen, plain = [], A.lcor_matrix
    monkeypatch.setattr(A, "lcor_matrix", lambda graph, y, z, **o: (seen.append(z), plain(graph, y, z, **o))[1])
    (row,) = A.permutation_test(g, y, z, times=19).collect()
    assert row.p_value == pytest.approx(1 / 20) and row.observed == pytest.approx(1.0)
    drawn = {}
    for r in seen[1].collect():
        drawn.setdefault(r.feature, []).append((r.v, r.value))
    assert len(drawn) == 19 and len({str(sorted(d)) for d in drawn.values()}) == 19
    for d in drawn.values():
        assert sorted(v for v, _ in d) == list(range(n)) and Counter(x for _, x in d) == Counter(value)


def test_bootstrap_means_are_weighted_means(spark):
    y = spark.createDataFrame([(i, float(i % 10)) for i in range(400)], "v long, y double")
    got = [r["mean"] for r in stats.bootstrap_means(y, "y", 60).collect()]
    assert len(got) == 60 and len(set(got)) == 60
    sd = (sum((m - 4.5) ** 2 for m in got) / 60) ** 0.5
    assert abs(sum(got) / 60 - 4.5) < 0.1 and 0.08 < sd < 0.25
    assert got == [r["mean"] for r in stats.bootstrap_means(y, "y", 60).collect()]
