import math

import pytest
from pyspark.sql import functions as F

from terrane.graph import from_edges
from terrane.operators.fixpoint import nearest
from terrane.operators.tolerant import Tolerance
from terrane.plans.basin_complex import METHODS, basin_complex


@pytest.fixture(scope="module")
def ring(spark):
    n = 40
    rows = [(i, (i + s) % n, 1.0) for i in range(n) for s in (1, 2)]
    y = [(i, math.sin(2 * math.pi * i / n) + 0.2 * math.sin(8 * math.pi * i / n) + i * 1e-6) for i in range(n)]
    return from_edges(spark.createDataFrame(rows, "a long, b long, len double")).cut(), spark.createDataFrame(y, "v long, y double").cache()


@pytest.mark.parametrize("method", METHODS)
def test_every_method_gives_the_same_tables(spark, ring, method):
    g, y = ring
    mass = g.vertices.withColumn("mass", F.lit(1.0))
    how = Tolerance(n_min=30, q=0.2, tau0=0.1, h_max=200)
    c = basin_complex(g, y, method, tolerance=how, mass=mass, stages={"support": 2})
    b, m = c.basins.collect(), c.membership
    assert {r.type for r in b} == {"max", "min"} and all(r.raw_support_size >= 1 for r in b)
    assert c.refinement[-1]["stage"] == "support" and c.refinement[-1]["before"] >= c.refinement[-1]["after"]
    total = m.groupBy("v", "direction").agg(F.sum("membership_weight").alias("s")).collect()
    assert total and all(r.s == pytest.approx(1) for r in total)
    assert c.assignment.groupBy("v", "direction").count().filter("count > 1").isEmpty()
    held = {(r.basin_id, r.v) for r in m.collect()}
    assert {r.basin_id for r in b if r.retained} == {k for k, _ in held}
    if method == "superlevel_merge_tree":
        roots = [r for r in b if r.parent_basin_id is None]
        assert len(roots) == 2 and sum(r.primary_support_mass for r in b if r.type == "max") == pytest.approx(1)
        assert c.merges.count() == len(b) - 2
    if method == "overlap_cell_complex":
        assert c.cells is not None
    top = next(r for r in b if r.retained)
    assert c.vertices(top.basin_id).count() == top.retained_support_size
    assert c.without_label(top.basin_id, "mine").basin("mine").count() == 1


def test_nearest_keeps_what_a_full_search_finds(spark, ring):
    g, _ = ring
    got = nearest(g.edges, spark.createDataFrame([(0, 0), (7, 7)], "ref long, v long"), 6).collect()
    for s in (0, 7):
        want = sorted((-(-min((v - s) % 40, (s - v) % 40) // 2), v) for v in range(40))[:6]
        assert sorted((int(r.dist), r.v) for r in got if r.ref == s) == want


def test_unknown_method(spark, ring):
    with pytest.raises(ValueError):
        basin_complex(*ring, method="watershed")
