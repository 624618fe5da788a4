"""Communities by modularity, scans over resolutions, similarity of partitions and consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..checkpoints import cut
from ..graph import Graph
from .comparison import modularity


def communities(graph: Graph, resolution: float = 1.0, weight: Column | None = None, seed: int = 1) -> DataFrame:
    """(v, cluster): communities that no merge of two would improve; a cluster is named by its smallest vertex.

    Each round every community names the neighbour whose merger raises modularity most. Mutual choices and, of the others,
    those of a leaf for a centre (a seeded coin per round) are taken, if they still pay when all others that chose the same
    centre come too; the best one always does. So modularity rises every round, stars merge at once, and only partial
    sums over community pairs move. Edges weigh 1 unless `weight` says otherwise.
    """
    links = cut(graph.edges.filter("src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), (F.lit(1.0) if weight is None else weight).cast("double").alias("w")))
    label = cut(graph.vertices.select("v", F.col("v").alias("c")))
    size = cut(links.groupBy(F.col("a").alias("c")).agg(F.sum("w").alias("t")))
    total = size.agg(F.sum("t")).first()[0]
    turn = 0
    while total:
        turn += 1
        ends = [size.select(F.col("c").alias(x), F.col("t").alias(f"t{x}")) for x in "ab"]
        cost = 2.0 * resolution / total**2
        gain = links.join(ends[0], "a").join(ends[1], "b").withColumn("gain", F.col("w") * (2.0 / total) - F.col("ta") * F.col("tb") * cost)
        best = gain.filter("gain > 1e-12").groupBy("a").agg(F.max(F.struct("gain", (-F.col("b")).alias("nb"), "ta")).alias("m"))
        best = cut(best.select("a", (-F.col("m.nb")).alias("b"), "m.gain", "m.ta"))
        if best.isEmpty():
            break
        back = best.select(F.col("a").alias("b"), F.col("b").alias("back"))
        chose = best.join(back, "b").withColumn("mutual", F.col("a") == F.col("back"))
        coin = F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), "a"), F.lit(2)) == 1
        chose = cut(chose.withColumn("leaf", F.when(F.col("mutual"), F.col("a") > F.col("b")).otherwise(coin)))
        centres = chose.filter(~F.col("leaf")).select(F.col("a").alias("b"))
        asked = chose.filter("leaf").join(centres, "b", "left_semi").select("a", "b", "gain", "ta")
        per = asked.groupBy("b").agg(F.sum("ta").alias("all"), F.max(F.struct("gain", (-F.col("a")).alias("na"))).alias("top"))
        pays = (F.col("a") == -F.col("top.na")) | (F.col("gain") - cost * F.col("ta") * (F.col("all") - F.col("ta")) > 1e-12)
        to = cut(asked.join(per, "b").filter(pays).select("a", F.col("b").alias("to")))
        moved = lambda df, c: df.join(to.withColumnRenamed("a", c), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        label = cut(moved(label, "c").select("v", "c"))
        links = cut(moved(moved(links, "a"), "b").filter("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")))
        size = cut(moved(size, "c").groupBy("c").agg(F.sum("t").alias("t")))
    first = label.groupBy("c").agg(F.min("v").alias("cluster"))
    return label.join(first, "c").select("v", "cluster")


def similarities(runs: DataFrame) -> DataFrame:
    """(first, second, adjusted_rand, nmi, vi) for every two runs of (run, v, cluster) over the same vertices, first < second.

    Two partitions that each hold one cluster are equal: 1, 1, 0.
    """
    a, b = (runs.select("v", F.col("run").alias(r), F.col("cluster").alias(c)) for r, c in (("first", "a"), ("second", "b")))
    cells = cut(a.join(b, "v").filter("first < second").groupBy("first", "second", "a", "b").agg(F.count("*").cast("double").alias("n")))
    pairs, spread = "n * (n - 1) / 2", "n * ln(n)"
    of = lambda *by: cells.groupBy("first", "second", *by).agg(F.sum("n").alias("n"))
    sums = lambda df, p: df.groupBy("first", "second").agg(F.sum(F.expr(pairs)).alias(f"{p}2"), F.sum(F.expr(spread)).alias(f"{p}l"))
    j = sums(cells, "c").join(sums(of("a"), "a"), ["first", "second"]).join(sums(of("b"), "b"), ["first", "second"]).join(of(), ["first", "second"])
    j = j.selectExpr("*", "a2 * b2 / nullif(n * (n - 1) / 2, 0) as chance", "ln(n) - al / n as ha", "ln(n) - bl / n as hb", "ln(n) - cl / n as hab")
    rand = "CASE WHEN (a2 + b2) / 2 - chance <> 0 THEN (c2 - chance) / ((a2 + b2) / 2 - chance) ELSE 1D END as adjusted_rand"
    nmi = "CASE WHEN ha + hb > 1e-12 THEN 2 * (ha + hb - hab) / (ha + hb) ELSE 1D END as nmi"
    return j.selectExpr("first", "second", rand, nmi, "2 * hab - ha - hb as vi")


def consensus(runs: DataFrame) -> DataFrame:
    """(run, stability): the mean adjusted Rand index of each run (run, v, cluster) with all runs, itself counting 1."""
    s = similarities(runs)
    both = s.selectExpr("first as run", "adjusted_rand as r").union(s.selectExpr("second", "adjusted_rand")).union(runs.select("run").distinct().selectExpr("run", "1D"))
    return both.groupBy("run").agg(F.avg("r").alias("stability"))


def scan_resolutions(graph: Graph, resolutions: list[float], weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Communities at each resolution: (resolution, clusters, modularity, adjusted_rand, nmi, vi), the last three with the
    resolution before it (null for the first), and the partitions (run, v, cluster), run being the place in the list."""
    order = sorted(set(resolutions))
    runs = rows = None
    for k, r in enumerate(order):
        c = cut(communities(graph, r, weight))
        q = modularity(graph, c.select("v", F.col("cluster").alias("label")), r).select(F.lit(k).alias("run"), F.lit(float(r)).alias("resolution"), "clusters", "modularity")
        c = c.select(F.lit(k).alias("run"), "v", "cluster")
        runs, rows = (c, q) if runs is None else (runs.union(c), rows.union(q))
    like = similarities(runs).filter("second = first + 1").withColumnRenamed("second", "run").drop("first")
    return rows.join(like, "run", "left").drop("run"), runs
