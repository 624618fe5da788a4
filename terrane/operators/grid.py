"""Functions on a two-dimensional grid: critical points, walks and cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .fixpoint import roots
from .flow import trajectories

#: Neighbours in the order in which the first strictly better one wins.
_STEPS = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def create_grid(spark: SparkSession, n: int) -> DataFrame:
    """(i, j, x, y) for i, j from 1 to n; x and y run over [0, 1]."""
    g = spark.range(1, n + 1).selectExpr("id as i").crossJoin(spark.range(1, n + 1).selectExpr("id as j"))
    return g.select("i", "j", ((F.col("i") - 1) / (n - 1.0)).alias("x"), ((F.col("j") - 1) / (n - 1.0)).alias("y"))


def evaluate(grid: DataFrame, f: Column) -> DataFrame:
    """(i, j, f): a column expression over x and y."""
    return grid.select("i", "j", f.cast("double").alias("f"))


def _around(values: DataFrame) -> DataFrame:
    moves = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(a).alias("a"), F.lit(b).alias("b")) for k, (a, b) in enumerate(_STEPS))))
    asks = values.select("i", "j", "f", moves.alias("m")).select("i", "j", "f", F.col("m.k").alias("k"), (F.col("i") + F.col("m.a")).alias("ni"), (F.col("j") + F.col("m.b")).alias("nj"))
    return asks.join(values.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("f").alias("nf")), ["ni", "nj"])


def critical_points(values: DataFrame) -> DataFrame:
    """(i, j, f, type): points that no neighbour exceeds (max) or falls below (min); flat points are both."""
    per = _around(values).groupBy("i", "j").agg(F.max("nf").alias("hi"), F.min("nf").alias("lo"))
    p = values.join(per, ["i", "j"], "left")
    hi, lo = p.filter("hi is null or hi <= f").select("i", "j", "f", F.lit("max").alias("type")), p.filter("lo is null or lo >= f").select("i", "j", "f", F.lit("min").alias("type"))
    return hi.union(lo)


def next_points(values: DataFrame, n: int, up: bool = True) -> DataFrame:
    """(v, next): the best strictly better neighbour, the first of equals; v = (i - 1) n + j."""
    better = _around(values).filter("nf > f" if up else "nf < f")
    best = better.groupBy("i", "j").agg(F.min(F.struct((-F.col("nf") if up else F.col("nf")).alias("s"), "k", "ni", "nj")).alias("b"))
    v = lambda a, b: (F.col(a) - 1) * n + F.col(b)
    return values.select("i", "j").join(best, ["i", "j"], "left").select(v("i", "j").alias("v"), v("b.ni", "b.nj").alias("next"))


def walk(values: DataFrame, n: int, i: int, j: int, up: bool = True) -> DataFrame:
    """(position, i, j): the steepest walk from a point."""
    seed = values.filter((F.col("i") == i) & (F.col("j") == j)).select(((F.col("i") - 1) * n + F.col("j")).alias("v"))
    line = trajectories(next_points(values, n, up), seed).select(F.posexplode("path").alias("position", "v"))
    return line.select("position", F.expr(f"(v - 1) div {n} + 1").alias("i"), F.expr(f"(v - 1) % {n} + 1").alias("j"))


def cells(values: DataFrame, n: int) -> DataFrame:
    """(i, j, min_v, max_v, cell): points by the ends of their walks; cells are numbered as they come up row by row."""
    hi = roots(next_points(values, n, True)).select("v", F.col("root").alias("max_v"))
    lo = roots(next_points(values, n, False)).select("v", F.col("root").alias("min_v"))
    p = hi.join(lo, "v")
    first = p.groupBy("min_v", "max_v").agg(F.min("v").alias("first")).withColumn("cell", F.row_number().over(Window.orderBy("first")))
    return p.join(first, ["min_v", "max_v"]).select(F.expr(f"(v - 1) div {n} + 1").alias("i"), F.expr(f"(v - 1) % {n} + 1").alias("j"), "min_v", "max_v", "cell")
