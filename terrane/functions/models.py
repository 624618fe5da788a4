"""Weighted linear models, one for each group of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..checkpoints import cut


def weighted_line(rows: DataFrame, by: str, x: Column, y: Column, w: Column, epsilon: float = 1e-10) -> DataFrame:
    """Add slope, fitted and loo_error (the squared error of the row without it) of the weighted line of its group.

    Where x does not vary the line is the weighted mean. loo_error is null for a row that decides its own fit (leverage 1).
    Groups without weight have no line: nulls. Sums are partial aggregates, joined back, so a group may be of any size.
    """
    own = ("x_", "y_", "w_")
    base = cut(rows.select("*", *(c.cast("double").alias(n) for c, n in zip((x, y, w), own))))
    total = F.sum("w_")
    means = base.groupBy(by).agg(total.alias("sw_"), (F.sum(F.expr("w_ * x_")) / F.nullif(total, F.lit(0.0))).alias("mx_"), (F.sum(F.expr("w_ * y_")) / F.nullif(total, F.lit(0.0))).alias("my_"))
    there = base.join(means, base[by].eqNullSafe(means[by])).drop(means[by])
    squares = there.groupBy(by).agg(F.sum(F.expr("w_ * pow(x_ - mx_, 2)")).alias("sxx_"), F.sum(F.expr("w_ * (x_ - mx_) * (y_ - my_)")).alias("sxy_"))
    both = there.join(squares, there[by].eqNullSafe(squares[by])).drop(squares[by])
    varies = F.col("sxx_") > epsilon
    both = both.withColumn("slope", F.when(varies, F.col("sxy_") / F.col("sxx_")).when(F.col("sw_") > 0, 0.0))
    both = both.withColumn("fitted", F.expr("my_ + slope * (x_ - mx_)"))
    leverage = F.expr("w_ / nullif(sw_, 0)") + F.when(varies, F.expr("w_ * pow(x_ - mx_, 2) / sxx_")).otherwise(0.0)
    error = F.when(1 - leverage > epsilon, F.pow((F.col("y_") - F.col("fitted")) / (1 - leverage), 2))
    return both.select(*(F.col(f"`{c}`") for c in rows.columns), "slope", "fitted", error.alias("loo_error"))
