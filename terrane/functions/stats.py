"""Statistics over tables: tests of concordance, distances of samples, intervals of shares."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..checkpoints import cut
from .ranks import running


def concordance_test(differences: DataFrame) -> DataFrame:
    """One row (n, concordance, chi_sq, cramer_v, odds_ratio) of the signs of dy and dz (dy > 0 against dz > 0), with continuity correction."""
    c = {f"{a}{b}": F.sum(F.when((F.col("dy") > 0) == bool(a), F.when((F.col("dz") > 0) == bool(b), 1.0).otherwise(0.0)).otherwise(0.0)).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)}
    t = differences.agg(*c.values()).withColumn("n", F.expr("n00 + n01 + n10 + n11"))
    rows, cols = ("(n00 + n01)", "(n10 + n11)"), ("(n00 + n10)", "(n01 + n11)")
    cells = [(f"n{a}{b}", f"({rows[a]} * {cols[b]} / n)") for a in (0, 1) for b in (0, 1)]
    # the correction is at most the smallest deviation
    fix = "least(0.5D, " + ", ".join(f"abs({o} - {e})" for o, e in cells) + ")"
    chi = " + ".join(f"pow(abs({o} - {e}) - {fix}, 2) / {e}" for o, e in cells)
    t = t.withColumn("chi_sq", F.expr(chi))
    return t.select("n", F.expr("(n00 + n11) / n").alias("concordance"), "chi_sq", F.sqrt(F.col("chi_sq") / F.col("n")).alias("cramer_v"), F.expr("n00 * n11 / (n01 * n10)").alias("odds_ratio"))


def proportions(rows: DataFrame, group: str, outcome: str, success, expected: float | None = None) -> DataFrame:
    """(level, n, successes, share, chi_sq, p_value) of an outcome in each group, against all other groups or an expected share.

    One degree of freedom, with a continuity correction of at most the deviation; null where there is nothing to compare with.
    Rows without group or outcome count nothing.
    """
    known = rows.filter(F.col(group).isNotNull() & F.col(outcome).isNotNull())
    per = known.groupBy(F.col(group).alias("level")).agg(F.count("*").alias("n"), F.sum((F.col(outcome) == success).cast("long")).alias("successes"))
    if expected is None:
        total = per.agg(F.sum("n").alias("m"), F.sum("successes").alias("yes"))
        per = per.crossJoin(F.broadcast(total)).withColumn("e", F.expr("n * yes / m"))
        weight = F.expr("1 / nullif(e, 0) + 1 / nullif(n - e, 0) + 1 / nullif(yes - e, 0) + 1 / nullif(m - n - yes + e, 0)")
    else:
        per = per.withColumn("e", F.col("n") * expected)
        weight = F.expr("1 / nullif(e, 0) + 1 / nullif(n - e, 0)")
    off = F.abs(F.col("successes") - F.col("e"))
    per = per.select("level", "n", "successes", (F.col("successes") / F.col("n")).alias("share"), (F.pow(off - F.least(F.lit(0.5), off), 2) * weight).alias("chi_sq"))

    @F.pandas_udf("double")
    def upper_tail(x: pd.Series) -> pd.Series:
        return x.map(lambda c: math.erfc(math.sqrt(c / 2)), na_action="ignore")

    return per.withColumn("p_value", upper_tail("chi_sq"))


def beta_binomial(successes: DataFrame, a: float = 1.0, b: float = 1.0) -> DataFrame:
    """(.., post_a, post_b, post_mean, post_sd) of a share with a Beta(a, b) prior, from columns (k, n)."""
    out = successes.withColumn("post_a", F.col("k") + a).withColumn("post_b", F.col("n") - F.col("k") + b)
    s = F.col("post_a") + F.col("post_b")
    return out.withColumn("post_mean", F.col("post_a") / s).withColumn("post_sd", F.sqrt(F.col("post_a") * F.col("post_b") / (s * s * (s + 1))))


def wasserstein(values: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """One row (distance): the first Wasserstein distance of two groups' samples, as the area between their distribution functions."""
    two = values.filter(F.col(group).isin([a, b]))
    n = two.agg(F.sum((F.col(group) == a).cast("double")).alias("na"), F.sum((F.col(group) == b).cast("double")).alias("nb"))
    per = two.groupBy(F.col(value).alias("x")).agg(F.sum((F.col(group) == a).cast("double")).alias("ca"), F.sum((F.col(group) == b).cast("double")).alias("cb"))
    per = running(per, ["x"], {"i": F.lit(1), "a": F.col("ca"), "b": F.col("cb")})
    after = per.select((F.col("i") - 1).alias("i"), F.col("x").alias("next"))
    per = per.join(after, "i").crossJoin(F.broadcast(n)).select(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb")).alias("d"), (F.col("next") - F.col("x")).alias("w"))
    return per.agg(F.coalesce(F.sum(F.col("d") * F.col("w")), F.lit(0.0)).alias("distance"))


def running_mean(rows: DataFrame, order: str, value: str, half: int) -> DataFrame:
    """Add the mean of a value over a window of so many rows to either side, shorter at the ends. `order` tells all rows apart."""
    ranked = cut(running(rows, [order], {"place": F.lit(1)}))
    told = ranked.select(F.explode(F.sequence(F.col("place") - half, F.col("place") + half)).alias("place"), F.col(value).alias("near"))
    return ranked.join(told.groupBy("place").agg(F.avg("near").alias("running_mean")), "place").select(*rows.columns, "running_mean")


def bootstrap_means(values: DataFrame, value: str, times: int, seed: int = 1) -> DataFrame:
    """(draw, mean): Bayesian bootstrap; weights are exponential draws from seeded hashes of the row's key (v)."""
    d = values.crossJoin(F.broadcast(values.sparkSession.range(times).withColumnRenamed("id", "draw")))
    u = (F.pmod(F.xxhash64(F.lit(seed), "draw", "v"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return d.withColumn("w", -F.log(u)).groupBy("draw").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))
