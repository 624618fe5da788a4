"""Running sums in a total order without a window over all rows: ranges of the order, and what lies before each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import cut


def running(rows: DataFrame, order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Add for each name the sum of its expression over all rows up to this one and its peers, in an order.

    Rows are dealt into ranges of the order, as many as shuffle partitions; a table of one row per range has what comes before
    it. Equal values fall into one range.
    """
    part, base = "range_", {name: f"before_{k}" for k, name in enumerate(sums)}
    dealt = rows.repartitionByRange(*order).select("*", F.spark_partition_id().alias(part), *(x.alias(f"own_{k}") for k, x in enumerate(sums.values())))
    dealt = cut(dealt)
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    per = dealt.groupBy(part).agg(*(F.sum(f"own_{k}").alias(f"own_{k}") for k in range(len(sums))))
    per = per.select(part, *(F.coalesce(F.sum(f"own_{k}").over(earlier), F.lit(0)).alias(b) for k, b in enumerate(base.values())))
    upto = Window.partitionBy(part).orderBy(*order)
    return dealt.join(F.broadcast(per), part).select(*(F.col(c) for c in rows.columns), *((F.col(base[name]) + F.sum(f"own_{k}").over(upto)).alias(name) for k, name in enumerate(sums)))
