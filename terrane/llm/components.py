"""Connected components of a link table, wholly on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import drop_written, written


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo") % (1 << 40)), F.sum(F.col("hi") % (1 << 40))).first())


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node long, component long) for each node with a link; component is the smallest node reachable.

    Alternating large-star and small-star rounds: each is two partially aggregated minima joined back to
    the links, so a node with very many links is pre-aggregated and its join side is split by skew handling.
    Each round is written to the shared folder. Null ends and self links are ignored; no links, no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"), x.alias("x"), y.alias("y"))
    edges = written(edges.filter("x is not null and y is not null and hi <> lo").select("hi", "lo").distinct(), "links")
    seen = _signature(edges)
    while seen[0]:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(low, "hi").filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = written(moved.union(low.select("hi", F.col("m").alias("lo"))).distinct(), "links")
        now = _signature(after)
        drop_written(edges)
        edges = after
        if now == seen:
            break
        seen = now
    parents = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(parents)
