"""Basins that tolerate small setbacks: run-capped, tolerance-bounded descent from each extremum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph
from .extrema import edge_length_quantile
from .fixpoint import nearest


@dataclass(frozen=True)
class Tolerance:
    """n_min vertices form the region; a path may lose up to what its gain times lambda and tau(v) = tau0 (1 - progress)^kappa
    allow, run_max setbacks in a row and h_max steps; a vertex keeps its k_max best labels, a sink max_paths of them.

    lambda = (1 - q) / q if q is given, else (1 - m) / (1 + m).
    """

    n_min: int = 20
    m: float = 0.7
    q: float | None = None
    run_max: int = 2
    tau0: float = 0.1
    kappa: float = 1.5
    k_max: int = 24
    h_max: int = 1000
    reach: float = float("inf")
    eta: float = 0.0
    eps: float = 1e-12
    max_paths: int = 64

    def rate(self) -> float:
        if self.q is not None and 0 < self.q <= 1:
            return (1 - self.q) / max(1e-12, self.q)
        m = max(-0.999999, min(0.999999, self.m))
        return (1 - m) / max(1e-12, 1 + m)


def tolerant_basins(graph: Graph, field: DataFrame, extrema: DataFrame, how: Tolerance = Tolerance(), q: float = 0.9) -> DataFrame:
    """(extremum, type, v, hop): vertices on accepted paths from extrema (v, type) to the sinks of their regions.

    A region has the n_min vertices nearest to the extremum over edges up to the q-quantile of lengths; its arcs lead away from the
    extremum. Labels (distance, gain, loss, setbacks in a row, steps) are settled by distance; one that another is no worse than
    in any of distance, balance, run and steps, and better in one, is dropped. A region is one task, of bounded size.
    """
    e = graph.edges.crossJoin(F.broadcast(edge_length_quantile(graph, q))).filter(F.col("len") <= F.col("threshold") + how.eps).select("src", "dst", "len")
    starts = extrema.select(F.col("v").alias("ref"), "v").distinct()
    region = nearest(e, starts, how.n_min).select("ref", "v", "dist")
    inside = region.join(field, "v")
    to = region.select("ref", F.col("v").alias("dst"), F.col("dist").alias("far"))
    arcs = region.withColumnRenamed("v", "src").join(e, "src").join(to, ["ref", "dst"]).filter(F.col("far") > F.col("dist") + how.eps).select("ref", "src", "dst", "len")
    rows = inside.select("ref", "v", F.lit(None).cast("long").alias("dst"), F.col("dist").alias("x"), "y").union(arcs.select("ref", "src", "dst", "len", F.lit(None).cast("double")))
    rows = rows.join(extrema.select(F.col("v").alias("ref"), "type"), "ref")

    def search(table):
        import pyarrow as pa

        got = table.to_pylist()
        out = [{"extremum": got[0]["ref"], "type": got[0]["type"], "v": v, "hop": h} for v, h in sorted(_accepted(got, how).items())]
        return pa.Table.from_pylist(out, schema=pa.schema([("extremum", pa.int64()), ("type", pa.string()), ("v", pa.int64()), ("hop", pa.int32())]))

    return rows.groupBy("ref", "type").applyInArrow(search, "extremum long, type string, v long, hop int")


def _accepted(rows: list[dict], how: Tolerance) -> dict[int, int]:
    """vertex -> fewest steps on an accepted path, in one region."""
    import heapq

    source, sign = rows[0]["ref"], -1.0 if rows[0]["type"] == "max" else 1.0
    near = {r["v"]: r["x"] for r in rows if r["dst"] is None}
    y = {r["v"]: r["y"] for r in rows if r["dst"] is None}
    ahead: dict[int, list] = {v: [] for v in near}
    behind: dict[int, list] = {v: [] for v in near}
    for r in rows:
        if r["dst"] is not None:
            ahead[r["v"]].append((r["dst"], r["x"]))
            behind[r["dst"]].append((r["v"], r["x"]))
    sinks = sorted(v for v in near if not ahead[v]) or [source]
    left = dict.fromkeys(sinks, 0.0)
    heap = [(0.0, s) for s in sinks]
    while heap:
        d, u = heapq.heappop(heap)
        if d > left[u]:
            continue
        for p, w in behind[u]:
            if d + w < left.get(p, float("inf")):
                left[p] = d + w
                heapq.heappush(heap, (d + w, p))
    slack = {}
    for v in near:
        done = near[v] / (near[v] + left[v] + how.eps) if v in left else 0.0
        slack[v] = how.tau0 * max(0.0, 1.0 - min(1.0, done)) ** how.kappa

    rate, eps = how.rate(), how.eps
    labels = [(source, 0.0, 0.0, 0.0, 0, 0, None)]  # vertex, distance, gain, loss, run, steps, label before
    balance = lambda a: rate * a[2] - a[3]
    alive, at = {0}, {v: [] for v in near}
    at[source].append(0)

    def better(a, b):
        no_worse = a[1] <= b[1] + eps and balance(a) >= balance(b) - eps and a[4] <= b[4] and a[5] <= b[5]
        return no_worse and (a[1] < b[1] - eps or balance(a) > balance(b) + eps or a[4] < b[4] or a[5] < b[5])

    heap = [(0.0, 0)]
    while heap:
        _, k = heapq.heappop(heap)
        if k not in alive:
            continue
        u, d, gain, loss, run, steps, _ = labels[k]
        for v, w in sorted(ahead[u]):
            change = sign * (y[v] - y[u])
            set_back = change < -how.eta and abs(change) > how.eta
            new = (v, d + w, gain + max(0.0, change if abs(change) > how.eta else 0.0), loss + (-change if set_back else 0.0), run + 1 if set_back else 0, steps + 1, k)
            if balance(new) + slack[v] < -eps or new[4] > how.run_max or new[5] > how.h_max or new[1] > how.reach:
                continue
            others = [i for i in at[v] if i in alive]
            if any(better(labels[i], new) for i in others):
                continue
            alive -= {i for i in others if better(new, labels[i])}
            labels.append(new)
            n = len(labels) - 1
            alive.add(n)
            at[v].append(n)
            others = sorted((i for i in at[v] if i in alive), key=lambda i: (-balance(labels[i]), labels[i][1], labels[i][4], labels[i][5]))
            alive -= set(others[how.k_max :])
            if n in alive:
                heapq.heappush(heap, (new[1], n))
    out = {source: 0}
    for s in sinks:
        good = sorted((i for i in at[s] if i in alive and balance(labels[i]) >= -eps), key=lambda i: (-balance(labels[i]), labels[i][1], labels[i][5]))
        for i in good[: how.max_paths]:
            while i is not None:
                v, steps = labels[i][0], labels[i][5]
                out[v] = min(out.get(v, steps), steps)
                i = labels[i][6]
    return out
