"""Level-set merge trees, persistence, cuts and layouts.

A tree of a large graph is that of a small one: each plateau flows to some higher neighbour, so vertices fall into one segment per
terminal plateau, and two segments meet first at the best lower end of the edges between them. What is left is a table of
meeting segments, thinned by spanning forests on every task, on which the elder rule runs once per component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..checkpoints import cut
from ..graph import Graph
from .extrema import edge_values
from .fixpoint import components, jumps, roots, walks
from .flow import plateaus

_EVENTS = "losing long, surviving long, plateau long, level double, birth double, persistence double, status string"


def _order(level, plateau):
    return (-level, plateau)


def _spanning(batches):
    """Of the meetings in a partition, those that join what earlier ones (in order) have not joined."""
    import pyarrow as pa

    rows = []
    for batch in batches:
        rows += batch.to_pylist()
    rows.sort(key=lambda r: (*_order(r["level"], r["plateau"]), r["a"], r["b"]))
    up, kept = {}, []
    for r in rows:
        x, y = _find(up, r["a"]), _find(up, r["b"])
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(r)
    if kept:
        yield pa.RecordBatch.from_pylist(kept, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("level", pa.float64()), ("plateau", pa.int64()), ("ba", pa.float64()), ("bb", pa.float64())]))


def _find(up, x):
    up.setdefault(x, x)
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _elder(table):
    """Events of one component: at each plateau in order, the segments that meet there join the eldest of them."""
    import itertools

    import pyarrow as pa

    rows = sorted(table.to_pylist(), key=lambda r: _order(r["level"], r["plateau"]))
    up, birth, out = {}, {}, []
    for r in rows:
        birth[r["a"]], birth[r["b"]] = r["ba"], r["bb"]
    for (_, plateau), group in itertools.groupby(rows, key=lambda r: _order(r["level"], r["plateau"])):
        group = list(group)
        for met in _joined(group, up):
            eldest = min(met, key=lambda s: (-birth[s], s))
            for s in sorted(met - {eldest}):
                level = group[0]["level"]
                out.append({"losing": s, "surviving": eldest, "plateau": plateau, "level": level, "birth": birth[s], "persistence": abs(birth[s] - level), "status": "elder_tie" if birth[s] == birth[eldest] else "merged"})
                up[s] = eldest
    names = [x.split()[0] for x in _EVENTS.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    return pa.Table.from_pylist(out, schema=pa.schema([(n, types[x.split()[1]]) for n, x in zip(names, _EVENTS.split(", "))]))


def _joined(group, up):
    """Sets of current survivors that the meetings of one plateau connect."""
    sets = []
    for r in group:
        new = {_find(up, r["a"]), _find(up, r["b"])}
        for s in [s for s in sets if s & new]:
            sets.remove(s)
            new |= s
        sets.append(new)
    return [s for s in sets if len(s) > 1]


def _climbed(at: DataFrame, events: DataFrame) -> DataFrame:
    """(v, basin): of rows (v, plateau, y, basin) the basin that has survived by the level of v.

    Levels fall along a chain of survivors, so a step of 2^k of them is right if its last one is; steps are tried from the
    longest down, and rounds are as many as the longest chain's length has binary digits.
    """
    steps = []
    step = events.select("losing", "surviving", F.col("level").alias("el"), F.col("plateau").alias("ep"))
    while not step.isEmpty():
        steps.append(step)
        on = step.select(F.col("losing").alias("surviving"), F.col("surviving").alias("to"), F.col("el").alias("l"), F.col("ep").alias("p"))
        step = cut(step.select("losing", "surviving").join(on, "surviving").select("losing", F.col("to").alias("surviving"), F.col("l").alias("el"), F.col("p").alias("ep")))
    for step in reversed(steps):
        j = at.join(step.withColumnRenamed("losing", "basin"), "basin", "left")
        moves = F.expr("surviving is not null and (el > y or (el = y and ep <= plateau))")
        at = j.select("v", "plateau", "y", F.when(moves, F.col("surviving")).otherwise(F.col("basin")).alias("basin"))
    return cut(at.select("v", "basin"))


def merge_tree(graph: Graph, field: DataFrame, up: bool = True, assign: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(events, basins, assignment) of superlevel sets (sublevel sets if not `up`); no assignment (None) if it is not asked for.

    events: (losing, surviving, plateau, level, birth, persistence, status): when sets that were apart meet at a plateau, the one
    of higher birth, then smaller vertex, survives. Ids are the representatives (smallest vertex) of terminal plateaus.
    basins: (basin, birth, death, persistence, parent): a root's death is its component's opposite extreme.
    assignment: (v, basin): the survivor at the level of v. Levels are in the field's own values.
    """
    sign = 1.0 if up else -1.0
    f = field.select("v", (F.col("y") * sign).alias("y"))
    p = cut(plateaus(graph, f))
    e = edge_values(graph, f)
    a, b = p.select(F.col("v").alias("src"), F.col("plateau").alias("ps")), p.select(F.col("v").alias("dst"), F.col("plateau").alias("pd"))
    e = cut(e.join(a, "src").join(b, "dst").filter("yd > ys").groupBy("ps", "pd").agg(F.first("ys").alias("ys"), F.first("yd").alias("yd")))
    level = p.filter("v = plateau").join(f, "v").select("plateau", F.col("y").alias("level"))
    rise = e.groupBy(F.col("ps").alias("v")).agg(F.min(F.struct((-F.col("yd")).alias("s"), "pd")).alias("b")).select("v", F.col("b.pd").alias("next"))
    seg = cut(roots(level.select(F.col("plateau").alias("v")).join(rise, "v", "left")).select(F.col("v").alias("plateau"), F.col("root").alias("segment")))
    born = level.join(seg.filter("plateau = segment"), "plateau").select("segment", F.col("level").alias("birth"))
    sa, sb = seg.select(F.col("plateau").alias("ps"), F.col("segment").alias("a")), seg.select(F.col("plateau").alias("pd"), F.col("segment").alias("b"))
    met = e.join(sa, "ps").join(sb, "pd").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.struct((-F.col("ys")).alias("s"), F.col("ps").alias("plateau")).alias("k"))
    met = met.groupBy("a", "b").agg(F.min("k").alias("k")).select("a", "b", (-F.col("k.s")).alias("level"), "k.plateau")
    met = met.join(born.select(F.col("segment").alias("a"), F.col("birth").alias("ba")), "a").join(born.select(F.col("segment").alias("b"), F.col("birth").alias("bb")), "b").select("a", "b", "level", "plateau", "ba", "bb")
    met = cut(met.mapInArrow(_spanning, met.schema))
    part = cut(components(born.select(F.col("segment").alias("v")), met.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
    events = cut(met.join(part, met.a == part.v).drop("v").groupBy("component").applyInArrow(lambda t: _elder(t.drop_columns(["component"])), _EVENTS))
    low = seg.join(level, "plateau").join(part, seg.segment == part.v).groupBy("component").agg(F.min("level").alias("floor"))
    lost = events.select(F.col("losing").alias("basin"), F.col("level").alias("lost_at"), F.col("surviving").alias("parent"))
    basins = born.withColumnRenamed("segment", "basin").join(part.withColumnRenamed("v", "basin"), "basin").join(low, "component").join(lost, "basin", "left")
    death = F.coalesce("lost_at", "floor")
    basins = basins.select("basin", (F.col("birth") * sign).alias("birth"), (death * sign).alias("death"), F.abs(F.col("birth") - death).alias("persistence"), "parent")
    at = None
    if assign:
        at = _climbed(p.join(f, "v").join(seg, "plateau").select("v", "plateau", "y", F.col("segment").alias("basin")), events)
    events = events.withColumn("level", F.col("level") * sign).withColumn("birth", F.col("birth") * sign)
    return events, basins, at


def supports(basins: DataFrame, assignment: DataFrame) -> DataFrame:
    """(v, basin): hierarchical supports; a survivor absorbs what its losers hold."""
    above = walks(jumps(basins, "basin", "parent"), basins.select(F.col("basin").alias("v")))
    return assignment.select("v", F.col("basin").alias("start")).join(above.select("start", F.col("v").alias("basin")), "start").select("v", "basin").distinct()


def cut_tree(graph: Graph, field: DataFrame, height: float, up: bool = True) -> tuple[DataFrame, DataFrame]:
    """(components, members) of {y >= height} (<= if not up): (component, extremum, value, size) and (v, component).

    The extremum is the best value's smallest vertex. Equality is included.
    """
    active = field.filter(F.col("y") >= height if up else F.col("y") <= height)
    ids = active.select("v")
    e = graph.edges.join(ids.withColumnRenamed("v", "src"), "src", "left_semi").join(ids.withColumnRenamed("v", "dst"), "dst", "left_semi")
    part = cut(components(ids, e))
    best = F.min(F.struct((-F.col("y") if up else F.col("y")).alias("k"), "v"))
    per = part.join(active, "v").groupBy("component").agg(best.alias("b"), F.count("*").alias("size"))
    return per.select("component", F.col("b.v").alias("extremum"), (-F.col("b.k") if up else F.col("b.k")).alias("value"), "size"), part


def persistence(graph: Graph, field: DataFrame, top: int | None = None) -> DataFrame:
    """(basin, birth, death, persistence, parent) of superlevel sets, the most persistent first."""
    out = merge_tree(graph, field, assign=False)[1].orderBy(F.col("persistence").desc(), "basin")
    return out if top is None else out.limit(top)


def layout(basins: DataFrame) -> DataFrame:
    """(basin, x, birth, death, parent): x is the place of a branch when children follow their parents, longest first."""
    paths = cut(basins.filter("parent is null").select("basin", F.array(F.struct((-F.col("persistence")).alias("k"), "basin")).alias("path")))
    out, todo = paths, basins.filter("parent is not null").select("basin", "parent", F.struct((-F.col("persistence")).alias("k"), "basin").alias("s"))
    while True:
        paths = cut(todo.join(paths.withColumnRenamed("basin", "parent"), "parent").select("basin", F.array_append("path", F.col("s")).alias("path")))
        if paths.isEmpty():
            break
        out = cut(out.union(paths))
    return out.withColumn("x", F.row_number().over(Window.orderBy("path"))).join(basins, "basin").select("basin", "x", "birth", "death", "parent")


def dendrogram(events: DataFrame, up: bool = True) -> DataFrame:
    """(step, left, right, height): merges in order; a cluster is its number of step, a basin not merged before its id, negated.

    Height is the drop from the highest merge level, so it grows.
    """
    order = Window.orderBy((-F.col("level") if up else F.col("level")), "plateau", "losing")
    e = cut(events.withColumn("step", F.row_number().over(order)).withColumn("top", F.max("level").over(Window.partitionBy()) if up else F.min("level").over(Window.partitionBy())))
    joins = e.select(F.col("surviving").alias("s"), F.col("step").alias("at")).union(e.select("losing", F.lit(None).cast("int")))
    last = lambda c: F.max("at").alias(c)
    out = e
    for side, c in (("surviving", "left"), ("losing", "right")):
        before = e.select("step", F.col(side).alias("s")).join(joins.filter("at is not null"), "s").filter("at < step").groupBy("step").agg(last("b"))
        out = out.join(before, "step", "left").withColumn(c, F.coalesce(F.col("b").cast("long"), -F.col(side))).drop("b")
    return out.select("step", "left", "right", F.abs(F.col("top") - F.col("level")).alias("height"))
