"""Embedding near-duplicates by collision counting on sorted one-dimensional projections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from .common import written
from .components import connected_components

#: Rows of a block; a task compares two blocks of one label, so its memory does not grow with the label.
_BLOCK = 2048
#: Projections counted first on all pairs of two blocks, and those counted after on the pairs that are left.
_FIRST, _SECOND = 24, 40
#: Half width of a window, in units of the distance of two unit vectors at the threshold.
_WIDTH = 1.75
#: Chance that a pair exactly at the threshold is missed by a count (closer pairs collide more often).
_MISS = 1e-7


def least_count(projections: int, width: float, miss: float = _MISS) -> int:
    """The largest count that a pair at the threshold distance reaches with a chance of at least 1 - miss.

    A Gaussian projection of its difference is normal with the distance as deviation, so the count is binomial
    with p = P(|normal| <= width).
    """
    p = math.erf(width / math.sqrt(2))
    below = 0.0
    for k in range(projections + 1):
        below += math.comb(projections, k) * p**k * (1 - p) ** (projections - k)
        if below > miss:
            return k
    return projections


def _collisions(a, b, half):
    """Boolean matrix: b[j] lies in the window of +-half centred at a[i]. Windows are found in the sorted order of b."""
    import numpy as np

    order = np.argsort(b, kind="stable")
    line = b[order]
    lo, hi = np.searchsorted(line, a - half, "left"), np.searchsorted(line, a + half, "right")
    place = np.empty(len(b), "int32")
    place[order] = np.arange(len(b), dtype="int32")
    return (place >= lo[:, None].astype("int32")) & (place < hi[:, None].astype("int32"))


def _verified(x, y, threshold: float, same: bool, seed: int):
    """Index pairs (i, j) with cosine >= threshold in double precision; i < j if x and y are one block."""
    import numpy as np

    rng = np.random.default_rng(seed)
    far = math.sqrt(max(0.0, 2 - 2 * threshold))
    half = _WIDTH * far + 1e-9
    lines = rng.standard_normal((x.shape[1], _FIRST + _SECOND))
    px, py = x @ lines, y @ lines
    need1, need = least_count(_FIRST, _WIDTH), least_count(_FIRST + _SECOND, _WIDTH)
    found_i, found_j = [], []
    for s in range(0, len(x), 256):
        n = min(256, len(x) - s)
        count = np.zeros((n, len(y)), "uint8")
        for t in range(_FIRST):
            count += _collisions(px[s : s + n, t], py[:, t], half)
        i, j = np.nonzero(count >= need1)
        seen = count[i, j].astype("int64")
        i += s
        if same:
            keep = i < j
            i, j, seen = i[keep], j[keep], seen[keep]
        for t in range(_FIRST, _FIRST + _SECOND):
            seen += np.abs(px[i, t] - py[j, t]) <= half
            keep = seen + (_FIRST + _SECOND - 1 - t) >= need
            i, j, seen = i[keep], j[keep], seen[keep]
        close = np.einsum("ij,ij->i", x[i], y[j]) >= threshold
        found_i.append(i[close])
        found_j.append(j[close])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.empty(0, int), np.empty(0, int))


def _spanning(n: int, i, j) -> list[tuple[int, int]]:
    """A spanning forest of the links (i, j) on n rows."""
    up, out = list(range(n)), []

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in zip(i.tolist(), j.tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def near_duplicates(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = 0.93, seed: int = 7) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of rows.

    Vectors link if their labels are equal and not null and their cosine in double precision is at least threshold
    (which is over 0). Null, zero or ragged vectors and those with null or non-finite components link with nothing.
    component_id is the smallest vec_id reachable, itself included; kept marks it. Equal vectors of a label meet
    once, as a class with a number of rows; n_links counts all of them. A class with a null vec_id links by its
    other rows; a row with a null vec_id gets its class's component and is not kept. Repeated rows count as rows.

    Classes of a label are dealt into blocks of about _BLOCK; each pair of blocks is a task's work, whatever the
    label's size. Tasks return link counts and a spanning forest of what they find, not pairs.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0, at most 1")
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    src = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), v.alias("v"))
    fine = "label is not null and v is not null and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('inf')) and exists(v, c -> c <> 0)"
    src = written(src.withColumn("key", F.when(F.expr(fine), F.sha2(F.to_json(F.struct("label", F.transform("v", lambda c: c + F.lit(0.0)).alias("v"))), 256))), "vectors")
    classes = src.filter("key is not null").groupBy("key").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("rep"))
    classes = written(classes.filter("rep is not null"), "classes")
    sizes = classes.groupBy("label", F.size("v").alias("dims")).agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    placed = classes.withColumn("dims", F.size("v")).join(sizes, ["label", "dims"]).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("label", "dims", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") == F.least("own", "other")).alias("left"), "rep", "n", "v")

    def compare(table):
        import numpy as np
        import pyarrow as pa

        rep, n, left = (table[c].to_numpy() for c in ("rep", "n", "left"))
        x = table["v"].combine_chunks().flatten().to_numpy().reshape(len(rep), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        same = table["a"][0] == table["b"][0]
        one, two = (np.arange(len(rep)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        i, j = _verified(x[one], x[two], threshold, same, seed)
        i, j = one[i], two[j]
        links = np.bincount(i, n[j], len(rep)) + np.bincount(j, n[i], len(rep))
        tree = _spanning(len(rep), i, j)
        hit = np.flatnonzero(links)
        a = np.concatenate([rep[hit], rep[[p for p, _ in tree]].astype("int64")])
        b = [None] * len(hit) + rep[[q for _, q in tree]].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array([*links[hit].astype("int64").tolist(), *[0] * len(tree)], pa.int64())})

    found = written(met.groupBy("label", "dims", "a", "b").applyInArrow(compare, "a long, b long, links long"), "found")
    parts = connected_components(found.filter("b is not null"), "a", "b")
    counts = found.filter("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    told = classes.join(counts, classes.rep == counts.a, "left").join(parts, classes.rep == parts.node, "left")
    told = told.select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    out = src.join(told, "key", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
