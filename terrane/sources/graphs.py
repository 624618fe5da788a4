"""Graphs and fields from tables: nearest neighbours, paths, co-occurrence, stars, grids, and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..graph import Graph, from_edges

#: Rows of a block at most; a task compares two blocks, so its memory does not grow with the table.
_BLOCK = 16384
#: Rows that a matrix product compares with a block at once, and pairs of rows whose distances are summed at once.
_STRIP, _PAIRS = 128, 1 << 14


def _nearest(x, v, y, w, k):
    """(places in x, w, distances) of the k rows of y (ids w) nearest to each row of x (ids v) by (distance, id), without itself.

    A matrix product tells which rows may be among them, up to a bound of its rounding error, in single precision where that
    leaves few; their distances are summed from differences in double precision.
    """
    import numpy as np

    xx, yy, dims = (x * x).sum(axis=1), (y * y).sum(axis=1), x.shape[1]
    single = bool(max(xx.max(initial=0.0), yy.max(initial=0.0)) < 1e30) and len(y) > 64 * k
    own = len(np.intersect1d(v, w)) > 0
    held, runs = {}, len(y) // 32

    def candidates(at, upto, kind):
        if kind not in held:
            held[kind] = np.column_stack([y, yy]).astype(kind).T, np.empty((_STRIP, len(y)), kind)
        told, near = held[kind]
        ask = np.column_stack([-2.0 * x[at:upto], np.ones(upto - at)]).astype(kind)
        near = np.matmul(ask, told, out=near[: upto - at])
        if own:
            near[v[at:upto, None] == w] = np.inf
        # The k-th least of the least of each 32 is no less than the k-th least of all.
        least = near[:, : 32 * runs].reshape(len(near), 32, runs).min(axis=1) if runs > 2 * k else near
        limit = np.partition(least, k - 1, axis=1)[:, k - 1] if k < len(y) else np.full(upto - at, np.inf)
        # A sum of yy and -2 x y is off by no more than (dims + 8) eps (xx + yy), and two of them are compared.
        slack = (dims + 8) * (4 * np.finfo(kind).eps * (xx[at:upto] + yy.max(initial=0.0)) + 16 * np.finfo(kind).tiny)
        limit = np.nextafter((limit + slack).astype(kind), np.array(np.inf, kind))
        # What cannot be compared, as not finite, stays.
        return ~(near > limit[:, None])

    out = [(np.empty(0, "int64"), np.empty(0, w.dtype), np.empty(0))]
    for at in range(0, len(x), _STRIP):
        upto = min(len(x), at + _STRIP)
        may = candidates(at, upto, np.float32) if single else None
        if may is None or np.count_nonzero(may) > 4 * k * len(may):
            may = candidates(at, upto, np.float64)
        i, j = np.divmod(np.flatnonzero(may), len(y)) if len(y) else np.nonzero(may)
        i += at
        keep = v[i] != w[j]
        i, j = i[keep], j[keep]
        d = np.concatenate([np.empty(0), *(np.sqrt(((y[j[s : s + _PAIRS]] - x[i[s : s + _PAIRS]]) ** 2).sum(axis=1)) for s in range(0, len(i), _PAIRS))])
        order = np.lexsort((w[j], d, i))
        i, j, d = i[order], j[order], d[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((i[best], w[j[best]], d[best]))
    return [np.concatenate(c) for c in zip(*out)]


def _told(x, v, k):
    """Places of the rows that can be among the k nearest of any: of equal rows those with the k + 1 least ids."""
    import numpy as np

    if not x.shape[1] or len(np.unique(v)) < len(v):
        return np.arange(len(v))
    same = np.unique(np.ascontiguousarray(x).view(f"V{x.itemsize * x.shape[1]}").ravel(), return_inverse=True)[1]
    order = np.lexsort((v, same))
    return np.sort(order[np.arange(len(v)) - np.searchsorted(same[order], same[order]) <= k])


def neighbours(rows: DataFrame, k: int, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(src, dst, len): the k nearest other rows of each by (Euclidean distance, id), exactly.

    Rows are dealt into blocks; each pair of blocks meets once and yields the k best of its own for the rows of both, and a
    window keeps the best of these.
    """
    src = rows.select(F.col(vec_id).cast("long").alias("v"), F.col(vector).alias("e"))
    n = src.count()
    blocks = max(1, -(-n // _BLOCK), min(8, -(-n // 1024)))
    own, other = F.pmod(F.xxhash64("v"), F.lit(blocks)).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    met = src.select("v", "e", own, other).select("v", "e", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def nearest(table):
        import numpy as np
        import pyarrow as pa

        v, own, a, b = table["v"].to_numpy(), table["own"].to_numpy(), table["a"][0].as_py(), table["b"][0].as_py()
        x = table["e"].combine_chunks().flatten().to_numpy().reshape(len(v), -1).astype(np.float64)
        p, q = np.flatnonzero(own == a), np.flatnonzero(own == b)
        cat = []
        for asks, told in ((p, q), (q, p))[: 1 + (a != b)]:
            told = told[_told(x[told], v[told], k)]
            i, dst, d = _nearest(x[asks], v[asks], x[told], v[told], k)
            cat.append((v[asks][i], dst, d))
        src, dst, d = (np.concatenate(c) for c in zip(*cat))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64()), "len": pa.array(d, pa.float64())})

    # A number of partitions that is named stays, so few pairs of blocks meet in a task.
    met = met.repartition(min(blocks * (blocks + 1) // 2, 4096), "a", "b")
    found = met.groupBy("a", "b").applyInArrow(nearest, "src long, dst long, len double")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("len", "dst"))
    return found.withColumn("rn", rank).filter(F.col("rn") <= k).drop("rn")


def knn_graph(rows: DataFrame, k: int = 8, *, vec_id: str = "vec_id", vector: str = "embedding") -> Graph:
    """The symmetric graph of the k nearest neighbours; lengths are distances."""
    return from_edges(neighbours(rows, k, vec_id=vec_id, vector=vector).selectExpr("src as a", "dst as b", "len"), rows.select(F.col(vec_id).cast("long").alias("v")))


def closed(near: DataFrame) -> DataFrame:
    """(v, x, d): the neighbourhoods of a table of neighbours (src, dst, len), each with its own vertex at distance 0."""
    own = near.select("src").distinct().selectExpr("src as v", "src as x", "0D as d")
    return near.selectExpr("src as v", "dst as x", "len as d").union(own)


def mutual_edges(near: DataFrame) -> DataFrame:
    """(a, b, len) with a < b: pairs of which each is among the neighbours (src, dst, len) of the other."""
    back = near.selectExpr("dst as src", "src as dst")
    return near.filter("src < dst").join(back, ["src", "dst"], "left_semi").selectExpr("src as a", "dst as b", "len")


def shared_edges(near: DataFrame) -> DataFrame:
    """(a, b, len, common) with a < b: pairs whose closed neighbourhoods meet, the shortest way through a vertex of both, and
    the number of such vertices. Every pair that shares a vertex is an edge, so a vertex that is near to many makes many.
    """
    c = closed(near)
    pairs = c.selectExpr("v as a", "x", "d as da").join(c.selectExpr("v as b", "x", "d as db"), "x").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.min(F.col("da") + F.col("db")).alias("len"), F.count("*").alias("common"))


def component_field(rows: DataFrame, position: int, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A vector component (from 0) as a field."""
    return rows.select(F.col(vec_id).cast("long").alias("v"), F.col(vector)[position].cast("double").alias("y"))


def path_graph(rows: DataFrame, v: str, group: str, order: list[str], length=None) -> Graph:
    """Rows of a group in order, each joined to the next; `length` is a Column over (row, next as `__next`), else 1."""
    by = Window.partitionBy(group).orderBy(*order)
    nxt = rows.withColumn("__next", F.lead(F.struct(*rows.columns)).over(by)).filter("__next is not null")
    edges = nxt.select(F.col(v).cast("long").alias("a"), F.col(f"__next.{v}").cast("long").alias("b"), (F.lit(1.0) if length is None else length).cast("double").alias("len"))
    return from_edges(edges, rows.select(F.col(v).cast("long").alias("v")))


def bipartite_graph(rows: DataFrame, left: str, right: str, shift: int) -> Graph:
    """Pairs that occur together, with length 1 / count; ids of the right side are moved by `shift`."""
    pairs = rows.groupBy(F.col(left).cast("long").alias("a"), (F.col(right).cast("long") + shift).alias("b")).agg((F.lit(1.0) / F.count("*")).alias("len"))
    return from_edges(pairs)


def grid_graph(spark, n: int) -> Graph:
    """An n x n grid with four neighbours; vertex (i - 1) * n + j for i, j from 1."""
    p = spark.range(1, n + 1).selectExpr("id as i").crossJoin(spark.range(1, n + 1).selectExpr("id as j"))
    v = p.selectExpr("i", "j", f"(i - 1) * {n} + j as v")
    right = v.filter(f"j < {n}").selectExpr("v as a", "v + 1 as b", "1D as len")
    return from_edges(right.union(v.filter(f"i < {n}").selectExpr("v", f"v + {n}", "1D")), v.select("v"))


def from_adjacency(spark, neighbours_of: list[list[int]], lengths: list[list[float]], base: int = 1) -> Graph:
    """A graph from ragged neighbour and length lists."""
    rows = [(i + base, int(j), float(w)) for i, (ns, ws) in enumerate(zip(neighbours_of, lengths)) for j, w in zip(ns, ws)]
    vertices = spark.createDataFrame([(i + base,) for i in range(len(neighbours_of))], "v long")
    return Graph(vertices, spark.createDataFrame(rows, "src long, dst long, len double").dropDuplicates(["src", "dst"]))


def read_matrix(spark, path: str, header: bool = False, sep: str = ",") -> DataFrame:
    """A numeric text matrix as (row, c1 .. cp), rows in file order within a file."""
    got = spark.read.csv(path, header=header, inferSchema=False, sep=sep)
    cols = [F.col(f"`{c}`").cast("double").alias(c if header else f"c{i + 1}") for i, c in enumerate(got.columns)]
    return got.select(F.monotonically_increasing_id().alias("row"), *cols)


def read_ragged(spark, path: str) -> DataFrame:
    """(path, row, pos, value) of binary lists of integers: the number of lists, then each list's length and its members, all
    little-endian, counts in 64 bits and members in 32. A file is read by one task, as nothing in it says where lists begin.
    """

    def lists(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch["path"].to_pylist(), batch["content"]):
                data = content.as_buffer()
                n, at = int(np.frombuffer(data, "<u8", 1)[0]), 8
                for row in range(n):
                    size = int(np.frombuffer(data, "<u8", 1, at)[0])
                    values = np.frombuffer(data, "<i4", size, at + 8)
                    at += 8 + 4 * size
                    if size:
                        yield pa.RecordBatch.from_pydict(
                            {"path": pa.array([name] * size), "row": pa.array(np.full(size, row, "int64")), "pos": pa.array(np.arange(size, dtype="int64")), "value": pa.array(values.astype("int64"))}
                        )

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lists, "path string, row long, pos long, value long")


def write_table(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Write a result as parquet or csv; arrays become text in csv."""
    if kind == "csv":
        flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
        df.select(*flat).write.mode(mode).csv(path, header=True)
    else:
        df.write.mode(mode).format(kind).save(path)
