"""Eigenvectors of graph Laplacians by restarted block Krylov spaces, and what is derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..checkpoints import cut
from ..graph import Graph

#: Applications of the Laplacian between restarts; a space has (steps + 1) times (vectors + _SPARE) columns.
_STEPS, _SPARE = 12, 3


def laplacian(graph: Graph, weight: Column | None = None, normalized: bool = True) -> DataFrame:
    """(src, dst, x): entries of D - W, or of 1 - D^-1/2 W D^-1/2 over vertices with edges, W being the weights (1 unless given)."""
    w = cut(graph.edges.filter("src <> dst").select("src", "dst", (F.lit(1.0) if weight is None else weight).cast("double").alias("w")))
    degree = w.groupBy(F.col("src").alias("v")).agg(F.sum("w").alias("d"))
    if not normalized:
        return w.selectExpr("src", "dst", "-w as x").union(degree.selectExpr("v", "v", "d"))
    ends = (degree.select(F.col("v").alias(c), F.col("d").alias(f"d_{c}")) for c in ("src", "dst"))
    off = w.join(next(ends), "src").join(next(ends), "dst").filter("d_src > 0 and d_dst > 0")
    return off.selectExpr("src", "dst", "-w / sqrt(d_src * d_dst) as x").union(degree.filter("d > 0").selectExpr("v", "v", "1D"))


def eigenvectors(graph: Graph, n: int, weight: Column | None = None, normalized: bool = True, tolerance: float = 1e-6, most: int = 200, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The n smallest eigenvalues (rank from 0, value) and their vectors (v, rank, x) of unit length.

    A vector's entry of largest size (the first by vertex of equal ones, to nine digits) is positive. A space of Chebyshev
    polynomials of the Laplacian, applied to a block of n + 3 columns, is projected on the driver, where only inner
    products of its columns arrive, until residuals are below tolerance (errors of the values are their squares); RuntimeError after `most` restarts. Vectors stay in
    rows of the table of vertices; each application is one join with the edges.
    """
    import numpy as np

    spark = graph.vertices.sparkSession
    entries = cut(laplacian(graph, weight, normalized))
    top = 2.0 if normalized else 2.0 * (entries.filter("src = dst").agg(F.max("x")).first()[0] or 1.0)
    count = graph.vertices.count()
    n = min(n, count)
    m = min(n + _SPARE, count)
    name = lambda j, i: f"k{j}_{i}"
    draw = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.lit(i), "v"), F.lit(1 << 30)) / float(1 << 30) - 0.5
    block = cut(graph.vertices.select("v", *(draw(i).alias(name(0, i)) for i in range(m))))
    for _ in range(most):
        blocks = [block]
        for j in range(_STEPS):
            here = blocks[j]
            at = here.withColumnRenamed("v", "dst")
            applied = entries.join(at, "dst").groupBy(F.col("src").alias("v")).agg(*(F.sum(F.col("x") * F.col(name(j, i))).alias(f"a{i}") for i in range(m)))
            wide = here.join(applied, "v", "left").na.fill(0.0, [f"a{i}" for i in range(m)])
            shifted = [F.col(f"a{i}") * (2.0 / top) - F.col(name(j, i)) for i in range(m)]
            if j:
                wide = wide.join(blocks[j - 1], "v")
                shifted = [2 * x - F.col(name(j - 1, i)) for i, x in enumerate(shifted)]
            blocks.append(cut(wide.select("v", *(x.alias(name(j + 1, i)) for i, x in enumerate(shifted)))))
        space = blocks[0]
        for more in blocks[1:]:
            space = space.join(more, "v")
        space = cut(space)
        gram = _gram(space.drop("v"), (_STEPS + 1) * m)
        size = _STEPS * m
        # Columns of the space after one more application of the shifted Laplacian, as combinations of its columns.
        step = np.zeros(((_STEPS + 1) * m, size))
        for j in range(_STEPS):
            for i in range(m):
                step[(j + 1) * m + i, j * m + i] = 1.0 if j == 0 else 0.5
                if j:
                    step[(j - 1) * m + i, j * m + i] = 0.5
        scale, axes = np.linalg.eigh(gram[:size, :size])
        use = scale > scale[-1] * 1e-12
        white = axes[:, use] / np.sqrt(scale[use])
        small = white.T @ gram[:size] @ step @ white
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        kept = min(m, len(theta))
        theta, mix = theta[:kept], white @ turn[:, :kept]
        rest = step @ mix - np.vstack([mix * theta, np.zeros((m, kept))])
        residual = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", rest, gram, rest), 0.0)) * top / 2
        if kept < m:
            mix = np.hstack([mix, np.zeros((size, m - kept))])
        block = cut(_combined(space, mix, [name(0, i) for i in range(m)]))
        if kept >= n and residual[:n].max() <= max(tolerance, 1e-8) * top:
            break
    else:
        raise RuntimeError(f"{most} restarts leave residuals up to {residual[:n].max()}")
    values = spark.createDataFrame([(i, float(max(0.0, (theta[i] + 1) * top / 2))) for i in range(n)], "rank int, value double")
    long = cut(block.select("v", F.posexplode(F.array(*(name(0, i) for i in range(n)))).alias("rank", "x")))
    sign = long.groupBy("rank").agg(F.max(F.struct(F.round(F.abs("x"), 9), -F.col("v"), F.signum("x").alias("s"))).alias("m"), F.sqrt(F.sum(F.expr("x * x"))).alias("len"))
    return values, long.join(F.broadcast(sign), "rank").select("v", "rank", (F.col("x") * F.col("m.s") / F.col("len")).alias("x"))


def _gram(rows: DataFrame, size: int):
    """Inner products of all columns: sums of those of batches, one row of `size` squared numbers a partition."""
    import numpy as np

    def partial(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((size, size))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"g": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros((size, size))
    for row in rows.mapInArrow(partial, "g binary").toLocalIterator():
        total += np.frombuffer(row.g).reshape(size, size)
    return total


def _combined(space: DataFrame, mix, names: list[str]) -> DataFrame:
    size = len(mix)

    def combine(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1 : size + 1]])
            y = x @ mix
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(y[:, i]) for i in range(len(names)))], names=["v", *names])

    return space.mapInArrow(combine, "v long, " + ", ".join(f"{c} double" for c in names))


def circular_coordinates(graph: Graph, weight: Column | None = None) -> DataFrame:
    """(v, angle) in [0, 2 pi): the angle of each vertex in the plane of the second and third vector of D - W."""
    x = eigenvectors(graph, 3, weight, normalized=False)[1].filter("rank > 0").groupBy("v").pivot("rank", [1, 2]).agg(F.first("x"))
    return x.select("v", F.pmod(F.atan2("2", "1"), F.lit(2 * 3.141592653589793)).alias("angle"))


def smoothed(vectors: DataFrame, field: DataFrame) -> DataFrame:
    """(v, y): a field projected on eigenvectors (v, rank, x) of unit length, its part of low frequency."""
    part = vectors.join(field, "v").groupBy("rank").agg(F.sum(F.col("x") * F.col("y")).alias("c"))
    return vectors.join(F.broadcast(part), "rank").groupBy("v").agg(F.sum(F.col("x") * F.col("c")).alias("y"))
