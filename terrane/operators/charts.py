"""Local charts: principal components of each vertex's neighbourhood."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SCHEMA = "v long, members array<long>, dim int, ratio double, singular array<double>, basis array<array<double>>, coordinates array<array<double>>"


def local_charts(rows: DataFrame, near: DataFrame, dim: int = 0, share: float = 0.95, centre: str = "mean", *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One chart per vertex from its closed neighbourhood in near (src, dst, len).

    Neighbourhoods are centred at their mean or at the vertex itself (`anchor`); `dim` components are kept, or, for 0,
    as many as hold `share` of the squared singular values. basis has a vector for each component, whose largest entry in
    size is positive; coordinates are those of members (in order of id) from the vertex. A chart's rows are the
    neighbours that the graph was built with, so they are bounded; charts are computed a batch at a time.
    """
    if centre not in ("mean", "anchor"):
        raise ValueError(f"no such centre: {centre}")
    from ..sources.graphs import closed

    vec = rows.select(F.col(vec_id).cast("long").alias("x"), F.transform(vector, lambda c: c.cast("double")).alias("e"))
    local = closed(near).join(vec, "x").groupBy("v").agg(F.sort_array(F.collect_list(F.struct("x", "e"))).alias("local"))
    local = local.select("v", F.col("local.x").alias("members"), F.col("local.e").alias("e"))

    def charts(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for v, members, e in zip(*(batch[c].to_pylist() for c in ("v", "members", "e"))):
                x = np.array(e)
                anchor = x[members.index(v)]
                _, s, basis = np.linalg.svd(x - (anchor if centre == "anchor" else x.mean(axis=0)), full_matrices=False)
                mass = s * s
                total = mass.sum()
                if dim:
                    m = min(dim, len(s))
                else:
                    m = int(np.argmax(np.cumsum(mass) >= share * total * (1 - 1e-12))) + 1 if total > 0 else 1
                basis = basis[:m]
                basis = basis * np.where(basis[np.arange(m), np.abs(basis).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
                out.append({"v": v, "members": members, "dim": m, "ratio": float(mass[:m].sum() / total) if total > 0 else 1.0, "singular": s.tolist(), "basis": basis.tolist(), "coordinates": ((x - anchor) @ basis.T).tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema(_fields(pa)))

    return local.mapInArrow(charts, SCHEMA)


def _fields(pa):
    doubles = pa.list_(pa.float64())
    return [("v", pa.int64()), ("members", pa.list_(pa.int64())), ("dim", pa.int32()), ("ratio", pa.float64()), ("singular", doubles), ("basis", pa.list_(doubles)), ("coordinates", pa.list_(doubles))]
