"""Best-fit packing of token pieces into fixed sequences, by hierarchical residual packing."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, functions as F

from .common import lean, written
from .tokens import encoder

_MEMBER = "struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>"
_BINS = f"node bigint, done boolean, sequence_id bigint, fill int, members array<{_MEMBER}>"
#: Pieces that a task holds before it packs them, and underfull bins of a node of the tree beyond which several tasks share them.
_HELD = 1 << 16


def best_fit(sizes, capacity: int) -> list[list[int]]:
    """Bins of item indexes, by best fit in order of falling size (ties by index).

    Free space is a whole number up to capacity, so open bins sit in a list for each and the tightest one
    with room is the lowest set bit of a mask.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    bins: list[list[int]] = []
    open_by: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in order:
        n = sizes[i]
        fits = mask >> n
        if n and fits:
            free = n + (fits & -fits).bit_length() - 1
            k = open_by[free].pop()
            if not open_by[free]:
                mask &= ~(1 << free)
            bins[k].append(i)
        else:
            free, k = capacity, len(bins)
            bins.append([i])
        free -= n
        if free:
            open_by[free].append(k)
            mask |= 1 << free
    return bins


def pieces_of(n_ids: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only documents over the capacity are cut, the first piece takes the rest."""
    if n_ids <= capacity:
        return [(0, n_ids)]
    first = n_ids % capacity
    return [(0, first)] * bool(first) + [(s, capacity) for s in range(first, n_ids, capacity)]


def _merged(parts: list[list[dict]]) -> list[dict]:
    out, at = [], 0
    for members in parts:
        out += [m | {"offset": m["offset"] + at} for m in members]
        at += sum(m["length"] for m in members)
    return out


def pack_documents(docs: DataFrame, vocab_path: str, *, doc_id: str = "doc_id", text: str = "text", style: str = "bytes",
                   end_id: int = 2, capacity: int = 1024, nearly_full: float = 0.99, fan_in: int = 8) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, fill (of its sequence).

    Each task encodes its whole documents and packs their pieces by best fit; bins at least nearly_full are
    final, the others all go up a tree of fan_in, in which each node packs its underfull bins as items again, or their
    pieces where that leaves fewer bins. A node with many deals them by hash to several tasks; the root then deals what
    these leave anew, until one task has it all or a round saves less than a bin a task.
    Only piece descriptions move between tasks, never texts or ids. Null text counts as empty (one piece with
    the end id); a null doc_id stays null; repeated rows are packed as often as they occur; no rows, no pieces.
    """
    full = max(1, int(capacity * nearly_full))
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def local(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part = encoder(vocab_path, style), TaskContext.get().partitionId()
        number = part << 32

        def rows(bins):
            nonlocal number
            out = {k: [] for k in ("node", "done", "sequence_id", "fill", "members")}
            for members, fill in bins:
                out["node"].append(part)
                out["done"].append(fill >= full)
                out["sequence_id"].append(number)
                out["fill"].append(fill)
                out["members"].append(members)
                number += 1
            return pa.RecordBatch.from_pydict(out, schema=_arrow_schema())

        held: list[dict] = []

        def packed(held):
            return [(_merged([[held[i]] for i in b]), sum(held[i]["length"] for i in b)) for b in best_fit([m["length"] for m in held], capacity)]

        for batch in batches:
            whole = []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(body.as_py() or ""), np.array([end_id], "<u4")).astype("<u4")
                for k, (start, length) in enumerate(pieces_of(len(ids), capacity)):
                    m = {"doc_id": key, "piece": k, "start": start, "length": length, "ids_crc32": zlib.crc32(ids[start : start + length].tobytes()), "offset": 0}
                    if length == capacity:
                        whole.append(([m], length))
                    else:
                        held.append(m)
            if whole:
                yield rows(whole)
            if len(held) >= _HELD:
                yield rows(packed(held))
                held = []
        if held:
            yield rows(packed(held))

    def node(table):
        import pyarrow as pa

        got = sorted(table.to_pylist(), key=lambda r: (-r["fill"], r["sequence_id"]))
        out = {k: [] for k in ("node", "done", "sequence_id", "fill", "members")}
        whole = [[r["members"] for r in (got[i] for i in b)] for b in best_fit([r["fill"] for r in got], capacity)]
        pieces = [m | {"offset": 0} for r in got for m in r["members"]]
        apart = best_fit([m["length"] for m in pieces], capacity)
        # Bins are items; where taking them apart leaves fewer bins, their pieces are.
        packed = whole if len(whole) <= len(apart) else [[[pieces[i]] for i in b] for b in apart]
        numbers = sorted(r["sequence_id"] for r in got)
        made = [(sum(m["length"] for part in parts for m in part), number, _merged(parts)) for number, parts in zip(numbers, packed)]
        for fill, number, members in made:
            out["node"].append(got[0]["node"])
            out["done"].append(fill >= full)
            out["sequence_id"].append(number)
            out["fill"].append(fill)
            out["members"].append(members)
        return pa.Table.from_pydict(out, schema=_arrow_schema())

    def repacked(left, salt):
        """The bins (node, ...) packed again, and whether the last node's were shared by tasks."""
        many = {r.node: -(-r["count"] // _HELD) for r in left.groupBy("node").count().filter(F.col("count") > _HELD).collect()}
        share = F.lit(0).cast("long")
        if many:
            tasks = F.create_map(*(F.lit(x).cast("long") for pair in many.items() for x in pair))[F.col("node")]
            share = F.coalesce(F.pmod(F.xxhash64(F.lit(salt), "sequence_id"), tasks), share)
        return written(left.withColumn("share", share).groupBy("node", "share").applyInArrow(node, _BINS), "bins"), 0 in many

    bins = written(src.mapInArrow(lean(local), _BINS), "bins")
    finals = [bins.filter("done")]
    left = bins.filter("not done")
    last = bins.agg(F.max("node")).first()[0] or 0
    shared = False
    while last > 0 or len(finals) == 1:
        last //= fan_in
        bins, shared = repacked(left.withColumn("node", F.expr(f"node div {fan_in}")), len(finals))
        finals.append(bins.filter("done"))
        left = bins.filter("not done")
    while shared:
        n = left.count()
        bins, shared = repacked(left, len(finals))
        saved = n - bins.count()
        finals.append(bins.filter("done"))
        left = bins.filter("not done")
        if saved < -(-n // _HELD):
            break
    out = left
    for x in finals:
        out = out.unionByName(x)
    m = F.col("m")
    return out.select("sequence_id", F.col("fill").cast("long").alias("fill"), F.explode("members").alias("m")).select(
        *(m[k].alias(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")), "sequence_id", m["offset"].alias("offset"), "fill"
    )


def _arrow_schema():
    import pyarrow as pa

    member = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
    return pa.schema([("node", pa.int64()), ("done", pa.bool_()), ("sequence_id", pa.int64()), ("fill", pa.int32()), ("members", pa.list_(member))])
