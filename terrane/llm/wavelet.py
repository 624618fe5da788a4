"""Token ids in wavelet-matrix shards: one compressed file answers access, count and occurrence queries.

A file holds the bit-planes of its ids from the highest bit down; each plane is followed by a stable split into
zeros and ones, so a symbol's rows stay together and rank/select steps through the planes find them. Layout:

    "WMX1", u32 length of the head, head (JSON), document table (Arrow IPC), planes

Each plane is cut into chunks of 2**18 bits, packed and compressed on their own by zstandard; the head has for each
plane its number of zeros, the byte place of each chunk and the ones before it, so a query reads a few chunks only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_path, lean, open_store, shared_dir, write_bytes, written
from .tokens import encoder

_CHUNK = 1 << 18
_MAGIC = b"WMX1"
#: Ids in a shard before the next one is begun; a longer document still goes whole into one shard.
_SHARD = 1 << 22
#: Ids that a reading task gets at least, on average, where there are many small shards.
_READ = 1 << 20


def build(ids, keys, lengths) -> list[bytes]:
    """The parts of a file over ids (numpy uint32) of documents with these keys and lengths, in this order."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    sink = pa.BufferOutputStream()
    table = pa.table({"doc_id": pa.array(keys, pa.int64()), "n_tokens": pa.array(lengths, pa.int64())})
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    docs = pack(sink.getvalue().to_pybytes())
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    row = ids.astype("<u2" if bits <= 16 else "<u4")
    planes, body, at = [], [], 0
    for b in range(bits - 1, -1, -1):
        ones = (row & row.dtype.type(1 << b)) != 0
        packed = np.packbits(ones, bitorder="little").tobytes()
        places, before, seen = [], [], 0
        for s in range(0, len(row), _CHUNK):
            places.append(at)
            before.append(seen)
            seen += int(np.count_nonzero(ones[s : s + _CHUNK]))
            body.append(pack(packed[s // 8 : (s + _CHUNK) // 8]))
            at += len(body[-1])
        places.append(at)
        planes.append({"zeros": len(row) - seen, "places": places, "ones_before": before})
        if b:
            up = pa.BooleanArray.from_buffers(pa.bool_(), len(row), [None, pa.py_buffer(packed)])
            row = np.concatenate([pc.filter(pa.array(row), keep).to_numpy() for keep in (pc.invert(up), up)])
    head = json.dumps({"n": len(ids), "bits": bits, "chunk": _CHUNK, "docs": len(docs), "planes": planes}, separators=(",", ":")).encode()
    return [_MAGIC, len(head).to_bytes(4, "little"), head, docs, *body]


class WaveletFile:
    """Queries over one file; chunks are read and decompressed as they are asked for."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        if self.file.read(4) != _MAGIC:
            raise ValueError(f"not a wavelet-matrix file: {uri}")
        size = int.from_bytes(self.file.read(4), "little")
        self.head = json.loads(self.file.read(size))
        self.n, self.bits, self.chunk = self.head["n"], self.head["bits"], self.head["chunk"]
        self.docs_at = 8 + size
        self.base = self.docs_at + self.head["docs"]
        self.held: dict[tuple[int, int], object] = {}

    def documents(self):
        """Arrow table (doc_id, n_tokens) in stored order."""
        import pyarrow as pa
        import zstandard

        self.file.seek(self.docs_at)
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(self.file.read(self.head["docs"]))).read_all()

    def _chunk(self, plane: int, k: int):
        """(bits, ones before each bit within the chunk)"""
        import numpy as np
        import zstandard

        if (plane, k) not in self.held:
            places = self.head["planes"][plane]["places"]
            self.file.seek(self.base + places[k])
            raw = zstandard.ZstdDecompressor().decompress(self.file.read(places[k + 1] - places[k]))
            count = min(self.chunk, self.n - k * self.chunk)
            bits = np.unpackbits(np.frombuffer(raw, "u1"), count=count, bitorder="little")
            if len(self.held) > 64:
                self.held.clear()
            self.held[plane, k] = bits, np.concatenate([[0], np.cumsum(bits, dtype="int64")])
        return self.held[plane, k]

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        if i >= self.n:
            return self.n - self.head["planes"][plane]["zeros"]
        k, r = divmod(i, self.chunk)
        return self.head["planes"][plane]["ones_before"][k] + int(self._chunk(plane, k)[1][r])

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.bits):
            bit = int(self._chunk(p, i // self.chunk)[0][i % self.chunk])
            ones = self._ones(p, i)
            i = self.head["planes"][p]["zeros"] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        if symbol >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._ones(p, lo), self._ones(p, hi)
            if symbol >> (self.bits - 1 - p) & 1:
                zeros = self.head["planes"][p]["zeros"]
                lo, hi = zeros + a, zeros + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of an id in places lo to hi (all places if not given)."""
        lo, hi = self._range(symbol, lo, self.n if hi is None else hi)
        return hi - lo

    def _select_bit(self, plane: int, bit: int, rank: int) -> int:
        import numpy as np

        before = self.head["planes"][plane]["ones_before"]
        lo, hi = 0, len(before) - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            seen = before[mid] if bit else mid * self.chunk - before[mid]
            lo, hi = (mid, hi) if seen <= rank else (lo, mid - 1)
        bits, _ = self._chunk(plane, lo)
        seen = before[lo] if bit else lo * self.chunk - before[lo]
        return lo * self.chunk + int(np.flatnonzero(bits == bit)[rank - seen])

    def select(self, symbol: int, k: int) -> int:
        """Place of the k-th occurrence (from 0) of an id."""
        lo, hi = self._range(symbol, 0, self.n)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - p) & 1
            i = self._select_bit(p, bit, i - self.head["planes"][p]["zeros"] * bit)
        return i

    def occurrences(self, symbol: int) -> list[int]:
        """All places of an id, rising."""
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def ids(self):
        """All ids in order, by undoing the split of each plane from the last one up."""
        import numpy as np
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        out = np.zeros(self.n, "<u2" if self.bits <= 16 else "<u4")
        for p in range(self.bits - 1, -1, -1):
            places = self.head["planes"][p]["places"]
            self.file.seek(self.base + places[0])
            raw = self.file.read(places[-1] - places[0])
            bits = b"".join(expand(raw[a - places[0] : b - places[0]]) for a, b in zip(places, places[1:]))
            ones = np.unpackbits(np.frombuffer(bits, "u1"), count=self.n, bitorder="little").view(bool)
            zeros, up = self.head["planes"][p]["zeros"], np.empty_like(out)
            up[~ones] = out[:zeros]
            up[ones] = out[zeros:] | out.dtype.type(1 << (self.bits - 1 - p))
            out = up
        return out.astype("<u4")


def write_token_shards(docs: DataFrame, vocab_path: str, *, doc_id: str = "doc_id", text: str = "text", style: str = "words",
                       end_id: int = 1, folder: str | None = None) -> DataFrame:
    """Encode whole documents in rising doc_id order into wavelet-matrix files; one row per file.

    Columns: shard (long, in doc_id order), path, n_docs, n_tokens, first_token (ids in the shards before).
    Rows are dealt by ranges of doc_id, so files of a task follow one another and tasks do too; file names are
    unique and the returned table names those of the attempts that counted. Null text: only the end id. A null
    doc_id comes first. Repeated rows are stored as often as they occur. No rows, no files.

    The table of shards is numbered by one task, which also writes it: a part of it from every task would be a file of
    a few hundred bytes each, and for each file and folder on a local store the executor's JVM starts `chmod`, which
    counts with all memory of the JVM until it runs.
    """
    spark = docs.sparkSession
    folder = folder or fresh_path(spark, "tokens")
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    src = src.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(batches):
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, part = encoder(vocab_path, style), TaskContext.get().partitionId()
        held, keys, lengths, n, number = [], [], [], 0, 0
        schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

        def flush():
            nonlocal held, keys, lengths, n, number
            path = f"{folder}/{part:06d}-{number:06d}-{uuid.uuid4().hex}.wmx"
            write_bytes(path, build(np.concatenate(held), keys, lengths))
            row = pa.RecordBatch.from_pydict({"part": [part], "number": [number], "path": [path], "n_docs": [len(keys)], "n_tokens": [n]}, schema=schema)
            held, keys, lengths, n, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for key, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(body.as_py() or ""), np.array([end_id], "<u4")).astype("<u4")
                if n and n + len(ids) > _SHARD:
                    yield flush()
                held.append(ids)
                keys.append(key)
                lengths.append(len(ids))
                n += len(ids)
        if keys:
            yield flush()

    files = src.mapInArrow(lean(write), "part long, number long, path string, n_docs long, n_tokens long")
    order = Window.orderBy("part", "number")
    before = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(files.select((F.row_number().over(order) - 1).cast("long").alias("shard"), "path", "n_docs", "n_tokens", before.cast("long").alias("first_token")), "shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """One row per stored document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""

    def read(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                file = WaveletFile(r["path"])
                docs, ids = file.documents(), file.ids()
                lengths = docs["n_tokens"].to_numpy()
                ends = np.cumsum(lengths)
                starts = ends - lengths
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [docs["doc_id"].combine_chunks(), pa.array(starts + r["first_token"], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64()), pa.array([r["shard"]] * len(crc), pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"],
                )

    spark = shards.sparkSession
    shared_dir(spark)
    ids = shards.agg(F.sum("n_tokens")).first()[0] or 0
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ids // _READ)))
    return shards.repartition(n).mapInArrow(lean(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard long")
