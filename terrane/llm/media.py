"""Media columns: payloads in content-addressed tar shards, rows with digest, offset and length."""

from __future__ import annotations

import hashlib
import zlib

from pyspark.sql import DataFrame, functions as F

from .common import fresh_path, open_store, written

#: Bytes of a tar shard before the next is begun; members, and bytes, of a lot, which is read by one task.
_SHARD, _LOT_ROWS, _LOT_BYTES = 1 << 26, 64, 1 << 21
#: Hash classes of digests, as a power of two, that the bitmap of repeated ones tells apart.
_CLASSES = 26
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples in a row of an image, and bytes of a PNG file up to the end of its IHDR chunk.
_WIDTH, _HEAD = 64, 33


def _chunk(kind: bytes, data: bytes) -> bytes:
    return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")


def to_image(payload: bytes) -> bytes:
    """An 8-bit grey PNG whose samples, 64 to a row, are the payload's bytes."""
    import numpy as np

    rows = np.zeros((len(payload) // _WIDTH, _WIDTH + 1), "u1")
    rows[:, 1:] = np.frombuffer(payload, "u1").reshape(-1, _WIDTH)
    head = _WIDTH.to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def image_head(head: bytes) -> dict:
    """Width, height, depth and colour type from the first 33 bytes of a PNG file."""
    if head[:8] != _SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG file")
    return {"width": int.from_bytes(head[16:20], "big"), "height": int.from_bytes(head[20:24], "big"), "depth": head[24], "colour": head[25]}


def samples(image: bytes) -> bytes:
    """The samples of an image of to_image()."""
    import numpy as np

    meta, at, data = image_head(image), 8, []
    while at < len(image):
        n, kind = int.from_bytes(image[at : at + 4], "big"), image[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), "u1").reshape(meta["height"], meta["width"] + 1)
    return rows[:, 1:].tobytes()


def feature_of(payload: bytes) -> str:
    """Mean and deviation of the samples, mean step between neighbours, and entropy in bits, to four places."""
    import numpy as np

    x = np.frombuffer(payload, "u1")
    share = np.bincount(x, minlength=256) / len(x)
    share = share[share > 0]
    step = np.abs(np.diff(x.astype("int16"))).mean() if len(x) > 1 else 0.0
    return f"mean={x.mean():.4f};sd={x.std():.4f};step={step:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f}"


def tar_head(name: str, size: int) -> bytes:
    """A ustar header block with fixed times and owners, so equal members give equal bytes."""
    block = bytearray(512)
    for at, data in ((0, name.encode()), (100, b"0000644"), (108, b"0000000"), (116, b"0000000"), (124, b"%011o" % size), (136, b"%011o" % 0), (148, b" " * 8), (156, b"0"), (257, b"ustar\x0000")):
        block[at : at + len(data)] = data
    block[148:156] = b"%06o\x00 " % sum(block)
    return bytes(block)


def with_payload(rows: DataFrame, text: str, to: str = "payload") -> DataFrame:
    """Add the UTF-8 bytes of a text, padded by zeros to a positive multiple of 64 (null text: empty)."""
    raw = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    rows = rows.withColumn(to, raw)
    room = F.greatest(F.lit(1), F.ceil(F.octet_length(to) / _WIDTH)).cast("int") * _WIDTH
    return rows.withColumn(to, F.rpad(F.col(to), room, F.lit(b"\0")))


class _Tar:
    """Appends images to tar shards of a folder and tells where each one is: path, lot (runs of members, counted from 0),
    offset and length."""

    def __init__(self, folder: str):
        self.folder, self.out, self.path, self.size = folder, None, None, 0
        self.lot, self.rows, self.begun = 0, 0, 0

    def add(self, key: str, image: bytes) -> tuple[str, int, int, int]:
        import uuid

        if self.out is None:
            self.path, self.size = f"{self.folder}/{uuid.uuid4().hex}.tar", 0
            self.lot, self.rows, self.begun = 0, 0, 0
            store, local = open_store(self.path)
            store.create_dir(local.rsplit("/", 1)[0], recursive=True)
            self.out = store.open_output_stream(local, compression=None)
        for part in (tar_head(f"{key}.png", len(image)), image, bytes(-len(image) % 512)):
            self.out.write(part)
        if self.rows and (self.rows == _LOT_ROWS or self.size + len(image) - self.begun > _LOT_BYTES):
            self.lot, self.rows, self.begun = self.lot + 1, 0, self.size
        self.rows += 1
        where = self.path, self.lot, self.size + 512, len(image)
        self.size += 512 + len(image) + -len(image) % 512
        if self.size >= _SHARD:
            self.close()
        return where

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(1024))
            self.out.close()
            self.out = None


def _repeated(digests: DataFrame) -> dict[int, bytes]:
    """Bitmaps over hash classes of the digests (as bytes) that occur more than once: at most 2**_CLASSES bits, whatever the input."""
    twice = digests.groupBy("digest").count().filter("count > 1")
    place = twice.select(F.expr(f"cast(conv(hex(substring(digest, 1, 4)), 16, 10) as bigint) >> {32 - _CLASSES}").alias("c"))
    maps = place.groupBy(F.expr("c >> 15").alias("b")).agg(F.expr("bitmap_construct_agg(c & 32767)").alias("m"))
    return {r["b"]: bytes(r["m"]) for r in maps.collect()}


def store_media(payloads: DataFrame, *, payload: str = "payload", digests: DataFrame | None = None, folder: str | None = None) -> DataFrame:
    """Write each distinct payload once as an image in tar shards; one row per distinct payload.

    Columns: digest (SHA-256 of the payload, lower-case hex, also the member's name), path, lot (number of a run of at most
    _LOT_ROWS members of the shard), offset and length (of the image in its shard). The digests are counted first (pass them as `digests`, bytes, if they are at hand); the hash
    classes of those that repeat make a bitmap of at most 8 MB. A payload outside these classes is alone, and the task
    that reads it writes it. The others are sent to the task that gathers their digest, compressed, and by
    each task once at most, however many rows share them. Empty input: no rows.
    """
    spark = payloads.sparkSession
    folder = folder or fresh_path(spark, "media")
    if digests is None:
        digests = payloads.select(F.unhex(F.sha2(payload, 256)).alias("digest"))
    repeated = _repeated(digests)
    kind = "digest string, path string, lot int, offset long, length long"

    def encode(batches):
        import pyarrow as pa

        schema = pa.schema([("digest", pa.string()), ("path", pa.string()), ("lot", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()), ("image", pa.binary())])
        seen, tar = set(), _Tar(folder)
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                rows = []
                for body in batch.column(0).slice(s, 256):
                    data = body.as_py()
                    key = hashlib.sha256(data).hexdigest()
                    c = int(key[:8], 16) >> (32 - _CLASSES)
                    bits = repeated.get(c >> 15)
                    if bits is None or not bits[(c & 32767) >> 3] >> (c & 7) & 1:
                        rows.append((key, *tar.add(key, to_image(data)), None))
                    elif key not in seen:
                        seen.add(key)
                        rows.append((key, None, None, None, None, to_image(data)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema) if rows else pa.RecordBatch.from_pylist([], schema=schema)
        tar.close()

    def gather(batches):
        import pyarrow as pa

        schema = pa.schema([("digest", pa.string()), ("path", pa.string()), ("lot", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        seen, tar = set(), _Tar(folder)
        for batch in batches:
            rows = []
            for key, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key not in seen:
                    seen.add(key)
                    rows.append(dict(zip(schema.names, (key, *tar.add(key, image.as_py())))))
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
        tar.close()

    first = written(payloads.select(F.col(payload)).mapInArrow(encode, f"{kind}, image binary"), "images")
    rest = first.filter("path is null").select("digest", "image").repartition("digest").mapInArrow(gather, kind)
    return first.filter("path is not null").drop("image").union(written(rest, "media"))


def _by_shard(media: DataFrame) -> DataFrame:
    """Lots of shards in order, so that reads run forward through few files and a task's rows do not depend on how small
    images are."""
    n = max(1, int(media.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return media.repartition(n, "path", "lot").sortWithinPartitions("path", "offset")


class _Shards:
    """Range reads from tar shards, one open at a time."""

    def __init__(self):
        self.at, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.at:
            store, local = open_store(path)
            self.at, self.file = path, store.open_input_file(local)
        return self.file.read_at(length, offset)


def read_heads(media: DataFrame) -> DataFrame:
    """Metadata columns (width, height, depth) by reads of the first 33 bytes of each member; payloads aren't read."""
    names = media.columns

    def read(batches):
        import pyarrow as pa

        shards = _Shards()
        for batch in batches:
            where = zip(*(batch.column(names.index(c)).to_pylist() for c in ("path", "offset")))
            out = [image_head(shards.read(path, offset, _HEAD)) for path, offset in where]
            cols = [pa.array([x[k] for x in out], pa.int32()) for k in ("width", "height", "depth")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*names, "width", "height", "depth"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in media.schema)
    return _by_shard(media).mapInArrow(read, f"{kinds}, width int, height int, depth int")


def read_features(media: DataFrame, *, placed: bool = False) -> DataFrame:
    """Features of each distinct payload, from its stored bytes: payload_bytes, tail_crc32, media_bytes, media_sha256 and
    feature are added to the columns. Bytes that do not have their digest any more are an error. `placed` says that
    the rows are dealt by lots already, as those of read_heads() are."""
    names = media.columns
    more = {"payload_bytes": "long", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}

    def read(batches):
        import pyarrow as pa

        shards = _Shards()
        for batch in batches:
            out = {k: [] for k in more}
            for digest, path, offset, length in zip(*(batch.column(names.index(c)).to_pylist() for c in ("digest", "path", "offset", "length"))):
                image = shards.read(path, offset, length)
                data = samples(image)
                if hashlib.sha256(data).hexdigest() != digest:
                    raise ValueError(f"{path} at {offset}: the payload stored there is not that of digest {digest}")
                for k, x in zip(more, (len(data), zlib.crc32(data[-64:]), len(image), hashlib.sha256(image).hexdigest(), feature_of(data))):
                    out[k].append(x)
            cols = [pa.array(out[k], pa.string() if kind == "string" else pa.int64()) for k, kind in more.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*names, *more])

    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in media.schema), *(f"{k} {kind}" for k, kind in more.items())])
    return (media if placed else _by_shard(media)).mapInArrow(read, kinds)


def media_columns(rows: DataFrame, *, row_id: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """One row per row: row_id, n_bytes (of the text), digest, path, offset, length, width, height, depth, and what
    read_features() tells of the stored payload, with payload_sha256.

    Reads of the stored images' heads alone fill width, height and depth; features are of the payloads read back. Null
    text is empty and is stored as 64 zero bytes, as empty text is; equal texts share one member. A null or repeated
    row_id stays as it is; no rows, no result. A very long text is one image. Texts move only as compressed images, once
    per task that has them; rows are joined by digest alone.
    """
    src = rows.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    slim = with_payload(src.withColumn("n_bytes", F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")), "text")
    # Digests are stored and moved as bytes, half as long as their hex form.
    slim = written(slim.select("row_id", "n_bytes", F.unhex(F.sha2("payload", 256)).alias("digest")), "digests")
    media = store_media(with_payload(src, "text").select("payload"), digests=slim.select("digest"), folder=folder)
    sums = ("digest", "media_sha256")
    got = read_features(read_heads(media), placed=True).drop("lot")
    got = got.select(*(F.unhex(c).alias(c) if c in sums else F.col(c) for c in got.columns))
    out = slim.join(got, "digest").withColumnRenamed("row_id", row_id)
    out = out.select(*(F.lower(F.hex(c)).alias(c) if c in sums else F.col(c) for c in out.columns))
    return out.withColumn("payload_sha256", F.col("digest"))
