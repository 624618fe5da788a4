"""WARC archives: records in gzip members of their own, payloads kept once, and a reader that splits files anywhere."""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame, Window, functions as F

from .common import fresh_path, open_store, write_bytes, written

_GZIP, _HEAD = b"\x1f\x8b\x08", b"WARC/1."
#: Bytes of an archive before the next is begun, of a reader's range, and of a read.
_FILE, _RANGE, _READ = 1 << 26, 1 << 23, 1 << 18


def _clean(value: str) -> str:
    """Header values hold no control characters."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member. A revisit keeps the HTTP head, with the payload's length, and leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    head += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write one record per row and return one row per archive: path, bytes, records.

    Of rows with equal payloads of at least least_bytes bytes the one with the largest page_id is a response and the
    others are revisits of it; rows that repeat this page_id are responses too, and so are rows without a page_id.
    Null html is an empty payload, a null url has no header. Which rows are revisits is settled on
    digests alone; html moves once, dealt by page_id, and archives are written where it arrives. File names are unique,
    and only the archives of attempts that counted are in the result. No rows, no archives.
    """
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "warc")
    body = F.coalesce(F.encode(F.col(html).cast("string"), "UTF-8"), F.lit(b""))
    src = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    slim = src.filter("page_id is not null").select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")).filter(F.col("n") >= least_bytes)
    top = slim.groupBy("digest", "n").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low")).filter("low < top").drop("low")
    roles = slim.join(top, ["digest", "n"]).filter("page_id < top").select("page_id", F.col("digest").alias("role_digest"), F.col("n").alias("role_n"), "top").distinct()
    dealt = src.filter("page_id is not null").withColumn("digest", F.sha1("payload")).join(roles, "page_id", "left")
    # A page_id that repeats with other payloads has its role only for the payload it was settled on.
    mine = (F.col("digest") == F.col("role_digest")) & (F.octet_length("payload") == F.col("role_n"))
    dealt = dealt.withColumn("top", F.when(mine, F.col("top")))
    # Rows without a page_id have no role and stay out of the join, where they would meet in one task.
    alone = src.filter("page_id is null").withColumn("top", F.lit(None).cast("long"))
    dealt = dealt.select("page_id", "url", "payload", "top").union(alone.select("page_id", "url", "payload", "top"))

    def write(batches):
        import uuid

        import pyarrow as pa

        held, size = [], 0

        def flush():
            nonlocal held, size
            path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
            n = write_bytes(path, held)
            row = pa.RecordBatch.from_pydict({"path": [path], "bytes": [n], "records": [len(held)]}, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))
            held, size = [], 0
            return row

        for batch in batches:
            for key, where, payload, top in zip(*(c for c in batch.columns)):
                data = payload.as_py()
                held.append(record(key.as_py(), where.as_py(), data, digest_of(data), top.as_py()))
                size += len(held[-1])
                if size >= _FILE:
                    yield flush()
        if held:
            yield flush()

    return written(dealt.mapInArrow(write, "path string, bytes long, records long"), "archives")


class _Window:
    """A file's bytes by place, read ahead in steps and dropped behind."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, start: int, most: int, least: int = 1) -> bytes:
        """Up to `most` bytes from a place, at least `least` of them unless the file ends before."""
        least = min(least, self.size - start)
        if not self.at <= start <= start + least <= self.at + len(self.data):
            self.at, self.data = start, self.file.read_at(max(least, min(_READ, self.size - start)), start)
        return self.data[start - self.at : start - self.at + most]


def _member(window: _Window, at: int):
    """(bytes, end) of the gzip member at a place, or None if it is not one that holds a WARC record and is followed by
    another member or the end of the file."""
    unpack, out, place, known = zlib.decompressobj(31), bytearray(), at, False
    try:
        while not unpack.eof:
            raw = window.get(place, _READ)
            if not raw:
                return None
            out += unpack.decompress(raw)
            place += len(raw)
            # The read may end anywhere, so there may be too little yet to tell what the member holds.
            if not known and (len(out) >= len(_HEAD) or unpack.eof):
                if not out.startswith(_HEAD):
                    return None
                known = True
    except zlib.error:
        return None
    end = place - len(unpack.unused_data)
    if end < window.size and window.get(end, 3, 3) != _GZIP:
        return None
    return bytes(out), end


def _parsed(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields | {"block": rest[: int(fields.get("content-length", 0))]}


def records_in(uri: str, start: int, end: int):
    """(place, fields with "block") of the records that begin in bytes start to end of a file, as met from start on; then
    (place, None), the place at or beyond the end up to which bytes are used."""
    store, path = open_store(uri)
    with store.open_input_file(path) as file:
        window, at = _Window(file, file.size()), start
        synced = False
        while at < end:
            if not synced:
                part = window.get(at, min(_READ, end - at + 2), 3)
                hit = part.find(_GZIP)
                if hit < 0:
                    at += max(1, len(part) - 2)
                    continue
                at += hit
                if at >= end:
                    break
            got = _member(window, at)
            if got is None:
                at, synced = at + 1, False
                continue
            yield at, _parsed(got[0])
            at, synced = got[1], True
    yield max(at, end), None


def _page(value: str | None) -> int | None:
    return int(value.removeprefix("<urn:page:").removesuffix(">")) if value else None


def read_archives(archives: DataFrame, *, range_bytes: int = _RANGE, payloads: bool = False) -> DataFrame:
    """One row per record, from the files: page_id, url, record_type, refers_to, payload_bytes, payload_digest, path, place
    (and payload, null for revisits, if asked for).

    Files are cut into ranges without regard to records. A task scans its range for gzip magic, takes a place as a
    member only if it decodes to a WARC head, passes its checksum and is followed by a member or the end, and owns the
    records that begin in its range. It also tells up to where it used bytes: where a range took for its first record
    what lies inside a record of a range before (a payload can hold whole members), it is read again from that place,
    until none is left. So the records are those that a scan from the file's start meets, whatever range_bytes is.
    Length and digest of a response are computed from the payload read; those of a revisit are of the full payload, from
    its heads. No archives, no rows.
    """
    out = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, place long" + ", payload binary" * payloads
    # Rows of records, and one row with `used` for each range.
    kind = out + ", start long, end long, used long"
    cuts = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start"))
    cuts = cuts.select("path", "start", F.least(F.col("start") + range_bytes, "bytes").alias("end"), F.col("start").alias("begin"))
    names = [x.split()[0] for x in kind.split(", ")]

    def read(batches):
        import pyarrow as pa

        types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in kind.split(", ")])
        for batch in batches:
            for r in batch.to_pylist():
                held, size = {k: [] for k in names}, 0
                for place, f in records_in(r["path"], r["begin"], r["end"]):
                    row = dict.fromkeys(names) | {"path": r["path"], "start": r["start"], "end": r["end"]}
                    if f is None:
                        row["used"] = place
                    else:
                        http, _, payload = f["block"].partition(b"\r\n\r\n")
                        full = f.get("warc-type") == "response"
                        inner = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                        row |= {"page_id": _page(f.get("warc-record-id")), "url": f.get("warc-target-uri"), "record_type": f.get("warc-type"), "refers_to": _page(f.get("warc-refers-to")), "place": place}
                        row |= {"payload_bytes": len(payload), "payload_digest": digest_of(payload)} if full else {"payload_bytes": inner, "payload_digest": f.get("warc-payload-digest", "").removeprefix("sha1:")}
                        if payloads and full:
                            row["payload"] = payload
                        size += 256 + len(payload) * payloads
                    for k in names:
                        held[k].append(row[k])
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_pydict(held, schema=schema)
                        held, size = {k: [] for k in names}, 0
                yield pa.RecordBatch.from_pydict(held, schema=schema)

    n = max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    got = written(cuts.repartition(n).mapInArrow(read, kind), "records")
    while True:
        first = got.groupBy("path", "start", "end").agg(F.min("place").alias("first"), F.max("used").alias("used"))
        late = written(first.withColumn("begin", F.max("used").over(before)).filter("first < begin").select("path", "start", "end", "begin"), "ranges")
        if late.isEmpty():
            return got.filter("used is null").drop("start", "end", "used")
        again = late.withColumn("begin", F.least("begin", "end")).repartition(n).mapInArrow(read, kind)
        got = written(got.join(late.select("path", "start"), ["path", "start"], "left_anti").unionByName(again), "records")
