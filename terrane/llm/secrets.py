"""Secrets in texts and in what is encoded in them, by a recursive decoding worklist."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from array import array
from bisect import bisect_right

from pyspark.sql import DataFrame, functions as F

from .common import lean

#: The base patterns, with the length that a match must have at least.
_ASSIGN = re.compile(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KINDS = ("assign", "access", "hex")

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};")
#: ASCII in UTF-16 of either byte order.
_WIDE = re.compile(r"\0?(?:[\t\n\r\x20-\x7e]\0){6,}[\t\n\r\x20-\x7e]?")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Runs joined over line breaks, with what indents the next line, and their lines.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
#: Bytes of what a compressed stream expands to that are one layer at a time. Longer content is scanned part by part, so
#: a task's memory is bounded whatever a text holds.
_PART = 1 << 24
#: Bytes that two parts share, so that what stands across their border is whole in one.
_OVERLAP = 1 << 16


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping per kind, matches that are too short left out."""
    out = [(m.start(), "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [(m.start(), "access", m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [(m.start(), "hex", m.end()) for m in _HEX.finditer(text)]


def _zstd():
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


#: Of each format: its first bytes, its decoder, and the most bytes given to that at a time (zstd has no limit of output).
_FORMATS = (
    (b"\x1f\x8b\x08", lambda: zlib.decompressobj(31), 1 << 12),
    (b"BZh", bz2.BZ2Decompressor, 1 << 12),
    (b"\xfd7zXZ\x00", lzma.LZMADecompressor, 1 << 12),
    (b"x", zlib.decompressobj, 1 << 12),
    (b"\x28\xb5\x2f\xfd", _zstd, 64),
)
_MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|x[\x01\x5e\x9c\xda]|\x28\xb5\x2f\xfd")


def _member(make, data: bytes, at: int, step: int):
    """Yields what a compressed stream at a place of data holds, as far as it can be decoded, in pieces of at most _PART
    bytes or so, and returns where it ends (0 if cut short or damaged)."""
    told, by, calm = 0, step, len(data)
    while True:
        unpack, skip, i = make(), told, at
        try:
            while i < len(data):
                # A damaged stream goes byte by byte from where it failed, which keeps all before the damage.
                n = step if i + step <= calm else by
                chunk = data[i : i + n]
                i += n
                while True:
                    out = unpack.decompress(chunk) if step == 64 else unpack.decompress(chunk, _PART)
                    if len(out) > skip:
                        told += len(out) - skip
                        yield out[skip:]
                    skip = max(0, skip - len(out))
                    if unpack.eof:
                        return min(i, len(data)) - len(unpack.unused_data)
                    chunk = getattr(unpack, "unconsumed_tail", b"") if step > 64 else b""
                    if not chunk and (step == 64 or len(out) < _PART or getattr(unpack, "needs_input", True)):
                        break
            return 0
        except Exception:  # Each decoder has errors of its own.
            if by == 1:
                return 0
            by, calm = 1, i - n


def _streams(data: bytes):
    """(start, end, content) of what is compressed in data, wherever it begins.

    Members that follow each other are one content, in parts with an overlap where it is long; a member that is cut
    short or damaged ends it with what can be decoded, and others are looked for from the byte after its first.
    """
    at = 0
    while m := _MAGIC.search(data, at):
        start, out, fresh, end = m.start(), bytearray(), 0, 0
        while m:
            make, step = next((make, step) for magic, make, step in _FORMATS if m.group().startswith(magic))
            begin, pieces = m.start(), _member(make, data, m.start(), step)
            while True:
                try:
                    piece = next(pieces)
                except StopIteration as done:
                    end = done.value
                    break
                out += piece
                fresh += len(piece)
                while len(out) > _PART:
                    yield start, len(data), bytes(out[:_PART])
                    del out[: _PART - _OVERLAP]
                    fresh = len(out) - _OVERLAP
            m = _MAGIC.match(data, end) if end else None
        if fresh:
            yield start, end or len(data), bytes(out)
        at = end or begin + 1


def _from_base64(run: str, skip: int) -> bytes:
    """The bytes of a run without its padding, from a character on; a last character that ends no byte is left out."""
    body = run[skip:].replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        body = body[:-1]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


class _Origin:
    """Where the characters of a layer come from in the outermost text, as runs: `at` has the first character of each,
    `lo` its place there, `hi` the end of that place if all characters of the run share it, or -1 if they go along."""

    def __init__(self):
        self.at, self.lo, self.hi = array("q"), array("q"), array("q")

    def add(self, at: int, lo: int, hi: int = -1) -> None:
        for to, value in ((self.at, at), (self.lo, lo), (self.hi, hi)):
            to.append(value)

    def of(self, i: int) -> tuple[int, int]:
        """The span of a character."""
        k = bisect_right(self.at, i) - 1
        if self.hi[k] < 0:
            return self.lo[k] + i - self.at[k], self.lo[k] + i - self.at[k] + 1
        return self.lo[k], self.hi[k]

    def copy(self, s: int, e: int, to: _Origin, at: int) -> None:
        """Add the runs of characters s to e to another map, from its character `at` on."""
        k = bisect_right(self.at, s) - 1
        while s < e:
            end = min(e, self.at[k + 1]) if k + 1 < len(self.at) else e
            to.add(at, self.lo[k] + (s - self.at[k] if self.hi[k] < 0 else 0), self.hi[k])
            at, s, k = at + end - s, end, k + 1

    def digest(self) -> bytes:
        return hashlib.sha256(b"".join(x.tobytes() for x in (self.at, self.lo, self.hi))).digest()


def _itself() -> _Origin:
    out = _Origin()
    out.add(0, 0)
    return out


def _replaced(text: str, origin: _Origin, pattern, decode):
    """Text with each match of an escape decoded, and where its characters come from; None if nothing was decoded."""
    out, size, last, to = [], 0, 0, _Origin()
    for m in pattern.finditer(text):
        new = decode(m.group())
        if new is None or new == m.group():
            continue
        if last < m.start():
            origin.copy(last, m.start(), to, size)
            out.append(text[last : m.start()])
            size += m.start() - last
        if new:
            to.add(size, origin.of(m.start())[0], origin.of(m.end() - 1)[1])
            out.append(new)
            size += len(new)
        last = m.end()
    if not last:
        return None
    origin.copy(last, len(text), to, size)
    out.append(text[last:])
    return "".join(out), to


def _percent(token: str) -> str:
    return bytes.fromhex(token.replace("%", "")).decode("utf-8", "replace")


def _escape(token: str) -> str | None:
    if token[0] == "&":
        new = html.unescape(token)
        return new if new != "\ufffd" else None
    code = int(token[2:].strip("{}"), 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _digest(layer: str | bytes) -> tuple:
    data = layer if isinstance(layer, bytes) else layer.encode("utf-8", "surrogatepass")
    return type(layer), hashlib.sha256(data).digest()


def _unescaped(now: str, origin: _Origin):
    """What a layer is with its URL escapes and with its Unicode escapes decoded, each with where it comes from."""
    for pattern, decode, signs in ((_PERCENT, _percent, ("%",)), (_ESCAPE, _escape, ("\\", "&#"))):
        got = _replaced(now, origin, pattern, decode) if any(x in now for x in signs) else None
        if got:
            yield got


def _places(data: bytes):
    """(start, end, layer) of what may be or hold secrets in bytes."""
    now = data.decode("latin-1")
    yield from ((s, e, now[s:e]) for s, _, e in base_spans(now))
    yield from _streams(data)
    for pattern in (_WIDE, _BASE64, _WRAPPED):
        yield from ((m.start(), m.end(), m.group()) for m in pattern.finditer(now))
    if _PERCENT.search(now) or _ESCAPE.search(now):
        yield 0, len(data), data


def _encoded(now: str):
    """(start, end, layer) for what base64 runs of a layer hold, at each of the four alignments, as a run may have other
    characters of its alphabet before it. The place of what is in one line is its run; of what lines that are joined
    hold, the lines that it comes from."""
    for m in _BASE64.finditer(now):
        run = m.group().rstrip("=")
        for skip in range(4):
            yield m.start(), m.end(), _from_base64(run, skip)
    for m in _WRAPPED.finditer(now):
        lines = [(x.start(), x.end()) for x in _LINE.finditer(now, m.start(), m.end())]
        run = "".join(now[s:e] for s, e in lines)
        if len(run) < 16:
            continue
        begins = [0]
        for s, e in lines:
            begins.append(begins[-1] + e - s)
        lines[-1] = (lines[-1][0], m.end())
        for skip in range(4):
            for s, e, layer in _places(_from_base64(run, skip)):
                first = bisect_right(begins, skip + 4 * (s // 3)) - 1
                last = bisect_right(begins, min(skip + 4 * -(-e // 3), len(run)) - 1) - 1
                yield lines[first][0], lines[last][1], layer


def _within(now: str | bytes):
    """The layers that are encoded in a layer, one at a time."""
    if isinstance(now, bytes):
        yield from (x for _, _, x in _streams(now))
        now = now.decode("latin-1")
    if "\0" in now:
        yield from (m.group().replace("\0", "") for m in _WIDE.finditer(now))
    yield from (x for x, _ in _unescaped(now, _itself()))
    yield from (x for _, _, x in _encoded(now))


def _kinds_within(layer: str | bytes, known: dict) -> set:
    """The kinds of secrets in a decoded layer and in all that is encoded in it.

    Bytes are read as Latin-1, whatever they are: patterns, escapes and base64 are ASCII, which that and UTF-8 share, and
    runs of ASCII in UTF-16 are read apart. A worklist unwraps a layer until nothing new comes up, an inner layer as soon
    as it is met, so that one layer of each depth is held; one met before, as text or as bytes, is not unwrapped again, so
    cycles end. All of it has one place in the text, so kinds are enough to know, and known keeps them for the
    next place of the same layer.
    """
    key = _digest(layer)
    if key not in known:
        kinds, seen, work = set(), {key}, [iter((layer,))]
        while work:
            now = next(work[-1], None)
            if now is None:
                work.pop()
                continue
            if len(work) > 1:
                if (d := _digest(now)) in seen:
                    continue
                seen.add(d)
            kinds.update(k for _, k, _ in base_spans(now if isinstance(now, str) else now.decode("latin-1")))
            work.append(_within(now))
        known[key] = kinds
    return known[key]


def spans_of(text: str) -> tuple[list, list]:
    """(base, all) spans of a text, each sorted by start, kind as listed, end. Those found in a decoded layer have the
    kind and the place in the text of what they were decoded from, once for each place where that stands.

    URL escapes and Unicode escapes (backslash and numeric character references) keep places run by run;
    every replacement of escapes shortens the text, so the work is finite.
    """
    order = {k: i for i, k in enumerate(_KINDS)}
    key = lambda s: (s[0], order[s[1]], s[2])
    base = sorted(base_spans(text), key=key)
    found, known = set(base), {}
    work, seen = [(text, _itself())], set()
    while work:
        now, origin = work.pop(0)
        where = lambda s, e, origin=origin: (origin.of(s)[0], origin.of(e - 1)[1])
        if now is not text:
            for s, kind, e in base_spans(now):
                s, e = where(s, e)
                found.add((s, kind, e))
        for s, e, layer in _encoded(now):
            kinds = _kinds_within(layer, known)
            if kinds:
                s, e = where(s, e)
                found.update((s, kind, e) for kind in kinds)
        for inner, to in _unescaped(now, origin):
            d = _digest(inner), to.digest()
            if d not in seen:
                seen.add(d)
                work.append((inner, to))
    return base, sorted(found, key=key)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans, mask: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced."""
    out, last = [], 0
    for s, _, e in sorted(spans):
        if s >= last:
            out += [text[last:s], mask]
        last = max(last, e)
    return "".join([*out, text[last:]])


def find_secrets(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded): one row per row, whole texts.

    The counts and base_sha256 are of the base patterns in the text itself; spans has these and those found in decoded
    layers; n_decoded says how many there are of the latter. Null text counts as empty; doc_ids may be null or repeat; no
    rows, no result. A very long text is read whole: memory is a few times its length, for escapes as well, as places are
    kept by runs; what compressed layers expand to is scanned in parts of _PART bytes, however long it is.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded")}
            for body in batch.column(1):
                base, every = spans_of(body.as_py() or "")
                for k in _KINDS:
                    out[f"n_{k}"].append(sum(x[1] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(every))
                out["n_decoded"].append(len(every) - len(base))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out.values(), types))], names=["doc_id", *out])

    return src.mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long")


def mask_secrets(docs: DataFrame, *, text: str = "text", n_chars: str | None = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each text with its secrets masked and n_chars, if there is such a column, set anew.

    Texts without secrets, null ones included, stay as they are, and so do their other columns.
    """
    names = docs.columns
    at = names.index(text)
    count = names.index(n_chars) if n_chars in names else None

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts, sizes = [], None if count is None else batch.column(count).to_pylist()
            for i, body in enumerate(batch.column(at)):
                old = new = body.as_py()
                spans = spans_of(old)[1] if old else []
                if spans:
                    new = masked(old, spans, mask)
                    if sizes is not None:
                        sizes[i] = len(new)
                texts.append(new)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[count] = pa.array(sizes, batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(run), docs.schema)
