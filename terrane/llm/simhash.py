"""SimHash near-duplicates: 64-bit fingerprints linked within a few bits, by pigeonring filtering.

A fingerprint is cut into a ring of five segments. If two differ in at most 4 bits, then some segment starts a chain
whose first l segments differ in at most floor(4 l / 5) bits together, for every l: 0, 1, 2, 3, 4. Rows are
keyed by the first two steps of each of the five chains (an equal segment, then one with at most one bit of
difference: the row with 0 in the differing bit asks under the other's key, so that a pair meets once). The
third and fourth steps are checked on the pairs that meet, and the full Hamming distance last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import lean, written
from .components import connected_components

#: Bits of the five segments, from the lowest bit up.
_WIDTHS = (13, 13, 13, 13, 12)
#: Members up to which a group's pairs are listed at once; larger groups are walked, which yields a spanning tree.
_SMALL = 6
#: Members of a key up to which one task has them all; those of larger keys are dealt into blocks of so many, and each
#: pair of blocks is a group of its own.
_LARGE = 2048
#: Bits of a block's number in the key of a pair of blocks.
_BLOCK_BITS = 17


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4) -> DataFrame:
    """(doc_id long, fp long): the SimHash of each whole text.

    A-Z are lower-cased, words are runs outside ASCII white space, shingles of so many words (repeats count; fewer
    words: one shingle of all) are hashed by XXH64 with seed 42, and a bit is 1 if over half of the hashes have it.
    Null or empty text or no word: fingerprint 0. Null doc_ids stay.
    """
    src = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for s in range(0, batch.num_rows, 512):
                part = batch.slice(s, 512)
                hashes, sizes = [], []
                for body in part.column(1):
                    h = _hashes(body.as_py(), words)
                    hashes.append(h)
                    sizes.append(len(h))
                fp = _majority(np.concatenate(hashes), np.array(sizes, "int64"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view("int64"), pa.int64())], names=["doc_id", "fp"])

    return src.mapInArrow(lean(run), "doc_id long, fp long")


def _hashes(text: str | None, words: int):
    from itertools import accumulate, repeat

    import numpy as np
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, "uint64")
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), 42)], "uint64")
    line = b" ".join(w)
    ends = list(accumulate(len(x) + 1 for x in w))
    cuts = map(slice, [0, *ends[: len(w) - words]], [e - 1 for e in ends[words - 1 :]])
    return np.fromiter(map(xxhash.xxh64_intdigest, map(line.__getitem__, cuts), repeat(42)), "uint64", len(w) - words + 1)


def _majority(hashes, sizes):
    """One fingerprint per run of hashes. Eight bits at a time are summed in the byte lanes of 64-bit words, over at
    most 255 hashes, so that no lane runs over."""
    import numpy as np

    out = np.zeros(len(sizes), "uint64")
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    parts = -(-sizes[some] // 255)
    first = np.cumsum(sizes[some]) - sizes[some]
    owner = np.repeat(np.arange(len(some)), parts)
    lead = np.cumsum(parts) - parts
    cuts = np.repeat(first, parts) + 255 * (np.arange(len(owner)) - np.repeat(lead, parts))
    half = sizes[some][:, None]
    lanes = np.uint64(0x0101010101010101)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & lanes, cuts).view("uint8").reshape(-1, 8)
        counts = np.add.reduceat(sums.astype("int64"), lead, axis=0)
        for byte in range(8):
            out[some] |= (2 * counts[:, byte] > half[:, 0]).astype("uint64") << np.uint64(8 * byte + k)
    return out


def _segments(fp):
    import numpy as np

    out, at = [], 0
    for w in _WIDTHS:
        out.append((fp >> np.uint64(at)) & np.uint64((1 << w) - 1))
        at += w
    return out



def _keyed(batches):
    """(fp, rep) -> (key, asks, fp, rep): five keys of its own and one for each zero bit of the segment that follows."""
    import numpy as np
    import pyarrow as pa

    n = len(_WIDTHS)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view("uint64")
        rep = batch.column(1).to_numpy(zero_copy_only=False)
        seg = _segments(fp)
        for i in range(n):
            nxt, w = seg[(i + 1) % n], _WIDTHS[(i + 1) % n]
            own = (np.uint64(i) << np.uint64(26)) | (seg[i] << np.uint64(13)) | nxt
            keys, who, asks = [own], [np.arange(len(fp))], [np.zeros(len(fp), bool)]
            for b in range(w):
                zero = np.flatnonzero((nxt >> np.uint64(b)) & np.uint64(1) == 0)
                keys.append(own[zero] | np.uint64(1 << b))
                who.append(zero)
                asks.append(np.ones(len(zero), bool))
            who = np.concatenate(who)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys).view("int64")), pa.array(np.concatenate(asks)), pa.array(fp[who].view("int64")), pa.array(rep[who])], names=["key", "asks", "fp", "rep"]
            )


def _close(a, b, start, most: int):
    """Pairs whose chain from segment `start` keeps its budgets at every length, and that differ in at most `most` bits."""
    import numpy as np

    n = len(_WIDTHS)
    diff = np.stack([np.bitwise_count(s).astype("int64") for s in _segments(a ^ b)])
    ok, total = np.ones(np.broadcast(a, b).shape, bool), 0
    for k in range(n):
        total = total + np.take_along_axis(diff, ((start + k) % n)[None], 0)[0]
        ok &= total <= most * (k + 1) // n
    return ok


def _walk(fp, rep, asks, start: int, most: int):
    """Spanning links of a large group: each row that is reached is held against those not yet reached."""
    import numpy as np

    left = np.arange(len(fp))
    out = []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            p = queue.pop()
            ok = _close(fp[left], fp[p], np.full(len(left), start), most)
            if asks[p]:
                ok &= ~asks[left]
            hit = left[ok]
            left = left[~ok]
            queue += hit.tolist()
            out += [(rep[p], rep[h]) for h in hit]
    return out


def _linked(most: int, shift: int = 26):
    """Links within groups of equal keys, whose bits from `shift` up name the segment that the chain starts at."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(k, asks, fp, rep):
            change = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            size = np.diff(np.append(change, len(k)))
            large = size > _SMALL
            i = np.flatnonzero(np.repeat(~large & (size > 1), size) & ~asks)
            for d in range(1, _SMALL):
                i = i[i + d < len(k)]
                i = i[k[i] == k[i + d]]
                if not len(i):
                    break
                ok = _close(fp[i], fp[i + d], k[i] >> shift, most)
                yield rep[i[ok]], rep[i[ok] + d]
            for s, n in zip(change[large].tolist(), size[large].tolist()):
                if not asks[s]:
                    got = _walk(fp[s : s + n], rep[s : s + n], asks[s : s + n], int(k[s] >> shift), most)
                    if got:
                        yield tuple(np.array(got, "int64").T)

        held = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now[2] = now[2].view("uint64")
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut:
                for a, b in links(*(x[:cut] for x in held)):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                held = [x[cut:] for x in held]
        if held is not None and len(held[0]):
            for a, b in links(*held):
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 4, most_bits: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per row of docs.

    component_id is the smallest doc_id reachable through fingerprints that differ in at most most_bits (4 at most)
    bits. Equal fingerprints meet once, by their smallest doc_id, so copies cost one row. Rows without a doc_id
    get the component of their fingerprint (null if no row with that fingerprint has an id). No rows, no result. A
    very long text is read whole, by the task that has it; a repeated doc_id has one component for each fingerprint.
    No task holds a key of more than _LARGE members: larger ones are compared by pairs of blocks.
    """
    if not 0 <= most_bits <= 4:
        raise ValueError("the keys of the first two chain steps hold for at most 4 bits")
    prints = written(fingerprints(docs, doc_id=doc_id, text=text, words=words), "prints")
    reps = written(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "reps")
    keyed = reps.filter("rep is not null").mapInArrow(_keyed, "key long, asks boolean, fp long, rep long")
    large = keyed.groupBy("key").agg(F.ceil(F.count("*") / _LARGE).cast("long").alias("blocks")).filter("blocks > 1")
    large = written(large, "large")
    rest = keyed if large.isEmpty() else keyed.join(large, "key", "left_anti")
    met = rest.repartition("key").sortWithinPartitions("key", "asks")
    links = met.mapInArrow(_linked(most_bits), "a long, b long")
    if rest is not keyed:
        blocks = keyed.join(large, "key").withColumn("own", F.expr("pmod(xxhash64(fp), blocks)")).withColumn("other", F.expr("explode(sequence(0L, blocks - 1))"))
        pair = f"shiftleft(key, {2 * _BLOCK_BITS}) | shiftleft(least(own, other), {_BLOCK_BITS}) | greatest(own, other)"
        met = blocks.select(F.expr(pair).alias("key"), "asks", "fp", "rep").repartition("key").sortWithinPartitions("key", "asks")
        links = links.union(met.mapInArrow(_linked(most_bits, 26 + 2 * _BLOCK_BITS), "a long, b long"))
    parts = connected_components(links, "a", "b")
    reps = reps.join(parts, reps.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(reps, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
