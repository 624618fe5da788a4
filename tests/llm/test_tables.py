"""WARC archives, vectors and the pipeline against brute force."""

import base64
import hashlib
import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrane.llm import components, vectors, warc
from terrane.llm.tokens import encoder, vocabulary


PAGES = "page_id long, url string, html string"


def _pages():
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", rng.choice(["", "same", f"<p>{i}</p>" * rng.randint(1, 900), "é中" * 50])) for i in range(120)]
    noise = base64.b64encode(rng.randbytes(40_000)).decode()
    return [*rows, (200, None, None), (201, "x\r\nWARC-Type: fake", noise), rows[5], (None, "u", "same"), (None, None, None), (5, "other", "not the same as before")]


def _roles(rows):
    top = defaultdict(lambda: -1)
    for key, _, html in rows:
        if key is not None:
            top[html or ""] = max(top[html or ""], key)
    out = []
    for key, _, html in rows:
        data, t = (html or "").encode(), top[html or ""]
        revisit = key is not None and key < t
        out.append((key, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", t if revisit else None))
    return out


def test_archives_give_back_every_page(spark):
    rows = _pages()
    pages = spark.createDataFrame(rows, PAGES).withColumn("top", F.lit(1)).withColumn("digest", F.lit("x"))
    archives = warc.write_archives(pages)
    for step in (1 << 23, 997):
        got = warc.read_archives(archives, range_bytes=step)
        got = [tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
        assert sorted(map(str, got)) == sorted(map(str, _roles(rows)))
    none = warc.write_archives(spark.createDataFrame([], PAGES))
    assert none.collect() == [] and warc.read_archives(none).collect() == []


def test_short_payloads_are_all_responses(spark):
    rows = [(1, "u", "aa"), (2, "u", "aa"), (3, "u", "aaaa"), (4, "u", "aaaa")]
    got = warc.read_archives(warc.write_archives(spark.createDataFrame(rows, PAGES), least_bytes=3), payloads=True).collect()
    assert {r.page_id: (r.record_type, r.refers_to) for r in got} == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    assert {r.page_id: r.payload for r in got if r.record_type == "response"} == {1: b"aa", 2: b"aa", 4: b"aaaa"}


@pytest.mark.parametrize("read", [1 << 18, 61, 3])
def test_ranges_own_records_once_and_ignore_nested_members(tmp_path, monkeypatch, read):
    monkeypatch.setattr(warc, "_READ", read)
    inner = warc.record(99, "u", b"inner", "X", None)
    path = str(tmp_path / "a.warc.gz")
    with open(path, "wb") as f:
        for i in range(30):
            # random bytes do not compress, so nested members stand in the file as they are
            f.write(warc.record(i, "u", os.urandom(300) + inner + os.urandom((5000 if read > 99 else 50) * (i % 3)), "X", None))
    size = os.path.getsize(path)
    for step in (50, 1000, size) if read > 3 else (1000,):
        got = [f["warc-record-id"] for s in range(0, size, step) for _, f in warc.records_in(path, s, min(size, s + step)) if f]
        assert got == [f"<urn:page:{i}>" for i in range(30)]


def _stored(data):
    """A gzip member that holds data as it is."""
    import zlib

    pack = zlib.compressobj(0, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def test_records_do_not_depend_on_ranges(spark, tmp_path):
    import zlib

    rng = random.Random(12)
    inner = [warc.record(900 + i, "u", b"inner" * 3, "X", None) for i in range(5)]
    path, places, at = str(tmp_path / "n.warc.gz"), [], 0
    with open(path, "wb") as f:
        for i in range(30):
            whole = zlib.decompress(warc.record(i, "u", rng.randbytes(rng.randint(0, 400)) + b"".join(inner[: i % 6]) + rng.randbytes(rng.choice([0, 9, 3000])), "X", None), 31)
            member = _stored(whole) if i % 3 else zlib.compress(whole, wbits=31)
            places.append(at)
            at += f.write(member)
    archives = spark.createDataFrame([(path, at, 30)], "path string, bytes long, records long")
    seen = set()
    for step in (50, 211, 1000, at):
        got = warc.read_archives(archives, range_bytes=step, payloads=True).collect()
        assert sorted((r.page_id, r.place) for r in got) == list(enumerate(places)), step
        seen.add(str(sorted((r.page_id, r.payload) for r in got)))
    assert len(seen) == 1


VECTORS = "vec_id long, embedding array<float>, label int"


def _vectors():
    rng = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1, None):
        for c in range(25):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 7)):
                rows.append((k, (centre + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.35])).astype("float32").tolist(), label))
                k += 1
    rows += [(k + i, rows[3][1], 0) for i in range(3)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [1.0] * 15 + [None], 0), (904, [float("inf")] * 16, 0), (905, [1.0, 2.0], 0), (906, [], 0), (907, [2.0, 4.0], 0)]
    return [*rows, rows[0], (None, rows[0][1], 0)]


def test_vectors_equal_brute_force(spark, monkeypatch):
    rows = _vectors()
    frame = spark.createDataFrame(rows, VECTORS).withColumn("n", F.lit(1)).withColumn("key", F.lit(2))

    def fine(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    links, edges = [0] * len(rows), []
    for i, (a, v, k) in enumerate(rows):
        for j, (b, w, m) in enumerate(rows):
            if i != j and k is not None and k == m and fine(v) and fine(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                    links[i] += 1
                    edges.append((i, j))
    up = list(range(len(rows)))
    for _ in rows:
        for i, j in edges:
            up[i] = up[j] = min(up[i], up[j])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[up[i]] = min(least.get(up[i], r[0]), r[0])
    want = sorted(str((r[0], links[i], least[up[i]], r[0] == least[up[i]])) for i, r in enumerate(rows))
    got = vectors.near_duplicates(frame).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    monkeypatch.setattr(vectors, "_BLOCK", 20)
    assert sorted(str(tuple(r)) for r in vectors.near_duplicates(frame).collect()) == want
    assert vectors.near_duplicates(spark.createDataFrame([], VECTORS)).collect() == []


def test_counts_are_calibrated():
    rng = np.random.default_rng(1)
    for m in (24, 64):
        need = vectors.least_count(m, 1.75)
        hits = (np.abs(rng.standard_normal((200_000, m))) <= 1.75).sum(axis=1)
        assert (hits < need).mean() < 1e-4 and need > m // 2


def test_components_of_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 180)] + [(7, 7), (None, 3), (300, 250)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 180)} | {300: 250, 250: 250}
    assert components.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, kept, seen = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, "/root/testdata/sf0.01")
        kept.write.parquet(out := str(tmp_path / name))
        kept = spark.read.parquet(out)
        seen.append(kept)
    assert all(x.columns == columns for x in seen[:-1])
    n = [x.count() for x in seen]
    assert n[0] >= 0.97 * docs.count() and n[1] < n[0] and n[2] == n[1]
    assert seen[2].filter("text like '%[SECRET]%'").count() > 0
    packed = seen[4].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert packed.filter("n <> e or n > 1024").count() == 0
    assert {r.doc_id for r in seen[4].select("doc_id").distinct().collect()} == {r.doc_id for r in seen[3].select("doc_id").distinct().collect()}


def test_pipeline_stages_take_hard_rows(spark):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, extra string"
    rows = [(1, None, None, None, None, "x"), (1, "the same row", "en", "a", 12, "x"), (1, "the same row", "en", "a", 12, "x"), (None, "no id", "en", None, 5, None), (None, "no id", "en", None, 5, None), (2, "", "en", "b", 0, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, "")
            assert got.columns == docs.columns
            got.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
