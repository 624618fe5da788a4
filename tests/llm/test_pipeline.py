"""The pipeline, stage by stage, against plain Python on whole small tables, and on rows and columns that could trip it."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrane.llm import language, mixing, secrets
from terrane.llm.tokens import vocabulary

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def _identified(rows, models):
    """Rows whose text has a letter and a margin of at least half a percent between the two dictionaries that suit it best."""
    how = lambda d: zstandard.ZstdCompressionParameters.from_level(3, dict_size=len(d), source_size=4096, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = []
    for _, data in models:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how(data))
        made.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how(data)))
    out = []
    for r in rows:
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            continue
        data = " ".join(re.findall(r"[^\W\d_]+", r["text"].lower())).encode()
        cuts = range(0, len(data), 4096)
        sizes = sorted(sum(len(c.compress(data[i : i + 4096])) for i in cuts) for c in made)
        if (sizes[1] - sizes[0]) / (sizes[1] - len(cuts) * len(made[0].compress(b""))) >= 0.005:
            out.append(r)
    return out


def _fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), text.encode()))
    grams = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _first_of_groups(rows):
    prints = {r["doc_id"]: _fingerprint(r["text"]) for r in rows}
    group = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a, p in prints.items():
            for b, q in prints.items():
                if (p ^ q).bit_count() <= 4 and group[b] > group[a]:
                    group[b], changed = group[a], True
    return [r for r in rows if group[r["doc_id"]] == r["doc_id"]]


def _masked(rows):
    out = []
    for r in rows:
        covered = bytearray(len(r["text"]) + 1)
        begins = set()
        for s, _, e in secrets.spans_of(r["text"])[1]:
            if not covered[s]:
                begins.add(s)
            covered[s:e] = b"\1" * (e - s)
        text = "".join("[SECRET]" * (i in begins) + c * (not covered[i]) for i, c in enumerate(r["text"]))
        out.append(r | {"text": text, "n_chars": len(text)} if begins else r)
    return out


def _plain(df):
    return [r.asDict() for r in df.collect()]


def _same(a, b):
    assert Counter(str(sorted(r.items())) for r in a) == Counter(str(sorted(r.items())) for r in b)


def test_stages_equal_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = _plain(docs)
    kept = STAGE["language_id"](spark, docs, SF)
    rows = _identified(rows, language.fit(docs))
    _same(_plain(kept), rows)
    kept = STAGE["simhash_near_dedup"](spark, spark.createDataFrame(kept.collect(), docs.schema), SF)
    rows = _first_of_groups(rows)
    _same(_plain(kept), rows)
    kept = STAGE["secret_scan"](spark, spark.createDataFrame(kept.collect(), docs.schema), SF)
    rows = _masked(rows)
    _same(_plain(kept), rows)
    before = spark.createDataFrame(kept.collect(), docs.schema)
    kept = STAGE["source_mixing"](spark, before, SF)
    copies = {r.doc_id: r.copies for r in mixing.mix(before).collect()}
    rows = [r for r in rows for _ in range(copies[r["doc_id"]])]
    _same(_plain(kept), rows)
    packed = STAGE["best_fit_packing"](spark, spark.createDataFrame(kept.collect(), docs.schema), SF).collect()
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in rows:
        ids = [*tok.encode(r["text"], add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], k, s, e - s, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[s:e]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want
    places = defaultdict(list)
    for r in packed:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 1024


NAMES = "text_ predicted margin rejected row mixed_doc_id mixed_source mixed_size mixed_shards mixed_words mixed_copy mixed_shard mixed_order size copies shards h fp rep key node component component_id __text __copy __size lang_pred score".split()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_columns_of_any_name_and_type_come_through(spark, name):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"the {i % 7} words of text number {i % 5} are here for everyone to read", "en", "ab"[i % 2], 5) for i in range(20)]
    rows += [(1, None, None, None, None), rows[3], (None, "no id here at all", "en", None, 3), (None, "no id here at all", "en", None, 3)]
    docs = spark.createDataFrame(rows, schema)
    for c in NAMES:
        docs = docs.withColumn(c, F.lit(f"own {c}"))
    docs = docs.withColumn("PREDICTED_", F.lit("other")).withColumn("map", F.create_map(F.lit("k"), F.col("lang")))
    got = STAGE[name](spark, docs, "")
    if name != "best_fit_packing":
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        for r in got.collect():
            assert all(r[c] == f"own {c}" for c in NAMES) and r.map == {"k": r.lang}
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in got.select("doc_id").collect()]
            assert ids.count(None) == 1 and ids.count(3) <= 1
    else:
        assert got.count() == len(rows)
