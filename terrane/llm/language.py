"""Language identification by compression: the dictionary that shortens a text most names its language."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, functions as F

from .common import lean, unused

#: The bounded sample that a dictionary is made of: rows of each language, in hash order, and bytes of their text.
_ROWS, _BYTES = 128, 1 << 16
#: Languages that may be learned: each is a dictionary that every worker holds and every text is compressed with.
_LANGUAGES = 200
#: A text is compressed in parts of so many bytes, each against the dictionary alone, so that all of it counts.
_PART = 4096
#: The least margin (share of the second smallest size) at which a prediction is not rejected.
_MARGIN = 0.005
_LETTERS = re.compile(r"[^\W\d_]+")


def _normal(text: str) -> bytes:
    """Lower-case runs of letters, a space between: style and markup say nothing of the language."""
    return " ".join(_LETTERS.findall(text.lower())).encode("utf-8", "surrogatepass")


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train: str = "crc32(cast({id} as string)) % 3 <> 1",
        sample_rows: int = _ROWS, sample_bytes: int = _BYTES, most_languages: int = _LANGUAGES) -> list[tuple[str, bytes]]:
    """[(language, dictionary)] from rows that meet `train` and have doc_id, text and language, in order of language.

    The sample has at most sample_rows distinct rows (doc_id, text) of a language, chosen by hash, and sample_bytes of
    their normal form. Every language that such a row names is learned; more than most_languages of them is an error, as
    a column with so many values does not name languages. No such row: no language.
    """
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.expr(train.format(id="id")) & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()}
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages: name another column, or raise most_languages")
    if not counts:
        return []
    h, span = F.pmod(F.xxhash64(F.lit("sample"), F.col("id").cast("string"), "text"), F.lit(1 << 30)), 1 << 30
    share = F.create_map(*(x for k, n in counts.items() for x in (F.lit(k), F.lit(min(span, span * 2 * sample_rows // n + 1)))))
    few = rows.withColumn("h", h).filter(F.col("h") < share[F.col("lang")]).select("lang", "h", F.col("id").cast("string").alias("id"), F.substring("text", 1, sample_bytes).alias("text")).distinct()
    parts: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted(few.collect(), key=lambda r: (r["lang"], r["h"], r["id"], r["text"])):
        if len(parts[r["lang"]]) < sample_rows:
            parts[r["lang"]].append(_normal(r["text"]))
    out = []
    for k in sorted(counts):
        # Every row gives the same share of the dictionary, short rows leave theirs to longer ones.
        left, made = sample_bytes, []
        for i, x in enumerate(sorted(parts[k], key=len)):
            made.append(x[: left // (len(parts[k]) - i)])
            left -= len(made[-1])
        out.append((k, b"\n".join(made)))
    return out


@functools.lru_cache(maxsize=2)
def _coders(models: tuple):
    import zstandard

    out = []
    for name, data in models:
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        # Short matches carry syllables; so they are searched for, by a strategy that finds the longest ones.
        how = zstandard.ZstdCompressionParameters.from_level(
            3, dict_size=len(data), source_size=_PART, min_match=3, strategy=zstandard.STRATEGY_BTLAZY2, search_log=5, write_content_size=0, write_checksum=0, write_dict_id=0
        )
        d.precompute_compress(compression_params=how)
        out.append((name, zstandard.ZstdCompressor(dict_data=d, compression_params=how)))
    return out


def predict(text: str | None, models: tuple) -> tuple[str, float]:
    """(language, score): score is the margin to the second, as a share of its size without frames; `und` if text is null or has no letter.

    With one language learned its score is 1, with none the text is `und`. Ties go to the first language by name and score 0.
    """
    if not models or text is None or not any(map(str.isalpha, text)):
        return "und", 0.0
    coders = _coders(models)
    if len(coders) == 1:
        return coders[0][0], 1.0
    data = _normal(text) or text.lower().encode("utf-8", "surrogatepass")
    parts = [data[i : i + _PART] for i in range(0, len(data), _PART)]
    sizes = sorted((sum(len(c.compress(p)) for p in parts), k) for k, (_, c) in enumerate(coders))
    frames = len(coders[0][1].compress(b"")) * len(parts)
    (best, k), (second, _) = sizes[:2]
    return coders[k][0], max(0.0, min(1.0, (second - best) / max(1, second - frames)))


def identify(docs: DataFrame, models: list[tuple[str, bytes]], *, text: str = "text", lang_to: str = "lang_pred", score_to: str = "score", rejected_to: str | None = None, least: float = _MARGIN) -> DataFrame:
    """All rows and columns with lang_pred and score added, from whole texts, and with `rejected_to`, if named: whether a
    text is rejected, as `und` or for a margin (score) under `least`, too narrow to tell.

    A column that has the name of an added one is replaced. Null and empty texts and those without a letter are `und`;
    equal texts have equal results, whatever else their rows hold; no rows, no result.
    """
    from pyspark.sql import types as T

    fixed = tuple(models)
    added = [c for c in (lang_to, score_to, rejected_to) if c is not None]
    keep = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    body = unused([*docs.columns, *added], "text")
    # A text that is a string and stays is not sent twice.
    sent = text in keep and docs.schema[text].dataType == T.StringType()
    at = keep.index(text) if sent else len(keep)
    src = docs.select(*(F.col(f"`{c}`") for c in keep), *([] if sent else [F.col(text).cast("string").alias(body)]))
    more = [T.StructField(c, t) for c, t in ((lang_to, T.StringType()), (score_to, T.DoubleType()), (rejected_to, T.BooleanType())) if c is not None]
    schema = T.StructType([*src.schema.fields[: len(keep)], *more])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [predict(x.as_py(), fixed) for x in batch.column(at)]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            if rejected_to is not None:
                cols.append(pa.array([g[0] == "und" or g[1] < least for g in got], pa.bool_()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *cols], names=[*keep, *added])

    return src.mapInArrow(lean(run), schema)
