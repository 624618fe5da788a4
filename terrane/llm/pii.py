"""Personal data in texts, with DataFrame functions only: patterns propose, checksums confirm, context scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed values by kind, in the order of output: pattern, digits it must have, first score, context words before it.
#: The first four are the base patterns. They are written with look-behinds and possessive quantifiers that leave
#: their leftmost matches as they are but read a long run of letters or digits once, not once for each place in it.
_KINDS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", None, 0.8, "mail|contact|write to|kontakt|correo|courriel"),
    "ip": (r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++", None, 0.6, "ip|host|address|server|adresse"),
    "card": (r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])", (12, 19), 0.7, "card|visa|credit|karte|carte|tarjeta"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", (9, 15), 0.6, "phone|call|tel|mobile|fax"),
    "iban": (r"[A-Z](?<![A-Za-z0-9][A-Z])[A-Z][0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", None, 0.7, "iban|account|konto|compte|cuenta"),
    "ssn": (r"[0-9](?<![0-9-][0-9])[0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9-])", None, 0.3, "ssn|social security|tax id"),
}
_BASE = ("email", "ip", "card", "phone")
#: Characters before a span in which context words count, and the score that a span of an added kind must reach.
_NEAR, _LEAST = 40, 0.5
#: Marks the ends of matches. No pattern can match it; where a text holds it, it is read as U+0002.
_MARK, _INSTEAD = "\x01", "\x02"


def _luhn(digits: str) -> str:
    one = f"cast(substring({digits}, length({digits}) - i, 1) as int) * (1 + i % 2)"
    return f"aggregate(sequence(0, length({digits}) - 1), 0, (t, i) -> t + {one} - if({one} > 9, 9, 0)) % 10 = 0"


def _mod97(value: str) -> str:
    chars = f"concat(substring({value}, 5), substring({value}, 1, 4))"
    code = f"instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substring({chars}, i, 1)) - 1"
    return f"aggregate(sequence(1, length({value})), 0, (t, i) -> (t * if({code} > 9, 100, 10) + {code}) % 97) = 1"


def _confirmed(kind: str) -> str:
    """SQL condition on a span s: digit counts and checksums."""
    digits, count = "translate(s.value, ' ().+-', '')", _KINDS[kind][1]
    tests = [] if count is None else [f"length({digits}) between {count[0]} and {count[1]}"]
    if kind == "card":
        tests.append(_luhn(digits))
    if kind == "ip":
        tests.append("forall(split(s.value, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)")
    if kind == "iban":
        tests.append("length(translate(s.value, ' ', '')) between 15 and 34")
        tests.append(_mod97("translate(s.value, ' ', '')"))
    if kind == "ssn":
        tests.append("s.value not rlike '^(000|666|9)' and s.value not rlike '-00-' and s.value not like '%-0000'")
    return " and ".join(tests) or "true"


def _spans(text: str, kind: str) -> Column:
    """Array of (start, rank, end, kind, score) of one kind, from a column without marks.

    Matches are set off by marks, the text is cut at these, and a running sum of the parts' lengths gives the places,
    so the work grows little faster than a text and its matches.
    """
    pattern, _, score, words = _KINDS[kind]
    rank = list(_KINDS).index(kind)
    quoted = pattern.replace("\\", "\\\\")
    parts = f"split(regexp_replace({text}, '({quoted})', '{_MARK}$0{_MARK}'), '{_MARK}')"
    kinds, heads = "array<struct<start:int,value:string,before:string>>", "array<struct<at:int,before:string>>"
    # Appending copies a list, so a list of n entries is made in about sqrt(n) slices: an even number of parts each, so that
    # every slice begins outside a match. First where each slice begins, then the matches of each.
    cut = "greatest(1, cast(sqrt(size(p)) as int)) * 2"
    slices = f"transform(sequence(0, (size(p) - 1) div ({cut})), k -> slice(p, k * {cut} + 1, {cut}))"
    begins = (
        f"aggregate(q, struct(0 as at, '' as before, cast(array() as {heads}) as got), (a, l) -> struct(a.at + length(array_join(l, '')) as at, right(concat(a.before, right(array_join(l, ''), {_NEAR})), {_NEAR}) as before, "
        "array_append(a.got, struct(a.at as at, a.before as before)) as got), a -> a.got)"
    )
    within = (
        f"aggregate(l, struct(h.at as at, false as hit, h.before as before, cast(array() as {kinds}) as got), (a, x) -> struct(a.at + length(x) as at, not a.hit as hit, right(concat(a.before, right(x, {_NEAR})), {_NEAR}) as before, "
        "if(a.hit, array_append(a.got, struct(a.at as start, x as value, a.before as before)), a.got) as got), a -> a.got)"
    )
    found = f"flatten(transform(transform(array({parts}), p -> {slices}), q -> flatten(zip_with(q, {begins}, (l, h) -> {within}))))"
    near = f"if(lower(s.before) rlike '(^|[^a-z])({words})', 0.2D, 0D)"
    checked = "0.1D" if kind in ("card", "iban") else "0D"
    scored = f"transform(filter({found}, s -> {_confirmed(kind)}), s -> struct(s.start as start, {rank} as rank, s.start + length(s.value) as `end`, '{kind}' as kind, {score}D + {checked} + {near} as score))"
    if kind not in _BASE:
        scored = f"filter({scored}, s -> s.score >= {_LEAST}D)"
    need = {"email": "@", "phone": "+", "ip": "."}.get(kind)
    return F.expr(scored if need is None else f"if(instr({text}, '{need}') > 0, {scored}, cast(array() as array<struct<start:int,rank:int,`end`:int,kind:string,score:double>>))")


def find_personal(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores, found): one row per row, whole texts.

    found is an array of (start, rank, end, kind, score) by start, then kind; spans and scores are its text forms;
    the counts and base_sha256 are of the four base kinds alone. Added kinds (IBAN by mod-97, social security numbers
    by form) need a score of _LEAST, which the latter reach by a context word only. Null text counts as empty: no spans.
    doc_ids may be null or repeat; no rows, no result. Places count code points, ends are exclusive. A very long text
    is read whole, in one row of one task.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _MARK, _INSTEAD).alias("__t"))
    out = out.select("doc_id", *(_spans("__t", k).alias(f"__{k}") for k in _KINDS))
    base, more = ([f"__{k}" for k in _KINDS if (k in _BASE) == b] for b in (True, False))
    out = out.withColumn("__base", F.array_sort(F.concat(*base)))
    out = out.withColumn("found", F.array_sort(F.concat("__base", *more)))
    named = lambda c: F.expr(f"array_join(transform({c}, s -> concat_ws(':', s.kind, s.start, s.`end`)), ',')")
    return out.select(
        "doc_id",
        *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in _BASE),
        F.sha2(named("__base").cast("binary"), 256).alias("base_sha256"),
        named("found").alias("spans"),
        F.expr("array_join(transform(found, s -> format_number(s.score, '0.0')), ',')").alias("scores"),
        "found",
    )
