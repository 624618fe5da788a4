"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once by a worker.

A vocabulary splits a text into pieces and encodes each on its own, and words repeat. So for texts of the Latin
blocks below U+0180, where one pattern splits as the vocabulary does, a worker keeps the ids that the library's model
gave to the pieces it has met. Any other text, and one that holds an added token of the vocabulary, goes through the
library whole. `tests/llm/test_tokens.py` holds both ways against the library with nothing set.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array

_LATIN = [chr(c) for c in range(0x180)]
_LETTER = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "L")
_NUMBER = "".join(c for c in _LATIN if unicodedata.category(c)[0] == "N")
_SPACE = "\t-\r \x85\xa0"
_OTHER = {"bytes": re.compile("[^\x00-ſ]"), "words": re.compile("[^\x00-įı-ſ]")}
#: The patterns by which the two public vocabularies split a text, for these characters.
_PIECES = {
    "bytes": re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+").findall,
    "words": re.compile(f"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_NUMBER}]").findall,
}


#: Pieces whose ids a worker keeps, about 230 bytes each.
_MOST = {"bytes": 150_000, "words": 500_000}


class _Known(dict):
    """Ids, as bytes, of the pieces met so far: words repeat. Beyond `most` pieces it starts anew; LONGEST characters are held."""

    LONGEST = 48

    def __init__(self, encode, most):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, piece):
        ids = self.encode(piece)
        if len(piece) <= self.LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _char_of_byte() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves,
    the others for U+0100 and up in turn."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str, style: str):
    """text -> numpy array of its ids (uint32), those of the library for add_special_tokens=False. style: "bytes" for a
    byte-level, "words" for a vocabulary of lower-cased words."""
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        added = [re.escape(x["content"]) for x in json.load(f)["added_tokens"]]
    other, holds = _OTHER[style].search, re.compile("|".join(added) or r"(?!)").search
    pieces, lower, stand_in, tokenize = _PIECES[style], style == "words", _char_of_byte(), tok.model.tokenize

    def ids_of(piece):
        # Printable ASCII but the blank stands for itself.
        own = piece if piece.isascii() and piece.isprintable() and " " not in piece else piece.encode().decode("latin-1").translate(stand_in)
        return array("I", [t.id for t in tokenize(own)]).tobytes()

    known = _Known(ids_of, _MOST[style])

    def encode(text: str):
        if other(text) or holds(text):
            return np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(known.__getitem__, pieces(text.lower() if lower else text))), "<u4")

    return encode
