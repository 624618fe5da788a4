"""Token ids against the tokenizers library as it is read from the vocabulary file, with nothing set."""

import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from terrane.llm import tokens
from terrane.llm.tokens import encoder, vocabulary

BOTH = [("byte_bpe_50k.json", "bytes"), ("word_bpe_49k.json", "words")]


def _plain(name):
    tok = Tokenizer.from_file(vocabulary(name))
    return lambda text: tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "style"), BOTH)
def test_ids_equal_those_of_the_library(name, style):
    plain, encode, rng = _plain(name), encoder(vocabulary(name), style), random.Random(2)
    alphabets = [" \n\t\r\x01\x1c\x1f\x85\xa0aZé'sÀ1²½.<|endoftext|>İıŸſĸßµª", "   ΣσςİK中​_-ﬁ🙂a'LL ́\n", "abcdefghijklmnopqrstuvwxyz ,.'THE"]
    for alphabet in alphabets:
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert encode(text).tolist() == plain(text), repr(text)


@pytest.mark.parametrize(("name", "style"), BOTH)
def test_added_tokens_in_a_text_get_their_own_ids(name, style):
    plain, encode = _plain(name), encoder(vocabulary(name), style)
    for text in ("a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|ENDOFTEXT|>", "<|endoftext |>", "é<|endoftext|><|endoftext|>"):
        assert encode(text).tolist() == plain(text), text
    assert {50256, 49407} & set(encode("a <|endoftext|> b").tolist())


@pytest.mark.parametrize(("name", "style"), BOTH)
def test_whole_documents_and_long_pieces(name, style):
    plain, encode = _plain(name), encoder(vocabulary(name), style)
    texts = [t for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist() if t]
    for text in [*texts, "x" * 5000, "éà" * 3000, " " * 3000, "\n" * 500 + "a", ""]:
        assert encode(text).tolist() == plain(text), text[:80]


@pytest.mark.parametrize(("name", "style"), BOTH)
def test_a_worker_keeps_the_ids_of_many_words(name, style):
    """Beyond what is held the library's model is asked again: a vocabulary of 200,000 words was, each time through."""
    made, asked = encoder.__wrapped__(vocabulary(name), style), []
    known = next(c.cell_contents for c in made.__closure__ if isinstance(c.cell_contents, tokens._Known))
    ids_of = known.encode
    known.encode = lambda piece: asked.append(piece) or ids_of(piece)
    n = 200_000 if style == "words" else 100_000
    words = ["".join(chr(97 + v // 26**k % 26) for k in range(4)) for v in range(n)]
    first = [made(" ".join(words[s : s + 1000])).tolist() for s in range(0, n, 1000)]
    seen = len(asked)
    assert [made(" ".join(words[s : s + 1000])).tolist() for s in range(0, n, 1000)] == first
    assert n <= seen == len(asked) <= known.most
