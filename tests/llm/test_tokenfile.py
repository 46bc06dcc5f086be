"""Ids of texts of any characters are the library's."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilmark.llm import tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def agree():
    library, encoder = Tokenizer.from_file(PATH), tokenfile.PieceEncoder(PATH)

    def check(texts):
        ids, bounds = encoder.encode([None if t is None else t.encode() for t in texts], 2)
        want = [e.ids + [2] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert [ids[a:z].tolist() for a, z in zip(bounds[:-1], bounds[1:])] == want

    return check


def test_every_code_point_beside_others(agree):
    points = [*range(1, 0x3000), *range(0xA000, 0xD7FF, 7), *range(0xE000, 0x11000, 3), *range(0x11000, 0x1F000, 17)]
    for k in range(0, len(points), 500):
        agree([form.format(chr(c)) for c in points[k : k + 500] for form in ("{}", "A{0}", "{0}A", "a{0}B{0}", "1{0}2", "{0}.{0}", "' {0}'s", "é{0}́")])


def test_special_tokens_contractions_and_marks(agree):
    agree(
        ["<|endoftext|>x <|startoftext|>", "a<|b|>C", "<|ENDOFTEXT|> É", "It's WE'LL 'S 1234 '' 'sun a'.b \"'s", "É ΑΣ Σ. ΟΔΟΣ İ ŉ", "é ́x Á.B"]
        + ["\x01 a\x01b é\x01", "a b c\x85d", "1́2é3", "", " ", None, "\x1c\x1d a\x1fb", "x" * 5_000, "é" * 2_500]
    )


def test_texts_of_mixed_characters(agree):
    rng = random.Random(1)
    agree(["".join(rng.choice("aAbZ09 .,'\n\t<|>éÉǘ あ\x01sStT_-") for _ in range(rng.randrange(60))) for _ in range(5000)])
    agree([])


def test_the_cache_may_start_anew(agree, monkeypatch):
    monkeypatch.setattr(tokenfile, "CACHE", 3)
    for text in ("one two three four five", "two six seven", "one two"):
        agree([text, None, text.upper()])
