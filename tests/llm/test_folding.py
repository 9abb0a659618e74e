"""Folding before the tokenizer leaves its tokens as they are."""

import unicodedata

import pyarrow as pa
from tokenizers import Tokenizer

from kerbline.llm import packing
from kerbline.llm.queries import word_vocabulary

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def test_capitals_with_marks_keep_their_tokens():
    tokenizer = Tokenizer.from_str(word_vocabulary())
    texts = [f"{c}{mark}amas {c} Plain" for c in LETTERS for mark in map(chr, range(0x300, 0x370))] + ["H̱᷀amas", "KELVIN Å", "<|endoftext|> B", "PLAIN\nText"]
    for text, folded in zip(texts, packing._folded(pa.array(texts, pa.large_string())).to_pylist()):
        assert tokenizer.encode(folded).ids == tokenizer.encode(text).ids, ascii(text)
    assert packing._folded(pa.array(["PLAIN\nText é"], pa.large_string())).to_pylist() == ["plain text é"]


def test_no_other_character_composes_with_a_letter():
    composing = {i for i in range(0x110000) if not 0xD800 <= i < 0xE000 for c in "Hhk" if unicodedata.normalize("NFC", c + chr(i))[0] != c}
    composing |= {i for i in range(0x80, 0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.combining(unicodedata.normalize("NFD", chr(i))[0]) and any(len(unicodedata.normalize("NFC", c + chr(i))) < 2 for c in LETTERS)}
    assert composing and all(0x300 <= i <= 0x36F for i in composing)
