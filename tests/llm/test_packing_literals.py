"""Texts with the literal of a special token have the ids of a plain call of the tokenizer."""

from __future__ import annotations

import struct

from tokenizers import Tokenizer

from driftwatch.llm import packing
from driftwatch.llm.queries import VOCABULARY


def test_literals_of_added_tokens():
    plain = Tokenizer.from_file(VOCABULARY)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "", "no literal, a  b", "x<|endoftext|>y <|endoftext| z", "<|endoftext|> a\n b."]
    want = [struct.pack(f"<{len(e.ids)}I", *e.ids) for e in plain.encode_batch(texts, add_special_tokens=False)]
    assert len(want[0]) == 4 * 4
    assert packing.Tokens(VOCABULARY).ids(texts) == want
