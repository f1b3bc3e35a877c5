"""Texts tokenized in one call get their own ids: boundaries by bytes, by word numbers where a vocabulary does not keep the bytes."""

from __future__ import annotations

import numpy as np

from driftwatch.llm.packing import Tokens
from driftwatch.llm.queries import VOCABULARY

TEXTS = ["", " word", "", "été", " x y", " 12345", " \U0001f600!?", "\t\n", " naïve", " ", ""]


def test_boundaries():
    tokens = Tokens(VOCABULARY)
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in TEXTS]
    slow = []
    real = tokens.tokenizer

    class Counting:
        """Counts the calls that ask for word numbers."""

        encode_batch_fast = staticmethod(real.encode_batch_fast)

        @staticmethod
        def encode_batch(*args, **options):
            slow.append(1)
            return real.encode_batch(*args, **options)

    tokens.tokenizer = Counting
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens._encoded(TEXTS)] == want and not slow
    tokens.sizes = tokens.sizes + 1
    assert [np.frombuffer(ids, "<u4").tolist() for ids in tokens._encoded(TEXTS)] == want and slow
    assert tokens._encoded([]) == []
