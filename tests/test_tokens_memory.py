"""Token ids hold one text's encoding at a time."""

import numpy as np
import pandas as pd

from tracewright.functions import tokens


class Encoding:
    alive = most = 0

    def __init__(self, text):
        self.ids = [len(w) for w in text.split()]
        Encoding.alive += 1
        Encoding.most = max(Encoding.most, Encoding.alive)

    def __del__(self):
        Encoding.alive -= 1


class Tokenizer:
    def encode(self, text, add_special_tokens):
        return Encoding(text)

    def encode_batch(self, texts, add_special_tokens):
        return [self.encode(t, add_special_tokens) for t in texts]


def test_one_encoding_at_a_time(monkeypatch):
    monkeypatch.setattr(tokens, "_loaded", lambda path: Tokenizer())
    found = tokens.ids_of(pd.Series(["a bc", None, "", "d"] * 500), "")
    assert Encoding.most <= 2
    assert [x.tolist() for x in found[:4]] == [[1, 2], [], [], [1]] and all(x.dtype == np.int32 for x in found)
