"""Token ids by a public tokenizer, over Arrow batches."""

from __future__ import annotations

import os
import sys
import types

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The end of a turn.
END_ID = 1


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _loaded(path: str):
    """The tokenizer of a path, read once in a process: kept in a module of its own, since this one reaches executors by value."""
    kept = sys.modules.setdefault("_tracewright_tokens", types.ModuleType("_tracewright_tokens")).__dict__
    if path not in kept:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        kept[path] = Tokenizer.from_file(path)
    return kept[path]


def ids_of(texts: pd.Series, path: str) -> pd.Series:
    """Ids of each text as an array. What the tokenizer makes beside ids is held for one text at a time."""
    encode = _loaded(path).encode
    return pd.Series([np.array(encode(t or "", add_special_tokens=False).ids, np.int32) for t in texts], dtype=object)


def token_ids(text: Column, path: str | None = None) -> Column:
    """Ids of a text; none of a null one."""
    path = path or tokenizer_path()

    @F.pandas_udf("array<int>")
    def run(texts: pd.Series) -> pd.Series:
        return ids_of(texts, path)

    return run(text)
