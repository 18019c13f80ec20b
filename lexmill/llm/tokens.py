"""Sizes in tokens of a public tokenizer, whose vocabulary files stay where they are."""

from __future__ import annotations

import base64
import importlib.util
import sys
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@cache
def encoder(folder: str = FOLDER, vocabulary: str = VOCABULARY):
    """The byte-level BPE of a vocabulary file, with the pattern that its folder's module states."""
    import tiktoken

    spec = importlib.util.spec_from_file_location("_token_files", Path(folder) / "__init__.py")
    module = importlib.util.module_from_spec(spec)
    sys.modules["_token_files"] = module
    spec.loader.exec_module(module)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, (Path(folder) / vocabulary).open("rb"))}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={})


def n_tokens_of(text: str | None, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> int:
    """The size of a text; 0 for null. The whole text is measured as one, as merging takes time nearly in proportion to it."""
    return len(encoder(folder, vocabulary).encode_ordinary(text)) if text else 0


def n_tokens(text: Column | str, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> Column:
    """The size of a text column in tokens."""

    @F.pandas_udf(T.LongType())
    def size(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: n_tokens_of(t, folder, vocabulary)).astype("int64")

    return size(F.col(text) if isinstance(text, str) else text)
