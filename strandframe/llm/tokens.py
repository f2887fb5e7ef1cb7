"""Token counts with a public tokenizer, in Arrow batches."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of a byte-level BPE; the path is a parameter of every function here.
RANKS = os.environ.get("STRANDFRAME_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: The split before the merges, as published with the ranks.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(ranks: str = RANKS):
    import tiktoken

    with open(ranks, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def token_count(text: Column, ranks: str = RANKS) -> Column:
    """Tokens of a text; 0 for an empty or null one."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(ranks)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)
