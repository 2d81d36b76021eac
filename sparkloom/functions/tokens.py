"""Exact token counts where a model's vocabulary file is given, else the estimate."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.text import tokens_estimated


@lru_cache(maxsize=4)
def _encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def count_tokens(text: Column, model: str | None, files: dict[str, str], pattern: str, bytes_per_token: float = 3.3) -> Column:
    """Tokens of a text (null: none). files: of each model the rank file of its vocabulary; others are estimated."""
    if model not in files:
        return tokens_estimated(text, bytes_per_token)
    with open(files[model], "rb") as f:
        ranks = f.read()

    @F.pandas_udf("int")
    def run(texts: pd.Series) -> pd.Series:
        encoding = _encoding(ranks, pattern)
        return texts.fillna("").map(lambda t: len(encoding.encode_ordinary(t)))

    return run(text)
