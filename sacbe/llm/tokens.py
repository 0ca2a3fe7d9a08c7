"""Sizes of texts in tokens of a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE vocabulary as ranks; every machine of a cluster has it at the same place.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How texts are cut before merging (the pattern published with the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a ranks file, read once per Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str | None, path: str = TOKENIZER) -> int:
    return len(encoder(path).encode_ordinary(text)) if text else 0


def token_sizes(df: DataFrame, id_col: str, text_col: str, path: str = TOKENIZER) -> DataFrame:
    """id and tokens of each row; null and blank texts have 0 or their few blanks' tokens."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"].to_numpy(), "tokens": [token_count(t, path) for t in b["text"]]})

    return df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id bigint, tokens bigint")
