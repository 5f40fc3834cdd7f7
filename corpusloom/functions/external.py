"""Public byte-pair vocabularies with special tokens appended, as column functions. Only the path of a rank file is given; it is read once in each Python worker."""

from __future__ import annotations

import base64
from functools import cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The public split pattern of byte-level vocabularies, the special tokens appended in this order.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SPECIALS = ("<|endoftext|>", "<|pad|>", "<|doc|>")


@cache
def encoding(path: str, specials: tuple[str, ...] = SPECIALS):
    """The encoding of a rank file (base64 piece, rank), specials numbered behind its ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={s: len(ranks) + k for k, s in enumerate(specials)})


def encode(text, path: str):
    """Column: the ids of a text; special tokens' strings in it are ordinary text. Null stays null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def run(s: pd.Series) -> pd.Series:
        enc = encoding(path)
        return s.map(lambda t: None if t is None else enc.encode_ordinary(t))

    return run(text)


def decode(ids, path: str):
    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        enc = encoding(path)
        return s.map(lambda x: None if x is None else enc.decode([int(i) for i in x]))

    return run(ids)


def spelled(token: int, path: str) -> str:
    """One id as text, for reading: a special token by its name, bytes that are no text replaced."""
    return encoding(path).decode_single_token_bytes(token).decode("utf-8", "replace")
