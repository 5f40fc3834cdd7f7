"""A public vocabulary with specials appended."""

import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import external as E

RANKS = os.environ.get("TOKENIZER_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")


@pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary")
def test_round_trip_and_specials(spark):
    texts = ["plain words, 12 of them", "ಕನ್ನಡ ಪಠ್ಯ 🙂", "", None, "a <|pad|> in a text"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").withColumn("ids", E.encode(F.col("t"), RANKS))
    assert {r.k: r.back for r in df.select("k", E.decode(F.col("ids"), RANKS).alias("back")).collect()} == dict(enumerate(texts))
    enc = E.encoding(RANKS)
    pad, doc = enc.encode_single_token("<|pad|>"), enc.encode_single_token("<|doc|>")
    assert doc == pad + 1 == enc.n_vocab - 1 and E.spelled(pad, RANKS) == "<|pad|>"
    assert pad not in df.where("k = 4").collect()[0].ids
