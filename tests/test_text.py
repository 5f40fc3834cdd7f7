import hashlib
import json
import unicodedata

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.functions import hashing as H
from corpusloom.functions import text as X


def test_stem_takes_longest_suffix_or_none():
    assert X.stem("ಮನೆಗಳು") == "ಮನೆ"
    assert X.stem("ಮನೆಗಳಲ್ಲಿ") == "ಮನೆ"
    assert X.stem("ಅಗಳು") == "ಅಗಳು"  # one character would be left, though a shorter suffix fits
    assert X.stem("page") == "page"


def test_words_and_stop_words():
    assert X.words("a, b! (c) ಈ।d") == ["a", "b", "c", "ಈ", "d"]
    assert X.content_words("ಈ ಮತ್ತು page") == ["page"]


def test_shingles_short_and_empty():
    assert X.shingles("a b c") == {"a b c"}
    assert X.shingles("ಈ ಆ") == set() and X.shingles("") == set()
    assert len(X.shingles("a b c d e f")) == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc ಮಗಳು.\n", max_size=80), max_size=6))
def test_hasher_has_a_key_for_each_shingle(texts):
    for t, keys in zip(texts, X.ShingleHasher().many(texts)):
        assert len(keys) == len(X.shingles(t)) and (np.diff(keys.astype(object)) > 0).all()


def test_hasher_keys_depend_on_the_shingle_alone():
    a, b, c = X.ShingleHasher().many(["x y z p q r", "w x y z p q", None])
    assert len(set(a.tolist()) & set(b.tolist())) == 1 and len(c) == 0


def test_nfc_forms_agree():
    t = "café a b c d e"
    a, b = X.ShingleHasher().many([t, unicodedata.normalize("NFC", t)])
    assert (a == b).all()


def test_canonical_json_and_chain():
    assert H.canonical({"b": 1, "a": "ಕ"}) == '{"a":"ಕ","b":1}'
    want = hashlib.sha256(b'GENESIS|{"a":1}').hexdigest()
    assert H.link(None, {"a": 1}) == want == H.link("GENESIS", {"a": 1})


def test_columns_equal_python(spark):
    from pyspark.sql import functions as F

    df = spark.range(50).withColumn("k", H.key_hex(1337, "root", 0, "p", F.col("id")))
    for r in df.select("id", "k", H.unsigned(F.col("k")).alias("u"), H.uniform_column(F.col("k"), F.col("id")).alias("x")).collect():
        k = H.key(1337, "root", 0, "p", r.id)
        assert int(r.u) == k == int(r.k, 16) and r.x == H.uniform(k, r.id) and 0 <= r.x < 1


def test_batch_hash_has_no_order(spark):
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(["b", "a"],), (["a", "b"],)], "ids array<string>").select(H.batch_hash_column(F.col("ids")).alias("h")).collect()
    assert r[0].h == r[1].h == H.sha256(json.dumps({"seq_ids": ["a", "b"]}, separators=(",", ":")))
