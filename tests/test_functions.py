import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import annotations as N
from corpusloom.functions import arrays as A
from corpusloom.functions import numbers as B
from corpusloom.operators import shards
from corpusloom.operators import tokenizer as TK
from corpusloom.sources import formats as S


def one(spark, column, **values):
    df = spark.range(1).select(*[v.alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).collect()[0].x


def test_array_edges(spark):
    empty, few = F.array().cast("array<int>"), F.array(F.lit(5))
    assert one(spark, A.shifted("t"), t=empty) == [] and one(spark, A.shifted("t"), t=few) == []
    assert one(spark, A.padded("t", 3), t=few) == [5, 0, 0] and one(spark, A.padding_mask("t", 3), t=few) == [1, 0, 0]
    assert one(spark, A.jaccard("t", "u"), t=empty, u=empty) == 1.0
    assert [tuple(r) for r in one(spark, A.top_k("t", 2), t=F.array(F.lit(3), F.lit(9), F.lit(9)))] == [(9, 1), (9, 2)]
    assert one(spark, A.boundary_targets("t", "b"), t=F.array(*map(F.lit, (7, 8, 9, 0))), b=F.array(*map(F.lit, (0, 0, 1, -1)))) == [8, -100, -100]


def test_softmax_masks_nulls(spark):
    got = one(spark, A.softmax("t"), t=F.array(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0)))
    assert got == [0.5, 0.0, 0.5]


def test_adam_published_value(spark):
    g = F.array(*map(F.lit, (0.1, -0.2, 0.3, 0.05, -0.15)))
    assert abs(one(spark, A.adam("g", 0.5, lr=0.001), g=g) - 0.49858944) < 1e-7


def test_common_prefix(spark):
    assert one(spark, A.common_prefix(F.col("a"), F.col("b")), a=F.lit("abcd"), b=F.lit("abxd")) == 2
    assert one(spark, A.common_suffix(F.col("a"), F.col("b")), a=F.lit("abcd"), b=F.lit("abxd")) == 1
    assert one(spark, A.common_prefix(F.col("a"), F.col("b")), a=F.lit(""), b=F.lit("x")) == 0


def test_posit_patterns():
    assert B.to_posit16(np.array([1.0, math.nan, 0.0, -1e-300, math.inf])).tolist() == [0x4000, 0x8000, 0, 0, 0x8000]
    every = np.array([b for b in range(1, 65536) if b != 0x8000])
    assert (B.to_posit16(B.from_posit16(every)) == every).all()
    x = np.random.default_rng(1).uniform(-4, 4, 3000)
    assert (abs(B.from_posit16(B.to_posit16(x)) - x) <= 2e-3 * abs(x) + 1e-6).all()
    assert np.isnan(B.from_posit16(np.array([0x8000]))).all() and B.from_posit16(np.array([0, 0x4000])).tolist() == [0.0, 1.0]


def test_byte_embedding_is_invertible():
    e = B.ByteEmbedding(256, 16, rounds=50)
    rng = random.Random(1)
    data = [rng.randbytes(rng.randint(1, 16)) for _ in range(400)]
    assert e.decode(e.encode(data)) == data and 0 < e.coherence < 1
    with pytest.raises(ValueError):
        e.encode([b""])


def test_bpe_small(spark):
    t = TK.train(spark.createDataFrame([("aaab",), ("aaab",), (None,)], "text string"))
    assert t.merges[0] == (101, 101) and t.decode(t.encode("aaab")) == "aaab"
    assert TK.train(spark.createDataFrame([], "text string")).merges == ()
    assert t.freeze_hash() != TK.Tokenizer(t.merges, "other").freeze_hash()
    df = spark.createDataFrame([("éx",), (None,), ("",)], "text string").withColumn("ids", t.encode_column("text"))
    assert [r.x for r in df.select(t.decode_column("ids").alias("x")).collect()] == ["éx", None, ""]


def test_whole_names_pass_the_byte_embedding(spark, tmp_path):
    from corpusloom.plans import core_queries

    assert (B.byte_embedding().width, B.byte_embedding().length) == (768, 32)
    names = ["Customer#000000001", "ಹೆಸರು" * 9, "x" * 32, "y" * 33, "", None]
    spark.createDataFrame(list(enumerate(names)), "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    df = core_queries()["byte_embedding_roundtrip"](spark, str(tmp_path))
    assert {(r.c_custkey, r.name) for r in df.collect()} == {(k, x) for k, x in enumerate(names) if x}


def slow_merges(texts, most, start=260):
    seqs, found = [[b + 4 for b in x.encode()] for x in texts], []
    while len(found) < most:
        n = {}
        for s in seqs:
            for p in zip(s, s[1:]):
                n[p] = n.get(p, 0) + 1
        pair = min(n, key=lambda p: (-n[p], p), default=None)
        if pair is None or n[pair] < 2:
            break
        for k, s in enumerate(seqs):
            r, i = [], 0
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == pair
                r.append(start + len(found) if hit else s[i])
                i += 1 + hit
            seqs[k] = r
        found.append(pair)
    return found, seqs


def test_bpe_trains_to_the_whole_vocabulary(spark, data):
    from corpusloom.operators import roles
    from corpusloom.plans import core_queries, corpus

    got = [(r.a, r.b) for r in core_queries()["bpe_merges"](spark, data).orderBy("rank").collect()]
    rows = roles.assign(corpus.docs(spark, data).where("text is not null")).where("role = 'TRAIN'").collect()
    want, seqs = slow_merges([unicodedata.normalize("NFC", r.text) for r in rows], 252)
    assert len(got) == 252 and got == want
    t = TK.Tokenizer(tuple(got))
    assert t.encode_many([r.text for r in rows]) == [[1, *s, 2] for s in seqs]


def test_bpe_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 40))) for _ in range(30)]
    got = TK.train(spark.createDataFrame([(x,) for x in texts], "text string"), vocab_size=TK.FIRST_MERGE + 6, ahead=2).merges
    seqs, want = [[b + 4 for b in x.encode()] for x in texts], []
    for k in range(6):
        n = {}
        for s in seqs:
            for p in zip(s, s[1:]):
                n[p] = n.get(p, 0) + 1
        pair = min(n, key=lambda p: (-n[p], p))
        want.append(pair)
        out = []
        for s in seqs:
            r, i = [], 0
            while i < len(s):
                hit = i + 1 < len(s) and (s[i], s[i + 1]) == pair
                r.append(260 + k if hit else s[i])
                i += 1 + hit
            out.append(r)
        seqs = out
    assert list(got) == want


def test_anchor():
    assert N.find_anchor("one two one two", "two", "e ", "", 0) == 4
    assert N.find_anchor("x two y two", "two", "y ", "", 0) == 8
    assert N.find_anchor("two two", "two", "", "", 4) == 4
    assert N.find_anchor("abc", "zz", "", "", 0) is None and N.find_anchor("abc", "", "", "", 0) is None and N.find_anchor(None, "a", None, None, None) is None


def test_mapped_positions(spark):
    at = lambda p, after: one(spark, N.mapped(F.lit(p), F.lit(5), F.lit(8), F.lit(2), after))
    assert at(3, True) == 3 and at(10, True) == 9 and at(6, True) == 7 and at(6, False) == 5


def test_token_files(spark, tmp_path):
    spark.dataSource.register(S.TokenFiles)
    p = str(tmp_path / "a.bin")
    S.write_token_file(p, list(range(50)))
    got = spark.read.format("tokens").option("path", str(tmp_path)).option("block", 16).load().orderBy("block").collect()
    assert [len(r.tokens) for r in got] == [16, 16, 16, 2] and got[3].tokens == [48, 49]
    assert spark.read.format("tokens").option("path", p).option("limit", 20).load().count() == 1
    (tmp_path / "b.bin").write_bytes(b"\0" * 2000)
    with pytest.raises(ValueError):
        S.token_count(str(tmp_path / "b.bin"))


def test_shards_round_trip_and_tampering(spark, tmp_path):
    docs = spark.createDataFrame([("b", "l", [4, 5]), ("a", "l", [1, 2, 3]), ("c", "m", [65535])], "doc_id string, lane string, tokens array<int>")
    shards.write_shards(docs, str(tmp_path), "t").collect()
    got = {r.doc_id: r.tokens for r in shards.read_shards(spark, f"file://{tmp_path}").collect()}
    assert got == {"a": [1, 2, 3], "b": [4, 5], "c": [65535]}
    f = tmp_path / "shard-TRAIN-l-000000.bin"
    data = f.read_bytes()
    f.write_bytes(bytes([data[0] ^ 1]) + data[1:])
    with pytest.raises(Exception, match="content hash mismatch"):
        shards.read_shards(spark, f"file://{tmp_path}").collect()
    f.write_bytes(data)
    assert shards.read_shards(spark, f"file://{tmp_path}").count() == 3


def test_corpus_and_ingest(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"doc_id":"1","tier":"verified","type":"web","text":" a "}\n\n{"doc_id":"2","tier":"verified","type":"web","text":" "}\n{"doc_id":"3","tier":"unverified","type":null,"text":"b"}\n')
    docs = S.read_corpus(spark, str(tmp_path / "c.jsonl"))
    assert docs.count() == 3
    got = S.ingest(docs, {("verified", "web"): 5, ("unverified", None): 1}, "s:").orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in got] == [("s:unverified:x-3", "b"), ("s:verified:web-1", "a")]


def test_state_file(tmp_path):
    p = str(tmp_path / "s.json")
    S.save_state(p, {"a": 1})
    assert S.load_state(p, {"a": 0, "b": 2}) == {"a": 1, "b": 2}
    (tmp_path / "s.json").write_text((tmp_path / "s.json").read_text().replace('"a": 1', '"a": 2'))
    with pytest.raises(ValueError):
        S.load_state(p)


def test_marked_block():
    assert S.replace_block("x <!-- t:start -->old<!-- t:end --> y", "t", ["1", "2"]) == "x <!-- t:start -->\n1\n2\n<!-- t:end --> y"
