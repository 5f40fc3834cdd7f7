"""The pipeline, the audits' evidence and the folds over ranges, on small fixtures."""

import json
import random

import numpy as np

from corpusloom.operators import audit as A
from corpusloom.operators import pipeline, roles, shards
from corpusloom.operators import series as S
from corpusloom.sources import synthetic

DOCS = "doc_id string, tier string, type string, text string"


def test_pipeline(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"d{k:03d}", "verified", "web", " ".join(rng.choice(["ಮನೆ", "ಊರು", "ನದಿ", "ಮಳೆ", "x y"]) for _ in range(40))) for k in range(60)]
    rows += [("z", "verified", "web", rows[0][3]), ("e", "verified", "web", ""), ("n", "other", None, "one two three four five six"), ("t", None, None, None)]
    c = pipeline.build(spark.createDataFrame(rows, DOCS), str(tmp_path))
    docs = {r.doc_id: r for r in c.docs.collect()}
    assert "z" not in docs and "t" not in docs and {r.role for r in docs.values()} <= {"TRAIN", "VALIDATION", "EVAL", "PROXY", "QUARANTINE"}
    m = c.manifests.collect()
    assert [r.role for r in m][-1] == "EVAL" and m[-1].token_count == 0 and m[0].parent_manifest_hash == "GENESIS"
    assert all(b.parent_manifest_hash == a.manifest_hash for a, b in zip(m, m[1:]))
    assert all(json.loads((tmp_path / f"{r.shard_id}.json").read_text())["manifest_hash"] == r.manifest_hash for r in m)
    back = {r.doc_id: r.tokens for r in shards.read_shards(spark, f"file://{tmp_path}").collect()}
    assert back == {r.doc_id: r.tokens for r in c.tokens.collect()} and all(docs[i].role != "EVAL" for i in back)
    assert all(c.tokenizer.decode(t) == docs[i].text for i, t in back.items())
    assert {d.split("::")[0] for r in c.packed.collect() for d in r.doc_ids_present} == {i for i in back if docs[i].role == "TRAIN"}


def test_pipeline_of_nothing(spark):
    c = pipeline.build(spark.createDataFrame([], DOCS))
    assert c.manifests.count() == c.packed.count() == c.docs.count() == 0 and c.tokenizer.merges == ()


def test_evidence(spark, tmp_path):
    bad = spark.createDataFrame([("d", "EVAL")], "doc_id string, role string")
    bundle = A.evidence(A.finding("gate", roles.rejected(bad, "training"), "none stopped").unionByName(A.finding("none", bad.limit(0), "empty")))
    assert not bundle["all_passed"] and [(f["name"], f["faults"]) for f in bundle["findings"]] == [("gate", 1), ("none", 0)]
    A.write_evidence(bundle, str(tmp_path))
    assert {(r.name, r.passed) for r in A.read_log(spark, str(tmp_path / "run.log")).collect()} == {("gate", False), ("none", True)}
    assert "Overall: FAIL" in (tmp_path / "findings.md").read_text() and json.loads((tmp_path / "findings.json").read_text()) == bundle


def series(spark):
    rng = random.Random(3)
    rows = [("a", k, None if rng.random() < 0.1 else rng.choice([1.0, 2.0, rng.random()])) for k in range(500)] + [("b", 7, 3.0), ("c", 1, None), ("c", 2, 5.0), ("n", 1, None)]
    return rows, spark.createDataFrame(rows, "run string, step int, value double")


def test_moving_average_over_ranges(spark):
    rows, df = series(spark)
    want, last = {}, {}
    for r, k, v in rows:
        if v is not None:
            last[r] = v if r not in last else 0.9 * last[r] + 0.1 * v
        want[r, k] = last.get(r)
    got = {(x.run, x.step): x.ema for x in S.ema(df, 0.9).collect()}
    assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    assert S.ema(df.limit(0), 0.9).count() == 0


def test_exact_quantiles(spark):
    rows, df = series(spark)
    got = {x.run: x.q for x in S.exact_quantiles(df, (0.0, 0.25, 0.99, 1.0)).collect()}
    assert set(got) == {"a", "b", "c"}
    for r, q in got.items():
        assert np.allclose(q, np.quantile([v for s, _, v in rows if s == r and v is not None], [0.0, 0.25, 0.99, 1.0]))
    assert S.exact_quantiles(df.limit(0), (0.5,)).count() == 0


def test_synthetic_corpus_is_a_function_of_its_seed(spark):
    a, b = ({(r.doc_id, r.text) for r in synthetic.corpus(spark, seed=s).collect()} for s in (1, 1))
    assert a == b and len(a) == 902 and a != {(r.doc_id, r.text) for r in synthetic.corpus(spark, seed=2).collect()}
