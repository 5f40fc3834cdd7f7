import random

import pytest

from corpusloom.functions.text import shingles
from corpusloom.operators import dedup, roles

SCHEMA = "doc_id string, tier string, type string, text string"


def brute(docs):
    first, out = {}, {}
    for i, t in sorted((i, t) for i, t in docs if t is not None):
        if t in first:
            out[i] = ("exact_duplicate", first[t])
        else:
            first[t] = i
    left, kept = sorted((i, shingles(t)) for t, i in first.items()), []
    for i, s in left:
        hit = next((j for j, r in kept if (len(s & r) / len(s | r) if s | r else 1.0) >= 0.8), None)
        if hit is None:
            kept.append((i, s))
            out[i] = ("survivor", None)
        else:
            out[i] = ("quarantined", hit)
    return out


def fixture():
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(60):
        w = [rng.choice(vocabulary) for _ in range(80)]
        docs.append((f"d{k:03d}", " ".join(w)))
        for e in range(k % 4):  # chains of small edits
            w = w.copy()
            w[rng.randrange(80)] = f"x{k}{e}"
            docs.append((f"d{rng.randrange(1000):03d}-{k}-{e}", " ".join(w)))
    docs += [("a1", docs[0][1]), ("z1", docs[0][1]), ("b1", docs[0][1] + " ."), ("d0", docs[9][1] + "!"), ("y1", docs[9][1] + " ?"), ("e1", ""), ("e2", " . "), ("e3", "ಈ ಆ"), ("n1", None)]
    return docs


def test_run_equals_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, "verified", "web", t) for i, t in docs], SCHEMA)
    got = {r.doc_id: (r.status, r.matched) for r in dedup.run(df).collect()}
    assert got == brute(docs)


def test_chain_keeps_the_third(spark):
    pairs = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.9)], "a string, b string, jaccard double")
    assert [(r.doc_id, r.matched) for r in dedup.greedy(pairs).collect()] == [("b", "a")]


def test_empty_table(spark):
    assert dedup.run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_roles_gate(spark):
    df = spark.createDataFrame([("a", "TRAIN"), ("b", "EVAL"), ("c", None), ("d", "OTHER")], "doc_id string, role string")
    assert {r.doc_id: r.reason for r in roles.rejected(df, "training").collect()} == {"b": "role EVAL", "c": "unknown role", "d": "unknown role"}
    assert roles.admitted(df.where("role = 'TRAIN'"), "training").count() == 1
    with pytest.raises(Exception, match="not admitted for training"):
        roles.admitted(df.where("role = 'EVAL'"), "training").collect()
    with pytest.raises(Exception, match="not admitted for proxy"):
        roles.admitted(df.where("role is null"), "proxy").collect()


def test_quarantine_overrides(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    got = {r.doc_id: r.role for r in roles.assign(docs, spark.createDataFrame([("a",), ("a",)], "doc_id string")).collect()}
    assert got["a"] == "QUARANTINE" and got["b"] in ("TRAIN", "VALIDATION", "EVAL", "PROXY") and len(got) == 2
