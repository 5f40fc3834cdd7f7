"""The similarity joins against brute force, and their edge cases."""

import random

import numpy as np
import pytest

from corpusloom.functions.text import shingles
from corpusloom.llm import chosen_path, components, cross_split
from corpusloom.llm.features import classes

SCHEMA = "doc_id string, text string, source string, n int, set_key bigint"  # extra columns with names used inside


def texts(n=70, seed=1):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 30, 60, 120]))]
        out.append(" ".join(w))
        for _ in range(k % 3):
            w = w.copy()
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice([["new"], [], ["a", "b"]])
            out.append(" ".join(w))
        if k % 9 == 0:
            out += [out[-1], out[-1] + " .", out[-1].upper()]
    base = [f"b{k}" for k in range(100)]
    for k in range(90):  # one hot group: alike, and each text different
        w = base.copy()
        w[k] = f"h{k}"
        out.append(" ".join(w))
    out += [None, "", " . ", "ಈ ಆ", "x" * 50_000]
    rng.shuffle(out)
    return [(f"d{k:04d}", t) for k, t in enumerate(out)]


def alike(docs):
    sets = [(i, t, shingles(t)) for i, t in docs if t]
    for k, (i, t, s) in enumerate(sets):
        for j, u, r in sets[k + 1 :]:
            if s and r and len(s & r) / len(s | r) >= 0.8:
                yield tuple(sorted((i, j))), t == u


def frame(spark, docs):
    return spark.createDataFrame([(i, t, " S ", 7, 7) for i, t in docs] + [(i, t, "s", 8, 8) for i, t in docs[::5]], SCHEMA)


@pytest.mark.parametrize("small", [4, 64])
def test_near_duplicates_equal_brute_force(spark, small):
    docs = texts()
    got = chosen_path.near_duplicates(classes(frame(spark, docs)), small=small, levels=3).collect()
    pairs = [(r.doc_id_a, r.doc_id_b) for r in got]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {p for p, same in alike(docs) if not same}


def test_large_nodes_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    docs = texts(5)
    got = chosen_path.near_duplicates(classes(frame(spark, docs)), small=4, levels=1).collect()
    assert {(r.doc_id_a, r.doc_id_b) for r in got} == {p for p, same in alike(docs) if not same}


def test_link_counts_one_row_a_document(spark):
    docs = texts(30)
    got = chosen_path.link_counts(classes(frame(spark, docs))).collect()
    known = {i for i, t in docs if t and shingles(t)}
    assert {r.doc_id for r in got} == known and len(got) == len(known)


def test_empty_and_null_tables(spark):
    none = frame(spark, [("a", None), ("b", ""), ("c", "ಈ")])
    assert chosen_path.near_duplicates(classes(none)).count() == 0
    assert chosen_path.near_duplicates(classes(none.limit(0))).count() == 0


def test_runs_for_the_target():
    assert chosen_path.survival(0) == 1 and chosen_path.runs_for(2) > chosen_path.runs_for(1)
    assert (1 - chosen_path.survival(2)) ** chosen_path.runs_for(2) <= 1 - chosen_path.TARGET


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 101), (7, 7), (200, 200)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


ROLES = "doc_id string, role string, assigned_at timestamp"
SHARDS = "role string, offsets map<string,array<bigint>>"


def split(docs, seed=3):
    import datetime as dt

    rng = random.Random(seed)
    t0 = dt.datetime(2026, 1, 1)
    assigned = []
    for k, (i, _) in enumerate(docs):
        if k % 11:
            assigned.append((i, rng.choice(["TRAIN", " train", "Eval ", "VALIDATION", "PROXY"]), t0))
        if k % 5 == 0:
            assigned.append((i, rng.choice(["EVAL", None, "TRAIN", " "]), t0 + dt.timedelta(days=1)))
    rng.shuffle(assigned)
    return assigned, [("Eval", {docs[0][0]: [0, 1], docs[1][0]: [1, 2]}), ("TRAIN", {docs[2][0]: [0, 1]})]


def splits(assigned, shards):
    last, out = {}, {}
    for i, r, t in sorted(assigned, key=lambda x: x[2]):
        if r and r.strip():
            last[i] = r.strip().upper()
    for i, r in [*last.items(), *[(i, r.strip().upper()) for r, m in shards for i in m]]:
        out.setdefault(i, set()).add(r)
    return out


def test_cross_split_equals_brute_force(spark):
    docs = texts()
    assigned, shards = split(docs)
    a = frame(spark, docs), spark.createDataFrame(assigned, ROLES), spark.createDataFrame(shards, SHARDS)
    got = [(r.doc_id_a, r.doc_id_b) for r in cross_split.overlaps(*a).collect()]
    s = splits(assigned, shards)
    hit = lambda x, y: "TRAIN" in s.get(x, ()) and s.get(y, set()) & {"EVAL", "VALIDATION"}
    want = {p: same for p, same in alike(docs) if hit(*p) or hit(*p[::-1])}
    assert len(got) == len(set(got)) and set(got) == set(want)
    found = {y: False for p in want for x, y in (p, p[::-1]) if hit(x, y)}
    for p, same in want.items():
        for x, y in (p, p[::-1]):
            found[y] = found.get(y, False) or bool(hit(x, y) and same)
    found = {y: e for y, e in found.items() if any(hit(x, y) for p in want for x, z in (p, p[::-1]) if z == y)}
    rows = cross_split.report(*a).collect()
    held = [(y, r) for y in found for r in s[y] & {"EVAL", "VALIDATION"}]
    assert sum(r.exact + r.near for r in rows) == len(held) and sum(r.exact for r in rows) == sum(found[y] for y, _ in held)


def test_cross_split_empty(spark):
    a = frame(spark, []), spark.createDataFrame([], ROLES), spark.createDataFrame([], SHARDS)
    assert cross_split.overlaps(*a).count() == 0 and cross_split.report(*a).count() == 0


def test_fingerprints_tell_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 5000).astype(np.uint64)
    a, b = x[:4500], x[500:]  # 4000 of 5000 in common
    d = int((cross_split.fingerprint(a) != cross_split.fingerprint(b)).sum())
    assert abs(d - cross_split.BITS * 0.1) < 40 and (cross_split.fingerprint(a) == cross_split.fingerprint(a[::-1])).all()
    for n in (10, 10**5, 10**9):
        length, number = cross_split.block_plan(n, 0.8)
        assert (1 - 0.9**length) ** number <= 1 - cross_split.TARGET
