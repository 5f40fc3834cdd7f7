"""Splitting and packing against brute force, and their edge cases."""

import random

import pytest

from corpusloom.llm import packing, splitting

PIECES = ["<PAD>", "<BOS>", "\n", ".", "?", " the", "a", "b", " ka", "ು"]
VOCAB = "token_id int, piece string, kind string"
FRAGS = "doc_id string, parent_doc_id string, fragment_index int, tokens array<int>, token_offset_in_parent int, piece_start int, n int"


def vocab(spark):
    return spark.createDataFrame([(k, p, "special" if k < 2 else "text") for k, p in enumerate(PIECES)], VOCAB)


def cut(tokens, limit=128, overlap=16):
    n, s, out = len(tokens), 0, []
    while n - s > limit:
        ends = range(s + 65, s + limit + 1)
        line = [e for e in ends if PIECES[tokens[e - 1]] == "\n"]
        stop = [e for e in ends if PIECES[tokens[e - 1]] in ".!?।॥"]
        word = [e for e in ends if PIECES[tokens[e]].startswith(" ")]
        e = max(line or stop or word or [s + limit])
        out.append((s, e))
        s = e - overlap
    return [*out, (s, n)]


def fragments(seed=1):
    rng = random.Random(seed)
    rows, want = [], set()
    for p in range(25):
        at = 0
        for k in range(rng.randint(1, 6) if p else 700):  # one parent has most rows
            weights = rng.choice([[1, 1, 1, 3, 3, 40, 40, 40, 40, 40], [0, 0, 0, 0, 0, 0, 1, 1, 0, 1], [0, 0, 0, 0, 0, 1, 20, 20, 1, 20]])
            t = rng.choices(range(len(PIECES)), weights, k=rng.choice([0, 5, 128, 129, 200, 400]) if p else rng.choice([3, 130]))
            rows.append((f"p{p}::f{k}", f"p{p}", k, t, None if rng.random() < 0.2 else at, 1, 1))
            if len(t) > 128:
                want |= {(f"p{p}", at + s, at + e) for s, e in cut(t)}
            at += len(t)
    rows += [("lost", "lost", 0, None, None, 1, 1), *rows[::7]]
    rng.shuffle(rows)
    return rows, want


def test_cut_equals_brute_force(spark):
    rows, want = fragments()
    df = spark.createDataFrame(rows, FRAGS)
    got = splitting.cut(df, vocab(spark)).collect()
    assert {(r.parent_doc_id, r.token_offset_in_parent, r.token_end_in_parent) for r in got} == want
    tokens = {i: t for i, _, _, t, *_ in rows}
    start = {}
    for i, p, k, t, o, *_ in rows:
        start[i] = o if o is not None else sum(len(u) for u in {j: u for j, q, m, u, *_ in rows if q == p and m < k}.values())
    for r in splitting.pieces(df, vocab(spark)).collect():
        at = r.token_offset_in_parent - start[r.doc_id]
        assert len(r.tokens) <= 128 and r.tokens == tokens[r.doc_id][at : at + len(r.tokens)]


def test_pieces_give_the_fragment_back(spark):
    rows, _ = fragments(2)
    df = spark.createDataFrame(rows, FRAGS)
    whole = {i: t for i, _, _, t, *_ in rows if t}
    by = {}
    for r in splitting.cut(df, vocab(spark)).collect():
        by.setdefault(r.doc_id, []).append((r.piece_start, r.piece_end))
    for i, spans in by.items():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] == len(whole[i])
        assert all(b[0] == a[1] - 16 and a[1] - a[0] <= 128 for a, b in zip(spans, spans[1:]))


def test_unknown_ids_and_empty(spark):
    df = spark.createDataFrame([("a", "a", 0, [999_999] * 300, 0, 1, 1), ("b", "b", 0, [], None, 1, 1)], FRAGS)
    assert [(r.piece_start, r.piece_end) for r in splitting.cut(df, vocab(spark)).orderBy("piece_start").collect()] == [(0, 128), (112, 240), (224, 300)]
    assert splitting.cut(df.limit(0), vocab(spark)).count() == 0 and splitting.pieces(df.limit(0), vocab(spark)).count() == 0
    with pytest.raises(ValueError):
        splitting.cut(df, vocab(spark), limit=10, overlap=20)


def test_text_spans():
    rng = random.Random(8)
    for _ in range(200):
        t = "".join(rng.choice(["a", "bc ", ". ", "\n", "\n\n", "\n# ", "ದೀರ್ಘ", "x" * 30]) for _ in range(rng.randint(0, 120)))
        spans = splitting.text_spans(t, 60, 12)
        assert all(0 < e - s <= 60 for s, e, _ in spans)
        assert not t and not spans or spans[0][0] == 0 and spans[-1][1] == len(t)
        for (s, e, _), (u, v, _) in zip(spans, spans[1:]):
            assert s < u <= e < v and e - u <= 12
    two = "A first line.\n\n" + "word " * 8 + "\n# Part two\n" + "more " * 8
    assert [k for *_, k in splitting.text_spans(two, 60, 0)] == ["section", "end"]
    assert splitting.text_spans("y" * 130, 60, 10) == [(0, 50, "character"), (40, 100, "character"), (90, 130, "end")]
    with pytest.raises(ValueError):
        splitting.text_spans("y", 10, 10)


def test_text_pieces(spark):
    rows = [(1, "one two " * 40), (1, "one two " * 40), (2, None), (3, ""), (4, "short")]
    df = spark.createDataFrame([(i, t, 0, 0) for i, t in rows], "doc_id bigint, text string, piece int, start int")
    got = splitting.text_pieces(df, 100, 10).orderBy("doc_id", "piece").collect()
    assert {r.doc_id for r in got} == {1, 4} and all(len(r.text) == r.end - r.start <= 100 for r in got) and got[-1].text == "short"
    assert splitting.text_pieces(df.limit(0)).count() == 0


def fewest(lengths, capacity=128):
    best = len(lengths)
    order = sorted(lengths, reverse=True)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(order):
            best = len(rooms)
            return
        for r in set(rooms):
            if r >= order[i]:
                x = list(rooms)
                x.remove(r)
                go(i + 1, [*x, r - order[i]])
        go(i + 1, [*rooms, capacity - order[i]])

    go(0, [])
    return best


def test_differencing_and_search():
    rng = random.Random(4)
    for _ in range(150):
        x = [rng.choice([rng.randint(1, 128), rng.randint(20, 64)]) for _ in range(rng.randint(1, 10))]
        k, got = fewest(x), packing.pack(x)
        assert sorted(i for w in got for i in w) == list(range(len(x)))
        assert all(sum(x[i] for i in w) <= 128 for w in got) and len(got) >= k >= packing.fewest_by_bound(x, 128)
        assert packing.complete_differencing(x, k) and not packing.complete_differencing(x, k - 1)
        assert packing.fewest_by_classes(x, 128) <= k
    with pytest.raises(packing.Undecided):
        packing.complete_differencing([51, 27, 26, 23, 43, 42, 40, 3] * 6, 12, most_states=5)
    assert packing.pack([]) == [] and packing.pack([128, 128]) == [[0], [1]]
    assert sorted(map(len, packing.differencing([4, 4, 4, 4], 2))) == [2, 2]


def packed(lengths_by_seq, lane="l", group=0):
    rows = []
    for k, lengths in enumerate(lengths_by_seq):
        blocks = [b for b, n in enumerate(lengths) for _ in range(n)]
        rows.append((f"{lane}:{group}:{k}", lane, group, blocks + [-1] * (128 - len(blocks)), 3))
    return rows


def test_repackable_equals_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], set()
    for g in range(60):
        seqs = []
        for _ in range(rng.randint(1, 5)):
            room, own = 128, []
            while room > 4 and (not own or rng.random() < 0.6):
                own.append(rng.randint(1, room))
                room -= own[-1]
            seqs.append(own)
        rows += packed(seqs, group=g)
        if fewest([n for s in seqs for n in s]) < len(seqs):
            want.add(g)
    rows += packed([[], [64], []], group=900)  # sequences without an item count
    want.add(900)
    rows += rows[::4]
    df = spark.createDataFrame(rows, "seq_id string, lane string, group_index int, attention_block_ids array<int>, lengths int")
    assert {r.group_index for r in packing.repackable(df).collect()} == want
    assert packing.repackable(df.limit(0)).count() == 0


def test_sequences_hold_every_token(spark):
    rng = random.Random(6)
    rows = [(f"d{k}", rng.choice(["TRAIN", " train"]), rng.choice(["a", "b", None]), [rng.randint(4, 99) for _ in range(rng.choice([1, 40, 128, 129, 300]))]) for k in range(120)]
    extra = [("e", "EVAL", "a", [1]), ("n", "TRAIN", "a", None), ("z", "TRAIN", "a", [])]
    df = spark.createDataFrame(rows + rows[::3] + extra, "doc_id string, role string, lane string, tokens array<int>")
    got = packing.sequences(df, batch=16).collect()
    back = {}
    for r in got:
        assert len(r.input_ids) == 128 and r.used == sum(b >= 0 for b in r.attention_block_ids)
        for k, (d, o) in enumerate(zip(r.doc_ids_present, r.token_offsets)):
            for j, t in enumerate(x for x, b in zip(r.input_ids, r.attention_block_ids) if b == k):
                back[d, o + j] = t
    assert back == {(i, j): t for i, _, _, ts in rows for j, t in enumerate(ts)}
    whole = [d for r in got for d in r.doc_ids_present]
    assert all(whole.count(i) == -(-len(t) // 128) for i, _, _, t in rows)
    assert packing.sequences(df.limit(0)).count() == 0
