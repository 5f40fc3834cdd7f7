import random

import pytest

from corpusloom import config
from corpusloom.operators import packing as P


def slow(lengths, capacity):
    """The same recurrence, one subset at a time."""
    n, best, last = len(lengths), {0: (0, 0)}, {}
    for mask in sorted(range(1 << n), key=lambda m: m.bit_count()):
        for i in range(n):
            if mask in best and not mask >> i & 1:
                bins, minus = best[mask]
                options = [(bins + 1, lengths[i] - capacity)]
                if bins and -minus >= lengths[i]:
                    options.insert(0, (bins, minus + lengths[i]))
                for o in options:
                    if mask | 1 << i not in best or o < best[mask | 1 << i]:
                        best[mask | 1 << i], last[mask | 1 << i] = o, (mask, i)
    out, mask = [0] * n, (1 << n) - 1
    while mask:
        before, i = last[mask]
        out[i] = best[mask][0] - 1
        mask = before
    return out


def test_exact_bins_equals_recurrence():
    rng = random.Random(1)
    for _ in range(60):
        x = [rng.randint(2, 128) for _ in range(rng.randint(1, 8))]
        assert P.exact_bins(x, 128) == slow(x, 128)


def test_exact_beats_ffd_within_bound():
    assert max(P.first_fit_decreasing([60, 50, 40, 30, 30, 30], 128)) + 1 == 3
    assert max(P.exact_bins([60, 50, 40, 30, 30, 30], 128)) + 1 == 2
    assert max(P.exact_bins([64, 64, 64], 128)) + 1 == 2
    rng = random.Random(2)
    for _ in range(40):
        x = [rng.randint(2, 128) for _ in range(9)]
        assert P.within_bound(max(P.first_fit_decreasing(x, 128)) + 1, max(P.exact_bins(x, 128)) + 1)
    with pytest.raises(ValueError):
        P.exact_bins([129], 128)
    assert P.exact_bins([], 128) == []


def test_capped_cuts_in_order():
    assert P.capped([0] * 13, 12) == [0] * 12 + [1]
    assert P.capped([1, 0, 1, 1], 2) == [1, 0, 1, 2]


def docs(spark, lane, sizes):
    return spark.createDataFrame([(f"{k:03d}", lane, list(range(1, n + 1)) if n is not None else None) for k, n in enumerate(sizes)], "doc_id string, lane string, tokens array<int>")


def test_fragments(spark):
    got = P.fragments(docs(spark, "unverified", [1, 127, 128, 129, 256, 260, 0, None])).orderBy("doc_id").collect()
    assert [(r.doc_id, len(r.tokens), r.token_offset_in_parent) for r in got] == [
        ("000", 1, 0), ("001", 127, 0), ("002", 128, 0), ("003::frag0", 128, 0), ("003::frag1", 1, 128), ("004::frag0", 128, 0), ("004::frag1", 128, 128),
        ("005::frag0", 128, 0), ("005::frag1", 128, 128), ("005::frag2", 4, 256),
    ]
    cut = P.fragments(docs(spark, "verified-web", [131])).collect()
    assert [(r.doc_id, r.tokens) for r in cut] == [("000", list(range(1, 129)))]


def test_pack_holds_every_token_once(spark):
    sizes = [random.Random(k).randint(2, 300) for k in range(60)]
    got = P.pack(docs(spark, "synthetic", sizes)).collect()
    assert sorted(int(r.seq_id.rsplit(":", 1)[1]) for r in got) == list(range(len(got)))
    seen = sum(sum(b >= 0 for b in r.attention_block_ids) for r in got)
    assert seen == sum(sizes)
    for r in got:
        assert len(r.input_ids) == len(r.loss_mask) == len(r.token_provenance) == config.SEQ_LEN
        assert len(r.doc_ids_present) <= config.PACKING["synthetic"].max_docs
        for b, p, m, t in zip(r.attention_block_ids, r.position_ids, r.loss_mask, r.token_provenance):
            assert (b == -1) == (t is None) and m == int(b >= 0 and p > 0)


def test_empty(spark):
    assert P.pack(docs(spark, "synthetic", [])).count() == 0


def test_utilisation_of_no_tokens(spark):
    df = spark.createDataFrame([("l", [], [], [])], "lane string, input_ids array<int>, attention_block_ids array<int>, loss_mask array<int>")
    assert P.utilisation(df).collect()[0].used_ratio == 0.0
