"""The model fixture: its gradient against finite differences, its masks, its keyed parts."""

import numpy as np

from corpusloom.functions import model as N


def sequence(n=12, vocabulary=40):
    rng = np.random.default_rng(1)
    ids = rng.integers(4, vocabulary, n)
    blocks = np.array([0] * 5 + [1] * 4 + [-1] * (n - 9))
    positions = np.array([*range(5), *range(4), *[0] * (n - 9)])
    mask = ((positions > 0) & (blocks >= 0)).astype(int)
    return np.where(blocks < 0, 0, ids), positions, blocks, mask


def test_gradient_is_the_slope_of_the_loss():
    m, s = N.initial(40, 16), sequence()
    for training in (False, True):
        loss, n, g = N.gradient(m, *s, training=training)
        assert n == 7 and loss > 0
        for at in (0, 33, 700, m.head.size + 5):
            e = np.zeros(len(g))
            e[at] = 1e-6
            up, down = (N.gradient(N.updated(m, k * e, 1.0), *s, training=training)[0] for k in (-1, 1))
            assert abs((up - down) / 2e-6 - g[at]) < 1e-6
    assert N.gradient(N.updated(m, g), *s)[0] < loss


def test_blocks_do_not_see_each_other_nor_what_follows():
    m, (ids, positions, blocks, _) = N.initial(40, 16), sequence()
    base = N.hidden(m, ids[None], positions[None], blocks[None])[0]
    other = ids.copy()
    other[3] = 5
    changed = N.hidden(m, other[None], positions[None], blocks[None])[0]
    assert np.allclose(base[:3], changed[:3]) and not np.allclose(base[3:5], changed[3:5]) and np.allclose(base[5:9], changed[5:9])


def test_draws_are_the_keyed_ones():
    from corpusloom.functions import hashing as H

    assert N.draws(7, 5).tolist() == [H.uniform(7, k) for k in range(5)]
    assert (N.initial(40, 16).head == N.drawn(N.WIDTH, 40, "head")).all()
    x = np.ones((3, N.WIDTH))
    assert (N.dropout(x, "b", 1, 2) == N.dropout(x, "b", 1, 2)).all() and not (N.dropout(x, "b", 1, 2) == N.dropout(x, "b", 1, 3)).all()


def test_sketch_equals_the_relational_one(spark):
    from corpusloom.operators import selection as S

    v = np.random.default_rng(2).standard_normal(200)
    got = {r.bucket: r.value for r in S.countsketch(spark.createDataFrame([(1, v.tolist())], "id int, v array<double>"), 200).collect()}
    want = N.sketched(v)
    assert all(abs(want[k] - got.get(k, 0.0)) < 1e-9 for k in range(64))


def test_no_loss_no_gradient():
    m, (ids, positions, blocks, mask) = N.initial(40, 16), sequence()
    assert N.gradient(m, ids, positions, blocks, mask * 0)[:2] == (0.0, 0)


def most_held(sketch, vocabulary=2000, rows=200):
    """The most bytes that the losses (and sketches) of one batch take, and the rows that come out."""
    import tracemalloc

    import pyarrow as pa

    from corpusloom import config
    from corpusloom.plans import models

    N.sketch_plan(N.initial(vocabulary).head.size + vocabulary, config.SKETCH)
    columns = [pa.array([[int(x) for x in a]] * rows, pa.list_(pa.int32())) for a in sequence(64, vocabulary)]
    b = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(rows)]), *columns], names=["seq_id", "input_ids", "position_ids", "attention_block_ids", "loss_mask"])
    tracemalloc.start()
    try:
        out = sum(x.num_rows for x in models._losses(vocabulary, sketch)([b]))
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_sketches_of_a_batch_hold_one_gradient_at_a_time():
    held, out = most_held(True)
    assert out == 200 and held < 16e6  # 200 gradients are 106 MB


def test_losses_of_a_batch_hold_no_gradients():
    held, out = most_held(False)
    assert out == 200 and held < 16e6  # 200 gradients are 106 MB


def test_scored_equals_gradient_and_sketch(monkeypatch):
    m, (ids, positions, blocks, mask) = N.initial(40, 16), sequence()
    none, some = (ids, positions, blocks, mask * 0), (ids, positions, blocks, mask)
    for tile in (1, 3, 7, 128):
        monkeypatch.setattr(N, "TILE", tile)
        for (loss, n, sketch), s in zip(N.scored(m, [some, none, some], 64), [some, none, some], strict=True):
            want, count, g = N.gradient(m, *s, training=False)
            assert n == count and abs(loss - want) < 1e-12 and np.abs(sketch - N.sketched(g)).max() < 1e-12


def test_candidate_scores_are_those_of_the_gradients(spark, data):
    import hashlib

    from corpusloom.plans import models
    from corpusloom.plans.packing import packed

    m = N.initial(models._vocabulary(spark, data))
    rows = packed(spark, data, "input_ids", "position_ids", "attention_block_ids", "loss_mask").collect()
    sketches = {r.seq_id: N.sketched(N.gradient(m, r.input_ids, r.position_ids, r.attention_block_ids, r.loss_mask, training=False)[2]) for r in rows}
    to = np.mean([x for k, x in sketches.items() if hashlib.sha256(k.encode()).hexdigest()[0] == "0"], axis=0)
    got = models.candidate_scores(spark, data).collect()
    assert len(got) == len(sketches) and {r.seq_id for r in got} == set(sketches)
    for r in got:
        x = sketches[r.seq_id]
        size = np.linalg.norm(x) * np.linalg.norm(to)
        score = float(x @ to / size) if size else 0.0  # a sequence that bears no loss
        assert abs(r.score - score) < 1.1e-6
        if min(abs(score - 0.15), abs(score + 0.15)) > 1e-9:
            assert r.classification == ("ACCEPT" if score >= 0.15 else "REJECT" if score <= -0.15 else "DEFER")


def test_model_losses_are_those_of_the_gradients(spark, data):
    from corpusloom.plans import models
    from corpusloom.plans.packing import packed

    m = N.initial(models._vocabulary(spark, data))
    rows = packed(spark, data, "input_ids", "position_ids", "attention_block_ids", "loss_mask").collect()
    want = {r.seq_id: N.gradient(m, r.input_ids, r.position_ids, r.attention_block_ids, r.loss_mask, training=False)[:2] for r in rows}
    got = models.model_losses(spark, data).collect()
    assert len(got) == len(want) and all(r.n == want[r.seq_id][1] and abs(r.loss - want[r.seq_id][0]) < 1.1e-6 for r in got)
