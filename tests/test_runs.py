import json
import random

import pytest

from corpusloom import config
from corpusloom.operators import ledger as L
from corpusloom.operators import mixture as M
from corpusloom.operators import recovery as R


def sequences(n=60):
    rng = random.Random(3)
    return {lane: [(f"{lane}:{k:03d}", rng.randint(20, 127), 128) for k in range(n)] for lane in M.ALL_LANES}


@pytest.fixture(scope="module")
def table(spark):
    rows = [(b, lane, *x) for b in ("b", "c") for lane, v in sequences().items() for x in v]
    return spark.createDataFrame(rows, "branch string, lane string, seq_id string, effective bigint, total bigint")


def drawn(state, *lanes):
    for x in lanes:
        state, _ = M.after(state, "drawn", x, 100, 128)
    return state


def test_deficit_rule_and_ties():
    s = M.start()
    assert M.draw(s) == "verified-pdf"  # all deficits are 0: by name
    s = drawn(s, "verified-pdf")
    assert M.draw(s) == "verified-web"
    assert M.draw(s, frozenset({"verified-web", "verified-speech"})) == "verified-pdf"
    assert M.draw(s, frozenset(M.ALL_LANES)) is None
    with pytest.raises(ValueError):
        M.after(s, "other")


def test_stage_advances_by_draws_and_plateau():
    s, what = M.after(drawn(M.start(), *["verified-web"] * 8), "stage")
    assert what["reason"] == "steps" and s.stage == 1 and s.since == 0 and "unverified" in s.weights
    s = s._replace(losses=(1.0, 0.999))
    assert M.after(s, "stage") == (s, None)  # not enough draws yet
    s, _ = M.after(s._replace(since=8), "stage")
    assert s.stage == 2 and M.after(s._replace(since=8), "stage")[1] is None


def test_floor_needs_four_draws():
    s = M.start()
    for _ in range(4):
        assert not M.below_floor(s)
        s = drawn(s, "synthetic")
    assert M.below_floor(s) and len(drawn(s, *["synthetic"] * 40).recent) == config.FLOOR_WINDOW


def test_demotion_keeps_the_sum_and_the_old_state():
    s = M.start()
    t, e = M.after(s, "demoted", "verified-web")
    assert e["old_weight"] == 0.45 == s.weights["verified-web"] and abs(sum(t.weights.values()) - 1) < 1e-12 and e["new_weight"] < 0.45


def test_state_survives_text():
    s, _ = M.after(drawn(M.start(1), "verified-web", "unverified"), "validated", 0.5)
    assert M.State.loads(s.dumps()) == s


def test_a_batch_passes_over_an_ended_lane():
    s, heads, got = M.batch(M.start(), {"verified-web": [("a", 5, 9)]}, {})
    assert got == [("verified-web", "a", 5, 9)] and heads == {"verified-web": 1}
    assert M.batch(s, {}, heads)[2] == []


def told(records):
    return [(r.branch, r.record_type, r.step, r.payload) for r in records.orderBy("branch", "place").collect() if r.record_type != "CHECKPOINT"]


def test_crash_resume_equals_undisturbed(table):
    whole = R.run(table, 20)
    crashed = R.run(table, 20, crash_at=13)
    assert {(r.branch, r.step) for r in R.orphans(crashed).collect()} == {("b", 13), ("c", 13)}
    assert {r.last_step for r in R.last_committed(crashed).collect()} == {12}
    assert told(R.resume(table, crashed, 20)) == [x for x in told(whole) if x[2] >= 13]
    assert R.orphans(crashed.unionByName(R.resume(table, crashed, 20))).count() == 0


def test_replay_fork_and_what_they_leave(table):
    whole = R.run(table, 20)
    before = told(whole)
    assert R.replay_mismatches(table, whole, 6, 12).count() == 0
    forked = told(R.fork(table, whole, 14, "-x", 20))
    assert {x[0] for x in forked} == {"b-x", "c-x"} and min(x[2] for x in forked) == 12 and "batch-b-x-12" in forked[0][3]
    assert [json.loads(x[3])["batch_hash"] for x in forked if x[1] == "INTENT"] == [json.loads(x[3])["batch_hash"] for x in before if x[1] == "INTENT" and x[2] >= 12]
    assert told(whole) == before
    ledgers = R.ledgers(whole)
    assert L.breaks(ledgers).count() == 0 and ledgers.select("chain").distinct().count() == 4


def test_rollback_once():
    worse = lambda step, what: float(step) if what == "validation" else 0.5
    events = [e for e in R.walk("b", sequences(), R.GENESIS, 12, loss=worse) if e[0] == "ROLLBACK"]
    assert [e[1] for e in events] == [5] and events[0][2]["new_weight"] < events[0][2]["old_weight"]


def test_nothing_to_run(table):
    none = R.run(table.limit(0), 5)
    assert none.count() == 0 and R.resume(table.limit(0), none, 5).count() == 0 and R.orphans(none).count() == 0


def test_scoring_rounds(spark):
    df = spark.createDataFrame([("l", k, f"s{k}", 9) for k in range(30)], "lane string, queue_index bigint, id string, round int")
    low = {r.id: r for r in R.scoring_rounds(df, 5, 5, score=lambda i, r: 0.0).collect()}
    assert set(low) == {"s0", "s1"}  # three deferrals, then a rejection; the next is deferred
    got = R.scoring_rounds(df, 2, 5, need=8, score=lambda i, r: 0.5).collect()
    assert [r.queue_index for r in got] == list(range(16)) and {r.classification for r in got} == {"ACCEPT"}
    assert R.scoring_rounds(df.limit(0), 2, 5).count() == 0


def test_simulation_is_the_fold(spark):
    seqs = sequences(20)
    rows = [("b", lane, *x) for lane, v in seqs.items() for x in v]
    df = spark.createDataFrame(rows, "branch string, lane string, seq_id string, effective bigint, total bigint")
    got = M.simulate(df, 12).orderBy("draw").collect()
    assert len(got) == 48 and got[0].lane == "verified-pdf" and {g.stage for g in got} == {0, 1, 2}


def test_mismatches(spark):
    a = spark.createDataFrame([(1, "x", 0.5), (2, "y", 0.5), (3, "z", 0.5), (4, "u", None)], "step int, batch_hash string, loss double")
    b = spark.createDataFrame([(1, "x", 0.5), (2, "w", 0.5), (4, "u", 0.1), (5, "v", 0.1)], "step int, batch_hash string, loss double")
    assert {(r.step, r.reason) for r in L.mismatches(a, b).collect()} == {(2, "batch"), (3, "missing"), (4, "loss"), (5, "extra")}
