"""Runs of training steps over tables, with a write-ahead ledger: crash, resume, replay, fork and rollback.

A step forms a batch, records INTENT, is computed, and records COMMIT and BATCH_LOSS. After every third step
there is a validation: a loss over the best by the margin demotes, once, the lane drawn most; else a stage may
end. The state is written as a CHECKPOINT every few steps. All of it is a fold from a state, so a run, the steps
done again after a crash, a replay and a fork are one function over different starts; what they find is joined
and counted as tables. A branch is one task, holds what its steps can draw, and branches run in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import canonical, object_hash, sha256
from . import ledger as L
from . import mixture as M

EVENTS = "branch string, place bigint, record_type string, step int, payload string"
VALIDATE, CHECKPOINT = 3, 6


def keyed_loss(step: int, seq_id: str) -> float:
    """A stand-in for a model's loss: a draw in [0, 1) keyed by the step and the sequence."""
    return int(sha256(f"{step}|{seq_id}")[:8], 16) / 2**32


class Branch(NamedTuple):
    """What a branch needs to go on: the next step, the scheduler's state, the queues' heads, the best validation loss, whether it was rolled back."""

    step: int
    scheduler: str
    heads: dict[str, int]
    best: float | None = None
    rolled_back: bool = False


GENESIS = Branch(0, M.start().dumps(), {})


def walk(name: str, queues: dict[str, list], at: Branch, steps: int, silent: int = 0, crash_at: int | None = None, loss: Callable = keyed_loss) -> Iterator[tuple[str, int, dict]]:
    """(record_type, step, payload) of the steps of a branch up to steps; those under silent are done without a word. At crash_at it ends after INTENT; a step for which no active lane has a sequence left has no batch, and says nothing."""
    state, heads, best, rolled = M.State.loads(at.scheduler), at.heads, at.best, at.rolled_back
    for step in range(at.step, steps):
        said, before = step >= silent, Branch(step, state.dumps(), heads, best, rolled)
        state, heads, draws = M.batch(state, queues, heads)
        if said and step % CHECKPOINT == 0:
            yield "CHECKPOINT", step, before._asdict()
        records = said and bool(draws)
        ids, batch_id = [d[1] for d in draws], f"batch-{name}-{step}"
        if records:
            yield "INTENT", step, {"step": step, "batch_id": batch_id, "batch_hash": object_hash({"seq_ids": sorted(ids)}), "seq_ids": ids, "lanes": [d[0] for d in draws]}
        if step == crash_at:
            return
        each = [(lane, loss(step, i), n) for lane, i, n, _ in draws]
        tokens = sum(n for _, _, n in each)
        by_lane = {x: [v for y, v, _ in each if y == x] for x, _, _ in each}
        if records:
            yield "COMMIT", step, {"step": step, "batch_id": batch_id, "n_sequences": len(ids), "n_loss_tokens": tokens}
            yield "BATCH_LOSS", step, {"step": step, "batch_id": batch_id, "avg_loss": sum(v * n for _, v, n in each) / tokens if tokens else 0.0, "per_lane_avg_loss": {x: sum(v) / len(v) for x, v in by_lane.items()}}
        if step % VALIDATE == VALIDATE - 1:
            value = loss(step, "validation")
            events = [("VALIDATION", {"step": step, "loss": value})]
            if best is not None and value > best + config.ROLLBACK_MARGIN and not rolled:
                worst = max((x for x in M.ALL_LANES if x in state.weights), key=lambda x: state.drawn[x])  # the first in the plan of equals
                state, what = M.after(state, "demoted", worst)
                rolled = True
                events.append(("ROLLBACK", {"step": step, **what}))
            best = value if best is None else min(best, value)
            state, _ = M.after(state, "validated", value)
            if len(events) == 1:
                state, what = M.after(state, "stage")
                events += [("STAGE", {"step": step, **what})] if what else []
            if said:
                yield from ((kind, step, payload) for kind, payload in events)


def _going(steps: int, crash_at: int | None):
    def fold(key: tuple, queue: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(begin):
            b = begin.iloc[0]
            at = Branch(**json.loads(b["state"])) if b["state"] else GENESIS
            until = steps if pd.isna(b["until"]) else int(b["until"])
            events = walk(key[0], M.queues_of(queue), at, until, int(b["silent"]), crash_at)
            rows = [(key[0], k, kind, step, canonical(payload)) for k, (kind, step, payload) in enumerate(events)]
        return pd.DataFrame(rows, columns=["branch", "place", "record_type", "step", "payload"])

    return fold


def run(sequences: DataFrame, steps: int, begin: DataFrame | None = None, crash_at: int | None = None) -> DataFrame:
    """The records of branches, EVENTS, in order of place.

    sequences: (branch, lane, seq_id, effective, total). begin: (branch, state, silent, until) says where a branch
    starts (a CHECKPOINT's payload, or null for its beginning), up to where it is silent, and where it ends;
    branches without a row do not run. Without begin all run from their beginning.
    """
    if begin is None:
        begin = sequences.select("branch").distinct().select("branch", F.lit(None).cast("string").alias("state"), F.lit(0).alias("silent"), F.lit(None).cast("int").alias("until"))
    return M.queued(sequences, steps * config.BATCH).groupBy("branch").cogroup(begin.groupBy("branch")).applyInPandas(_going(steps, crash_at), EVENTS)


def _of(records: DataFrame, kind: str, **fields: str) -> DataFrame:
    own = records.where(F.col("record_type") == kind)
    return own.select("branch", "step", "place", *[F.get_json_object("payload", f"$.{k}").cast(t).alias(k) for k, t in fields.items()])


def last_committed(records: DataFrame) -> DataFrame:
    """(branch, last_step), -1 for a branch that committed none."""
    return records.groupBy("branch").agg(F.coalesce(F.max(F.when(F.col("record_type") == "COMMIT", F.col("step"))), F.lit(-1)).alias("last_step"))


def orphans(records: DataFrame) -> DataFrame:
    """(branch, step, batch_id) of the INTENTs that were not committed. To be read before a resume, whose COMMIT makes them whole."""
    as_chain = lambda d: d.withColumnRenamed("branch", "chain")
    return L.unmatched(as_chain(_of(records, "INTENT", batch_id="string")), as_chain(_of(records, "COMMIT", batch_id="string"))).select(F.col("chain").alias("branch"), "step", "batch_id")


def checkpoint_as_of(records: DataFrame, when: DataFrame) -> DataFrame:
    """(branch, state, checkpoint): the last CHECKPOINT of each branch of when (branch, upto) at or before upto."""
    own = records.where("record_type = 'CHECKPOINT'").select("branch", "step", "payload").join(when, "branch").where(F.col("step") <= F.col("upto"))
    return own.groupBy("branch").agg(F.max_by("payload", "step").alias("state"), F.max("step").alias("checkpoint"))


def resume(sequences: DataFrame, records: DataFrame, steps: int) -> DataFrame:
    """The records after a crash: each branch from its last checkpoint, its committed steps done again in silence, then on to steps."""
    last = last_committed(records)
    at = checkpoint_as_of(records, last.select("branch", (F.col("last_step") + 1).alias("upto"))).join(last, "branch")
    return run(sequences, steps, at.select("branch", "state", (F.col("last_step") + 1).alias("silent"), F.lit(None).cast("int").alias("until")))


def outcomes(records: DataFrame) -> DataFrame:
    """(branch, step, batch_hash, loss): what each step came to, by its last INTENT and BATCH_LOSS; loss is null for a step that has none."""
    last = lambda kind, field, t: _of(records, kind, **{field: t}).groupBy("branch", "step").agg(F.max_by(field, "place").alias(field))
    return last("INTENT", "batch_hash", "string").join(last("BATCH_LOSS", "avg_loss", "double").withColumnRenamed("avg_loss", "loss"), ["branch", "step"], "left")


def replay(sequences: DataFrame, records: DataFrame, first: int, last: int) -> DataFrame:
    """The records of the steps from first to last, computed anew from the last checkpoint before them."""
    when = records.select("branch").distinct().withColumn("upto", F.lit(first))
    at = checkpoint_as_of(records, when)
    return run(sequences, last + 1, at.select("branch", "state", F.lit(first).alias("silent"), F.lit(last + 1).alias("until")))


def replay_mismatches(sequences: DataFrame, records: DataFrame, first: int, last: int, tolerance: float = 1e-9) -> DataFrame:
    """(branch, step, reason) of the steps of an interval that do not come out again with the same batch and loss; a step that never had a loss differs."""
    keyed = lambda d: outcomes(d).where(F.col("step").between(first, last)).select(F.struct("branch", "step").alias("step"), "batch_hash", "loss")
    return L.mismatches(keyed(records), keyed(replay(sequences, records, first, last)), tolerance).select("step.branch", "step.step", "reason")


def fork(sequences: DataFrame, records: DataFrame, at: int, suffix: str, steps: int) -> DataFrame:
    """The records of new branches, named branch + suffix, from the last checkpoint at or before at; nothing of the old ones changes."""
    begin = checkpoint_as_of(records, records.select("branch").distinct().withColumn("upto", F.lit(at)))
    new = F.concat("branch", F.lit(suffix))
    return run(sequences.withColumn("branch", new), steps, begin.select(new.alias("branch"), "state", F.col("checkpoint").alias("silent"), F.lit(None).cast("int").alias("until")))


def ledgers(records: DataFrame) -> DataFrame:
    """The chained ledgers of records: (chain, index, record_type, payload, prev_hash, chain_hash), one of consumption and one of learning for each branch."""
    kind = F.when(F.col("record_type") == "BATCH_LOSS", "learning_").when(F.col("record_type").isin("INTENT", "COMMIT"), "consumption_")
    rows = records.withColumn("kind", kind).where("kind is not null").withColumn("chain", F.concat("kind", "branch"))
    index = F.row_number().over(Window.partitionBy("chain").orderBy("place")).cast("bigint") - 1
    return L.build(rows.select("chain", index.alias("index"), "record_type", "payload"))


def scoring_rounds(candidates: DataFrame, rounds: int, lanes: int, budget: int = config.POOL, need: int = 0, score: Callable | None = None) -> DataFrame:
    """(lane, round, queue_index, id, score, classification, defer_count): what the scoring rounds decide.

    candidates: (lane, queue_index, id). A round goes on where the lane's last one stopped, through budget // lanes
    candidates, or max(4, budget // lanes) in the further round that a lane gets while need of it are not
    accepted, and stops at a deferred one, which comes first in the next round. One lane is one fold over what its
    rounds can reach.
    """
    score = score or (lambda i, r: 2 * keyed_loss(r, i) - 1)
    per, fallback = budget // lanes, max(4, budget // lanes)
    most = rounds * (per + fallback)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf.sort_values("queue_index")
        lane, ids, places = own["lane"].iloc[0], own["id"].tolist(), own["queue_index"].tolist()
        at, defers, accepted, rows = 0, 0, 0, []
        for r in range(rounds):
            for further, size in enumerate((per, fallback)):
                if further and accepted >= need * (r + 1):
                    break
                for _ in range(size):
                    if at >= len(ids):
                        break
                    s = score(ids[at], r)
                    kind = "ACCEPT" if s >= config.ACCEPT + config.BAND else "REJECT" if s <= config.ACCEPT - config.BAND else "DEFER"
                    defers += kind == "DEFER"
                    if kind == "DEFER" and defers > config.MAX_DEFERS:
                        kind = "REJECT"
                    rows.append((lane, r, places[at], ids[at], s, kind, defers))
                    if kind == "DEFER":
                        break
                    accepted += kind == "ACCEPT"
                    at, defers = at + 1, 0
        return pd.DataFrame(rows, columns=["lane", "round", "queue_index", "id", "score", "classification", "defer_count"])

    reach = candidates.withColumn("r", F.row_number().over(Window.partitionBy("lane").orderBy("queue_index"))).where(F.col("r") <= most).drop("r")
    return reach.groupBy("lane").applyInPandas(fold, "lane string, round int, queue_index bigint, id string, score double, classification string, defer_count int")
