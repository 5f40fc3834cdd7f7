"""Queries over runs: the scheduler, crash and resume, replay, fork, rollback and scoring rounds.

The packed sequences are the queues of 16 branches. Their SQL draws every sequence anew by a recursive query of
its own, one draw an iteration, with all of the state in columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config
from ..operators import ledger as L
from ..operators import mixture as M
from ..operators import recovery as R
from ..session import written
from .registry import query
from .selection import draws

STEPS, CRASH = 30, 13
_N = sorted(M.ALL_LANES)
_I = {n: k for k, n in enumerate(_N)}


def queues(spark, d):
    return draws(spark, d).select("branch", "lane", "seq_id", "effective", "total")


def _hash_loss(step: str, what: str) -> str:
    return f"(('0x' || substr(sha256({step} || '|' || {what}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def schedule_sql(steps: int, govern: bool) -> str:
    """CTEs up to drawn (branch, step, draw, seq_id, lane, effective, stage) and happened (branch, step, kind, lane)."""
    weight = lambda stage, n: config.STAGES[stage].weights.get(n)
    literal = lambda w: "NULL::DOUBLE" if w is None else f"{w!r}::DOUBLE"
    all_of = lambda f, sep=", ": sep.join(f(k) for k in range(len(_N)))
    scale = "(" + " + ".join(f"coalesce(w{k}, 0)" for k in range(len(_N))) + ")"
    drawn = "(" + " + ".join(f"CASE WHEN w{k} IS NULL THEN 0 ELSE d{k} END" for k in range(len(_N))) + ")"
    gap = lambda k: f"CASE WHEN w{k} IS NOT NULL AND NOT list_contains(ended, {k}) THEN w{k} / {scale} * {drawn} - d{k} END"
    cut = lambda k: f"(w{k} * CASE WHEN worst = {k} THEN {config.DEMOTION}::DOUBLE ELSE 1.0::DOUBLE END)"
    cut_scale = "(" + " + ".join(f"coalesce({cut(k)}, 0)" for k in range(len(_N))) + ")"
    next_weight = lambda k: "CASE stage " + " ".join(f"WHEN {s} THEN {literal(weight(s + 1, _N[k]))}" for s in range(len(config.STAGES) - 1)) + " END"
    in_plan = "CASE " + " ".join(f"WHEN w{_I[n]} IS NOT NULL AND d{_I[n]} = greatest({all_of(lambda k: f'CASE WHEN w{k} IS NOT NULL THEN d{k} ELSE -1 END')}) THEN {_I[n]}" for n in M.ALL_LANES) + " END"
    pick = "CASE WHEN best_gap IS NULL THEN NULL " + " ".join(f"WHEN g{k} = best_gap THEN {k}" for k in range(len(_N))) + " END"
    names = "CASE lane " + " ".join(f"WHEN '{n}' THEN {k}" for n, k in _I.items()) + " END"
    return f"""qq AS (SELECT branch, {names} AS ln, row_number() OVER (PARTITION BY branch, lane ORDER BY seq_id) - 1 AS pos, seq_id, effective FROM draws),
r AS (SELECT DISTINCT branch, 0 AS step, 0 AS k, 0 AS n, []::INTEGER[] AS ended, 0 AS stage, 0 AS since, NULL::DOUBLE AS best, false AS rolled, {all_of(lambda k: f'0::BIGINT AS d{k}')}, {all_of(lambda k: f'0::BIGINT AS h{k}')}, {all_of(lambda k: f'{literal(weight(0, _N[k]))} AS w{k}')},
  NULL::VARCHAR AS seq_id, NULL::INTEGER AS ln, NULL::BIGINT AS effective, NULL::INTEGER AS at_step, NULL::INTEGER AS at_stage, NULL::VARCHAR AS kind, NULL::INTEGER AS what FROM draws
UNION ALL
SELECT branch, CASE WHEN over THEN step + 1 ELSE step END, CASE WHEN over THEN 0 ELSE k1 END, n + got, CASE WHEN over THEN []::INTEGER[] WHEN got = 0 THEN list_append(ended, c) ELSE ended END,
  CASE WHEN event = 'STAGE' THEN stage + 1 ELSE stage END, CASE WHEN event = 'STAGE' THEN 0 ELSE since END, CASE WHEN val IS NULL THEN best ELSE least(coalesce(best, val), val) END, rolled OR coalesce(event = 'ROLLBACK', false),
  {all_of(lambda k: f'd{k}')}, {all_of(lambda k: f'h{k}')}, {all_of(lambda k: f"CASE event WHEN 'STAGE' THEN {next_weight(k)} WHEN 'ROLLBACK' THEN {cut(k)} / {cut_scale} ELSE w{k} END")},
  x.seq_id, c, x.effective, step, stage, event, worst
FROM (SELECT *, CASE WHEN NOT over OR step % 3 <> 2 THEN NULL WHEN {'val > best + ' + repr(config.ROLLBACK_MARGIN) + '::DOUBLE AND NOT rolled' if govern else 'false'} THEN 'ROLLBACK' WHEN stage < {len(config.STAGES) - 1} AND since >= {config.ADVANCE_STEPS} THEN 'STAGE' END AS event
FROM (SELECT *, {in_plan} AS worst, CASE WHEN over AND step % 3 = 2 THEN {_hash_loss('step', "'validation'")} END AS val
FROM (SELECT * REPLACE ({all_of(lambda k: f'd{k} + CASE WHEN c = {k} THEN coalesce(eff, 0) ELSE 0 END AS d{k}')}, {all_of(lambda k: f'h{k} + CASE WHEN c = {k} THEN got ELSE 0 END AS h{k}')}, since + got AS since), k + got AS k1, k + got = {config.BATCH} OR c IS NULL AS over
FROM (SELECT p.*, q.seq_id AS seq, q.effective AS eff, CASE WHEN q.seq_id IS NULL THEN 0 ELSE 1 END AS got
FROM (SELECT *, {pick} AS c FROM (SELECT *, greatest({all_of(lambda k: f'g{k}')}) AS best_gap FROM (SELECT r.* EXCLUDE (seq_id, ln, effective, at_step, at_stage, kind, what), {all_of(lambda k: f'{gap(k)} AS g{k}')} FROM r WHERE step < {steps}))) p
LEFT JOIN qq q ON q.branch = p.branch AND q.ln = p.c AND q.pos = CASE p.c {all_of(lambda k: f'WHEN {k} THEN p.h{k}', ' ')} END)))) y, LATERAL (SELECT y.seq AS seq_id, y.eff AS effective) x),
drawn AS (SELECT branch, at_step AS step, n - 1 AS draw, seq_id, CASE ln {' '.join(f"WHEN {k} THEN '{n}'" for n, k in _I.items())} END AS lane, effective, at_stage AS stage FROM r WHERE seq_id IS NOT NULL),
happened AS (SELECT branch, at_step AS step, kind, CASE WHEN kind = 'ROLLBACK' THEN CASE what {' '.join(f"WHEN {k} THEN '{n}'" for n, k in _I.items())} END END AS lane FROM r WHERE kind IS NOT NULL)"""


def _sql(govern: bool, select: str) -> str:
    from .selection import _DRAWS

    return f"WITH RECURSIVE {_DRAWS}, {schedule_sql(STEPS, govern)}, {_BATCHES}\n{select}"


_BATCHES = f"""each AS (SELECT *, {_hash_loss('step', 'seq_id')} AS loss FROM drawn),
batches AS (SELECT branch, step, sha256('{{"seq_ids":["' || string_agg(seq_id, '","' ORDER BY seq_id) || '"]}}') AS batch_hash, round(sum(loss * effective) / nullif(sum(effective), 0), 9) AS loss FROM each GROUP BY ALL)"""


@query(_sql(False, "SELECT branch, step, draw::INTEGER AS draw, seq_id, lane, effective, stage FROM drawn"))
def schedule_simulation(spark, d):
    """30 steps of the deficit scheduler in each branch, stages and all."""
    return M.simulate(queues(spark, d), STEPS)


def _records(spark, d, **options):
    return written(R.run(queues(spark, d), options.pop("steps", STEPS), **options), "records")


def _outcomes(records):
    return R.outcomes(records).select("branch", "step", "batch_hash", F.round("loss", 9).alias("loss"))


@query(_sql(True, "SELECT branch, step, batch_hash, loss FROM batches"))
def run_steps(spark, d):
    """The batch and the loss of every step of every branch, by INTENT and BATCH_LOSS."""
    return _outcomes(_records(spark, d))


@query(_sql(True, f"SELECT branch, step, batch_hash, loss FROM batches WHERE step >= {CRASH}"))
def run_resumed(spark, d):
    """All branches crash after the INTENT of step 13 and resume from their last checkpoint: the steps from there come out as if nothing had been."""
    crashed = _records(spark, d, crash_at=CRASH)
    return _outcomes(written(R.resume(queues(spark, d), crashed, STEPS), "resumed"))


@query(_sql(True, f"SELECT DISTINCT branch, step, 'batch-' || branch || '-' || step AS batch_id, {CRASH - 1} AS last_step FROM batches WHERE step = {CRASH}"))
def run_orphans(spark, d):
    """The INTENTs that the crash left without a COMMIT, and the last committed step of their branch."""
    crashed = _records(spark, d, crash_at=CRASH)
    return R.orphans(crashed).join(R.last_committed(crashed), "branch")


@query(_sql(True, "SELECT branch, step, batch_hash, loss FROM batches WHERE step BETWEEN 6 AND 12"))
def run_replayed(spark, d):
    """Steps 6 to 12, computed anew from the last checkpoint before them."""
    return _outcomes(written(R.replay(queues(spark, d), _records(spark, d), 6, 12), "replayed"))


@query(_sql(True, """SELECT branch, step, CASE WHEN step = 7 THEN 'batch' ELSE 'loss' END AS reason FROM batches WHERE step = 7 OR step = 9 AND loss IS NOT NULL"""))
def run_replay_mismatches(spark, d):
    """The replay against a ledger in which the batch hash of step 7 and the loss of step 9 were changed: it finds these, and no other."""
    records = _records(spark, d)
    changed = F.when((F.col("step") == 7) & (F.col("record_type") == "INTENT"), F.regexp_replace("payload", '"batch_hash":"..', '"batch_hash":"zz'))
    changed = changed.when((F.col("step") == 9) & (F.col("record_type") == "BATCH_LOSS"), F.regexp_replace("payload", r'"avg_loss":\d', '"avg_loss":7')).otherwise(F.col("payload"))
    return R.replay_mismatches(queues(spark, d), written(records.withColumn("payload", changed), "changed"), 6, 12)


@query(_sql(True, "SELECT branch || '-fork-18' AS branch, step, batch_hash, loss FROM batches WHERE step >= 18"))
def run_forked(spark, d):
    """Forks from the checkpoint at step 18: new branches, whose steps are those of the old."""
    return _outcomes(written(R.fork(queues(spark, d), _records(spark, d), 18, "-fork-18", STEPS), "forked"))


@query(_sql(True, "SELECT branch, step, kind AS record_type, lane FROM happened"))
def run_events(spark, d):
    """The stage advances, and the one rollback of each branch with the lane it demotes."""
    own = _records(spark, d).where(F.col("record_type").isin("STAGE", "ROLLBACK"))
    return own.select("branch", "step", "record_type", F.get_json_object("payload", "$.lane").alias("lane"))


@query(_sql(True, """SELECT branch, step, lane, round(avg(loss), 9) AS lane_loss FROM each GROUP BY ALL"""))
def run_lane_losses(spark, d):
    """The unweighted mean of a step's sequences by lane, as BATCH_LOSS carries it."""
    own = _records(spark, d).where("record_type = 'BATCH_LOSS'")
    by = F.from_json(F.get_json_object("payload", "$.per_lane_avg_loss"), "map<string,double>")
    return own.select("branch", "step", F.explode(by).alias("lane", "x")).select("branch", "step", "lane", F.round("x", 9).alias("lane_loss"))


@query(_sql(True, """SELECT chain, count(*) AS records, true AS whole FROM (SELECT 'learning_' || branch AS chain, step FROM batches UNION ALL SELECT 'consumption_' || branch, unnest([step, step]) FROM batches) GROUP BY chain"""))
def run_ledgers(spark, d):
    """The chained ledgers of every branch: their records, and whether their chains hold."""
    built = written(R.ledgers(_records(spark, d)), "ledgers")
    broken = L.breaks(built).select("chain", F.lit(True).alias("broken")).distinct()
    return built.groupBy("chain").agg(F.count(F.lit(1)).alias("records")).join(broken, "chain", "left").select("chain", "records", F.col("broken").isNull().alias("whole"))


_CANDS = """p AS (SELECT seq_id AS id, any_value(lane) AS lane FROM packed GROUP BY seq_id), c AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY id) - 1 AS i FROM p),
m AS (SELECT lane, count(*) AS n FROM c GROUP BY lane),"""
_SCORE = "2 * (('0x' || substr(sha256(round || '|' || c.id), 1, 8))::BIGINT / 4294967296.0::DOUBLE) - 1"


@query(f"""WITH RECURSIVE {_CANDS}
s AS (SELECT lane, 0 AS round, 0 AS used, false AS extra, 0::BIGINT AS i, 0 AS defers, 0 AS accepted, NULL::BIGINT AS queue_index, NULL::VARCHAR AS id, NULL::DOUBLE AS score, NULL::VARCHAR AS kind, NULL::INTEGER AS defer_count, NULL::INTEGER AS in_round FROM m
UNION ALL
SELECT lane, CASE WHEN done AND (extra OR acc >= 2 * (round + 1)) THEN round + 1 ELSE round END, CASE WHEN done THEN 0 ELSE used + 1 END, CASE WHEN done THEN NOT extra AND acc < 2 * (round + 1) ELSE extra END,
  CASE WHEN kind IS NULL OR kind = 'DEFER' THEN i ELSE i + 1 END, CASE WHEN kind IS NULL THEN defers WHEN kind = 'DEFER' THEN df ELSE 0 END, acc, CASE WHEN kind IS NOT NULL THEN i END, cid, sc, kind, df, round
FROM (SELECT *, kind IS NULL OR kind = 'DEFER' OR used + 1 = 4 OR i + 1 >= n AS done, accepted + coalesce((kind = 'ACCEPT')::INTEGER, 0) AS acc
FROM (SELECT *, CASE WHEN rule = 'DEFER' AND df > {config.MAX_DEFERS} THEN 'REJECT' ELSE rule END AS kind
FROM (SELECT *, defers + (rule = 'DEFER')::INTEGER AS df FROM (SELECT *, CASE WHEN sc >= 0.15::DOUBLE THEN 'ACCEPT' WHEN sc <= -0.15::DOUBLE THEN 'REJECT' WHEN sc IS NOT NULL THEN 'DEFER' END AS rule
FROM (SELECT s.lane, s.round, s.used, s.extra, s.i, s.defers, s.accepted, m.n, c.id AS cid, {_SCORE} AS sc FROM s JOIN m ON m.lane = s.lane LEFT JOIN c ON c.lane = s.lane AND c.i = s.i WHERE s.round < 8))))))
SELECT lane, in_round AS round, queue_index, id, round(score, 9) AS score, kind AS classification, defer_count FROM s WHERE kind IS NOT NULL""")
def scoring_rounds(spark, d):
    """Eight rounds over the lanes' queues, 24 // 5 candidates a lane, with a further round for lanes that accepted fewer than two a round."""
    from pyspark.sql import Window

    from .packing import packed

    own = packed(spark, d, "lane").select(F.col("seq_id").alias("id"), "lane")
    own = own.withColumn("queue_index", F.row_number().over(Window.partitionBy("lane").orderBy("id")).cast("bigint") - 1)
    return R.scoring_rounds(own, 8, 5, need=2).withColumn("score", F.round("score", 9))
