"""Queries over ledgers. The driver's events stand for ledger records: a chain a user, one record an event."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


from ..functions import hashing as H
from ..operators import ledger as L
from ..session import scratch_path, table
from .packing import packed
from .registry import query


def records(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    payload = F.concat(F.lit('{"event":'), F.col("event_id").cast("string"), F.lit("}"))
    index = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("bigint") - 1
    return e.select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("chain"), index.alias("index"), F.upper("event_type").alias("record_type"), payload.alias("payload"))


_REC = """r AS (SELECT 'user-' || user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS index, upper(event_type) AS record_type, '{"event":' || event_id || '}' AS payload FROM events)"""


_CHAINED = f"""WITH RECURSIVE {_REC}, c AS (
SELECT chain, index, 'GENESIS' AS prev_hash, sha256('GENESIS|{{"index":' || index || ',"payload":' || payload || ',"record_type":"' || record_type || '"}}') AS chain_hash FROM r WHERE index = 0
UNION ALL SELECT r.chain, r.index, c.chain_hash, sha256(c.chain_hash || '|{{"index":' || r.index || ',"payload":' || r.payload || ',"record_type":"' || r.record_type || '"}}') FROM c JOIN r ON r.chain = c.chain AND r.index = c.index + 1)
SELECT chain, index, prev_hash, chain_hash FROM c"""


@query(_CHAINED)
def ledger_chain_build(spark, d):
    return L.build(records(spark, d)).select("chain", "index", "prev_hash", "chain_hash")


@query(_CHAINED)
def ledger_appended(spark, d):
    """The ledgers written to a table in two goes, the second chained to what the first left there."""
    r = records(spark, d)
    path = scratch_path(spark, "ledger")
    L.build(r.where("index < 3")).write.parquet(path)
    L.appended(spark.read.parquet(path), r.where("index >= 3").withColumnRenamed("index", "at")).write.mode("append").parquet(path)
    return spark.read.parquet(path).select("chain", "index", "prev_hash", "chain_hash")


@query(f"""WITH {_REC}, n AS (SELECT chain, max(index) AS last FROM r GROUP BY chain) SELECT chain, 1::BIGINT AS index FROM n WHERE last >= 1 AND chain LIKE '%7' """)
def ledger_chain_verify(spark, d):
    """Chains of which every tenth had its second record tampered with: the verification finds just those records."""
    built = L.build(records(spark, d))
    hit = (F.col("index") == 1) & F.col("chain").endswith("7")
    return L.breaks(built.withColumn("payload", F.when(hit, '{"event":0}').otherwise(F.col("payload"))))


def _commits(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    one = lambda kind: e.where(F.col("event_type") == kind).select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("chain"), (F.col("event_id") % 50).alias("step"), F.lit("b").alias("batch_id"), F.col("event_id").alias("index"))
    return one("click"), one("purchase")


@query("""SELECT 'user-' || c.user_id AS chain, c.event_id % 50 AS step, c.event_id AS index FROM events c WHERE c.event_type = 'click' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.user_id = c.user_id AND p.event_id % 50 = c.event_id % 50)""")
def orphan_intents(spark, d):
    i, c = _commits(spark, d)
    return L.unmatched(i, c).select("chain", "step", "index")


@query("""SELECT 'user-' || c.user_id AS chain, c.event_id % 50 AS step, c.event_id AS index FROM events c WHERE c.event_type = 'click' AND c.event_id <= (SELECT max(event_id) // 2 FROM events) AND NOT EXISTS (SELECT 1 FROM events p WHERE p.event_type = 'purchase' AND p.event_id <= (SELECT max(event_id) // 2 FROM events) AND p.user_id = c.user_id AND p.event_id % 50 = c.event_id % 50)""")
def orphan_intents_as_of(spark, d):
    """The ledger as it stood half-way: what a resume would have found, before any retry."""
    i, c = _commits(spark, d)
    half = table(spark, d, "events", "event_id").agg(F.max("event_id")).collect()[0][0] // 2  # one number
    return L.unmatched(i, c, half).select("chain", "step", "index")


@query("SELECT coalesce(max(event_id % 50), -1) AS last_step FROM events WHERE event_type = 'purchase'")
def last_committed_step(spark, d):
    return L.last_committed(_commits(spark, d)[1])


@query("SELECT event_id, user_id, event_type FROM events WHERE event_id % 50 BETWEEN 6 AND 12")
def step_range_scan(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "event_type").where((F.col("event_id") % 50).between(6, 12))


_STEP = """o AS (SELECT event_id % 500 AS step, count(*) AS n, sum(value::DECIMAL(18, 4))::DOUBLE AS loss FROM events WHERE event_type <> 'error' GROUP BY 1),
p AS (SELECT event_id % 500 AS step, count(*) AS n, sum(value::DECIMAL(18, 4))::DOUBLE AS loss FROM events WHERE event_type <> 'signup' OR event_id % 2 = 0 GROUP BY 1)"""


@query(f"""WITH {_STEP} SELECT step, CASE WHEN p.n IS NULL THEN 'missing' WHEN o.n IS NULL THEN 'extra' WHEN o.n <> p.n THEN 'batch' ELSE 'loss' END AS reason FROM o FULL JOIN p USING (step)
WHERE o.n IS NULL OR p.n IS NULL OR o.n <> p.n OR abs(o.loss - p.loss) > 1e-9""")
def replay_mismatch(spark, d):
    e = table(spark, d, "events", "event_id", "event_type", "value").withColumn("step", F.col("event_id") % 500)
    side = lambda f: e.where(f).groupBy("step").agg(F.count(F.lit(1)).cast("string").alias("batch_hash"), F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("loss"))
    return L.mismatches(side("event_type <> 'error'"), side("event_type <> 'signup' or event_id % 2 = 0"))


@query("""WITH p AS (SELECT DISTINCT seq_id, lane, group_index FROM packed) SELECT lane, group_index, sha256('{"seq_ids":["' || string_agg(seq_id, '","' ORDER BY seq_id) || '"]}') AS batch_hash FROM p GROUP BY ALL""")
def batch_hash(spark, d):
    return packed(spark, d, "lane", "group_index").groupBy("lane", "group_index").agg(H.batch_hash_column(F.collect_list("seq_id")).alias("batch_hash"))


@query("""WITH c AS (SELECT user_id, event_id % 50 AS step, count(*) AS n_sequences FROM events WHERE event_type = 'purchase' GROUP BY ALL),
l AS (SELECT user_id, event_id % 50 AS step, round(avg(value), 6) AS avg_loss FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT user_id, step, n_sequences, avg_loss FROM c JOIN l USING (user_id, step)""")
def batch_link(spark, d):
    """Consumption joined to learning on the batch."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value").withColumn("step", F.col("event_id") % 50)
    c = e.where("event_type = 'purchase'").groupBy("user_id", "step").agg(F.count(F.lit(1)).alias("n_sequences"))
    return c.join(e.where("event_type = 'view'").groupBy("user_id", "step").agg(F.round(F.avg("value"), 6).alias("avg_loss")), ["user_id", "step"])


@query("""WITH i AS (SELECT item_id, unnest([1, 2, 3]) AS pos, item_id AS base FROM eval_items) SELECT i.item_id, pos::INTEGER AS pos, e.task FROM i JOIN eval_items e ON e.item_id = (base + pos) % 200""")
def id_lookup_in_order(spark, d):
    """Ids looked up in another table, their order kept."""
    e = table(spark, d, "eval_items", "item_id", "task")
    ids = e.select("item_id", F.posexplode(F.transform(F.array(*[F.lit(k) for k in (1, 2, 3)]), lambda k: (F.col("item_id") + k) % 200)).alias("pos", "ref"))
    return ids.join(e.select(F.col("item_id").alias("ref"), "task"), "ref").select("item_id", (F.col("pos") + 1).alias("pos"), "task")


@query("""WITH k AS (SELECT user_id, event_id AS step FROM events WHERE event_type = 'signup'), q AS (SELECT event_id AS asked, user_id FROM events WHERE event_type = 'error')
SELECT asked, q.user_id, max(step) AS checkpoint FROM q LEFT JOIN k ON k.user_id = q.user_id AND step <= asked GROUP BY ALL""")
def checkpoint_as_of(spark, d):
    """For each error, the last checkpoint (signup) of its user at or before it: an as-of join by a window over the union."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type").where(F.col("event_type").isin("signup", "error"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = e.withColumn("checkpoint", F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).over(w))
    return seen.where("event_type = 'error'").select(F.col("event_id").alias("asked"), "user_id", "checkpoint")



