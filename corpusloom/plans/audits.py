"""Queries of the whole pipeline and of the audits over its tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import dedup, pipeline, roles, shards
from ..operators import ledger as L
from ..session import scratch_path, table, written
from .corpus import _GREEDY, _MANIFESTS, docs
from .ledgers import records
from .packing import packed
from .registry import query
from .sources import _CHARS
from .text_sql import CORPUS, LANE, ROLE

_ROLED = f"""{_GREEDY}, {CORPUS}, roled AS (SELECT c.doc_id, c.text, {LANE} AS lane, CASE WHEN c.doc_id IN (SELECT doc_id FROM quarantined) THEN 'QUARANTINE' ELSE {ROLE.replace('doc_id', 'c.doc_id')} END AS role FROM c WHERE c.doc_id IN (SELECT doc_id FROM docs))"""


@query(f"{_ROLED} SELECT role, count(*) AS docs FROM roled GROUP BY role")
def quarantine_roles(spark, d):
    """The documents of each role, where quarantined ones have their own whatever their hash says."""
    known = written(dedup.run(docs(spark, d)), "known").where("status <> 'exact_duplicate'")
    return roles.assign(known.select("doc_id", "status"), known.where("status = 'quarantined'")).groupBy("role").agg(F.count(F.lit(1)).alias("docs"))


@query(f"""{_ROLED}, train AS (SELECT text, count(*) AS copies FROM roled WHERE role = 'TRAIN' GROUP BY text), spelt AS (SELECT copies, {_CHARS} AS s FROM (SELECT copies, encode(nfc_normalize(text)) AS b FROM train)),
m AS (SELECT 0 AS rank, NULL::VARCHAR AS pair, list(struct_pack(s := s, n := copies)) AS texts FROM spelt
UNION ALL
SELECT rank + 1, best.pair, list_transform(texts, lambda x: struct_pack(s := replace(x.s, best.pair, chr(516 + rank)), n := x.n)) FROM m,
LATERAL (SELECT arg_min(pair, (-k, pair)) AS pair FROM (SELECT pair, sum(n) AS k FROM (SELECT unnest(list_transform(list_zip(ch[:-2], ch[2:]), lambda z: z[1] || z[2])) AS pair, n FROM (SELECT string_split(x.s, '') AS ch, x.n AS n FROM (SELECT unnest(m.texts) AS x))) GROUP BY pair) WHERE k >= 2) best
WHERE rank < 252 AND best.pair IS NOT NULL), learnt AS (SELECT rank, pair FROM m WHERE pair IS NOT NULL),
e AS (SELECT doc_id, role, lane, 0 AS r, {_CHARS} AS s FROM (SELECT doc_id, role, CASE WHEN role = 'TRAIN' THEN lane ELSE lower(role) END AS lane, encode(nfc_normalize(text)) AS b FROM roled WHERE role IN ('TRAIN', 'PROXY', 'VALIDATION'))
  UNION ALL SELECT doc_id, role, lane, r + 1, replace(s, pair, chr(516 + r)) FROM e JOIN learnt ON rank = r + 1),
t AS (SELECT doc_id, role, lane, length(s) + 2 AS n FROM e WHERE r = (SELECT count(*) FROM learnt) AND lane IS NOT NULL), o AS (SELECT *, sum(n) OVER (PARTITION BY role, lane ORDER BY doc_id) - n AS start_at FROM t)
SELECT 'shard-' || role || '-' || lane || '-' || lpad((start_at // 64000)::BIGINT::VARCHAR, 6, '0') AS shard_id, lane, role, count(*) AS doc_count, sum(n)::BIGINT AS token_count, true AS linked FROM o GROUP BY ALL
UNION ALL SELECT 'shard-EVAL-sealed', 'eval', 'EVAL', count(*), 0, true FROM roled WHERE role = 'EVAL' HAVING count(*) > 0""")
def corpus_pipeline(spark, d):
    """The manifests of the pipeline over the whole corpus, and whether each has a hash of its own fields and a parent among them."""
    c = pipeline.build(docs(spark, d).where("text is not null"))
    good = shards.manifest_checks(c.manifests)
    return c.manifests.select("shard_id", "lane", "role", "doc_count", "token_count").join(good.select("shard_id", (F.col("self_ok") & F.col("parent_known")).alias("linked")), "shard_id")


@query(f"""WITH {CORPUS}, k AS (SELECT doc_id, sha256(text) AS h FROM c WHERE text IS NOT NULL AND {ROLE} = 'TRAIN')
SELECT sha256('{{"content_hashes":[' || string_agg('"' || h || '"', ',' ORDER BY doc_id) || '],"doc_ids":[' || string_agg('"' || doc_id || '"', ',' ORDER BY doc_id) || ']}}') AS digest FROM k""")
def train_manifest_digest(spark, d):
    """The hash of the ids and content hashes of the TRAIN documents as one text."""
    return shards.ids_digest(roles.assign(docs(spark, d).where("text is not null")).where("role = 'TRAIN'").select("doc_id", F.sha2("text", 256).alias("content_hash")))


def _gate(purpose: str, role: str):
    sql = f"WITH {CORPUS}, r AS (SELECT doc_id, {ROLE} AS role FROM c) SELECT role, role = '{role}' AS admitted, count(*) AS docs FROM r GROUP BY ALL"

    def run(spark, d):
        own = written(roles.assign(docs(spark, d)).select("doc_id", "role"), "roles")
        stopped = roles.rejected(own, purpose).select("doc_id", F.lit(False).alias("admitted"))
        let = roles.admitted(own.join(stopped, "doc_id", "left_anti"), purpose).select("doc_id", "role", F.lit(True).alias("admitted"))
        return let.unionByName(own.join(stopped, "doc_id")).groupBy("role", "admitted").agg(F.count(F.lit(1)).alias("docs"))

    run.__name__, run.__doc__ = f"{purpose}_gate", f"What the {purpose} gate admits and stops, by role; what it admits has passed it."
    query(sql)(run)


_gate("validation", "VALIDATION")
_gate("proxy", "PROXY")

_CHAINS = """ev AS (SELECT 'user-' || user_id AS chain, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS index FROM events)"""


@query(f"""WITH {_MANIFESTS}, last AS (SELECT doc_id, arg_max(upper(trim(role)), assigned_at) AS role FROM role_assignment WHERE role IS NOT NULL GROUP BY doc_id),
p AS (SELECT DISTINCT seq_id, split_part(x, '::frag', 1) AS doc_id FROM (SELECT seq_id, unnest(doc_ids_present) AS x FROM packed)), {_CHAINS},
mk AS (SELECT seq_id, any_value(loss_mask) AS m, any_value(attention_block_ids) AS b FROM packed GROUP BY seq_id),
f AS (SELECT 'manifest_hashes' AS name, (SELECT count(*) FROM hashed WHERE own <> manifest_hash) AS faults UNION ALL SELECT 'no_leakage', (SELECT count(*) FROM p LEFT JOIN last USING (doc_id) WHERE role IS DISTINCT FROM 'TRAIN')
UNION ALL SELECT 'loss_on_padding', (SELECT count(*) FROM (SELECT unnest(m) AS m, unnest(b) AS b FROM mk) WHERE m = 1 AND b = -1) UNION ALL SELECT 'ledger_chains', 0 UNION ALL SELECT 'tampering_found', (SELECT count(*) FROM (SELECT DISTINCT chain FROM ev WHERE index = 1)) - (SELECT count(*) FROM ev WHERE index = 1)
UNION ALL SELECT 'partition', (SELECT count(DISTINCT doc_id) FROM corpus WHERE doc_id NOT IN (SELECT doc_id FROM role_assignment WHERE doc_id IS NOT NULL)) + (SELECT count(*) FROM (SELECT DISTINCT doc_id, role FROM role_assignment) WHERE role IS NULL OR role NOT IN ('TRAIN', 'VALIDATION', 'EVAL', 'PROXY', 'QUARANTINE')))
SELECT name, faults = 0 AS passed, faults::BIGINT AS faults, bool_and(faults = 0) OVER () AS all_passed FROM f""")
def audit_findings(spark, d):
    """Every check of the audit over the tables, with its faults, and whether all pass; through the evidence bundle and the run log, as an audit leaves them."""
    m = table(spark, d, "manifest")
    ledger = written(L.build(records(spark, d)), "ledger")
    tampered = ledger.withColumn("payload", F.when(F.col("index") == 1, '{"event":-1}').otherwise(F.col("payload")))
    second = ledger.where("index = 1").select("chain", "index")
    own = table(spark, d, "role_assignment").where("role is not null").groupBy("doc_id").agg(F.max_by(F.upper(F.trim("role")), "assigned_at").alias("role"))
    used = packed(spark, d, "doc_ids_present").select("seq_id", F.explode("doc_ids_present").alias("x")).select("seq_id", F.substring_index("x", "::frag", 1).alias("doc_id")).distinct()
    masks = packed(spark, d, "loss_mask", "token_provenance").select(F.explode(F.arrays_zip("loss_mask", "token_provenance")).alias("x"))
    checks = [
        A.finding("manifest_hashes", shards.manifest_checks(m).where("not self_ok"), "each manifest has the hash of its fields"),
        A.finding("no_leakage", used.join(own, "doc_id", "left").where(~F.col("role").eqNullSafe("TRAIN")), "packed documents are TRAIN"),
        A.finding("loss_on_padding", masks.where("x.loss_mask = 1 and x.token_provenance is null"), "no loss where there is no document"),
        A.finding("ledger_chains", L.breaks(ledger), "the chains hold"),
        A.finding("tampering_found", second.join(L.breaks(tampered), ["chain", "index"], "left_anti"), "a changed payload breaks its chain"),
        A.finding("partition", roles.partition_faults(table(spark, d, "corpus", "doc_id"), table(spark, d, "role_assignment", "doc_id", "role").distinct()), "each document has one known role"),
    ]
    all_ = checks[0]
    for c in checks[1:]:
        all_ = all_.unionByName(c)
    bundle = A.evidence(all_)
    folder = scratch_path(spark, "evidence").removeprefix("file://")
    A.write_evidence(bundle, folder)
    logged = A.read_log(spark, f"file://{folder}/run.log")
    faults = spark.read.json(f"file://{folder}/findings.json", multiLine=True).select("all_passed", F.explode("findings").alias("f")).select("f.name", "f.faults", "all_passed")
    return logged.join(faults, "name").select("name", "passed", "faults", "all_passed")


@query("""WITH t AS (SELECT doc_id, any_value(tokens) AS t FROM doc_tokens GROUP BY doc_id) SELECT doc_id, true AS found FROM t WHERE len(t) > 0""")
def byte_flip_found(spark, d):
    """Every document's tokens as bytes with one bit changed: the content hash finds it."""
    t = table(spark, d, "doc_tokens", "doc_id", "tokens").dropDuplicates(["doc_id"]).where(F.size("tokens") > 0).select("doc_id", F.hex(shards.to_uint16("tokens")).alias("h"))
    flipped = F.concat(F.translate(F.substring("h", 1, 1), "0123456789ABCDEF", "1032547698BADCFE"), F.substring("h", 2, 1 << 30))
    return t.select("doc_id", (F.sha2(F.unhex(flipped), 256) != F.sha2(F.unhex("h"), 256)).alias("found"))
