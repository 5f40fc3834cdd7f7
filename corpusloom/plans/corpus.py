"""Queries over the corpus: lanes, roles, duplicates, words, shingles, manifests, leakage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.normal import nfc
from ..operators import dedup, roles, shards
from ..session import table, written
from ..sources.formats import ingest
from .registry import query
from .text_sql import BUCKET, CORPUS, DOCS, LANE, PAIRS, ROLE, SHINGLED, WORDS


def docs(spark, d):
    """Each corpus document once: (doc_id, tier, type, source, text)."""
    low = lambda c: F.min(F.lower(F.trim(c))).alias(c)
    return table(spark, d, "corpus", "doc_id", "tier", "type", "source", "text").groupBy("doc_id").agg(low("tier"), low("type"), low("source"), F.max("text").alias("text"))


@query(
    f"""WITH {CORPUS}, l AS (SELECT {LANE} AS lane, {ROLE} AS role, doc_id, text, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical FROM c WHERE text IS NOT NULL)
SELECT lane, role, count(*) AS docs, sum(octet_length(encode(text)))::BIGINT AS bytes, count(*) FILTER (WHERE doc_id <> canonical) AS exact_dups FROM l GROUP BY ALL"""
)
def lane_role_matrix(spark, d):
    known = dedup.exact(docs(spark, d))
    return known.groupBy(roles.lane().alias("lane"), roles.role().alias("role")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), F.count_if(F.col("doc_id") != F.col("canonical_doc_id")).alias("exact_dups"))


@query(f"WITH {CORPUS} SELECT doc_id, sha256(text) AS content_hash FROM c WHERE text IS NOT NULL")
def content_hash(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.sha2("text", 256).alias("content_hash"))


@query(f"WITH {CORPUS}, k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS canonical_doc_id FROM c WHERE text IS NOT NULL) SELECT * FROM k WHERE doc_id <> canonical_doc_id")
def content_hash_exact_dedup(spark, d):
    return dedup.exact(docs(spark, d)).where("doc_id <> canonical_doc_id").select("doc_id", "canonical_doc_id")


#: The greedy choice by a recursive query over lists of ids: kept are those whose smaller neighbours are all set aside, set aside those with a kept smaller one.
_GREEDY = f"""WITH RECURSIVE all_docs AS (SELECT doc_id, any_value(text) AS text FROM corpus WHERE text IS NOT NULL GROUP BY doc_id),
docs AS (SELECT min(doc_id) AS doc_id, text FROM all_docs GROUP BY text), {SHINGLED}, {PAIRS}, near AS (SELECT * FROM alike), nodes AS (SELECT a AS n FROM near UNION SELECT b FROM near),
g AS (SELECT []::VARCHAR[] AS kept, []::VARCHAR[] AS aside UNION ALL
SELECT kept2, list_concat(aside, coalesce((SELECT list(DISTINCT b) FROM near WHERE list_contains(kept2, a) AND NOT list_contains(aside, b)), [])) FROM (
  SELECT aside, list_concat(kept, coalesce((SELECT list(n) FROM nodes WHERE NOT list_contains(kept, n) AND NOT list_contains(aside, n) AND NOT EXISTS (SELECT 1 FROM near WHERE b = n AND NOT list_contains(aside, a))), [])) AS kept2
  FROM g WHERE len(kept) + len(aside) < (SELECT count(*) FROM nodes))),
ended AS (SELECT kept, aside FROM g WHERE len(kept) + len(aside) = (SELECT count(*) FROM nodes)),
empty AS (SELECT doc_id, min(doc_id) OVER () AS first FROM shingled WHERE len(sh) = 0),
quarantined AS (SELECT b AS doc_id, min(a) AS matched, arg_min(jaccard, a) AS jaccard FROM near, ended WHERE list_contains(aside, b) AND list_contains(kept, a) GROUP BY b UNION ALL SELECT doc_id, first, 1.0::DOUBLE FROM empty WHERE doc_id <> first)"""


@query(f"""{_GREEDY} SELECT * FROM (SELECT 'survivor' AS status, (SELECT count(*) FROM docs) - (SELECT count(*) FROM quarantined) AS docs UNION ALL SELECT 'quarantined', (SELECT count(*) FROM quarantined)
UNION ALL SELECT 'exact_duplicate', (SELECT count(*) FROM all_docs) - (SELECT count(*) FROM docs)) WHERE docs > 0""")
def dedup_report(spark, d):
    return dedup.run(docs(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("docs"))


@query(f"{_GREEDY} SELECT doc_id, matched, round(jaccard, 9) AS jaccard FROM quarantined")
def near_dup_quarantine(spark, d):
    return dedup.run(docs(spark, d)).where("status = 'quarantined'").select("doc_id", "matched", F.round("jaccard", 9).alias("jaccard"))


@query(f"WITH {DOCS}, {SHINGLED}, {PAIRS} SELECT a, b, round(jaccard, 9) AS jaccard FROM alike")
def near_dup_pairs(spark, d):
    sets = written(dedup.shingled(docs(spark, d).where("text is not null")), "sets")
    return dedup.near_pairs(sets).select("a", "b", F.round("jaccard", 9).alias("jaccard"))


@query(f"WITH {CORPUS} SELECT doc_id, {ROLE} AS role FROM c")
def role_table(spark, d):
    return docs(spark, d).select("doc_id", roles.role().alias("role"))


@query(f"WITH {CORPUS} SELECT {ROLE} AS role, count(*) AS docs FROM c GROUP BY ALL")
def role_split_counts(spark, d):
    return docs(spark, d).groupBy(roles.role().alias("role")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH {CORPUS} SELECT {BUCKET} AS bucket, count(*) AS docs FROM c GROUP BY ALL")
def role_buckets(spark, d):
    return docs(spark, d).groupBy(roles.bucket().alias("bucket")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH {CORPUS} SELECT {LANE} AS lane, count(*) AS docs FROM c WHERE {ROLE} = 'TRAIN' GROUP BY ALL")
def train_docs_per_lane(spark, d):
    return roles.assign(docs(spark, d)).where("role = 'TRAIN'").groupBy(roles.lane().alias("lane")).agg(F.count(F.lit(1)).alias("docs"))


@query("""WITH a AS (SELECT DISTINCT doc_id FROM corpus), r AS (SELECT DISTINCT doc_id, role FROM role_assignment)
SELECT doc_id, 'missing' AS fault FROM a WHERE doc_id NOT IN (SELECT doc_id FROM r WHERE doc_id IS NOT NULL)
UNION ALL SELECT doc_id, 'unknown role' FROM r WHERE role IS NULL OR role NOT IN ('TRAIN', 'VALIDATION', 'EVAL', 'PROXY', 'QUARANTINE')""")
def partition_check(spark, d):
    return roles.partition_faults(table(spark, d, "corpus", "doc_id"), table(spark, d, "role_assignment", "doc_id", "role").distinct())


@query("""SELECT doc_id, role, CASE WHEN role IN ('TRAIN', 'VALIDATION', 'EVAL', 'PROXY', 'QUARANTINE') THEN 'role ' || role ELSE 'unknown role' END AS reason
FROM (SELECT DISTINCT doc_id, role FROM role_assignment) WHERE role IS NULL OR role <> 'TRAIN'""")
def training_gate_rejects(spark, d):
    return roles.rejected(table(spark, d, "role_assignment", "doc_id", "role").distinct(), "training")


@query("SELECT DISTINCT doc_id, role FROM role_assignment WHERE role = 'TRAIN'")
def training_gate_admitted(spark, d):
    return roles.admitted(table(spark, d, "role_assignment", "doc_id", "role").where("role = 'TRAIN'").distinct(), "training")


@query(f"WITH {DOCS} SELECT doc_id, len({WORDS})::INTEGER AS words FROM docs")
def word_tokenize_counts(spark, d):
    text = nfc(F.col("text"))
    words = F.regexp_extract_all(text, F.lit(r"(?U)([^\s\x1c-\x1f.,!?;:\"'()\[\]{}।॥]+)"), 1)
    return docs(spark, d).where("text is not null").select("doc_id", F.size(words).alias("words"))


@query(f"WITH {DOCS}, {SHINGLED} SELECT doc_id, len(sh)::INTEGER AS n FROM shingled")
def shingle_counts(spark, d):
    return dedup.shingled(docs(spark, d).where("text is not null")).select("doc_id", "n")


@query("""WITH m AS (SELECT DISTINCT * FROM (SELECT shard_id, unnest(map_entries(offsets)) AS e FROM manifest))
SELECT shard_id, e.key AS doc_id, e.value[1] AS start_token, e.value[2] AS end_token FROM m""")
def manifest_offsets(spark, d):
    m = table(spark, d, "manifest", "shard_id", "offsets").dropDuplicates(["shard_id"])
    return m.select("shard_id", F.explode("offsets").alias("doc_id", "span")).select("shard_id", "doc_id", F.col("span")[0].alias("start_token"), F.col("span")[1].alias("end_token"))


@query("""WITH t AS (SELECT doc_id, any_value(lane) AS lane, any_value(len(tokens)) AS n FROM doc_tokens GROUP BY doc_id)
SELECT lane, doc_id, (sum(n) OVER w - n)::BIGINT AS start_token, (sum(n) OVER w)::BIGINT AS end_token FROM t WINDOW w AS (PARTITION BY lane ORDER BY doc_id ROWS UNBOUNDED PRECEDING)""")
def shard_offsets(spark, d):
    t = table(spark, d, "doc_tokens", "doc_id", "lane", F.size("tokens").alias("n")).groupBy("doc_id").agg(F.max("lane").alias("lane"), F.max("n").alias("n"))
    return shards.offsets(t)


_MANIFESTS = """m AS (SELECT DISTINCT ON (shard_id) * FROM manifest),
spans AS (SELECT shard_id, string_agg('"' || e.key || '":[' || e.value[1] || ',' || e.value[2] || ']', ',' ORDER BY e.key) AS offsets FROM (SELECT shard_id, unnest(map_entries(offsets)) AS e FROM m) GROUP BY shard_id),
hashed AS (SELECT m.*, sha256('{"content_hash":"' || content_hash || '","created_at":"' || created_at || '","doc_count":' || doc_count || ',"lane":"' || lane || '","offsets":{' || coalesce(s.offsets, '') || '},"parent_manifest_hash":"' || parent_manifest_hash || '","role":"' || role || '","shard_id":"' || shard_id || '","token_count":' || token_count || ',"tokenizer_hash":"' || tokenizer_hash || '"}') AS own FROM m LEFT JOIN spans s USING (shard_id))"""


@query(f"WITH {_MANIFESTS} SELECT shard_id, own = manifest_hash AS self_ok, parent_manifest_hash = 'GENESIS' OR parent_manifest_hash IN (SELECT manifest_hash FROM m) AS parent_known FROM hashed")
def manifest_self_hash(spark, d):
    return shards.manifest_checks(table(spark, d, "manifest"))


@query("""WITH RECURSIVE o AS (SELECT shard_id, any_value(manifest_hash) AS h, row_number() OVER (ORDER BY shard_id) AS i FROM manifest GROUP BY shard_id),
r AS (SELECT 0::BIGINT AS i, 'GENESIS' AS prev UNION ALL SELECT o.i, sha256(prev || '|{"manifest_hash":"' || h || '","shard_id":"' || shard_id || '"}') FROM r JOIN o ON o.i = r.i + 1) SELECT arg_max(prev, i) AS root_hash FROM r""")
def manifest_chain_root(spark, d):
    return shards.chain_root(table(spark, d, "manifest"))


@query("""WITH m AS (SELECT DISTINCT shard_id, doc_count, token_count, offsets FROM manifest),
x AS (SELECT shard_id, unnest(map_entries(offsets)) AS e, doc_count, token_count FROM m),
o AS (SELECT shard_id, doc_count, token_count, e.value[1] AS s, e.value[2] AS t FROM x),
g AS (SELECT *, lag(t, 1, 0) OVER (PARTITION BY shard_id ORDER BY s) AS p FROM o)
SELECT shard_id, count(*) = any_value(doc_count) AS docs_ok, max(t) = any_value(token_count) AS tokens_ok, bool_and(s = p) AS contiguous FROM g GROUP BY shard_id""")
def manifest_audit(spark, d):
    return shards.contiguous(table(spark, d, "manifest"))


@query(r"""WITH last AS (SELECT doc_id, arg_max(upper(trim(role)), assigned_at) AS role FROM role_assignment WHERE role IS NOT NULL GROUP BY doc_id),
p AS (SELECT DISTINCT seq_id, split_part(x, '::frag', 1) AS doc_id FROM (SELECT seq_id, unnest(doc_ids_present) AS x FROM packed))
SELECT seq_id, doc_id, role FROM p LEFT JOIN last USING (doc_id) WHERE role IS DISTINCT FROM 'TRAIN'""")
def leakage_audit(spark, d):
    """Packed documents whose role is not TRAIN, or that have none."""
    own = table(spark, d, "role_assignment").where("role is not null").groupBy("doc_id").agg(F.max_by(F.upper(F.trim("role")), "assigned_at").alias("role"))
    used = table(spark, d, "packed", "seq_id", "doc_ids_present").select("seq_id", F.explode("doc_ids_present").alias("x")).select("seq_id", F.substring_index("x", "::frag", 1).alias("doc_id")).distinct()
    return used.join(own, "doc_id", "left").where(~F.col("role").eqNullSafe("TRAIN")).select("seq_id", "doc_id", "role")


@query(f"""WITH {CORPUS}, k AS (SELECT tier, coalesce(type, '') AS type, doc_id, trim(text) AS text, row_number() OVER (PARTITION BY tier, coalesce(type, '') ORDER BY doc_id) AS r FROM c WHERE trim(text) <> '')
SELECT 'ingested:' || tier || ':' || CASE WHEN type = '' THEN 'x' ELSE type END || '-' || doc_id AS doc_id, length(text)::INTEGER AS chars FROM k WHERE r <= CASE tier WHEN 'verified' THEN 200 ELSE 150 END AND (tier <> 'verified') = (type = '') AND tier IN ('verified', 'unverified', 'synthetic')""")
def per_group_budget_limit(spark, d):
    """The corpus ingested with budgets: the first so many documents of each (tier, type) that have text, under new ids."""
    budgets = {("verified", k): 200 for k in ("web", "speech", "pdf")} | {("unverified", None): 150, ("synthetic", None): 150}
    return ingest(docs(spark, d), budgets, "ingested:").select("doc_id", F.length("text").alias("chars"))


@query("""SELECT e.item_id, count(*) AS other_items FROM eval_items e JOIN eval_items f ON e.task = f.task AND e.item_id <> f.item_id GROUP BY ALL""")
def eval_items_by_task(spark, d):
    own = table(spark, d, "eval_items", "item_id", "task")
    size = own.groupBy("task").agg((F.count(F.lit(1)) - 1).alias("other_items"))
    return own.join(size, "task").where("other_items > 0").select("item_id", "other_items")


@query(f"WITH {CORPUS}, b AS (SELECT substr(sha256(doc_id), 1, 4) AS k, sha256(string_agg(doc_id || ':' || sha256(text), ',' ORDER BY doc_id)) AS h FROM c WHERE text IS NOT NULL AND {ROLE} = 'TRAIN' GROUP BY k) SELECT sha256(string_agg(h, ',' ORDER BY k)) AS train_manifest FROM b")
def train_manifest_hash(spark, d):
    """One hash over the ids and content hashes of the TRAIN documents, in order of the ids."""
    return shards.ordered_digest(roles.assign(docs(spark, d).where("text is not null")).where("role = 'TRAIN'").select("doc_id", F.sha2("text", 256).alias("content_hash")))

