"""Queries over records, catalogues and small sources: comments, lookups, state, blocks, sorted and labelled rows."""

from __future__ import annotations

import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import annotations as N
from ..session import scratch_path, table
from ..sources import formats as S
from ..sources import synthetic
from .arrays import tokens
from .corpus import docs
from .registry import query
from .text_sql import CORPUS


def _comments(spark, d):
    path = F.concat(F.lit("notes/"), "event_type", F.lit(".md"))
    own = table(spark, d, "events", "event_id", "user_id", "event_type")
    return own.select(F.col("event_id").cast("string").alias("id"), path.alias("path"), F.col("user_id").alias("from"), (F.col("user_id") + 5).alias("to"), F.lit("q").alias("quote"), F.lit("").alias("prefix"), F.lit("").alias("suffix"), (F.col("event_id") % 3 == 0).alias("resolved"), (F.col("event_id") % 5 == 0).alias("orphaned"))


@query("""SELECT event_id::VARCHAR AS id, 'notes/' || event_type || '.md' AS path, row_number() OVER (PARTITION BY event_type ORDER BY event_id % 5 = 0, user_id, event_id::VARCHAR)::INTEGER AS rank FROM events WHERE event_id % 3 <> 0""")
def comment_order(spark, d):
    """The unresolved comments of each path in the order they are listed: lost ones last, then by place."""
    return N.listed(_comments(spark, d)).select("id", "path", "rank")


@query("""SELECT event_id::VARCHAR AS id, 'notes/' || event_type || '.md' AS path, user_id AS "from" FROM events WHERE event_id % 100 = 0""")
def comments_found(spark, d):
    """Comments looked up by their ids in the store of arrays by path."""
    ids = table(spark, d, "events", F.col("event_id").cast("string").alias("id"), "event_id").where("event_id % 100 = 0")
    return N.found(N.by_path(_comments(spark, d)), ids).select("id", "path", "from")


@query("""WITH t AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) > 0)
SELECT doc_id::VARCHAR AS id, substr(text, length(text) // 2 + 1, least(20, length(text) - length(text) // 2)) AS quote, substr(text, greatest(length(text) // 2 - 40, 0) + 1, length(text) // 2 - greatest(length(text) // 2 - 40, 0)) AS prefix, substr(text, length(text) // 2 + 21, 40) AS suffix, 1 AS messages FROM t""")
def comments_added(spark, d):
    """A comment added in the middle of each document's text, with what stands around it."""
    t = table(spark, d, "documents", F.col("doc_id").cast("string").alias("path"), "text").where("length(text) > 0").dropDuplicates(["path"])
    half = F.floor(F.length("text") / 2).cast("int")
    new = t.select(F.col("path").alias("id"), "path", half.alias("from"), F.least(half + 20, F.length("text")).alias("to"), F.lit("a").alias("author"), F.lit("see here").alias("message"))
    none = spark.createDataFrame([], "id string, path string, from int, to int, quote string, prefix string, suffix string, resolved boolean, orphaned boolean, thread array<struct<id:string,author:string,text:string,edited:boolean>>")
    return N.added(none, new, t).select("id", "quote", "prefix", "suffix", F.size("thread").alias("messages"))


@query("""SELECT event_id AS id, CASE WHEN p < 40 THEN p WHEN p <= 60 THEN CASE WHEN p = 60 OR p < 60 THEN 45 END ELSE p - 15 END AS "from" FROM (SELECT event_id, user_id AS p FROM events)""")
def positions_mapped(spark, d):
    """Positions through an edit that puts five characters in place of [40, 60): those inside go to the end of what came in."""
    p = F.col("user_id")
    return table(spark, d, "events", "event_id", "user_id").select(F.col("event_id").alias("id"), N.mapped(p, F.lit(40), F.lit(60), F.lit(5), True).alias("from"))


@query("""WITH u AS (SELECT event_id, 'https://www.example.org/' || event_type || '/' || repeat('p', (event_id % 50)::INTEGER) AS u FROM events), p AS (SELECT event_id, substr(u, 24) AS p FROM u)
SELECT event_id, 'example.org' || CASE WHEN length(p) > 34 THEN left(p, 33) || '…' ELSE p END AS shown FROM p""")
def short_urls(spark, d):
    u = F.concat(F.lit("https://www.example.org/"), "event_type", F.lit("/"), F.repeat(F.lit("p"), (F.col("event_id") % 50).cast("int")))
    return table(spark, d, "events", "event_id", "event_type").select("event_id", N.short_url(u).alias("shown"))


@query("""WITH n AS (SELECT p_partkey, p_name || '.' || lower(p_type) AS name FROM part)
SELECT p_partkey, CASE WHEN contains(name, 'red') OR contains(name, 'blue') THEN 'embeddings' WHEN contains(name, 'ring') OR (contains(name, 'bolt') AND contains(name, 'small')) THEN 'attn.weight' WHEN contains(name, 'widget') THEN 'mlp.weight' WHEN contains(name, 'ln') OR contains(name, 'norm') OR contains(name, 'eco') THEN 'layernorm' ELSE 'other' END AS grp FROM n""")
def substring_labels(spark, d):
    """Groups by what names contain, the first rule that fits; within a rule, and binds before or."""
    name = F.concat("p_name", F.lit("."), F.lower("p_type"))
    rules = (("embeddings", (("red",), ("blue",))), ("attn.weight", (("ring",), ("bolt", "small"))), ("mlp.weight", (("widget",),)), ("layernorm", (("ln",), ("norm",), ("eco",))))
    return table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", N.labelled(name, rules, "other").alias("grp"))


@query(f"WITH {CORPUS} SELECT 'typed' AS part, doc_id FROM c WHERE type IS NOT NULL UNION ALL SELECT 'untyped', doc_id FROM c WHERE type IS NULL")
def null_split(spark, d):
    """The documents with a type, and those without."""
    return docs(spark, d).select(F.when(F.col("type").isNotNull(), "typed").otherwise("untyped").alias("part"), "doc_id")


@query("""SELECT doc_id, row_number() OVER (ORDER BY collected_at::DATE, source, doc_id) AS place FROM (SELECT DISTINCT doc_id, min(collected_at) OVER (PARTITION BY doc_id) AS collected_at, coalesce(min(source) OVER (PARTITION BY doc_id), '') AS source FROM documents)""")
def sorted_by_date_and_name(spark, d):
    """The place of each document by date, then source, then id: a total order numbered over ranges."""
    from ..operators.shards import offsets

    t = table(spark, d, "documents", "doc_id", "collected_at", "source").groupBy("doc_id").agg(F.to_date(F.min("collected_at")).alias("day"), F.coalesce(F.min("source"), F.lit("")).alias("source"))
    at = offsets(t.select(F.lit("").alias("lane"), F.struct("day", "source", "doc_id").alias("doc_id"), F.lit(1).alias("n")))
    return at.select("doc_id.doc_id", F.col("end_token").alias("place"))


@query("""WITH r AS (SELECT user_id AS doc, event_id AS block, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) SELECT doc, block, k::INTEGER AS k FROM r WHERE k <= 4""")
def top_blocks(spark, d):
    """The four blocks of each sequence that matter most."""
    e = table(spark, d, "events", "user_id", "event_id", "value")
    return e.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))).where("k <= 4").select(F.col("user_id").alias("doc"), F.col("event_id").alias("block"), "k")


@query("""WITH a AS (SELECT event_id, user_id || 'v' || (event_id % 3 + 1) AS raw, dense_rank() OVER (ORDER BY user_id) - 1 AS i FROM events) SELECT event_id, i // 25 AS request, c_name AS name FROM a LEFT JOIN customer ON c_custkey = regexp_replace(raw, 'v\\d+$', '')::BIGINT""".replace("\\\\", "\\"))
def reference_lookup(spark, d):
    """Ids with a version looked up in a reference table without it, in requests of 25: what a lookup service would answer."""
    ids = table(spark, d, "events", "event_id", "user_id")
    known = table(spark, d, "customer", F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    return S.looked_up(ids.select("event_id", F.concat("user_id", F.lit("v"), (F.col("event_id") % 3 + 1)).alias("raw"), "user_id"), "raw", known, order="user_id").select("event_id", "request", "name")


@query("SELECT source AS key, max_repeats AS given, max_repeats * 2 AS doubled, true AS verified FROM mix_targets")
def state_file(spark, d):
    """A state written with its hash and read again, with defaults for what it lacks."""
    rows = table(spark, d, "mix_targets").limit(1000).collect()  # a state is small
    path = os.path.join(scratch_path(spark, "state").removeprefix("file://"))
    os.makedirs(path, exist_ok=True)
    S.save_state(f"{path}/state.json", {"given": {r.source: r.max_repeats for r in rows}})
    s = S.load_state(f"{path}/state.json", {"verified": True, "given": {}})
    return spark.createDataFrame([(k, v, 2 * v, s["verified"]) for k, v in s["given"].items()], "key string, given int, doubled int, verified boolean")


@query("SELECT '<!-- t:start -->' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) || chr(10) || '<!-- t:end -->' AS block FROM nation")
def marked_block(spark, d):
    """A table of rows put between the markers of a text."""
    rows = table(spark, d, "nation", "n_nationkey", "n_name").orderBy("n_nationkey").limit(1000).collect()  # a page's table
    text = S.replace_block("<!-- t:start -->old<!-- t:end -->", "t", [f"| {r.n_nationkey} | {r.n_name} |" for r in rows])
    return spark.createDataFrame([(text,)], "block string")


@query("WITH o AS (SELECT token_id, row_number() OVER (ORDER BY token_id) - 1 AS i FROM vocab) SELECT i // 1024 AS block, count(*) AS n, sum(token_id)::BIGINT AS total FROM o GROUP BY 1")
def token_file(spark, d):
    """The vocabulary's ids as a headered token file, read back in blocks in parallel."""
    spark.dataSource.register(S.TokenFiles)
    ids = [r.token_id for r in table(spark, d, "vocab", "token_id").orderBy("token_id").collect()]  # a fixed vocabulary
    path = scratch_path(spark, "tokens").removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    S.write_token_file(f"{path}/vocab.bin", ids)
    back = spark.read.format("tokens").option("path", path).load()
    return back.select("block", F.size("tokens").cast("bigint").alias("n"), F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query(f"WITH {CORPUS} SELECT doc_id, tier, type, sha256(text) AS h FROM c WHERE text IS NOT NULL")
def jsonl_corpus(spark, d):
    """The corpus written as JSON lines and read with its fixed four fields."""
    path = scratch_path(spark, "jsonl")
    docs(spark, d).where("text is not null").select("doc_id", "tier", "type", "text").write.json(path)
    return S.read_corpus(spark, path).select("doc_id", "tier", "type", F.sha2("text", 256).alias("h"))


@query("SELECT tier, coalesce(type, '') AS type, n AS docs, x AS exact, y AS near FROM (VALUES ('verified', 'web', 220, 0, 0), ('verified', 'speech', 180, 0, 0), ('verified', 'pdf', 120, 0, 0), ('unverified', NULL, 221, 1, 0), ('synthetic', NULL, 161, 0, 1)) t(tier, type, n, x, y)")
def synthetic_corpus(spark, d):
    """A corpus made from keyed draws, with an exact and a near duplicate planted: as deduplication counts it."""
    from ..operators import dedup

    got = dedup.run(synthetic.corpus(spark))
    count = lambda s: F.count_if(F.col("status") == s)
    return got.groupBy("tier", F.coalesce("type", F.lit("")).alias("type")).agg(F.count(F.lit(1)).alias("docs"), count("exact_duplicate").alias("exact"), count("quarantined").alias("near"))


@query("WITH t AS (SELECT doc_id, any_value(tokens) AS t FROM doc_tokens GROUP BY doc_id), k AS (SELECT doc_id, t, unnest([0, 1, 2]) AS i, substr(sha256('1337|root|0|demo|' || doc_id), 1, 16) AS k, len(t) AS n FROM t WHERE len(t) > 17),\ns AS (SELECT doc_id, t, i, floor(('0x' || substr(sha256(unhex(k || lpad(printf('%x', i), 16, '0'))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE * (n - 16))::BIGINT AS start_at FROM k) SELECT doc_id, i::INTEGER AS crop, list_sum(t[start_at + 1:start_at + 16])::BIGINT AS x_sum FROM s")
def in_memory_crops(spark, d):
    """Three crops of 16 tokens of each document, at keyed places."""
    from .. import config
    from ..functions import hashing as H

    t = tokens(spark, d).where(F.size("tokens") > 17).withColumn("k", H.key_hex(config.SEED, "root", 0, "demo", F.col("doc_id"))).withColumn("crop", F.explode(F.sequence(F.lit(0), F.lit(2))))
    at = F.floor(H.uniform_column(F.col("k"), F.col("crop")) * (F.size("tokens") - 16)).cast("int")
    return t.select("doc_id", "crop", F.aggregate(F.slice("tokens", at + 1, F.lit(16)), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("x_sum"))
