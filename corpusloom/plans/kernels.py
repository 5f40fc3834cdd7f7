"""Numeric kernels and record lookups as relational queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import config
from ..functions import annotations as N
from ..functions import arrays as A
from ..functions import hashing as H
from ..functions import numbers as B
from ..session import table
from .arrays import _T, tokens
from .registry import query


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, vec_id % 64 AS y FROM embeddings), m AS (SELECT *, list_max(v) AS m FROM e)
SELECT vec_id, round(ln(list_sum(list_transform(v, lambda a: exp(a - m)))) + m - v[y + 1], 6) AS loss FROM m""")
def chunked_cross_entropy(spark, d):
    """Cross-entropy from chunks of 8 scores each, combined by their maxima and sums: as from all at once."""
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 64).cast("int").alias("y"))
    chunk = v.select("vec_id", "v", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).withColumn("c", F.slice("v", F.col("k") * 8 + 1, F.lit(8)))
    part = chunk.select("vec_id", F.get("v", F.col("y")).alias("s"), F.array_max("c").alias("m"), F.aggregate(F.transform("c", lambda x: F.exp(x - F.array_max("c"))), F.lit(0.0), lambda a, x: a + x).alias("z"))
    top = part.withColumn("top", F.max("m").over(Window.partitionBy("vec_id")))
    return top.groupBy("vec_id").agg((F.ln(F.sum(F.col("z") * F.exp(F.col("m") - F.col("top")))) + F.max("top") - F.max("s")).alias("l")).select("vec_id", F.round("l", 6).alias("loss"))


@query("""WITH e AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings), p AS (SELECT *, list_transform(list_zip(a, b), lambda z: z[1] + tanh(z[2]) * 0.5) AS p FROM e),
q AS (SELECT *, list_transform(list_zip(b, p), lambda z: z[1] + tanh(z[2]) * 0.5) AS q FROM p)
SELECT vec_id, round(list_sum(p), 6) AS p, round(list_sum(q), 6) AS q, list_transform(list_concat(a, b), lambda x: round(x, 9)) AS restored FROM q""")
def reversible_step(spark, d):
    """A coupling step over the halves of each vector, and the vector that its inverse brings back."""
    f = lambda a: F.transform(a, lambda x: F.tanh(x) * 0.5)
    add, sub = (lambda a, b: F.zip_with(a, b, lambda x, y: x + y)), (lambda a, b: F.zip_with(a, b, lambda x, y: x - y))
    v = table(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 32).cast("array<double>").alias("a"), F.slice("embedding", 33, 32).cast("array<double>").alias("b"))
    y = v.withColumn("p", add("a", f("b"))).withColumn("q", add("b", f("p"))).select("vec_id", "p", "q")
    back = y.withColumn("b", sub("q", f("p"))).withColumn("a", sub("p", f("b")))
    return back.select("vec_id", F.round(A.total("p"), 6).alias("p"), F.round(A.total("q"), 6).alias("q"), F.transform(F.concat("a", "b"), lambda x: F.round(x, 9)).alias("restored"))


@query("""WITH k AS (SELECT vec_id, substr(sha256('1337|root|0|dropout|' || vec_id), 1, 16) AS k FROM embeddings), e AS (SELECT vec_id, k, i FROM k, range(64) t(i))
SELECT vec_id, count(*) FILTER (WHERE ('0x' || substr(sha256(unhex(k || lpad(printf('%x', i), 16, '0'))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE < 0.1::DOUBLE) AS dropped FROM e GROUP BY vec_id""")
def keyed_dropout(spark, d):
    """How many of the 64 units of each vector a keyed mask drops, the same on any partitioning."""
    k = H.key_hex(config.SEED, "root", 0, "dropout", F.col("vec_id"))
    e = table(spark, d, "embeddings", "vec_id").withColumn("k", k).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return e.groupBy("vec_id").agg(F.count_if(H.uniform_column(F.col("k"), F.col("i")) < 0.1).alias("dropped"))


@query(f"""WITH {_T}, n AS (SELECT doc_id, t, len(t) AS n, substr(sha256('1337|root|0|crop|' || doc_id), 1, 16) AS k FROM t WHERE len(t) > 33),
s AS (SELECT doc_id, t, floor(('0x' || substr(sha256(unhex(k || '0000000000000000')), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE * (n - 32))::BIGINT AS start_at FROM n)
SELECT doc_id, start_at, list_sum(t[start_at + 1:start_at + 32])::BIGINT AS x_sum, list_sum(t[start_at + 2:start_at + 33])::BIGINT AS y_sum FROM s""")
def random_crops(spark, d):
    """A crop of 32 tokens of each long document at a keyed place, and the same one token on."""
    k = H.key_hex(config.SEED, "root", 0, "crop", F.col("doc_id"))
    t = tokens(spark, d).where(F.size("tokens") > 33).withColumn("start_at", F.floor(H.uniform_column(k, F.lit(0)) * (F.size("tokens") - 32)))
    at = F.col("start_at").cast("int")
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.select("doc_id", "start_at", add(F.slice("tokens", at + 1, F.lit(32))).alias("x_sum"), add(F.slice("tokens", at + 2, F.lit(32))).alias("y_sum"))


@query()
def codeword_coherence(spark, d):
    """The greatest inner product of two different codewords of the byte embedding, against the bound that no codebook passes under."""
    e = B.byte_embedding()
    return spark.createDataFrame([(e.coherence, float(((256 - e.size) / (255 * e.size)) ** 0.5))], "coherence double, bound double")


@query("""WITH p AS (SELECT user_id AS run, CASE WHEN event_type IN ('click', 'view') THEN 'forward' WHEN event_type = 'purchase' THEN 'backward' WHEN event_type = 'signup' THEN 'comm' ELSE 'optimizer' END AS phase, value::DECIMAL(18, 4) AS v FROM events)
SELECT run, coalesce(sum(v) FILTER (WHERE phase = 'forward'), 0)::DOUBLE AS forward, coalesce(sum(v) FILTER (WHERE phase = 'backward'), 0)::DOUBLE AS backward, coalesce(sum(v) FILTER (WHERE phase = 'comm'), 0)::DOUBLE AS comm, coalesce(sum(v) FILTER (WHERE phase = 'optimizer'), 0)::DOUBLE AS optimizer FROM p GROUP BY run""")
def phase_slots(spark, d):
    """Phase names, with their synonyms, into four slots a run."""
    names = {"click": "forward", "view": "forward", "purchase": "backward", "signup": "comm"}
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    p = table(spark, d, "events", "user_id", "event_type", "value").select(F.col("user_id").alias("run"), F.coalesce(known[F.col("event_type")], F.lit("optimizer")).alias("phase"), F.col("value").cast("decimal(18,4)").alias("v"))
    slots = ["forward", "backward", "comm", "optimizer"]
    return p.groupBy("run").pivot("phase", slots).sum("v").select("run", *[F.coalesce(F.col(s).cast("double"), F.lit(0.0)).alias(s) for s in slots])


@query("SELECT user_id AS candidate, arg_max(value, event_id) AS score FROM events WHERE event_type = 'view' GROUP BY 1")
def latest_score(spark, d):
    """The last score recorded for each candidate."""
    return table(spark, d, "events", "event_id", "user_id", "event_type", "value").where("event_type = 'view'").groupBy(F.col("user_id").alias("candidate")).agg(F.max_by("value", "event_id").alias("score"))


@query("""SELECT l_suppkey AS rank, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity::BIGINT * 2 ELSE 0 END)::BIGINT AS fp16, sum(CASE WHEN l_returnflag <> 'A' THEN l_quantity::BIGINT * 4 ELSE 0 END)::BIGINT AS fp32 FROM lineitem GROUP BY 1""")
def device_bytes(spark, d):
    """Bytes a device and component: entries times width."""
    n = F.col("l_quantity").cast("bigint")
    return table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_quantity").groupBy(F.col("l_suppkey").alias("rank")).agg(F.sum(F.when(F.col("l_returnflag") == "A", n * 2).otherwise(0)).alias("fp16"), F.sum(F.when(F.col("l_returnflag") != "A", n * 4).otherwise(0)).alias("fp32"))


@query("SELECT sum(n)::BIGINT AS untied, sum(CASE WHEN kind <> 'head' THEN n ELSE 0 END)::BIGINT AS tied, sum(CASE WHEN kind = 'head' THEN n ELSE 0 END)::BIGINT AS saved FROM (VALUES ('embed', 50259 * 64), ('head', 50259 * 64), ('body', 831000)) t(kind, n)")
def tied_parameters(spark, d):
    p = spark.createDataFrame([("embed", 50259 * 64), ("head", 50259 * 64), ("body", 831000)], "kind string, n bigint")
    head = F.sum(F.when(F.col("kind") == "head", F.col("n")).otherwise(0))
    return p.agg(F.sum("n").alias("untied"), (F.sum("n") - head).alias("tied"), head.alias("saved"))


@query("""WITH c AS (SELECT event_id AS id, 'notes/' || event_type || CASE WHEN event_id % 2 = 0 THEN '/a.md' ELSE '.md' END AS path, event_id % 3 = 0 AS resolved FROM events)
SELECT id, CASE WHEN path LIKE 'notes/view/%' THEN 'old/seen' || substr(path, 11) ELSE path END AS path FROM c WHERE NOT resolved AND path NOT LIKE 'notes/error/%'""")
def comment_paths(spark, d):
    """Comments after a folder was renamed and another deleted, resolved ones hidden."""
    path = F.concat(F.lit("notes/"), "event_type", F.when(F.col("event_id") % 2 == 0, "/a.md").otherwise(".md"))
    c = table(spark, d, "events", "event_id", "event_type").select(F.col("event_id").alias("id"), path.alias("path"), (F.col("event_id") % 3 == 0).alias("resolved"))
    return N.without_path(N.renamed(N.visible(c), "notes/view", "old/seen"), "notes/error").select("id", "path")


@query("""WITH e AS (SELECT vec_id, vec_id // 64 AS win, embedding[1:8]::DOUBLE[] AS k, embedding[9:16]::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id, list_inner_product(q.k, e.k) AS s, e.v FROM e q JOIN e ON e.win = q.win AND e.vec_id <= q.vec_id), o AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS c, s * unnest(v) AS x FROM s)
SELECT vec_id, c::INTEGER AS c, round(sum(x), 5) AS value FROM o GROUP BY ALL""")
def regrouping_identity(spark, d):
    """Attention without softmax from the running state, Q (K' V) over the keys so far in windows of 64; the SQL takes every query to every key, (Q K') V."""
    e = table(spark, d, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 64).alias("win"), F.slice("embedding", 1, 8).cast("array<double>").alias("k"), F.slice("embedding", 9, 8).cast("array<double>").alias("v"))
    cells = e.select("vec_id", "win", F.col("k").alias("q"), F.posexplode("k").alias("i", "x"), "v").select("vec_id", "win", "q", "i", "x", F.posexplode("v").alias("c", "y"))
    w = Window.partitionBy("win", "i", "c").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, 0)
    state = cells.withColumn("s", F.sum(F.col("x") * F.col("y")).over(w))
    return state.groupBy("vec_id", "c").agg(F.round(F.sum(F.get("q", F.col("i")) * F.col("s")), 5).alias("value"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS run, event_id AS step, value, event_type AS key, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS i FROM events)
SELECT run, key, round(sum(value), 4) AS add_only, round(arg_max(value, step), 4) AS corrected FROM e GROUP BY ALL""")
def delta_rule(spark, d):
    """A state that only adds keeps every old answer of a key; one that adds the difference to what it holds ends with the last."""
    e = table(spark, d, "events", "user_id", "event_id", "event_type", "value").select(F.col("user_id").alias("run"), F.col("event_type").alias("key"), "event_id", "value")
    got = e.groupBy("run", "key").agg(F.sum("value").alias("add_only"), F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("v"))  # a run's answers to one key
    held = F.aggregate("v", F.lit(0.0), lambda s, x: s + (x["value"] - s))
    return got.select("run", "key", F.round("add_only", 4).alias("add_only"), F.round(held, 4).alias("corrected"))


@query("SELECT x::INTEGER AS factor, round(pow(x, ln(1.41::DOUBLE) / ln(8.0::DOUBLE)), 9) AS cost FROM range(1, 65) t(x)")
def depth_schedule(spark, d):
    """Cost against depth, where eight times the depth costs 1.41 times as much."""
    import math

    return spark.range(1, 65).select(F.col("id").cast("int").alias("factor"), F.round(F.pow("id", F.lit(math.log(1.41) / math.log(8))), 9).alias("cost"))
