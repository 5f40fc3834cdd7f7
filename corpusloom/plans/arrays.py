"""Queries over token arrays and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..session import table
from .packing import packed
from .registry import query


def tokens(spark, d):
    return table(spark, d, "doc_tokens", "doc_id", "tokens").dropDuplicates(["doc_id"])


_T = "t AS (SELECT doc_id, any_value(tokens) AS t FROM doc_tokens GROUP BY doc_id)"


@query(f"WITH {_T}, p AS (SELECT unnest(t[:-2]) AS x, unnest(t[2:]) AS y FROM t) SELECT x, y, count(*) AS n FROM p GROUP BY ALL")
def shift_pairs(spark, d):
    """Adjacent token pairs: the counts a byte-pair merge looks at."""
    p = tokens(spark, d).select(F.explode(A.shifted("tokens")).alias("p")).select("p.*").toDF("x", "y")
    return p.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_T}, p AS (SELECT unnest(t[:-3]) AS x, unnest(t[3:]) AS y FROM t) SELECT y, count(DISTINCT x) AS before, count(*) AS n FROM p GROUP BY ALL")
def t_plus_2_pairs(spark, d):
    p = tokens(spark, d).select(F.explode(A.shifted("tokens", 2)).alias("p")).select("p.*").toDF("x", "y")
    return p.groupBy("y").agg(F.count_distinct("x").alias("before"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_T} SELECT doc_id, least(len(t), 256)::BIGINT AS real, greatest(256 - len(t), 0)::BIGINT AS pad FROM t")
def pad_mask_counts(spark, d):
    m = tokens(spark, d).select("doc_id", A.padding_mask("tokens", 256).alias("m"), A.padded("tokens", 256).alias("p"))
    real = F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return m.select("doc_id", real.alias("real"), (F.size("p") - real).alias("pad"))


@query("""WITH p AS (SELECT seq_id, any_value(attention_block_ids) AS b FROM packed GROUP BY seq_id), e AS (SELECT seq_id, unnest(b[:-2]) AS x, unnest(b[2:]) AS y FROM p)
SELECT seq_id, count(*) FILTER (WHERE x = y AND x >= 0) AS kept, count(*) FILTER (WHERE NOT (x = y AND x >= 0)) AS masked FROM e GROUP BY seq_id""")
def boundary_mask_counts(spark, d):
    t = packed(spark, d, "input_ids", "attention_block_ids").select("seq_id", A.boundary_targets("input_ids", "attention_block_ids").alias("t"))
    kept = F.size(F.filter("t", lambda x: x != A.IGNORE)).cast("bigint")
    return t.select("seq_id", kept.alias("kept"), (F.size("t") - kept).alias("masked"))


@query(f"WITH {_T}, p AS (SELECT doc_id, unnest(t[:-2]) AS x, unnest(t[2:]) AS y FROM t) SELECT doc_id, count(*) AS same FROM p WHERE x = y GROUP BY doc_id")
def misshift_detector(spark, d):
    """How many targets equal their input: all of them would, were the shift forgotten."""
    p = tokens(spark, d).select("doc_id", F.size(F.filter(A.shifted("tokens"), lambda p: p["x"] == p["y"])).cast("bigint").alias("same"))
    return p.where("same > 0")


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, list_max(v) AS m FROM e), x AS (SELECT vec_id, list_transform(v, lambda a: exp(a - m)) AS w FROM m)
SELECT vec_id, list_transform(w, lambda a: round(a / list_sum(w), 6)) AS p FROM x""")
def softmax_rows(spark, d):
    v = table(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.transform(A.softmax("v"), lambda x: F.round(x, 6)).alias("p"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, i) AS k FROM e)
SELECT vec_id, i::INTEGER AS expert, k::INTEGER AS k FROM r WHERE k <= 2""")
def router_top_k(spark, d):
    """Each vector's entries as router scores: its two best experts."""
    v = table(spark, d, "embeddings", "vec_id", F.col("embedding").alias("v"))
    return v.select("vec_id", F.posexplode(A.top_k("v", 2)).alias("k", "t")).select("vec_id", F.col("t.index").alias("expert"), (F.col("k") + 1).alias("k"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, list_transform(v, lambda a: exp(a - list_max(v))) AS w FROM e),
p AS (SELECT vec_id, unnest(w) / list_sum(w) AS p, generate_subscripts(w, 1) - 1 AS expert FROM x), t AS (SELECT vec_id, arg_max(expert, (p, -expert)) AS expert FROM p GROUP BY vec_id),
f AS (SELECT expert, count(*)::DOUBLE / (SELECT count(*) FROM embeddings) AS f FROM t GROUP BY expert), m AS (SELECT expert, avg(p) AS m FROM p GROUP BY expert) SELECT round(64 * sum(coalesce(f, 0) * m), 6) AS loss FROM m LEFT JOIN f USING (expert)""")
def load_balance_loss(spark, d):
    """The number of experts times the sum over them of (share of first choices x mean probability)."""
    v = table(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("v")).select("vec_id", A.softmax("v").alias("p"))
    each = v.select("vec_id", F.posexplode("p").alias("expert", "p"), A.top_k("p", 1)[0]["index"].alias("first"))
    by = each.groupBy("expert").agg(F.avg("p").alias("m"), F.avg((F.col("first") == F.col("expert")).cast("double")).alias("f"))
    return by.agg(F.round(F.lit(64) * F.sum(F.col("m") * F.col("f")), 6).alias("loss"))


@query("""WITH RECURSIVE g AS (SELECT vec_id, embedding::DOUBLE[] AS g FROM embeddings),
s AS (SELECT vec_id, g, 0 AS t, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v, 0.5::DOUBLE AS p FROM g
UNION ALL SELECT vec_id, g, t + 1, m * 0.9::DOUBLE + g[t + 1] * (1 - 0.9::DOUBLE), v * 0.999::DOUBLE + g[t + 1] * g[t + 1] * (1 - 0.999::DOUBLE),
p - 0.001::DOUBLE * ((m * 0.9::DOUBLE + g[t + 1] * (1 - 0.9::DOUBLE)) / (1 - pow(0.9::DOUBLE, t + 1))) / (sqrt((v * 0.999::DOUBLE + g[t + 1] * g[t + 1] * (1 - 0.999::DOUBLE)) / (1 - pow(0.999::DOUBLE, t + 1))) + 1e-8::DOUBLE) FROM s WHERE t < 64)
SELECT vec_id, round(p, 9) AS p FROM s WHERE t = 64""")
def adam_fold(spark, d):
    g = table(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("g"))
    return g.select("vec_id", F.round(A.adam("g", 0.5, lr=0.001), 9).alias("p"))


@query("""SELECT vec_id, r::INTEGER AS rank, round(list_sum(embedding[r * 10 + 1:r * 10 + 10]::DOUBLE[]), 5) AS total FROM embeddings, range(7) t(r)""")
def shard_partition(spark, d):
    """Each vector cut into 7 shards of ceil(64 / 7) entries."""
    v = table(spark, d, "embeddings", "vec_id", "embedding")
    each = F.array(*[A.total(A.shard("embedding", r, 7)) for r in range(7)])
    return v.select("vec_id", F.posexplode(each).alias("rank", "total")).select("vec_id", "rank", F.round("total", 5).alias("total"))


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_reverse(embedding)::DOUBLE[] AS r FROM embeddings), n AS (SELECT vec_id, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n,
sqrt(list_sum(list_transform(list_zip(v, r), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS c FROM v) SELECT vec_id, round(CASE WHEN n > 1e-8::DOUBLE THEN c / n END, 6) AS ratio FROM n""")
def norm_ratio(spark, d):
    """The norm of a change against the norm of the weights: here, of a vector turned round."""
    v = table(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    sq = lambda a: F.sqrt(A.total(F.transform(a, lambda x: x * x)))
    c = F.zip_with("v", F.reverse("v"), lambda a, b: a - b)
    return v.select("vec_id", F.round(F.when(sq("v") > 1e-8, sq(c) / sq("v")), 6).alias("ratio"))


@query("""WITH e AS (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT pos::INTEGER AS pos, round(avg(x::DOUBLE), 6) AS mean, round(sum(x::DOUBLE), 4) AS total FROM e GROUP BY pos""")
def vector_mean(spark, d):
    """The mean vector, position by position: an all-reduce of gradients."""
    return table(spark, d, "embeddings", "embedding").select(F.posexplode("embedding").alias("pos", "x")).groupBy("pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"), F.round(F.sum(F.col("x").cast("double")), 4).alias("total"))


@query("""WITH b AS (SELECT vec_id // 64 AS win, vec_id % 64 AS pos, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.win, q.pos AS i, k.pos AS j, t.temperature, list_inner_product(q.e, k.e) / 8.0::DOUBLE / t.temperature AS s, k.e AS v FROM b q JOIN b k ON k.win = q.win AND k.pos <= q.pos, (VALUES (1.0::DOUBLE), (0.5::DOUBLE)) t(temperature)),
m AS (SELECT *, max(s) OVER (PARTITION BY win, i, temperature) AS m FROM s), w AS (SELECT win, i, j, temperature, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY win, i, temperature) AS p, v FROM m),
o AS (SELECT win, i, temperature, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS c, p FROM w) SELECT win * 64 + i AS vec_id, temperature, c::INTEGER AS c, round(sum(p * x), 5) AS value FROM o GROUP BY ALL""")
def attention_relational(spark, d):
    """Causal single-head attention over all vectors in windows of 64 positions, at two temperatures: scores, softmax and output as joins and sums."""
    from pyspark.sql import Window

    from ..operators.selection import dot

    b = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("win"), (F.col("vec_id") % 64).alias("pos"), F.col("embedding").cast("array<double>").alias("e"))
    q, k = b.select("win", F.col("pos").alias("i"), F.col("e").alias("q")), b.select("win", F.col("pos").alias("j"), F.col("e").alias("v"))
    s = q.join(k, (q.win == k.win) & (F.col("j") <= F.col("i"))).select(q.win, "i", "v", F.explode(F.array(F.lit(1.0), F.lit(0.5))).alias("temperature"), (dot(F.col("q"), F.col("v")) / 8.0).alias("s"))
    s = s.withColumn("s", F.col("s") / F.col("temperature"))
    w = Window.partitionBy("win", "i", "temperature")
    p = s.withColumn("w", F.exp(F.col("s") - F.max("s").over(w)))
    p = p.withColumn("p", F.col("w") / F.sum("w").over(w))
    out = p.select("win", "i", "temperature", "p", F.posexplode("v").alias("c", "x")).groupBy("win", "i", "temperature", "c").agg(F.round(F.sum(F.col("p") * F.col("x")), 5).alias("value"))
    return out.select((F.col("win") * 64 + F.col("i")).alias("vec_id"), "temperature", "c", "value")


@query("""WITH t AS (SELECT doc_id, any_value(tokens) AS t FROM doc_tokens GROUP BY doc_id), n AS (SELECT doc_id, t, len(t) AS n FROM t WHERE len(t) > 65), e AS (SELECT *, unnest(range(n // 64 + 2)) AS i FROM n), s AS (SELECT doc_id, t, i, ((i * 2 * 32) % (n - 64 - 1))::BIGINT AS start_at FROM e)
SELECT doc_id, i::INTEGER AS step, start_at, list_sum(t[start_at + 1:start_at + 64])::BIGINT AS x_sum, list_sum(t[start_at + 2:start_at + 65])::BIGINT AS y_sum FROM s""")
def sequential_batches(spark, d):
    """Wrap-round batching once through each long document and beyond its end: x, and y one token on."""
    t = tokens(spark, d).where(F.size("tokens") > 65).select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.floor(F.size("tokens") / 64).cast("int") + 1)).alias("step"))
    t = t.withColumn("start_at", F.pmod(F.col("step") * 64, F.size("tokens") - 65).cast("bigint"))
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    at = F.col("start_at").cast("int")
    return t.select("doc_id", "step", "start_at", add(F.slice("tokens", at + 1, F.lit(64))).alias("x_sum"), add(F.slice("tokens", at + 2, F.lit(64))).alias("y_sum"))


_SHARDS = "s AS (SELECT r AS rank, label, (r * 16 + i)::INTEGER AS pos, sum(embedding[r * 16 + i + 1]::DOUBLE) AS x FROM embeddings, range(4) a(r), range(16) b(i) GROUP BY ALL)"


@query(f"WITH {_SHARDS} SELECT rank::INTEGER AS rank, label, list_transform(list(x ORDER BY pos), lambda v: round(v, 4)) AS shard FROM s GROUP BY ALL")
def reduce_scatter(spark, d):
    """The vectors of each label summed over its members, each of four ranks keeping its quarter."""
    return _reduced(spark, d).select("rank", "label", F.transform("shard", lambda v: F.round(v, 4)).alias("shard"))


def _reduced(spark, d):
    e = table(spark, d, "embeddings", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).groupBy("label", "pos").agg(F.sum("x").alias("x"))
    own = e.groupBy(F.floor(F.col("pos") / 16).cast("int").alias("rank"), "label").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("p"))
    return own.select("rank", "label", F.transform("p", lambda p: p["x"]).alias("shard"))


@query(f"WITH {_SHARDS} SELECT label, list_transform(list(x ORDER BY pos), lambda v: round(v, 4)) AS whole FROM s GROUP BY label")
def all_gather(spark, d):
    """The ranks' shards laid end to end again: an all-reduce is a reduce-scatter and this."""
    own = _reduced(spark, d).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("rank", "shard"))).alias("s"))
    return own.select("label", F.transform(F.flatten(F.transform("s", lambda x: x["shard"])), lambda v: F.round(v, 4)).alias("whole"))


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, embedding[1:8]::DOUBLE[] AS r FROM embeddings), x AS (SELECT vec_id, v, list_transform(r, lambda a: exp(a - list_max(r))) AS w FROM e),
p AS (SELECT vec_id, v, unnest(w) / list_sum(w) AS p, generate_subscripts(w, 1) - 1 AS expert FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, expert) AS r FROM p),
t AS (SELECT vec_id, v, expert, p / sum(p) OVER (PARTITION BY vec_id) AS g FROM k WHERE r <= 2), o AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS c, unnest(list_transform(v, lambda a: tanh(a * (1 + 0.01::DOUBLE * expert)))) * g AS y FROM t)
SELECT vec_id, c::INTEGER AS c, round(sum(y), 6) AS value FROM o GROUP BY ALL""")
def expert_combination(spark, d):
    """Each vector through its two best of eight experts, which are one dense layer slightly altered, and their outputs summed by renormalised weights."""
    v = table(spark, d, "embeddings", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    top = v.select("vec_id", "v", F.explode(A.top_k(A.softmax(F.slice("v", 1, 8)), 2)).alias("t")).select("vec_id", "v", F.col("t.index").alias("expert"), F.col("t.value").alias("p"))
    from pyspark.sql import Window

    top = top.withColumn("g", F.col("p") / F.sum("p").over(Window.partitionBy("vec_id")))
    y = F.transform("v", lambda a: F.tanh(a * (1 + 0.01 * F.col("expert"))) * F.col("g"))
    return top.select("vec_id", F.posexplode(y).alias("c", "y")).groupBy("vec_id", "c").agg(F.round(F.sum("y"), 6).alias("value"))
