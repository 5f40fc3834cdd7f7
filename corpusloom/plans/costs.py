"""Closed-form cost models and schedules, over grids."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import query


def kv_cache_bytes(layers, heads, width, tokens, batch, per_number) -> Column:
    return F.lit(2).cast("bigint") * layers * heads * width * tokens * batch * per_number


def decimal_bytes(b) -> Column:
    """Bytes in units of 1000, two places under 10 and one from there."""
    out, units = None, ("B", "KB", "MB", "GB", "TB")
    for k, u in enumerate(units):
        v = b / F.lit(1000.0**k)
        text = F.concat(F.when(v < 10, F.format_string("%.2f", v)).otherwise(F.format_string("%.1f", v)), F.lit(f" {u}"))
        fits = b < 1000.0 ** (k + 1) if k + 1 < len(units) else F.lit(True)
        out = F.when(fits, text) if out is None else out.when(fits, text)
    return out


@query("""SELECT l::INTEGER AS layers, h::INTEGER AS kv_heads, t::BIGINT AS tokens, (2::BIGINT * l * h * 128 * t * 1 * 2)::BIGINT AS bytes FROM (VALUES (32), (80)) a(l), (VALUES (1), (8), (32)) b(h), (VALUES (4096), (131072)) c(t)""")
def kv_cache_grid(spark, d):
    g = spark.createDataFrame([(a, b, c) for a in (32, 80) for b in (1, 8, 32) for c in (4096, 131072)], "layers int, kv_heads int, tokens bigint")
    return g.withColumn("bytes", kv_cache_bytes(F.col("layers"), F.col("kv_heads"), 128, F.col("tokens"), 1, 2))


@query("SELECT n, CASE WHEN n < 1000 THEN printf(CASE WHEN n < 10 THEN '%.2f' ELSE '%.1f' END, n::DOUBLE) || ' B' WHEN n < 1000000 THEN printf(CASE WHEN n < 10000 THEN '%.2f' ELSE '%.1f' END, n / 1e3::DOUBLE) || ' KB' WHEN n < 1000000000 THEN printf(CASE WHEN n < 10000000 THEN '%.2f' ELSE '%.1f' END, n / 1e6::DOUBLE) || ' MB' WHEN n < 1000000000000 THEN printf(CASE WHEN n < 10000000000 THEN '%.2f' ELSE '%.1f' END, n / 1e9::DOUBLE) || ' GB' ELSE printf(CASE WHEN n < 10000000000000 THEN '%.2f' ELSE '%.1f' END, n / 1e12::DOUBLE) || ' TB' END AS shown FROM (SELECT (7::BIGINT * i * i * i * i * i) AS n FROM range(1, 200) t(i))")
def byte_units(spark, d):
    n = F.lit(7).cast("bigint") * F.col("id") * F.col("id") * F.col("id") * F.col("id") * F.col("id")
    return spark.range(1, 200).select(n.alias("n")).withColumn("shown", decimal_bytes(F.col("n").cast("double")))


def lr_cosine(step, warm: int, last: int, peak: float, floor: float) -> Column:
    x = (step - warm) / float(last - warm)
    return F.when(step < warm, peak * (step + 1) / warm).when(step > last, floor).otherwise(floor + 0.5 * (1 + F.cos(F.lit(math.pi) * x)) * (peak - floor))


def lr_wsd(step, warm: int, stable: int, end: int, peak: float, floor: float) -> Column:
    return F.when(step < warm, peak * (step + 1) / warm).when(step < stable, peak).when(step < end, peak - (step - stable) / float(end - stable) * (peak - floor)).otherwise(floor)


def lr_plan(pct, peak: float = 1.0, warm: float = 0.5, decay: float = 92.0, floor: float = 0.15) -> Column:
    """Warm-up, plateau, and a cosine down to a share of the peak, by percent of the tokens."""
    x = (pct - decay) / (100.0 - decay)
    return F.when(pct < warm, peak * pct / warm).when(pct < decay, peak).otherwise(peak * (floor + (1 - floor) * 0.5 * (1 + F.cos(F.lit(math.pi) * x))))


@query("""SELECT i AS step, round(CASE WHEN i < 20 THEN 1e-3::DOUBLE * (i + 1) / 20 WHEN i > 180 THEN 1e-4::DOUBLE ELSE 1e-4::DOUBLE + 0.5 * (1 + cos(pi() * (i - 20) / 160.0)) * (1e-3::DOUBLE - 1e-4::DOUBLE) END, 12) AS cosine,
round(CASE WHEN i < 20 THEN 1e-3::DOUBLE * (i + 1) / 20 WHEN i < 150 THEN 1e-3::DOUBLE WHEN i < 190 THEN 1e-3::DOUBLE - (i - 150) / 40.0 * (1e-3::DOUBLE - 1e-4::DOUBLE) ELSE 1e-4::DOUBLE END, 12) AS wsd FROM range(200) t(i)""")
def lr_schedules(spark, d):
    s = F.col("step")
    g = spark.range(200).toDF("step")
    return g.select("step", F.round(lr_cosine(s, 20, 180, 1e-3, 1e-4), 12).alias("cosine"), F.round(lr_wsd(s, 20, 150, 190, 1e-3, 1e-4), 12).alias("wsd"))


@query("SELECT i AS step, round(CASE WHEN i / 10.0 < 0.5 THEN i / 10.0 / 0.5 WHEN i / 10.0 < 92 THEN 1.0 ELSE 0.15::DOUBLE + 0.85::DOUBLE * 0.5 * (1 + cos(pi() * (i / 10.0 - 92) / 8.0)) END::DOUBLE, 9) AS lr FROM range(1001) t(i)")
def lr_by_share(spark, d):
    return spark.range(1001).select(F.col("id").alias("step"), F.round(lr_plan(F.col("id") / 10.0), 9).alias("lr"))


@query("SELECT b AS batch, least(3e-3::DOUBLE, 1e-3::DOUBLE * sqrt(b / 32.0)) AS lr FROM (VALUES (32), (128), (288), (512), (1024), (1408)) t(b)")
def lr_for_batch(spark, d):
    b = spark.createDataFrame([(x,) for x in (32, 128, 288, 512, 1024, 1408)], "batch int")
    return b.withColumn("lr", F.least(F.lit(3e-3), 1e-3 * F.sqrt(F.col("batch") / 32.0)))


PARTS = (("params_fp16", 2, 3), ("grads_fp16", 2, 2), ("master_fp32", 4, 1), ("adam_m", 4, 1), ("adam_v", 4, 1))


@query("""WITH p(part, width, since) AS (VALUES ('params_fp16', 2, 3), ('grads_fp16', 2, 2), ('master_fp32', 4, 1), ('adam_m', 4, 1), ('adam_v', 4, 1)), g AS (SELECT * FROM (VALUES (0), (1), (2), (3)) s(stage), (VALUES (1), (8), (32)) n(gpus)),
m AS (SELECT stage, gpus, sum(3700000::DOUBLE * width / CASE WHEN stage >= since THEN gpus ELSE 1 END) / 1048576 AS mb FROM g, p GROUP BY ALL)
SELECT stage, gpus, round(mb, 6) AS mb, round(first_value(mb) OVER (PARTITION BY gpus ORDER BY stage) / mb, 6) AS reduction FROM m""")
def zero_memory_grid(spark, d):
    """Memory a device for the sharding stages: a part is cut by the number of devices from its stage on."""
    from pyspark.sql import Window

    rows = [(s, n, part, w, since) for s in range(4) for n in (1, 8, 32) for part, w, since in PARTS]
    g = spark.createDataFrame(rows, "stage int, gpus int, part string, width int, since int")
    per = 3700000.0 * F.col("width") / F.when(F.col("stage") >= F.col("since"), F.col("gpus")).otherwise(1)
    m = g.groupBy("stage", "gpus").agg((F.sum(per) / 1048576).alias("mb"))
    return m.select("stage", "gpus", F.round("mb", 6).alias("mb"), F.round(F.first("mb").over(Window.partitionBy("gpus").orderBy("stage")) / F.col("mb"), 6).alias("reduction"))


@query("""WITH c(op, stage, k, width, calls) AS (VALUES ('all_reduce', 0, 2, 2, 1), ('reduce_scatter', 1, 1, 2, 1), ('all_gather', 1, 1, 2, 1), ('reduce_scatter', 2, 1, 2, 1), ('all_gather', 2, 1, 2, 1), ('reduce_scatter', 3, 1, 2, 1), ('all_gather', 3, 1, 2, 2)), n(gpus) AS (VALUES (2), (8), (32))
SELECT stage, gpus, op, round(k * calls * (gpus - 1) / gpus::DOUBLE * 3700000 * width, 3) AS bytes FROM c, n""")
def collective_bytes(spark, d):
    """Bytes a step by the formulas: a ring all-reduce moves twice (N - 1) / N of the data, the others once; full sharding gathers twice."""
    c = [("all_reduce", 0, 2, 1), ("reduce_scatter", 1, 1, 1), ("all_gather", 1, 1, 1), ("reduce_scatter", 2, 1, 1), ("all_gather", 2, 1, 1), ("reduce_scatter", 3, 1, 1), ("all_gather", 3, 1, 2)]
    g = spark.createDataFrame([(s, n, op, k * calls) for op, s, k, calls in c for n in (2, 8, 32)], "stage int, gpus int, op string, k int")
    return g.select("stage", "gpus", "op", F.round(F.col("k") * (F.col("gpus") - 1) / F.col("gpus").cast("double") * 3700000 * 2, 3).alias("bytes"))


@query("""WITH c(op, stage, k, width, calls) AS (VALUES ('all_reduce', 0, 2, 2, 1), ('all_gather', 1, 1, 4, 1), ('all_gather', 2, 1, 4, 1), ('all_gather', 3, 1, 2, 1)) SELECT stage, op, round(k * calls * 31 / 32.0::DOUBLE * 3700000 * width, 3) AS bytes FROM c""")
def collective_bytes_recorded(spark, d):
    """Bytes as a recorder counts them that gathers fp32 shards, and full parameters once."""
    g = spark.createDataFrame([(0, "all_reduce", 2, 2), (1, "all_gather", 1, 4), (2, "all_gather", 1, 4), (3, "all_gather", 1, 2)], "stage int, op string, k int, width int")
    return g.select("stage", "op", F.round(F.col("k") * 31 / 32.0 * 3700000 * F.col("width"), 3).alias("bytes"))


@query("SELECT n, s, round(sqrt((n - s) / ((n - 1.0) * s)), 9) AS bound FROM (VALUES (256)) a(n), (VALUES (16), (24), (64), (128)) b(s)")
def welch_bound(spark, d):
    g = spark.createDataFrame([(256, s) for s in (16, 24, 64, 128)], "n int, s int")
    return g.withColumn("bound", F.round(F.sqrt((F.col("n") - F.col("s")) / ((F.col("n") - 1.0) * F.col("s"))), 9))


@query("SELECT kv::INTEGER AS kv_heads, q::INTEGER AS query_head, (q // (8 // kv))::INTEGER AS shared_head, kv / 8.0::DOUBLE AS cache_ratio FROM (VALUES (1), (2), (4), (8)) a(kv), range(8) b(q)")
def shared_heads(spark, d):
    g = spark.createDataFrame([(k, q) for k in (1, 2, 4, 8) for q in range(8)], "kv_heads int, query_head int")
    return g.withColumn("shared_head", F.floor(F.col("query_head") / (F.lit(8) / F.col("kv_heads"))).cast("int")).withColumn("cache_ratio", F.col("kv_heads") / 8.0)


@query("SELECT i::INTEGER AS i, (i * 0.05)::DOUBLE AS x, ((i * 0.05) * (i * 0.05))::DOUBLE AS quadratic, (i * 0.05 * 2)::DOUBLE AS linear FROM range(81) t(i)")
def cost_curves(spark, d):
    x = F.col("id") * 0.05
    return spark.range(81).select(F.col("id").cast("int").alias("i"), x.alias("x"), (x * x).alias("quadratic"), (x * 2).alias("linear"))


@query("SELECT t AS tokens, m AS block, ceil(t / m::DOUBLE)::BIGINT AS blocks, least(16, ceil(t / m::DOUBLE))::BIGINT AS reads FROM (VALUES (1000), (4096), (100000)) a(t), (VALUES (4), (16), (64)) b(m)")
def block_compression(spark, d):
    g = spark.createDataFrame([(t, m) for t in (1000, 4096, 100000) for m in (4, 16, 64)], "tokens int, block int").withColumn("blocks", F.ceil(F.col("tokens") / F.col("block")))
    return g.withColumn("reads", F.least(F.lit(16).cast("bigint"), "blocks"))


@query("SELECT p AS pattern, (length(p) - length(replace(p, 'G', '')))::INTEGER AS global_layers, round((length(p) - length(replace(p, 'G', ''))) / length(p)::DOUBLE, 6) AS ratio FROM (VALUES ('GGGG'), ('LLLG'), ('LLLLLG'), ('GLGLGL')) t(p)")
def layer_patterns(spark, d):
    g = spark.createDataFrame([(p,) for p in ("GGGG", "LLLG", "LLLLLG", "GLGLGL")], "pattern string")
    n = F.length("pattern") - F.length(F.replace("pattern", F.lit("G"), F.lit("")))
    return g.select("pattern", n.alias("global_layers"), F.round(n / F.length("pattern"), 6).alias("ratio"))


@query("""WITH RECURSIVE s AS (SELECT 0::BIGINT AS lo, NULL::BIGINT AS hi, 16::BIGINT AS b, 0 AS k UNION ALL
SELECT CASE WHEN fits THEN b ELSE lo END, CASE WHEN fits THEN hi ELSE b END, CASE WHEN CASE WHEN fits THEN hi ELSE b END IS NULL THEN b * 2 ELSE (CASE WHEN fits THEN b ELSE lo END + CASE WHEN fits THEN hi ELSE b END) // 2 // 8 * 8 END, k + 1
FROM (SELECT *, b * 10.9 <= 15360 AS fits FROM s) WHERE (hi IS NULL OR hi - lo > 8) AND b > lo AND (hi IS NULL OR b < hi)) SELECT max(lo) AS most FROM s""")
def max_batch_search(spark, d):
    """The largest batch, to a multiple of 8, that fits: doubling, then halving, as a recursive query over a memory model."""
    return spark.sql("""
        WITH RECURSIVE s(lo, hi, b, k) AS (
          SELECT 0L, CAST(NULL AS BIGINT), 16L, 0
          UNION ALL
          SELECT lo2, hi2, CASE WHEN hi2 IS NULL THEN b * 2 ELSE ((lo2 + hi2) DIV 2 DIV 8) * 8 END, k + 1
          FROM (SELECT b, k, IF(b * 10.9 <= 15360, b, lo) AS lo2, IF(b * 10.9 <= 15360, hi, b) AS hi2 FROM s WHERE (hi IS NULL OR hi - lo > 8) AND b > lo AND (hi IS NULL OR b < hi)))
        SELECT max(lo) AS most FROM s""")


@query("SELECT k::INTEGER AS k, round(0.5::DOUBLE * pow(10.0::DOUBLE, -k), 12) AS h, round((pow(2.0::DOUBLE + pow(10.0::DOUBLE, -k), 3) - pow(2.0::DOUBLE - pow(10.0::DOUBLE, -k), 3)) / (2 * pow(10.0::DOUBLE, -k)), 5) AS slope FROM range(1, 6) t(k)")
def finite_difference_check(spark, d):
    """A derivative against central differences over a sweep of steps."""
    h = F.pow(F.lit(10.0), -F.col("id"))
    cube = lambda x: F.pow(x, F.lit(3.0))
    return spark.range(1, 6).select(F.col("id").cast("int").alias("k"), F.round(0.5 * h, 12).alias("h"), F.round((cube(2.0 + h) - cube(2.0 - h)) / (2 * h), 5).alias("slope"))
