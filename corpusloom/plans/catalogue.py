"""The mixture plan, eras and other small dimension tables, and the questions asked of them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import table
from .registry import query

# Slots (main, anneal, total, floor), their shares by stage, transition windows, eras, length bands.
SLOTS = (("Core web", 40.0, 1.05, 41.05, 25.0), ("Code", 15.0, 1.0, 16.0, 8.0), ("Math / reasoning", 10.0, 1.5, 11.5, 5.0), ("Indic", 12.0, 3.0, 15.0, 6.0), ("Agentic", 6.0, 0.7, 6.7, 2.0), ("Long-context", 5.0, 0.0, 5.0, 2.0), ("Instruction", 3.0, 0.5, 3.5, 1.5), ("Safety", 1.0, 0.25, 1.25, 1.0))
BY_STAGE = (("Core web", (23.3, 11.5, 3.6, 1.6, 1.05)), ("Code", (1.0, 8.0, 4.0, 2.0, 1.0)), ("Math / reasoning", (0.5, 1.5, 7.0, 1.0, 1.5)), ("Indic", (4.3, 2.2, 2.5, 3.0, 3.0)), ("Agentic", (0.2, 0.8, 1.5, 3.5, 0.7)), ("Long-context", (0.2, 0.3, 0.5, 4.0, 0.0)), ("Instruction", (0.3, 0.5, 0.6, 1.6, 0.5)), ("Safety", (0.25, 0.25, 0.25, 0.25, 0.25)))
STAGE_TOTALS = (("S1", 30.0, 0.0, 30.0), ("S2", 25.05, 30.0, 55.0), ("S3", 20.0, 55.0, 75.0), ("S4", 16.95, 75.0, 92.0), ("S5", 8.0, 92.0, 100.0))
WINDOWS = (("S1-S2", 28.5, 31.5), ("S2-S3", 53.5, 56.5), ("S3-S4", 72.5, 77.5), ("S4-S5", 89.5, 94.5))
ERAS = (("exactness", "2014-01-01", "2017-12-31"), ("compute-1", "2018-01-01", "2020-12-31"), ("position", "2021-01-01", "2022-12-31"), ("decode-memory", "2023-01-01", "2023-12-31"), ("state-returns", "2024-01-01", "2024-12-31"), ("sparsity-returns", "2025-01-01", "2025-12-31"), ("compression", "2026-01-01", "2026-12-31"))
BANDS = ((0, "trivial"), (100, "multi-step"), (500, "extended"), (2000, "long-horizon"))


def _values(rows, types) -> str:
    cell = lambda v, t: f"'{v}'" if t == "s" else f"DATE '{v}'" if t == "d" else f"{v}::DOUBLE"
    return "(VALUES " + ", ".join("(" + ", ".join(cell(v, t) for v, t in zip(r, types)) + ")" for r in rows) + ")"


_STAGED = tuple((s, f"S{k + 1}", x) for s, v in BY_STAGE for k, x in enumerate(v))


@query(f"WITH p AS (SELECT * FROM {_values(_STAGED, 'ssf')} t(slot, stage, pct)), s AS (SELECT * FROM {_values(STAGE_TOTALS, 'sfff')} t(stage, stated, lo, hi)) SELECT stage, round(sum(pct), 4) AS total, any_value(stated) AS stated, abs(sum(pct) - any_value(stated)) <= 1e-6 AS agrees FROM p JOIN s USING (stage) GROUP BY stage")
def mixture_sum_audit(spark, d):
    p = spark.createDataFrame(_STAGED, "slot string, stage string, pct double")
    s = spark.createDataFrame([r[:2] for r in STAGE_TOTALS], "stage string, stated double")
    return p.groupBy("stage").agg(F.sum("pct").alias("t")).join(s, "stage").select("stage", F.round("t", 4).alias("total"), "stated", (F.abs(F.col("t") - F.col("stated")) <= 1e-6).alias("agrees"))


@query(f"WITH p AS (SELECT * FROM {_values(_STAGED, 'ssf')} t(slot, stage, pct)), s AS (SELECT * FROM {_values(SLOTS, 'sffff')} t(slot, main, anneal, total, floor)) SELECT slot, round(sum(pct), 4) AS planned, any_value(total) AS stated, any_value(floor) AS floor, sum(pct) >= any_value(floor) AS above_floor FROM p JOIN s USING (slot) GROUP BY slot")
def slot_floor_audit(spark, d):
    p = spark.createDataFrame(_STAGED, "slot string, stage string, pct double")
    s = spark.createDataFrame([(r[0], r[3], r[4]) for r in SLOTS], "slot string, stated double, floor double")
    return p.groupBy("slot").agg(F.sum("pct").alias("t")).join(s, "slot").select("slot", F.round("t", 4).alias("planned"), "stated", "floor", (F.col("t") >= F.col("floor")).alias("above_floor"))


@query(f"WITH p AS (SELECT * FROM {_values(_STAGED, 'ssf')} t(slot, stage, pct)) SELECT slot, stage, round(sum(pct) OVER (PARTITION BY slot ORDER BY stage) / sum(pct) OVER (PARTITION BY 1 ORDER BY stage RANGE UNBOUNDED PRECEDING), 6) AS share FROM p")
def cumulative_share(spark, d):
    """Each slot's share of all tokens seen by the end of each stage."""
    p = spark.createDataFrame(_STAGED, "slot string, stage string, pct double")
    seen = p.groupBy("stage").agg(F.sum("pct").alias("t")).withColumn("seen", F.sum("t").over(Window.orderBy("stage")))
    own = F.sum("pct").over(Window.partitionBy("slot").orderBy("stage"))
    return p.withColumn("own", own).join(seen, "stage").select("slot", "stage", F.round(F.col("own") / F.col("seen"), 6).alias("share"))


@query(f"SELECT name, lead(s) OVER (ORDER BY s) - e AS gap, coalesce(lead(s) OVER (ORDER BY s) - e < 0, false) AS overlaps FROM {_values(WINDOWS, 'sff')} t(name, s, e)")
def transition_overlap(spark, d):
    w = spark.createDataFrame(WINDOWS, "name string, s double, e double")
    gap = F.lead("s").over(Window.orderBy("s")) - F.col("e")
    return w.select("name", gap.alias("gap"), F.coalesce(gap < 0, F.lit(False)).alias("overlaps"))


@query(f"WITH t AS (SELECT unnest(range(285, 316)) / 10.0::DOUBLE AS t), p AS (SELECT * FROM {_values([(s, v[0] / 30, v[1] / 25) for s, v in BY_STAGE], 'sff')} x(slot, old, new)) SELECT slot, t, round(old + (new - old) * (t - 30 + 1.5) / 3, 6) AS share FROM p, t")
def blend_share(spark, d):
    """The shares in the window between the first two stages: a straight line from one to the other."""
    p = spark.createDataFrame([(s, v[0] / 30, v[1] / 25) for s, v in BY_STAGE], "slot string, old double, new double")
    t = p.withColumn("t", F.explode(F.transform(F.sequence(F.lit(285), F.lit(315)), lambda x: x / 10.0)))
    return t.select("slot", "t", F.round(F.col("old") + (F.col("new") - F.col("old")) * (F.col("t") - 30 + 1.5) / 3, 6).alias("share"))


@query(f"WITH e AS (SELECT * FROM {_values(ERAS, 'sdd')} t(era, lo, hi)) SELECT era, count(*) AS docs FROM (SELECT DISTINCT doc_id, collected_at FROM documents) c JOIN e ON c.collected_at::DATE BETWEEN lo AND hi GROUP BY era")
def era_range_join(spark, d):
    e = spark.createDataFrame(ERAS, "era string, lo string, hi string").select("era", F.col("lo").cast("date").alias("lo"), F.col("hi").cast("date").alias("hi"))
    c = table(spark, d, "documents", "doc_id", F.col("collected_at").cast("date").alias("day")).distinct()
    return c.join(F.broadcast(e), F.col("day").between(F.col("lo"), F.col("hi"))).groupBy("era").agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH s AS (SELECT * FROM {_values(STAGE_TOTALS, 'sfff')} t(stage, stated, lo, hi)), o AS (SELECT o_orderkey, (o_orderkey % 1000) / 10.0::DOUBLE AS pct FROM orders) SELECT stage, count(*) AS n FROM o JOIN s ON pct >= lo AND pct < hi GROUP BY stage")
def stage_lookup(spark, d):
    """The curriculum stage of each point of the token budget."""
    s = spark.createDataFrame([(r[0], r[2], r[3]) for r in STAGE_TOTALS], "stage string, lo double, hi double")
    o = table(spark, d, "orders", ((F.col("o_orderkey") % 1000) / 10.0).alias("pct"))
    return o.join(F.broadcast(s), (F.col("pct") >= F.col("lo")) & (F.col("pct") < F.col("hi"))).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN n < 100 THEN 'trivial' WHEN n < 500 THEN 'multi-step' WHEN n < 2000 THEN 'extended' ELSE 'long-horizon' END AS band, count(*) AS docs FROM (SELECT doc_id, any_value(len(tokens)) AS n FROM doc_tokens GROUP BY doc_id) GROUP BY 1")
def difficulty_bands(spark, d):
    n = table(spark, d, "doc_tokens", "doc_id", F.size("tokens").alias("n")).dropDuplicates(["doc_id"])
    band = F.lit(BANDS[0][1])
    for lo, name in BANDS[1:]:
        band = F.when(F.col("n") >= lo, name).otherwise(band)
    return n.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("docs"))


@query("""WITH a AS (SELECT doc_id, min(collected_at::DATE) AS stored FROM corpus GROUP BY doc_id), b AS (SELECT doc_id, min(assigned_at::DATE) AS known FROM role_assignment GROUP BY doc_id)
SELECT CASE WHEN known IS NULL THEN 'MISSING' WHEN stored <= known THEN 'OK' ELSE 'FAIL' END AS verdict, count(*) AS n FROM a LEFT JOIN b USING (doc_id) GROUP BY 1""")
def date_verify_join(spark, d):
    """Each document's stored date against another table's: agreeing, failing, or missing there."""
    a = table(spark, d, "corpus", "doc_id", "collected_at").groupBy("doc_id").agg(F.min(F.to_date("collected_at")).alias("stored"))
    b = table(spark, d, "role_assignment", "doc_id", "assigned_at").groupBy("doc_id").agg(F.min(F.to_date("assigned_at")).alias("known"))
    verdict = F.when(F.col("known").isNull(), "MISSING").when(F.col("stored") <= F.col("known"), "OK").otherwise("FAIL")
    return a.join(b, "doc_id", "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT DISTINCT doc_id FROM (SELECT doc_id, list_value(lower(trim(tier)), lower(trim(type))) AS tags FROM corpus) WHERE list_has_any(tags, ['web', 'synthetic'])""")
def tag_overlap_filter(spark, d):
    """Rows with any of the chosen tags; choosing none would show all."""
    chosen = ["web", "synthetic"]
    tags = F.array(F.lower(F.trim("tier")), F.lower(F.trim("type")))
    rows = table(spark, d, "corpus", "doc_id", "tier", "type")
    return rows.where(F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, chosen))), F.lit(False)) if chosen else F.lit(True)).select("doc_id").distinct()


@query("""SELECT count(*) AS docs, count(*) FILTER (WHERE has_type) AS typed, max(y) - min(y) AS span FROM (SELECT doc_id, bool_or(type IS NOT NULL) AS has_type, min(year(collected_at)) AS y FROM corpus GROUP BY doc_id)""")
def catalogue_stats(spark, d):
    c = table(spark, d, "corpus", "doc_id", "type", "collected_at").groupBy("doc_id").agg(F.bool_or(F.col("type").isNotNull()).alias("t"), F.min(F.year("collected_at")).alias("y"))
    return c.agg(F.count(F.lit(1)).alias("docs"), F.count_if("t").alias("typed"), (F.max("y") - F.min("y")).cast("bigint").alias("span"))


@query("""WITH r AS (SELECT lower(trim(tier)) AS variant, avg(len(text)) AS m FROM documents GROUP BY 1) SELECT variant, CASE WHEN m >= 600 AND variant <> 'unverified' THEN 'act' ELSE 'revert' END AS decision FROM r""")
def decision_rule(spark, d):
    """A rule set down beforehand: act where the effect is large enough and the guardrail holds."""
    r = table(spark, d, "documents", "tier", "text").groupBy(F.lower(F.trim("tier")).alias("variant")).agg(F.avg(F.length("text")).alias("m"))
    return r.select("variant", F.when((F.col("m") >= 600) & (F.col("variant") != "unverified"), "act").otherwise("revert").alias("decision"))


@query("""SELECT vec_id, CASE WHEN label = 0 THEN 'embed' WHEN label IN (1, 2) THEN 'attn' WHEN label = 3 THEN 'mlp' ELSE 'other' END AS grp FROM embeddings""")
def group_labels(spark, d):
    """Labels by rules, the first that fits."""
    k = F.col("label")
    return table(spark, d, "embeddings", "vec_id", F.when(k == 0, "embed").when(k.isin(1, 2), "attn").when(k == 3, "mlp").otherwise("other").alias("grp"))
