"""Queries over metric series and aggregates. events stand for logged steps: a run a user, a step an event; lineitem for sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import series as S
from ..session import table
from .registry import query


def runs(spark, d):
    return table(spark, d, "events", "event_id", "user_id", "value").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), "value")


_E = "e AS (SELECT user_id AS run, event_id AS step, value FROM events)"


@query(f"""WITH RECURSIVE {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM e),
r AS (SELECT run, step, i, value AS ema FROM n WHERE i = 1 UNION ALL SELECT n.run, n.step, n.i, 0.98::DOUBLE * r.ema + (1 - 0.98::DOUBLE) * n.value FROM r JOIN n ON n.run = r.run AND n.i = r.i + 1)
SELECT run, step, round(ema, 6) AS ema FROM r""")
def ema_loss(spark, d):
    return S.ema(runs(spark, d), 0.98).select("run", "step", F.round("ema", 6).alias("ema"))


@query(f"""WITH {_E}, b AS (SELECT *, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e)
SELECT run, step, best, coalesce(value > best + 0.02::DOUBLE, false) AS breach FROM b""")
def running_best_margin(spark, d):
    return S.running_best(runs(spark, d), 0.02).select("run", "step", "best", "breach")


@query(f"WITH {_E} SELECT run, step, coalesce(lag(value) OVER (PARTITION BY run ORDER BY step) - value < 0.01::DOUBLE, false) AS flat FROM e")
def plateau_flag(spark, d):
    return S.plateau(runs(spark, d), 0.01).select("run", "step", "flat")


@query(f"""WITH {_E}, x AS (SELECT run, step, value - lag(value) OVER w AS change, lead(value) OVER w - value AS next_change FROM e WINDOW w AS (PARTITION BY run ORDER BY step)),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY abs(change) + abs(next_change) DESC, step) AS k FROM x WHERE change IS NOT NULL AND next_change IS NOT NULL)
SELECT run, step, round(change, 6) AS change, round(next_change, 6) AS next_change FROM r WHERE k <= 5""")
def lead_lag_top5(spark, d):
    x = S.differences(runs(spark, d)).where("change is not null and next_change is not null")
    w = Window.partitionBy("run").orderBy(F.desc(F.abs("change") + F.abs("next_change")), "step")
    return x.withColumn("k", F.row_number().over(w)).where("k <= 5").select("run", "step", F.round("change", 6).alias("change"), F.round("next_change", 6).alias("next_change"))


@query(f"""WITH {_E}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) AS i, count(*) OVER (PARTITION BY run) AS n FROM e)
SELECT run, round(avg(value) FILTER (WHERE i <= 5), 6) AS first_mean, round(avg(value) FILTER (WHERE i > n - 5), 6) AS last_mean FROM r GROUP BY run""")
def first_last_gap(spark, d):
    return S.first_and_last(runs(spark, d), 5).select("run", F.round("first_mean", 6).alias("first_mean"), F.round("last_mean", 6).alias("last_mean"))


@query("""WITH a AS (SELECT user_id AS run, event_id // 10 AS step, max(value) AS x FROM events WHERE event_id % 2 = 0 GROUP BY ALL), b AS (SELECT user_id AS run, event_id // 10 AS step, max(value) AS y FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
g AS (SELECT run, step, abs(x - y) AS gap, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS back FROM a JOIN b USING (run, step))
SELECT run, round(avg(gap), 6) AS mean_gap, round(avg(gap) FILTER (WHERE back <= 10), 6) AS last_mean_gap, round(max(gap), 6) AS max_gap, round(arg_max(gap, step), 6) AS final_gap FROM g GROUP BY run""")
def series_gap(spark, d):
    e = table(spark, d, "events", "event_id", "user_id", "value")
    half = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("user_id").alias("run"), F.floor(F.col("event_id") / 10).alias("step")).agg(F.max("value").alias("value"))
    return S.aligned_gap(half(0), half(1)).select("run", *[F.round(c, 6).alias(c) for c in ("mean_gap", "last_mean_gap", "max_gap", "final_gap")])


@query(f"WITH {_E} SELECT run, min(step) FILTER (WHERE value < 1) AS step FROM e GROUP BY run")
def first_gap_step(spark, d):
    return S.first_step_where(runs(spark, d), F.col("value") < 1)


@query("SELECT user_id AS run, min(event_id) FILTER (WHERE event_type = 'error') AS step FROM events GROUP BY 1")
def first_nonfinite_step(spark, d):
    """The divergence point of each run, where an error's value is not a number."""
    v = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    r = table(spark, d, "events", "event_id", "user_id", "event_type", "value").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), v.alias("value"))
    return S.first_step_where(r, S.non_finite(F.col("value")))


@query("""WITH b AS (SELECT l_suppkey AS run, l_orderkey, avg(l_discount) AS mean, sum(l_quantity) AS n FROM lineitem GROUP BY ALL) SELECT run, round(sum(mean * n) / nullif(sum(n), 0), 6) AS weighted, round(avg(mean), 6) AS naive FROM b GROUP BY run""")
def weighted_vs_naive_mean(spark, d):
    b = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_discount", "l_quantity").groupBy(F.col("l_suppkey").alias("run"), "l_orderkey").agg(F.avg("l_discount").alias("mean"), F.sum("l_quantity").alias("n"))
    return S.weighted_and_naive(b).select("run", F.round("weighted", 6).alias("weighted"), F.round("naive", 6).alias("naive"))


@query("""WITH t AS (SELECT l_suppkey AS run, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_tax, l_shipdate) - 1 AS step, l_quantity::BIGINT AS tokens, round(100 + l_tax * 100)::BIGINT AS seconds FROM lineitem)
SELECT run, step, sum(CASE WHEN step >= 5 THEN tokens END) OVER w / sum(CASE WHEN step >= 5 THEN seconds END) OVER w AS rate FROM t WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)""")
def throughput_after_warmup(spark, d):
    li = table(spark, d, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_tax")
    step = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_tax", "l_shipdate")).cast("bigint") - 1
    t = li.select(F.col("l_suppkey").alias("run"), step.alias("step"), F.col("l_quantity").cast("bigint").alias("tokens"), F.round(100 + F.col("l_tax") * 100).cast("bigint").alias("seconds"))
    return S.throughput(t).select("run", "step", "rate")


@query("""WITH s AS (SELECT l_orderkey AS run, l_linenumber AS step, sum(l_quantity)::BIGINT AS n FROM lineitem GROUP BY ALL) SELECT run, step, coalesce(sum(n) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at FROM s""")
def microbatch_offsets(spark, d):
    s = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").groupBy(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("step")).agg(F.sum("l_quantity").cast("bigint").alias("n"))
    return S.exclusive_offsets(s).select("run", "step", F.col("offset").alias("start_at"))


@query(f"WITH {_E} SELECT run, step, lag(step) OVER w AS before, lead(step) OVER w AS after FROM e WINDOW w AS (PARTITION BY run ORDER BY step)")
def previous_and_next(spark, d):
    w = S.by_step()
    return runs(spark, d).select("run", "step", F.lag("step").over(w).alias("before"), F.lead("step").over(w).alias("after"))


@query("""WITH s AS (SELECT l_linenumber AS width, l_discount AS lr, round(avg(l_extendedprice), 4) AS loss FROM lineitem GROUP BY ALL) SELECT width, arg_min(lr, (loss, lr)) AS best_lr, min(loss) AS best_loss FROM s GROUP BY width""")
def argmin_lr_per_width(spark, d):
    s = table(spark, d, "lineitem", "l_linenumber", "l_discount", "l_extendedprice").groupBy(F.col("l_linenumber").alias("width"), F.col("l_discount").alias("lr")).agg(F.round(F.avg("l_extendedprice"), 4).alias("loss"))
    return s.groupBy("width").agg(F.min_by("lr", F.struct("loss", "lr")).alias("best_lr"), F.min("loss").alias("best_loss"))


@query("""WITH s AS (SELECT l_linenumber AS variant, l_discount AS lr, round(avg(l_extendedprice), 4) AS loss FROM lineitem GROUP BY ALL) SELECT arg_min(variant, (loss, variant)) AS best_variant, min(loss) AS loss FROM s WHERE variant IN (1, 3, 5)""")
def argmin_filtered(spark, d):
    """The best of a chosen set of variants."""
    s = table(spark, d, "lineitem", "l_linenumber", "l_discount", "l_extendedprice").groupBy(F.col("l_linenumber").alias("variant"), "l_discount").agg(F.round(F.avg("l_extendedprice"), 4).alias("loss"))
    return s.where(F.col("variant").isin(1, 3, 5)).agg(F.min_by("variant", F.struct("loss", "variant")).alias("best_variant"), F.min("loss").alias("loss"))


@query("""SELECT l_returnflag AS series, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(exp(regr_intercept(ln(l_extendedprice), ln(l_quantity))), 4) AS scale, round(regr_r2(ln(l_extendedprice), ln(l_quantity)), 6) AS r2 FROM lineitem GROUP BY 1""")
def power_law_fit(spark, d):
    x, y = F.ln("l_quantity"), F.ln("l_extendedprice")
    return table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_extendedprice").groupBy(F.col("l_returnflag").alias("series")).agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.exp(F.regr_intercept(y, x)), 4).alias("scale"), F.round(F.regr_r2(y, x), 6).alias("r2"))


@query("""SELECT l_returnflag AS grp, min(a) AS least, round(quantile_cont(a, 0.01), 6) AS p1, round(quantile_cont(a, 0.5), 6) AS p50, round(quantile_cont(a, 0.99), 6) AS p99, max(a) AS most FROM (SELECT l_returnflag, abs(l_extendedprice) AS a FROM lineitem) WHERE a > 0 GROUP BY 1""")
def quantile_profile(spark, d):
    a = table(spark, d, "lineitem", "l_returnflag", "l_extendedprice").select(F.col("l_returnflag").alias("grp"), F.abs("l_extendedprice").alias("a")).where("a > 0")
    q = S.exact_quantiles(a.select(F.col("grp").alias("run"), F.col("a").alias("value")), (0.01, 0.5, 0.99)).select(F.col("run").alias("grp"), "q")
    ends = a.groupBy("grp").agg(F.min("a").alias("least"), F.max("a").alias("most"))
    return ends.join(q, "grp").select("grp", "least", *[F.round(F.col("q")[k], 6).alias(n) for k, n in enumerate(("p1", "p50", "p99"))], "most")


@query("""SELECT event_type AS op, count(*) AS trials, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most FROM events GROUP BY 1""")
def trial_stats(spark, d):
    return table(spark, d, "events", "event_type", "value").groupBy(F.col("event_type").alias("op")).agg(F.count(F.lit(1)).alias("trials"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"))


@query("""SELECT event_type AS phase, round(sum(value::DECIMAL(18, 4))::DOUBLE, 4) AS total, round(sum(value::DECIMAL(18, 4))::DOUBLE / (SELECT sum(value::DECIMAL(18, 4))::DOUBLE FROM events), 8) AS share FROM events GROUP BY 1""")
def phase_shares(spark, d):
    v = F.sum(F.col("value").cast("decimal(18,4)")).cast("double")
    s = table(spark, d, "events", "event_type", "value").groupBy(F.col("event_type").alias("phase")).agg(v.alias("total"))
    return s.withColumn("share", F.round(F.col("total") / F.sum("total").over(Window.partitionBy()), 8)).withColumn("total", F.round("total", 4))


@query("""WITH e AS (SELECT user_id, event_type, value, event_id FROM events) SELECT user_id AS run, round(exp(sum(value / 100.0::DOUBLE * (1 + event_id % 7)) / sum(1 + event_id % 7)), 6) AS perplexity FROM e GROUP BY 1""")
def corpus_perplexity(spark, d):
    n = 1 + F.col("event_id") % 7
    return table(spark, d, "events", "event_id", "user_id", "value").groupBy(F.col("user_id").alias("run")).agg(F.round(F.exp(F.sum(F.col("value") / 100.0 * n) / F.sum(n)), 6).alias("perplexity"))


@query("""SELECT user_id AS run, round(avg(value), 6) AS val_loss FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE value > 0) WHERE r <= 8 GROUP BY 1""")
def validation_loss(spark, d):
    """The mean over the first 8 sequences that bear loss."""
    v = runs(spark, d).where("value > 0").withColumn("r", F.row_number().over(S.by_step()))
    return v.where("r <= 8").groupBy("run").agg(F.round(F.avg("value"), 6).alias("val_loss"))


@query("""WITH t AS (SELECT event_type AS split, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, value FROM events) SELECT split, round(avg(value), 6) AS loss FROM t WHERE r <= 50 GROUP BY split""")
def eval_batches(spark, d):
    """The mean over a fixed number of batches of each split."""
    t = table(spark, d, "events", "event_id", "event_type", "value").withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")))
    return t.where("r <= 50").groupBy(F.col("event_type").alias("split")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query("""WITH r AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, value FROM events)
SELECT run, round(avg(value) FILTER (WHERE step >= 3), 6) AS ms, round(avg(value) FILTER (WHERE step < 3), 6) AS before, round(avg(value) FILTER (WHERE step >= 3) / avg(value) FILTER (WHERE step < 3) - 1, 6) AS change FROM r GROUP BY run""")
def warmup_change(spark, d):
    r = runs(spark, d).withColumn("i", F.row_number().over(S.by_step()) - 1).groupBy("run").agg(F.avg(F.when(F.col("i") >= 3, F.col("value"))).alias("ms"), F.avg(F.when(F.col("i") < 3, F.col("value"))).alias("before"))
    return r.select("run", F.round("ms", 6).alias("ms"), F.round("before", 6).alias("before"), F.round(F.col("ms") / F.col("before") - 1, 6).alias("change"))


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value < 50) AS low, bool_and(value >= 0) AS passed FROM events GROUP BY 1""")
def finding_rollup(spark, d):
    """Findings by kind: how many, and whether all passed."""
    return table(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 50).alias("low"), F.bool_and(F.col("value") >= 0).alias("passed"))
