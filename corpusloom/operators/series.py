"""Metric series (run, step, value): folds and windows over the steps of each run.

Folds and ranks go over ranges of a run and then over what the ranges come to, so no run is held by one task.
Null values are passed over by folds and give null in windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def by_step(column: str = "step"):
    return Window.partitionBy("run").orderBy(column)


def ema(series: DataFrame, k: float) -> DataFrame:
    """series with ema: e = k e + (1 - k) v, from the first value; a null value changes nothing.

    The step is linear, so a part of a run folds to (decay, sum) whatever came before: runs are cut into
    ranges, each is folded by itself, and what the ranges before come to is added. No run is held by one task.
    """
    ranged = written(series.select("run", "step", "value").repartitionByRange("run", "step").withColumn("part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("run", "part").orderBy("step")
    seen = F.sum(F.col("value").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ordered = ranged.withColumn("seen", seen).repartition("run", "part").sortWithinPartitions("run", "part", "step")

    def fold(batches):
        key, e = None, 0.0
        for b in batches:
            out = []
            for r, p, v in zip(b["run"], b["part"], b["value"]):
                if (r, p) != key:
                    key, e = (r, p), 0.0
                if v == v and v is not None:
                    e = k * e + (1 - k) * v
                out.append(e)
            yield b.assign(own=out)

    kind = dict(ranged.dtypes)
    own = ordered.mapInPandas(fold, f"run {kind['run']}, step {kind['step']}, value double, part int, seen bigint, own double")
    # what a range adds, and the first value of a run, which weighs 1 and not 1 - k
    ends = ranged.groupBy("run", "part").agg(F.count("value").alias("n"), F.min_by("value", F.when(F.col("value").isNotNull(), F.col("step"))).alias("first"))
    last = own.groupBy("run", "part").agg(F.max_by("own", "step").alias("sum"))
    parts = ends.join(last, ["run", "part"])
    up = Window.partitionBy("run").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # the ranges of a run are as many as the partitions it covers; the fold over them is a few numbers a range
    parts = parts.withColumn("before", F.coalesce(F.collect_list(F.struct("n", "sum", "first")).over(up), F.array()))
    carried = F.aggregate("before", F.struct(F.lit(0.0).alias("e"), F.lit(False).alias("any")), lambda a, p: F.struct((a["e"] * F.pow(F.lit(float(k)), p["n"].cast("double")) + p["sum"] + F.when(~a["any"] & (p["n"] > 0), p["first"] * F.pow(F.lit(float(k)), p["n"].cast("double"))).otherwise(0.0)).alias("e"), (a["any"] | (p["n"] > 0)).alias("any")))
    parts = parts.withColumn("c", carried).select("run", "part", "first", F.col("c.e").alias("e"), F.col("c.any").alias("any"))
    both = own.alias("o").join(parts.alias("p"), F.col("o.run").eqNullSafe(F.col("p.run")) & (F.col("o.part") == F.col("p.part")))
    decay = F.pow(F.lit(float(k)), F.col("seen").cast("double"))
    value = F.when(F.col("any"), F.col("own") + decay * F.col("e")).when(F.col("seen") > 0, F.col("own") + decay * F.col("first"))
    return both.select("o.run", "step", "value", value.alias("ema"))


def exact_quantiles(series: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """(run, q): the quantiles of each run's values, exact and linearly interpolated, in the order of shares; nulls are left out.

    Values are range-partitioned and counted by range; a value's rank is its range's plus its place in it, so a
    run is spread over ranges, and of the ranked values only the two beside each quantile are kept.
    """
    ranged = written(series.select("run", "value").where("value is not null").repartitionByRange("run", "value").withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("run", "part").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("run")
    totals = totals.withColumn("before", F.sum("n").over(w.orderBy("part")) - F.col("n")).withColumn("all", F.sum("n").over(w))
    place = F.row_number().over(Window.partitionBy("run", "part").orderBy("value")) - 1
    at = ranged.withColumn("i", place).alias("a").join(totals.alias("t"), F.col("a.run").eqNullSafe(F.col("t.run")) & (F.col("a.part") == F.col("t.part"))).select("a.run", "value", (F.col("i") + F.col("before")).alias("rank"), "all")
    low = [F.floor(F.lit(s) * (F.col("all") - 1)) for s in shares]
    near = F.lit(False)
    for x in low:
        near = near | (F.col("rank") == x) | (F.col("rank") == x + 1)
    kept = at.where(near)
    out = kept.groupBy("run").agg(*[F.max(F.when(F.col("rank") == x, F.col("value"))).alias(f"l{k}") for k, x in enumerate(low)], *[F.max(F.when(F.col("rank") == x + 1, F.col("value"))).alias(f"h{k}") for k, x in enumerate(low)], F.max("all").alias("all"))
    part = [F.lit(s) * (F.col("all") - 1) - F.floor(F.lit(s) * (F.col("all") - 1)) for s in shares]
    return out.select("run", F.array(*[F.col(f"l{k}") + F.coalesce(F.col(f"h{k}") - F.col(f"l{k}"), F.lit(0.0)) * part[k] for k in range(len(shares))]).alias("q"))


def running_best(series: DataFrame, margin: float) -> DataFrame:
    """series with best, the least value of earlier steps, and whether the value is over it by more than margin."""
    best = F.min("value").over(by_step().rowsBetween(Window.unboundedPreceding, -1))
    return series.withColumn("best", best).withColumn("breach", F.coalesce(F.col("value") > F.col("best") + margin, F.lit(False)))


def plateau(series: DataFrame, eps: float) -> DataFrame:
    """series with flat: the value fell by less than eps since the step before."""
    return series.withColumn("flat", F.coalesce(F.lag("value").over(by_step()) - F.col("value") < eps, F.lit(False)))


def differences(series: DataFrame) -> DataFrame:
    """series with the change since the step before and the change to the next."""
    w = by_step()
    return series.withColumn("change", F.col("value") - F.lag("value").over(w)).withColumn("next_change", F.lead("value").over(w) - F.col("value"))


def first_and_last(series: DataFrame, k: int) -> DataFrame:
    """(run, first_mean, last_mean, gap) over the first and last k steps."""
    w = Window.partitionBy("run")
    r = series.withColumn("i", F.row_number().over(by_step())).withColumn("n", F.count(F.lit(1)).over(w))
    out = r.groupBy("run").agg(F.avg(F.when(F.col("i") <= k, F.col("value"))).alias("first_mean"), F.avg(F.when(F.col("i") > F.col("n") - k, F.col("value"))).alias("last_mean"))
    return out.withColumn("gap", F.col("first_mean") - F.col("last_mean"))


def aligned_gap(a: DataFrame, b: DataFrame, last: int = 10) -> DataFrame:
    """(run, mean_gap, last_mean_gap, max_gap, final_gap) of two series on the steps both have."""
    both = a.select("run", "step", F.col("value").alias("x")).join(b.select("run", "step", F.col("value").alias("y")), ["run", "step"]).withColumn("gap", F.abs(F.col("x") - F.col("y")))
    r = both.withColumn("back", F.row_number().over(Window.partitionBy("run").orderBy(F.desc("step"))))
    return r.groupBy("run").agg(F.avg("gap").alias("mean_gap"), F.avg(F.when(F.col("back") <= last, F.col("gap"))).alias("last_mean_gap"), F.max("gap").alias("max_gap"), F.max_by("gap", "step").alias("final_gap"))


def first_step_where(series: DataFrame, condition: Column) -> DataFrame:
    """(run, step): the first step where the condition holds, null if it never does."""
    return series.groupBy("run").agg(F.min(F.when(condition, F.col("step"))).alias("step"))


def non_finite(c) -> Column:
    return F.isnan(c) | (F.abs(c) == float("inf"))


def weighted_and_naive(batches: DataFrame) -> DataFrame:
    """(run, weighted, naive) of batches (run, mean, n): the mean over all tokens, and the mean of means."""
    return batches.groupBy("run").agg((F.sum(F.col("mean") * F.col("n")) / F.nullif(F.sum("n"), F.lit(0))).alias("weighted"), F.avg("mean").alias("naive"))


def throughput(timed: DataFrame, warm: int = 5) -> DataFrame:
    """timed (run, step, tokens, seconds) with the running rate since the warm-up."""
    w = by_step().rowsBetween(Window.unboundedPreceding, 0)
    on = F.col("step") >= warm
    total = lambda c: F.sum(F.when(on, F.col(c))).over(w)
    return timed.withColumn("rate", F.try_divide(total("tokens").cast("double"), total("seconds")))


def exclusive_offsets(sizes: DataFrame) -> DataFrame:
    """sizes (run, step, n) with offset, the sum of n of earlier steps."""
    return sizes.withColumn("offset", F.coalesce(F.sum("n").over(by_step().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
