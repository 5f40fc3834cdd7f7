"""Scoring candidates against a direction, classifying them, and drawing an order.

Vectors are sketched by CountSketch: position i goes to a bucket with a sign, both keyed draws. The
(position, bucket, sign) table is as long as a vector, whatever the number of vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import hashing as H

# The purpose strings of the draws, and the names of the steps.
SKETCH_PURPOSE = ("opus-sketch", 0, "hash")
ORDER_PURPOSE = "boltzmann"
STEPS = ("ingest", "firewall_check", "integrity_check", "opus_score", "threshold_rule", "mixture_fit", "floor_check", "verdict")


def sketch_table(spark: SparkSession, width: int, dim: int = config.SKETCH) -> DataFrame:
    """(pos, bucket, sign) of every position under width."""
    key = H.key_hex(config.SEED, *SKETCH_PURPOSE, F.col("id"))
    at = spark.range(width).withColumn("k", key)
    bucket = F.pmod(F.floor(H.uniform_column(F.col("k"), F.lit(0)) * dim), F.lit(dim)).cast("int")
    sign = F.when(H.uniform_column(F.col("k"), F.lit(1)) < 0.5, 1.0).otherwise(-1.0)
    return at.select(F.col("id").cast("int").alias("pos"), bucket.alias("bucket"), sign.alias("sign"))


def countsketch(vectors: DataFrame, width: int, dim: int = config.SKETCH) -> DataFrame:
    """(id, bucket, value) of vectors (id, v array); zero buckets without an entry are left out."""
    table = F.broadcast(sketch_table(vectors.sparkSession, width, dim))  # width rows
    each = vectors.select("id", F.posexplode("v").alias("pos", "x")).where("x <> 0")
    return each.join(table, "pos").groupBy("id", "bucket").agg(F.sum(F.col("x").cast("double") * F.col("sign")).alias("value"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 where either vector is zero; null where either is null."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def classify(score, centre: float = config.ACCEPT, band: float = config.BAND) -> Column:
    return F.when(score >= centre + band, "ACCEPT").when(score <= centre - band, "REJECT").otherwise("DEFER")


def decide(candidates: DataFrame) -> DataFrame:
    """candidates (id, role, score, defers, floor_breach, padding_faults) with the verdict and the path to it.

    A candidate that may not be trained on stops the run, as does one that bears loss on padding. A deferred
    candidate is rejected once it was deferred MAX_DEFERS times; a rejected one of a lane below its floor is
    accepted, and marked.
    """
    bad = F.when(~F.coalesce(F.col("role") == "TRAIN", F.lit(False)), F.concat(F.lit("not admitted for training: "), F.col("id"))).when(F.col("padding_faults") > 0, F.concat(F.lit("loss on padding: "), F.col("id")))
    first = F.when(bad.isNotNull(), F.raise_error(bad)).otherwise(classify(F.col("score")))
    out = candidates.withColumn("rule", first).withColumn("defer_count", F.col("defers") + (F.col("rule") == "DEFER").cast("int"))
    late = (F.col("rule") == "DEFER") & (F.col("defer_count") > config.MAX_DEFERS)
    out = out.withColumn("rule", F.when(late, "REJECT").otherwise(F.col("rule")))
    lifted = (F.col("rule") == "REJECT") & F.col("floor_breach")
    trace = F.array(*[F.lit(x) for x in STEPS])
    return out.select("id", F.when(lifted, "ACCEPT").otherwise(F.col("rule")).alias("classification"), "score", "defer_count", lifted.alias("floor_override"), trace.alias("node_trace"))


def frontier(decided: DataFrame, budget: int) -> DataFrame:
    """Of decided (lane, queue_index, classification, ...), what one round goes through: a lane's first budget candidates up to and with its first deferred one."""
    w = Window.partitionBy("lane").orderBy("queue_index")
    stopped = F.coalesce(F.sum((F.col("classification") == "DEFER").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return decided.withColumn("r", F.row_number().over(w)).where(F.col("r") <= budget).withColumn("stopped", stopped).where("stopped = 0").drop("r", "stopped")


def weighted_order(scored: DataFrame, branch: str = "root", step: int = 0, temperature: float = config.TEMPERATURE) -> DataFrame:
    """scored (lane, idx, id, score) with rank: a weighted order without replacement, weight exp(score / temperature), by a keyed draw for each candidate."""
    k = H.key_hex(config.SEED, branch, step, ORDER_PURPOSE, F.col("id"))
    u = F.greatest(F.least(H.uniform_column(k, F.col("idx")), F.lit(1 - 1e-12)), F.lit(1e-12))
    key = F.pow(u, F.lit(1.0) / F.exp(F.col("score") / temperature))
    return scored.withColumn("key", key).withColumn("rank", F.row_number().over(Window.partitionBy("lane").orderBy(F.desc("key"), "idx"))).drop("key")


def rows_blockwise(queries: DataFrame, rows: DataFrame, k: int, block: int = 1024, chunk: int = 8192) -> DataFrame:
    """(query_id, id, score, rank): each query's k most similar rows by cosine, exactly, the query itself left out.

    queries and rows: (id bigint, v array). Queries go in blocks and rows in chunks of bounded size; each
    (block, chunk) is one matrix product that gives out k rows a query at most.
    """
    import numpy as np
    import pandas as pd

    n_blocks = max(1, -(-queries.count() // block))
    n_chunks = max(1, -(-rows.count() // chunk))
    q = queries.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("chunk"))
    r = rows.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})

        def unit(d):
            m = np.stack(d["v"].to_numpy()).astype(np.float64)
            size = np.linalg.norm(m, axis=1, keepdims=True)
            return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

        y = y.sort_values("id")
        scores, ids = unit(x) @ unit(y).T, y["id"].to_numpy()
        out = []
        for own, s in zip(x["id"], scores):
            s = np.where(ids == own, -np.inf, s)
            top = np.lexsort((ids, -s))[: k + 1]
            out += [(own, ids[j], s[j]) for j in top if ids[j] != own][:k]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    near = q.groupBy("block", "chunk").cogroup(r.groupBy("block", "chunk")).applyInPandas(best, "query_id bigint, id bigint, score double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)
