"""Queries over models: losses and scores of the fixture, parameter counts, sharding simulators, sweeps and timings."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .. import config
from ..functions import model as N
from ..functions.arrow import slices
from ..operators.selection import classify, cosine
from ..session import table, written
from .registry import query


def _losses(vocabulary: int, sketch: bool):
    def go(batches):
        model = N.initial(vocabulary)
        for b in (part for whole in batches for part in slices(whole)):
            sequences = ([x.values.to_numpy(zero_copy_only=k < 3) for k, x in enumerate(row)] for row in zip(*b.columns[1:]))  # a mask may hold nulls
            found = list(N.scored(model, sequences, config.SKETCH if sketch else 0))
            cols = [b.column(0), pa.array([n for _, n, _ in found], pa.int32()), pa.array([v for v, _, _ in found], pa.float64())]
            names = ["seq_id", "n", "loss"]
            if sketch:
                cols.append(pa.array([x for _, _, x in found], pa.list_(pa.float64())))
                names.append("sketch")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return go


def _vocabulary(spark, d) -> int:
    return max(config.VOCAB_SIZE, table(spark, d, "vocab", "token_id").agg(F.max("token_id")).collect()[0][0] + 1)  # one number


def _sequences(spark, d):
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, much work
    return table(spark, d, "packed", "seq_id", "input_ids", "position_ids", "attention_block_ids", "loss_mask").repartition(tasks, "seq_id").dropDuplicates(["seq_id"])


@query()
def model_losses(spark, d):
    """The mean loss of each packed sequence under the untrained model, and the tokens that bear it."""
    return _sequences(spark, d).mapInArrow(_losses(_vocabulary(spark, d), False), "seq_id string, n int, loss double").select("seq_id", "n", F.round("loss", 6).alias("loss"))


@query()
def candidate_scores(spark, d):
    """Each packed sequence's score: the cosine of its gradient's sketch with the mean sketch of the proxy sequences (those whose id's hash starts with 0), and the class that gives."""
    made = written(_sequences(spark, d).mapInArrow(_losses(_vocabulary(spark, d), True), "seq_id string, n int, loss double, sketch array<double>").select("seq_id", "sketch"), "sketches")  # read twice
    proxy = made.where(F.sha2("seq_id", 256).startswith("0")).select(F.posexplode("sketch").alias("k", "x")).groupBy("k").agg(F.avg("x").alias("x")).orderBy("k").collect()  # as long as a sketch
    direction = F.array(*[F.lit(r.x) for r in proxy]) if proxy else F.lit(None).cast("array<double>")
    score = cosine(F.col("sketch"), direction)
    return made.select("seq_id", F.round(score, 6).alias("score"), classify(score).alias("classification"))


@query("""WITH p AS (SELECT p_brand AS layer, CASE WHEN p_size % 2 = 0 THEN 'expert' ELSE 'shared' END AS kind, p_size::BIGINT * 1000 AS numel FROM part)
SELECT layer, sum(CASE kind WHEN 'expert' THEN 8 * numel ELSE numel END)::BIGINT AS total, sum(CASE kind WHEN 'expert' THEN 2 * numel ELSE numel END)::BIGINT AS active FROM p GROUP BY layer""")
def active_parameters(spark, d):
    """Parameters by layer with eight experts in place of each dense part, and those that a token with two experts goes through."""
    p = table(spark, d, "part", "p_brand", "p_size").select(F.col("p_brand").alias("layer"), (F.col("p_size") % 2 == 0).alias("expert"), (F.col("p_size").cast("bigint") * 1000).alias("numel"))
    times = lambda n: F.sum(F.when(F.col("expert"), n * F.col("numel")).otherwise(F.col("numel")))
    return p.groupBy("layer").agg(times(8).alias("total"), times(2).alias("active"))


@query("""WITH r AS (SELECT l_returnflag AS variant, 32 * l_linenumber AS batch, count(*) AS tries, round(sum(l_quantity) / count(*), 4) AS rate FROM lineitem GROUP BY ALL)
SELECT batch, max(rate) FILTER (variant = 'A') AS "A", max(rate) FILTER (variant = 'N') AS "N", max(rate) FILTER (variant = 'R') AS "R", sum(tries)::BIGINT AS tries FROM r GROUP BY batch""")
def throughput_sweep(spark, d):
    """A row a batch size with each variant's rate, and how many tries there were."""
    r = table(spark, d, "lineitem", "l_returnflag", "l_linenumber", "l_quantity").groupBy(F.col("l_returnflag").alias("variant"), (32 * F.col("l_linenumber")).alias("batch")).agg(F.count(F.lit(1)).alias("tries"), F.round(F.sum("l_quantity") / F.count(F.lit(1)), 4).alias("rate"))
    wide = r.groupBy("batch").pivot("variant", ["A", "N", "R"]).agg(F.max("rate"))
    return wide.join(r.groupBy("batch").agg(F.sum("tries").alias("tries")), "batch")


@query("""WITH t AS (SELECT l_suppkey AS gpu, round(100 + l_tax * 100)::BIGINT AS ms, l_quantity::BIGINT AS tokens FROM lineitem), g AS (SELECT gpu, sum(ms)::BIGINT AS ms, sum(tokens)::BIGINT AS tokens FROM t GROUP BY gpu)
SELECT min(ms) AS least, round(avg(ms), 6) AS mean, max(ms) AS most, sum(tokens)::BIGINT AS tokens, round(sum(tokens) * 1000.0::DOUBLE / max(ms), 6) AS rate, round(sum(ms) / max(ms)::DOUBLE, 6) AS speed_up FROM g""")
def parallel_latency(spark, d):
    """Latencies of devices that work side by side, their rate, and the speed-up over one after the other."""
    g = table(spark, d, "lineitem", "l_suppkey", "l_tax", "l_quantity").groupBy("l_suppkey").agg(F.sum(F.round(100 + F.col("l_tax") * 100).cast("bigint")).alias("ms"), F.sum(F.col("l_quantity").cast("bigint")).alias("tokens"))
    return g.agg(F.min("ms").alias("least"), F.round(F.avg("ms"), 6).alias("mean"), F.max("ms").alias("most"), F.sum("tokens").alias("tokens"), F.round(F.sum("tokens") * 1000.0 / F.max("ms"), 6).alias("rate"), F.round(F.sum("ms") / F.max("ms").cast("double"), 6).alias("speed_up"))


PEAK = 312e12


@query(f"""WITH t AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS step, value AS ms FROM events), a AS (SELECT run, avg(ms) FILTER (WHERE step >= 5) / 1000 AS dt FROM t GROUP BY run)
SELECT run, round(dt, 9) AS dt, round((6 * 831000::DOUBLE + 12 * 4 * 4 * 32 * 128) * 128 * 12 / dt / {PEAK!r}::DOUBLE, 9) AS utilisation FROM a WHERE dt > 0""")
def model_flops_utilisation(spark, d):
    """Seconds a step after the warm-up, and the model's arithmetic in them as a share of a device's peak: 6 operations a parameter and token, and 12 layers x heads x head width x length for attention."""
    from pyspark.sql import Window

    r = table(spark, d, "events", "event_id", "user_id", "value").withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1)
    a = r.groupBy(F.col("user_id").alias("run")).agg((F.avg(F.when(F.col("step") >= 5, F.col("value"))) / 1000).alias("dt")).where("dt > 0")
    flops = (6 * 831000.0 + 12 * 4 * 4 * 32 * 128) * 128 * 12
    return a.select("run", F.round("dt", 9).alias("dt"), F.round(F.lit(flops) / F.col("dt") / F.lit(PEAK), 9).alias("utilisation"))


@query("""SELECT s::INTEGER AS size, p::INTEGER AS length, round((1 - sqrt((256.0 - s) / (255.0 * s))) / (2 * sqrt(p::DOUBLE) * 8), 9) AS margin FROM (VALUES (24), (64), (128)) a(s), (VALUES (8), (16), (32)) b(p)""")
def decoding_margin(spark, d):
    """The change that decoding surely survives, at the best coherence a codebook can have and a spectrum between 1/8 and 1."""
    g = spark.createDataFrame([(s, p) for s in (24, 64, 128) for p in (8, 16, 32)], "size int, length int")
    mu = F.sqrt((256.0 - F.col("size")) / (255.0 * F.col("size")))
    return g.withColumn("margin", F.round((1 - mu) / (2 * F.sqrt("length") * 8), 9))


SHAPES = {"packed": ("input_ids", ("sequence", "token in the sequence")), "embeddings": ("embedding", ("vector", "coordinate")), "doc_tokens": ("tokens", ("document", "token in the document"))}


@query("""SELECT 'packed' AS name, 0 AS dim, count(*) AS size, 'sequence' AS meaning FROM packed UNION ALL SELECT 'packed', 1, max(len(input_ids)), 'token in the sequence' FROM packed UNION ALL SELECT 'embeddings', 0, count(*), 'vector' FROM embeddings UNION ALL SELECT 'embeddings', 1, max(len(embedding)), 'coordinate' FROM embeddings
UNION ALL SELECT 'doc_tokens', 0, count(*), 'document' FROM doc_tokens UNION ALL SELECT 'doc_tokens', 1, max(len(tokens)), 'token in the document' FROM doc_tokens""")
def named_shapes(spark, d):
    """Array columns described: the size of each dimension and what it counts."""
    out = None
    for name, (column, meanings) in SHAPES.items():
        df = table(spark, d, name, column)
        depth, kind = 1, df.schema[column].dataType
        while hasattr(kind, "elementType"):
            depth, kind = depth + 1, kind.elementType
        if len(meanings) != depth:
            raise ValueError(f"{name} has {depth} dimensions but {len(meanings)} meanings")
        own = df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(column)).cast("bigint").alias("m")).select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(k).alias("dim"), F.col(c).alias("size"), F.lit(meanings[k]).alias("meaning")) for k, c in enumerate(("n", "m"))])).alias("x")).select("x.*")
        out = own if out is None else out.unionByName(own)
    return out


@query("""WITH p AS (SELECT p_partkey AS id, p_size::BIGINT * 1000 + 7 AS n FROM part), g AS (SELECT * FROM p, (VALUES (0), (1), (2), (3)) s(stage), (VALUES (8), (32)) w(gpus)), c AS (SELECT *, (n + gpus - 1) // gpus AS cut FROM g)
SELECT stage, gpus, sum(CASE WHEN stage >= 3 THEN 2 * cut ELSE 2 * n END)::BIGINT AS parameters, sum(CASE WHEN stage >= 2 THEN 2 * cut ELSE 2 * n END)::BIGINT AS gradients, sum(CASE WHEN stage >= 1 THEN 12 * cut ELSE 12 * n END)::BIGINT AS optimizer,
round(sum(CASE stage WHEN 0 THEN 2 * 2 * n * (gpus - 1) / gpus::DOUBLE WHEN 3 THEN (2 + 2 * 2) * n * (gpus - 1) / gpus::DOUBLE ELSE (2 + 2) * n * (gpus - 1) / gpus::DOUBLE END), 3) AS traffic FROM c GROUP BY ALL""")
def sharded_steps(spark, d):
    """One step of data parallelism and its three sharded forms over a model's parameter tensors: bytes each device holds, with tensors cut to ceil(n / N), and bytes it sends."""
    p = table(spark, d, "part", "p_partkey", (F.col("p_size").cast("bigint") * 1000 + 7).alias("n"))
    grid = F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(g).alias("gpus")) for s in range(4) for g in (8, 32)]))
    c = p.select("n", grid.alias("x")).select("n", "x.*").withColumn("cut", F.ceil(F.col("n") / F.col("gpus")).cast("bigint"))
    held = lambda since, width: F.sum(F.when(F.col("stage") >= since, width * F.col("cut")).otherwise(width * F.col("n")))
    ring = F.col("n") * (F.col("gpus") - 1) / F.col("gpus").cast("double")  # a reduce-scatter or an all-gather; an all-reduce is both
    calls = F.when(F.col("stage") == 3, 3).otherwise(2)
    return c.groupBy("stage", "gpus").agg(held(3, 2).alias("parameters"), held(2, 2).alias("gradients"), held(1, 12).alias("optimizer"), F.round(F.sum(2 * calls * ring), 3).alias("traffic"))


@query("""WITH c AS (SELECT event_id % 32 AS rank, CASE event_type WHEN 'click' THEN 'all_reduce' WHEN 'view' THEN 'reduce_scatter' ELSE 'all_gather' END AS op, round(value)::BIGINT * 4 AS bytes FROM events)
SELECT op, count(*) AS calls, round(sum(CASE op WHEN 'all_reduce' THEN 2 ELSE 1 END * 31 / 32.0::DOUBLE * bytes), 3) AS moved FROM c GROUP BY op""")
def collective_totals(spark, d):
    """Recorded collective calls counted by their kind, with the bytes a ring of 32 moves for them."""
    op = F.when(F.col("event_type") == "click", "all_reduce").when(F.col("event_type") == "view", "reduce_scatter").otherwise("all_gather")
    c = table(spark, d, "events", "event_type", "value").select(op.alias("op"), (F.round("value").cast("bigint") * 4).alias("bytes"))
    return c.groupBy("op").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum(F.when(F.col("op") == "all_reduce", 2).otherwise(1) * 31 / 32.0 * F.col("bytes")), 3).alias("moved"))


@query("""SELECT vec_id % 32 AS task, round(sum(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 4) AS total FROM embeddings GROUP BY 1""")
def mapped_tasks(spark, d):
    """32 tasks over the vectors, side by side: each sums the squares of its own."""
    v = table(spark, d, "embeddings", (F.col("vec_id") % 32).alias("task"), "embedding").repartition(32, "task")

    def go(batches):
        for b in batches:
            squares = np.array([float(np.square(np.asarray(x, np.float64)).sum()) for x in b.column(1).to_pylist()])
            tasks, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(tasks), pa.array(np.bincount(at, squares, minlength=len(tasks)))], names=["task", "total"])

    return v.mapInArrow(go, "task bigint, total double").groupBy("task").agg(F.round(F.sum("total"), 4).alias("total"))


@query("""SELECT k::INTEGER AS k, round(pow(2.0::DOUBLE - 12 * pow(10.0::DOUBLE, -k), 3) - 8, 9) AS actual, round(-144 * pow(10.0::DOUBLE, -k), 9) AS predicted, round(abs(pow(2.0::DOUBLE - 12 * pow(10.0::DOUBLE, -k), 3) - 8 + 144 * pow(10.0::DOUBLE, -k)) / abs(pow(2.0::DOUBLE - 12 * pow(10.0::DOUBLE, -k), 3) - 8), 5) AS error FROM range(1, 6) t(k)""")
def taylor_sweep(spark, d):
    """A step down the gradient of x^3 at 2, over rates from 0.1 to 0.00001: what the loss does, what the first order says, and how far that is off."""
    rate = F.pow(F.lit(10.0), -F.col("id"))
    actual, said = F.pow(2.0 - 12 * rate, F.lit(3.0)) - 8, -144 * rate
    return spark.range(1, 6).select(F.col("id").cast("int").alias("k"), F.round(actual, 9).alias("actual"), F.round(said, 9).alias("predicted"), F.round(F.abs(actual - said) / F.abs(actual), 5).alias("error"))


@query("""WITH p AS (SELECT p_brand AS grp, CASE WHEN p_partkey % 10 = 0 THEN 'head' ELSE 'body' END AS kind, p_size::BIGINT AS n FROM part) SELECT grp, sum(n)::BIGINT AS untied, sum(CASE WHEN kind <> 'head' THEN n ELSE 0 END)::BIGINT AS tied FROM p GROUP BY grp""")
def tied_by_group(spark, d):
    """Parameters by group with and without a head of its own."""
    p = table(spark, d, "part", "p_partkey", "p_brand", "p_size")
    n = F.col("p_size").cast("bigint")
    return p.groupBy(F.col("p_brand").alias("grp")).agg(F.sum(n).alias("untied"), F.sum(F.when(F.col("p_partkey") % 10 != 0, n).otherwise(0)).alias("tied"))
