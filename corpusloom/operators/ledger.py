"""Hash-chained ledgers: building, verifying, and the questions asked of them.

A chain is sequential within itself, so it is built one chain to a task; verification is parallel, as each
record needs only the hash before it. Payloads are canonical JSON text.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import GENESIS, sha256


def _record(index, kind, payload) -> str:
    """The canonical JSON of a record whose payload is canonical JSON."""
    return f'{{"index":{index},"payload":{payload},"record_type":{json.dumps(kind, ensure_ascii=False)}}}'


def build(records: DataFrame, last: DataFrame | None = None) -> DataFrame:
    """records (chain, index, record_type, payload) with prev_hash and chain_hash. Streams through each chain in order; nothing but the last hash is held. last (chain, chain_hash) says what a chain goes on from, where it has begun before."""
    own = records.select("chain", "index", "record_type", "payload")
    own = own.withColumn("begin", F.lit(GENESIS)) if last is None else own.join(last.select("chain", F.col("chain_hash").alias("begin")), "chain", "left").withColumn("begin", F.coalesce("begin", F.lit(GENESIS)))
    ordered = own.repartition("chain").sortWithinPartitions("chain", "index").select("chain", "index", "record_type", "payload", "begin")

    def fold(batches):
        chain, prev = None, GENESIS
        for b in batches:
            before, after = [], []
            for c, i, k, p, begin in b.itertuples(index=False):
                if c != chain:
                    chain, prev = c, begin
                before.append(prev)
                prev = sha256(f"{prev}|{_record(i, k, p)}")
                after.append(prev)
            yield b.drop(columns="begin").assign(prev_hash=before, chain_hash=after)

    return ordered.mapInPandas(fold, "chain string, index bigint, record_type string, payload string, prev_hash string, chain_hash string")


def appended(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """The rows to append to a ledger for new records (chain, record_type, payload, at): numbered on, in order of at, and chained to its last ones."""
    last = ledger.groupBy("chain").agg(F.max_by("chain_hash", "index").alias("chain_hash"), F.max("index").alias("last"))
    number = F.row_number().over(Window.partitionBy("chain").orderBy("at")).cast("bigint")
    rows = records.withColumn("n", number).join(last.select("chain", "last"), "chain", "left")
    return build(rows.select("chain", (F.coalesce("last", F.lit(-1)) + F.col("n")).cast("bigint").alias("index"), "record_type", "payload"), last)


def breaks(ledger: DataFrame) -> DataFrame:
    """(chain, index) of the records whose hash, or link to the record before, is not right. In parallel."""
    w = Window.partitionBy("chain").orderBy("index")
    before = F.coalesce(F.lag("chain_hash").over(w), F.lit(GENESIS))
    body = F.concat(F.lit('{"index":'), F.col("index").cast("string"), F.lit(',"payload":'), "payload", F.lit(',"record_type":"'), "record_type", F.lit('"}'))
    own = F.sha2(F.concat("before", F.lit("|"), body), 256)
    return ledger.withColumn("before", before).where((F.col("prev_hash") != F.col("before")) | (F.col("chain_hash") != own)).select("chain", "index")


def unmatched(intents: DataFrame, commits: DataFrame, upto: int | None = None) -> DataFrame:
    """The INTENT rows (chain, step, batch_id, index, ...) without a COMMIT of the same step and batch; upto reads the ledger as of an index, as a resume does."""
    if upto is not None:
        intents, commits = intents.where(F.col("index") <= upto), commits.where(F.col("index") <= upto)
    return intents.join(commits.select("chain", "step", "batch_id").distinct(), ["chain", "step", "batch_id"], "left_anti")


def last_committed(commits: DataFrame) -> DataFrame:
    """One row: the last committed step, -1 if there is none."""
    return commits.agg(F.coalesce(F.max("step"), F.lit(-1)).alias("last_step"))


def mismatches(original: DataFrame, replayed: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(step, reason): steps of (step, batch_hash, loss) that a replay misses, adds, or gives with another batch or loss."""
    both = original.select("step", F.col("batch_hash").alias("h"), F.col("loss").alias("l"), F.lit(True).alias("was")).join(replayed.select("step", F.col("batch_hash").alias("g"), F.col("loss").alias("m"), F.lit(True).alias("now")), "step", "full_outer")
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "extra").when(~F.col("h").eqNullSafe(F.col("g")), "batch").when(~F.coalesce(F.abs(F.col("l") - F.col("m")) <= tolerance, F.col("l").isNull() & F.col("m").isNull()), "loss")
    return both.withColumn("reason", reason).where("reason is not null").select("step", "reason")
