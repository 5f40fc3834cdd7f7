"""Draws as a stream: the scheduler's state per branch, and an append-only ledger without repeats.

A branch's state is the scheduler's snapshot, a few hundred bytes however long the branch is. Records that
come again (a retried batch) are dropped by their key within the watermark; the sink replaces a batch of the
stream by its number, so a retry writes the same files.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import config
from ..operators import mixture as M

OUT = "branch string, draw int, seq_id string, lane string, deficit double, below_floor boolean"


def _follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = M.State.loads(state.get[0]) if state.exists else M.start(len(config.STAGES) - 1)
    rows = []
    for pdf in sorted(batches, key=lambda p: p["draw"].min() if len(p) else 0):
        for r in pdf.sort_values("draw").itertuples(index=False):
            gap = M.lacks(now).get(r.lane, 0.0)
            now, _ = M.after(now, "drawn", r.lane, int(r.effective), int(r.total))
            rows.append((key[0], int(r.draw), r.seq_id, r.lane, gap, M.below_floor(now)))
    state.update((now.dumps(),))
    yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])


def follow(draws: DataFrame) -> DataFrame:
    """Each draw (branch, draw, seq_id, lane, effective, total) of a stream with its lane's deficit before it and the floor after it."""
    return draws.groupBy("branch").applyInPandasWithState(_follow, OUT, "snapshot string", "append", GroupStateTimeout.NoTimeout)


def once(records: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """A stream of ledger records (branch, step, batch_id, record_type, ts, ...) with repeats of a key dropped within the delay."""
    return records.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["branch", "step", "batch_id", "record_type"])


def append(stream: DataFrame, path: str, checkpoint: str) -> None:
    """What is there of the stream, to parquet, one folder for each batch of the stream; done again, a batch replaces itself."""

    def write(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """append(), then the table it left."""
    append(stream, path, checkpoint)
    return spark.read.parquet(path)
