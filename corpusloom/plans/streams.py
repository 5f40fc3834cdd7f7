"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import scratch_path, written
from ..streaming import draws as D
from .registry import query
from .selection import _DRAWS, _W, draws

_SHARE = {k: v / sum(_W.values()) for k, v in _W.items()}
_OWN = "coalesce(sum(effective) OVER (PARTITION BY branch, lane ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_ALL = "coalesce(sum(effective) OVER (PARTITION BY branch ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"


@query(f"""WITH {_DRAWS} SELECT branch, draw::INTEGER AS draw, lane, round(CASE lane {' '.join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in _SHARE.items())} END * {_ALL} - {_OWN}, 5) AS deficit FROM draws""")
def streamed_deficits(spark, d):
    """The draws as a stream, followed branch by branch with state."""
    source = written(draws(spark, d), "draws")
    base = scratch_path(spark, "stream")
    stream = spark.readStream.schema(source.schema).parquet(source.inputFiles()[0].rsplit("/", 1)[0])
    out = D.drain(spark, D.follow(stream), f"{base}/out", f"{base}/state")
    return out.select("branch", "draw", "lane", F.round("deficit", 5).alias("deficit"))
