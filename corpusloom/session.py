"""Sessions, table loading and the shared folder for tables written between stages."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, SparkSession] = {}


def session(cores: int | str = "*", shuffle: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster, take the session spark-submit gives."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("corpusloom")
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A parquet table of a data directory, with only the columns named (all, if none is)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, whose executors are this machine, may leave it unset and gets a temporary one."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("corpusloom.scratch", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, at, True)
        spark.conf.set("corpusloom.scratch", at)
    return at


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new folder name among the intermediate tables, dropped with them."""
    path = os.path.join(shared_dir(spark), "corpusloom", f"{what}-{uuid.uuid4().hex}")
    _scratch[path] = spark
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a parquet table in the shared folder: cuts the lineage, survives lost executors, and later reads prune columns."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates():
    """Drops the tables written inside the block when it ends: with a long session, use the results of a query inside one."""
    before = set(_scratch)
    try:
        yield
    finally:
        drop_scratch(set(_scratch) - before)


def drop_scratch(paths: set[str] | None = None) -> None:
    """Drops the intermediate tables (all, unless some are named); results that still read them are lost."""
    for path in list(_scratch if paths is None else paths):
        spark = _scratch.pop(path)
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before
            return


atexit.register(drop_scratch)
