"""Sources and sinks beyond Spark's own: corpora, token files, notebooks' logged records, records in JS text, marked blocks."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CORPUS = "doc_id string, tier string, type string, text string"
MAGIC, HEADER = 20240520, 1024


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines corpus with its fixed four fields; blank lines are passed over, a line that is no JSON fails."""
    return spark.read.schema(CORPUS).option("mode", "FAILFAST").json(path)


def ingest(docs: DataFrame, budgets: dict[tuple[str, str | None], int], prefix: str) -> DataFrame:
    """Documents of the (tier, type) groups with a budget: trimmed, empty ones dropped, ids prefixed, and the first so many of each group."""
    from pyspark.sql import Window

    rows = [(t, k or "", n) for (t, k), n in budgets.items()]
    plan = docs.sparkSession.createDataFrame(rows, "tier string, _type string, _budget int")
    own = docs.withColumn("text", F.trim("text")).where("text <> ''").withColumn("_type", F.coalesce("type", F.lit("")))
    own = own.join(F.broadcast(plan), ["tier", "_type"])
    r = F.row_number().over(Window.partitionBy("tier", "_type").orderBy("doc_id"))
    return own.withColumn("_r", r).where("_r <= _budget").withColumn("doc_id", F.concat(F.lit(prefix), "tier", F.lit(":"), F.when(F.col("_type") == "", "x").otherwise(F.col("_type")), F.lit("-"), "doc_id")).drop("_type", "_budget", "_r")


class _Blocks(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class _TokenReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.block = options["path"], int(options.get("block", "1024"))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.per = int(options.get("blocksPerPartition", "4096"))

    def partitions(self):
        files = sorted(os.path.join(self.path, f) for f in os.listdir(self.path) if f.endswith(".bin")) if os.path.isdir(self.path) else [self.path]
        out = []
        for f in files:
            n = token_count(f) if self.limit is None else min(self.limit, token_count(f))
            blocks = -(-n // self.block)
            out += [_Blocks(f, at, min(self.per, blocks - at)) for at in range(0, blocks, self.per)]
        return out or [_Blocks("", 0, 0)]

    def read(self, part):
        if not part.count:
            return
        n = token_count(part.path) if self.limit is None else min(self.limit, token_count(part.path))
        with open(part.path, "rb") as f:
            for k in range(part.first, part.first + part.count):
                f.seek(HEADER + 2 * k * self.block)
                data = f.read(2 * min(self.block, n - k * self.block))
                yield (os.path.basename(part.path), k, np.frombuffer(data, "<u2").astype(np.int32).tolist())


class TokenFiles(DataSource):
    """format("tokens"): token files with a header of 256 ints (magic, version, count) and 16-bit tokens from byte 1024, as blocks (file, block, tokens), read in parallel by ranges."""

    @classmethod
    def name(cls):
        return "tokens"

    def schema(self):
        return "file string, block bigint, tokens array<int>"

    def reader(self, schema):
        return _TokenReader(self.options)


def token_count(path: str) -> int:
    with open(path, "rb") as f:
        magic, _, n = struct.unpack("<3i", f.read(12))
    if magic != MAGIC:
        raise ValueError(f"{path} has no token header")
    if os.path.getsize(path) < HEADER + 2 * n:
        raise ValueError(f"{path} is shorter than its header says")
    return n


def write_token_file(path: str, tokens) -> None:
    head = np.zeros(256, "<i4")
    head[:3] = MAGIC, 1, len(tokens)
    with open(path, "wb") as f:
        f.write(head.tobytes() + np.asarray(tokens).astype("<u2").tobytes())


def logged(lines: DataFrame, prefix: str, schema: str) -> DataFrame:
    """The JSON records that logs (value) give out behind a prefix, as columns."""
    hit = lines.where(F.col("value").startswith(prefix))
    return hit.select(F.from_json(F.substring("value", len(prefix) + 1, 1 << 30), schema).alias("r")).select("r.*")


def tagged(df: DataFrame, prefix: str) -> DataFrame:
    """df as lines that logged() reads."""
    return df.select(F.concat(F.lit(prefix), F.to_json(F.struct("*"))).alias("value"))


def js_records(text: Column, fields: list[str]) -> Column:
    """An array of structs out of a JS array literal of flat objects: each field's quoted value, null where it is not there."""
    blocks = F.filter(F.split(text, r"\{"), lambda b: b.contains(":"))
    value = lambda b, f: F.nullif(F.regexp_extract(b, rf"""\b{f}\s*:\s*['"]([^'"]*)['"]""", 1), F.lit(""))
    return F.transform(blocks, lambda b: F.struct(*[value(b, f).alias(f) for f in fields]))


def urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"""(https?://[^\s"'<>)\]]+)"""), 1))


def replace_block(text: str, name: str, lines: list[str]) -> str:
    """A Markdown text with what stands between the markers of a block replaced."""
    start, end = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    a, b = text.index(start) + len(start), text.index(end)
    return text[:a] + "\n" + "\n".join(lines) + "\n" + text[b:]


def byte_cap(docs: DataFrame, most: int) -> DataFrame:
    """docs (doc_id, text) in order of the ids for as long as their bytes, summed, are at most most; with split: the first 99 % of the bytes kept train, the rest validation."""
    from ..operators.shards import offsets

    n = docs.select("doc_id", F.lit("").alias("lane"), F.octet_length("text").alias("n"))
    at = offsets(n).where(F.col("end_token") <= most)
    kept = at.agg(F.max("end_token")).collect()[0][0] or 0  # one number
    return docs.join(at.select("doc_id", "start_token", "end_token"), "doc_id").withColumn("split", F.when(F.col("end_token") <= kept * 0.99, "train").otherwise("validation"))


def save_state(path: str, state: dict) -> str:
    """A JSON state with its own hash, written whole or not at all; the hash."""
    from ..functions.hashing import object_hash

    h = object_hash(state)
    tmp = f"{path}.{os.getpid()}"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump({"state": state, "hash": h}, f, ensure_ascii=False, sort_keys=True)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)
    return h


def load_state(path: str, defaults: dict | None = None) -> dict:
    from ..functions.hashing import object_hash

    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    if object_hash(kept["state"]) != kept["hash"]:
        raise ValueError(f"{path} is not what was written")
    return {**(defaults or {}), **kept["state"]}




def looked_up(ids: DataFrame, raw: str, reference: DataFrame, order: str, per: int = 25) -> DataFrame:
    """ids with what a reference (id, ...) says of them, a version (v and digits) at an id's end left off, null where it knows none; request numbers the batches of per different ids, in order."""
    from ..operators.shards import offsets

    once = ids.select(F.col(order).alias("doc_id")).distinct().withColumn("lane", F.lit("")).withColumn("n", F.lit(1))
    at = offsets(once).select(F.col("doc_id").alias(order), F.floor(F.col("start_token") / per).alias("request"))
    return ids.withColumn("id", F.regexp_replace(raw, r"v\d+$", "")).join(reference, "id", "left").join(at, order)
