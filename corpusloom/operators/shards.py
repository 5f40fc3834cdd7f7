"""Token shards: offsets, binary form, manifests and their hash chain.

A manifest's own hash covers all its fields but that hash, as canonical JSON. The chain goes through the
manifests in order of their shard ids; there is one manifest for up to 64,000 tokens, so a chain is short
against the tokens it stands for. Verification is parallel: each record needs only its predecessor's hash.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import GENESIS, link, object_hash
from ..session import written

MANIFEST = "shard_id string, lane string, role string, tokenizer_hash string, content_hash string, doc_count bigint, token_count bigint, offsets map<string,array<bigint>>, created_at string, parent_manifest_hash string, manifest_hash string"
FIELDS = ("shard_id", "lane", "role", "tokenizer_hash", "content_hash", "doc_count", "token_count", "offsets", "created_at", "parent_manifest_hash")


def offsets(t: DataFrame) -> DataFrame:
    """(lane, doc_id, start_token, end_token) of docs (doc_id, lane, n) laid end to end in order of the ids, lane by lane.

    A prefix sum in two steps: rows are range-partitioned by (lane, doc_id), summed within each range, and
    the totals of the ranges before (one row a range and lane) are added. No lane falls to one task.
    """
    ranged = written(t.select("lane", "doc_id", "n").repartitionByRange(F.coalesce("lane", F.lit("")), "doc_id").withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("lane", "part").agg(F.sum("n").alias("total"))
    before = totals.withColumn("before", F.sum("total").over(Window.partitionBy("lane").orderBy("part")) - F.col("total"))
    w = Window.partitionBy("lane", "part").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("upto", F.sum("n").over(w)).alias("o").join(before.alias("b"), F.col("o.lane").eqNullSafe(F.col("b.lane")) & (F.col("o.part") == F.col("b.part")))
    end = F.col("upto") + F.col("before")
    return own.select("o.lane", "doc_id", (end - F.col("n")).alias("start_token"), end.alias("end_token"))


def ordered_digest(rows: DataFrame) -> DataFrame:
    """One row, train_manifest: a hash over (doc_id, content_hash) in order. Ids go to 65,536 buckets by their hash; each bucket, then the list of bucket hashes, is hashed in order."""
    each = rows.groupBy(F.substring(F.sha2("doc_id", 256), 1, 4).alias("bucket")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "content_hash"))), lambda x: F.concat(x.doc_id, F.lit(":"), x.content_hash)), ","), 256).alias("h")
    )
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda x: x.h), ","), 256).alias("train_manifest"))


def _self_hash(shard_id, lane, role, tokenizer_hash, content_hash, doc_count, token_count, keys, spans, created_at, parent):
    m = dict(zip(FIELDS, (shard_id, lane, role, tokenizer_hash, content_hash, doc_count, token_count, {k: [int(x) for x in v] for k, v in zip(keys or [], spans or [])}, created_at, parent)))
    return object_hash(m)


def with_self_hash(manifests: DataFrame) -> DataFrame:
    """manifests, each shard once, with computed_hash."""
    own = F.udf(_self_hash, "string", useArrow=True)("shard_id", "lane", "role", "tokenizer_hash", "content_hash", "doc_count", "token_count", F.map_keys("offsets"), F.map_values("offsets"), "created_at", "parent_manifest_hash")
    return manifests.dropDuplicates(["shard_id"]).withColumn("computed_hash", own)


def manifest_checks(manifests: DataFrame) -> DataFrame:
    """(shard_id, self_ok, parent_known): whether a manifest has its own hash, and whether its parent is a manifest here or the start."""
    m = with_self_hash(manifests)
    known = m.select(F.col("manifest_hash").alias("parent_manifest_hash"), F.lit(True).alias("k")).dropDuplicates(["parent_manifest_hash"])
    return m.join(known, "parent_manifest_hash", "left").select("shard_id", (F.col("computed_hash") == F.col("manifest_hash")).alias("self_ok"), (F.coalesce("k", F.lit(False)) | (F.col("parent_manifest_hash") == GENESIS)).alias("parent_known"))


def contiguous(manifests: DataFrame) -> DataFrame:
    """(shard_id, docs_ok, tokens_ok, contiguous): whether counts and offsets of each manifest agree."""
    spans = manifests.dropDuplicates(["shard_id"]).select("shard_id", "doc_count", "token_count", F.explode(F.map_values("offsets")).alias("x")).select("shard_id", "doc_count", "token_count", F.col("x")[0].alias("s"), F.col("x")[1].alias("t"))
    before = F.lag("t", 1, 0).over(Window.partitionBy("shard_id").orderBy("s"))
    return spans.withColumn("p", before).groupBy("shard_id").agg((F.count(F.lit(1)) == F.max("doc_count")).alias("docs_ok"), (F.max("t") == F.max("token_count")).alias("tokens_ok"), F.bool_and(F.col("s") == F.col("p")).alias("contiguous"))


def chain_root(manifests: DataFrame) -> DataFrame:
    """One row, root_hash: the chain through all manifests in order of their ids. Sequential by nature: two hashes a shard go through one task."""
    own = manifests.select("shard_id", "manifest_hash").dropDuplicates(["shard_id"]).repartitionByRange("shard_id").sortWithinPartitions("shard_id").coalesce(1)

    def fold(batches):
        prev = GENESIS
        for b in batches:
            for s, h in zip(b["shard_id"], b["manifest_hash"]):
                prev = link(prev, {"shard_id": s, "manifest_hash": h})
        yield pd.DataFrame({"root_hash": [prev]})

    return own.sortWithinPartitions("shard_id").mapInPandas(fold, "root_hash string")


@F.pandas_udf(T.BinaryType())
def to_uint16(tokens: pd.Series) -> pd.Series:
    """Tokens as little-endian 16-bit words; an id outside of them is an error."""

    def one(t):
        if t is None:
            return None
        a = np.asarray(t, np.int64)
        if len(a) and not (0 <= a.min() and a.max() < 65536):
            raise ValueError("a token id that 16 bits do not hold")
        return a.astype("<u2").tobytes()

    return tokens.map(one)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def from_uint16(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else np.frombuffer(b, "<u2").astype(np.int32))


def write_shards(docs: DataFrame, out_dir: str, tokenizer_hash: str, role: str = "TRAIN", max_tokens: int = 64_000) -> DataFrame:
    """docs (doc_id, lane, tokens) as <shard>.bin and <shard>.json under a shared folder; the manifests, without parents linked.

    A shard holds the documents of one lane that start in a stretch of max_tokens of it (a document stays whole). Each shard is written
    by one task, to a name of its own first and then renamed, so a repeated task leaves one whole file.
    """
    n = docs.select("doc_id", "lane", F.size("tokens").alias("n"))
    placed = offsets(n).withColumn("part", F.floor(F.col("start_token") / F.lit(max_tokens)))
    own = docs.select("doc_id", "tokens").join(placed, "doc_id")

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lane, part = key
        pdf = pdf.sort_values("doc_id")
        shard = f"shard-{role}-{lane}-{part:06d}"
        first = int(pdf["start_token"].min()) if len(pdf) else 0
        data = np.concatenate([np.asarray(t, np.int64) for t in pdf["tokens"]]).astype("<u2").tobytes()
        m = dict(zip(FIELDS, (shard, lane, role, tokenizer_hash, hashlib.sha256(data).hexdigest(), len(pdf), len(data) // 2, {d: [int(s) - first, int(e) - first] for d, s, e in zip(pdf["doc_id"], pdf["start_token"], pdf["end_token"])}, "frozen", GENESIS)))
        m["manifest_hash"] = object_hash(m)
        os.makedirs(out_dir, exist_ok=True)
        for name, body in ((f"{shard}.bin", data), (f"{shard}.json", json.dumps(m, ensure_ascii=False, indent=2, sort_keys=True).encode())):
            tmp = os.path.join(out_dir, f".{name}.{os.getpid()}")
            with open(tmp, "wb") as f:
                f.write(body)
            os.replace(tmp, os.path.join(out_dir, name))
        return pd.DataFrame([[m[k] for k in (*FIELDS, "manifest_hash")]], columns=[*FIELDS, "manifest_hash"])

    return own.groupBy("lane", "part").applyInPandas(one, MANIFEST)


def linked(manifests: DataFrame, order: list) -> DataFrame:
    """manifests with each one's parent the one before it in order (columns of manifests), the first one's the start, and their own hashes made anew. Sequential by nature: a hash a shard goes through one task."""
    rows = manifests.repartitionByRange(*order).sortWithinPartitions(*order).coalesce(1).sortWithinPartitions(*order).select(*FIELDS)

    def fold(batches):
        prev = GENESIS
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                r["offsets"] = {k: [int(x) for x in v] for k, v in dict(r["offsets"]).items()}
                r = {k: int(v) if k in ("doc_count", "token_count") else v for k, v in r.items()} | {"parent_manifest_hash": prev}
                prev = object_hash(r)
                out.append([*(r[k] for k in FIELDS), prev])
            yield pd.DataFrame(out, columns=[*FIELDS, "manifest_hash"])

    return rows.mapInPandas(fold, MANIFEST)


def write_manifests(manifests: DataFrame, out_dir: str) -> DataFrame:
    """Writes each manifest's JSON beside its shard; (shard_id) of those written. In parallel, each file whole or not at all."""

    def write(batches):
        for b in batches:
            for r in b.to_dict("records"):
                m = {k: {d: [int(x) for x in v] for d, v in dict(r[k]).items()} if k == "offsets" else r[k] for k in (*FIELDS, "manifest_hash")}
                tmp = os.path.join(out_dir, f".{r['shard_id']}.json.{os.getpid()}")
                with open(tmp, "w", encoding="utf-8") as f:
                    json.dump(m, f, ensure_ascii=False, indent=2, sort_keys=True)
                os.replace(tmp, os.path.join(out_dir, f"{r['shard_id']}.json"))
            yield b[["shard_id"]]

    return manifests.repartition("shard_id").mapInPandas(write, "shard_id string")


def ids_digest(rows: DataFrame) -> DataFrame:
    """One row, digest: the hash of the canonical JSON of {content_hashes, doc_ids} in order of the ids, as one text of any length. Streams through one task, a few bytes a document. No row for no documents."""
    ordered = lambda c: rows.select(F.col(c).alias("x"), "doc_id").repartitionByRange("doc_id").sortWithinPartitions("doc_id").coalesce(1).sortWithinPartitions("doc_id").select("x", F.lit(c).alias("c"))

    def fold(batches):
        h, now = hashlib.sha256(b'{"content_hashes":['), "content_hash"
        first = True
        for b in batches:
            for x, c in zip(b["x"], b["c"]):
                if c != now:
                    h.update(b'],"doc_ids":[')
                    now, first = c, True
                h.update((b"" if first else b",") + json.dumps(x, ensure_ascii=False).encode())
                first = False
        if now == "content_hash":
            h.update(b'],"doc_ids":[')
        h.update(b"]}")
        yield pd.DataFrame({"digest": [h.hexdigest()]})

    return ordered("content_hash").union(ordered("doc_id")).coalesce(1).mapInPandas(fold, "digest string")


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """(shard_id, lane, role, doc_id, tokens) of a folder of shards; a read fails where bytes or manifest do not have their hashes."""
    raw = spark.read.format("binaryFile").load(f"{out_dir}/*.bin").select(F.regexp_extract("path", r"([^/]+)\.bin$", 1).alias("shard_id"), "content")
    texts = spark.read.text(f"{out_dir}/*.json", wholetext=True)

    @F.udf("struct<shard_id:string,lane:string,role:string,content_hash:string,ok:boolean,offsets:map<string,array<bigint>>>", useArrow=True)
    def parsed(text):
        m = json.loads(text)
        own = m.pop("manifest_hash")
        return {"shard_id": m["shard_id"], "lane": m["lane"], "role": m["role"], "content_hash": m["content_hash"], "ok": object_hash(m) == own, "offsets": m["offsets"]}

    m = texts.select(parsed("value").alias("m")).select("m.*")
    both = raw.join(m, "shard_id")
    bad = F.when(~F.col("ok"), F.lit("manifest")).when(F.sha2("content", 256) != F.col("content_hash"), F.lit("content"))
    both = both.withColumn("content", F.when(bad.isNull(), F.col("content")).otherwise(F.raise_error(F.concat(bad, F.lit(" hash mismatch in "), F.col("shard_id")))))
    one = both.select("shard_id", "lane", "role", "content", F.explode("offsets").alias("doc_id", "span"))
    start, end = F.col("span")[0].cast("int"), F.col("span")[1].cast("int")
    return one.select("shard_id", "lane", "role", "doc_id", from_uint16(F.substring("content", start * 2 + 1, (end - start) * 2)).alias("tokens"))
