"""The corpus pipeline as one thing: duplicates, roles, tokenizer, shards, packed sequences, manifests.

The order is a guarantee: duplicates go before roles are given, roles before the tokenizer sees a text, and the
tokenizer sees TRAIN alone; each stage is a written table, so no later filter can reach before it. Quarantined
documents have a role of their own. EVAL is sealed: it has a manifest, and no tokens.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.hashing import object_hash
from ..session import scratch_path, written
from . import dedup, packing, roles, shards
from . import tokenizer as TK

#: The order of the chain: TRAIN by lane, then the roles that are packed whole, then the sealed one.
SHARDED = ("TRAIN", "PROXY", "VALIDATION")


@dataclass(frozen=True)
class Corpus:
    """docs: (doc_id, lane, role, status, text, content_hash). tokens: (doc_id, role, lane, tokens). manifests: linked, with the sealed one. packed: TRAIN through the gate. held: PROXY and VALIDATION."""

    docs: DataFrame
    tokenizer: TK.Tokenizer
    tokens: DataFrame
    manifests: DataFrame
    packed: DataFrame
    held: DataFrame
    folder: str


def build(docs: DataFrame, folder: str | None = None) -> Corpus:
    """The corpus of docs (doc_id, tier, type, text); rows with a null id or text are left out, an empty table gives empty ones and a tokenizer without merges. folder, shared by the executors, takes the shards; one among the intermediate tables unless given."""
    spark = docs.sparkSession
    known = written(dedup.run(docs), "known")
    kept = known.where("status <> 'exact_duplicate'")
    given = roles.assign(kept, known.where("status = 'quarantined'")).select("doc_id", roles.lane().alias("lane"), "role", "status", "text", "content_hash")
    given = written(given, "roles")
    train = roles.admitted(given.where("role = 'TRAIN'"), "training")
    digest = shards.ids_digest(train.select("doc_id", "content_hash")).collect()  # one row, or none for no documents
    tokenizer = TK.train(train.select("text"), train_manifest_hash=digest[0].digest if digest else object_hash({"content_hashes": [], "doc_ids": []}))
    frozen = tokenizer.freeze_hash()
    lane = F.when(F.col("role") == "TRAIN", F.col("lane")).otherwise(F.lower("role"))
    tokens = written(given.where(F.col("role").isin(*SHARDED)).select("doc_id", "role", lane.alias("lane"), tokenizer.encode_column("text").alias("tokens")).where("lane is not null"), "tokens")
    folder = (folder or scratch_path(spark, "corpus")).removeprefix("file://")
    parts = [shards.write_shards(tokens.where(F.col("role") == r), folder, frozen, r) for r in SHARDED]
    made = written(parts[0].unionByName(parts[1]).unionByName(parts[2]), "shards")
    held_out = given.where("role = 'EVAL'").select("doc_id", "content_hash")
    number = held_out.count()
    sealed = shards.ids_digest(held_out).where(F.lit(number > 0)).select(
        F.lit("shard-EVAL-sealed").alias("shard_id"), F.lit("eval").alias("lane"), F.lit("EVAL").alias("role"), F.lit(frozen).alias("tokenizer_hash"), F.col("digest").alias("content_hash"), F.lit(number).cast("bigint").alias("doc_count"),
        F.lit(0).cast("bigint").alias("token_count"), F.expr("cast(map() as map<string,array<bigint>>)").alias("offsets"), F.lit("frozen").alias("created_at"), F.lit("").alias("parent_manifest_hash"), F.lit("").alias("manifest_hash"),
    )
    place = F.array_position(F.array(*[F.lit(r) for r in (*SHARDED, "EVAL")]), F.col("role"))
    lanes = F.array_position(F.array(*[F.lit(n) for n, _, _ in config.LANES]), F.col("lane"))
    manifests = written(shards.linked(made.unionByName(sealed), [place, lanes, F.col("shard_id")]), "manifests")
    shards.write_manifests(manifests, folder).write.format("noop").mode("overwrite").save()
    packed = packing.pack(roles.admitted(tokens.where("role = 'TRAIN'"), "training").select("doc_id", "lane", "tokens"))
    held = packing.pack(tokens.where("role <> 'TRAIN'").select("doc_id", "lane", "tokens"), policies={}, cap=False)
    return Corpus(given, tokenizer, tokens, manifests, packed, held, folder)
