"""Records that stand, exactly or almost, on both sides of a split.

Each distinct shingle set gets a similarity-hash fingerprint of BITS bits: bit i is one bit of the
set's i-th min-wise hash, so two sets of Jaccard similarity J differ in each bit with a chance of
(1 - J) / 2, and their Hamming distance tells J. The bits are permuted again and again and cut into
blocks; the sides are joined on equal blocks, candidates outside the Hamming radius fall away, and
the exact similarity of the sets decides. The block length follows the logarithm of the number of
sets, so that chance meetings stay in proportion to the input; the number of blocks follows from the
length and a target recall of independent blocks; block_plan states what that gives.

Roles: upper-cased and trimmed; null and blank ones are passed over. Of role_assignment, a document's
row with the latest assigned_at among those with a role holds (on a tie, the greater role). A document
can stand on both sides and then pairs with documents of either; never with itself.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import flat_lists, long_lists, slices
from ..functions.text import mix64, seeds64
from ..session import written
from .features import Classes, classes, verified

BITS = 512
TARGET = 0.99999
TRAIN, HELD_OUT = ("TRAIN",), ("VALIDATION", "EVAL")
_U = np.uint64
_FACTORS = seeds64(BITS, 0xB175)


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """The bits (0 or 1) of a set of 64-bit keys. Taken through in pieces, so a very long set needs no more memory."""
    x = mix64(shingles)
    lo, factor, shift = (x >> _U(32)).astype(np.uint32), (_FACTORS >> _U(32)).astype(np.uint32) | np.uint32(1), _FACTORS.astype(np.uint32)
    least = np.full(BITS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(lo), 256):
        least = np.minimum(least, (lo[at : at + 256, None] * factor + shift).min(axis=0))
    return (mix64(least.astype(_U) ^ _FACTORS) & _U(1)).astype(np.uint8)


def _prints(batches):
    for whole in batches:
        for b in slices(whole):
            values, ends = flat_lists(b.column(1))
            values = values.view(_U)
            bits = [np.packbits(fingerprint(values[ends[k] : ends[k + 1]])).view(_U) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), long_lists(bits)], names=["set_key", "bits"])


def block_plan(sets: int, threshold: float, target: float = TARGET) -> tuple[int, int]:
    """(bits in a block, blocks): a pair at the threshold would share a block with the target chance, were blocks independent.

    They come from the same BITS bits, whose distance varies: averaged over it, recall at similarity 0.8 is 0.99986 for 9,000 sets,
    0.99976 for 90,000, 0.99959 for 1,000,000 and 0.99865 for 100,000,000. Unlike sets meet in a block about once for each set or less."""
    length = max(12, math.ceil(math.log2(max(2, sets))) + 1)
    alike = ((1 + threshold) / 2) ** length
    return length, math.ceil(math.log(1 - target) / math.log(1 - alike))


def radius(threshold: float, spread: float = 5.0) -> int:
    """The Hamming distance that a pair at the threshold stays under: the mean and spread standard deviations."""
    p = (1 - threshold) / 2
    return math.ceil(BITS * p + spread * math.sqrt(BITS * p * (1 - p)))


def _blocks(length: int, number: int):
    order, draw = [], np.random.Generator(np.random.PCG64(20_17))
    while len(order) < number:
        bits = draw.permutation(BITS)
        order += [bits[at : at + length] for at in range(0, BITS - length + 1, length)]
    order = order[:number]

    def go(batches):
        weights = _U(1) << np.arange(length, dtype=_U)
        for whole in batches:
            for b in slices(whole, 4000):
                bits = np.unpackbits(flat_lists(b.column(1))[0].view(np.uint8).reshape(b.num_rows, -1), axis=1).astype(_U)
                for t, at in enumerate(order):
                    key = (_U(t) << _U(length)) + bits[:, at] @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0), b.column(2), b.column(3)], names=["block", "set_key", "train", "held_out"])

    return go


def distance(a: str, b: str) -> Column:
    """The Hamming distance of two fingerprints (arrays of 64-bit words)."""
    total = F.lit(0)
    for k in range(BITS // 64):
        total = total + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    return total


def roles(role_assignment: DataFrame, manifest: DataFrame) -> DataFrame:
    """(doc_id, role): the splits each document is in, by its valid assignment and by the shards whose offsets hold it."""
    clean = F.upper(F.trim(F.regexp_replace("role", r"\s+", " ")))
    own = role_assignment.select("doc_id", "assigned_at", clean.alias("role")).where("doc_id is not null and role <> ''")
    last = own.groupBy("doc_id").agg(F.max(F.struct("assigned_at", "role")).getField("role").alias("role"))
    sharded = manifest.select(clean.alias("role"), F.explode(F.map_keys("offsets")).alias("doc_id")).where("role <> ''")
    return last.unionByName(sharded).distinct()


def sides(role_table: DataFrame) -> DataFrame:
    """(doc_id, train, held_out): the documents on either side."""
    of = lambda names: F.max(F.col("role").isin(*names))
    return role_table.groupBy("doc_id").agg(of(TRAIN).alias("train"), of(HELD_OUT).alias("held_out")).where("train or held_out")


def similar_across(c: Classes, members: DataFrame, threshold: float = 0.8, target: float = TARGET) -> DataFrame:
    """Pairs (a, b, jaccard) of different sets, one with a TRAIN document and the other with a held-out one.

    members: (doc_id, text_key, set_key, train, held_out).
    """
    side = members.groupBy("set_key").agg(F.max("train").alias("train"), F.max("held_out").alias("held_out"))
    prints = written(c.sets.select("set_key", "shingles").mapInArrow(_prints, "set_key bigint, bits array<bigint>").join(side, "set_key"), "prints")
    length, number = block_plan(prints.count(), threshold, target)
    blocks = prints.select("set_key", "bits", "train", "held_out").mapInArrow(_blocks(length, number), "block bigint, set_key bigint, train boolean, held_out boolean")
    blocks = written(blocks, "blocks")
    x = blocks.where("train").select("block", F.col("set_key").alias("x"))
    y = blocks.where("held_out").select("block", F.col("set_key").alias("y"))
    met = x.join(y, "block").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    bits = prints.select("set_key", "bits")
    near = (
        met.join(bits.select(F.col("set_key").alias("a"), F.col("bits").alias("p")), "a")
        .join(bits.select(F.col("set_key").alias("b"), F.col("bits").alias("q")), "b")
        .where(distance("p", "q") <= radius(threshold))
        .select("a", "b")
    )
    return verified(near, c.sets, threshold)


def _both_sides(threshold, corpus, role_assignment, manifest, **options):
    c = classes(corpus)
    members = written(c.members.join(sides(roles(role_assignment, manifest)), "doc_id"), "sides")
    links = written(similar_across(c, members, threshold, **options), "links")
    one_set = members.select(F.col("set_key").alias("a"), F.col("set_key").alias("b"), F.lit(1.0).alias("jaccard")).distinct()
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "jaccard")).union(one_set)
    return members, both


def overlaps(corpus: DataFrame, role_assignment: DataFrame, manifest: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard): every pair of different documents, one in TRAIN and the other held out, with equal or similar sets."""
    members, links = _both_sides(threshold, corpus, role_assignment, manifest, **options)
    x = members.where("train").select(F.col("doc_id").alias("x"), F.col("set_key").alias("a"))
    y = members.where("held_out").select(F.col("doc_id").alias("y"), F.col("set_key").alias("b"))
    pairs = links.join(x, "a").join(y, "b").where("x <> y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard").dropDuplicates(["doc_id_a", "doc_id_b"])


def report(corpus: DataFrame, role_assignment: DataFrame, manifest: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """(role, source, documents, exact, near): of each held-out split and source (trimmed, lower case; '' if null), how many documents there are with a set, and how many have a byte-identical, or only a similar, text in TRAIN under another id.

    Counted from sets to sets, without forming the pairs of documents.
    """
    members, links = _both_sides(threshold, corpus, role_assignment, manifest, **options)
    per_set = members.where("train").groupBy("set_key").agg(F.countDistinct("doc_id").alias("k"))
    per_text = members.where("train").groupBy("text_key").agg(F.countDistinct("doc_id").alias("same"))
    reach = links.join(per_set.select(F.col("set_key").alias("a"), "k"), "a").groupBy(F.col("b").alias("set_key")).agg(F.sum("k").alias("k"))
    held = members.where("held_out").select("doc_id", "text_key", "set_key", F.col("train").cast("int").alias("self")).dropDuplicates(["doc_id"])
    counted = (
        held.join(reach, "set_key", "left")
        .join(per_text, "text_key", "left")
        .select("doc_id", (F.coalesce("same", F.lit(0)) - F.col("self") > 0).alias("exact"), (F.coalesce("k", F.lit(0)) - F.col("self") > 0).alias("any"))
    )
    source = corpus.groupBy("doc_id").agg(F.coalesce(F.min(F.lower(F.trim("source"))), F.lit("")).alias("source"))
    split = roles(role_assignment, manifest).where(F.col("role").isin(*HELD_OUT))
    return (
        counted.join(split, "doc_id")
        .join(source, "doc_id")
        .groupBy("role", "source")
        .agg(F.count(F.lit(1)).alias("documents"), F.count_if("exact").alias("exact"), F.count_if(F.col("any") & ~F.col("exact")).alias("near"))
    )
