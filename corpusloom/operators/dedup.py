"""Exact and near duplicates, and the greedy choice of survivors.

Near pairs come from an exact prefix-filter join: shingles are ordered from rare to common, and two sets
with a similarity of at least t share one of their first n - ceil(t n) + 1 shingles. Survivors follow the
order of the ids: a document is set aside if it is similar to a smaller one that is kept; a document set
aside sets no other aside. Documents without a shingle are alike among themselves: the first is kept.
Null texts are no documents; null ids are left out.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrow import long_lists, slices
from ..functions.text import ShingleHasher
from ..session import written


def exact(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with content_hash and canonical_doc_id, the smallest id with the same bytes."""
    hashed = docs.where("doc_id is not null and text is not null").withColumn("content_hash", F.sha2("text", 256))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("canonical_doc_id"))
    return hashed.join(first, "content_hash")


def _sets(batches):
    hasher = ShingleHasher()
    for whole in batches:
        for b in slices(whole):
            sets = list(hasher.many(b.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), long_lists(sets)], names=["doc_id", "n", "shingles"])


def shingled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, shingles): 64-bit keys of each document's shingles."""
    return docs.select("doc_id", "text").mapInArrow(_sets, "doc_id string, n int, shingles array<bigint>")


def folded(sets: DataFrame) -> DataFrame:
    """(doc_id, rep) of the documents of sets: rep is the smallest id with the same set. A group of equal sets, however large, is one row of any later join."""
    keyed = sets.select("doc_id", F.struct(F.xxhash64("shingles"), F.xxhash64(F.lit(1), "shingles"), "n").alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("doc_id").alias("rep")), "key").select("doc_id", "rep")


def near_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, jaccard), a < b, of documents with similar non-empty sets. Equal sets are joined once and spread out at the end."""
    own = sets.where("n > 0")
    of = written(folded(own), "folded")
    reps = own.join(of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    near = written(distinct_pairs(reps, threshold), "near")
    x, y = of.select(F.col("rep").alias("a"), F.col("doc_id").alias("x")), of.select(F.col("rep").alias("b"), F.col("doc_id").alias("y"))
    across = near.join(x, "a").join(y, "b").select("x", "y", "jaccard")
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y", F.lit(1.0).alias("jaccard"))
    return across.unionByName(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")


def distinct_pairs(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """near_pairs() of sets that all differ and are not empty."""
    tokens = sets.select("doc_id", "n", F.explode("shingles").alias("s"))
    common = tokens.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # a shingle of one document meets none, yet counts in the order: those come first, so the others rank behind their number
    shared, w = tokens.join(common, "s"), Window.partitionBy("doc_id")
    rank = F.col("n") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("df", "s"))
    prefix = shared.withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1).select("doc_id", "n", "s")
    x, y = prefix.alias("x"), prefix.alias("y")
    near = (F.col("x.s") == F.col("y.s")) & (F.col("x.doc_id") < F.col("y.doc_id")) & (F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n"))
    pairs = x.join(y, near).select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct()
    left = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").withColumn("c", F.size(F.array_intersect("sa", "sb")))
    return both.withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).where(F.col("jaccard") >= threshold).select("a", "b", "jaccard")


def greedy(pairs: DataFrame) -> DataFrame:
    """(doc_id, matched, jaccard) of the documents set aside, given pairs (a, b, jaccard) with a < b.

    In rounds: undecided documents without an undecided or kept smaller neighbour are kept; those with a
    kept one are set aside. matched is the smallest kept neighbour. Every round decides the smallest
    undecided document of each component at least; tables are written between rounds.
    """
    pairs = written(pairs, "pairs")
    open_pairs, out = pairs, None
    while not open_pairs.isEmpty():
        blocked = open_pairs.select(F.col("b").alias("id")).distinct()
        kept = open_pairs.select(F.col("a").alias("id")).distinct().join(blocked, "id", "left_anti")
        aside = written(pairs.join(kept.withColumnRenamed("id", "a"), "a").groupBy("b").agg(F.min(F.struct("a", "jaccard")).alias("m")).select(F.col("b").alias("doc_id"), F.col("m.a").alias("matched"), F.col("m.jaccard").alias("jaccard")), "aside")
        out = aside if out is None else out.unionByName(aside)
        gone = aside.select(F.col("doc_id").alias("id"))
        rest = open_pairs.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti")
        open_pairs = written(rest, "open")
    if out is None:
        return pairs.select(F.col("b").alias("doc_id"), F.col("a").alias("matched"), "jaccard").limit(0)
    return out.groupBy("doc_id").agg(F.min(F.struct("matched", "jaccard")).alias("m")).select("doc_id", "m.matched", "m.jaccard")


def run(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """docs with status (survivor, exact_duplicate, quarantined), matched and jaccard."""
    known = exact(docs)
    unique = known.where("doc_id = canonical_doc_id").select("doc_id", "text")
    sets = written(shingled(unique), "sets")
    of = written(folded(sets.where("n > 0")), "folded")
    reps = sets.join(of.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi")
    # of equal sets the smallest id decides: if it is kept the others match it, if not they match what it matches
    first_aside = written(greedy(distinct_pairs(reps, threshold)), "aside")
    rest = of.where("doc_id <> rep").join(first_aside.select(F.col("doc_id").alias("rep"), "matched", "jaccard"), "rep", "left")
    aside = first_aside.unionByName(rest.select("doc_id", F.coalesce("matched", "rep").alias("matched"), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard")))
    empty = sets.where("n = 0").select("doc_id")
    first = empty.agg(F.min("doc_id")).collect()[0][0]  # one value
    blank = empty.where(F.col("doc_id") != first).select("doc_id", F.lit(first).alias("matched"), F.lit(1.0).alias("jaccard"))
    marked = known.join(aside.unionByName(blank), "doc_id", "left")
    status = F.when(F.col("doc_id") != F.col("canonical_doc_id"), "exact_duplicate").when(F.col("matched").isNotNull(), "quarantined").otherwise("survivor")
    return marked.withColumn("status", status).withColumn("matched", F.when(F.col("status") == "exact_duplicate", F.col("canonical_doc_id")).otherwise(F.col("matched"))).withColumn("jaccard", F.when(F.col("status") == "exact_duplicate", F.lit(1.0)).otherwise(F.col("jaccard")))
