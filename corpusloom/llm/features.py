"""The shingle sets of a corpus, once per document and once per distinct set.

Nulls: a null or empty text, or one of stop words and marks only, has the empty set; such documents
belong to no class and take part in no similarity join. A document delivered twice with the same
text counts once; delivered with two texts, it counts with each. Extra columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import long_lists, slices
from ..functions.text import ShingleHasher, bytes_id
from ..session import written


@dataclass(frozen=True)
class Classes:
    """members: (doc_id, text_key, set_key), one row per document with a set. sets: (set_key, n, shingles), one per distinct set."""

    members: DataFrame
    sets: DataFrame


def _hash_texts(batches):
    hasher = ShingleHasher()
    for whole in batches:
        for b in slices(whole):
            ids, texts = b.column(0), b.column(1).to_pylist()
            sets = list(hasher.many(texts))
            keep = [k for k, s in enumerate(sets) if len(s)]
            if not keep:
                continue
            sets = [sets[k] for k in keep]
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(keep)),
                    pa.array([bytes_id(texts[k].encode("utf-8", "surrogatepass")) for k in keep], pa.int64()),
                    pa.array([bytes_id(s.tobytes()) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    long_lists(sets),
                ],
                names=["doc_id", "text_key", "set_key", "n", "shingles"],
            )


def classes(corpus: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Classes:
    """One scan of the texts; copies are folded before anything is joined, so a group of copies is one row however large it is."""
    kind = dict(corpus.dtypes)[id_column]
    hashed = written(
        corpus.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
        .where("doc_id is not null and text is not null")
        .mapInArrow(_hash_texts, f"doc_id {kind}, text_key bigint, set_key bigint, n int, shingles array<bigint>"),
        "shingles",
    )
    members = hashed.select("doc_id", "text_key", "set_key").distinct()
    sets = written(hashed.select("set_key", "n", "shingles").dropDuplicates(["set_key"]), "sets")
    return Classes(members, sets)


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Of pairs (a, b) of set keys, those with a Jaccard similarity of at least threshold, with it."""
    a = sets.select(F.col("set_key").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("set_key").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .where(F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb"))
        .withColumn("common", both)
        .withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
        .where(F.col("jaccard") >= threshold)
        .select("a", "b", "jaccard")
    )
