"""A corpus made of keyed draws, for tests of the pipeline: documents by (tier, type), and planted duplicates.

Every word is a function of the seed, the document and its place, so the corpus is the same on any
partitioning and of any size: times multiplies the number of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H

# Documents and sentences by (tier, type); words to draw from.
GROUPS = (("verified", "web", 220, 4, 10), ("verified", "speech", 180, 3, 6), ("verified", "pdf", 120, 12, 30), ("unverified", None, 220, 4, 12), ("synthetic", None, 160, 3, 9))
WORDS = """ಮನೆ ಊರು ನದಿ ಮಳೆ ಹೊಲ ಮರ ಹಕ್ಕಿ ಶಾಲೆ ಪುಸ್ತಕ ಕಥೆ ರೈತ ಗುರು ಮಗು ಬೆಟ್ಟ ಕೆರೆ ದಾರಿ ದೀಪ ಹಬ್ಬ ಹಾಡು ಬೆಳೆ ಸಂತೆ ತೋಟ ಗಾಳಿ ಚಂದ್ರ
ನಕ್ಷತ್ರ ಬೀದಿ ಅಂಗಡಿ ಪತ್ರಿಕೆ ಚಿತ್ರ ಆಟ ಊಟ ನೀರು ಬೆಳಕು ಕನಸು ಮಾತು ನೆನಪು ಸಮಯ ಕೆಲಸ ಯಂತ್ರ ರಾಗ""".split()
SENTENCE = 8


def corpus(spark: SparkSession, times: int = 1, seed: int = 1337) -> DataFrame:
    """(doc_id, tier, type, text): GROUPS times over, an exact duplicate of the sixth document among the unverified, and among the synthetic a near one of the 41st pdf document, a word of it changed."""
    rows = spark.createDataFrame([(t, k, n * times, lo, hi) for t, k, n, lo, hi in GROUPS], "tier string, type string, n int, lo int, hi int")
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n"))))
    each = each.withColumn("doc_id", F.format_string("%s:%s-%06d", "tier", F.coalesce("type", F.lit("x")), "i"))
    key = H.key_hex(seed, "corpus", F.col("doc_id"))
    each = each.withColumn("key", key).withColumn("sentences", F.col("lo") + F.floor(H.uniform_column(F.col("key"), F.lit(0)) * (F.col("hi") - F.col("lo") + 1)).cast("int"))
    word = lambda c: F.element_at(F.array(*map(F.lit, WORDS)), F.floor(H.uniform_column(F.col("key"), c) * len(WORDS)).cast("int") + 1)
    sentence = lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(SENTENCE)), lambda w: word(s * SENTENCE + w)), " ")
    made = each.select("doc_id", "tier", "type", F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.col("sentences")), sentence), ". "), F.lit(".")).alias("text"))
    exact = made.where("doc_id = 'verified:web-000006'").select(F.concat(F.lit("unverified:zz-dup-of-"), "doc_id").alias("doc_id"), F.lit("unverified").alias("tier"), F.lit(None).cast("string").alias("type"), "text")
    near = made.where("doc_id = 'verified:pdf-000041'").select(F.concat(F.lit("zz-synthetic:near-dup-of-"), "doc_id").alias("doc_id"), F.lit("synthetic").alias("tier"), F.lit(None).cast("string").alias("type"), F.regexp_replace("text", r"^(\S+ \S+) \S+", "$1 ಬದಲು").alias("text"))
    exact = exact.withColumn("doc_id", F.concat(F.lit("zz-"), "doc_id"))
    return made.unionByName(exact).unionByName(near)
