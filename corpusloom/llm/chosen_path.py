"""Near-duplicate records by a chosen-path set similarity join.

Each run starts all sets at one node. A node picks tokens at random, on average 1 / threshold of
them, from the sets' min-wise embedding (WIDTH tokens, one a coordinate and the smallest hash of the
set there: equal tokens stand for shared elements, in proportion to the Jaccard similarity), and each
set goes to a child for each picked token. A node with few sets is compared pair by pair; a larger
one splits again. Two sets alike stay together in at least one child on average at every level, so a
run finds them with a chance that falls only slowly with the depth, and runs are repeated until the
target recall holds at the depth that was reached. A node that is still large at the last level is
compared too, in blocks, so no case is dropped.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import flat_lists, slices
from ..functions.text import mix64, seeds64
from ..session import written
from .features import Classes, verified

WIDTH = 128
SMALL = 64
LEVELS = 8
BLOCK = 1024
TARGET = 0.99999
_U = np.uint64
_SEEDS = seeds64(WIDTH, 0xC0FFEE)


def survival(depth: int) -> float:
    """The chance that two sets at the threshold are together at depth levels under the root, each level having one shared child on average."""
    p = 1.0
    for _ in range(depth):
        p = 1 - math.exp(-p)
    return p


def runs_for(depth: int, target: float = TARGET) -> int:
    """The number of runs after which a pair that no run takes deeper is found with the target chance."""
    return math.ceil(math.log(1 - target) / math.log(1 - survival(depth)))


def picked(node: int, threshold: float) -> np.ndarray:
    """The coordinates that a node picks."""
    draw = mix64(_SEEDS ^ _U(node & 0xFFFFFFFFFFFFFFFF)) >> _U(11)
    return np.flatnonzero(draw < _U(int(2**53 / (threshold * WIDTH))))


def _child(node: int, coordinate: int, smallest: np.ndarray) -> np.ndarray:
    return mix64(smallest + mix64(np.array([node & 0xFFFFFFFFFFFFFFFF], _U)) * _U(2 * coordinate + 1)).view(np.int64)


def _smallest(values: np.ndarray, starts: np.ndarray, coordinate: int) -> np.ndarray:
    return np.minimum.reduceat(mix64(values ^ _SEEDS[coordinate]), starts)


def _roots(first: int, last: int) -> list[int]:
    return mix64(np.arange(first, last, dtype=_U) + _U(0x5EED)).astype(object).tolist()


def _first_level(first: int, last: int, threshold: float):
    plan = [(root, int(c)) for root in _roots(first, last) for c in picked(root, threshold)]

    def go(batches):
        for whole in batches:
            for b in slices(whole, 2000):
                values, ends = flat_lists(b.column(2))
                values, starts, low = values.view(_U), ends[:-1], {}
                for root, c in plan:
                    if c not in low:
                        low[c] = _smallest(values, starts, c)
                    yield pa.RecordBatch.from_arrays([pa.array(_child(root, c, low[c])), b.column(0), b.column(1)], names=["node", "set_key", "n"])

    return go


def _next_level(threshold: float):
    def go(batches):
        for whole in batches:
            for b in slices(whole, 2000):
                nodes = b.column(0).to_numpy()
                values, ends = flat_lists(b.column(3))
                values = values.view(_U)
                for node in np.unique(nodes).tolist():
                    at = np.flatnonzero(nodes == node)
                    own = np.concatenate([values[ends[k] : ends[k + 1]] for k in at])
                    starts = np.concatenate([[0], np.cumsum(ends[at + 1] - ends[at])[:-1]])
                    for c in picked(node, threshold):
                        yield pa.RecordBatch.from_arrays([pa.array(_child(node, int(c), _smallest(own, starts, int(c)))), b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at))], names=["node", "set_key", "n"])

    return go


def _counted(entries: DataFrame) -> DataFrame:
    """Entries whose node holds two sets or more, with their number. Only the entries of these nodes are kept."""
    size = entries.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return entries.join(size, "node")


def _alike_in_size(threshold: float):
    return F.least("x.n", "y.n") >= F.lit(threshold) * F.greatest("x.n", "y.n")


def _pairs_of_small(entries: DataFrame, threshold: float) -> DataFrame:
    x, y = entries.alias("x"), entries.alias("y")
    return x.join(y, (F.col("x.node") == F.col("y.node")) & (F.col("x.set_key") < F.col("y.set_key")) & _alike_in_size(threshold)).select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b"))


def _pairs_in_blocks(entries: DataFrame, threshold: float) -> DataFrame:
    """The pairs of large nodes: each pair of blocks of a node is a join key of its own, so no task holds more than two blocks of a node."""
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    cut = entries.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int"))
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    x = cut.select("node", "set_key", "n", F.col("own").alias("i"), all_blocks.alias("j")).alias("x")
    y = cut.select("node", "set_key", "n", all_blocks.alias("i"), F.col("own").alias("j")).alias("y")
    on = (F.col("x.node") == F.col("y.node")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    return x.join(y, on & (F.col("x.set_key") < F.col("y.set_key")) & _alike_in_size(threshold)).select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b"))


def similar_sets(sets: DataFrame, threshold: float = 0.8, target: float = TARGET, levels: int = LEVELS, small: int = SMALL) -> DataFrame:
    """Pairs (a, b, jaccard), a < b, of set keys whose Jaccard similarity is at least threshold.

    sets: (set_key, n, shingles), keys distinct, no empty set. Result: each pair once, jaccard exact;
    a pair at the threshold is missed with a chance under 1 - target, a closer one with a smaller
    chance. An empty table gives no pairs.
    """
    kind = "node bigint, set_key bigint, n int"
    planned, done, found, members = 2, 0, [], sets
    while True:
        last = runs_for(planned, target)
        entries = members.select("set_key", "n", "shingles").mapInArrow(_first_level(done, last, threshold), kind)
        deep, reached = None, planned
        for level in range(1, levels + 1):
            kept = written(_counted(written(entries, f"entries{level}")), f"paths{level}")
            found.append(_pairs_of_small(kept.where(F.col("size") <= small), threshold))
            large = kept.where(F.col("size") > small)
            if large.isEmpty():
                break
            if level == levels:
                found.append(_pairs_in_blocks(large, threshold))
                break
            if level >= planned:
                reached, at = level + 1, large.select("set_key")
                deep = at if deep is None else deep.union(at)
            wide = large.select("node", "set_key").join(members.select("set_key", "n", "shingles"), "set_key").select("node", "set_key", "n", "shingles")
            entries = wide.mapInArrow(_next_level(threshold), kind)
        if deep is None:
            break
        done, planned = last, reached
        members = written(members.join(deep.distinct(), "set_key", "left_semi"), "deep")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return verified(pairs.distinct(), sets, threshold)


def near_duplicates(c: Classes, threshold: float = 0.8, **options) -> DataFrame:
    """Pairs (doc_id_a, doc_id_b, jaccard) of documents with different texts and similar sets, smaller id first."""
    links = written(similar_sets(c.sets, threshold, **options), "links")
    m = c.members
    x = m.select(F.col("doc_id").alias("x"), F.col("text_key").alias("tx"), F.col("set_key").alias("a"))
    y = m.select(F.col("doc_id").alias("y"), F.col("text_key").alias("ty"), F.col("set_key").alias("b"))
    across = links.join(x, "a").join(y, "b").select("x", "y", "jaccard")
    # inside a set: first the pairs of its different texts, then their documents, so that copies never meet each other
    texts = m.select("set_key", "text_key").distinct()
    s, t = texts.select("set_key", F.col("text_key").alias("tx")), texts.select("set_key", F.col("text_key").alias("ty"))
    differing = s.join(t, "set_key").where("tx < ty").select("tx", "ty")
    within = differing.join(x.select("x", "tx"), "tx").join(y.select("y", "ty"), "ty").select("x", "y", F.lit(1.0).alias("jaccard"))
    return across.union(within).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"), "jaccard").dropDuplicates(["doc_id_a", "doc_id_b"])


def link_counts(c: Classes, threshold: float = 0.8, **options) -> DataFrame:
    """(doc_id, class_id, copies, links): class_id the smallest id with the same set, copies the documents in that class, links the other classes at or over the threshold."""
    links = written(similar_sets(c.sets, threshold, **options), "links")
    degree = links.select(F.explode(F.array("a", "b")).alias("set_key")).groupBy("set_key").agg(F.count(F.lit(1)).alias("links"))
    head = c.members.groupBy("set_key").agg(F.min("doc_id").alias("class_id"), F.countDistinct("doc_id").alias("copies"))
    return c.members.select("doc_id", "set_key").distinct().join(head.join(degree, "set_key", "left"), "set_key").select("doc_id", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
