"""Documents to fragments to fixed-length sequences, with exact provenance.

Fragments: a document within the length is one; a longer one is cut into runs of that length, or, where a
lane's policy forbids it, cut off. Fragments in order of their ids form groups of a lane's size; each group
is packed into the fewest bins, exactly up to EXACT_GROUP items and first-fit-decreasing above; bins over
the lane's document cap are cut in order and numbered anew; sequences count through the lane. The numbering
of groups and sequences is a two-step prefix sum, so no lane is held in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..session import written
from .shards import offsets


@cache
def _subsets(n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each size from 1 to n: the subsets of n items of that size, their items (last first), and the subsets without each of them."""
    every = np.arange(1 << n, dtype=np.int32)
    sizes = np.bitwise_count(every)
    out = []
    for size in range(1, n + 1):
        masks = every[sizes == size]
        items = n - 1 - np.nonzero(masks[:, None] >> np.arange(n - 1, -1, -1) & 1)[1].reshape(len(masks), size)
        out.append((masks, items.astype(np.int8), masks[:, None] ^ (1 << items).astype(np.int32)))
    return out


def exact_bins(lengths: Sequence[int], capacity: int) -> list[int]:
    """The bin of each item in a packing into the fewest bins.

    A table over the subsets holds the best (bins, room taken in the open bin), fewer first, then more
    room; of equally good last items the one that leaves the numerically smallest subset is taken. All
    subsets of a size are filled at once.
    """
    n = len(lengths)
    if any(x > capacity for x in lengths):
        raise ValueError("an item longer than the capacity")
    if not n:
        return []
    bits = capacity.bit_length()
    length = np.array(lengths, np.int32)
    best, last = np.zeros(1 << n, np.int32), np.zeros(1 << n, np.int8)
    best[0] = capacity
    for masks, items, without in _subsets(n):
        before, own = best[without], length[items]
        value = np.where((before & (1 << bits) - 1) + own <= capacity, before + own, (before >> bits) + 1 << bits | own)
        at = value.argmin(axis=1)
        rows = np.arange(len(masks))
        best[masks], last[masks] = value[rows, at], items[rows, at]
    out, mask = [0] * n, (1 << n) - 1
    while mask:
        i = int(last[mask])
        out[i] = int(best[mask] >> bits) - 1
        mask ^= 1 << i
    return out


def first_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[int]:
    """The bin of each item: longest first (earlier first on ties), each into the first bin with room."""
    room: list[int] = []
    out = [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if at == len(room):
            room.append(capacity)
        room[at] -= lengths[i]
        out[i] = at
    return out


def within_bound(ffd: int, optimum: int) -> bool:
    return ffd <= 11 / 9 * optimum + 6 / 9 + 1e-9


def capped(bins: Sequence[int], most: int) -> list[int]:
    """Bins renumbered so that none holds more than most items; a bin over it is cut in the items' order."""
    members: dict[int, list[int]] = {}
    for i, b in enumerate(bins):
        members.setdefault(b, []).append(i)
    out, number = [0] * len(bins), 0
    for b in sorted(members):
        for at in range(0, len(members[b]), most):
            for i in members[b][at : at + most]:
                out[i] = number
            number += 1
    return out


def fragments(docs: DataFrame, seq_len: int = config.SEQ_LEN, policies: dict[str, config.Packing] | None = None) -> DataFrame:
    """(doc_id, parent_doc_id, lane, fragment_index, is_continuation, tokens, token_offset_in_parent) of docs (doc_id, lane, tokens).

    A lane without a policy is packed as the role-agnostic sets are. Null or empty tokens give no fragment.
    """
    policies = config.PACKING if policies is None else policies
    whole = F.col("lane").isin(*[k for k, p in policies.items() if not p.split])
    n = F.size("tokens")
    number = F.when((n <= seq_len) | F.coalesce(whole, F.lit(False)), F.lit(1)).otherwise(F.ceil(n / F.lit(seq_len)).cast("int"))
    each = docs.where(n > 0).withColumn("parts", number).withColumn("fragment_index", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    at = F.col("fragment_index") * seq_len
    name = F.when(F.col("parts") > 1, F.concat("doc_id", F.lit("::frag"), F.col("fragment_index").cast("string"))).otherwise(F.col("doc_id"))
    return each.select(name.alias("doc_id"), F.col("doc_id").alias("parent_doc_id"), "lane", "fragment_index", (F.col("fragment_index") > 0).alias("is_continuation"), F.slice("tokens", at + 1, F.lit(seq_len)).alias("tokens"), at.alias("token_offset_in_parent"))


def grouped(frags: DataFrame, policies: dict[str, config.Packing] | None = None) -> DataFrame:
    """frags with group_index: consecutive fragments of a lane in order of their ids."""
    policies = config.PACKING if policies is None else policies
    size = F.lit(config.ROLE_AGNOSTIC.group)
    for k, p in policies.items():
        size = F.when(F.col("lane") == k, p.group).otherwise(size)
    place = offsets(frags.select("doc_id", "lane", F.lit(1).alias("n"))).select("lane", "doc_id", F.col("start_token").alias("i"))
    return frags.join(place, ["lane", "doc_id"]).withColumn("group_index", F.floor(F.col("i") / size).cast("int")).drop("i")


def _bins(seq_len: int, policies: dict[str, config.Packing], cap: bool):
    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        lengths = pdf["n"].tolist()
        bins = exact_bins(lengths, seq_len) if len(lengths) <= config.EXACT_GROUP else first_fit_decreasing(lengths, seq_len)
        policy = policies.get(key[0], config.ROLE_AGNOSTIC)
        return pdf.assign(bin_index=capped(bins, policy.max_docs if cap else len(bins)))[["lane", "group_index", "doc_id", "bin_index"]]

    return one


def _sequence(seq_len: int) -> list[Column]:
    """The arrays of a sequence out of its items (doc_id, parent_doc_id, tokens), in the order of their ids."""
    flat = lambda f: F.flatten(F.transform("items", f))
    pad = F.greatest(F.lit(seq_len) - F.aggregate("items", F.lit(0), lambda a, x: a + F.size(x["tokens"])), F.lit(0))
    places = lambda x: F.sequence(F.lit(0), F.size(x["tokens"]) - 1)
    filled = lambda a, v: F.concat(a, F.array_repeat(v, pad))
    position = flat(places)
    source = flat(lambda x: F.transform(places(x), lambda p: F.named_struct(F.lit("doc_id"), x["doc_id"], F.lit("parent_doc_id"), x["parent_doc_id"], F.lit("token_offset"), p)))
    none = F.lit(None).cast("struct<doc_id:string,parent_doc_id:string,token_offset:int>")
    return [
        filled(flat(lambda x: x["tokens"]), F.lit(config.PAD)).alias("input_ids"),
        filled(flat(lambda x, i: F.array_repeat(i, F.size(x["tokens"]))), F.lit(-1)).alias("attention_block_ids"),
        filled(position, F.lit(0)).alias("position_ids"),
        filled(F.transform(position, lambda p: (p > 0).cast("int")), F.lit(0)).alias("loss_mask"),
        filled(source, none).alias("token_provenance"),
        F.transform("items", lambda x: x["doc_id"]).alias("doc_ids_present"),
    ]


def pack(docs: DataFrame, seq_len: int = config.SEQ_LEN, policies: dict[str, config.Packing] | None = None, cap: bool = True) -> DataFrame:
    """Packed sequences of docs (doc_id, lane, tokens), with seq_id lane:g<group>:b<bin>:<number in the lane>.

    Only lengths go through Python; tokens are laid out in the JVM.
    """
    policies = config.PACKING if policies is None else policies
    groups = written(grouped(fragments(docs, seq_len, policies), policies).select("lane", "group_index", "doc_id", "parent_doc_id", "tokens"), "groups")
    sizes = groups.select("lane", "group_index", "doc_id", F.size("tokens").alias("n"))
    # lengths are few bytes and much work: by their size alone they would all be one task's
    tasks = max(4 * docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    bins = sizes.repartition(tasks, "lane", "group_index").groupBy("lane", "group_index").applyInPandas(_bins(seq_len, policies, cap), "lane string, group_index int, doc_id string, bin_index int")
    bins = written(bins, "bins")
    place = F.format_string("%012d:%012d", "group_index", "bin_index")
    number = offsets(bins.select("lane", place.alias("doc_id")).distinct().withColumn("n", F.lit(1))).select("lane", F.col("doc_id").alias("place"), F.col("start_token").alias("number"))
    items = F.array_sort(F.collect_list(F.struct("doc_id", "parent_doc_id", "tokens")))  # a bin's items: at most a group's
    packed = groups.join(bins, ["lane", "group_index", "doc_id"]).groupBy("lane", "group_index", "bin_index").agg(items.alias("items"))
    packed = packed.select("lane", "group_index", "bin_index", *_sequence(seq_len), place.alias("place")).join(number, ["lane", "place"])
    return packed.withColumn("seq_id", F.concat("lane", F.lit(":g"), "group_index", F.lit(":b"), "bin_index", F.lit(":"), "number")).drop("place", "number")


def utilisation(packed: DataFrame) -> DataFrame:
    """(lane, sequences, total, used, loss_bearing, used_ratio, loss_ratio); ratios are 0 for a lane without tokens."""
    ones = lambda c, f: F.aggregate(c, F.lit(0), lambda a, x: a + F.when(f(x), 1).otherwise(0))
    each = packed.select("lane", F.size("input_ids").alias("t"), ones("attention_block_ids", lambda x: x >= 0).alias("u"), ones("loss_mask", lambda x: x == 1).alias("l"))
    sums = each.groupBy("lane").agg(F.count(F.lit(1)).alias("sequences"), F.sum("t").alias("total"), F.sum("u").alias("used"), F.sum("l").alias("loss_bearing"))
    ratio = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col("total")), F.lit(0.0))
    return sums.withColumn("used_ratio", ratio("used")).withColumn("loss_ratio", ratio("loss_bearing"))


def attention_mask(blocks):
    """Column: 1 where position i sees position j: same block, not padding, j not after i."""
    return F.transform(blocks, lambda bi, i: F.transform(blocks, lambda bj, j: F.when((bi == bj) & (bi != -1) & (j <= i), 1).otherwise(0)))
