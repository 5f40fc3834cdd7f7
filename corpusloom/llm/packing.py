"""Items of varying length into containers of fixed capacity.

Karmarkar-Karp multiway differencing: every item starts as a partition of its own into k windows, and
the two partitions of largest spread are merged, the fullest window of one on the emptiest of the other,
until one partition is left, whose windows are nearly equal. k starts at the least number that could do
and rises while a window exceeds the capacity. Only items longer than the capacity are cut, into full
containers and a rest. Items are dealt to batches of bounded size by a hash, within their lane, so a lane
of any size is packed in parallel; what a batch wastes does not depend on the number of batches.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 128
BATCH = 256
#: States that the complete search of one group may go through (some 200 bytes each) before it raises.
MOST_STATES = 1_000_000
#: Items of one group up to which differencing is tried; its time grows with items times windows. Larger groups go to the bounds and the complete search at once.
MOST_LEVELLED = 20_000


def differencing(lengths: Sequence[int], k: int) -> list[list[int]]:
    """The items' positions in k windows, by multiway differencing. Ties go to the earlier item, so the result is a function of the input.

    A partition is the sorted list of its windows that hold something, each a number made of its sum
    above its node in a table of joined windows; the other windows are empty and need no entry.
    """
    if k <= 1:
        return [list(range(len(lengths)))] if k else []
    joined: list[tuple[int, int] | int] = list(range(len(lengths)))
    heap = [(-n, i, [n << 32 | i]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    count = len(lengths)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        meet = len(a) + len(b) - k
        if meet > 0:
            both = []
            for x, y in zip(a[:meet], reversed(b[:meet])):
                both.append((x >> 32) + (y >> 32) << 32 | len(joined))
                joined.append((x & 0xFFFFFFFF, y & 0xFFFFFFFF))
            merged = sorted(both + a[meet:] + b[meet:])
        else:
            merged = sorted(a + b)
        least = merged[0] >> 32 if len(merged) == k else 0
        if least:
            merged = [x - (least << 32) for x in merged]
        heapq.heappush(heap, (-(merged[-1] >> 32), count, merged))
        count += 1
    windows = [_flat(joined, x & 0xFFFFFFFF) for x in heap[0][2]] if heap else []
    return windows + [[] for _ in range(k - len(windows))]


def _flat(joined: list, node: int) -> list[int]:
    out, todo = [], [node]
    while todo:
        x = joined[todo.pop()]
        if isinstance(x, tuple):
            todo.extend(x)
        else:
            out.append(x)
    return sorted(out)


def fewest_by_bound(lengths: Sequence[int], capacity: int) -> int:
    """A number of containers that any packing needs: by the sum, and by the items that no two of can share one."""
    halves = sum(2 * n > capacity for n in lengths)
    rest = sum(n for n in lengths if 2 * n <= capacity)
    free = sum(capacity - n for n in lengths if 2 * n > capacity)
    return max(math.ceil(sum(lengths) / capacity), halves + max(0, math.ceil((rest - free) / capacity)))


def pack(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of positions, none over the capacity; the items that fill a container by themselves go first. No window is empty."""
    full = [[i] for i, n in enumerate(lengths) if n == capacity]
    rest = [i for i, n in enumerate(lengths) if n != capacity]
    own = [lengths[i] for i in rest]
    k = fewest_by_bound(own, capacity)
    while own:
        windows = differencing(own, k)
        if all(sum(own[i] for i in w) <= capacity for w in windows):
            return full + [[rest[i] for i in w] for w in windows if w]
        k += 1
    return full


class Undecided(Exception):
    """The complete search went through most_states states of a group without an answer."""


def paired_off(lengths: Sequence[int], capacity: int) -> tuple[list[int], int]:
    """(the other lengths, containers used): items of the capacity, and pairs that fill a container, packed together, as some best packing has them."""
    count = Counter(n for n in lengths if n < capacity)
    used = len(lengths) - count.total()
    for n in [n for n in count if 2 * n <= capacity]:
        pairs = count[n] // 2 if 2 * n == capacity else min(count[n], count.get(capacity - n, 0))
        count[n] -= 2 * pairs if 2 * n == capacity else pairs
        if 2 * n < capacity and pairs:
            count[capacity - n] -= pairs
        used += pairs
    return sorted(count.elements(), reverse=True), used


def fewest_by_classes(lengths: Sequence[int], capacity: int) -> int:
    """A number of containers that any packing needs (the published bound L2): for each a, items over capacity - a stand alone, those over the half one each, and the rest from a on fill what these leave."""
    best = math.ceil(sum(lengths) / capacity)
    for a in {n for n in lengths if 2 * n <= capacity} | {0}:
        alone = sum(n > capacity - a for n in lengths)
        big = [n for n in lengths if capacity - a >= n and 2 * n > capacity]
        small = sum(n for n in lengths if a <= n and 2 * n <= capacity)
        best = max(best, alone + len(big) + max(0, math.ceil((small - (len(big) * capacity - sum(big))) / capacity)))
    return best


def complete_differencing(lengths: Sequence[int], k: int, capacity: int = CAPACITY, most_states: int = MOST_STATES) -> bool:
    """Whether the items go into k containers, by the complete form of differencing.

    The partition of largest spread takes in the next largest item in every way that differs, where
    differencing takes only the one that levels most: the same merge, with what it leaves out as further
    branches. A state is the number of items taken in and the room left in each window, sorted; states seen
    before, and those whose room cannot hold the rest, are left out. Beyond most_states states it raises
    Undecided: the problem is NP-complete, so some bound has to be stated, and it never guesses.
    """
    order, used = paired_off(lengths, capacity)
    k -= used
    if any(n > capacity for n in order) or k < 0 or fewest_by_classes(order, capacity) > k:
        return False
    after = [*itertools.accumulate(reversed(order), initial=0)][::-1]
    seen, stack = set(), [(0, (capacity,) * k)]
    while stack:
        i, rooms = stack.pop()
        if i == len(order):
            return True
        n, smallest = order[i], order[-1]
        if sum(r for r in rooms if r >= smallest) < after[i]:
            continue
        for r in [n] if n in rooms else sorted({r for r in rooms if r >= n}, reverse=True):
            left = list(rooms)
            left.remove(r)
            bisect.insort(left, r - n)
            state = (i + 1, tuple(left))
            if state not in seen:
                seen.add(state)
                stack.append(state)
        if len(seen) > most_states:
            raise Undecided(f"{len(lengths)} items, {k + used} containers: undecided after {most_states} states; raise most_states")
    return False


def batches_of(doc_tokens: DataFrame, batch: int = BATCH) -> DataFrame:
    """The lanes' items with the batch each goes to: the batches of a lane are as many as its items need."""
    per_lane = doc_tokens.groupBy("lane").agg(F.ceil(F.count(F.lit(1)) / F.lit(batch)).alias("batches"))
    return doc_tokens.join(per_lane, "lane").withColumn("group_index", F.pmod(F.xxhash64("doc_id"), F.col("batches")).cast("int")).drop("batches")


def _sequences(capacity: int):
    def go(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending")])
        ids, lane, group = table["doc_id"].to_pylist(), table["lane"][0].as_py(), table["group_index"][0].as_py()
        chunk = table["tokens"].combine_chunks()
        ends = chunk.offsets.to_numpy()
        flat = chunk.values.to_numpy()
        items = []
        for d, s, e in zip(ids, ends[:-1], ends[1:]):
            for at in range(int(s), int(e), capacity):
                items.append((d, at - int(s), flat[at : min(at + capacity, e)]))
        bins = pack([len(x[2]) for x in items], capacity)
        rows: dict[str, list] = {k: [] for k in ("lane", "group_index", "bin_index", "used", "input_ids", "attention_block_ids", "position_ids", "doc_ids_present", "token_offsets")}
        for number, members in enumerate(bins):
            own = [items[i] for i in members]
            used = sum(len(t) for _, _, t in own)
            pad = capacity - used
            rows["lane"].append(lane)
            rows["group_index"].append(group)
            rows["bin_index"].append(number)
            rows["used"].append(used)
            rows["input_ids"].append(np.concatenate([*(t for _, _, t in own), np.zeros(pad, np.int32)]).astype(np.int32))
            rows["attention_block_ids"].append(np.concatenate([*(np.full(len(t), k, np.int32) for k, (_, _, t) in enumerate(own)), np.full(pad, -1, np.int32)]))
            rows["position_ids"].append(np.concatenate([*(np.arange(len(t), dtype=np.int32) for _, _, t in own), np.zeros(pad, np.int32)]))
            rows["doc_ids_present"].append([d for d, _, _ in own])
            rows["token_offsets"].append([o for _, o, _ in own])
        ints = pa.list_(pa.int32())
        kinds = {"lane": pa.string(), "group_index": pa.int32(), "bin_index": pa.int32(), "used": pa.int32(), "input_ids": ints, "attention_block_ids": ints, "position_ids": ints, "doc_ids_present": pa.list_(pa.string()), "token_offsets": ints}
        return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})

    return go


def sequences(doc_tokens: DataFrame, capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """Sequences of capacity tokens from the TRAIN documents of doc_tokens.

    A row delivered again counts once; null or empty tokens make no item; a null lane is the lane ''.
    Padding is 0 with block -1. token_offsets says where in its document each item starts.
    """
    train = doc_tokens.where(F.upper(F.trim("role")) == "TRAIN").where(F.size("tokens") > 0)
    items = train.select("doc_id", F.coalesce("lane", F.lit("")).alias("lane"), "tokens").dropDuplicates(["doc_id"])
    ints = "array<int>"
    schema = f"lane string, group_index int, bin_index int, used int, input_ids {ints}, attention_block_ids {ints}, position_ids {ints}, doc_ids_present array<string>, token_offsets {ints}"
    return batches_of(items, batch).groupBy("lane", "group_index").applyInArrow(_sequences(capacity), schema)


def group_items(packed: DataFrame) -> DataFrame:
    """(lane, group_index, seq_id, lengths): the lengths of the items in each packed sequence, by their blocks; delivered again, once."""
    blocks = F.filter("attention_block_ids", lambda b: b >= 0)
    lengths = F.transform(F.array_distinct("blocks"), lambda b: F.size(F.filter("blocks", lambda x: x == b)))
    return packed.select("lane", "group_index", "seq_id", blocks.alias("blocks")).select("lane", "group_index", "seq_id", lengths.alias("lengths")).dropDuplicates(["lane", "group_index", "seq_id"])


def group_counts(packed: DataFrame) -> DataFrame:
    """(lane, group_index, sequences, lengths): a group's items as (length, number) pairs, one for each length: at most as many as the capacity, however large the group."""
    own = group_items(packed)
    number = own.groupBy("lane", "group_index").agg(F.count(F.lit(1)).cast("int").alias("sequences"))
    by_length = own.select("lane", "group_index", F.explode("lengths").alias("length")).groupBy("lane", "group_index", "length").agg(F.count(F.lit(1)).alias("k"))
    items = by_length.groupBy("lane", "group_index").agg(F.collect_list(F.struct("length", "k")).alias("lengths"))
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("lane", "group_index")]
    return number.alias("n").join(items.alias("i"), same[0] & same[1], "left").select("n.lane", "n.group_index", "sequences", "lengths")


def _judge(capacity: int, most_states: int):
    def go(lengths: Sequence[int], have: int) -> tuple[int, str]:
        """(containers, how): the fewest containers known for a group, and how they were found."""
        if fewest_by_classes(lengths, capacity) >= have:
            return have, "none"
        best = len(pack(lengths, capacity)) if len(lengths) <= MOST_LEVELLED else have
        if best < have:
            return best, "differencing"
        return (have - 1, "complete differencing") if complete_differencing(lengths, have - 1, capacity, most_states) else (have, "none")

    def batches(it):
        for b in it:
            judged = [go([n["length"] for n in x or [] for _ in range(n["k"])], h) for h, x in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array([x for x, _ in judged], pa.int32()), pa.array([y for _, y in judged])],
                names=["lane", "group_index", "sequences", "fewer", "how"],
            )

    return batches


def repackable(packed: DataFrame, capacity: int = CAPACITY, most_states: int = MOST_STATES) -> DataFrame:
    """(lane, group_index, sequences, fewer, how) of the groups whose items fit into fewer containers than they take.

    Differencing decides; where it stays at the group's own number and no bound excludes fewer, its complete
    form does. A group goes to Python as its counts by length. A group of null lane or index is one of its own.
    """
    sc = packed.sparkSession.sparkContext
    groups = group_counts(packed).repartition(max(2 * sc.defaultParallelism, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "lane", "group_index")  # few bytes, much work
    return groups.mapInArrow(_judge(capacity, most_states), "lane string, group_index int, sequences int, fewer int, how string").where("fewer < sequences")
