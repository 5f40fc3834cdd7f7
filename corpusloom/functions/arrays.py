"""Column functions over token and vector arrays. Null arrays give null; short ones give empty arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IGNORE = -100


def shifted(tokens, by: int = 1) -> Column:
    """Pairs (x, y) of each token and the one by places on."""
    n = F.greatest(F.size(tokens) - by, F.lit(0))
    return F.arrays_zip(F.slice(tokens, F.lit(1), n).alias("x"), F.slice(tokens, F.lit(1 + by), n).alias("y"))


def padded(tokens, length: int, pad: int = 0) -> Column:
    return F.concat(F.slice(tokens, 1, length), F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - F.size(tokens), F.lit(0))))


def padding_mask(tokens, length: int) -> Column:
    return F.concat(F.array_repeat(F.lit(1), F.least(F.size(tokens), F.lit(length))), F.array_repeat(F.lit(0), F.greatest(F.lit(length) - F.size(tokens), F.lit(0))))


def masked_targets(targets, mask) -> Column:
    return F.zip_with(targets, mask, lambda t, m: F.when(m == 1, t).otherwise(IGNORE))


def boundary_targets(tokens, blocks) -> Column:
    """The next token where it is of the same document, else IGNORE; one shorter than tokens."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    after, own, other = F.slice(tokens, F.lit(2), n), F.slice(blocks, F.lit(1), n), F.slice(blocks, F.lit(2), n)
    same = F.zip_with(own, other, lambda a, b: (a == b) & (a >= 0))
    return F.zip_with(after, same, lambda t, s: F.when(s, t).otherwise(IGNORE))


def total(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def softmax(a, temperature: float = 1.0) -> Column:
    """exp((x - max) / t), scaled to a sum of 1; a null entry is masked and gets 0."""
    t = max(temperature, 1e-6)
    top = _let(F.struct(a.alias("v") if isinstance(a, Column) else F.col(a).alias("v"), F.array_max(a).cast("double").alias("m")), lambda s: F.transform(s["v"], lambda x: F.when(x.isNull(), 0.0).otherwise(F.exp((x.cast("double") - s["m"]) / t))))
    return _let(F.struct(top.alias("e"), total(top).alias("z")), lambda s: F.transform(s["e"], lambda x: x / s["z"]))


def _let(value, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def top_k(a, k: int) -> Column:
    """The k largest entries as (value, index), ties to the smaller index."""
    pairs = F.transform(a, lambda x, i: F.named_struct(F.lit("value"), x, F.lit("i"), -i))
    return F.transform(F.slice(F.sort_array(pairs, asc=False), 1, k), lambda p: F.named_struct(F.lit("value"), p["value"], F.lit("index"), -p["i"]))


def shard(a, rank: int, world: int) -> Column:
    """The rank-th of world slices of ceil(n / world) entries."""
    size = F.ceil(F.size(a) / F.lit(world)).cast("int")
    return F.slice(a, size * rank + 1, size)


def jaccard(a, b) -> Column:
    """Of two sets as arrays; 1 if both are empty."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / u)


def adam(gradients, start: float, lr: float = 0.1, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8, corrected: bool = True) -> Column:
    """The parameter after Adam steps over an array of gradients, as a fold."""
    state = F.struct(F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0).alias("t"), F.lit(float(start)).alias("p"))

    def step(s, g):
        m, v, t = s.m * b1 + g * (1 - b1), s.v * b2 + g * g * (1 - b2), s.t + 1
        mh, vh = (m / (1 - F.pow(F.lit(b1), t)), v / (1 - F.pow(F.lit(b2), t))) if corrected else (m, v)
        return F.struct(m.alias("m"), v.alias("v"), t.alias("t"), (s.p - lr * mh / (F.sqrt(vh) + eps)).alias("p"))

    return F.aggregate(gradients, state, step, lambda s: s.p)


def common_prefix(a, b) -> Column:
    """The number of leading characters two strings share."""
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    same = F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce(x == y, F.lit(False)))  # the shorter is filled up with nulls
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def common_suffix(a, b) -> Column:
    return common_prefix(F.reverse(a), F.reverse(b))
