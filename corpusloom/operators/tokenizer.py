"""Byte-level pair encoding: training, encoding, decoding, and the hash that freezes a tokenizer.

Ids: specials, then the 256 bytes, then the merges in the order they were learnt. Training counts over
distinct words of bytes with their multiplicities (there are no word boundaries to a byte tokenizer, so a
"word" is a distinct text): a pair's count is the sum over texts of its occurrences times their copies.
Texts are trained on where they are: each partition keeps its own pair counts and sends the sums, and the
driver holds only pairs, of which there are at most 512 x 512.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import config
from ..functions.arrow import slices
from ..functions.hashing import object_hash
from ..session import written

FIRST_BYTE = len(config.SPECIALS)
FIRST_MERGE = FIRST_BYTE + 256


def laid_out(texts) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(unicodedata.normalize("NFC", t).encode("utf-8", "surrogatepass"), np.uint8) for t in texts]
    ids = np.concatenate([*parts, np.empty(0, np.uint8)]).astype(np.int32) + FIRST_BYTE
    return ids, np.repeat(np.arange(len(parts)), [len(p) for p in parts])


@dataclass(frozen=True)
class Tokenizer:
    merges: tuple[tuple[int, int], ...]
    train_manifest_hash: str = ""

    @property
    def vocab_size(self) -> int:
        return FIRST_MERGE + len(self.merges)

    def freeze_hash(self) -> str:
        return object_hash({"merges": [list(m) for m in self.merges], "specials": list(config.SPECIALS), "nfc": True, "pretokenize": "byte", "tiebreak": "lexicographic_pair", "vocab_size": self.vocab_size, "train_manifest_hash": self.train_manifest_hash})

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        ids, row = laid_out(texts)
        ends = np.searchsorted(row, np.arange(len(texts) + 1))
        ids = np.insert(ids, ends[1:], config.PAD).astype(np.uint16)
        ids, ends = _replayed(ids, ends + np.arange(len(texts) + 1), self.groups)
        return [[config.BOS, *ids[s : e - 1].tolist(), config.EOS] for s, e in zip(ends, ends[1:])]

    @cached_property
    def groups(self) -> list[list[tuple[int, int, int]]]:
        return _groups([(a, b, FIRST_MERGE + k) for k, (a, b) in enumerate(self.merges)])

    @cached_property
    def spelled(self) -> list[bytes]:
        """The bytes of each id; none for specials."""
        out = [b""] * FIRST_BYTE + [bytes([k]) for k in range(256)]
        for a, b in self.merges:
            out.append(out[a] + out[b])
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0]

    def decode(self, ids: list[int]) -> str:
        known = self.spelled
        return b"".join([known[t] for t in ids if 0 <= t < len(known)]).decode("utf-8", "replace")

    def encode_column(self, text):
        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def run(s: pd.Series) -> pd.Series:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            own = s[s.notna()]
            for at in range(0, len(own), 500):
                part = own.iloc[at : at + 500]
                for i, x in zip(part.index, self.encode_many(list(part))):
                    out[i] = x
            return out

        return run(text)

    def decode_column(self, ids):
        @F.pandas_udf(T.StringType())
        def run(s: pd.Series) -> pd.Series:
            return s.map(lambda t: None if t is None else self.decode(t))

        return run(ids)


def _groups(merges) -> list[list[tuple[int, int, int]]]:
    """Merges (a, b, new) in order, cut where one could overlap, or use, another of its group: each group can be applied at once."""
    out: list[list[tuple[int, int, int]]] = []
    for a, b, new in merges:
        if not out or a == b or any(a in (y, z) or b in (x, z) or x == y for x, y, z in out[-1]):
            out.append([])
        out[-1].append((a, b, new))
    return out


def _applied(ids: np.ndarray, group: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray | None]:
    """Sequences (uint16), each with a PAD behind it, after the merges of a group; and what was kept of ids (None for all)."""
    if len(group) == 1 and group[0][0] == group[0][1]:
        a, _, new = group[0]
        hit = np.flatnonzero((ids[:-1] == a) & (ids[1:] == a))
        order = np.arange(len(hit))
        first = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], order, 0)) if len(hit) else order
        hit = hit[(order - first) % 2 == 0]
        to = np.full(len(hit), new, np.uint16)
    elif len(group) == 1:
        a, b, new = group[0]
        hit = np.flatnonzero((ids[:-1] == a) & (ids[1:] == b))
        to = np.full(len(hit), new, np.uint16)
    else:
        width = max(max(x) for x in group) + 1
        becomes = np.zeros((width, width), np.uint16)
        for a, b, new in group:
            becomes[a, b] = new
        starts, ends = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        starts[[a for a, _, _ in group]] = True
        ends[[b for _, b, _ in group]] = True
        hit = np.flatnonzero(starts[ids[:-1]] & ends[ids[1:]])
        to = becomes[ids[hit], ids[hit + 1]]
        hit, to = hit[to > 0], to[to > 0]
    if not len(hit):
        return ids, None
    ids, keep = ids.copy(), np.ones(len(ids), bool)
    ids[hit] = to
    keep[hit + 1] = False
    return ids[keep], keep


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ends) of a binary column of sequences, laid end to end."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint16, (at[-1] - at[0]) // 2, at[0]) if data and at[-1] > at[0] else np.empty(0, np.uint16), (at - at[0]) // 2


def _replayed(ids, ends, groups):
    for group in groups:
        ids, keep = _applied(ids, group)
        if keep is not None:
            ends = np.concatenate([[0], np.cumsum(keep)])[ends]
    return ids, ends


def _replay(groups):
    def go(batches):
        for whole in batches:
            for b in slices(whole):
                ids, ends = _replayed(*_bytes(b.column(0)), groups)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer((2 * ends).astype(np.int32).tobytes()), pa.py_buffer(ids.tobytes())]), b.column(1)], names=["ids", "copies"])

    return go


def _counted(ids: np.ndarray, ends: np.ndarray, copies: np.ndarray, width: int) -> np.ndarray:
    """How often each pair (a, b) stands in the sequences, at a * width + b."""
    pair = ids[:-1].astype(np.int64) * width + ids[1:]
    total = np.bincount(pair, minlength=width * width)
    for k in np.flatnonzero(copies != 1):
        np.add.at(total, pair[ends[k] : ends[k + 1] - 1], copies[k] - 1)
    return total


def _changed(ids: np.ndarray, weight: np.ndarray | None, merge: tuple[int, int, int], total: np.ndarray, width: int):
    """(ids, weight) after a merge; total gets what it changes, counted around the places where it applies."""
    new, keep = _applied(ids, [merge])
    if keep is None:
        return ids, weight
    hit = np.flatnonzero(~keep) - 1
    for of, at, by, sign in ((ids, np.concatenate([hit - 1, hit, hit + 1]), weight, -1), (new, np.add.outer((-1, 0), np.cumsum(keep)[hit] - 1).ravel(), None if weight is None else weight[keep], 1)):
        at = np.unique(at[(at >= 0) & (at < len(of) - 1)])
        pair = of[at].astype(np.int64) * width + of[at + 1]
        np.add.at(total, pair, sign if by is None else sign * by[at])
    return new, None if weight is None else weight[keep]


def _counts(groups, guessed: list[tuple[int, int, int]], width: int):
    def go(batches):
        total = np.zeros((len(guessed) + 1, width * width), np.int64)
        for whole in batches:
            for b in slices(whole):
                ids, ends = _replayed(*_bytes(b.column(0)), groups)
                copies = b.column(1).to_numpy()
                total[0] += _counted(ids, ends, copies, width)
                weight = np.repeat(copies, np.diff(ends)) if (copies != 1).any() else None
                for k, merge in enumerate(guessed, 1):
                    ids, weight = _changed(ids, weight, merge, total[k], width)
        after, at = np.nonzero(total)
        kept = (at // width != config.PAD) & (at % width != config.PAD)
        after, at = after[kept], at[kept]
        yield pa.RecordBatch.from_arrays([pa.array(after.astype(np.int32)), pa.array((at // width).astype(np.int32)), pa.array((at % width).astype(np.int32)), pa.array(total[after, at])], names=["after", "a", "b", "n"])

    return go


def pair_counts(state: DataFrame, groups, guessed, width: int) -> DataFrame:
    """(after, a, b, n): how often each adjacent pair stands in the sequences (ids binary, copies bigint) after the groups of merges, and by how much each guessed merge, one after the other, changes that."""
    return state.mapInArrow(_counts(groups, guessed, width), "after int, a int, b int, n bigint").groupBy("after", "a", "b").agg(F.sum("n").alias("n"))


@F.pandas_udf(T.BinaryType())
def byte_ids(text: pd.Series) -> pd.Series:
    """The ids of a text's bytes as 16-bit numbers, and a PAD behind them."""
    return text.map(lambda t: None if t is None else np.append(laid_out([t])[0], config.PAD).astype(np.uint16).tobytes())


def _best(counts: np.ndarray) -> tuple[int, int] | None:
    """The pair that comes oftenest, twice at least; of equals the first."""
    a, b = divmod(int(counts.argmax()), counts.shape[1])
    return (a, b) if counts[a, b] >= 2 else None


def _guess(counts: np.ndarray, first: int, most: int) -> list[tuple[int, int, int]]:
    """The next merges, were neighbours independent: (a, b, new id). Only guesses: the counts that come back decide."""
    n, out = counts.astype(np.float64), []
    for new in range(first, first + most):
        best = _best(n)
        if best is None:
            break
        a, b = best
        k = n[a, b]
        behind, before = n[b].copy(), n[:, a].copy()
        behind *= k / max(behind.sum(), k)
        before *= k / max(before.sum(), k)
        n[b], n[:, a] = n[b] - behind, n[:, a] - before
        n[new], n[:, new] = behind, n[:, new] + before
        n[a, b] = 0
        out.append((a, b, new))
    return out


def train(texts: DataFrame, vocab_size: int = config.VOCAB_SIZE, train_manifest_hash: str = "", ahead: int = 16) -> Tokenizer:
    """The tokenizer of the texts (text). Each pass counts pairs and, for the next merges as guessed, what each would change; the counts confirm the guesses up to the first wrong one, and give the merge in its place. The sequences are written anew now and then, and the merges since are replayed on reading."""
    state = written(texts.where("text is not null").groupBy("text").agg(F.count(F.lit(1)).alias("copies")).select(byte_ids("text").alias("ids"), "copies"), "bpe")
    merges: list[tuple[int, int]] = []
    pending: list[tuple[int, int, int]] = []
    guessed: list[tuple[int, int, int]] = []
    while FIRST_MERGE + len(merges) < vocab_size:
        found = pair_counts(state, _groups(pending), guessed, vocab_size).toPandas()
        counts = np.zeros((vocab_size, vocab_size), np.int64)
        for k in range(len(guessed) + 1):
            own = found[found["after"] == k]
            counts[own["a"], own["b"]] += own["n"]
            best = _best(counts)
            if best is None or FIRST_MERGE + len(merges) == vocab_size:
                return Tokenizer(tuple(merges), train_manifest_hash)
            merges.append(best)
            pending.append((*best, FIRST_MERGE + len(merges) - 1))
            if k == len(guessed) or best != guessed[k][:2]:
                break
        # the counts are those before the last merge, so it is the first of the guesses from them
        guessed = _guess(counts, FIRST_MERGE + len(merges) - 1, min(ahead, vocab_size - FIRST_MERGE - len(merges)) + 1)[1:]
        if len(pending) >= 2 * ahead:
            state = written(state.mapInArrow(_replay(_groups(pending)), "ids binary, copies bigint"), "bpe")
            pending = []
    return Tokenizer(tuple(merges), train_manifest_hash)
