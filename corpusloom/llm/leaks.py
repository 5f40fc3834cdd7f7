"""Held-out passages inside a training corpus.

Words: NFKC, lower case, format characters removed, maximal runs of letters, marks and digits. Numbers,
units and names are replaced by typed placeholders, so a passage and a copy of it with other values have
the same template. Names are learnt from the texts themselves: words of which most occurrences inside
sentences are capitalised, besides days, months and words with a place's ending. Windows of PASSAGE template
words (all of them, for a shorter item) of the held-out items and of the documents are joined on a hash;
then the slots are checked: equal values make the window a verbatim leak, values exchanged one for one
throughout the window a re-parameterised one, and anything else no leak. Whether a word is a slot depends on
the word alone, so equal passages never get unequal templates. A window of which fewer than one word in
ANCHORED is fixed (a row of numbers, say) says nothing as a template and goes by its words themselves, so no
template gathers the corpus's numbers under one key.

What the held-out side has is known to the document scan as bitmaps of bounded size, with two hashes: the
keys of its windows, and the names. A full bitmap lets more windows through to the join, which decides.

A null text, or one without words, has no windows. Repeated items and documents count once each.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import slices
from ..functions.text import mix64, seeds64, word_id
from ..session import written

PASSAGE = 13
ANCHORED = 3
#: Bits of a bitmap for each key, and at most (16 MB).
BITS_A_KEY, MOST_BITS = 256, 1 << 27
#: A word is a name if it stands inside sentences capitalised more than so many times as often as in lower case.
CAPITALISED = 3
_U = np.uint64

# Number words, units, names of days and months, endings of place names.
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen
eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion
ಒಂದು ಎರಡು ಮೂರು ನಾಲ್ಕು ಐದು ಆರು ಏಳು ಎಂಟು ಒಂಬತ್ತು ಹತ್ತು ನೂರು ಸಾವಿರ ಲಕ್ಷ ಕೋಟಿ""".split()
UNITS = """mm cm km kg mg ml litre litres liter liters metre metres meter meters kilometre kilometres gram grams kilogram kilograms
tonne tonnes inch inches foot feet mile miles second seconds minute minutes hour hours day days week weeks month months year years
rupee rupees dollar dollars percent kb mb gb ಕಿಲೋ ಕಿಲೋಮೀಟರ್ ಮೀಟರ್ ಗ್ರಾಂ ಲೀಟರ್ ರೂಪಾಯಿ ಗಂಟೆ ನಿಮಿಷ ಸೆಕೆಂಡ್ ವರ್ಷ ತಿಂಗಳು ವಾರ""".split()
NAMES = """monday tuesday wednesday thursday friday saturday sunday january february march april june july august september october
november december ಸೋಮವಾರ ಮಂಗಳವಾರ ಬುಧವಾರ ಗುರುವಾರ ಶುಕ್ರವಾರ ಶನಿವಾರ ಭಾನುವಾರ ಜನವರಿ ಫೆಬ್ರವರಿ ಮಾರ್ಚ್ ಏಪ್ರಿಲ್ ಮೇ ಜೂನ್ ಜುಲೈ ಆಗಸ್ಟ್ ಸೆಪ್ಟೆಂಬರ್
ಅಕ್ಟೋಬರ್ ನವೆಂಬರ್ ಡಿಸೆಂಬರ್""".split()
PLACE_ENDINGS = ("ಪುರ", "ಹಳ್ಳಿ", "ಗಿರಿ", "ಸಂದ್ರ", "ನಗರ")
CASE_ENDINGS = ("", "ದಲ್ಲಿ", "ಯಲ್ಲಿ", "ದಿಂದ", "ಯಿಂದ", "ಕ್ಕೆ", "ಗೆ", "ವನ್ನು", "ಯನ್ನು", "ದ", "ಯ")

_find = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall
_format = regex.compile(r"\p{Cf}+")
_number = regex.compile(r"\p{N}+").fullmatch
_typed = {w: 1 for w in NUMBER_WORDS} | {w: 2 for w in UNITS} | {w: 3 for w in NAMES}
_place = regex.compile(f"\\p{{L}}.*(?:{'|'.join(PLACE_ENDINGS)})(?:{'|'.join(CASE_ENDINGS)})").fullmatch
_KINDS = mix64(np.arange(1, 4, dtype=_U) + _U(0x7E3F)).tolist()
_BASE = int(seeds64(1, 0xBA5E)[0])
_BACK = pow(_BASE, -1, 1 << 64)


def words(text: str) -> list[str]:
    return _find(_format.sub("", unicodedata.normalize("NFKC", text).lower()))


def slot(word: str) -> int:
    """1 for a number, 2 for a unit, 3 for a name, 0 for another word."""
    return _typed.get(word) or (1 if _number(word) else 3 if _place(word) else 0)


class Bitmap:
    """A set of 64-bit keys in bits, each key at two places. It may hold keys that were not put in, and never lacks one that was."""

    def __init__(self, bits: int, words: np.ndarray):
        self.mask, self.words = _U(bits - 1), words

    def __contains__(self, key: int) -> bool:
        return bool(self.has(np.array([key & 0xFFFFFFFFFFFFFFFF], _U))[0])

    def has(self, keys: np.ndarray) -> np.ndarray:
        first, second = keys & self.mask, (keys >> _U(27)) & self.mask
        bit = lambda at: (self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1)).astype(bool)
        return bit(first) & bit(second)


def bitmap(keys: DataFrame, bits_a_key: int = BITS_A_KEY, most_bits: int = MOST_BITS) -> Bitmap:
    """The bitmap of keys (key bigint). Bits are joined in the executors; what comes to the driver is bounded by most_bits."""
    bits = min(most_bits, max(1 << 12, 1 << math.ceil(math.log2(max(1, bits_a_key * keys.count())))))
    mask = F.lit(bits - 1)
    places = F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 27).bitwiseAND(mask))
    at = keys.select(F.explode(places).alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, int(at & 63))").alias("bit"))
    got = at.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros(bits >> 6, _U)
    words[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(_U)
    return Bitmap(bits, words)


_inside = regex.compile(r"(?<=[\p{Ll}\p{M},;]\s)\p{Lu}\p{Ll}[\p{L}\p{M}]*").findall
_lower = regex.compile(r"(?<![\p{L}\p{M}\p{N}])\p{Ll}[\p{L}\p{M}]*").findall


def _cased(batches):
    seen: Counter = Counter()

    def rows():
        own = [(w, seen[w, 1], seen[w, 0]) for w in {w for w, _ in seen}]
        seen.clear()
        cols = list(zip(*own)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["word", "inside", "lower"])

    for whole in batches:
        for b in slices(whole):
            for t in b.column(0).to_pylist():
                t = _format.sub("", t if t.isascii() else unicodedata.normalize("NFKC", t))
                seen.update((w.lower(), 1) for w in _inside(t))
                seen.update((w, 0) for w in _lower(t))
            if len(seen) > 200_000:
                yield rows()
    yield rows()


def learnt_names(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(word, key): the words of all texts that are written as names are, counted over all of them."""
    both = items.select("text").union(documents.select("text")).where("text is not null")
    counts = both.mapInArrow(_cased, "word string, inside bigint, lower bigint").groupBy("word").agg(F.sum("inside").alias("inside"), F.sum("lower").alias("lower"))

    @F.pandas_udf("bigint")
    def key(w: pd.Series) -> pd.Series:
        return w.map(lambda x: int(np.array([word_id(x)], _U).view(np.int64)[0]))

    return counts.where(F.col("inside") > CAPITALISED * F.col("lower")).select("word", key("word").alias("key"))


class _Windows:
    """Keys of template windows over many texts at once; word keys are cached up to a number."""

    def __init__(self, names: Bitmap | None, most: int = 500_000):
        self.names, self.seen, self.most = names, {}, most
        self.up = self.back = np.ones(1, _U)

    def _key(self, w: str) -> tuple[int, int]:
        """(as a template's word, as itself)."""
        own = word_id(w)
        s = slot(w) or (3 if self.names is not None and own in self.names else 0)
        k = self.seen[w] = (_KINDS[s - 1] if s else own, own)
        return k

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            self.up = np.cumprod(np.full(2 * n, _BASE, _U))
            self.back = np.cumprod(np.full(2 * n, _BACK, _U))

    def over(self, texts: list[str | None]):
        """(words of each text, where each starts among all, sums from which keys() makes the windows' keys)."""
        parts = [words(t) if t else [] for t in texts]
        if len(self.seen) > self.most:
            self.seen.clear()
        get, key = self.seen.get, self._key
        ids = np.array([get(w) or key(w) for p in parts for w in p], _U).reshape(-1, 2)
        self._powers(len(ids) + 1)
        sums = np.zeros((3, len(ids) + 1), _U)
        np.cumsum(ids.T * self.up[: len(ids)], axis=1, out=sums[:2, 1:])
        np.cumsum(ids[:, 0] == ids[:, 1], out=sums[2, 1:])  # the words that are no slots
        starts = np.zeros(len(parts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=starts[1:])
        return parts, starts, sums

    def keys(self, sums: np.ndarray, length: int) -> np.ndarray:
        """The key of the window of each start; those that pass the end of their text are to be left out."""
        n = sums.shape[1] - length  # sums has one entry more than there are words
        if n <= 0:
            return np.empty(0, _U)
        template, itself, fixed = sums[:, length:] - sums[:, :n]
        own = np.where(fixed * _U(ANCHORED) >= _U(length), template, itself)
        return mix64(own * self.back[:n] + _U(length))


_WINDOW = "length int, key bigint, id bigint, words array<string>"
_FIELDS = pa.schema([("length", pa.int32()), ("key", pa.int64()), ("id", pa.int64()), ("words", pa.list_(pa.string()))])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found), _FIELDS)], schema=_FIELDS)


def _item_windows(batches, passage: int, names):
    hold = _Windows(names and names.value)
    for whole in batches:
        for b in slices(whole):
            ids = b.column(0).to_pylist()
            parts, starts, sums = hold.over(b.column(1).to_pylist())
            found, made = [], {}
            for k, p in enumerate(parts):
                length = min(passage, len(p))
                if length:
                    if length not in made:
                        made[length] = hold.keys(sums, length).view(np.int64)
                    keys = made[length][starts[k] : starts[k + 1] - length + 1]
                    found += [(length, key, ids[k], p[i : i + length]) for i, key in enumerate(keys.tolist())]
            if found:
                yield _rows(found)


def _document_windows(batches, sieve, names, lengths: list[int]):
    """The windows of documents that the sieve lets through."""
    hold, held = _Windows(names and names.value), sieve.value
    for whole in batches:
        for b in slices(whole):
            ids = b.column(0).to_pylist()
            parts, starts, sums = hold.over(b.column(1).to_pylist())
            owner = np.repeat(np.arange(len(parts)), np.diff(starts))
            found = []
            for length in lengths:
                keys = hold.keys(sums, length)
                at = np.flatnonzero(held.has(keys))
                at = at[starts[owner[at] + 1] >= at + length]
                for i, o, key in zip(at.tolist(), owner[at].tolist(), keys[at].view(np.int64).tolist()):
                    s = i - int(starts[o])
                    found.append((length, key, ids[o], parts[o][s : s + length]))
            if found:
                yield _rows(found)


def matches(items: DataFrame, documents: DataFrame, passage: int = PASSAGE, most_bits: int = MOST_BITS) -> DataFrame:
    """(item_id, doc_id, length, item_words, doc_words, verbatim, consistent): the windows in common, by their templates."""
    spark = items.sparkSession
    names = spark.sparkContext.broadcast(bitmap(written(learnt_names(items, documents).select("key"), "names"), most_bits=most_bits))
    held = items.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null").mapInArrow(partial(_item_windows, passage=passage, names=names), _WINDOW)
    held = written(held.dropDuplicates(["length", "key", "id", "words"]), "held")  # windows of one template with other slots are different passages
    lengths = sorted(r.length for r in held.select("length").distinct().collect())  # at most passage numbers
    sieve = spark.sparkContext.broadcast(bitmap(held.select("key").distinct(), most_bits=most_bits))
    own = documents.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null").mapInArrow(partial(_document_windows, sieve=sieve, names=names, lengths=lengths), _WINDOW)
    x = held.select("length", "key", F.col("id").alias("item_id"), F.col("words").alias("item_words"))
    y = own.select("length", "key", F.col("id").alias("doc_id"), F.col("words").alias("doc_words"))
    met = y.join(x, ["length", "key"])
    slots = F.arrays_zip("item_words", "doc_words")
    one_to_one = (F.size(F.array_distinct(slots)) == F.size(F.array_distinct("item_words"))) & (F.size(F.array_distinct(slots)) == F.size(F.array_distinct("doc_words")))
    return met.select("item_id", "doc_id", "length", "item_words", "doc_words", (F.col("item_words") == F.col("doc_words")).alias("verbatim"), one_to_one.alias("consistent"))


def leaks(items: DataFrame, documents: DataFrame, passage: int = PASSAGE, **options) -> DataFrame:
    """(item_id, doc_id, verbatim, reparameterised): documents with an item's passage, and how many of their windows say so either way.

    A window counts once, as verbatim if it equals any window of the item.
    """
    m = matches(items, documents, passage, **options).where("verbatim or consistent")
    pairs = m.groupBy("item_id", "doc_id", "doc_words", "item_words").agg(F.count(F.lit(1)).alias("n"), F.bool_or("verbatim").alias("verbatim"))
    own = pairs.groupBy("item_id", "doc_id", "doc_words").agg(F.max("n").alias("n"), F.bool_or("verbatim").alias("verbatim"))
    many = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return own.groupBy("item_id", "doc_id").agg(many(F.col("verbatim")).alias("verbatim"), many(~F.col("verbatim")).alias("reparameterised"))
