"""Oversized token sequences cut at natural boundaries.

The boundaries form a hierarchy: line end, sentence end, start of a word, any token. A piece is packed
greedily: of the ends that leave it within the limit (and more than LEAST tokens long), the last one of
the highest kind that is there; the next piece starts overlap tokens before that end. The longest piece
that the strongest boundary allows is the one taken, so the pieces are as few as the hierarchy permits.

Raw text has no pieces to look at: text_pieces() cuts it by the same hierarchy with sections and paragraphs
above it and characters below, in character offsets.

Cases: null tokens (lost fragments) have no pieces; sequences within the limit give none in cut(), which
is about oversized ones; unknown token ids count as text inside a word; a row delivered again gives its
pieces once. A null offset is the sum of the lengths of the parent's fragments with a smaller index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import flat_lists, slices
from ..operators.shards import offsets

LIMIT, OVERLAP, LEAST = 128, 16, 64
LINE, SENTENCE, WORD, OTHER = 3, 2, 1, 0
# The sentence ends.
SENTENCE_ENDS = (".", "!", "?", "।", "॥")
VOCABULARY_BOUND = 1 << 20


def boundary_kinds(vocab: DataFrame, most: int = VOCABULARY_BOUND) -> np.ndarray:
    """The kind of each token id: LINE or SENTENCE for pieces that end one, WORD for those that start with a blank.

    It is sent to every task, a byte an id. The vocabulary of a tokenizer is fixed, whatever the data; one of more than most pieces is refused, and most can be raised.
    """
    rows = vocab.where("token_id is not null and piece is not null and kind = 'text'").select("token_id", "piece").limit(most + 1).collect()
    if len(rows) > most or any(not 0 <= r.token_id < 4 * most for r in rows):
        raise ValueError(f"a vocabulary of more than {most} pieces")
    kinds = np.zeros(max((r.token_id for r in rows), default=0) + 1, np.int8)
    for r in rows:
        kinds[r.token_id] = LINE if r.piece == "\n" else SENTENCE if r.piece in SENTENCE_ENDS else WORD if r.piece.startswith(" ") else OTHER
    return kinds


def piece_ends(kinds: np.ndarray, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[int, int]]:
    """The [start, end) pieces of one sequence, given the kind of each of its tokens."""
    n, start, out = len(kinds), 0, []
    while n - start > limit:
        closes, opens = kinds[start + least : start + limit], kinds[start + least + 1 : start + limit + 1]
        for at in (closes == LINE, closes == SENTENCE, opens == WORD):
            hit = at.nonzero()[0]
            if len(hit):
                end = start + least + 1 + int(hit[-1])
                break
        else:
            end = start + limit
        out.append((start, end))
        start = end - overlap
    out.append((start, n))
    return out


def _cut(kinds: np.ndarray, limit: int, overlap: int, least: int, tokens_too: bool = False):
    """Over batches of (doc_id, tokens, ...): a row a piece with its start and end, or with its tokens, start, and the other columns."""

    def go(batches):
        for whole in batches:
            for b in slices(whole, 2000):
                tokens, ends = flat_lists(b.column(1))
                kind = np.where((tokens >= 0) & (tokens < len(kinds)), kinds[np.clip(tokens, 0, len(kinds) - 1)], OTHER)
                row, start, end = [], [], []
                for k in range(b.num_rows):
                    for s, e in piece_ends(kind[ends[k] : ends[k + 1]], limit, overlap, least):
                        row.append(k)
                        start.append(s)
                        end.append(e)
                at = pa.array(row, pa.int32())
                if not tokens_too:
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["doc_id", "piece_start", "piece_end"])
                    continue
                first = ends[row] + np.array(start, np.int64)
                size = np.array(end, np.int64) - np.array(start, np.int64)
                upto = np.concatenate([[0], np.cumsum(size)])
                own = tokens[np.repeat(first - upto[:-1], size) + np.arange(upto[-1])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(own))
                place = pa.array(np.array(start, np.int32) + b.column(3).to_numpy(zero_copy_only=False)[row].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), lists, place], names=["doc_id", "parent_doc_id", "tokens", "token_offset_in_parent"])

    return go


def fragment_offsets(fragments: DataFrame) -> DataFrame:
    """(doc_id, offset) of the fragments whose offset is not given: the lengths of their parent's fragments with a smaller index, summed.

    Lengths are summed by (parent, index) and then run through the range-partitioned prefix sum of
    shards.offsets, so a parent with any number of fragments is spread over ranges of its indices.
    """
    once = (
        fragments.select("doc_id", "parent_doc_id", "fragment_index", F.greatest(F.coalesce(F.size("tokens"), F.lit(0)), F.lit(0)).cast("bigint").alias("n"), "token_offset_in_parent")
        .groupBy("parent_doc_id", "fragment_index", "doc_id")
        .agg(F.max("n").alias("n"), F.max("token_offset_in_parent").alias("given"))
    )
    per_index = once.groupBy("parent_doc_id", "fragment_index").agg(F.sum("n").alias("n"))
    start = offsets(per_index.select(F.col("parent_doc_id").alias("lane"), F.col("fragment_index").alias("doc_id"), "n"))
    start = start.select(F.col("lane").alias("parent_doc_id"), F.col("doc_id").alias("fragment_index"), "start_token")
    todo = once.where("given is null").select("doc_id", "parent_doc_id", "fragment_index")
    return todo.join(start, ["parent_doc_id", "fragment_index"]).groupBy("doc_id").agg(F.max("start_token").alias("offset"))


def cut(fragments: DataFrame, vocab: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """(doc_id, parent_doc_id, piece_start, piece_end, token_offset_in_parent, token_end_in_parent) of every piece of every fragment over the limit.

    The tokens stay where they are: fragments are cut in place, and only positions are shuffled.
    """
    if not 0 <= overlap <= least < limit:
        raise ValueError("overlap <= least < limit is needed")
    long = fragments.where(F.size("tokens") > limit).select("doc_id", F.col("tokens"))
    pieces = long.mapInArrow(_cut(boundary_kinds(vocab), limit, overlap, least), "doc_id string, piece_start int, piece_end int").distinct()
    rows = fragments.where(F.size("tokens") > limit).groupBy("doc_id", "parent_doc_id").agg(F.max("token_offset_in_parent").alias("given"))
    placed = rows.join(fragment_offsets(fragments), "doc_id", "left").select("doc_id", "parent_doc_id", _at("given").alias("at"))
    return pieces.join(placed, "doc_id").select("doc_id", "parent_doc_id", "piece_start", "piece_end", (F.col("at") + F.col("piece_start")).alias("token_offset_in_parent"), (F.col("at") + F.col("piece_end")).alias("token_end_in_parent"))


def _at(given: str):
    """Where a fragment starts; one whose parent or index is null as well starts at 0."""
    return F.coalesce(F.col(given), F.col("offset").cast("int"), F.lit(0))


def pieces(fragments: DataFrame, vocab: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, least: int = LEAST) -> DataFrame:
    """The fragments to train on, none over the limit: (doc_id, parent_doc_id, tokens, token_offset_in_parent), oversized ones replaced by their pieces; lost ones left out.

    Tokens are shuffled once, by fragment, and cut where they then are.
    """
    once = fragments.where("tokens is not null").dropDuplicates(["doc_id"]).select("doc_id", "parent_doc_id", "tokens", "token_offset_in_parent")
    placed = once.join(fragment_offsets(fragments), "doc_id", "left").select("doc_id", "tokens", "parent_doc_id", _at("token_offset_in_parent").alias("at"))
    return placed.mapInArrow(_cut(boundary_kinds(vocab), limit, overlap, least, True), "doc_id string, parent_doc_id string, tokens array<int>, token_offset_in_parent int")


# Where a text may be cut, strongest first; a piece ends behind the match. The last level is any character.
TEXT_LEVELS = (
    ("section", r"\n(?=\s*(?:#{1,6}\s|={3,}|-{3,}|\*{3,}))|\f"),
    ("paragraph", r"\n[ \t]*\n\s*"),
    ("line", r"\n"),
    ("sentence", r"[.!?।॥]+[\"'”’)\]]*\s+"),
    ("word", r"\s+"),
)
_levels = [regex.compile(r) for _, r in TEXT_LEVELS]


def text_spans(text: str, limit: int, overlap: int, level: int = 0) -> list[tuple[int, int, str]]:
    """[start, end) of the pieces of a text, none over limit characters, and the kind of boundary each ends at.

    The text is split at the strongest separators; parts still too long are split by the next kind, down to
    single characters; the parts are then packed greedily, each piece starting overlap characters before the
    end of the last (at a word's start, where one is that near).
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap < limit is needed")
    ends: list[tuple[int, str]] = []

    def split(a: int, b: int, level: int) -> None:
        """The ends of unsplittable parts of text[a:b], each at most limit - overlap long."""
        if b - a <= limit - overlap:
            ends.append((b, ""))
            return
        if level == len(_levels):
            step = limit - overlap
            for at in range(a + step, b, step):
                ends.append((at, "character"))
            ends.append((b, ""))
            return
        cuts = [m.end() for m in _levels[level].finditer(text, a, b) if a < m.end() < b]
        for x, y in zip([a, *cuts], [*cuts, b]):
            split(x, y, level + 1)
            if y < b:
                ends[-1] = (y, TEXT_LEVELS[level][0])

    split(0, len(text), level)
    out, start, last = [], 0, (0, "")
    for end, kind in ends:
        if end - start > limit:
            out.append((start, *last))
            start = max(start + 1, last[0] - overlap)
            near = _levels[-1].search(text, start, last[0]) if overlap else None
            start = near.end() if near and near.end() < last[0] else start
        last = (end, kind)
    return [*out, (start, len(text), "end")] if text else []


def _text_cut(limit: int, overlap: int):
    def go(batches):
        for whole in batches:
            for b in slices(whole):
                rows = [(d, k, s, e, kind, t[s:e]) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (s, e, kind) in enumerate(text_spans(t, limit, overlap))]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string())], names=["doc_id", "piece", "start", "end", "boundary", "text"])

    return go


def text_pieces(documents: DataFrame, limit: int = 512, overlap: int = 64) -> DataFrame:
    """(doc_id, piece, start, end, boundary, text): every document's text in pieces of at most limit characters; a null or empty text has none, a document delivered again with the same text counts once. One narrow pass."""
    kind = dict(documents.dtypes)["doc_id"]
    rows = documents.select("doc_id", "text").where("text is not null").distinct()
    return rows.mapInArrow(_text_cut(limit, overlap), f"doc_id {kind}, piece int, start int, end int, boundary string, text string")
