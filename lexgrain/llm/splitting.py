"""Splitting of oversized texts at natural boundaries.

Every position that follows white space is a candidate cut with a strength
(paragraph > line > sentence > semicolon or colon > comma or dash > word).  A
sparse table holds the maximum of every run of 2^k candidates, so the strongest
cut of any length window is found with two look-ups; the key of a candidate is
``strength, index``, which breaks ties rightward.  After each cut the next piece
starts at the first word within the overlap before it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAGRAPH, LINE, SENTENCE, CLAUSE, PHRASE, WORD = 6, 5, 4, 3, 2, 1
_SPACES = np.array([9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], dtype=np.uint32)
_LINES = np.array([10, 11, 12, 13, 0x85, 0x2028, 0x2029], dtype=np.uint32)
_ENDS = np.array([ord(c) for c in ".!?…。！？"], dtype=np.uint32)
_CLOSERS = np.array([ord(c) for c in "»”\"')]’"], dtype=np.uint32)
_CLAUSES = np.array([ord(c) for c in ";:；："], dtype=np.uint32)
_PHRASES = np.array([ord(c) for c in ",—–，"], dtype=np.uint32)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts of a text (positions, ascending) and their strengths.

    A cut at ``p`` separates ``text[:p]`` and ``text[p:]``.  Only the last
    position of a run of white space is a candidate.
    """
    # numpy's view of the code points; lone surrogates pass as they are
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = np.isin(codes, _SPACES)
    at = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(at):
        return at, np.zeros(0, np.int64)
    # start of the run of white space before each candidate
    word_ends = np.concatenate([[0], np.flatnonzero(~space[:-1] & space[1:]) + 1])
    run = word_ends[np.searchsorted(word_ends, at, side="left") - 1]
    breaks = np.concatenate([[0], np.cumsum(np.isin(codes, _LINES))])
    lines = breaks[at] - breaks[run]
    before = codes[np.maximum(run - 1, 0)]
    closed = np.isin(before, _CLOSERS)
    last = np.where(closed, codes[np.maximum(run - 2, 0)], before)
    earlier = codes[np.maximum(run - 2, 0)]
    digit = (earlier >= 48) & (earlier <= 57) & ~closed
    strength = np.full(len(at), WORD, np.int64)
    strength[np.isin(before, _PHRASES)] = PHRASE
    strength[np.isin(before, _CLAUSES)] = CLAUSE
    ends = np.isin(last, _ENDS)
    strength[ends] = np.where(digit[ends], PHRASE, SENTENCE)  # "4.1. " is a label
    strength[lines == 1] = LINE
    strength[lines > 1] = PARAGRAPH
    return at, strength


class RangeMaximum:
    """Sparse table over candidate strengths: strongest of a range, ties rightward."""

    def __init__(self, strengths: np.ndarray):
        row = (strengths.astype(np.int64) << 40) | np.arange(len(strengths))
        self.rows = [row]
        width = 1
        while 2 * width <= len(strengths):
            row = np.maximum(row[:-width], row[width:])
            self.rows.append(row)
            width *= 2

    def strongest(self, low: int, high: int) -> int:
        """Index of the strongest candidate of ``low .. high - 1``; -1 if none."""
        if low >= high:
            return -1
        k = (high - low).bit_length() - 1
        row = self.rows[k]
        return int(max(row[low], row[high - (1 << k)])) & ((1 << 40) - 1)


def _parts_a_mark(text: str, at: int) -> bool:
    """Whether a cut would part a mark or a joiner from its base character."""
    if not 0 < at < len(text):
        return False
    return bool(unicodedata.combining(text[at])) or text[at] in "\u200d\ufe0f" or text[at - 1] == "\u200d"


def _plain_cut(text: str, at: int, least: int) -> int:
    """``at``, moved left so that no mark is parted from its base character."""
    cut = at
    while cut > least and _parts_a_mark(text, cut):
        cut -= 1
    return cut if cut > least else at


def split_spans(text: str, limit: int, overlap: int, least: float = 0.0) -> list[tuple[int, int]]:
    """Half-open spans of at most ``limit`` code points that cover the text.

    Each span but the last ends at the strongest boundary of the permissible lengths,
    else at the limit itself.  With ``least``, lengths of at least that share of the
    limit are tried first.  Consecutive spans share at most ``overlap`` code points.
    """
    if limit < 1 or not 0 <= overlap < limit or not 0 <= least <= 1:
        raise ValueError("limit must be positive, overlap smaller than it and least a share")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    at, strength = boundaries(text)
    table = RangeMaximum(strength) if len(at) else None
    first = max(overlap, int(limit * least))
    spans, start, done = [], 0, 0
    while n - start > limit:
        # a piece must reach beyond what is covered, or nothing would be gained
        beyond = max(start + overlap, done)
        end = -1
        if table is not None:
            for low, high in ((max(start + first, beyond), start + limit), (beyond, start + first)):
                i, j = np.searchsorted(at, [low + 1, high + 1])
                best = table.strongest(int(i), int(j))
                if best >= 0:
                    end = int(at[best])
                    break
        if end < 0:
            end = _plain_cut(text, start + limit, beyond)
        spans.append((start, end))
        done = end
        start = end - overlap
        if table is not None and overlap:
            i = int(np.searchsorted(at, start))
            if i < len(at) and at[i] <= end:
                start = int(at[i])
            else:
                while start < end and _parts_a_mark(text, start):
                    start += 1
        if start <= spans[-1][0]:
            start = end
    spans.append((start, n))
    return spans


def split_oversized(
    items: DataFrame,
    key: str,
    text: str,
    limit: int,
    overlap: int = 150,
    start: str | None = None,
    end: str | None = None,
) -> DataFrame:
    """Pieces of all items over ``limit`` code points.

    Result: ``key``, ``piece_no`` (from 0), ``span_start``, ``span_end`` (relative
    to the text), ``piece``.  With ``start`` and ``end`` the item is that span of
    the text; a span whose text is null is cut by its length alone, with null
    pieces, and so is the part of a span beyond the end of its text.  Items within
    the limit, null texts without spans and empty texts give no rows; repeated
    keys give the pieces of each repetition.  Other columns, whatever their
    names, are ignored.
    """
    whole = start is None or end is None
    length = F.length(text) if whole else F.col(end) - F.col(start)
    source = items.where(length > limit).select(
        F.col(key).alias("item"),
        F.col(text).alias("body"),
        (F.lit(0) if whole else F.col(start)).cast("long").alias("low"),
        length.cast("long").alias("size"),
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            out: list[tuple] = []
            for item, body, low, size in zip(*columns):
                part = None if body is None else body[low : low + size]
                if part is None or len(part) < size:
                    # no text to look at: spaces have no boundaries between them
                    part_text = (part or "") + " " * (size - len(part or ""))
                else:
                    part_text = part
                for no, (a, b) in enumerate(split_spans(part_text, limit, overlap)):
                    piece = None if part is None else part[a:b]
                    out.append((item, no, low + a, low + b, piece))
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string())
            names = (key, "piece_no", "span_start", "span_end", "piece")
            data = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), type=k) for c, k in zip(data, kinds)], names=names
            )

    kind = source.schema["item"].dataType.simpleString()
    return source.mapInArrow(
        cut, f"`{key}` {kind}, piece_no int, span_start bigint, span_end bigint, piece string"
    )
