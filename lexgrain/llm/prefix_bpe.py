"""Byte-pair encoding by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes exactly if each two neighbours
are, taken alone, the encoding of their joined bytes.  So every byte prefix of a
text has one *last token*: the only vocabulary entry that ends there and is
compatible with the last token of the prefix before it.  Storing that token for
every prefix gives

* the encoding (walk back from the end),
* exact appends (the table only grows; nothing before it changes), and
* re-encoding near an edit (only prefixes from the edit on are computed again,
  and only until the table agrees with the old one at a token boundary).

The table is kept for each pre-token, since merges never cross pre-tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the pre-token pattern that belongs to the rank files of the public tokenizers.
PATTERN = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Memory bound of a worker's table of encoded pre-tokens, not of the result.
MEMO_WORDS = 500_000
#: A vocabulary file is broadcast; this is its checked size.
VOCABULARY_BYTES = 16_000_000


class PrefixEncoder:
    """Encoder of byte strings over a rank vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.findall = regex.compile(pattern).findall
        self._fits: dict[tuple[int, int], bool] = {}
        self._memo: dict[str, bytes] = {}

    @classmethod
    def from_file_bytes(cls, data: bytes) -> PrefixEncoder:
        ranks = {}
        for line in data.splitlines():
            token, _, rank = line.partition(b" ")
            if rank:
                ranks[base64.b64decode(token)] = int(rank)
        return cls(ranks)

    def merged(self, piece: bytes) -> list[int]:
        """Encoding by repeated lowest-rank merges; used on pairs of tokens only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left``."""
        known = self._fits.get((left, right))
        if known is None:
            known = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._fits[(left, right)] = known
        return known

    def reaches(self, token: int) -> bool:
        """Whether ``token`` is the encoding of its own bytes."""
        known = self._fits.get((token, -1))
        if known is None:
            known = self.merged(self.bytes_of[token]) == [token]
            self._fits[(token, -1)] = known
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The valid last token of ``data[:end]``; ``last[i]`` is that of ``data[:i]``."""
        ranks = self.ranks
        for start in range(max(0, end - self.longest), end):
            token = ranks.get(data[start:end])
            if token is None:
                continue
            if self.reaches(token) if start == 0 else self.fits(last[start], token):
                return token
        raise ValueError("vocabulary lacks a single byte")

    def prefixes(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Table of last tokens (index = prefix length; index 0 is unused).

        With the table of a prefix of ``data`` given, only the rest is computed:
        an exact append.
        """
        table = [-1] if last is None else list(last)
        for end in range(len(table), len(data) + 1):
            table.append(self.last_token(data, end, table))
        return table

    def edited(
        self, old: bytes, last: list[int], start: int, end: int, new: bytes
    ) -> tuple[bytes, list[int]]:
        """Replace ``old[start:end]`` by ``new``; prefixes before ``start`` are kept.

        After the edit the table is computed again only until ``longest``
        consecutive entries agree with the old ones: every later entry depends
        on no more than those, so the rest is copied.
        """
        data = old[:start] + new + old[end:]
        table = last[: start + 1]
        shift, alike = len(data) - len(old), 0
        for at in range(start + 1, len(data) + 1):
            table.append(self.last_token(data, at, table))
            if at - shift >= end + self.longest and at - shift > 0:
                alike = alike + 1 if table[at] == last[at - shift] else 0
                if alike >= self.longest:
                    table.extend(last[at - shift + 1 :])
                    break
        return data, table

    def walk(self, table: list[int]) -> list[int]:
        """The encoding that a prefix table holds."""
        ids, at = [], len(table) - 1
        while at > 0:
            ids.append(table[at])
            at -= len(self.bytes_of[table[at]])
        return ids[::-1]

    def encode_bytes(self, data: bytes) -> list[int]:
        return self.walk(self.prefixes(data))

    def _word(self, word: str) -> bytes:
        """Ids of a pre-token as packed int32, memoised."""
        packed = np.array(
            self.encode_bytes(word.encode("utf-8", "replace")), dtype=np.int32
        ).tobytes()
        if len(self._memo) >= MEMO_WORDS:
            self._memo.clear()
        self._memo[word] = packed
        return packed

    def encode_packed(self, text: str | None) -> bytes:
        """Packed int32 ids of a text; empty for an empty or null text."""
        if not text:
            return b""
        words = self.findall(text)
        get = self._memo.get
        packed = [get(w) or self._word(w) for w in words]
        return b"".join(packed)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(key: str, data: bytes) -> PrefixEncoder:
    """One encoder for each worker process and vocabulary."""
    if key not in _ENCODERS:
        _ENCODERS[key] = PrefixEncoder.from_file_bytes(data)
    return _ENCODERS[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file as a broadcast of checked size, and the mark of its content."""
    with open(path, "rb") as f:
        data = f.read(VOCABULARY_BYTES + 1)
    if len(data) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data), xxhash.xxh64_hexdigest(data)


def _strings(column: pa.Array) -> list[str | None]:
    return column.to_pylist()


def token_ids(
    spark: SparkSession, text: Column | str, vocabulary: str = DEFAULT_VOCABULARY
) -> Column:
    """Column of token ids (``array<int>``) of a text column.

    Null and empty texts give an empty array; strings of special tokens are
    ordinary text; texts of any length are encoded whole.  Other columns of the
    frame are not touched and not sent to Python.
    """
    shared, key = _vocabulary(spark, vocabulary)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        pack = _encoder(key, shared.value).encode_packed
        packed = [pack(t) for t in _strings(texts)]
        ends = np.zeros(len(packed) + 1, dtype=np.int64)
        np.cumsum([len(p) // 4 for p in packed], out=ends[1:])
        flat = np.frombuffer(b"".join(packed), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))

    return encode(F.col(text) if isinstance(text, str) else text)


def token_count(
    spark: SparkSession, text: Column | str, vocabulary: str = DEFAULT_VOCABULARY
) -> Column:
    """Column with the number of tokens (``int``) of a text; 0 for null and empty."""
    shared, key = _vocabulary(spark, vocabulary)

    @F.arrow_udf("int")
    def count(texts: pa.Array) -> pa.Array:
        encoder = _encoder(key, shared.value)
        return pa.array(
            [len(encoder.encode_packed(t)) // 4 for t in _strings(texts)], pa.int32()
        )

    return count(F.col(text) if isinstance(text, str) else text)
