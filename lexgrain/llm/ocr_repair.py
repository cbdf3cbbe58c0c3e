"""Repair of text recognised from scanned pages.

Lines of page furniture are told from charter text: markers and numbers by their
shape, running heads because they recur at page breaks.  The rest is one stream
without lines, in which a line end is a character and a hyphen before it another.
Around each chunk of it that is no known word, the stream is decoded jointly: a path
over a lattice of words may drop a space or a line end inside a word, drop or keep a
hyphen at a line end, part words that ran together and take misread glyphs for the
letters they stand for, each at a cost; what isn't read stays as it is, at a cost
that grows with its length.  Broken and misread lines are read off the cheapest path.
Paragraph boundaries are chosen by dynamic programming over the lines.

The vocabulary stays a table.  Every confusion of the decoder is an identity under
:func:`skeleton`, so the words that a chunk may stand for are found by an equi-join on
skeletons, once for each different stretch of text.
"""

from __future__ import annotations

import heapq
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrain.runtime import materialise

#: What a glyph was read as, and the letter it stands for.
MISREAD = [
    ("0", "о"), ("o", "о"), ("с", "е"), ("п", "н"), ("н", "п"), ("г", "т"), ("н", "и"), ("и", "н"),
    ("8", "в"), ("!", "л"), ("л", "д"), ("ьi", "ы"), ("ьı", "ы"), ("ьl", "ы"), ("ь1", "ы"), ("bi", "ы"),
    ("rn", "м"), ("m", "м"), ("3", "з"), ("4", "ч"), ("6", "б"), ("ш", "щ"), ("щ", "ш"), ("ср", "ф"),
    ("ıо", "ю"), ("iо", "ю"), ("lо", "ю"), ("u,", "ц"), ("(", "с"), (")|(", "ж"), ("€", "е"), ("е", "с"), ("|", "л"),
    ("1", "л"), ("й", "и"), ("ii", "п"), ("jо", "ю"), ("т", "г"), ("д", "л"),
]
#: Skeletons of characters, chosen so that both sides of every confusion
#: have the same one; a character that isn't listed is its own.
_SKELETON = {
    **dict.fromkeys("1iılj!|лд", "l"), **dict.fromkeys("пний", "ll"), **dict.fromkeys("0oо", "o"),
    **dict.fromkeys("се€(", "c"), "г": "т", "8": "в", "3": "з", "4": "ч", "6": "б", "щ": "ш", "b": "ь",
    "ы": "ьl", "ю": "lo", "м": "rn", "m": "rn", "ф": "cр", "ц": "u,", "ж": ")lc",
}
_SKELETONS = str.maketrans(_SKELETON)
_DASH = "-‐‑¬\xad"
_NUMBER_GLYPHS = "0-9ОоOoІіIlЗзбSВ|!"
_N = rf"[{_NUMBER_GLYPHS}]{{1,5}}"
_MARKER = re.compile(
    rf"-{{2,}} ?Page .*-{{2,}}|Total pages:.*|<!--.*-->|(?:стр|лист|страница|с)\.? *{_N}(?: *(?:из|/) *{_N})?"
    rf"|[-—–\[(] ?{_N} ?[-—–\])]|[ivxlc]{{1,6}}|(?-i:[0-9]{{0,3}}[lIІ|!][0-9lIІОO|!]{{0,3}}|[0-9]{{1,3}}[ОO])",
    re.I,
)
_PAGE = re.compile(r"-{2,} ?Page +(\d+)")
_BARE = re.compile(r"\d{1,6}")
_CHUNK = re.compile(r"(?:\)\|\(|u,(?=[а-яё-])|[^\s.,;:«»\"—№%*#|\[\]<>/\\)…])+", re.I)
_TAIL = re.compile(rf"[{_DASH}]\s*$")
_LABEL = re.compile(
    rf"\s*(?:[-*•>|#]+ ?)*\**(?:(?:статья|глава|раздел) +)?([{_NUMBER_GLYPHS}]{{1,3}}(?:[.,][{_NUMBER_GLYPHS}]{{1,3}})*)(?=[.)*|](?:\D|$)|\s*$)",
    re.I,
)
_CLAUSE = re.compile(r"\s*(?:[-*•>|#]+ ?)*\**\d+(?:\.\d+)*[.)]")
_ITEM = re.compile(r"\s*(?:[-*•] |\d+\)|[а-я]\))")
_CF = re.compile("[\xad​‌‍⁠﻿]")
_VOCABULARY_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_CYRILLIC = re.compile("[а-яё]")
_PASSED = "(!?')"

# separators of a stream: a space and a line end that may fall inside a word, one that may not, a
# hyphen at a line end before a word that goes on, another dash there, a hyphen before a
# word that seems new, and a hyphen that only stands for the end of the next word
SPACE, LINE, APART, HYPHEN, DASH, DOUBTFUL, HANGING = " \n\t\x02\x03\x04\x05"
_BREAKS = HYPHEN + DASH + DOUBTFUL + HANGING
_PIECE = re.compile(rf"[^ \n\t{_BREAKS}-]+")


@dataclass(frozen=True)
class Costs:
    """Costs of the decoder, in units of one certain confusion."""

    confusion: float = 1.0
    #: Of a space, or a line end without a hyphen, inside a word.
    join: float = 1.5
    join_lines: float = 1.8
    #: Of parting two words that ran together; each has at least three letters.
    split: float = 2.5
    #: Of a hyphen at a line end: dropped inside a word; kept after о, kept elsewhere; not read on.
    hyphen: float = 0.1
    compound: float = 0.6
    other_compound: float = 2.0
    hanging: float = 20.0
    #: Of letters that aren't read: at least, and for each letter.
    literal: float = 2.9
    literal_letter: float = 0.54
    #: Of a word that is one in e of the words of the corpus.
    rarity: float = 0.05


def skeleton(text: str) -> str:
    """Form that a word shares with everything it may be misread as."""
    return text.translate(_SKELETONS)


def words_of_texts(texts: DataFrame, text: str) -> DataFrame:
    """Document counts of words (lower case, compounds whole and in parts): ``word``, ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for at in range(batch.num_rows):
                t = batch.column(0)[at].as_py()
                if not t:
                    continue
                t = t.lower()
                if not t.isascii():
                    t = unicodedata.normalize("NFC", _CF.sub("", t) if _CF.search(t) else t)
                found = set(_VOCABULARY_WORD.findall(t))
                for word in [w for w in found if "-" in w]:
                    found.update(word.split("-"))
                counts.update(found)
            if len(counts) > 200_000:
                yield _counted(counts)
                counts = Counter()
        if counts:
            yield _counted(counts)

    return (
        texts.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
    )


class Token(NamedTuple):
    """Part of a stream that reads otherwise than it stands: ``word`` for ``start .. end``,
    where letters were misread, and where lines were broken with what joins them there."""

    start: int
    end: int
    word: str
    glyphs: tuple[int, ...]
    breaks: tuple[tuple[int, str], ...]


_READ_AS: dict[str, list[tuple[str, str]]] = {}
for _read, _truth in MISREAD:
    _READ_AS.setdefault(_read[0], []).append((_read, _truth))


def decode(stream: str, rarity: dict[str, float], costs: Costs = Costs()) -> tuple[float, list[Token]]:
    """Cheapest reading of a stream: its cost and the tokens that differ from the stream.

    ``rarity`` has the words that may occur and what each costs.  Streams are lower case;
    their separators are the constants above.  The search takes states in the order of
    their cost, so the first to reach the end is the cheapest path and confusions need
    no limit.
    """
    n = len(stream)
    prefixes = {w[:i] for w in rarity for i in range(1, len(w) + 1)}
    piece_end: dict[int, int] = {m.start(): m.end() for m in _PIECE.finditer(stream)}

    def literal(piece: str) -> float:
        known = rarity.get(piece)
        if known is not None:
            return known
        if not _CYRILLIC.search(piece):
            return 0.0
        return max(costs.literal, costs.literal_letter * len(piece))

    # states: (position, prefix of the word that is being read, whether it began inside a chunk);
    # prefix None: between words, "о"/"" as third: just behind a word (that ends with о)
    heap: list = [(0.0, 0, 0, None, None, None)]
    seen = set()
    count = 0

    def push(cost, at, prefix, mark, trace):
        nonlocal count
        if (at, prefix, mark) not in seen:
            count += 1
            heapq.heappush(heap, (cost, count, at, prefix, mark, trace))

    while heap:
        cost, _, at, prefix, mark, trace = heapq.heappop(heap)
        if (at, prefix, mark) in seen:
            continue
        seen.add((at, prefix, mark))
        if prefix is None and at == n:
            return cost, _tokens(stream, trace)
        c = stream[at] if at < n else ""
        if prefix is None:
            behind = mark is not None
            if c in SPACE + LINE + APART + "-":
                push(cost, at + 1, None, None, trace)
                continue
            if c in _BREAKS:
                if behind:
                    free = c == HANGING or c == DOUBTFUL
                    push(cost + (0.0 if free else costs.hanging), at + 1, None, None, trace)
                    if c == HYPHEN or (c == DOUBTFUL and mark == "о"):
                        more = costs.compound if mark == "о" else costs.other_compound
                        push(cost + more, at + 1, None, None, (trace, "k", at, at + 1, "-"))
                continue
            if c in _PASSED:
                push(cost + 0.05, at + 1, None, mark, trace)
            if behind:
                push(cost + costs.split, at, "", True, (trace, "b", at, at, ""))
                continue
            push(cost, at, "", False, (trace, "b", at, at, ""))
            end = piece_end.get(at)
            if end:
                piece = stream[at:end]
                last = "о" if piece in rarity and piece[-1] == "о" else ""
                push(cost + literal(piece), end, None, last, trace)
                after = piece_end.get(end + 1) if stream[end : end + 1] in (HYPHEN, DASH) and end < n else None
                if after:
                    both = piece + stream[end + 1 : after]
                    lost = rarity.get(both)
                    lost = max(costs.literal, costs.literal_letter * len(both)) if lost is None else lost
                    push(cost + lost + costs.hyphen, after, None, "", (trace, "l", at, after, both, end))
            continue
        # inside a word
        if prefix in rarity:
            inside = c and c not in _BREAKS + SPACE + LINE + APART + "-"
            if len(prefix) > 2 or not (mark or inside):
                push(cost + rarity[prefix], at, None, "о" if prefix[-1] == "о" else "", (trace, "w", at, at, prefix))
        if not c:
            continue
        if c in SPACE + LINE + APART + _BREAKS:
            if prefix and c == SPACE:
                push(cost + costs.join, at + 1, prefix, mark, (trace, "j", at, at + 1, ""))
            elif prefix and c == LINE:
                push(cost + costs.join_lines, at + 1, prefix, mark, (trace, "j", at, at + 1, ""))
            elif prefix and c != APART:
                push(cost + costs.hyphen, at + 1, prefix, mark, (trace, "h", at, at + 1, ""))
                if prefix + "-" in prefixes and c != HANGING:
                    push(cost, at + 1, prefix + "-", mark, (trace, "h", at, at + 1, "-"))
            continue
        if prefix + c in prefixes:
            push(cost, at + 1, prefix + c, mark, trace)
        for read, truth in _READ_AS.get(c, ()):
            if prefix + truth in prefixes and stream.startswith(read, at):
                push(cost + costs.confusion, at + len(read), prefix + truth, mark, (trace, "g", at, at, ""))
    return math.inf, []


def _tokens(stream: str, trace) -> list[Token]:
    """Tokens of a path that differ from the stream."""
    steps = []
    while trace:
        steps.append(trace[1:])
        trace = trace[0]
    out: list[Token] = []
    start, glyphs, breaks, moved = 0, [], [], False
    for step in reversed(steps):
        kind, at, end, word = step[:4]
        if kind == "b":
            start, glyphs, breaks, moved = at, [], [], False
            parted = at > 0 and stream[at - 1] not in SPACE + LINE + APART + _BREAKS + "-" + _PASSED
        elif kind == "g":
            glyphs.append(at)
        elif kind == "j":
            moved = True
        elif kind == "h":
            breaks.append((at, word))
        elif kind == "k":
            out.append(Token(at, end, word, (), ((at, "-"),)))
        elif kind == "l":
            out.append(Token(at, end, word, (), ((step[4], ""),)))
        elif parted or moved or glyphs or breaks:
            out.append(Token(start, at, " " * parted + word, tuple(glyphs), tuple(breaks)))
    return out


@dataclass
class Page:
    """Lines of a text and what was found out about them."""

    lines: list[str]
    furniture: set[int] = field(default_factory=set)
    hyphen: set[int] = field(default_factory=set)
    glyph: set[int] = field(default_factory=set)
    #: Line -> next line and what joins the word that goes on there.
    joined: dict[int, tuple[int, str]] = field(default_factory=dict)
    #: Line -> parts of it that read otherwise: (start, end, reading).
    repairs: dict[int, list[tuple[int, int, str]]] = field(default_factory=dict)


def _near(a: str, b: str, most: int) -> bool:
    """Whether two strings differ by at most ``most`` edits."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > most:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return False
    return row[-1] <= most


def _letters(text: str) -> str:
    return "".join(c for c in text.casefold() if c.isalpha())


def find_furniture(page: Page, stamps: re.Pattern) -> None:
    """Lines that belong to the page: markers, stamps, running heads and page numbers."""
    lines = page.lines
    texts = [(i, s) for i, x in enumerate(lines) if (s := x.strip())]
    page.furniture.update(i for i, s in texts if _MARKER.fullmatch(s) or stamps.match(s))
    find_heads(page, texts)
    bare, listing, number = [], None, 0
    for i, s in texts:
        marker = _PAGE.match(s)
        if marker:
            number = int(marker[1])
        if i in page.furniture:
            continue
        if _BARE.fullmatch(s):
            bare.append((i, int(s), number, listing is not None and lines[i][:1] != " "))
        else:
            listing = i if s.endswith(":") else None
    page.furniture.update(i for i, _, _, in_list in bare if not in_list)
    # page numbers run with the pages; in a list of numbers only those that do are furniture
    offsets = Counter(value - number for _, value, number, in_list in bare if not in_list)
    usual = offsets.most_common(1)[0][0] if offsets else None
    for i, value, number, in_list in bare:
        if in_list and usual is not None and value - number == usual and _beside_marker(page, i):
            page.furniture.add(i)


def find_heads(page: Page, texts: list[tuple[int, str]]) -> None:
    """Running heads: short lines that repeat the end of the title or recur at page breaks.

    A head may add a number and up to two words to the end of the title.
    """
    title = next((s for _, s in texts if s.startswith("# ")), "")
    words = re.findall(r"\w+", title)
    ends = {_letters("".join(words[k:])) for k in range(len(words))}
    ends = {e for e in ends if len(e) > 4}
    edges = set()
    for place, (i, s) in enumerate(texts):
        if i in page.furniture or place in (0, len(texts) - 1) or _BARE.fullmatch(s):
            edges.update(i for i, _ in texts[max(0, place - 2) : place + 3])
    found = []
    for i, s in texts:
        if i not in page.furniture and len(s) < 90 and s[0] not in "#|" and s[-1] not in ".;:,":
            key = _letters(s)
            if len(key) > 4:
                found.append((i, s, key))
    at_edges = Counter(key for i, _, key in found if i in edges)
    for i, s, key in found:
        if (
            any(_near(e, key, 2) for e in ends)
            or (i in edges and (at_edges[key] > 1 or any(o != key and _near(o, key, 2) for o in at_edges)))
            or (s[-1].isalpha() and any(key.startswith(e) and _few_words(s, e) for e in ends))
        ):
            page.furniture.add(i)


def _few_words(line: str, head: str) -> bool:
    """Whether a line has a number and one or two words behind a head."""
    words = re.findall(r"\w+", line)
    rest = next((words[k:] for k in range(len(words)) if _letters("".join(words[:k])) == head), [])
    return 1 < len(rest) < 4 and any(w.isdigit() for w in rest)


def _beside_marker(page: Page, i: int) -> bool:
    """Whether the next or the previous line with text is page furniture."""
    for step in (-1, 1):
        j = i + step
        while 0 <= j < len(page.lines) and not page.lines[j].strip():
            j += step
        if 0 <= j < len(page.lines) and (j in page.furniture):
            return True
    return False


def _plain(chunk: str) -> str:
    low = chunk.lower()
    return low if low.isascii() else unicodedata.normalize("NFC", _CF.sub("", low))


class Chunk:
    """A chunk of the stream: the parts of lines that it joins and its characters."""

    __slots__ = ("parts", "stream", "whole", "frozen")

    def __init__(self, line: int, start: int, end: int, text: str, frozen: bool):
        self.parts = [(line, start, end, 0)]
        self.stream = _plain(text)
        self.whole = text
        self.frozen = frozen

    def extend(self, other: Chunk, sign: str) -> None:
        line, start, end, _ = other.parts[0]
        self.parts.append((line, start, end, len(self.stream) + 1))
        self.stream += sign + other.stream
        self.whole += other.whole

    def place(self, at: int, ends: bool = False) -> tuple[int, int]:
        """Line and column of a position of this chunk's stream."""
        part = self.parts[0]
        for p in self.parts[1:]:
            if at >= p[3] + ends:
                part = p
        line, start, end, base = part
        nxt = next((p[3] - 1 for p in self.parts if p[3] > base), len(self.stream))
        return line, (end if at >= nxt else min(end, start + at - base))


def chunks_of(page: Page, text_lines: list[int]) -> list[Chunk | None]:
    """Chunks of the stream in order; None where something parts them that no word crosses."""
    out: list[Chunk | None] = []
    pending: tuple[Chunk, str] | None = None  # chunk before a hyphen at its line's end
    for i in text_lines:
        line = page.lines[i]
        block = line.lstrip()[:1] in "#|"
        label = _LABEL.match(line)
        low = label.end(1) if label else 0
        found = [m for m in _CHUNK.finditer(line)]
        last_end = 0
        if block:
            out.append(None)
        for k, m in enumerate(found):
            start, end, text = m.start(), m.end(), m[0]
            gap = line[last_end:start]
            last_end = end
            if end <= low:
                out.append(None)
                pending = None
                continue
            sign = ""
            if k == len(found) - 1 and not block:
                tail = _TAIL.search(line)
                if tail and tail.start() == end - 1 and end - start > 1:
                    sign, end, text = text[-1], end - 1, text[:-1]
            frozen = start > 0 and line[start - 1] == "«" and text[0].isupper()
            chunk = Chunk(i, start, end, text, frozen)
            if pending and k == 0 and not gap.strip() and not block and (text[0].isalnum() or text[0] in "(!)€"):
                before, dash = pending
                before.extend(chunk, _break(before.whole, text, dash))
                chunk = before
            else:
                if gap.strip():
                    out.append(None)
                out.append(chunk)
            pending = (chunk, sign) if sign else None
        if block or (line[last_end:].strip() and not pending):
            out.append(None)
            pending = None
    return out


def _break(left: str, right: str, dash: str) -> str:
    """Separator for a hyphen at a line end."""
    if dash in "-‐‑" and right.lower() in ("и", "или"):
        return HANGING
    if right[0].islower() or right[0] in "0(!8346" or (left.isupper() and right.isupper()):
        return HYPHEN if dash in "-‐‑" else DASH
    return DOUBTFUL


def _known(piece: str, hot: dict[str, float]) -> bool:
    if piece in hot or not _CYRILLIC.search(piece):
        return True
    bare = piece.strip(_PASSED)
    return bare != piece and bare in hot and piece[:1] in "('" and not set(piece[1:]) & set("!(")


def _settled(chunk: Chunk, hot: dict[str, float]) -> str | None:
    """What joins a chunk's lines if it needs no decoding ("" for one without breaks), else None."""
    stream = chunk.stream
    if len(chunk.parts) == 1:
        return "" if stream in hot or all(_known(p, hot) for p in _PIECE.findall(stream)) else None
    if len(chunk.parts) > 2:
        return None
    cut = chunk.parts[1][3] - 1
    left, right = stream[:cut].split("-"), stream[cut + 1 :].split("-")
    if not all(_known(p, hot) for p in left[:-1] + right[1:]):
        return None
    if left[-1] + right[0] in hot:
        return ""
    return "-" if f"{left[-1]}-{right[0]}" in hot and stream[cut] != HANGING else None


def _between(a: Chunk, b: Chunk, page: Page) -> str:
    """Separator between two neighbouring chunks."""
    line, _, end, _ = a.parts[-1]
    other, start, _, _ = b.parts[0]
    if b.whole[0].isdigit() or a.whole[-1].isdigit() or b.whole[0] == "-" or a.whole[-1] == "-":
        return APART
    if b.whole[0].isupper() and not (a.whole.isupper() and b.whole.isupper() and len(a.whole) > 1):
        return APART
    if line == other:
        return SPACE if page.lines[line][end:start] == " " else APART
    return APART if _ITEM.match(page.lines[other]) or _CLAUSE.match(page.lines[other]) else LINE


class Window(NamedTuple):
    """A chunk to decode with its neighbours: their stream and where the chunk is in it."""

    key: str
    chunks: tuple[Chunk, ...]
    starts: tuple[int, ...]


def windows(page: Page, chunks: list[Chunk | None], hot: dict[str, float]) -> Iterator[Window]:
    """Windows around all chunks that need decoding."""
    for at, chunk in enumerate(chunks):
        if chunk is None or chunk.frozen or _settled(chunk, hot) is not None:
            continue
        group = [chunk]
        signs: list[str] = []
        centre = 0
        before = chunks[at - 1] if at else None
        after = chunks[at + 1] if at + 1 < len(chunks) else None
        if before is not None and not before.frozen:
            group.insert(0, before)
            signs.append(_between(before, chunk, page))
            centre = 1
        if after is not None and not after.frozen:
            group.append(after)
            signs.append(_between(chunk, after, page))
        stream, starts = "", []
        for k, part in enumerate(group):
            starts.append(len(stream))
            stream += part.stream + (signs[k] if k < len(signs) else "")
        low = starts[centre]
        yield Window(f"{stream}\x1f{low}\x1f{low + len(chunk.stream)}", tuple(group), tuple(starts))


def _parts_of(key: str) -> tuple[str, int, int]:
    stream, low, high = key.split("\x1f")
    return stream, int(low), int(high)


def requests(key: str) -> list[str]:
    """Skeletons of the words that a window may hold without parting run-together words."""
    stream, low, high = _parts_of(key)
    out = set()
    chunk = stream[low:high]
    for part in re.split(f"[{_BREAKS}]", chunk):
        for piece in _PIECE.findall(part):
            out.update((piece, piece.strip(_PASSED), piece.lstrip("('"), piece.rstrip("!?')")))
    halves = re.split(f"[{_BREAKS}]", chunk)
    for a, b in zip(halves, halves[1:]):
        a, b = a.split("-")[-1], b.split("-")[0]
        out.update((a + b, f"{a}-{b}"))
    joined = re.sub(f"[{_BREAKS}]", "", chunk)
    out.add(joined)
    # words that a space or a line end parts, over one neighbour or both
    before = stream[:low]
    after = stream[high:]
    left = re.sub(f"[{_BREAKS}]", "", before[:-1]) if before[-1:] in (SPACE, LINE) and before else None
    right = re.sub(f"[{_BREAKS}]", "", after[1:]) if after[:1] in (SPACE, LINE) and after else None
    if left:
        out.add(left + joined)
    if right:
        out.add(joined + right)
    if left and right:
        out.add(left + joined + right)
    # neighbours are read too, lest their letters count as unknown
    for side in (before, after):
        out.update(_PIECE.findall(side))
        out.add(re.sub(f"[ \n\t{_BREAKS}]", "", side))
    return sorted({skeleton(x) for x in out if x})


def requests_within(chunk: str) -> list[str]:
    """Skeletons of all parts of a chunk's pieces that could be words run together."""
    out = set()
    for piece in _PIECE.findall(re.sub(f"[{_BREAKS}]", "", chunk)):
        n = len(piece)
        for a in range(n):
            for b in range(a + 3, min(n, a + 40) + 1):
                out.add(skeleton(piece[a:b]))
    return sorted(out)


class Reader:
    """Decodes windows with the words that were found for them."""

    def __init__(self, hot: dict[str, float], total: int, costs: Costs):
        self.hot, self.total, self.costs = hot, total, costs

    def rarity(self, words: list[tuple[str, int]]) -> dict[str, float]:
        return {w: self.costs.rarity * math.log(self.total / n) for w, n in words}

    def read(self, key: str, words: list[tuple[str, int]]) -> tuple[list[Token], bool]:
        """Tokens that touch the window's chunk; whether parting it could be cheaper still."""
        stream, low, high = _parts_of(key)
        rarity = self.rarity(words)
        for side in (stream[:low], stream[high:]):
            for piece in _PIECE.findall(side):
                bare = piece.strip(_PASSED)
                for x in (piece, bare):
                    if x in self.hot:
                        rarity[x] = self.hot[x]
            whole = re.sub(f"[ \n\t{_BREAKS}]", "", side)
            if whole in self.hot:
                rarity[whole] = self.hot[whole]
        for piece in _PIECE.findall(stream[low:high]):
            if piece in self.hot:
                rarity[piece] = self.hot[piece]
        cost, tokens = decode(stream, rarity, self.costs)
        least, _ = decode(stream[:low].rstrip(SPACE + LINE + APART), rarity, self.costs) if low else (0.0, None)
        rest = stream[high:].lstrip(SPACE + LINE + APART)
        more, _ = decode(rest, rarity, self.costs) if rest else (0.0, None)
        touching = [t for t in tokens if t.start < high and t.end > low]
        return touching, cost - least - more > self.costs.split

    def packed(self, tokens: list[Token]) -> str | None:
        return json.dumps(tokens, ensure_ascii=False) if tokens else None


def _unpacked(text: str) -> list[Token]:
    return [Token(a, b, w, tuple(g), tuple(map(tuple, h))) for a, b, w, g, h in json.loads(text)]


def apply_readings(page: Page, chunks: list[Chunk | None], readings: dict[str, str], hot: dict[str, float]) -> None:
    """Enter what the windows read into the page: broken lines, misread lines, repairs."""
    lines = set()
    for chunk in chunks:
        if chunk is None:
            continue
        lines.add(chunk.parts[0][0])
        if len(chunk.parts) < 2:
            continue
        joined = _settled(chunk, hot)
        if joined is None and chunk.frozen and not set(chunk.stream) & {DOUBTFUL, HANGING}:
            joined = ""
        if joined is not None:
            for (i, *_), (j, *_) in zip(chunk.parts, chunk.parts[1:]):
                page.hyphen.add(i)
                page.joined[i] = (j, joined)
    last = (-1, -1)  # end of the last token that was entered
    for window in windows(page, chunks, hot) if readings else ():
        text = readings.get(window.key)
        for token in _unpacked(text) if text is not None else ():
            start, end = _place(window, token.start), _place(window, token.end, True)
            if start < last:
                continue
            last = end
            page.glyph.update(_place(window, at)[0] for at in token.glyphs)
            for at, joiner in token.breaks:
                line = _place(window, at - 1)[0]
                page.hyphen.add(line)
                page.joined[line] = (_place(window, at + 1)[0], joiner)
            _enter(page, window, token, start, end)
    for i in lines:
        label = _LABEL.match(page.lines[i])
        if label and _misread_label(label[1], page.lines[i]):
            page.glyph.add(i)


def _place(window: Window, at: int, ends: bool = False) -> tuple[int, int]:
    """Line and column of a position in a window's stream."""
    k = max(k for k, s in enumerate(window.starts) if s < at + (not ends) or k == 0)
    return window.chunks[k].place(at - window.starts[k], ends)


def _enter(page: Page, window: Window, token: Token, start: tuple[int, int], end: tuple[int, int]) -> None:
    """Repairs of the lines that a token lies on."""
    stream, joiners = _parts_of(window.key)[0], dict(token.breaks)
    if token.word == "".join(joiners.get(at, stream[at]) for at in range(token.start, token.end)):
        return  # only a hyphen goes or stays
    first, last = page.lines[start[0]], page.lines[end[0]]
    if start[0] == end[0]:
        page.repairs.setdefault(start[0], []).append((start[1], end[1], _as_cased(token.word, first[start[1] : end[1]])))
        return
    # over line ends: the whole word goes to the first line
    original = first[start[1] :].rstrip(_DASH + " ") + last[: end[1]].lstrip()
    page.joined[start[0]] = (end[0], " " if last[end[1] : end[1] + 1].isspace() else "")
    page.repairs.setdefault(start[0], []).append((start[1], len(first), _as_cased(token.word, original)))
    page.repairs.setdefault(end[0], []).append((0, end[1], ""))


def _misread_label(raw: str, line: str) -> bool:
    if re.fullmatch(r"[\d.]+", raw):
        return False
    numeric = (
        re.search(r"\d", raw)
        or re.fullmatch(r"[lІIО]", raw) and re.match(r"\s*[#-]", line)
        or re.fullmatch(r"[lІIЗб][.,][lІIЗбО]", raw)
    )
    return bool(numeric) and not re.fullmatch(r"\d+", raw)


def _as_cased(read: str, chunk: str) -> str:
    letters = [c for c in chunk if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return read.upper()
    return read[:1].upper() + read[1:] if chunk[:1].isupper() else read


def paragraphs(page: Page, text_lines: list[int]) -> list[list[int]]:
    """Lines of each paragraph: the split of least cost.

    ``best[k]`` is the least cost of the first ``k`` lines as whole paragraphs;
    a paragraph costs what speaks against its start plus what speaks against
    each join inside it.
    """
    lines = page.lines
    n = len(text_lines)
    width = sorted(len(lines[i].rstrip()) for i in text_lines)[int(0.9 * (n - 1))] if n else 0
    apart, together = [0.0] * n, [0.0] * n
    for k in range(1, n):
        a, b = text_lines[k - 1], text_lines[k]
        before, after = lines[a].rstrip(), lines[b].lstrip()
        blank = any(not lines[x].strip() for x in range(a + 1, b))
        furniture = any(x in page.furniture for x in range(a + 1, b))
        block = before.lstrip()[:1] in "#|" or after[:1] in "#|"
        if block:
            together[k] += 20.0
        if a in page.joined and page.joined[a][0] == b:
            apart[k] += 30.0
        if before[-1:] not in ".;:!?":
            apart[k] += 3.0
        if after[:1].islower() and not _ITEM.match(after):
            apart[k] += 4.0
        if _CLAUSE.match(lines[b]) or _ITEM.match(lines[b]):
            together[k] += 6.0
        if blank:
            together[k] += 1.0 if furniture else 5.0
        if len(before) < 0.6 * width and before[-1:] in ".;:":
            together[k] += 2.0
        if not blank and not furniture and len(before) > 0.8 * width:
            apart[k] += 1.0
    best, start = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        inside = 0.0
        for begin in range(end - 1, -1, -1):
            cost = best[begin] + (apart[begin] if begin else 0.0) + inside
            if cost < best[end]:
                best[end], start[end] = cost, begin
            inside += together[begin]
            if inside > 40.0:
                break
    out, end = [], n
    while end:
        out.append(text_lines[start[end] : end])
        end = start[end]
    return out[::-1]


#: Stamps that a scanned page may bear; a parameter, since they are set words.
STAMPS = re.compile(r"Копия верна\b", re.I)


def _page_of(text: str, stamps: re.Pattern) -> tuple[Page, list[int], list[Chunk | None]]:
    page = Page(text.split("\n"))
    find_furniture(page, stamps)
    text_lines = [i for i, x in enumerate(page.lines) if x.strip() and i not in page.furniture]
    return page, text_lines, chunks_of(page, text_lines)


def asks(text: str, hot: dict[str, float], stamps: re.Pattern = STAMPS) -> set[str]:
    """Keys of the windows of a text that need decoding."""
    page, _, chunks = _page_of(text, stamps)
    return {w.key for w in windows(page, chunks, hot)}


def repair(
    text: str, readings: dict[str, str], hot: dict[str, float], stamps: re.Pattern = STAMPS
) -> tuple[str, list[tuple[int, str]]]:
    """Repaired text (paragraphs parted by blank lines) and findings ``(line, kind)``."""
    page, text_lines, chunks = _page_of(text, stamps)
    apply_readings(page, chunks, readings, hot)
    found = [(i, "furniture") for i in sorted(page.furniture)]
    found += [(i, "hyphen") for i in sorted(page.hyphen)] + [(i, "glyph") for i in sorted(page.glyph)]
    out = []
    for group in paragraphs(page, text_lines):
        joined = ""
        for i in group:
            line = page.lines[i]
            for start, end, read in sorted(page.repairs.get(i, ()), reverse=True):
                line = line[:start] + read + line[end:]
            line = line.strip()
            if i in page.joined and page.joined[i][0] in group:
                joined += line.rstrip(_DASH + " ") + page.joined[i][1]
            else:
                joined += line + " "
        joined = joined.rstrip()
        label = _LABEL.match(joined)
        if label and re.search(r"\d", label[1]) and not re.fullmatch(r"[\d.]+", label[1]):
            joined = joined[: label.start(1)] + _number(label[1]) + joined[label.end(1) :]
        out.append(joined)
    return "\n\n".join(out), found


def _number(label: str) -> str:
    return label.translate(str.maketrans("ОоOoІіIlЗзбSВ|!,", "0000111133658" + "11."))


@F.arrow_udf(T.StringType())
def _skeletons(words: pa.Array) -> pa.Array:
    return pa.array([skeleton(w) for w in words.to_pylist()], pa.string())


@F.arrow_udf(T.ArrayType(T.StringType()))
def _requests(keys: pa.Array) -> pa.Array:
    return pa.array([requests(k) for k in keys.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.ArrayType(T.StringType()))
def _requests_within(chunks: pa.Array) -> pa.Array:
    return pa.array([requests_within(c) for c in chunks.to_pylist()], pa.list_(pa.string()))


def vocabulary(clean: DataFrame, text: str, least: int = 3) -> DataFrame:
    """Words of at least ``least`` texts, in one script each: ``word``, ``n``, ``skeleton``."""
    mixed = F.col("word").rlike("[a-z]") & F.col("word").rlike(r"[^\x00-\x7f]")
    words = words_of_texts(clean, text).where(F.col("n") >= least).where(~mixed)
    return words.withColumn("skeleton", _skeletons("word"))


def repair_documents(
    scanned: DataFrame,
    key: str,
    text: str,
    clean: DataFrame,
    clean_text: str,
    costs: Costs = Costs(),
    hot_words: int = 50_000,
    stamps: re.Pattern = STAMPS,
) -> DataFrame:
    """``key``, ``repaired`` and ``found`` (array of line_no, kind) of scanned texts.

    The vocabulary is that of ``clean``: words in at least three of its texts, at every
    size.  It stays a table; only its ``hot_words`` most frequent words travel to the
    workers, to tell early which chunks need no look-up (with any other number of them
    the rows are the same).  Null texts give null and no findings, empty ones are empty;
    repeated keys give one row each.
    """
    spark = scanned.sparkSession
    known = materialise(vocabulary(clean, clean_text))
    total = known.agg(F.sum("n")).first()[0] or 1
    top = known.orderBy(F.desc("n"), "word").limit(hot_words).select("word", "n").collect()
    hot = {r.word: costs.rarity * math.log(total / r.n) for r in top}
    shared = spark.sparkContext.broadcast(hot)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids, keys = [], []
                for t, s in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = sorted(asks(s, shared.value, stamps))
                    ids.extend([t] * len(found))
                    keys.extend(found)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string())], names=["t", "k"])

    @F.arrow_udf("struct<reading:string,more:boolean>")
    def read(keys: pa.Array, words: pa.Array) -> pa.Array:
        reader = Reader(shared.value, total, costs)
        readings, more = [], []
        for k, ws in zip(keys.to_pylist(), words.to_pylist()):
            tokens, cheaper = reader.read(k, [(w["word"], w["n"]) for w in ws])
            readings.append(reader.packed(tokens))
            more.append(cheaper)
        return pa.StructArray.from_arrays([pa.array(readings, pa.string()), pa.array(more)], names=["reading", "more"])

    place = F.xxhash64(F.lit("text"), text)
    asked = materialise(
        scanned.where(F.col(text) != "").select(place.alias("t"), text).mapInArrow(ask, "t long, k string")
    )
    words = known.select("skeleton", F.struct("word", "n").alias("w"))
    first = materialise(
        asked.select("k").distinct()
        .select("k", F.explode(_requests("k")).alias("skeleton"))
        .join(words, "skeleton", "left")
        .groupBy("k").agg(F.collect_set("w").alias("ws"))
        .select("k", "ws", read("k", "ws").alias("r"))
    )
    # where parting a chunk could be cheaper, all words inside it are looked up
    centre = F.expr("substring(k, cast(split(k, '\x1f')[1] as int) + 1, cast(split(k, '\x1f')[2] as int) - cast(split(k, '\x1f')[1] as int))")
    open_ = first.where("r.more").select("k", "ws", centre.alias("c"))
    inside = (
        open_.select("c").distinct()
        .select("c", F.explode(_requests_within("c")).alias("skeleton"))
        .join(words, "skeleton")
        .groupBy("c").agg(F.collect_set("w").alias("inside"))
    )
    second = open_.join(inside, "c", "left").select(
        "k", read("k", F.array_union("ws", F.coalesce("inside", F.array().cast("array<struct<word:string,n:bigint>>")))).alias("r")
    )
    readings = (
        first.where("not r.more").select("k", F.col("r.reading").alias("reading"))
        .unionByName(second.select("k", F.col("r.reading").alias("reading")))
        .where("reading is not null")
    )
    of_text = asked.distinct().join(readings, "k").groupBy("t").agg(F.collect_list(F.struct("k", "reading")).alias("_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line_no", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts, found = [], []
                for t, r in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    known_readings = {x["k"]: x["reading"] for x in r or ()}
                    fixed, marks = (t, []) if not t else repair(t, known_readings, shared.value, stamps)
                    texts.append(fixed)
                    found.append([{"line_no": i, "kind": k} for i, k in marks])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(found, kind)],
                    names=[key, "repaired", "found"],
                )

    kind = dict(scanned.dtypes)[key]
    return (
        scanned.select(F.col(key), F.col(text), place.alias("t"))
        .join(of_text, "t", "left")
        .select(key, text, "_r")
        .mapInArrow(run, f"`{key}` {kind}, repaired string, found array<struct<line_no:bigint,kind:string>>")
    )
