"""Text functions as Column builders, and the regular expressions behind them.

White space, digits and letters are written as Unicode classes, so that a pattern
means the same in the JVM's regular expressions as in others.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode sees it.
WS = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
NOT_WS = WS.replace("[", "[^", 1)
#: The same characters one by one.
WS_CHARS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DIGIT = r"\p{Nd}"
LETTER = r"[\p{L}\p{Nl}\p{No}]"
#: Letters read for digits in numbers, and the digits.
GLYPHS, GLYPH_DIGITS = "OoОоlI|іЗзSsб", "0000111133556"
#: Of these, the bar is table markup and detects nothing.
_DETECT = "OoОоlIіЗзSsб"
#: A part of a number that may hold such letters, but has at least one digit.
PART = rf"[0-9{_DETECT}]*[0-9][0-9{_DETECT}]*"

#: Headings, their numbers, titles of tables of contents.
HEADING = rf"(?s)^{WS}{{0,3}}(#{{1,6}}){WS}+({NOT_WS}.*)$"
WORD_KEY = rf"(?i)^{WS}*(?:статья|глава|раздел|СТАТЬЯ|ГЛАВА|РАЗДЕЛ){WS}+({PART})"
NUMBER_KEY = rf"^{WS}*({PART}(?:{WS}*[.,]{WS}*{PART})*)"
TOC_TITLE = rf"^(?:содержание|оглавление|contents|table{WS}+of{WS}+contents)(?:{WS}|[:.])*$"


def _number(part: str, between: str) -> str:
    """Group of a dotted number: two to five parts."""
    return f"({part}(?:{between}{part}){{1,4}})"


def _line(*parts: str) -> str:
    return "^" + "".join(parts)


# what a line that opens a clause is made of
_INDENT, _GAP = rf"{WS}{{0,3}}", rf"{WS}+"
_BULLET, _BOLD = rf"[-*]{_GAP}", rf"(?:\*{{1,2}}{WS}*)?"
_DIGITS, _ANY_PART = rf"{DIGIT}+", PART
_LOOSE_DOT, _LOOSE_MARK = rf"{WS}*\.{WS}*", rf"{WS}*[.,]{WS}*"
_UNBOLD = r"(?:\*{1,2})?"
_TEXT = rf"(?:{_GAP}{NOT_WS}|{LETTER})"
#: Lines that open a clause: closed by a dot or bracket before text, bulleted without
#: punctuation, first cell of a table row.  Group 1 is the number.
CLAUSE_LINES = (
    _line(_INDENT, f"(?:{_BULLET})?", _BOLD, _number(_DIGITS, _LOOSE_DOT), rf"{WS}*[.)]", _UNBOLD, _TEXT),
    _line(_INDENT, _BULLET, _number(_DIGITS, r"\."), _GAP, NOT_WS),
    _line(rf"{WS}*\|{WS}*", _BOLD, _number(_DIGITS, r"\."), rf"(?:{WS}*[.)])?", _GAP, rf"[^|]*{LETTER}"),
)
#: The first two with misread digits and commas.
CLAUSE_LINES_MISREAD = (
    _line(_INDENT, f"(?:{_BULLET})?", _BOLD, _number(_ANY_PART, _LOOSE_MARK), rf"{WS}*[.,)]", _UNBOLD, _TEXT),
    _line(_INDENT, _BULLET, _number(_ANY_PART, "[.,]"), _GAP, NOT_WS),
)
#: A line up to its number and a bracket, for telling "1.2)" from "1.2.".
CLOSED_BY_BRACKET = _line(rf"{WS}*", f"(?:{_BULLET})?", _BOLD, rf"(?:[0-9{_DETECT}]|{DIGIT}|[.,]|{WS})*\)")
LEADING_ZERO = rf"(?:^|\.){WS}*0{DIGIT}"
#: A number that needs no repair.
CLEAN_NUMBER = rf"^(?!0{DIGIT}){DIGIT}+(?:\.(?!0{DIGIT}){DIGIT}+)*\z"
TOKEN = r"[\p{L}\p{N}_]+"
#: Lines of page furniture in chunking, and those that a preview skips.
NOISE_CHUNK = rf"(?is)^{WS}*(?:---{WS}*Page{WS}+{DIGIT}+.*|Total pages:.*|<!--.*-->){WS}*$"
NOISE_PREVIEW = rf"(?is)^{WS}*(?:---{WS}*page{WS}+{DIGIT}+{WS}*/{WS}*{DIGIT}+{WS}*---|<!--.*-->|-{{3,}}|\|.*|total{WS}+pages:.*){WS}*$"


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def strip(text: Column | str) -> Column:
    """Without white space at both ends."""
    return F.trim(_c(text), F.lit(WS_CHARS))


def strip_left(text: Column | str) -> Column:
    """Without white space at the beginning."""
    return F.ltrim(_c(text), F.lit(WS_CHARS))


def squeeze(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(_c(text), rf"{WS}+", " "))


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(TOKEN), F.lit(0))


def repair_number(raw: Column | str) -> Column:
    """Number in digits and dots from one with misread digits; "" if it is none.

    White space goes, commas are dots, look-alike letters digits.  Without a real
    digit, with anything else in it, or with a part that has a leading zero
    (a date, an amount) the result is empty.
    """
    raw = _c(raw)
    bare = F.regexp_replace(raw, rf"{WS}+", "")
    mapped = F.translate(bare, "," + GLYPHS, "." + GLYPH_DIGITS)
    dotted = F.regexp_replace(F.regexp_replace(mapped, r"\.{2,}", "."), r"^\.+|\.+$", "")
    good = raw.rlike(DIGIT) & dotted.rlike(rf"^{DIGIT}+(?:\.{DIGIT}+)*$") & ~dotted.rlike(LEADING_ZERO)
    return F.when(raw.rlike(CLEAN_NUMBER), raw).when(good, dotted).otherwise(F.lit(""))


def section_key(title: Column | str) -> Column:
    """Number of a heading: after a word for article, chapter or section, else at its start."""
    title = _c(title)
    by_word = F.regexp_extract(title, WORD_KEY.replace("(?i)", "(?iu)"), 1)
    by_number = F.regexp_extract(title, NUMBER_KEY, 1)
    return F.when(by_word != "", repair_number(by_word)).otherwise(repair_number(by_number))


def is_toc_title(title: Column | str) -> Column:
    return F.lower(strip(title)).rlike(TOC_TITLE)


def is_numbered(key: Column | str) -> Column:
    """Whether a section key is a number rather than empty or made up."""
    return (_c(key) != "") & ~_c(key).startswith("§")


def is_descendant(key: Column | str, parent: Column | str) -> Column:
    """Whether a dotted key is the parent itself or below it."""
    key, parent = _c(key), _c(parent)
    return (key != "") & (parent != "") & ((key == parent) | F.startswith(key, F.concat(parent, F.lit("."))))


def family(key: Column | str) -> Column:
    """The key without its last part, if it has more than one."""
    return F.regexp_replace(_c(key), r"\.[^.]*$", "")


def ancestors(key: Column | str) -> Column:
    """``a.b.c`` as ``[a, a.b, a.b.c]``; empty for an empty key."""
    parts = F.split(_c(key), r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.when(_c(key) == "", F.array().cast("array<string>")).otherwise(chain)


def shorten(text: Column | str, most: int) -> Column:
    """At most ``most`` characters and an ellipsis, cut at a space in the second half."""
    clean = squeeze(text)
    head = F.substring(clean, 1, most)
    back = F.locate(" ", F.reverse(head))
    space = F.when(back == 0, F.lit(-1)).otherwise(F.lit(most) - back)
    cut = F.when(space > most // 2, space).otherwise(F.lit(most))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.substring(clean, F.lit(1), cut), F.lit("…")))


def is_poor_title(title: Column | str) -> Column:
    """Whether a title has fewer than three letters."""
    return F.length(F.regexp_replace(_c(title), r"[^\p{L}\p{Nl}\p{No}]", "")) < 3


def number_sort_key(number: Column | str) -> Column:
    """Parts of a dotted number as integers, others as 0."""
    return F.transform(
        F.split(_c(number), r"\."), lambda p: F.coalesce(F.when(p.rlike("^[0-9]{1,9}$"), p).cast("int"), F.lit(0))
    )


def page_selection(spec: Column | str, total: Column | str) -> Column:
    """Pages of a selector such as ``1,3,5-8`` within 1 .. total, ascending, once each.

    Parts that are neither a number nor a range are skipped, so are ranges that
    run backwards.
    """
    total = _c(total)
    parts = F.transform(F.split(_c(spec), ","), lambda p: F.trim(p))

    def pages(p: Column) -> Column:
        low = F.regexp_extract(p, r"^([0-9]{1,9})\s*(?:-\s*[0-9]{1,9})?$", 1)
        high = F.regexp_extract(p, r"^[0-9]{1,9}\s*-\s*([0-9]{1,9})$", 1)
        a = F.greatest(F.lit(1), low.try_cast("int"))
        b = F.least(total, F.when(high == "", low.try_cast("int")).otherwise(high.try_cast("int")))
        single = (high == "") & (low.try_cast("int") < 1)
        fits = (low != "") & (b >= a) & ~single
        return F.when(fits, F.sequence(a, F.when(fits, b).otherwise(a))).otherwise(F.array().cast("array<int>"))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, pages))))
