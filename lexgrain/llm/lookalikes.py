"""One consistent form for text that looks the same in different characters.

Characters are composed, brought to ordinary width and stripped of invisible
ones by rule.  Words need the corpus: for each word in more than one script the
dominant script is determined and the look-alike letters of the others are
substituted, if the result is a word of the corpus; other words stay as they are, and
so do words in one script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrain.runtime import materialise

#: Letters that look alike in Latin, Cyrillic and Greek; "." where there is none.
_LATIN = "ABCEHIJKMOPSTXYaceijopsxyVbuknvg"
_CYRIL = "АВСЕНІЈКМОРЅТХУасеіјорѕху......."
_GREEK = "ΑΒϹΕΗΙ.ΚΜΟΡ.ΤΧΥαϲ.ι.ορ.χγ.βυκ.ν."
#: Greek letters that look like Cyrillic ones and like no Latin letter.
_GREEK_CYRILLIC = ("ΓΠΦκτωπ", "ГПФктшп")

_TO: dict[str, dict[str, str]] = {"LATIN": {}, "CYRILLIC": {}, "GREEK": {}}
for _rows in zip(_LATIN, _CYRIL, _GREEK):
    for _script, _letter in zip(_TO, _rows):
        if _letter != ".":
            _TO[_script].update({x: _letter for x in _rows if x not in (".", _letter)})
_TO["CYRILLIC"].update(zip(*_GREEK_CYRILLIC))
_TO["CYRILLIC"].update({"k": "к", "u": "и", "α": "а", "ο": "о", "ε": "е", "ρ": "р", "χ": "х", "Ӏ": "І"})
_TO["LATIN"].update({"Ӏ": "l", "α": "a", "ο": "o"})

#: Characters that stand for an ordinary hyphen.
_HYPHENS = "‐‑‒⁃−﹣－"
#: Letters that stand for digits in clause numbers.
_NUMBER_GLYPHS = str.maketrans("ОоOoІіIlЗзбSВ", "0000111133658")
_GLYPHS = "ОоOoІіIlЗзбSВ"
_DOTS = "․．。·"
_LABEL = re.compile(rf"^(\W*?)([0-9{_GLYPHS}]{{1,3}}(?:\.[0-9{_GLYPHS}]{{1,3}})+)(?=[.)*|\s]|$)")
_NUMBER = re.compile(rf"[0-9{_GLYPHS}]+(?:\.[0-9{_GLYPHS}]+)*\.?")
_WORD = re.compile(r"[^\W\d_]+")
#: Texts that may need repair hold a character outside this set ...
_ODD = re.compile(r"[^\n -~А-Яа-яЁё№§²½°…«»—]")
#: ... or Latin and Cyrillic side by side, or a letter in their number label.
_LATIN_LETTER = re.compile("[A-Za-z]")
_SIDE_BY_SIDE = re.compile("[A-Za-z][А-Яа-яЁё]|[А-Яа-яЁё][A-Za-z]")
_LABEL_SUSPECT = re.compile(rf"[^\w]*[0-9.]*[{_GLYPHS}][0-9{_GLYPHS}]{{0,2}}\.")


def suspect(text: str) -> bool:
    """Whether a text has anything that could be inconsistent."""
    return bool(
        _ODD.search(text)
        or _LABEL_SUSPECT.match(text)
        or (_LATIN_LETTER.search(text) and _SIDE_BY_SIDE.search(text))
    )


def _map_char(c: str) -> str:
    code = ord(c)
    if 0xFF01 <= code <= 0xFF5E or 0xFFE0 <= code <= 0xFFEE or 0x1D400 <= code <= 0x1D7FF or 0xFF61 <= code <= 0xFF9F:
        return unicodedata.normalize("NFKC", c)
    kind = unicodedata.category(c)
    if kind == "Nd":
        return str(unicodedata.digit(c))
    if kind == "Zs" or c == "\t":
        return " "
    if c in _HYPHENS:
        return "-"
    if kind == "Cf" or c in "͏ᅟᅠㅤ":
        return ""
    return c


class _Table(dict):
    """Translation table that is worked out character by character."""

    def __missing__(self, code: int) -> str:
        value = self[code] = _map_char(chr(code))
        return value


_CHARACTERS = _Table()


def plain_number(value: str) -> str:
    """A clause number in digits and dots; other values only in plain characters."""
    text = unicodedata.normalize("NFC", value.translate(_CHARACTERS)).strip()
    text = re.sub(rf"[{_DOTS}]", ".", text)
    if _NUMBER.fullmatch(text):
        return text.translate(_NUMBER_GLYPHS)
    return text


def plain_text(value: str) -> str:
    """Text with composed, ordinary, visible characters and a plain number label."""
    text = unicodedata.normalize("NFC", value.translate(_CHARACTERS)).replace("․", ".")
    label = _LABEL.match(text)
    if label and any(c.isdigit() for c in label[2]):
        text = label[1] + label[2].translate(_NUMBER_GLYPHS) + text[label.end(2) :]
    return text


def script_of(c: str) -> str:
    """Script of a letter, as far as scripts have look-alikes."""
    code = ord(c)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "LATIN"
    if 0x400 <= code < 0x530:
        return "CYRILLIC"
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "GREEK"
    return "OTHER"


def readings(word: str) -> list[str]:
    """Forms of a word of several scripts in one script, the dominant first.

    Empty for words of one script, of a single letter, and where no script has
    all letters.  A letter that only one script has decides for that script.
    """
    if len(word) < 2:
        return []
    scripts = [script_of(c) for c in word]
    kinds = set(scripts)
    # letters of other Cyrillic alphabets are mixed in just as those of other scripts
    foreign = kinds == {"CYRILLIC"} and any(c in "ІіЈЅ" for c in word)
    if "OTHER" in kinds or (len(kinds) == 1 and not foreign):
        return []
    forms = []
    for script in _TO:
        table = _TO[script]
        out = []
        for c, own in zip(word, scripts):
            if own == script and not (script == "CYRILLIC" and c in "ІіЈЅ"):
                out.append(c)
            elif c in table and own != script:
                out.append(table[c])
            else:
                break
        else:
            forms.append((-scripts.count(script), script, "".join(out)))
    return [f for _, _, f in sorted(forms) if f != word]


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Plain text and words of several scripts of each suspect text."""
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows = []
        for key, text in zip(keys, texts):
            if text and suspect(text):
                plain = plain_text(text)
                words = {w for w in _WORD.findall(plain) if not w.isascii() and readings(w)}
                rows.append((key, text, plain, sorted(words)))
        columns = list(zip(*rows)) if rows else [(), (), (), ()]
        kinds = (batch.schema.field(0).type, pa.string(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["_k", "_v", "_plain", "_words"]
        )


@F.arrow_udf(T.ArrayType(T.StringType()))
def _readings(words: pa.Array) -> pa.Array:
    return pa.array([readings(w) for w in words.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(T.StringType())
def _substitute(plain: pa.Array, old: pa.Array, new: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(plain.to_pylist(), old.to_pylist(), new.to_pylist()):
        if text is not None and a:
            table = dict(zip(a, b))
            text = _WORD.sub(lambda m: table.get(m[0], m[0]), text)
        out.append(text)
    return pa.array(out, pa.string())


@F.arrow_udf(T.StringType())
def _number(values: pa.Array) -> pa.Array:
    return pa.array([None if v is None else plain_number(v) for v in values.to_pylist()], pa.string())


def consistent_numbers(rows: DataFrame, key: str, number: str) -> DataFrame:
    """``key``, ``value``, ``consistent`` of numbers that are not plain already.

    Null numbers give no rows; an empty number is plain.
    """
    odd = rows.where(~F.col(number).rlike(r"^(?:[0-9]+(?:\.[0-9]+)*)?$"))
    return odd.select(F.col(key).alias(key), F.col(number).alias("value"), _number(number).alias("consistent"))


def vocabulary(rows: DataFrame, text: str) -> DataFrame:
    """Distinct lower-case words of a text column (column ``word``)."""
    words = F.explode(F.array_distinct(F.expr(f"regexp_extract_all(lower(`{text}`), '\\\\p{{L}}{{2,}}', 0)")))
    return rows.select(words.alias("word")).distinct()


def consistent_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``value``, ``consistent`` of texts that have anything to look at.

    Texts that are absent from the result are consistent; so are null and empty
    ones.  Repeated keys give one row each.  Words without a reading in one script
    that the corpus has (the vocabulary of ``rows``) stay as they are; of several
    readings that it has, the one in the dominant script wins.
    """
    kind = dict(rows.dtypes)[key]
    spelled = materialise(
        rows.select(key, text).mapInArrow(_spell, f"_k {kind}, _v string, _plain string, _words array<string>")
    )
    candidates = (
        spelled.select(F.explode("_words").alias("_w"))
        .distinct()
        .withColumn("_f", _readings("_w"))
        .select("_w", F.posexplode("_f").alias("_pos", "_form"))
        .withColumn("word", F.lower("_form"))
    )
    first = Window.partitionBy("_w").orderBy("_pos")
    chosen = (
        candidates.join(vocabulary(rows, text), "word")
        .withColumn("_rn", F.row_number().over(first))
        .where("_rn = 1")
        .select("_w", "_form")
    )
    repaired = (
        spelled.where(F.size("_words") > 0)
        .select("_k", "_v", "_plain", F.explode("_words").alias("_w"))
        .join(chosen, "_w", "left")
        .groupBy("_k", "_v", "_plain")
        .agg(F.collect_list(F.when(F.col("_form").isNotNull(), F.struct("_w", "_form"))).alias("_r"))
        .select("_k", "_v", _substitute("_plain", F.col("_r._w"), F.col("_r._form")).alias("_c"))
    )
    simple = spelled.where(F.size("_words") == 0).select("_k", "_v", F.col("_plain").alias("_c"))
    return (
        simple.unionByName(repaired)
        .select(F.col("_k").alias(key), F.col("_v").alias("value"), F.col("_c").alias("consistent"))
    )
