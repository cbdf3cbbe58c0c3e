"""Mapping of freely typed entries to a reference list.

Each distinct token is joined to the tokens of the reference list over keys that close
tokens share (what deleting up to two letters leaves of their beginnings) and kept where the
edit distance, with transpositions, is small.  Corrected tokens are combined by soft
TF-IDF: the cosine of the typed and the listed entry, each token weighted by its rarity in
the list and by its similarity.  A deputy or a committee of a body has a token that no entry
explains, so it is close to none.  Entries without a match are tried as abbreviations and
as run-together words; both find their candidates by equi-joins on keys that the list's
entries generate, and no value is held against the whole list.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrain.runtime import materialise

#: Latin letters that look like Cyrillic ones, typed by mistake.
_LOOKALIKE = str.maketrans("ABCEHKMOPTXYaceopxyk", "АВСЕНКМОРТХУасеорхук")
_DIGIT_LETTERS = str.maketrans("036", "озб")
#: Romanisation of Russian, longest first.
ROMAN = [
    ("shch", "щ"), ("zh", "ж"), ("kh", "х"), ("ts", "ц"), ("ch", "ч"), ("sh", "ш"),
    ("yu", "ю"), ("ya", "я"), ("yo", "е"), ("yy", "ый"), ("iy", "ий"), ("ey", "ей"), ("oy", "ой"), ("ay", "ай"),
    ("a", "а"), ("b", "б"), ("v", "в"), ("g", "г"), ("d", "д"), ("e", "е"), ("z", "з"),
    ("i", "и"), ("y", "ы"), ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"),
    ("r", "р"), ("s", "с"), ("t", "т"), ("u", "у"), ("f", "ф"), ("h", "х"), ("j", "й"), ("c", "к"),
    ("w", "в"), ("x", "кс"), ("q", "к"), ("'", "ь"),
]
_CYRILLIC_LETTER = re.compile("[а-яё]", re.I)
_MIXED_DIGIT = re.compile(r"(?<=[а-яё])[036]|[036](?=[а-яё])", re.I)
#: Endings of Russian nouns and adjectives, for comparing stems.
_ENDING = re.compile(r"(?:ого|его|ому|ему|ыми|ими|ами|ями|ый|ий|ой|ая|яя|ое|ее|ые|ие|ых|их|ым|им|ом|ем|ую|юю|ов|ев|ей|ия|ии|ию|ах|ях|ам|ям|а|я|о|е|ы|и|у|ю|ь)$")


@dataclass(frozen=True)
class Rules:
    """What surrounds an entry without being part of it, and the limits of likeness."""

    #: Patterns (lower case) that are blanked out of an entry before it is compared.
    noise: tuple[str, ...] = ()
    #: Tokens in other words: what a token stands for.
    synonyms: dict[str, str] = field(default_factory=dict)
    #: A token may be corrected at this similarity, an entry accepted at that.
    token_similarity: float = 0.58
    entry_similarity: float = 0.8
    #: Of a run-together entry and the joined words of a listed one.
    joined_similarity: float = 0.75


def stem(token: str) -> str:
    """Token without its ending, if at least three letters stay."""
    short = _ENDING.sub("", token)
    return short if len(short) >= 3 else token


def distance(a: str, b: str) -> int:
    """Edits from ``a`` to ``b``: insertions, deletions, substitutions, transpositions."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


def similarity(a: str, b: str) -> float:
    """1 for equal tokens or stems, less with each edit."""
    if a == b:
        return 1.0
    whole = 1 - distance(a, b) / max(len(a), len(b), 1)
    sa, sb = stem(a), stem(b)
    if sa == sb:
        return max(whole, 0.97)
    return max(whole, 0.97 - distance(sa, sb) / max(len(sa), len(sb)))


def clean(value: str | None, rules: Rules) -> str:
    """One consistent form: composed, one alphabet, lower case, without what surrounds it."""
    if value is None:
        return ""
    text = unicodedata.normalize("NFKC", value)
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    text = re.sub(r"\s+", " ", text)
    words = re.split(r"([^\w'])", text)
    for i, word in enumerate(words):
        if _CYRILLIC_LETTER.search(word):
            word = word.translate(_LOOKALIKE)
            word = _MIXED_DIGIT.sub(lambda m: m[0].translate(_DIGIT_LETTERS), word)
        elif re.fullmatch(r"[A-Za-z']{3,}", word):
            word = word.lower()
            for latin, letter in ROMAN:
                word = word.replace(latin, letter)
        words[i] = word
    text = "".join(words).lower().replace("ё", "е")
    for pattern in rules.noise:
        text = re.sub(pattern, " ", text)
    return re.sub(r"\s+", " ", text).strip(" ;,'\"«»*[]—–-")


def tokens_of(cleaned: str, rules: Rules) -> list[str]:
    return [rules.synonyms.get(t, t) for t in re.findall(r"[^\W_]+", cleaned)]


def letters(cleaned: str, rules: Rules) -> str:
    """Letters of an entry; a synonym at its beginning counts as the beginning of its word."""
    for short, full in rules.synonyms.items():
        if cleaned.startswith(short) and len(cleaned) > len(short):
            cleaned = full[:3] + cleaned[len(short) :]
    return "".join(re.findall(r"[^\W\d_]", cleaned))


def _deletes(text: str, most: int) -> set[str]:
    found = level = {text}
    for _ in range(most):
        level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
        found = found | level
    return found


#: Letters of a token's beginning that its keys are made of.
KEY_LETTERS = 8


def keys_of(token: str) -> list[str]:
    """Keys of a token: its stem and itself, each with up to two letters of the beginning deleted.

    Of tokens at an edit distance of two, or two exchanges of neighbours, some keys are
    the same; of short tokens, fewer letters are deleted.
    """
    found = set()
    for form in {token, stem(token)}:
        found |= _deletes(form[:KEY_LETTERS], 0 if len(form) < 3 else 1 if len(form) < 5 else 2)
    return sorted(found)


def short_keys(words: tuple[str, ...]) -> list[str]:
    """Keys under which an entry's abbreviations are found: how its first words may begin."""
    if len(words) < 2:
        return []
    first, second = words[0], words[1][0]
    return sorted({f"1{first[0]}{second}", f"t{first[0]}{first[-1]}{second}", f"2{first[:2]}{second}"})


def short_requests(short: str) -> list[str]:
    """The keys of :func:`short_keys` that an entry must have for ``short`` to spell it."""
    out = {f"1{short[:2]}"}
    out |= {f"t{short[0]}{short[j - 1]}{short[j]}" for j in range(2, min(6, len(short)))}
    out |= {f"2{short[:2]}{short[j]}" for j in range(2, len(short))}
    return sorted(out)


def grams_of(text: str) -> set[str]:
    marked = f"^{text}$"
    return {marked[i : i + 3] for i in range(len(marked) - 2)}


def spells(short: str, words: tuple[str, ...]) -> int | None:
    """Letters left out if ``short`` is beginnings of all the words in order.

    After its beginning, a word may go on with its last letters (a contraction).
    None if it is not.
    """
    reach = {0: 0}  # letters of short used -> least letters left out
    for word in words:
        following: dict[int, int] = {}
        for used, left in reach.items():
            start = 0
            while start < len(word) and used + start < len(short) and short[used + start] == word[start]:
                start += 1
                for tail in range(0, min(4, len(word) - start) + 1):
                    end = used + start + tail
                    if tail and short[used + start : end] != word[len(word) - tail :]:
                        continue
                    cost = left + len(word) - start - tail
                    if end not in following or cost < following[end]:
                        following[end] = cost
        reach = following
        if not reach:
            return None
    return reach.get(len(short))


def _arrow_clean(rules: Rules):
    @F.arrow_udf("struct<cleaned:string,tokens:array<string>>")
    def run(values: pa.Array) -> pa.Array:
        cleaned = [clean(v, rules) for v in values.to_pylist()]
        tokens = [sorted(set(tokens_of(c, rules))) for c in cleaned]
        return pa.StructArray.from_arrays(
            [pa.array(cleaned, pa.string()), pa.array(tokens, pa.list_(pa.string()))],
            names=["cleaned", "tokens"],
        )

    return run


def _lists(of):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(values: pa.Array) -> pa.Array:
        return pa.array([sorted(of(v)) if v else [] for v in values.to_pylist()], pa.list_(pa.string()))

    return run


_arrow_keys, _arrow_short, _arrow_grams = _lists(keys_of), _lists(short_requests), _lists(grams_of)


@F.arrow_udf(T.DoubleType())
def _arrow_similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([similarity(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


@F.arrow_udf(T.IntegerType())
def _arrow_spells(short: pa.Array, words: pa.Array) -> pa.Array:
    return pa.array([spells(s, tuple(w)) for s, w in zip(short.to_pylist(), words.to_pylist())], pa.int32())


@F.arrow_udf(T.DoubleType())
def _arrow_joined(short: pa.Array, joined: pa.Array) -> pa.Array:
    return pa.array(
        [1 - distance(a, b) / max(1, len(b)) for a, b in zip(short.to_pylist(), joined.to_pylist())], pa.float64()
    )


#: Reference entries are kept by every worker; this is the checked size of their list.
REFERENCE_ROWS = 100_000


class Reference:
    """Entries of the reference list with the weights of their tokens."""

    def __init__(self, rows: list[tuple[int, str, str]], rules: Rules):
        self.rules = rules
        self.entries: dict[int, tuple[str, tuple[str, ...]]] = {}
        for ref, kind, name in rows:
            words = tuple(tokens_of(clean(name, rules), rules))
            if words:
                self.entries[ref] = (kind, words)
        self.having: dict[str, list[int]] = {}
        for ref, (_, words) in self.entries.items():
            for word in set(words):
                self.having.setdefault(word, []).append(ref)
        n = len(self.entries)
        self.weight = {w: math.log1p(n / len(refs)) for w, refs in self.having.items()}
        self.heaviest = math.log1p(n)
        self.norm = {
            ref: math.sqrt(sum(self.weight[w] ** 2 for w in set(words))) for ref, (_, words) in self.entries.items()
        }

    def best(self, fixed: dict[str, list[tuple[str, float]]], hint: str) -> tuple[int, float] | None:
        """Entry with the largest soft TF-IDF, and it.

        ``fixed``: for each typed token the list's words that it may be, with their
        similarities; a token without any has the weight of a word of one entry.  Entries
        are looked up by the heaviest tokens only: what the others weigh together
        is not enough for a match.
        """
        least = self.rules.entry_similarity
        weight = {}
        for token, words in fixed.items():
            near = max(words, key=lambda x: (x[1], x[0]), default=None)
            weight[token] = self.weight[near[0]] if near else self.heaviest
        whole = math.sqrt(sum(w * w for w in weight.values()))
        refs: set[int] = set()
        left = whole * whole
        for token in sorted(fixed, key=lambda t: (-weight[t], t)):
            if math.sqrt(max(0.0, left)) < least * whole:
                break
            refs.update(ref for word, _ in fixed[token] for ref in self.having[word])
            left -= weight[token] ** 2
        options = []
        near = {t: dict(words) for t, words in fixed.items()}
        for ref in refs:
            kind, words = self.entries[ref]
            total = 0.0
            for token, words_of_token in near.items():
                s, w = max(((words_of_token[w], w) for w in words if w in words_of_token), default=(0.0, ""))
                if s:
                    total += s * weight[token] * self.weight[w]
            score = round(total / (whole * self.norm[ref]), 6)
            if score >= least:
                options.append((score, kind == hint, -ref))
        return (-max(options)[2], max(options)[0]) if options else None


def map_to_reference(
    values: DataFrame,
    value: str,
    reference: DataFrame,
    ref_id: str,
    ref_name: str,
    rules: Rules | None = None,
    hint: str | None = None,
    ref_hint: str | None = None,
) -> DataFrame:
    """Reference entry of each distinct value.

    Result: ``value`` (and ``hint`` if given), ``ref_id`` (null: names none),
    ``similarity``.  A hint (a kind of entry) only decides between entries that
    match equally well; otherwise the lower id wins.  Of several entries that an
    abbreviation may stand for, the one wins that the values write out most often.  Null and
    blank values give no rows.  Null names are no entries; an empty reference list
    matches none.
    """
    rules = rules or Rules()
    spark = values.sparkSession
    listed = reference.select(
        F.col(ref_id).cast("long"), (F.col(ref_hint) if ref_hint else F.lit("")), F.col(ref_name)
    ).where(F.col(ref_name).isNotNull())
    rows = [tuple(r) for r in listed.limit(REFERENCE_ROWS + 1).collect()]
    if len(rows) > REFERENCE_ROWS:
        raise ValueError(f"the reference list has more than {REFERENCE_ROWS} rows")
    book = Reference(rows, rules)
    words = spark.createDataFrame([(w,) for w in book.having], "_word string")
    tidy = _arrow_clean(rules)
    forms = materialise(
        values.select(F.col(value).alias("_v"), (F.col(hint) if hint else F.lit("")).alias("_h"))
        .where(F.col("_v").isNotNull() & F.col("_v").rlike(r"[^\s\u00a0]"))
        .distinct()
        .select("_v", "_h", tidy("_v").alias("_c"))
        .select("_v", "_h", "_c.cleaned", "_c.tokens")
    )
    # distinct tokens against the vocabulary, over what deletions leave
    fixed = (
        forms.select(F.explode("tokens").alias("_t"))
        .distinct()
        .withColumn("_p", F.explode(_arrow_keys("_t")))
        .join(words.withColumn("_p", F.explode(_arrow_keys("_word"))), "_p")
        .select("_t", "_word")
        .distinct()
        .withColumn("_s", _arrow_similarity("_t", "_word"))
        .where(F.col("_s") >= rules.token_similarity)
        .groupBy("_t")
        .agg(F.sort_array(F.collect_list(F.struct("_word", "_s"))).alias("_near"))
    )
    gathered = (
        forms.select("_v", "_h", "cleaned", F.explode_outer("tokens").alias("_t"))
        .join(fixed, "_t", "left")
        .groupBy("_v", "_h", "cleaned")
        .agg(F.collect_list(F.struct("_t", "_near")).alias("_tokens"))
    )
    shared = spark.sparkContext.broadcast(book)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, cleaned, tokens = (batch.column(i).to_pylist() for i in range(1, 4))
            found = []
            for kind, near in zip(kinds, tokens):
                typed = {x["_t"]: [(y["_word"], y["_s"]) for y in x["_near"] or []] for x in near if x["_t"]}
                found.append((shared.value.best(typed, kind) if typed else None) or (None, None))
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([letters(c, rules) for c in cleaned], pa.string()),
                pa.array([" " not in c for c in cleaned]),
                pa.array([x[0] for x in found], pa.int64()),
                pa.array([x[1] for x in found], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["_v", "_h", "_short", "_one", "_id", "_score"])

    chosen = materialise(
        gathered.mapInArrow(choose, "_v string, _h string, _short string, _one boolean, _id long, _score double")
    )
    rest = shorthand(chosen.where("_id is null"), book, values.select(F.col(value).alias("_name")), listed, rules)
    result = chosen.where("_id is not null").select("_v", "_h", "_id", "_score").unionByName(rest)
    columns = [F.col("_v").alias(value)]
    if hint:
        columns.append(F.col("_h").alias(hint))
    return result.select(*columns, F.col("_id").alias(ref_id), F.col("_score").alias("similarity"))


def shorthand(open_: DataFrame, book: Reference, names: DataFrame, listed: DataFrame, rules: Rules) -> DataFrame:
    """Entries (``_id``, ``_score``) that abbreviations and run-together spellings stand for.

    ``open_`` has ``_v``, ``_h``, ``_short`` (the letters) and ``_one`` (a single word); all
    its rows come back.  An abbreviation spells beginnings of all words of an entry.
    """
    spark = open_.sparkSession
    many = [(ref, kind, list(words)) for ref, (kind, words) in book.entries.items() if len(words) > 1]
    entries = spark.createDataFrame(many, "_ref long, _kind string, _words array<string>")
    keyed = spark.createDataFrame(
        [(k, ref) for ref, _, words in many for k in short_keys(tuple(words))], "_k string, _ref long"
    )
    # how often each entry is written out in full decides between abbreviations
    full = listed.toDF("_ref", "_kind", "_name").select("_ref", "_name")
    used = names.groupBy("_name").count().join(full, "_name").groupBy("_ref").agg(F.sum("count").alias("_used"))
    fits = F.struct(
        F.coalesce("_used", F.lit(0)).alias("u"), (F.col("_kind") == F.col("_h")).alias("h"), (-F.col("_left")).alias("l"), (-F.col("_ref")).alias("r")
    )
    total = F.aggregate("_words", F.lit(0), lambda n, w: n + F.length(w))
    spelled = (
        open_.where(F.length("_short") > 1)
        .select("_v", "_h", "_short", F.explode(_arrow_short("_short")).alias("_k"))
        .join(keyed, "_k")
        .select("_v", "_h", "_short", "_ref").distinct()
        .join(entries, "_ref")
        .withColumn("_left", _arrow_spells("_short", "_words"))
        .where("_left is not null")
        .join(used, "_ref", "left")
        .groupBy("_v", "_h").agg(F.max_by(F.struct("_ref", F.round(1 - F.col("_left") / total, 6).alias("_score")), fits).alias("_s"))
    )
    # run together with mistakes: of the grams of a joined name, the rarest that a match must keep
    joined = {ref: "".join(words) for ref, _, words in many}
    often: dict[str, int] = {}
    for name in joined.values():
        for gram in grams_of(name):
            often[gram] = often.get(gram, 0) + 1
    rare = []
    for ref, name in joined.items():
        edits = int((1 - rules.joined_similarity) * len(name))
        grams = sorted(grams_of(name), key=lambda g: (often[g], g))
        rare.extend((g, ref, name) for g in grams[: 3 * edits + 1])
    close = F.struct("_close", (F.col("_kind") == F.col("_h")).alias("h"), (-F.col("_ref")).alias("r"))
    together = (
        open_.where(F.col("_one") & (F.length("_short") > 1))
        .select("_v", "_h", "_short", F.explode(_arrow_grams("_short")).alias("_g"))
        .join(spark.createDataFrame(rare, "_g string, _ref long, _joined string"), "_g")
        .where(F.abs(F.length("_joined") - F.length("_short")) <= (1 - rules.joined_similarity) * F.length("_joined"))
        .select("_v", "_h", "_short", "_ref", "_joined").distinct()
        .withColumn("_close", _arrow_joined("_short", "_joined"))
        .where(F.col("_close") >= rules.joined_similarity)
        .join(entries.select("_ref", "_kind"), "_ref")
        .groupBy("_v", "_h").agg(F.max_by(F.struct("_ref", F.round("_close", 6).alias("_score")), close).alias("_j"))
    )
    found = F.coalesce("_s", "_j")
    return (
        open_.select("_v", "_h").join(spelled, ["_v", "_h"], "left").join(together, ["_v", "_h"], "left")
        .select("_v", "_h", found["_ref"].alias("_id"), found["_score"].alias("_score"))
    )
