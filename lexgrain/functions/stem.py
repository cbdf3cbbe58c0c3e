"""Russian stems by the published Snowball algorithm, as a chain of columns.

Every step is a substitution at the end of the region behind the first vowel, so the whole
algorithm is a chain of regular expressions that stays in the JVM (and that SQL can repeat).
Where an ending must follow "а" or "я", that letter is matched too and put back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vowels and the endings of each class, as the algorithm lists them; those
#: under ``after`` must follow "а" or "я".
VOWELS = "аеиоуыэюя"
GERUND = {"after": "в вши вшись", "free": "ив ивши ившись ыв ывши ывшись"}
ADJECTIVE = {"free": "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею"}
PARTICIPLE = {"after": "ем нн вш ющ щ", "free": "ивш ывш ующ"}
REFLEXIVE = {"free": "ся сь"}
VERB = {
    "after": "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно",
    "free": "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю",
}
NOUN = {"free": "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я"}
SUPERLATIVE = {"free": "ейш ейше"}
DERIVATIONAL = {"free": "ост ость"}


def ending(kind: dict[str, str]) -> str:
    """Pattern of the longest ending of a class; group 1 is the letter to put back."""
    longest = lambda words: "|".join(sorted(words.split(), key=lambda w: (-len(w), w)))
    free = f"(?:{longest(kind['free'])})"
    return f"(?:{free}|([ая])(?:{longest(kind['after'])}))$" if "after" in kind else f"{free}$"


HEAD = f"^[^{VOWELS}]*[{VOWELS}]"
R2 = f"^(?:[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]){{2}}"


def with_stem(words: DataFrame, word: str, name: str) -> DataFrame:
    """Table with the stem of each lower-case word; words without a Russian vowel stay as they are.

    Each step is a column of its own, so that no expression holds another one several
    times over.
    """

    def less(text: str, kind: dict[str, str]) -> Column:
        return F.regexp_replace(text, ending(kind), "$1" if "after" in kind else "")

    def step(df: DataFrame, **columns: Column) -> DataFrame:
        return df.select("_row", *[c for c in df.columns if c != "_row" and c not in columns], *[c.alias(n) for n, c in columns.items()])

    rows = F.struct(*words.columns) if words.columns else F.struct()
    df = words.select(rows.alias("_row"), F.translate(word, "ё", "е").alias("p"))
    df = step(df, h=F.regexp_extract("p", HEAD, 0), region=F.length(F.regexp_extract("p", R2, 0)))
    df = step(df, r=F.substring("p", F.length("h") + 1, F.length("p")))
    df = step(df, gerund=less("r", GERUND), bare=less("r", REFLEXIVE))
    df = step(df, adjective=less("bare", ADJECTIVE), verb=less("bare", VERB), noun=less("bare", NOUN))
    inflected = (
        F.when(F.col("gerund") != F.col("r"), F.col("gerund"))
        .when(F.col("adjective") != F.col("bare"), less("adjective", PARTICIPLE))
        .when(F.col("verb") != F.col("bare"), F.col("verb"))
        .otherwise(F.col("noun"))
    )
    df = step(df, x=inflected)
    df = step(df, x=F.regexp_replace("x", "и$", ""))
    df = step(df, d=less("x", DERIVATIONAL))
    in_r2 = (F.col("region") > 0) & (F.length("h") + F.length("d") >= F.col("region"))
    df = step(df, y=F.when(in_r2, F.col("d")).otherwise(F.col("x")))
    df = step(df, u=less("y", SUPERLATIVE))
    tidy = (
        F.when(F.col("u") != F.col("y"), F.regexp_replace("u", "нн$", "н"))
        .when(F.endswith("y", F.lit("нн")), F.regexp_replace("y", "нн$", "н"))
        .otherwise(F.regexp_replace("y", "ь$", ""))
    )
    done = F.when(F.col("h") == "", F.col("p")).otherwise(F.concat("h", tidy))
    # never null, so that no test for it is pushed down through all the steps; a null word has an empty stem
    return df.select("_row.*", F.coalesce(done, F.lit("")).alias(name))
