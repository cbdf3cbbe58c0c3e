"""Navigation by table of contents: previews, entries, outline, finding and reading sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as X
from lexgrain.operators import parse


def previews(of: DataFrame, sections: DataFrame, key: str, most: int = 80) -> DataFrame:
    """First line of text of each section: ``key``, ``line_start``, ``preview`` ("" if none).

    The next line of text after each line comes from one window over the document,
    read backwards; a section has it as preview if it still lies within.
    """
    text = ~F.col("line").rlike(rf"^{X.WS}*$") & ~F.col("line").rlike(X.NOISE_PREVIEW) & ~F.col("line").rlike(X.HEADING)
    below = Window.partitionBy(key).orderBy(F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    following = F.last(F.when(text, F.struct("line_no", "line")), ignorenulls=True).over(below)
    at = of.select(key, F.col("line_no").alias("line_start"), following.alias("_n"))
    first = sections.join(at, [key, "line_start"]).withColumn("_f", F.when(F.col("_n.line_no") < F.col("line_end"), F.col("_n.line")))
    bare = F.regexp_replace("_f", rf"^{X.WS}*[-*]{X.WS}+", "")
    return first.select(key, "line_start", F.coalesce(X.shorten(bare, most), F.lit("")).alias("preview"))


def home_sections(clauses: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """Numbered clauses with the section whose key is their longest ancestor, else their own section."""
    numbered = clauses.where("number <> ''").groupBy(key, "number", "section_key").agg(F.count("*").cast("int").alias("_c"))
    chain = numbered.select(key, "number", "section_key", "_c", F.explode(X.ancestors("number")).alias("_k"))
    keys = sections.select(key, F.col("section_key").alias("_k")).distinct().withColumn("_hit", F.lit(1))
    return (
        chain.join(keys, [key, "_k"], "left")
        .groupBy(key, "number", "section_key", "_c")
        .agg(F.max_by("_k", F.when(F.col("_hit") == 1, F.length("_k"))).alias("_h"))
        .select(
            key,
            F.explode(F.array_repeat("number", F.col("_c"))).alias("number"),
            F.coalesce("_h", "section_key").alias("section_key"),
        )
    )


def entries(docs: DataFrame, key: str, text: str, clauses: DataFrame, most: int = 80) -> DataFrame:
    """One row for each section: ``title`` (the preview where the title has no words),
    ``preview``, ``level``, ``clause_numbers`` in numeric order."""
    of = parse.lines(docs, key, text)
    sections = parse.sections(of, key)
    seen = previews(of, sections, key, most)
    grouped = (
        home_sections(clauses, sections, key)
        .groupBy(key, "section_key")
        .agg(F.array_sort(F.collect_list(F.struct(X.number_sort_key("number").alias("o"), "number"))).alias("_n"))
        .select(key, "section_key", F.transform("_n", lambda x: x["number"]).alias("clause_numbers"))
    )
    title = X.squeeze("title")
    return (
        sections.join(seen, [key, "line_start"])
        .join(grouped, [key, "section_key"], "left")
        .select(
            key,
            "line_start",
            "section_key",
            F.when(X.is_poor_title(title) & (F.col("preview") != ""), F.col("preview")).otherwise(title).alias("title"),
            "preview",
            "level",
            F.coalesce("clause_numbers", F.array().cast("array<string>")).alias("clause_numbers"),
        )
    )


def outline(of: DataFrame, key: str, preview: bool = False, clauses: bool = False, most: int = 14) -> DataFrame:
    """Readable outline of each document: ``key``, ``outline``."""
    line = F.concat(
        F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1)),
        F.when(F.col("section_key") != "", F.concat(F.lit("["), "section_key", F.lit("] "))).otherwise(""),
        "title",
    )
    if preview:
        more = (F.col("preview") != "") & (F.col("preview") != F.col("title"))
        line = F.concat(line, F.when(more, F.concat(F.lit(" — "), "preview")).otherwise(""))
    if clauses:
        n = F.size("clause_numbers")
        shown = F.array_join(F.slice("clause_numbers", 1, most), ", ")
        total = F.when(n > most, F.concat(F.lit(", … (всего "), n, F.lit(")"))).otherwise("")
        indent = F.repeat(F.lit("  "), F.greatest(F.lit(0), F.col("level") - 1))
        line = F.concat(line, F.when(n > 0, F.concat(F.lit("\n"), indent, F.lit("      пункты: "), shown, total)).otherwise(""))
    return (
        of.select(key, "line_start", line.alias("_l"))
        .groupBy(key)
        .agg(F.array_sort(F.collect_list(F.struct("line_start", "_l"))).alias("_o"))
        .select(
            key,
            F.concat(
                F.lit("=== "), F.col(key), F.lit(" ===\n"), F.array_join(F.transform("_o", lambda x: x["_l"]), "\n")
            ).alias("outline"),
        )
    )


def find(of: DataFrame, key: str, query: str, k: int = 3) -> DataFrame:
    """Sections by exact key (1.0), part of the title (0.5) or of the preview (0.3).

    Pass entries with longer previews (300 characters) than those displayed.
    """
    wanted = query.strip()
    low = wanted.lower()
    target = X.section_key(F.lit(wanted))
    exact = F.col("section_key") == F.when(target != "", target).otherwise(F.lit(wanted))
    score = (
        F.when(exact & (F.col("section_key") != ""), 1.0)
        .when(F.lit(low != "") & F.lower("title").contains(low), 0.5)
        .when(F.lit(low != "") & F.lower("preview").contains(low), 0.3)
    )
    return (
        of.withColumn("score", score)
        .where("score is not null")
        .groupBy(key, "section_key", "title")
        .agg(F.max("score").alias("score"), F.min("line_start").alias("line_start"))
        .orderBy(F.desc("score"), key, "line_start")
        .limit(k)
    )


def read(docs: DataFrame, key: str, text: str, query: str, most: int | None = None) -> DataFrame:
    """Whole text of the section that a query names in each document: by key, else by title.

    ``key``, ``section_key``, ``section_text``; documents without it give no row.
    With ``most``, longer texts are cut there and marked.
    """
    of = parse.lines(docs, key, text)
    sections = parse.sections(of, key)
    wanted = query.strip()
    target = X.section_key(F.lit(wanted))
    by_key = F.col("section_key") == F.when(target != "", target).otherwise(F.lit(wanted))
    by_title = F.lower("title").contains(wanted.lower())
    chosen = (
        sections.where(by_key | by_title)
        .groupBy(key)
        .agg(F.min(F.struct((~by_key).alias("o"), "line_start", "line_end", "section_key")).alias("s"))
        .select(key, "s.line_start", "s.line_end", "s.section_key")
    )
    parts = F.slice(F.split(text, "\n", -1), F.col("line_start") + 1, F.col("line_end") - F.col("line_start"))
    whole = X.strip(F.array_join(parts, "\n"))
    if most is not None:
        whole = F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("\n… [cut]"))).otherwise(whole)
    return docs.where(F.col(text).isNotNull()).join(chosen, key).select(key, "section_key", whole.alias("section_text"))
