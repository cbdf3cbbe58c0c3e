"""From text to lines, headings, sections and clauses.

All order-dependent steps are windows over one document, so that the lines are
shuffled once by document and stay where they are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as X
from lexgrain.runtime import materialise


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``line_no`` (from 0), ``line``, ``start`` (offset of its first character).

    Lines end at line feeds only; null texts give no rows.
    """
    split = docs.where(F.col(text).isNotNull()).select(
        key, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")
    )
    before = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return split.select(key, "line_no", "line", start.alias("start"))


def headings(of: DataFrame, key: str) -> DataFrame:
    """``key``, ``line_no``, ``level``, ``title``, ``section_key`` of heading lines."""
    title = X.strip(F.regexp_extract("line", X.HEADING, 2))
    return (
        of.where(F.col("line").rlike(X.HEADING))
        .select(key, "line_no", F.length(F.regexp_extract("line", X.HEADING, 1)).alias("level"), title.alias("title"))
        .withColumn("section_key", X.section_key("title"))
    )


def sections(of: DataFrame, key: str) -> DataFrame:
    """Sections of each document from its lines (:func:`lines`).

    ``key``, ``line_start``, ``line_end``, ``level``, ``title``, ``section_key``
    (``§1, §2 ...`` where the heading has no number), ``parent_key`` ("" if none).
    A numbered section ends at the next numbered heading that is not below it, an
    unnumbered one at the next heading, the last at the end of the text.
    """
    whole = Window.partitionBy(key)
    marked = of.withColumn("_n", F.count("*").over(whole)).where(F.col("line").rlike(X.HEADING))
    heads = headings_with(marked, key)
    kind = heads.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, line_start int, line_end int, level int, title string, section_key string, parent_key string"
    # lines are already grouped by document, so this adds no exchange
    return heads.groupBy(key).applyInArrow(lambda group: _scoped(group, key), schema)


def _scoped(heads: pa.Table, key: str) -> pa.Table:
    """Scopes of one document's headings, in one pass.

    The sections open at any heading form a chain, each below the one before, so closing
    from the end of that chain touches each section once.
    """
    heads = heads.sort_by("line_no")
    at, keys = heads.column("line_no").to_pylist(), heads.column("section_key").to_pylist()
    last = heads.column("_n")[0].as_py()
    known = set(keys)
    ends, names, parents = [last] * len(at), [], []
    chain: list[int] = []
    unnumbered = 0
    for i, name in enumerate(keys):
        if name == "":
            unnumbered += 1
            names.append(f"§{unnumbered}")
            parents.append("")
            ends[i] = at[i + 1] if i + 1 < len(at) else last
            continue
        while chain and not (name + ".").startswith(keys[chain[-1]] + "."):
            ends[chain.pop()] = at[i]
        chain.append(i)
        names.append(name)
        above = name
        while "." in above:
            above = above.rpartition(".")[0]
            if above in known:
                break
        parents.append(above if above != name and above in known else "")
    return pa.table(
        {
            key: heads.column(key),
            "line_start": heads.column("line_no").cast(pa.int32()),
            "line_end": pa.array(ends, pa.int32()),
            "level": heads.column("level").cast(pa.int32()),
            "title": heads.column("title"),
            "section_key": pa.array(names, pa.string()),
            "parent_key": pa.array(parents, pa.string()),
        }
    )


def headings_with(marked: DataFrame, key: str) -> DataFrame:
    title = X.strip(F.regexp_extract("line", X.HEADING, 2))
    return marked.select(
        key,
        "line_no",
        "_n",
        F.length(F.regexp_extract("line", X.HEADING, 1)).alias("level"),
        title.alias("title"),
        X.section_key(title).alias("section_key"),
    )


def clause_number(line: Column | str, misread: bool = True) -> Column:
    """Raw number with which a line opens a clause; "" if it opens none."""
    line = F.col(line) if isinstance(line, str) else line
    found = F.lit("")
    if misread:
        for pattern in reversed(X.CLAUSE_LINES_MISREAD):
            raw = F.regexp_extract(line, pattern, 1)
            # the first pattern that matches decides, even if its number is none
            found = F.when(line.rlike(pattern), F.when(X.repair_number(raw) != "", raw).otherwise("")).otherwise(found)
    for pattern in reversed(X.CLAUSE_LINES):
        raw = F.regexp_extract(line, pattern, 1)
        found = F.when((raw != "") & ~raw.rlike(X.LEADING_ZERO), raw).otherwise(found)
    return found


def consistent(number: Column, section: Column) -> Column:
    """Whether a number belongs to the numbering of a section: below it or beside it."""
    return (section == "") | X.is_descendant(number, section) | X.is_descendant(number, X.family(section))


def segments(docs: DataFrame, key: str, text: str, misread: bool = True) -> DataFrame:
    """Whole clauses: ``key``, ``number``, ``section_key``, ``span_start``, ``span_end``, ``text``.

    Clauses start at headings and at lines that open with a dotted number, and
    reach to the next start; the text before the first is one too.  Tables of
    contents give none.  Text is the exact span without white space at its ends.
    """
    of = lines(docs, key, text)
    ordered = Window.partitionBy(key).orderBy("line_no")
    # a section ends only where a later heading starts, so the innermost section
    # of a line is that of the last heading; no scopes are needed, and no join.
    # Documents without a key have no sections
    titled = (
        of.withColumn("_title", F.when(F.col(key).isNotNull(), F.regexp_extract("line", X.HEADING, 2)).otherwise(""))
        .withColumn("_head", F.col("_title") != "")
        .withColumn("_title", F.when(F.col("_head"), X.strip("_title")))
        .withColumn("_key", F.when(F.col("_head"), X.section_key("_title")))
    )
    named = titled.withColumn("_sec", F.when(F.col("_head"), F.struct("_key", X.is_toc_title("_title").alias("toc"))))
    latest = named.withColumns(
        {"_in": F.last("_sec", ignorenulls=True).over(ordered), "_nth": F.count(F.when(F.col("_key") == "", 1)).over(ordered)}
    )
    section = F.when(F.col("_in._key") == "", F.concat(F.lit("§"), "_nth")).otherwise(F.coalesce("_in._key", F.lit("")))
    placed = latest.select(
        key,
        "line_no",
        "line",
        "start",
        "_head",
        section.alias("section_key"),
        F.coalesce("_in.toc", F.lit(False)).alias("_toc"),
        F.when(~F.col("_head"), clause_number("line", misread)).otherwise("").alias("_raw"),
    )
    number = X.repair_number("_raw")
    parts = F.split("_num", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(2))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )
    fitting = F.filter(suffixes, lambda s: s.contains(".") & consistent(s, F.col("section_key")))
    spaced = F.col("_raw").rlike(X.WS) & ~consistent(F.col("_num"), F.col("section_key"))
    numbered = placed.withColumn("_num", number).withColumn(
        "_num", F.when(spaced, F.coalesce(F.get(fitting, F.lit(0)), F.col("_num"))).otherwise(F.col("_num"))
    )
    bracket = F.col("line").rlike(X.CLOSED_BY_BRACKET) & ~F.col("line").rlike(r"^[^|]*\|")
    opens = (F.col("_num") != "") & ~(bracket & ~consistent(F.col("_num"), F.col("section_key")))
    starts = numbered.withColumn("_opens", opens).withColumn(
        "_id", F.sum((F.col("_head") | F.col("_opens") | (F.col("line_no") == 0)).cast("int")).over(ordered)
    )
    first = F.struct("line_no", "_head", "_num", "section_key", "_toc", "start", "_opens")
    blocks = starts.groupBy(key, "_id").agg(
        F.min(first).alias("f"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_lines")
    )
    raw = F.array_join(F.transform("_lines", lambda x: x["line"]), "\n")
    cut = X.strip("_text")
    lead = F.length("_text") - F.length(X.strip_left("_text"))
    own = F.when(F.col("f._head"), F.col("f.section_key")).when(F.col("f._opens"), F.col("f._num")).otherwise("")
    # text before the first start belongs to no section
    section = F.when(F.col("f._head") | F.col("f._opens"), F.col("f.section_key")).otherwise("")
    return (
        blocks.where(~F.col("f._toc"))
        .withColumn("_text", raw)
        .where(F.col("_text").rlike(X.NOT_WS))
        .select(
            key,
            F.when(X.is_numbered(own), own).when(X.is_numbered(section), section).otherwise("").alias("number"),
            section.alias("section_key"),
            (F.col("f.start") + lead).cast("long").alias("span_start"),
            cut.alias("text"),
        )
        .withColumn("span_end", F.col("span_start") + F.length("text"))
    )


#: A number within a flattened table row: framed by wide gaps, a letter after it.
#: Digits are tried first and no more than two characters are looked back at, since
#: this is tried at every place of a text.
_INLINE = rf"(?=\p{{Nd}})(?<={X.WS}{{2}})(?=(?!0\d)\p{{Nd}}+(?:\.(?!0\d)\p{{Nd}}+){{1,4}}(?:{X.WS}*[.)])?{X.WS}{{2,}}{X.LETTER})"
#: What lies between such places. ``split`` would compile the pattern for each row.
_PIECE = rf"(?s).+?(?={_INLINE}|\z)"


def split_inline(clauses: DataFrame, key: str) -> DataFrame:
    """Clauses with the sub-clauses of flattened table rows split off.

    Only numbered clauses with table markup; a number inside splits if it is
    below the clause or beside it and is not the clause's own.
    """
    number = F.col("number")
    tabular = (number != "") & F.col("text").contains("|")
    got = clauses.withColumn("_p", F.when(tabular, F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))).otherwise(F.array("text")))
    inner = F.transform("_p", lambda piece: F.regexp_extract(piece, r"^(\p{Nd}+(?:\.\p{Nd}+){1,4})", 1))
    got = got.withColumn("_n", F.when(F.size("_p") > 1, inner)).withColumn("_above", F.when(F.size("_p") > 1, X.family(number)))

    def fits(i: Column) -> Column:
        n = F.get("_n", i)
        return (n != number) & (X.is_descendant(n, number) | X.is_descendant(n, F.col("_above")))

    # a piece that doesn't split belongs to the one before
    firsts = F.filter(F.sequence(F.lit(0), F.size("_p") - 1), lambda i: (i == 0) | fits(i))
    cut = got.withColumn("_at", F.when(F.size("_p") > 1, firsts).otherwise(F.array(F.lit(0))))
    joined = F.transform(
        "_at",
        lambda at, j: F.struct(
            F.when(at > 0, F.get("_n", at)).alias("_inner"),
            F.array_join(F.slice("_p", at + 1, F.coalesce(F.get("_at", j + 1), F.size("_p")) - at), "").alias("_raw"),
        ),
    )
    parts = cut.select(key, "number", "section_key", "span_start", F.posexplode(joined).alias("_i", "_part"))
    parts = parts.select(key, "number", "section_key", "span_start", "_i", "_part.*")
    before = Window.partitionBy(key, "span_start").orderBy("_i").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn("_off", F.coalesce(F.sum(F.length("_raw")).over(before), F.lit(0)))
    lead = F.length("_raw") - F.length("_left")
    return (
        placed.where(F.col("_raw").rlike(X.NOT_WS))
        .withColumn("_left", X.strip_left("_raw"))
        .select(
            key,
            F.coalesce("_inner", "number").alias("number"),
            "section_key",
            (F.col("span_start") + F.col("_off") + lead).cast("long").alias("span_start"),
            X.strip("_left").alias("text"),
        )
        .withColumn("span_end", F.col("span_start") + F.length("text"))
    )


def window_spans(length: Column, size: int, overlap: int) -> Column:
    """Windows over a text of this length as an array of ``(span_start, span_end)``.

    One window if the text fits; else steps of ``size - overlap`` until a window
    reaches the end.
    """
    step = max(1, size - overlap)
    last = F.ceil(F.greatest(length - size, F.lit(0)) / step).cast("int")
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct((k * step).alias("span_start"), F.least(k * step + size, length).alias("span_end")),
    )


def section_spans(of: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Sections with the character range of their lines: ``span_start``, ``span_end``."""
    offsets = of.select(key, "line_no", "start", (F.col("start") + F.length("line")).alias("_stop"))
    first = offsets.select(key, F.col("line_no").alias("line_start"), F.col("start").alias("span_start"))
    # the section ends where the line after it starts, or with the text
    after = offsets.select(key, F.col("line_no").alias("line_end"), F.col("start").alias("_after"))
    whole = offsets.groupBy(key).agg(F.max("_stop").alias("_n"))
    return (
        found.join(first, [key, "line_start"])
        .join(after, [key, "line_end"], "left")
        .join(whole, key)
        .withColumn("span_end", F.coalesce("_after", "_n").cast("long"))
        .drop("_after", "_n")
    )


def contained(clauses: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Pairs of a section and a clause whose span lies in it: ``key``, ``section_key``,
    ``line_start`` and the clause's columns."""
    inner = spans.select(F.col(key).alias("_k"), F.col("section_key").alias("in_section"), "line_start", F.col("span_start").alias("_a"), F.col("span_end").alias("_b"))
    within = (F.col(key) == F.col("_k")) & (F.col("span_start") >= F.col("_a")) & (F.col("span_end") <= F.col("_b"))
    return clauses.join(inner, within).drop("_k", "_a", "_b")


def ordinals(rows: DataFrame, group: str, *order: str, name: str, parts: int | None = None) -> DataFrame:
    """Dense ids from 0 in the order of ``group`` and, within it, of ``order``.

    Counts by group are spread over range partitions; their totals (one row a
    partition) give each partition its base, a window within the partition each
    group's, a window within the group each row's.  No window spans the table.
    ``rows`` is read twice: pass a materialised table.
    """
    spark = rows.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.groupBy(group).count()
    # partitions by range are only known once written
    placed = materialise(counts.repartitionByRange(n, group).withColumn("_part", F.spark_partition_id()))
    totals = placed.groupBy("_part").agg(F.sum("count").alias("_total"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    before = Window.partitionBy("_part").orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("count").over(before), F.lit(0))
    # one row a partition: as many as ``n``
    based = placed.withColumn("_off", offset).join(F.broadcast(bases), "_part")
    within = Window.partitionBy(group).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(within) - 1)
        .join(based.select(group, (F.col("_base") + F.col("_off")).alias("_first")), group)
        .withColumn(name, (F.col("_first") + F.col("_rn")).cast("long"))
        .drop("_first", "_rn")
    )
