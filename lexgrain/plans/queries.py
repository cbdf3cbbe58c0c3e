"""Registered queries of the core operators, each beside its SQL."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as X
from lexgrain.operators import chunking, conversation, evaluation, extraction, fusion, lexical, parse, toc, vectors
from lexgrain.operators.agentic import agentic_search
from lexgrain.plans import tables as T
from lexgrain.plans.index import Index
from lexgrain.plans.persisted import Searchable, hashed_scores, searchable
from lexgrain.runtime import materialise, scratch, table
from lexgrain.sources import files, store
from lexgrain.streaming import ingest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


QUESTION = "полномочия Наблюдательного совета и одобрение крупной сделки"
# ---------------------------------------------------------------- SQL parts


def s_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{X.WS}+|{X.WS}+$', '', 'g')"


def s_squeeze(x: str) -> str:
    return s_strip(f"regexp_replace({x}, '{X.WS}+', ' ', 'g')")


def s_repair(x: str) -> str:
    mapped = f"translate(regexp_replace({x}, '{X.WS}+', '', 'g'), ',{X.GLYPHS}', '.{X.GLYPH_DIGITS}')"
    dotted = rf"regexp_replace(regexp_replace({mapped}, '\.{{2,}}', '.', 'g'), '^\.+|\.+$', '', 'g')"
    return rf"""(CASE WHEN regexp_matches({x}, '{X.DIGIT}') AND regexp_matches({dotted}, '^{X.DIGIT}+(?:\.{X.DIGIT}+)*$')
        AND NOT regexp_matches({dotted}, '{X.LEADING_ZERO}') THEN {dotted} ELSE '' END)"""


def s_key(title: str) -> str:
    word, num = f"regexp_extract({title}, '{X.WORD_KEY}', 1)", f"regexp_extract({title}, '{X.NUMBER_KEY}', 1)"
    return f"(CASE WHEN {word} <> '' THEN {s_repair(word)} ELSE {s_repair(num)} END)"


def s_below(key: str, parent: str) -> str:
    return f"({key} <> '' AND {parent} <> '' AND ({key} = {parent} OR starts_with({key}, {parent} || '.')))"


def s_family(x: str) -> str:
    return rf"regexp_replace({x}, '\.[^.]*$', '')"


def s_tokens(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '{X.TOKEN}')"


LINES = f"""{T.CHARTERS}, lines AS (
    SELECT doc_ord, line_no, line,
           CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_ord ORDER BY line_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
    FROM (SELECT doc_ord, CAST(unnest(range(len(a))) AS INT) AS line_no, unnest(a) AS line
          FROM (SELECT doc_ord, string_split(md_text, chr(10)) AS a FROM charters)))"""
HEADS = f"""{LINES}, h0 AS (
    SELECT doc_ord, line_no, CAST(length(regexp_extract(line, '{X.HEADING}', 1)) AS INT) AS level,
           {s_strip(f"regexp_extract(line, '{X.HEADING}', 2)")} AS title
    FROM lines WHERE regexp_matches(line, '{X.HEADING}')),
heads AS (SELECT *, {s_key("title")} AS section_key FROM h0)"""
SECTIONS = f"""{HEADS}, last AS (SELECT doc_ord, count(*) AS n FROM lines GROUP BY doc_ord),
closing AS (
    SELECT a.doc_ord, a.line_no, min(b.line_no) AS e FROM heads a JOIN heads b
      ON a.doc_ord = b.doc_ord AND b.line_no > a.line_no
     AND (a.section_key = '' OR (b.section_key <> '' AND NOT {s_below("b.section_key", "a.section_key")}))
    GROUP BY 1, 2),
parents AS (
    SELECT a.doc_ord, a.line_no, arg_max(b.section_key, length(b.section_key)) AS p
    FROM heads a JOIN heads b ON a.doc_ord = b.doc_ord AND b.section_key <> '' AND starts_with(a.section_key, b.section_key || '.')
    GROUP BY 1, 2),
sections AS (
    SELECT h.doc_ord, h.line_no AS line_start, CAST(coalesce(c.e, l.n) AS INT) AS line_end, h.level, h.title,
           CASE WHEN h.section_key = '' THEN '§' || sum(CASE WHEN h.section_key = '' THEN 1 ELSE 0 END)
                OVER (PARTITION BY h.doc_ord ORDER BY h.line_no) ELSE h.section_key END AS section_key,
           coalesce(p.p, '') AS parent_key
    FROM heads h JOIN last l USING (doc_ord) LEFT JOIN closing c ON c.doc_ord = h.doc_ord AND c.line_no = h.line_no
    LEFT JOIN parents p ON p.doc_ord = h.doc_ord AND p.line_no = h.line_no)"""


def s_clause_raw(line: str) -> str:
    """Raw number of a line that opens a clause, in the order of the patterns."""
    cases = []
    for p in X.CLAUSE_LINES:
        raw = f"regexp_extract({line}, '{p}', 1)"
        cases.append(f"WHEN {raw} <> '' AND NOT regexp_matches({raw}, '{X.LEADING_ZERO}') THEN {raw}")
    for p in X.CLAUSE_LINES_MISREAD:
        raw = f"regexp_extract({line}, '{p}', 1)"
        cases.append(f"WHEN regexp_matches({line}, '{p}') THEN (CASE WHEN {s_repair(raw)} <> '' THEN {raw} ELSE '' END)")
    return "(CASE " + " ".join(cases) + " ELSE '' END)"


SEGMENTS = f"""{SECTIONS}, placed AS (
    SELECT l.*, s.line_start IS NOT NULL AS head,
           last_value(s.section_key IGNORE NULLS) OVER w AS sk0, last_value(s.title IGNORE NULLS) OVER w AS sec_title,
           CASE WHEN s.line_start IS NULL THEN {s_clause_raw("l.line")} ELSE '' END AS raw
    FROM lines l LEFT JOIN sections s ON s.doc_ord = l.doc_ord AND s.line_start = l.line_no
    WINDOW w AS (PARTITION BY l.doc_ord ORDER BY l.line_no)),
numbered AS (
    SELECT *, coalesce(sk0, '') AS sk, coalesce(regexp_matches(lower({s_strip("sec_title")}), '{X.TOC_TITLE}'), false) AS toc,
           {s_repair("raw")} AS num FROM placed),
opening AS (
    SELECT *, num <> '' AND NOT (regexp_matches(line, '{X.CLOSED_BY_BRACKET}') AND NOT regexp_matches(line, '^[^|]*\\|')
              AND NOT (sk = '' OR {s_below("num", "sk")} OR {s_below("num", s_family("sk"))})) AS opens FROM numbered),
blocks AS (
    SELECT *, sum(CASE WHEN head OR opens OR line_no = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_ord ORDER BY line_no) AS id FROM opening),
texts AS (
    SELECT doc_ord, id, arg_min(head, line_no) AS head, arg_min(opens, line_no) AS opens, arg_min(num, line_no) AS num,
           arg_min(sk, line_no) AS sk, arg_min(toc, line_no) AS toc, min(start) AS start,
           string_agg(line, chr(10) ORDER BY line_no) AS raw
    FROM blocks GROUP BY 1, 2),
cut AS (
    SELECT doc_ord, CASE WHEN head THEN sk WHEN opens THEN num ELSE '' END AS own,
           CASE WHEN head OR opens THEN sk ELSE '' END AS section_key,
           CAST(start + length(raw) - length(regexp_replace(raw, '^{X.WS}+', '')) AS BIGINT) AS span_start,
           {s_strip("raw")} AS text
    FROM texts WHERE NOT toc),
segments AS (
    SELECT doc_ord, CASE WHEN own <> '' AND NOT starts_with(own, '§') THEN own
                         WHEN section_key <> '' AND NOT starts_with(section_key, '§') THEN section_key ELSE '' END AS number,
           section_key, span_start, CAST(span_start + length(text) AS BIGINT) AS span_end, text
    FROM cut WHERE text <> '')"""

# ---------------------------------------------------------------- parsing


def _lines(spark: SparkSession, root: str) -> DataFrame:
    return parse.lines(T.charters(spark, root), "doc_ord", "md_text")


@query("line_offsets", f"WITH {LINES} SELECT doc_ord, line_no, start, length(line)::INT AS n FROM lines")
def line_offsets(spark: SparkSession, root: str) -> DataFrame:
    return _lines(spark, root).select("doc_ord", "line_no", "start", F.length("line").alias("n"))


@query("headings", f"WITH {HEADS} SELECT doc_ord, line_no, level, title, section_key FROM heads")
def headings(spark: SparkSession, root: str) -> DataFrame:
    return parse.headings(_lines(spark, root), "doc_ord")


@query("section_tree", f"WITH {SECTIONS} SELECT * FROM sections")
def section_tree(spark: SparkSession, root: str) -> DataFrame:
    return parse.sections(_lines(spark, root), "doc_ord")


@query(
    "section_children",
    f"""WITH {SECTIONS} SELECT p.doc_ord, p.section_key, string_agg(c.section_key, ',' ORDER BY c.line_start) AS children
    FROM (SELECT doc_ord, section_key, min(line_start) AS first FROM sections GROUP BY 1, 2) p
    JOIN sections c ON c.doc_ord = p.doc_ord AND c.parent_key = p.section_key GROUP BY 1, 2""",
)
def section_children(spark: SparkSession, root: str) -> DataFrame:
    sections = section_tree(spark, root).where("parent_key <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("line_start", "section_key")))
    return sections.groupBy("doc_ord", F.col("parent_key").alias("_p")).agg(
        F.array_join(F.transform(ordered, lambda x: x["section_key"]), ",").alias("children")
    ).select("doc_ord", F.col("_p").alias("section_key"), "children")


@query("clause_segments", f"WITH {SEGMENTS} SELECT doc_ord, number, section_key, span_start, span_end, text FROM segments")
def clause_segments(spark: SparkSession, root: str) -> DataFrame:
    got = parse.segments(T.charters(spark, root), "doc_ord", "md_text")
    return got.select("doc_ord", "number", "section_key", "span_start", F.col("span_end").cast("long").alias("span_end"), "text")


@query(
    "inline_clauses",
    """WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n, l_partkey AS p FROM lineitem),
    c AS (SELECT k, CAST(k AS VARCHAR) AS number, '## Статья ' || k || '. Список' AS text FROM l WHERE n = 1
        UNION ALL SELECT k, k || '.' || n, CASE WHEN n = 1 THEN k || '.1. Перечень |  Товар ' || p ELSE k || '.' || n || '.  Товар ' || p END FROM l)
    SELECT k AS doc, number, text, CAST(length(text) AS BIGINT) AS n FROM c""",
)
def inline_clauses(spark: SparkSession, root: str) -> DataFrame:
    """Orders as flattened table rows, taken apart again: one clause for each line."""
    lines = table(spark, root, "lineitem").where("l_orderkey is not null").withColumnRenamed("l_orderkey", "doc")
    # nothing but this groups by order: all that follows stays where it is
    rows = lines.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("_c"))

    def cell(x: Column, i: Column) -> Column:
        item = F.when(i == 0, F.lit("Перечень |  Товар ")).otherwise(F.lit(" Товар "))
        return F.concat("doc", F.lit("."), i + 1, F.lit(". "), item, x["l_partkey"])

    body = F.array_join(F.transform("_c", cell), "   ")
    docs = rows.select("doc", F.concat_ws("", F.lit("## Статья "), "doc", F.lit(". Список\n"), body).alias("md_text"))
    got = parse.split_inline(parse.segments(docs, "doc", "md_text"), "doc")
    return got.select("doc", "number", "text", (F.col("span_end") - F.col("span_start")).cast("long").alias("n"))


@query(
    "section_contents",
    f"""WITH {SEGMENTS}, spans AS (
        SELECT s.doc_ord, s.line_start, s.section_key, a.start AS a, coalesce(z.start, n.n) AS b FROM sections s
        JOIN lines a ON a.doc_ord = s.doc_ord AND a.line_no = s.line_start LEFT JOIN lines z ON z.doc_ord = s.doc_ord AND z.line_no = s.line_end
        JOIN (SELECT doc_ord, length(md_text) AS n FROM charters) n ON n.doc_ord = s.doc_ord)
    SELECT p.doc_ord, p.line_start, p.section_key, CAST(p.a AS BIGINT) AS span_start, CAST(p.b AS BIGINT) AS span_end, count(g.doc_ord) AS clauses
    FROM spans p LEFT JOIN segments g ON g.doc_ord = p.doc_ord AND g.span_start >= p.a AND g.span_end <= p.b GROUP BY ALL""",
)
def section_contents(spark: SparkSession, root: str) -> DataFrame:
    """Sections with their character range and the number of clauses within it."""
    of = _lines(spark, root)
    spans = materialise(parse.section_spans(of, parse.sections(of, "doc_ord"), "doc_ord"))
    inside = parse.contained(clause_segments(spark, root), spans, "doc_ord")
    counts = inside.groupBy("doc_ord", "line_start").agg(F.count("*").alias("clauses"))
    return spans.join(counts, ["doc_ord", "line_start"], "left").select(
        "doc_ord", "line_start", "section_key", "span_start", "span_end", F.coalesce("clauses", F.lit(0)).alias("clauses")
    )


@query(
    "clause_ordinals",
    f"""WITH {SEGMENTS} SELECT CAST(row_number() OVER (ORDER BY doc_ord, span_start, span_end) - 1 AS BIGINT) AS clause_id, doc_ord, span_start FROM segments""",
)
def clause_ordinals(spark: SparkSession, root: str) -> DataFrame:
    got = materialise(clause_segments(spark, root).select("doc_ord", "span_start", "span_end"))
    return parse.ordinals(got, "doc_ord", "span_start", "span_end", name="clause_id").select("clause_id", "doc_ord", "span_start")


@query(
    "repair_number",
    f"WITH {T.CLAUSES} SELECT clause_id, {s_repair('number')} AS repaired FROM cl WHERE number IS NOT NULL",
)
def repair_number(spark: SparkSession, root: str) -> DataFrame:
    return T.clauses(spark, root).where("number is not null").select("clause_id", X.repair_number("number").alias("repaired"))


@query(
    "section_paths",
    rf"""WITH {T.CLAUSES}, k AS (SELECT clause_id, coalesce(nullif(number, ''), section_key, '') AS key FROM cl)
    SELECT clause_id, key, CAST(CASE WHEN key = '' THEN 0 ELSE len(string_split(key, '.')) END AS INT) AS depth,
           CASE WHEN key = '' THEN '' ELSE array_to_string(list_transform(range(1, len(string_split(key, '.')) + 1),
                lambda i: array_to_string(string_split(key, '.')[1:i], '.')), '>') END AS path FROM k""",
)
def section_paths(spark: SparkSession, root: str) -> DataFrame:
    key = fusion.effective_key("number", "section_key")
    got = T.clauses(spark, root).select("clause_id", key.alias("key"))
    return got.select("clause_id", "key", F.size(X.ancestors("key")).alias("depth"), F.array_join(X.ancestors("key"), ">").alias("path"))


@query(
    "window_spans",
    f"""WITH {T.CLAUSES}, n AS (SELECT clause_id, length(text) AS n FROM cl WHERE text IS NOT NULL)
    SELECT clause_id, CAST(k * 1350 AS INT) AS span_start, CAST(least(k * 1350 + 1500, n) AS INT) AS span_end
    FROM (SELECT clause_id, n, unnest(range(CAST(ceil(greatest(n - 1500, 0) / 1350.0) AS BIGINT) + 1)) AS k FROM n)""",
)
def window_spans(spark: SparkSession, root: str) -> DataFrame:
    spans = parse.window_spans(F.length("text"), 1500, 150)
    return T.clauses(spark, root).where("text is not null").select("clause_id", F.inline(spans))


@query(
    "size_pieces",
    f"""WITH {T.CHARTERS} SELECT doc_ord, CAST(k AS INT) AS piece_no, CAST(length(substring(md_text, k * 1650 + 1, 1800)) AS INT) AS n,
    md5(substring(md_text, k * 1650 + 1, 1800)) AS h FROM (
        SELECT doc_ord, md_text, unnest(range(CAST(greatest(floor((length(md_text) - 1) / 1650.0), 0) AS BIGINT) + 1)) AS k FROM charters)""",
)
def size_pieces(spark: SparkSession, root: str) -> DataFrame:
    got = T.charters(spark, root).select("doc_ord", F.posexplode(chunking.size_pieces(F.col("md_text"), 1800, 150)).alias("piece_no", "p"))
    return got.select("doc_ord", "piece_no", F.length("p").alias("n"), F.md5("p").alias("h"))


@query(
    "pattern_pieces",
    f"""WITH d AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS p FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(count(*) AS INT) AS n, CAST(sum(length({s_strip("p")})) AS BIGINT) AS chars FROM d WHERE {s_strip("p")} <> '' GROUP BY 1""",
)
def pattern_pieces(spark: SparkSession, root: str) -> DataFrame:
    pieces = chunking.pattern_pieces(F.col("text"), r"\n{2,}")
    got = table(spark, root, "documents").where("text is not null").select("doc_id", F.explode(pieces).alias("p"))
    return got.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.sum(F.length("p")).alias("chars"))


@query(
    "fixed_windows",
    f"""WITH {T.CLAUSES} SELECT clause_id, CAST(k AS INT) AS piece_no, md5(substring(text, k * 1350 + 1, 1500)) AS h FROM (
        SELECT clause_id, text, unnest(range(CAST(floor((length(text) - 1) / 1350.0) AS BIGINT) + 1)) AS k FROM cl WHERE text <> '')""",
)
def fixed_windows(spark: SparkSession, root: str) -> DataFrame:
    pieces = F.posexplode(chunking.windows_or_nothing(F.col("text"))).alias("piece_no", "p")
    return T.clauses(spark, root).where("text is not null").select("clause_id", pieces).select("clause_id", "piece_no", F.md5("p").alias("h"))


S_LINE_END = chunking.LINE_ENDS
S_HIER = f"""{T.CHARTERS}, hl AS (
    SELECT doc_ord, CAST(unnest(range(len(a))) AS INT) AS i, unnest(a) AS line FROM (
        SELECT doc_ord, string_split_regex(regexp_replace(md_text, '(?:{S_LINE_END})$', ''), '{S_LINE_END}') AS a FROM charters)),
hc AS (SELECT doc_ord, i, regexp_replace(regexp_replace(line, '[ \\t]{{2,}}', ' ', 'g'), '{X.WS}+$', '') AS line FROM hl WHERE NOT regexp_matches(line, '{X.NOISE_CHUNK}')),
hm AS (SELECT *, regexp_matches(line, '{chunking._HEAD}') AS h, regexp_matches(line, '{chunking._UNIT}') AS u FROM hc),
hs AS (SELECT *, sum(CASE WHEN h THEN 1 ELSE 0 END) OVER (PARTITION BY doc_ord ORDER BY i) AS s FROM hm),
hb AS (SELECT *, coalesce(sum(CASE WHEN h THEN 0 ELSE 1 END) OVER (PARTITION BY doc_ord, s ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM hs),
hu AS (SELECT *, sum(CASE WHEN u AND before > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_ord, s ORDER BY i) AS un FROM hb),
units0 AS (SELECT doc_ord, s, un, string_agg(line, chr(10) ORDER BY i) AS t FROM hu WHERE NOT h GROUP BY 1, 2, 3),
folded AS (SELECT doc_ord, s, list_reduce(list({{'o': CAST([] AS VARCHAR[]), 'b': t}} ORDER BY un), lambda a, x:
    CASE WHEN a.b = '' THEN {{'o': a.o, 'b': x.b}} WHEN length(a.b) + length(x.b) + 1 <= 1720 THEN {{'o': a.o, 'b': a.b || chr(10) || x.b}}
    ELSE {{'o': list_append(a.o, a.b), 'b': x.b}} END) AS f FROM units0 GROUP BY 1, 2),
names AS (SELECT doc_ord, s, max({s_strip(f"regexp_replace({s_strip('line')}, '^#+', '')")}) AS head FROM hu WHERE h GROUP BY 1, 2),
merged AS (SELECT f.doc_ord, f.s, CASE WHEN coalesce(head, '') = '' THEN '' ELSE '[' || head || ']' || chr(10) END AS p,
    list_filter(list_transform(CASE WHEN f.b = '' THEN f.o ELSE list_append(f.o, f.b) END, lambda x: {s_strip("x")}), lambda x: x <> '') AS m
    FROM folded f LEFT JOIN names USING (doc_ord, s)),
flat AS (SELECT doc_ord, s, p, unnest(range(len(m))) AS m, unnest(m) AS t FROM merged),
sized AS (SELECT *, greatest(200, 1800 - length(p)) AS z, length(p) + length(t) <= 1800 AS fits FROM flat),
cut AS (SELECT doc_ord, s, m, p, t, z, fits, unnest(range(CASE WHEN fits THEN 1 ELSE CAST(greatest(floor((length(t) - 1) / CAST(greatest(1, z - 150) AS DOUBLE)), 0) AS BIGINT) + 1 END)) AS k FROM sized),
got AS (SELECT doc_ord, s, m, k, p || CASE WHEN fits THEN t ELSE substring(t, k * greatest(1, z - 150) + 1, z) END AS chunk FROM cut),
kept AS (SELECT * FROM got WHERE {s_strip("chunk")} <> ''),
bare AS (SELECT doc_ord, 0 AS s, 0 AS m, unnest(range(CAST(greatest(floor((length(md_text) - 1) / 1650.0), 0) AS BIGINT) + 1)) AS k, md_text FROM charters WHERE doc_ord NOT IN (SELECT doc_ord FROM kept)),
hchunks AS (SELECT doc_ord, CAST(row_number() OVER (PARTITION BY doc_ord ORDER BY s, m, k) - 1 AS INT) AS chunk_no, chunk FROM (
    SELECT * FROM kept UNION ALL SELECT doc_ord, s, m, k, substring(md_text, k * 1650 + 1, 1800) FROM bare))"""


@query("hierarchical_chunks", f"WITH {S_HIER} SELECT * FROM hchunks")
def hierarchical_chunks(spark: SparkSession, root: str) -> DataFrame:
    return chunking.hierarchical(T.charters(spark, root), "doc_ord", "md_text")


# ---------------------------------------------------------------- lexical search

STATS = f"""{T.UNITS}, tok AS (SELECT unit_id, unnest({s_tokens("text")}) AS term FROM units),
tf AS (SELECT unit_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT unit_id, count(*) AS dl FROM tok GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM units) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM units) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY 1),
terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)"""


def s_scores(queries: str) -> str:
    """Scores of units for a table of queries (query_id, text)."""
    return f"""{STATS}, q AS (SELECT query_id, term, count(*) AS qtf FROM (
        SELECT query_id, unnest({s_tokens("text")}) AS term FROM ({queries})) GROUP BY 1, 2),
scores AS (SELECT * FROM (
    SELECT q.query_id, tf.unit_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM n)))), 9) AS score
    FROM q JOIN terms USING (term) JOIN tf USING (term) JOIN dl USING (unit_id) GROUP BY 1, 2) WHERE score > 0)"""


def s_clause_rank(scores: str, depth: int, k: int) -> str:
    """Top clauses from unit scores."""
    return f"""by_clause AS (SELECT query_id, clause_id, max(score) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM {scores}) JOIN units USING (unit_id)
        WHERE r <= {depth} GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT query_id, clause_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS rank FROM by_clause) WHERE rank <= {k})"""


ONE = f"SELECT 1 AS query_id, '{QUESTION}' AS text"
BODIES = "SELECT body_id AS query_id, canonical_name AS text FROM governing_bodies"


def _one(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, QUESTION)], "query_id long, text string")


def _bm25(spark: SparkSession, root: str, queries: DataFrame, normaliser: str = "none") -> tuple[DataFrame, Searchable]:
    index = searchable(spark, root, normaliser)
    return lexical.asked(index.lexical, queries, "query_id", "text"), index


def _top_clauses(scored: DataFrame, units: DataFrame, k: int) -> DataFrame:
    got = fusion.by_clause(lexical.top(scored, max(5 * k, 50)), units)
    return fusion.ranked(got, "clause_id").where(F.col("rank") <= k)


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.select(F.col("query_id").cast("long").alias("query_id"), "clause_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


S_SHOWN = "CAST(query_id AS BIGINT) AS query_id, clause_id, round(score, 6) AS score, CAST(rank AS INT) AS rank"


@query("bm25_topk", f"WITH {s_scores(ONE)}, {s_clause_rank('scores', 50, 5)} SELECT {S_SHOWN} FROM best")
def bm25_topk(spark: SparkSession, root: str) -> DataFrame:
    scored, index = _bm25(spark, root, _one(spark))
    return _shown(_top_clauses(scored, index.units, 5))


@query("bm25_batch", f"WITH {s_scores(BODIES)}, {s_clause_rank('scores', 50, 5)} SELECT {S_SHOWN} FROM best")
def bm25_batch(spark: SparkSession, root: str) -> DataFrame:
    scored, index = _bm25(spark, root, T.bodies(spark, root))
    return _shown(_top_clauses(scored, index.units, 5))


S_IN_SECTION = s_below("coalesce(nullif(number, ''), section_key, '')", "'8'") + " OR " + s_below("coalesce(section_key, '')", "'8'")


@query(
    "bm25_in_section",
    f"""WITH {s_scores(ONE)}, inside AS (SELECT scores.* FROM scores JOIN units USING (unit_id) JOIN cl USING (clause_id) WHERE {S_IN_SECTION}),
    {s_clause_rank('inside', 50, 5)} SELECT {S_SHOWN} FROM best""",
)
def bm25_in_section(spark: SparkSession, root: str) -> DataFrame:
    """Filters restrict the ranking; document frequencies stay those of the corpus."""
    scored, index = _bm25(spark, root, _one(spark))
    units = index.units
    clauses = T.clauses(spark, root)
    scope = clauses.select("doc_id").distinct().withColumn("section_key", F.lit("8"))
    allowed = fusion.in_scope(clauses, scope, "doc_id").select("clause_id")
    inside = scored.join(units.join(allowed, "clause_id", "left_semi").select("unit_id"), "unit_id", "left_semi")
    return _shown(_top_clauses(inside, units, 5))


S_CHUNK_BEST = f"""{S_HIER}, tok AS (SELECT doc_ord, chunk_no, unnest({s_tokens("chunk")}) AS term FROM hchunks),
tf AS (SELECT doc_ord, chunk_no, term, count(*) AS tf FROM tok GROUP BY 1, 2, 3), dl AS (SELECT doc_ord, chunk_no, count(*) AS dl FROM tok GROUP BY 1, 2),
n AS (SELECT (SELECT count(*) FROM hchunks) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM hchunks) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY 1),
terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({s_tokens("text")}) AS term FROM ({BODIES})) GROUP BY 1, 2),
cs AS (SELECT q.query_id, tf.doc_ord, tf.chunk_no, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM n)))), 9) AS score
    FROM q JOIN terms USING (term) JOIN tf USING (term) JOIN dl USING (doc_ord, chunk_no) GROUP BY 1, 2, 3),
cb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_ord ORDER BY score DESC, chunk_no) AS r FROM cs WHERE score > 0) WHERE r <= 12),
pairs AS (SELECT DISTINCT body_id AS query_id, doc_ord FROM governing_bodies, (SELECT DISTINCT doc_ord FROM hchunks))"""


@query(
    "bm25_chunk_context",
    f"""WITH {S_CHUNK_BEST} SELECT p.query_id, p.doc_ord AS doc, coalesce(string_agg(h.chunk, chr(10) || chr(10) ORDER BY h.chunk_no), any_value(f.chunk)) AS context
    FROM pairs p JOIN hchunks f ON f.doc_ord = p.doc_ord AND f.chunk_no = 0 LEFT JOIN cb ON cb.query_id = p.query_id AND cb.doc_ord = p.doc_ord
    LEFT JOIN hchunks h ON h.doc_ord = p.doc_ord AND h.chunk_no = cb.chunk_no GROUP BY 1, 2""",
)
def bm25_chunk_context(spark: SparkSession, root: str) -> DataFrame:
    """Context of each listed body in each charter: its 12 best hierarchical chunks uncut, in document order.

    A charter without a chunk that scores gives its first one.
    """
    chunks = materialise(
        hierarchical_chunks(spark, root).select(F.col("doc_ord").alias("doc"), "chunk_no", "chunk")
    )
    numbered = materialise(parse.ordinals(chunks, "doc", "chunk_no", name="unit_id"))
    index = lexical.build(numbered, "unit_id", "chunk")
    bodies = T.bodies(spark, root)
    scored = lexical.scores(index, lexical.query_terms(bodies, "query_id", "text")).join(
        numbered.select("unit_id", "doc", "chunk_no"), "unit_id"
    )
    asked = chunks.select("doc").distinct().join(F.broadcast(bodies.select("query_id")))
    return chunking.contexts(scored, chunks, 12, asked=asked)


@query("term_stats", f"WITH {STATS} SELECT terms.term, terms.df, round(terms.idf, 6) AS idf FROM terms")
def term_stats(spark: SparkSession, root: str) -> DataFrame:
    return searchable(spark, root).lexical.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query("posting_counts", f"WITH {STATS} SELECT unit_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tokens FROM tf GROUP BY 1")
def posting_counts(spark: SparkSession, root: str) -> DataFrame:
    got = lexical.postings_of(T.units(spark, root), "unit_id", "text")
    return got.groupBy("unit_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tokens"))


PATTERN = "крупн[а-яё]+ сдел[а-яё]+|совет[а-яё]* директоров"


@query(
    "grep_count",
    f"""WITH {T.CLAUSES} SELECT clause_id, CAST(len(regexp_extract_all(lower(text), '{PATTERN}')) AS BIGINT) AS score
    FROM cl WHERE len(regexp_extract_all(lower(text), '{PATTERN}')) > 0""",
)
def grep_count(spark: SparkSession, root: str) -> DataFrame:
    return fusion.grep(T.clauses(spark, root), PATTERN).select("clause_id", "score")


# ---------------------------------------------------------------- vectors

S_VEC = "(SELECT vec_id, embedding, label FROM embeddings)"
S_COS = "list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))"
S_RANKED = """SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM sims)"""


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("vec"), "label")


def s_sims(queries: str, items: str = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings") -> str:
    return f"""q AS ({queries}), e AS ({items}), sims AS (SELECT q.query_id, e.vec_id, round({S_COS}, 6) AS score FROM q, e)"""


S_QUERY_VECTORS = "SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0"


@query(
    "vector_topk",
    f"""WITH {s_sims(S_QUERY_VECTORS)} SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, score, CAST(rank AS INT) AS rank FROM ({S_RANKED}) WHERE rank <= 10""",
)
def vector_topk(spark: SparkSession, root: str) -> DataFrame:
    """Ten nearest of each stated query vector (ids divisible by 100) among all."""
    rows = _vectors(spark, root)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return vectors.rank(asked, rows.select("vec_id", "vec"), "vec_id", 10)


@query(
    "vector_filtered",
    f"""WITH {s_sims(S_QUERY_VECTORS, "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label < 5")}
    SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, score, CAST(rank AS INT) AS rank FROM ({S_RANKED}) WHERE rank <= 5""",
)
def vector_filtered(spark: SparkSession, root: str) -> DataFrame:
    rows = _vectors(spark, root)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    return vectors.rank(asked, rows.where("label < 5").select("vec_id", "vec"), "vec_id", 5)


S_CENTROIDS = """means AS (SELECT label, i, avg(x) AS m FROM (
        SELECT label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY 1, 2),
    len AS (SELECT label, sqrt(sum(m * m)) AS n FROM means GROUP BY 1)"""


@query("label_centroids", f"WITH {S_CENTROIDS} SELECT label, CAST(i AS INT) AS dim, round(m / n, 6) AS value FROM means JOIN len USING (label)")
def label_centroids(spark: SparkSession, root: str) -> DataFrame:
    pooled = vectors.pool(_vectors(spark, root), "label")
    return pooled.select("label", F.posexplode("vec").alias("dim", "value")).select("label", "dim", F.round("value", 6).alias("value"))


@query(
    "tree_search",
    f"""WITH {S_CENTROIDS}, c AS (SELECT label, list(m / n ORDER BY i) AS v FROM means JOIN len USING (label) GROUP BY 1),
    q AS ({S_QUERY_VECTORS}), near AS (SELECT query_id, label FROM (
        SELECT q.query_id, e.label, row_number() OVER (PARTITION BY query_id ORDER BY round({S_COS}, 6) DESC, label) AS r FROM q, c e) WHERE r <= 2),
    e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
    sims AS (SELECT q.query_id, e.vec_id, round({S_COS}, 6) AS score FROM q JOIN near USING (query_id) JOIN e USING (label))
    SELECT CAST(query_id AS BIGINT) AS query_id, vec_id, score, CAST(rank AS INT) AS rank FROM ({S_RANKED}) WHERE rank <= 5""",
)
def tree_search(spark: SparkSession, root: str) -> DataFrame:
    """Coarse to fine: the two nearest centroids of each query, then their vectors."""
    return _tree(spark, root, 2)


def _tree(spark: SparkSession, root: str, sections: int) -> DataFrame:
    rows = _vectors(spark, root)
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "vec")
    coarse = vectors.rank(asked, vectors.pool(rows, "label").select(F.col("label").alias("section"), "vec"), "section", sections)
    scope = {}
    for r in coarse.select("query_id", "section").collect():  # the stated queries times the sections
        scope.setdefault(r.query_id, set()).add(r.section)
    got = vectors.rank(asked, rows, "vec_id", 5, section="label", scope=scope)
    return got.select("query_id", "vec_id", "score", "rank")


@query("tree_search_sections", SQL["tree_search"].replace("WHERE r <= 2)", "WHERE r <= 8)"))
def tree_search_sections(spark: SparkSession, root: str) -> DataFrame:
    """Coarse to fine with the reference's eight nearest sections; ``tree_search`` and its SQL keep two."""
    return _tree(spark, root, 8)


S_HASHED = f"""{T.UNITS}, hw AS (SELECT unit_id, sha1(w) AS h FROM (SELECT unit_id, unnest({s_tokens("text")}) AS w FROM units)),
hs AS (SELECT unit_id, CAST(('0x' || substring(h, 15, 2)) AS INT) AS dim,
       sum(CASE WHEN CAST(('0x' || substring(h, 14, 1)) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM hw GROUP BY 1, 2),
hv AS (SELECT unit_id, dim, v / sqrt(sum(v * v) OVER (PARTITION BY unit_id)) AS value FROM hs WHERE v <> 0)"""


@query("hashing_vectors", f"WITH {S_HASHED} SELECT unit_id, dim, round(value, 6) AS value FROM hv")
def hashing_vectors(spark: SparkSession, root: str) -> DataFrame:
    return vectors.hashed(T.units(spark, root), "unit_id", "text").select("unit_id", "dim", F.round("value", 6).alias("value"))


def s_hashed_query(text: str) -> str:
    return f"""qw AS (SELECT sha1(unnest({s_tokens("'" + text + "'")})) AS h),
qs AS (SELECT CAST(('0x' || substring(h, 15, 2)) AS INT) AS dim,
       sum(CASE WHEN CAST(('0x' || substring(h, 14, 1)) AS INT) % 2 = 1 THEN 1 ELSE -1 END) AS v FROM qw GROUP BY 1),
qv AS (SELECT dim, v / sqrt((SELECT sum(v * v) FROM qs)) AS value FROM qs WHERE v <> 0),
vscores AS (SELECT 1 AS query_id, unit_id, round(sum(hv.value * qv.value), 9) AS score FROM hv JOIN qv USING (dim) GROUP BY 1, 2)"""


@query(
    "hashing_topk",
    f"""WITH {S_HASHED}, {s_hashed_query(QUESTION)}, {s_clause_rank('vscores', 50, 5)} SELECT {S_SHOWN} FROM best""",
)
def hashing_topk(spark: SparkSession, root: str) -> DataFrame:
    index = searchable(spark, root)
    return _shown(_top_clauses(hashed_scores(index, _one(spark)), index.units, 5))


S_UNIT_QUERIES = "SELECT unit_id AS query_id, text FROM units WHERE unit_id % 100 = 0"
S_BEST_UNITS = "SELECT CAST(query_id AS BIGINT) AS query_id, unit_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS rank FROM {}) WHERE rank <= 5"


@query("bm25_units", f"WITH {s_scores(S_UNIT_QUERIES)} {S_BEST_UNITS.format('scores')}")
def bm25_units(spark: SparkSession, root: str) -> DataFrame:
    """Five best units for each unit whose id is divisible by 100, among all: the stated query set."""
    asked = T.units(spark, root).where("unit_id % 100 = 0").select(F.col("unit_id").alias("query_id"), "text")
    found = lexical.rank(searchable(spark, root).lexical, asked, "query_id", "text", 5)
    return found.select("query_id", "unit_id", F.round("score", 6).alias("score"), "rank")


@query(
    "hashing_units",
    f"""WITH {S_HASHED}, uv AS (SELECT a.unit_id AS query_id, b.unit_id, round(sum(a.value * b.value), 6) AS score FROM hv a JOIN hv b USING (dim) WHERE a.unit_id % 100 = 0 GROUP BY 1, 2),
    qs AS (SELECT DISTINCT unit_id AS query_id FROM hv WHERE unit_id % 100 = 0),
    every AS (SELECT qs.query_id, u.unit_id, coalesce(uv.score, 0) AS score FROM qs CROSS JOIN units u LEFT JOIN uv ON uv.query_id = qs.query_id AND uv.unit_id = u.unit_id)
    {S_BEST_UNITS.format("every")}""",
)
def hashing_units(spark: SparkSession, root: str) -> DataFrame:
    """Five nearest units by hashing vectors for each unit whose id is divisible by 100, among all."""
    rows = T.units(spark, root).select("unit_id", vectors.hashed_dense(X.tokens("text")).alias("vec"))
    rows = materialise(rows)
    asked = rows.where("unit_id % 100 = 0").where(F.exists("vec", lambda x: x != 0)).select(F.col("unit_id").alias("query_id"), "vec")
    return vectors.rank(asked, rows, "unit_id", 5).select("query_id", "unit_id", "score", "rank")


S_BOTH = f"""{s_scores(ONE)}, {S_HASHED.split('), hw AS', 1)[1].join(['hw AS', ''])}, {s_hashed_query(QUESTION)},
b1 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS rank FROM (
    SELECT query_id, clause_id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM scores)
    JOIN units USING (unit_id) WHERE r <= 50 GROUP BY 1, 2)),
b2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS rank FROM (
    SELECT query_id, clause_id, max(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, unit_id) AS r FROM vscores)
    JOIN units USING (unit_id) WHERE r <= 50 GROUP BY 1, 2))"""


def s_fused(w1: float, w2: float) -> str:
    return f"""fused AS (SELECT query_id, clause_id, round(sum(c), 9) AS score FROM (
        SELECT query_id, clause_id, CAST({w1} AS DOUBLE) / (60 + rank) AS c FROM b1 UNION ALL SELECT query_id, clause_id, CAST({w2} AS DOUBLE) / (60 + rank) FROM b2) GROUP BY 1, 2),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, clause_id) AS rank FROM fused) WHERE rank <= 5)"""


def _fused(spark: SparkSession, root: str, w1: float, w2: float) -> DataFrame:
    scored, index = _bm25(spark, root, _one(spark))
    rankings = [
        fusion.ranked(fusion.by_clause(lexical.top(s, 50), index.units), "clause_id") for s in (scored, hashed_scores(index, _one(spark)))
    ]
    fused = fusion.rrf(list(zip(rankings, (w1, w2))), "clause_id")
    return _shown(fusion.ranked(fused, "clause_id").where("rank <= 5"))


@query("hybrid_rrf", f"WITH {S_BOTH}, {s_fused(1.0, 1.0)} SELECT {S_SHOWN} FROM best")
def hybrid_rrf(spark: SparkSession, root: str) -> DataFrame:
    return _fused(spark, root, 1.0, 1.0)


@query("hybrid_rrf_weighted", f"WITH {S_BOTH}, {s_fused(0.7, 0.3)} SELECT {S_SHOWN} FROM best")
def hybrid_rrf_weighted(spark: SparkSession, root: str) -> DataFrame:
    return _fused(spark, root, 0.7, 0.3)


@query(
    "embedding_cache_missing",
    """WITH k AS (SELECT DISTINCT sha1('hashing-256' || chr(0) || text) AS key, text, doc_id % 2 = 0 AS have FROM documents WHERE text IS NOT NULL)
    SELECT DISTINCT key, CAST(length(text) AS INT) AS n FROM k WHERE key NOT IN (SELECT key FROM k WHERE have)""",
)
def embedding_cache_missing(spark: SparkSession, root: str) -> DataFrame:
    """Texts to embed when those of even documents are cached."""
    docs = table(spark, root, "documents").where("text is not null")
    cache = docs.where("doc_id % 2 = 0").select(vectors.cache_key("hashing-256", "text").alias("key")).distinct()
    return vectors.missing(docs, "text", cache, "hashing-256").select("key", F.length("text").alias("n"))


# ---------------------------------------------------------------- navigation

S_BODY = f"""body AS (SELECT * FROM lines WHERE NOT regexp_matches(line, '^{X.WS}*$')
    AND NOT regexp_matches(line, '{X.NOISE_PREVIEW}') AND NOT regexp_matches(line, '{X.HEADING}')),
firsts AS (SELECT s.doc_ord, s.line_start, arg_min(b.line, b.line_no) AS f FROM sections s LEFT JOIN body b
    ON b.doc_ord = s.doc_ord AND b.line_no > s.line_start AND b.line_no < s.line_end GROUP BY 1, 2),
clean AS (SELECT doc_ord, line_start, coalesce({s_squeeze(f"regexp_replace(f, '^{X.WS}*[-*]{X.WS}+', '')")}, '') AS c FROM firsts)"""


def s_previews(most: int) -> str:
    space = f"({most} - strpos(reverse(left(c, {most})), ' '))"
    return f"""{SECTIONS}, {S_BODY}, previews AS (SELECT doc_ord, line_start, CASE WHEN length(c) <= {most} THEN c
        WHEN strpos(reverse(left(c, {most})), ' ') > 0 AND {space} > {most // 2} THEN left(c, {space}) || '…' ELSE left(c, {most}) || '…' END AS preview FROM clean)"""


def s_entries(most: int) -> str:
    return f"""{s_previews(most)}, entries AS (SELECT s.doc_ord, s.line_start, s.section_key,
        CASE WHEN length(regexp_replace({s_squeeze("title")}, '[^\\p{{L}}\\p{{Nl}}\\p{{No}}]', '', 'g')) < 3 AND preview <> '' THEN preview ELSE {s_squeeze("title")} END AS title,
        preview, level FROM sections s JOIN previews USING (doc_ord, line_start))"""


@query("section_previews", f"WITH {s_previews(80)} SELECT * FROM previews")
def section_previews(spark: SparkSession, root: str) -> DataFrame:
    of = _lines(spark, root)
    return toc.previews(of, parse.sections(of, "doc_ord"), "doc_ord")


def _entries(spark: SparkSession, root: str, most: int = 80) -> DataFrame:
    docs = T.charters(spark, root)
    segments = materialise(parse.segments(docs, "doc_ord", "md_text").select("doc_ord", "number", "section_key"))
    return toc.entries(docs, "doc_ord", "md_text", segments, most)


@query(
    "toc_entries",
    f"""WITH {SEGMENTS}, {s_entries(80).split(SECTIONS + ", ", 1)[1]},
    home AS (SELECT g.doc_ord, g.number, coalesce((SELECT arg_max(s.section_key, length(s.section_key)) FROM sections s
        WHERE s.doc_ord = g.doc_ord AND {s_below("g.number", "s.section_key")}), g.section_key) AS section_key FROM segments g WHERE g.number <> ''),
    grouped AS (SELECT doc_ord, section_key, array_to_string(list(number ORDER BY list_transform(string_split(number, '.'), lambda p: coalesce(try_cast(p AS INT), 0)), number), ',') AS numbers
        FROM home GROUP BY 1, 2)
    SELECT e.doc_ord, e.line_start, e.section_key, e.title, e.preview, e.level, coalesce(numbers, '') AS clause_numbers
    FROM entries e LEFT JOIN grouped USING (doc_ord, section_key)""",
)
def toc_entries(spark: SparkSession, root: str) -> DataFrame:
    return _entries(spark, root).withColumn("clause_numbers", F.array_join("clause_numbers", ","))


@query(
    "toc_outline",
    f"""WITH {s_entries(80)} SELECT doc_ord, '=== ' || doc_ord || ' ===' || chr(10) || string_agg(repeat('  ', greatest(0, level - 1)) || '[' || section_key || '] ' || title
        || CASE WHEN preview <> '' AND preview <> title THEN ' — ' || preview ELSE '' END, chr(10) ORDER BY line_start) AS outline FROM entries GROUP BY 1""",
)
def toc_outline(spark: SparkSession, root: str) -> DataFrame:
    return toc.outline(_entries(spark, root), "doc_ord", preview=True)


@query(
    "find_section",
    f"""WITH {s_entries(300)} SELECT doc_ord, section_key, title, max(score) AS score, min(line_start) AS line_start FROM (
        SELECT *, CAST(CASE WHEN section_key = '8' THEN 1.0 WHEN contains(lower(title), 'статья 8') THEN 0.5 WHEN contains(lower(preview), 'статья 8') THEN 0.3 END AS DOUBLE) AS score
        FROM entries) WHERE score IS NOT NULL GROUP BY 1, 2, 3 ORDER BY score DESC, doc_ord, line_start LIMIT 3""",
)
def find_section(spark: SparkSession, root: str) -> DataFrame:
    return toc.find(_entries(spark, root, 300), "doc_ord", "Статья 8")


@query(
    "read_section",
    f"""WITH {SECTIONS}, chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_ord ORDER BY section_key <> '8', line_start) AS r
        FROM sections WHERE section_key = '8' OR contains(lower(title), 'статья 8')) WHERE r = 1)
    SELECT c.doc_ord, c.section_key, {s_strip("string_agg(l.line, chr(10) ORDER BY l.line_no)")} AS section_text
    FROM chosen c JOIN lines l ON l.doc_ord = c.doc_ord AND l.line_no >= c.line_start AND l.line_no < c.line_end GROUP BY 1, 2""",
)
def read_section(spark: SparkSession, root: str) -> DataFrame:
    return toc.read(T.charters(spark, root), "doc_ord", "md_text", "Статья 8")


@query(
    "search_hits",
    f"""WITH {s_scores(BODIES)}, {s_clause_rank('scores', 50, 3)}, {SECTIONS.replace('charters AS', 'charters AS', 1)},
    names AS (SELECT doc_ord, doc_id, coalesce(nullif(regexp_extract(source_path, '([^/]*)$', 1), ''), doc_id) AS doc_name FROM charters),
    titles AS (SELECT n.doc_id, s.section_key, arg_min(s.title, s.line_start) AS title FROM sections s JOIN names n USING (doc_ord) GROUP BY 1, 2),
    h AS (SELECT query_id, clause_id, score, rank, doc_id, cl.number, coalesce(nullif(number, ''), section_key, '') AS key FROM best JOIN cl USING (clause_id)),
    lv AS (SELECT query_id, clause_id, doc_id, unnest(range(1, len(string_split(key, '.')) + 1)) AS i, key FROM h WHERE key <> ''),
    crumbs AS (SELECT query_id, clause_id, string_agg(CASE WHEN coalesce(t.title, '') <> '' THEN t.title ELSE k END, ' › ' ORDER BY i) AS breadcrumb
        FROM (SELECT *, array_to_string(string_split(key, '.')[1:i], '.') AS k FROM lv) v LEFT JOIN titles t ON t.doc_id = v.doc_id AND t.section_key = v.k GROUP BY 1, 2)
    SELECT CAST(query_id AS BIGINT) AS query_id, clause_id, CAST(rank AS INT) AS rank, names.doc_name, coalesce(breadcrumb, '') AS breadcrumb,
        coalesce(nullif(number, ''), breadcrumb, names.doc_name || '#' || clause_id) AS locator
    FROM h LEFT JOIN crumbs USING (query_id, clause_id) LEFT JOIN names ON names.doc_id = h.doc_id""",
)
def search_hits(spark: SparkSession, root: str) -> DataFrame:
    """Ranked clauses with titles, breadcrumb and locator."""
    scored, index = _bm25(spark, root, T.bodies(spark, root))
    docs = materialise(T.charters(spark, root))
    name = F.coalesce(F.when(F.regexp_extract("source_path", r"([^/]*)$", 1) != "", F.regexp_extract("source_path", r"([^/]*)$", 1)), F.col("doc_id"))
    titles = (
        parse.sections(parse.lines(docs, "doc_ord", "md_text"), "doc_ord")
        .join(docs.select("doc_ord", "doc_id"), "doc_ord")
        .groupBy("doc_id", "section_key")
        .agg(F.min_by("title", "line_start").alias("title"))
    )
    found = fusion.hits(_top_clauses(scored, index.units, 3), T.clauses(spark, root), titles, docs.select("doc_id", name.alias("doc_name")), "doc_id")
    return found.select(F.col("query_id").cast("long").alias("query_id"), "clause_id", F.col("rank").cast("int").alias("rank"), "doc_name", "breadcrumb", "locator")


# ---------------------------------------------------------------- extraction

LISTS = ("collegial_governing_bodies", "sole_executive_bodies", "major_transaction_clauses", "related_party_transaction_clauses", "sole_executive_body_restrictions")
TEXTS = ("supreme_governing_body", "general_meeting_minutes_protocol")
S_RUNS = """runs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id ORDER BY extracted_at DESC) AS rn FROM extractions) WHERE rn = 1)"""
S_ITEMS = "items AS (" + " UNION ALL ".join(
    f"SELECT extraction_id, doc_id, '{c}' AS field, CAST(unnest(range(len({c}))) AS INT) AS pos, unnest({c}) AS value FROM runs" for c in LISTS
) + ")"


def _runs(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "extractions")
    latest = rows.groupBy("extraction_id").agg(F.max_by(F.struct("doc_id", *LISTS, *TEXTS), "extracted_at").alias("r"))
    return latest.select("extraction_id", "r.*")


def _items(spark: SparkSession, root: str) -> DataFrame:
    runs = _runs(spark, root)
    named = [F.struct(F.lit(c).alias("field"), F.col(c).alias("values")) for c in LISTS]
    each = runs.select("extraction_id", "doc_id", F.explode(F.array(*named)).alias("f"))
    return each.select("extraction_id", "doc_id", "f.field", F.posexplode("f.values").alias("pos", "value"))


S_PLACEHOLDERS = ", ".join(f"'{p}'" for p in extraction.PLACEHOLDERS)


@query(
    "coerced_items",
    f"""WITH {S_RUNS}, {S_ITEMS}, c AS (SELECT extraction_id, field, pos, {s_strip("value")} AS value FROM items WHERE value IS NOT NULL)
    SELECT extraction_id, field, pos, value FROM (SELECT *, row_number() OVER (PARTITION BY extraction_id, field, lower(value) ORDER BY pos) AS r
        FROM c WHERE lower(value) NOT IN ({S_PLACEHOLDERS})) WHERE r = 1""",
)
def coerced_items(spark: SparkSession, root: str) -> DataFrame:
    return extraction.coerced(_items(spark, root), "extraction_id", "field", pos="pos", value="value")


@query(
    "coerced_texts",
    f"""WITH {S_RUNS} SELECT extraction_id, CASE WHEN {s_strip("supreme_governing_body")} IS NULL OR lower({s_strip("supreme_governing_body")}) IN ({S_PLACEHOLDERS})
        THEN '{extraction.NOT_GIVEN}' ELSE {s_strip("supreme_governing_body")} END AS value FROM runs""",
)
def coerced_texts(spark: SparkSession, root: str) -> DataFrame:
    return _runs(spark, root).select("extraction_id", extraction.coerced_text("supreme_governing_body").alias("value"))


S_BARE = s_strip(f"regexp_replace(value, '{extraction._PREFIX}', '')")


@query(
    "unprefixed_items",
    f"""WITH {S_RUNS}, {S_ITEMS} SELECT extraction_id, field, pos, CASE WHEN {S_BARE} = '' THEN value ELSE {S_BARE} END AS value,
        regexp_extract(value, '^{X.WS}*(\\d+(?:\\.\\d+)*)', 1) AS clause_number FROM items WHERE value IS NOT NULL""",
)
def unprefixed_items(spark: SparkSession, root: str) -> DataFrame:
    items = _items(spark, root).where("value is not null")
    return items.select("extraction_id", "field", "pos", extraction.without_prefix("value").alias("value"), extraction.leading_number("value").alias("clause_number"))


@query(
    "absent_clause_numbers",
    f"""WITH {T.CHARTERS}, {S_RUNS}, {S_ITEMS}, n AS (SELECT extraction_id, doc_id, field, pos, regexp_extract(value, '^{X.WS}*(\\d+(?:\\.\\d+)*)', 1) AS clause_number FROM items),
    runs_of AS (SELECT doc_id, unnest(regexp_extract_all(md_text, '[0-9.]+')) AS run FROM charters),
    found AS (SELECT DISTINCT doc_id, regexp_extract(run, '^([0-9]+(?:\\.[0-9]+)*)', 1) AS clause_number FROM runs_of)
    SELECT extraction_id, field, pos, clause_number FROM n WHERE clause_number <> '' AND NOT EXISTS (
        SELECT 1 FROM found f WHERE f.doc_id = n.doc_id AND f.clause_number = n.clause_number)""",
)
def absent_clause_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Extracted items that name a clause which their charter doesn't have."""
    docs = T.charters(spark, root).select("doc_id", "md_text")
    got = extraction.absent_numbers(_items(spark, root), "doc_id", "value", docs, "md_text")
    return got.select("extraction_id", "field", "pos", "clause_number")


@query(
    "fences_removed",
    f"""SELECT doc_id, md5({s_strip("regexp_replace(regexp_replace('```json' || chr(10) || text || chr(10) || '````', '`{3,}[ \\t]*[a-zA-Z]*[ \\t]*\\n?', '', 'g'), '`', '', 'g')")}) AS h
    FROM documents WHERE text IS NOT NULL""",
)
def fences_removed(spark: SparkSession, root: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n````"))
    return table(spark, root, "documents").where("text is not null").select("doc_id", F.md5(extraction.without_fences(fenced)).alias("h"))


def s_rendered(column: str, heading: str, many: bool) -> str:
    body = f"""(CASE WHEN len({column}) > 0 THEN array_to_string(list_transform({column}, lambda x: '- ' || x), chr(10)) ELSE '- (не найдено)' END)"""
    one = f"(CASE WHEN {column} <> '' THEN {column} ELSE '(не найдено)' END)"
    return f"'### {heading} (`{column}`)' || chr(10) || {body if many else one} || chr(10)"


S_RENDERED = " || chr(10) || ".join(
    s_rendered(*x) for x in (("supreme_governing_body", "Высший орган", False), ("collegial_governing_bodies", "Коллегиальные органы", True), ("sole_executive_bodies", "Единоличные органы", True))
)


@query("rendered_reports", f"WITH {S_RUNS} SELECT extraction_id, '## Извлечённые поля' || chr(10) || chr(10) || {S_RENDERED} AS report FROM runs")
def rendered_reports(spark: SparkSession, root: str) -> DataFrame:
    """Readable report of each extraction."""
    fields = [("supreme_governing_body", "Высший орган"), ("collegial_governing_bodies", "Коллегиальные органы"), ("sole_executive_bodies", "Единоличные органы")]
    return extraction.rendered(_runs(spark, root), "extraction_id", fields)


@query(
    "tolerant_json",
    f"""WITH {S_RUNS} SELECT extraction_id, array_to_string(list_filter(list_transform(sole_executive_bodies,
        lambda x: CASE WHEN extraction_id % 4 = 2 THEN trim({s_strip("regexp_replace(x, '^[-*•[:space:]]+', '')")}, ',') ELSE coalesce({s_strip("x")}, 'None') END), lambda x: x <> ''), '|') AS items
    FROM runs WHERE sole_executive_bodies IS NOT NULL""",
)
def tolerant_json(spark: SparkSession, root: str) -> DataFrame:
    """Replies made of extractions in several broken shapes, parsed again."""
    runs = _runs(spark, root)
    body = F.to_json("sole_executive_bodies")
    shape = F.col("extraction_id") % 4
    raw = (
        F.when(shape == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(shape == 1, F.concat(F.lit("Ответ: "), body, F.lit(" — готово")))
        .when(shape == 2, F.concat(F.lit("- "), F.array_join("sole_executive_bodies", "\n- ")))
        .otherwise(body)
    )
    asked = runs.where("sole_executive_bodies is not null").select("extraction_id", raw.alias("raw"), F.lit("list").alias("kind"))
    return asked.select("extraction_id", F.array_join(extraction.reply_values("raw", "kind"), "|").alias("items"))


# ---------------------------------------------------------------- conversations and scores

# a conversation is a user's events; a purchase calls a tool, what follows answers it
S_MESSAGES = """ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
calls AS (SELECT user_id AS conv_id, turn, 'call-' || event_id AS id, 'tool-' || (event_id % 3) AS name FROM ev WHERE event_type = 'purchase'),
tools AS (SELECT ev.user_id AS conv_id, ev.turn, max(c.turn) AS last, event_id, event_id % 2 = 0 AS named
    FROM ev JOIN calls c ON c.conv_id = ev.user_id AND c.turn < ev.turn WHERE event_type <> 'purchase' GROUP BY ALL)"""


def _messages(spark: SparkSession, root: str) -> DataFrame:
    ordered = Window.partitionBy("user_id").orderBy("ts", "event_id")
    called = F.col("event_type") == "purchase"
    events = table(spark, root, "events").withColumn("turn", F.row_number().over(ordered).cast("long"))
    call = F.array(F.struct(F.concat(F.lit("call-"), "event_id").alias("id"), F.concat(F.lit("tool-"), F.col("event_id") % 3).alias("name")))
    own = F.last(F.when(called, F.concat(F.lit("call-"), "event_id")), ignorenulls=True).over(ordered)
    return events.select(
        F.col("user_id").alias("conv_id"),
        "turn",
        F.when(called, F.lit("assistant")).otherwise(F.lit("tool")).alias("role"),
        F.when(called, call).alias("tool_calls"),
        F.when(~called & (F.col("event_id") % 2 == 0), own).otherwise(F.lit("")).alias("tool_call_id"),
        F.col("event_type").alias("content"),
        F.length("props").alias("tokens"),
    )


S_PAIRS = """WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
    m AS (SELECT user_id AS conv_id, turn, event_id, event_type = 'purchase' AS called,
          last_value(CASE WHEN event_type = 'purchase' THEN turn END IGNORE NULLS) OVER w AS last,
          last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER w AS call
          FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY turn)),
    t AS (SELECT *, event_id % 2 = 0 AND call IS NOT NULL AS named FROM m WHERE NOT called),
    direct AS (SELECT conv_id, turn, 'call-' || call AS tool_call_id, 'tool-' || (call % 3) AS name FROM t WHERE named),
    orphans AS (SELECT *, row_number() OVER (PARTITION BY conv_id, last ORDER BY turn) AS n FROM t WHERE NOT named),
    paired AS (SELECT * FROM direct UNION ALL
    SELECT o.conv_id, o.turn, CASE WHEN hit THEN 'call-' || call WHEN o.event_id % 2 = 0 THEN NULL ELSE '' END, CASE WHEN hit THEN 'tool-' || (call % 3) ELSE 'tool' END
    FROM (SELECT *, n = 1 AND call IS NOT NULL AS hit FROM orphans) o)"""


@query("reply_pairing", f"{S_PAIRS} SELECT * FROM paired")
def reply_pairing(spark: SparkSession, root: str) -> DataFrame:
    return conversation.replies(_messages(spark, root))


@query(
    "report_concat",
    """SELECT user_id AS conv_id, CAST(length(string_agg(event_type, chr(10) || chr(10) ORDER BY turn)) AS INT) AS n,
        md5(string_agg(event_type, chr(10) || chr(10) ORDER BY turn)) AS h
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events) GROUP BY 1""",
)
def report_concat(spark: SparkSession, root: str) -> DataFrame:
    got = conversation.reports(_messages(spark, root), "conv_id", order="turn", text="content")
    return got.select("conv_id", F.length("report").alias("n"), F.md5("report").alias("h"))


@query(
    "token_budget",
    """SELECT user_id AS conv_id, turn, CAST(used AS BIGINT) AS used_before, used < 500 AS allowed FROM (
        SELECT user_id, turn, coalesce(sum(length(props)) OVER (PARTITION BY user_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events))""",
)
def token_budget(spark: SparkSession, root: str) -> DataFrame:
    got = conversation.budget(_messages(spark, root), "conv_id", "turn", "tokens", 500)
    return got.select("conv_id", "turn", "used_before", "allowed")


@query(
    "tool_traces",
    f"""{S_PAIRS}, said AS (SELECT user_id AS conv_id, turn, event_id, event_type FROM ev),
    outs AS (SELECT p.conv_id, p.tool_call_id AS id, arg_min(s.event_type, p.turn) AS out FROM paired p JOIN said s ON s.conv_id = p.conv_id AND s.turn = p.turn WHERE p.name <> 'tool' GROUP BY 1, 2),
    steps AS (
        SELECT c.conv_id, c.turn, 'tool-' || (c.event_id % 3) AS name, coalesce(o.out, '') AS out FROM said c
            LEFT JOIN outs o ON o.conv_id = c.conv_id AND o.id = 'call-' || c.event_id WHERE c.event_type = 'purchase'
        UNION ALL SELECT p.conv_id, p.turn, 'tool', s.event_type FROM paired p JOIN said s ON s.conv_id = p.conv_id AND s.turn = p.turn WHERE p.name = 'tool'),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM steps),
    tx AS (SELECT conv_id, string_agg('[' || i || '] ' || name || ' → ' || out, chr(10) ORDER BY i) AS x FROM n GROUP BY 1)
    SELECT conv_id, CASE WHEN length(x) > 6000 THEN left(x, 6000) || chr(10) || '... (truncated)' ELSE x END AS trace FROM tx""",
)
def tool_traces(spark: SparkSession, root: str) -> DataFrame:
    """Tool steps of each conversation, a line each."""
    return conversation.trace(_messages(spark, root))


S_CALLED = "SELECT event_id, event_type AS name, unnest(['a', 'n']) AS arg, unnest([event_type, CAST(event_id AS VARCHAR)]) AS value, event_id % 5 AS form FROM events"


@query("tool_call_markup", f"SELECT event_id, name, arg, value FROM ({S_CALLED}) WHERE form IN (0, 2) OR (form IN (1, 3) AND arg = 'a')")
def tool_call_markup(spark: SparkSession, root: str) -> DataFrame:
    """Arguments of calls written as markup: whole, cut off, in the corrupted form, and as prose, which is no call."""
    kind, number = F.col("event_type"), F.col("event_id").cast("string")
    head = F.concat(F.lit('<invoke name="'), kind, F.lit('">'))
    named = F.concat(F.lit("<minimax:tool_call>"), head, F.lit('<parameter name="a">'), kind)
    direct = F.concat(F.lit("]<]minimax[>["), head, F.lit("<a>"), kind)
    text = (
        F.when(F.col("event_id") % 5 == 0, F.concat(named, F.lit('</parameter><parameter name="n">'), number, F.lit("</parameter></invoke></minimax:tool_call> so")))
        .when(F.col("event_id") % 5 == 1, named)
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit("a "), direct, F.lit("</a><n>"), number, F.lit("</n></invoke>]<]/minimax[>[ so")))
        .when(F.col("event_id") % 5 == 3, F.concat(direct, F.lit("</a")))
        .otherwise(F.concat(head, F.lit("<a>"), kind, F.lit("</a></invoke>")))
    )
    found = table(spark, root, "events").select("event_id", F.explode(conversation.parsed_calls(text)).alias("c"))
    return found.select("event_id", "c.name", F.explode("c.args").alias("arg", "value"))


@query(
    "verdict_scores",
    """WITH v AS (SELECT annotator, CASE WHEN subject_id IS NULL THEN 'not_significant_error' WHEN subject_id % 3 = 0 THEN 'significant_error' WHEN subject_id % 3 = 1 THEN 'correct' ELSE 'unknown' END AS status FROM subject_labels)
    SELECT annotator, round(avg(CASE status WHEN 'correct' THEN 1.0 WHEN 'not_significant_error' THEN 0.7 ELSE 0.0 END), 6) AS score,
        count(*) FILTER (status = 'correct') AS n_correct, count(*) FILTER (status = 'not_significant_error') AS n_not_significant_error, count(*) FILTER (status = 'significant_error') AS n_significant_error
    FROM v GROUP BY 1""",
)
def verdict_scores(spark: SparkSession, root: str) -> DataFrame:
    status = (
        F.when(F.col("subject_id").isNull(), "not_significant_error")
        .when(F.col("subject_id") % 3 == 0, "significant_error")
        .when(F.col("subject_id") % 3 == 1, "correct")
        .otherwise("unknown")
    )
    return evaluation.verdict_scores(table(spark, root, "subject_labels").withColumn("status", status), "annotator")


@query(
    "ranking_quality",
    f"""WITH {s_scores(BODIES)}, {s_clause_rank('scores', 50, 10)},
    rel AS (SELECT b.body_id AS query_id, cl.clause_id FROM governing_bodies b JOIN cl ON contains(lower(cl.text), lower(b.canonical_name))),
    f AS (SELECT query_id, min(rank) AS first, count(*) FILTER (rank <= 5) AS n FROM best JOIN rel USING (query_id, clause_id) GROUP BY 1)
    SELECT round(avg(coalesce(1.0 / first, 0.0)), 6) AS mrr, CAST(coalesce(sum(n), 0) AS BIGINT) AS relevant_at_k FROM governing_bodies b LEFT JOIN f ON f.query_id = b.body_id""",
)
def ranking_quality(spark: SparkSession, root: str) -> DataFrame:
    """Does BM25 find clauses that spell a body's name out?"""
    scored, index = _bm25(spark, root, T.bodies(spark, root))
    hits = _top_clauses(scored, index.units, 10).select("query_id", "clause_id", "rank")
    # 45 listed names against every clause: the stated query set
    names = F.broadcast(T.bodies(spark, root).withColumnRenamed("text", "name"))
    texts = T.clauses(spark, root).select("clause_id", F.lower("text").alias("t"))
    said = hits.join(texts, "clause_id").join(names, "query_id").where(F.col("t").contains(F.lower("name"))).select("query_id", "clause_id", F.lit(True).alias("relevant"))
    judged = said.unionByName(names.select("query_id", F.lit(None).cast("long").alias("clause_id"), F.lit(False).alias("relevant")))
    return evaluation.ranking_quality(hits, judged, "clause_id")


# ---------------------------------------------------------------- sources


@query(
    "page_selection",
    """WITH s AS (SELECT p_partkey AS id, (p_partkey % 7) || ',' || (p_size) || '-' || (p_size + p_partkey % 5 - 1) || ',x,' || (p_partkey % 3) || '-4' AS spec, CAST(20 + p_partkey % 20 AS INT) AS total FROM part),
    parts AS (SELECT id, total, trim(unnest(string_split(spec, ','))) AS p FROM s),
    b AS (SELECT id, total, try_cast(regexp_extract(p, '^([0-9]+)(-[0-9]+)?$', 1) AS INT) AS lo, try_cast(coalesce(nullif(regexp_extract(p, '^[0-9]+-([0-9]+)$', 1), ''), regexp_extract(p, '^([0-9]+)$', 1)) AS INT) AS hi FROM parts),
    pages AS (SELECT DISTINCT id, unnest(range(greatest(1, lo), least(total, hi) + 1)) AS page FROM b WHERE lo IS NOT NULL AND hi IS NOT NULL)
    SELECT s.id, coalesce(string_agg(CAST(page AS VARCHAR), ',' ORDER BY page), '') AS pages FROM s LEFT JOIN pages USING (id) GROUP BY 1""",
)
def page_selection(spark: SparkSession, root: str) -> DataFrame:
    part = table(spark, root, "part")
    key = F.col("p_partkey")
    spec = F.concat_ws(",", key % 7, F.concat_ws("-", "p_size", F.col("p_size") + key % 5 - 1), F.lit("x"), F.concat(key % 3, F.lit("-4")))
    got = part.select(key.alias("id"), X.page_selection(spec, (20 + key % 20).cast("int")).alias("p"))
    return got.select("id", F.array_join(F.transform("p", lambda x: x.cast("string")), ",").alias("pages"))


S_STEM = r"regexp_replace(regexp_extract(source_path, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')"


@query(
    "doc_ids",
    rf"""WITH {T.CHARTERS}, b AS (SELECT doc_ord, coalesce(nullif(regexp_replace(regexp_replace({S_STEM}, '[^\p{{L}}\p{{N}}_.-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'doc') AS base FROM charters WHERE source_path IS NOT NULL)
    SELECT doc_ord, base || CASE WHEN n = 1 THEN '' ELSE '-' || n END AS file_id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_ord) AS n FROM b)""",
)
def doc_ids(spark: SparkSession, root: str) -> DataFrame:
    docs = T.charters(spark, root).where("source_path is not null").select("doc_ord", "source_path")
    return files.doc_ids(docs, "source_path", "doc_ord").select("doc_ord", F.col("doc_id").alias("file_id"))


@query("content_keys", f"WITH {T.CHARTERS} SELECT doc_ord, left(sha256(md_text), 16) AS content_key FROM charters")
def content_keys(spark: SparkSession, root: str) -> DataFrame:
    return T.charters(spark, root).select("doc_ord", files.content_key("md_text").alias("content_key"))


@query(
    "table_cells",
    rf"""WITH {LINES}, r AS (SELECT *, regexp_matches(line, '^\s*\|') AS bar FROM lines),
    p AS (SELECT *, lag(bar) OVER (PARTITION BY doc_ord ORDER BY line_no) AS before FROM r),
    n AS (SELECT *, sum(CASE WHEN bar AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_ord ORDER BY line_no) AS table_no FROM p),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_ord, table_no ORDER BY line_no) - 1 AS row_no FROM n WHERE bar AND NOT regexp_matches(line, '^[\s|:-]+$'))
    SELECT doc_ord, CAST(table_no AS BIGINT) AS table_no, CAST(row_no AS INT) AS row_no, cell_no, trim(cell) AS cell FROM (
        SELECT doc_ord, table_no, row_no, CAST(unnest(range(len(c))) AS INT) AS cell_no, unnest(c) AS cell FROM (
            SELECT *, string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|') AS c FROM k))""",
)
def table_cells(spark: SparkSession, root: str) -> DataFrame:
    got = files.tables_of(T.charters(spark, root), "doc_ord", "md_text")
    return got.select("doc_ord", "table_no", "row_no", F.posexplode("cells").alias("cell_no", "cell"))


@query("jsonl_round_trip", f"WITH {T.CLAUSES} SELECT clause_id, number, text FROM cl")
def jsonl_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Clauses written as JSON lines in the shared folder and read again."""
    path = scratch(spark)
    store.write_jsonl(T.clauses(spark, root).select("clause_id", "number", "text"), path)
    return store.read_jsonl(spark, path, "clause_id long, number string, text string")


@query(
    "index_round_trip",
    f"WITH {SEGMENTS} SELECT doc_id, number, span_start, text FROM segments JOIN charters USING (doc_ord)",
)
def index_round_trip(spark: SparkSession, root: str) -> DataFrame:
    """Clauses of an index that was built, saved by spans and loaded again."""
    path = scratch(spark)
    docs = materialise(T.charters(spark, root).select("doc_id", "source_path", "md_text"))
    Index.build(docs).save(spark, path)
    return Index.load(spark, path).tables["clauses"].select("doc_id", "number", "span_start", "text")


@query(
    "agentic_rounds",
    f"WITH {s_scores(ONE)}, {s_clause_rank('scores', 50, 8)} SELECT clause_id, round(score, 6) AS score, 'relevant' AS verdict FROM best",
)
def agentic_rounds(spark: SparkSession, root: str) -> DataFrame:
    """Search in rounds with a scripted model that finds every clause relevant: the ranking as it is."""
    index = searchable(spark, root)
    clauses = materialise(T.clauses(spark, root))

    def search(text: str, k: int) -> list:
        asked = spark.createDataFrame([(1, text)], "query_id long, text string")
        got = _top_clauses(lexical.asked(index.lexical, asked, "query_id", "text"), index.units, k).join(clauses.select("clause_id", "text"), "clause_id")
        return [(r.clause_id, r.score, r.text) for r in got.orderBy("rank").collect()]

    def grep(pattern: str, k: int) -> list:
        got = fusion.grep(clauses, pattern).orderBy(F.desc("score"), "clause_id").limit(k)
        return [(r.clause_id, float(r.score), r.text) for r in got.collect()]

    def model(prompt: str) -> str:
        if prompt.startswith("PLAN"):
            return json.dumps({"queries": [QUESTION], "aspects": ["a"]})
        if prompt.startswith("GRADE"):
            n = sum(line.startswith("C") for line in prompt.splitlines())
            return json.dumps([{"id": f"C{i}", "verdict": "relevant", "aspects": [1]} for i in range(1, n + 1)])
        return "[]"

    found = agentic_search(QUESTION, search, grep, model)
    rows = [(c, round(s, 6), v) for c, s, v, _ in found.rows]
    return spark.createDataFrame(rows, "clause_id long, score double, verdict string")


@query(
    "streamed_deliveries",
    "SELECT date_trunc('day', loaded_at) AS day, count(*) AS n FROM documents_in GROUP BY 1",
)
def streamed_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """Deliveries by day, counted by a stream over the table's files."""
    static, name = table(spark, root, "documents_in"), "documents_in.parquet"
    # a stream reads folders: the table's own, or for a single file the one it lies in
    own = os.path.isdir(f"{root}/{name}")
    reader = spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet" if own else name)
    stream = reader.parquet(f"{root}/{name}" if own else root)
    stream = stream.withColumn("loaded_at", F.col("loaded_at").cast("timestamp"))
    counted = ingest.deliveries(stream, "loaded_at", late="3650 days")
    sink = f"m{uuid.uuid4().hex}"
    run = (
        counted.writeStream.format("memory").queryName(sink).outputMode("complete")
        .option("checkpointLocation", scratch(spark)).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.table(sink).select(F.col("window_start").cast("timestamp_ntz").alias("day"), "n")
