"""Queries of the operators that no other query reaches, over the tables or over few planted rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators import agentic, chunking, conversation, evaluation, extraction, lexical, parse, toc
from lexgrain.plans import queries as Q
from lexgrain.plans import tables as T
from lexgrain.plans.index import Index
from lexgrain.plans.planted import s_values
from lexgrain.plans.queries import query
from lexgrain.runtime import materialise, scratch, table
from lexgrain.sources import files, store

# ---------------------------------------------------------------- the index facade

S_BUILT = f"""{Q.SEGMENTS}, cl AS (SELECT row_number() OVER (ORDER BY doc_id, span_start, span_end) - 1 AS clause_id, doc_id, number, section_key, span_start, span_end, text
    FROM segments JOIN charters USING (doc_ord)),
units AS (SELECT row_number() OVER (ORDER BY doc_id, clause_id, k) - 1 AS unit_id, clause_id, doc_id, substring(text, k * 1350 + 1, 1500) AS text
    FROM (SELECT *, unnest(range(CAST(ceil(greatest(length(text) - 1500, 0) / 1350.0) AS BIGINT) + 1)) AS k FROM cl))"""
S_FOUND = Q.s_scores(Q.BODIES).split(T.UNITS + ", ", 1)[1]


def _built(spark: SparkSession, root: str) -> Index:
    docs = materialise(T.charters(spark, root).select("doc_id", "source_path", "md_text"))
    return Index.build(docs, normaliser="none")


@query(
    "index_search",
    f"""WITH {S_BUILT}, {S_FOUND}, inside AS (SELECT scores.* FROM scores JOIN units USING (unit_id) JOIN cl USING (clause_id) WHERE {Q.S_IN_SECTION}),
    {Q.s_clause_rank("inside", 50, 3)} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, number, span_start, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM best JOIN cl USING (clause_id)""",
)
def index_search(spark: SparkSession, root: str) -> DataFrame:
    """Listed bodies in the eighth sections of an index built from the charters."""
    index = _built(spark, root)
    found = index.search(T.bodies(spark, root), "bm25", 3, section="8").join(index.tables["clauses"], "clause_id")
    return found.select("query_id", "doc_id", "number", "span_start", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    "index_of_one_document",
    f"""WITH {S_BUILT}, {S_FOUND}, inside AS (SELECT scores.* FROM scores JOIN units USING (unit_id) WHERE doc_id = (SELECT min(doc_id) FROM charters)),
    {Q.s_clause_rank("inside", 50, 3)} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, number, span_start, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM best JOIN cl USING (clause_id)""",
)
def index_of_one_document(spark: SparkSession, root: str) -> DataFrame:
    """Listed bodies in the first charter; frequencies stay those of all."""
    index = _built(spark, root)
    first = index.tables["documents"].agg(F.min("doc_id")).first()[0]
    found = index.search(T.bodies(spark, root), "bm25", 3, doc=first).join(index.tables["clauses"], "clause_id")
    return found.select("query_id", "doc_id", "number", "span_start", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query(
    "manifest_counts",
    f"""WITH {S_BUILT} SELECT 'documents' AS part, count(*) AS n FROM charters UNION ALL SELECT 'sections', count(*) FROM sections UNION ALL SELECT 'clauses', count(*) FROM cl
    UNION ALL SELECT 'units', count(*) FROM units UNION ALL SELECT 'terms', count(DISTINCT w) FROM (SELECT unnest({Q.s_tokens("text")}) AS w FROM units)
    UNION ALL SELECT 'postings', count(*) FROM (SELECT DISTINCT unit_id, unnest({Q.s_tokens("text")}) AS w FROM units)""",
)
def manifest_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows of each table of a saved index, as its manifest says; deleted again."""
    path = scratch(spark)
    _built(spark, root).save(spark, path)
    counts = store.manifest(spark, path)["counts"]
    store.delete(spark, path)
    return spark.createDataFrame(sorted(counts.items()), "part string, n long")


# ---------------------------------------------------------------- contexts and navigation

WARM = 9000


@query(
    "bm25_warm_context",
    f"""WITH {Q.S_CHUNK_BEST.replace("r <= 12", "r <= 6")} SELECT p.query_id, p.doc_ord AS doc,
        left(coalesce(string_agg(h.chunk, chr(10) || chr(10) ORDER BY h.chunk_no), any_value(f.chunk)), {WARM}) AS context
    FROM pairs p JOIN hchunks f ON f.doc_ord = p.doc_ord AND f.chunk_no = 0 LEFT JOIN cb ON cb.query_id = p.query_id AND cb.doc_ord = p.doc_ord
    LEFT JOIN hchunks h ON h.doc_ord = p.doc_ord AND h.chunk_no = cb.chunk_no WHERE p.query_id = (SELECT min(body_id) FROM governing_bodies) GROUP BY 1, 2""",
)
def bm25_warm_context(spark: SparkSession, root: str) -> DataFrame:
    """A first context of the first listed body in each charter: six chunks, at most 9,000 characters."""
    chunks = materialise(Q.hierarchical_chunks(spark, root).select(F.col("doc_ord").alias("doc"), "chunk_no", "chunk"))
    numbered = materialise(parse.ordinals(chunks, "doc", "chunk_no", name="unit_id"))
    index = lexical.build(numbered, "unit_id", "chunk")
    body = T.bodies(spark, root).orderBy("query_id").limit(1)
    found = lexical.asked(index, body, "query_id", "text").join(numbered.select("unit_id", "doc", "chunk_no"), "unit_id")
    every = chunks.select("doc").distinct().join(F.broadcast(body.select("query_id")))
    return chunking.contexts(found, chunks, 6, WARM, every)


@query(
    "read_section_cut",
    Q.SQL["read_section"].replace("SELECT c.doc_ord", "SELECT doc_ord, section_key, CASE WHEN length(t) > 500 THEN left(t, 500) || chr(10) || '… [cut]' ELSE t END AS section_text FROM (SELECT c.doc_ord").replace("AS section_text\n", "AS t\n", 1) + ")",
)
def read_section_cut(spark: SparkSession, root: str) -> DataFrame:
    return toc.read(T.charters(spark, root), "doc_ord", "md_text", "Статья 8", most=500)


S_HOME, S_LISTED = Q.SQL["toc_entries"].split("grouped AS (", 1)[0], "list(number ORDER BY list_transform(string_split(number, '.'), lambda p: coalesce(try_cast(p AS INT), 0)), number)"


@query(
    "toc_with_clauses",
    f"""{S_HOME} grouped AS (SELECT doc_ord, section_key, {S_LISTED} AS l FROM home GROUP BY 1, 2)
    SELECT e.doc_ord, '=== ' || e.doc_ord || ' ===' || chr(10) || string_agg(repeat('  ', greatest(0, level - 1)) || '[' || e.section_key || '] ' || title
        || CASE WHEN len(l) > 0 THEN chr(10) || repeat('  ', greatest(0, level - 1)) || '      пункты: ' || array_to_string(l[1:14], ', ')
            || CASE WHEN len(l) > 14 THEN ', … (всего ' || len(l) || ')' ELSE '' END ELSE '' END, chr(10) ORDER BY line_start) AS outline
    FROM entries e LEFT JOIN grouped USING (doc_ord, section_key) GROUP BY 1""",
)
def toc_with_clauses(spark: SparkSession, root: str) -> DataFrame:
    """Outlines with the clauses of each section, fourteen at most."""
    return toc.outline(Q._entries(spark, root), "doc_ord", clauses=True)


# ---------------------------------------------------------------- conversations and evaluation


@query(
    "token_usage",
    """SELECT user_id AS conv_id, CAST(CASE WHEN sum(CASE WHEN user_id % 2 = 0 THEN length(props) ELSE 0 END) > 0 THEN sum(length(props)) ELSE max(event_id) END AS BIGINT) AS tokens FROM events GROUP BY 1""",
)
def token_usage(spark: SparkSession, root: str) -> DataFrame:
    """Tokens of each conversation; where messages have none, the stated total."""
    own = F.when(F.col("user_id") % 2 == 0, F.length("props"))
    rows = table(spark, root, "events").select(F.col("user_id").alias("conv_id"), own.alias("tokens"), F.col("event_id").alias("total"))
    return conversation.usage(rows, "conv_id", "tokens", "total")


S_HINT = conversation.HINT.replace("'", "''")


@query(
    "readable_blocks",
    f"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'text:' || event_type WHEN 1 THEN 'text:{S_HINT}' WHEN 2 THEN 'text:' || event_type ELSE 'other:' || event_type || '|text:{S_HINT}' END AS blocks FROM events""",
)
def readable_blocks(spark: SparkSession, root: str) -> DataFrame:
    """Content blocks without binary ones: text alone, an image alone, both, an image beside another kind."""
    form, body = F.col("event_id") % 4, F.col("event_type")
    block = lambda kind: F.struct(F.lit(kind).alias("type"), body.alias("text"))
    blocks = (
        F.when(form == 0, F.array(block("text")))
        .when(form == 1, F.array(block("image_url")))
        .when(form == 2, F.array(block("file"), block("text")))
        .otherwise(F.array(block("other"), block("audio")))
    )
    kept = table(spark, root, "events").select("event_id", conversation.text_blocks(blocks).alias("b"))
    return kept.select("event_id", F.array_join(F.transform("b", lambda x: F.concat(x["type"], F.lit(":"), x["text"])), "|").alias("blocks"))


@query(
    "field_evidence",
    """WITH ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn FROM events),
    f AS (SELECT user_id AS conv, arg_max(event_type, turn) AS last, coalesce(string_agg(CASE WHEN event_type = 'purchase' THEN event_type END, chr(10) || chr(10) ORDER BY turn), '') AS said FROM ev GROUP BY 1)
    SELECT conv, 'органы' AS field, left('отчёт ' || conv || chr(10) || chr(10) || CASE WHEN length(last) < 200 AND length(said) > length(last) THEN said ELSE last END, 300) AS evidence FROM f""",
)
def field_evidence(spark: SparkSession, root: str) -> DataFrame:
    """What a field is read from: its report, then the last message or all that the assistant said."""
    of = Q._messages(spark, root).withColumnRenamed("conv_id", "conv")
    reports = of.select("conv").distinct().select("conv", F.lit("органы").alias("field"), F.concat(F.lit("отчёт "), "conv").alias("report"))
    return extraction.evidence(of, reports, "conv", "turn", most=300)


@query(
    "training_reports",
    """SELECT n_nationkey AS sample, '## ' || n_nationkey || chr(10) || chr(10) || '| before | after | delta | result |' || chr(10) || '|---|---|---|---|' || chr(10)
        || '| ' || printf('%.2f', n_regionkey / 4.0) || ' | ' || printf('%.2f', n_nationkey / 31.0) || ' | ' || printf('%+.2f', n_nationkey / 31.0 - n_regionkey / 4.0) || ' | '
        || CASE n_nationkey % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rolled back' ELSE 'no edits' END || ' |' || chr(10) AS section FROM nation""",
)
def training_reports(spark: SparkSession, root: str) -> DataFrame:
    """A section for each sample of a training run."""
    form = F.col("n_nationkey") % 3
    rows = table(spark, root, "nation").select(
        F.col("n_nationkey").alias("sample"), (F.col("n_regionkey") / 4).alias("before"), (F.col("n_nationkey") / 31).alias("after"),
        F.when(form == 0, True).when(form == 1, False).alias("accepted"),
    )
    return evaluation.training_report(rows, "sample")


@query(
    "trials",
    "SELECT n_nationkey AS sample, n_nationkey / 32.0 >= n_regionkey / 4.0 AS accepted, CAST(greatest(n_nationkey / 32.0, n_regionkey / 4.0) AS DOUBLE) AS score FROM nation",
)
def trials(spark: SparkSession, root: str) -> DataFrame:
    """Changes that are kept because the score did not fall."""
    rows = table(spark, root, "nation").select(F.col("n_nationkey").alias("sample"), (F.col("n_regionkey") / 4).alias("b"), (F.col("n_nationkey") / 32).alias("a"))
    return evaluation.trial(rows.select("sample", F.col("b").alias("score")), rows.select("sample", F.col("a").alias("score")), "sample")


# ---------------------------------------------------------------- planted rows

RUNS = [("/a/1/result.md", 1), ("/a/2/result.md", 5), ("/a/3/other.md", 9), ("/a/4/result.md", 5)]
PATHS = [("/input/a.md", True), ("/scratch/b/c.md", True), ("/input/../etc/x", False), ("/inputs/a", False), ("/input/a..b", True), ("input/a", False)]
ANSWERS = [
    ('{"a": 1}', '{"a": 1}'), ("<think>[0]</think>```json\n[1, 2]\n```", "[1, 2]"), ('so: {"queries": ["x"]} end', '["x"]'), ("so: {broken} [1", "null"), ("none", "null"),
    ('a [b] {"c": "]"}', '{"c": "]"}'), ("", "null"), ("7", "7"),
]


@query("planted_paths", s_values([(p, int(ok)) for p, ok in PATHS], "path, ok"))
def planted_paths(spark: SparkSession, root: str) -> DataFrame:
    """Paths under an allowed root that don't climb out of it."""
    rows = spark.createDataFrame([(p,) for p, _ in PATHS], "path string")
    kept = files.allowed(rows, "path").withColumn("ok", F.lit(1))
    return rows.join(kept, "path", "left").select("path", F.coalesce("ok", F.lit(0)).alias("ok"))


@query("planted_runs", "SELECT '/a/2' AS run_dir")
def planted_runs(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete run."""
    return store.latest_run(spark.createDataFrame(RUNS[:3], "path string, modificationTime long"))


@query("planted_answers", s_values(ANSWERS, "answer, value"))
def planted_answers(spark: SparkSession, root: str) -> DataFrame:
    """JSON of a model's answers: the whole, else the first array, else the first object."""
    rows = [(a, json.dumps(extraction.first_json(a), ensure_ascii=False)) for a, _ in ANSWERS]
    return spark.createDataFrame(rows, "answer string, value string")


def _plan(**more) -> str:
    return json.dumps({"queries": ["q"], "aspects": ["a", "b"]} | more)


def _grades(*items: tuple) -> str:
    return json.dumps([{"id": i, "verdict": v, "aspects": a} for i, v, a in items])


#: Name, answers of the model, limits; then what is due: degraded, calls, rounds, clauses with verdicts.
ROUNDS = [
    ("unreadable plan", ["no"], {}, 1, 1, 0, "1: 2: 3:"),
    ("plan that is a list", ["[1]"], {}, 1, 1, 0, "1: 2: 3:"),
    ("failed reflection", [_plan(), "no"], {}, 1, 2, 1, "1: 2: 3:"),
    ("verdicts outside the list", [_plan(), _grades(("C1", "good", []), ("C2", "bad", []))], {}, 1, 2, 1, "1: 2: 3:"),
    ("no calls left", [_plan()], {"calls": 1}, 1, 1, 1, "1: 2: 3:"),
    ("partial covers", [_plan(), _grades(("C2", "partial", [1, 2]), ("C1", "Relevant ", []), ("9", "relevant", [1]))], {}, 0, 2, 1, "1:relevant 2:partial"),
    ("enough relevant", [_plan(), _grades(("C1", "relevant", []), ("the 3rd", "relevant", None))], {"top_k": 2}, 0, 2, 1, "1:relevant 3:relevant"),
    ("refined once", [_plan(), _grades(("1", "irrelevant", [])), json.dumps({"queries": ["r"]}), _grades(("C1", "relevant", ["1", "2"]))], {}, 0, 4, 2, "2:relevant"),
    ("nothing accepted", [_plan(), _grades(("C1", "irrelevant", [])), "no"], {}, 0, 3, 1, "1: 2: 3:"),
    ("failed refinement", [_plan(), _grades(("C2", "partial", [1])), "no"], {}, 0, 3, 1, "2:partial"),
]


@query("planted_rounds", s_values([(r[0], *r[3:]) for r in ROUNDS], "name, degraded, calls, rounds, found"))
def planted_rounds(spark: SparkSession, root: str) -> DataFrame:
    """Searches in rounds with scripted models."""
    rows = []
    for name, answers, limits, *_ in ROUNDS:
        told = iter(answers)
        found = agentic.agentic_search(
            "q", lambda q, k: [(1, 0.9, "один"), (2, 0.5, "два"), (3, 0.1, "три")][:k], lambda p, k: [], lambda text, told=told: next(told), agentic.Limits(**limits)
        )
        rows.append((name, int(found.degraded), found.calls, found.rounds, " ".join(f"{c}:{v}" for c, _, v, _ in found.rows)))
    return spark.createDataFrame(rows, "name string, degraded int, calls int, rounds int, found string")
