"""Whole pipelines: extraction from documents, search over files; and their queries."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.functions import stem as S
from lexgrain.operators import chunking, evaluation, extraction, lexical, parse, vectors
from lexgrain.plans import queries as Q
from lexgrain.plans import tables as T
from lexgrain.plans.index import Index
from lexgrain.plans.persisted import hashed_scores, searchable
from lexgrain.plans.queries import query
from lexgrain.runtime import materialise, table
from lexgrain.sources import files


@dataclass(frozen=True)
class Field:
    """What is extracted: kind "list" or "str", style "name" or "clause", words to find its context by."""

    key: str
    kind: str
    style: str
    keywords: str


def extract_documents(
    docs: DataFrame, doc: str, text: str, fields: list[Field], client: Callable[[str, str], str], k: int = 12, embedder=None
) -> DataFrame:
    """Values of all fields of each document: ``doc``, ``field``, ``values``.

    Documents are cut into chunks under their headings; the ``k`` best for a field's
    keywords (by words, and by meaning if there is an embedder that works) are its context, in
    document order, else the first chunk.  Documents without a text have the fields' defaults.
    """
    spark = docs.sparkSession
    there = docs.select(F.col(doc).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("md_text"))
    chunks = materialise(chunking.hierarchical(there.where("md_text <> ''"), "doc", "md_text").select("doc", "chunk_no", "chunk"))
    numbered = materialise(parse.ordinals(chunks, "doc", "chunk_no", name="unit_id"))
    places = numbered.select("unit_id", "doc", "chunk_no")
    asked = spark.createDataFrame([(i, f.keywords) for i, f in enumerate(fields)], "query_id long, text string")
    index = lexical.build(numbered, "unit_id", "chunk")
    words = lexical.asked(index, asked, "query_id", "text").join(places, "unit_id")
    best = chunking.fused(words, _by_meaning(numbered, asked, places, embedder), k)
    every = chunks.select("doc").distinct().join(F.broadcast(asked.select("query_id")))
    texts = chunking.contexts(best, chunks, k, asked=every)
    specs = spark.createDataFrame([(i, f.key, f.kind, f.style) for i, f in enumerate(fields)], "query_id long, field string, kind string, style string")
    # the fields are a handful; so is their number of rows for each document
    wanted = there.select("doc").distinct().join(F.broadcast(specs))
    return extraction.extract(wanted.join(texts, ["query_id", "doc"], "left"), client)


def _by_meaning(units: DataFrame, asked: DataFrame, places: DataFrame, embedder) -> DataFrame | None:
    """All chunks by cosine with each field's keywords; None without an embedder or if it fails."""
    if embedder is None:
        return None
    try:
        rows = asked.collect()
        near = [(r.query_id, [float(x) for x in v]) for r, v in zip(rows, embedder([r.text for r in rows]))]
        made = materialise(vectors.embed(units, "unit_id", "chunk", embedder))
    except Exception:  # noqa: BLE001 without vectors the ranking by words stands
        return None
    spark = units.sparkSession
    each = spark.createDataFrame(near, "query_id long, q array<double>")
    cosine = vectors.dot(F.col("vec"), F.col("q")) / ((vectors.norm(F.col("vec")) + 1e-9) * (vectors.norm(F.col("q")) + 1e-9))
    scored = made.join(F.broadcast(each)).select("query_id", "unit_id", F.round(cosine, 6).alias("score"))
    return scored.join(places, "unit_id")


@dataclass
class FileSearch:
    """Search over the contents of files; the indexes of the last ``most`` sets of files are kept.

    A set of files is known by the hashes of their contents, so a changed file is indexed anew.
    """

    spark: SparkSession
    embedder: Callable[[list[str]], list[list[float]]] | None = None
    most: int = 8
    _kept: OrderedDict = field(default_factory=OrderedDict)

    def index(self, paths: list[str]) -> Index:
        read = files.binary(self.spark, paths).withColumn("content_key", files.content_key())
        mark = tuple(sorted((r.path, r.content_key) for r in read.select("path", "content_key").collect()))
        if mark not in self._kept:
            texts = files.recognised(read).where("error is null")
            docs = materialise(files.doc_ids(texts, "path").select("doc_id", F.col("path").alias("source_path"), "md_text"))
            index = Index.build(docs)
            if self.embedder is not None:
                index.tables["vectors"] = materialise(vectors.embed(index.tables["units"], "unit_id", "text", self.embedder))
            self._kept[mark] = index
            while len(self._kept) > self.most:
                self._kept.popitem(last=False)
        self._kept.move_to_end(mark)
        return self._kept[mark]

    def search(self, paths: list[str], text: str, method: str = "bm25", k: int = 5) -> DataFrame:
        """``clause_id``, ``doc_id``, ``number``, ``text``, ``score``, ``rank`` of the best clauses."""
        index = self.index(paths)
        asked = self.spark.createDataFrame([(1, text)], "query_id long, text string")
        near = None
        if method != "bm25":
            if self.embedder is None:
                raise RuntimeError(f"method {method!r} needs an embedder")
            near = self.spark.createDataFrame([(1, [float(x) for x in self.embedder([text])[0]])], "query_id long, vec array<double>")
        found = index.search(asked, method, k, query_vectors=near)
        texts = index.tables["clauses"].select("clause_id", "doc_id", "number", "text")
        return found.join(texts, "clause_id").select("clause_id", "doc_id", "number", "text", "score", "rank").orderBy("rank")


# ---------------------------------------------------------------- stems


def s_stem(terms: str) -> str:
    """Stems of a table's terms (``term``) as common table expressions: ``stems`` (term, s)."""

    def less(x: str, kind: dict[str, str]) -> str:
        return f"regexp_replace({x}, '{S.ending(kind)}', '{chr(92) + '1' if 'after' in kind else ''}')"

    return f"""w0 AS (SELECT term, replace(term, 'ё', 'е') AS p FROM ({terms})),
w1 AS (SELECT *, regexp_extract(p, '{S.HEAD}') AS h, length(regexp_extract(p, '{S.R2}')) AS r2 FROM w0),
w2 AS (SELECT *, substring(p, length(h) + 1) AS r FROM w1),
w3 AS (SELECT *, {less("r", S.GERUND)} AS g, {less("r", S.REFLEXIVE)} AS b FROM w2),
w4 AS (SELECT *, {less("b", S.ADJECTIVE)} AS a, {less("b", S.VERB)} AS v, {less("b", S.NOUN)} AS n FROM w3),
w5 AS (SELECT *, regexp_replace(CASE WHEN g <> r THEN g WHEN a <> b THEN {less("a", S.PARTICIPLE)} WHEN v <> b THEN v ELSE n END, 'и$', '') AS x FROM w4),
w6 AS (SELECT *, {less("x", S.DERIVATIONAL)} AS d FROM w5),
w7 AS (SELECT *, CASE WHEN r2 > 0 AND length(h) + length(d) >= r2 THEN d ELSE x END AS y FROM w6),
w8 AS (SELECT *, {less("y", S.SUPERLATIVE)} AS u FROM w7),
stems AS (SELECT term, CASE WHEN h = '' THEN p WHEN u <> y THEN h || regexp_replace(u, 'нн$', 'н')
    WHEN ends_with(y, 'нн') THEN h || regexp_replace(y, 'нн$', 'н') ELSE h || regexp_replace(y, 'ь$', '') END AS s FROM w8)"""


S_WORDS = f"SELECT term FROM tok UNION SELECT unnest({Q.s_tokens(chr(39) + Q.QUESTION + chr(39))})"
S_STEMMED = f"""{T.UNITS}, tok AS (SELECT unit_id, unnest({Q.s_tokens("text")}) AS term FROM units), {s_stem(S_WORDS)},
tf AS (SELECT unit_id, s AS term, count(*) AS tf FROM tok JOIN stems USING (term) GROUP BY 1, 2), dl AS (SELECT unit_id, count(*) AS dl FROM tok GROUP BY 1),
n AS (SELECT (SELECT count(*) FROM units) AS n, (SELECT sum(dl) FROM dl) / (SELECT count(*) FROM units) AS avgdl),
raw AS (SELECT term, count(*) AS df, ln((SELECT n FROM n) - count(*) + 0.5) - ln(count(*) + 0.5) AS idf FROM tf GROUP BY 1),
terms AS (SELECT term, df, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw)"""


@query("term_stats_stem", f"WITH {S_STEMMED} SELECT terms.term, terms.df, round(terms.idf, 6) AS idf FROM terms")
def term_stats_stem(spark: SparkSession, root: str) -> DataFrame:
    return searchable(spark, root, "stem").lexical.terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query(
    "bm25_stem_topk",
    f"""WITH {S_STEMMED}, q AS (SELECT 1 AS query_id, s AS term, count(*) AS qtf FROM (SELECT unnest({Q.s_tokens(chr(39) + Q.QUESTION + chr(39))}) AS term) JOIN stems USING (term) GROUP BY 1, 2),
scores AS (SELECT * FROM (
    SELECT q.query_id, tf.unit_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avgdl FROM n)))), 9) AS score
    FROM q JOIN terms USING (term) JOIN tf USING (term) JOIN dl USING (unit_id) GROUP BY 1, 2) WHERE score > 0),
{Q.s_clause_rank('scores', 50, 5)} SELECT {Q.S_SHOWN} FROM best""",
)
def bm25_stem_topk(spark: SparkSession, root: str) -> DataFrame:
    """The question's clauses by stems of words, the default of a new index."""
    scored, index = Q._bm25(spark, root, Q._one(spark), "stem")
    return Q._shown(Q._top_clauses(scored, index.units, 5))


# ---------------------------------------------------------------- extraction


def s_cut(name: str, scores: str, depth: int) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT doc_id, unit_id, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, unit_id) AS rank
        FROM {scores} JOIN units USING (unit_id)) WHERE rank <= {depth})"""


@query(
    "chunk_hybrid",
    f"""WITH {Q.S_BOTH.split(", b1 AS")[0].split("," + chr(10) + "b1 AS")[0]}, {s_cut("c1", "scores", 15)}, {s_cut("c2", "vscores", 15)},
    f AS (SELECT doc_id, unit_id, round(sum(c), 9) AS fs, max(own) AS own FROM (
        SELECT doc_id, unit_id, CAST(0.7 AS DOUBLE) / (60 + rank) AS c, score AS own FROM c1
        UNION ALL SELECT doc_id, unit_id, (1.0 - CAST(0.7 AS DOUBLE)) / (60 + rank), NULL FROM c2) GROUP BY 1, 2),
    g AS (SELECT doc_id, unit_id, CASE WHEN doc_id IN (SELECT doc_id FROM c2) THEN fs ELSE own END AS score FROM f)
    SELECT doc_id, unit_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (
        SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, unit_id) AS rank FROM g) WHERE rank <= 5""",
)
def chunk_hybrid(spark: SparkSession, root: str) -> DataFrame:
    """The five best windows of each charter for the question, by words and hashing vectors."""
    scored, index = Q._bm25(spark, root, Q._one(spark))
    docs = T.units(spark, root).select("unit_id", F.col("doc_id").alias("doc"), F.col("unit_id").alias("chunk_no"))
    docs = materialise(docs)
    words = scored.join(docs, "unit_id")
    meaning = hashed_scores(index, Q._one(spark)).join(docs, "unit_id")
    got = chunking.fused(words, meaning, 5)
    return got.select(F.col("doc").alias("doc_id"), F.col("chunk_no").alias("unit_id"), F.round("score", 6).alias("score"), "rank")


FIELDS = [
    Field("органы", "list", "name", "совет директоров правление собрание"),
    Field("высший орган", "str", "name", "высший орган общее собрание"),
    Field("сделки", "list", "clause", "крупные сделки одобрение"),
]


@query(
    "extracted_fields",
    f"""WITH d AS (SELECT doc_ord, coalesce(arg_max(coalesce(md_text, ''), loaded_at), '') AS t FROM documents_in GROUP BY 1),
    f AS (SELECT * FROM (VALUES {", ".join(f"('{f.key}', {f.kind == 'str'})" for f in FIELDS)}) AS v(field, single))
    SELECT doc_ord, field, CASE WHEN t <> '' THEN '7.1. ' || field || '|второе' WHEN single THEN '{extraction.NOT_GIVEN}' ELSE '' END AS found
    FROM d CROSS JOIN f WHERE NOT (single AND t <> '') AND field <> 'органы'
    UNION ALL SELECT doc_ord, field, CASE WHEN t = '' THEN '' ELSE field || '|второе' END FROM d CROSS JOIN f WHERE field = 'органы'
    UNION ALL SELECT doc_ord, field, field FROM d CROSS JOIN f WHERE single AND t <> ''""",
)
def extracted_fields(spark: SparkSession, root: str) -> DataFrame:
    """Fields of every charter by a scripted client that repeats the field's name."""
    rows = table(spark, root, "documents_in").withColumn("t", F.coalesce("md_text", F.lit("")))
    docs = rows.groupBy("doc_ord").agg(F.max_by("t", "loaded_at").alias("t"))

    def client(name: str, context: str) -> str:
        return f'```json\n["7.1. {name}", "второе", "{name.upper() if name == "-" else "Второе"}"]\n```' if name != "высший орган" else f'"7.1. {name}"'

    got = extract_documents(docs, "doc_ord", "t", FIELDS, client)
    return got.select(F.col("doc").alias("doc_ord"), "field", F.array_join("values", "|").alias("found"))


CLAUSE_LISTS, NAME_LISTS = ("major_transaction_clauses", "related_party_transaction_clauses"), ("collegial_governing_bodies", "sole_executive_bodies")


@query(
    "field_warnings",
    f"""WITH {Q.S_RUNS}, {T.CHARTERS}, t AS (SELECT doc_id, md_text FROM charters WHERE md_text <> ''),
    i AS ({" UNION ALL ".join(f"SELECT DISTINCT doc_id, '{c}' AS field, '{s}' AS style, unnest({c}) AS value FROM runs" for cs, s in ((CLAUSE_LISTS, "clause"), (NAME_LISTS, "name")) for c in cs)}),
    n AS (SELECT DISTINCT *, regexp_extract(value, '^{Q.X.WS}*({Q.X.DIGIT}+(?:\\.{Q.X.DIGIT}+)*)', 1) AS num FROM i WHERE value IS NOT NULL)
    SELECT doc_id, field, value, 'number_in_name' AS warning FROM n WHERE style = 'name' AND num <> ''
    UNION ALL SELECT DISTINCT doc_id, field, value, 'number_absent' FROM n JOIN t USING (doc_id) WHERE style = 'clause' AND num <> ''
        AND NOT regexp_matches(t.md_text, '(?:^|[^0-9.])' || replace(num, '.', '\\.') || '(?:$|[^0-9.]|\\.(?:$|[^0-9]))')""",
)
def field_warnings(spark: SparkSession, root: str) -> DataFrame:
    """Extracted names that begin with a number, and clause numbers that their charter hasn't."""
    runs = Q._runs(spark, root)
    parts = [
        runs.select("doc_id", F.lit(c).alias("field"), F.lit(s).alias("style"), F.explode(c).alias("value"))
        for cs, s in ((CLAUSE_LISTS, "clause"), (NAME_LISTS, "name"))
        for c in cs
    ]
    items = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("value is not null").distinct()
    return extraction.warnings(items, "doc_id", T.charters(spark, root).select("doc_id", "md_text"), "md_text")


# ---------------------------------------------------------------- evaluation


@query(
    "field_verdicts",
    """WITH e AS (SELECT event_id, event_id % 4 AS form, event_type, CAST(trunc(value) AS INT) AS v FROM events)
    SELECT event_id, CASE WHEN form = 0 THEN 'expected is no JSON' WHEN form = 1 THEN 'actual is no JSON' ELSE '' END AS reason,
        CASE form WHEN 0 THEN NULL WHEN 1 THEN 'kind significant_error "' || event_type || '"|n significant_error ' || CASE WHEN v = 0 THEN '' ELSE CAST(v AS VARCHAR) END
        WHEN 2 THEN 'kind correct |n correct ' ELSE 'kind correct |n significant_error ' END AS verdicts FROM e""",
)
def field_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts on events as JSON: a part of both sides broken, a part of the values wrong."""
    form, n = F.col("event_id") % 4, F.col("value").cast("int")
    whole = F.to_json(F.struct(F.col("event_type").alias("kind"), n.alias("n")))
    wrong = F.to_json(F.struct(F.col("event_type").alias("kind"), (n + 1).alias("n")))
    pairs = table(spark, root, "events").select(
        "event_id",
        F.when(form == 0, "{no").otherwise(whole).alias("expected"),
        F.when(form == 1, "[]").when(form == 3, wrong).otherwise(whole).alias("actual"),
    )

    def judge(want: dict, got: dict) -> list[dict]:
        return [{"field": k, "status": "correct" if got.get(k) == v else "significant_error"} for k, v in want.items()]

    told = evaluation.judged(pairs, "event_id", judge)
    shown = F.transform("verdicts", lambda v: F.concat(v["field"], F.lit(" "), v["status"], F.lit(" "), F.array_join(v["missing"], ";")))
    return told.select("event_id", "reason", F.when(F.size("verdicts") > 0, F.array_join(shown, "|")).alias("verdicts"))


@query(
    "edited_texts",
    """SELECT n_nationkey AS target, CASE n_nationkey % 4 WHEN 0 THEN n_name || chr(10) || 'конец' WHEN 1 THEN 'X' || substring(n_name, 2) WHEN 2 THEN substring(n_name, 2) ELSE n_name END
        || CASE WHEN n_nationkey % 4 = 3 THEN '' ELSE chr(10) || 'ещё' END AS content,
        CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE CASE n_nationkey % 4 WHEN 1 THEN 'X' || substring(n_name, 2) || chr(10) || 'ещё' ELSE n_name END END AS kept FROM nation""",
)
def edited_texts(spark: SparkSession, root: str) -> DataFrame:
    """Texts after edits in order, and after those of even targets were rejected."""
    texts = table(spark, root, "nation").select(F.col("n_nationkey").alias("target"), F.col("n_name").alias("content"))
    first = F.substring("content", 1, 1)
    form = F.col("target") % 4
    none = F.lit(None).cast("string")
    own = texts.where(form < 3).select(
        "target", F.lit(1).alias("ord"), F.when(form == 0, "INSERT").when(form == 1, "MODIFY").otherwise("DELETE").alias("operation"),
        F.when(form > 0, first).alias("old"), F.when(form == 0, "конец").when(form == 1, "X").alias("new"),
    )
    more = texts.where(form < 3).select("target", F.lit(2).alias("ord"), F.lit("INSERT").alias("operation"), none.alias("old"), F.lit("ещё").alias("new"))
    idle = texts.select("target", F.lit(3).alias("ord"), F.lit("MODIFY").alias("operation"), F.lit("нет такого").alias("old"), F.lit("y").alias("new"))
    history = evaluation.with_version(spark.createDataFrame([], "target int, version int, content string"), texts)
    done = evaluation.edited(texts, own.unionByName(more).unionByName(idle))
    kept = evaluation.rolled_back(done, history, texts.where("target % 2 = 0"))
    return done.join(kept.select("target", F.col("content").alias("kept")), "target")
