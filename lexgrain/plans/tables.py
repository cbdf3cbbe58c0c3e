"""The project's tables as the operators want them: one row for each delivered thing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.runtime import table


def charters(spark: SparkSession, root: str) -> DataFrame:
    """Charters with a text, the latest delivery of each: ``doc_ord``, ``doc_id``, ``source_path``, ``md_text``."""
    latest = F.max_by(F.struct("doc_id", "source_path", "md_text"), "loaded_at").alias("d")
    rows = table(spark, root, "documents_in").where("md_text is not null").groupBy("doc_ord").agg(latest)
    return rows.select("doc_ord", "d.doc_id", "d.source_path", "d.md_text")


def clauses(spark: SparkSession, root: str) -> DataFrame:
    """Clauses, the latest delivery of each."""
    columns = ("doc_id", "number", "section_key", "span_start", "span_end", "text")
    latest = F.max_by(F.struct(*columns), "loaded_at").alias("c")
    rows = table(spark, root, "clauses").groupBy("clause_id").agg(latest)
    return rows.select("clause_id", *[f"c.{c}" for c in columns])


def units(spark: SparkSession, root: str) -> DataFrame:
    """Index windows with their text: ``unit_id``, ``clause_id``, ``doc_id``, ``text``."""
    latest = F.max_by(F.struct("clause_id", "doc_id", "span_start", "span_end"), "indexed_at").alias("u")
    windows = table(spark, root, "chunks").groupBy("unit_id").agg(latest).select("unit_id", "u.*")
    texts = clauses(spark, root).select("clause_id", F.col("text").alias("_t"))
    cut = F.substring(F.col("_t"), F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))
    return windows.join(texts, "clause_id").select("unit_id", "clause_id", "doc_id", F.coalesce(cut, F.lit("")).alias("text"))


def bodies(spark: SparkSession, root: str) -> DataFrame:
    """Listed bodies as a query set: ``query_id``, ``text``."""
    return table(spark, root, "governing_bodies").select(F.col("body_id").alias("query_id"), F.col("canonical_name").alias("text"))


#: The same tables in SQL, as common table expressions.
CHARTERS = """charters AS (
    SELECT doc_ord, arg_max(doc_id, loaded_at) AS doc_id, arg_max(source_path, loaded_at) AS source_path,
           arg_max(md_text, loaded_at) AS md_text
    FROM documents_in WHERE md_text IS NOT NULL GROUP BY doc_ord)"""
CLAUSES = """cl AS (
    SELECT clause_id, doc_id, number, section_key, span_start, span_end, text FROM (
        SELECT *, row_number() OVER (PARTITION BY clause_id ORDER BY loaded_at DESC) AS rn FROM clauses) WHERE rn = 1)"""
UNITS = f"""{CLAUSES}, units AS (
    SELECT u.unit_id, u.clause_id, u.doc_id,
           coalesce(substring(cl.text, u.span_start + 1, u.span_end - u.span_start), '') AS text
    FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY indexed_at DESC) AS rn FROM chunks) u
    JOIN cl USING (clause_id) WHERE u.rn = 1)"""
