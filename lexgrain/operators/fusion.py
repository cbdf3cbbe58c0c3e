"""From unit scores to ranked clauses: aggregation, fusion, scopes, search by pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as X

RRF_K = 60


def by_clause(scored: DataFrame, units: DataFrame) -> DataFrame:
    """Best score of each clause over its units: ``query_id``, ``clause_id``, ``score``."""
    return (
        scored.join(units.select("unit_id", "clause_id"), "unit_id")
        .groupBy("query_id", "clause_id")
        .agg(F.max("score").alias("score"))
    )


def rrf(rankings: list[tuple[DataFrame, float]], item: str, k: int = RRF_K, digits: int = 9) -> DataFrame:
    """Weighted sum of ``1 / (k + rank)`` over rankings (query_id, item, rank from 1)."""
    parts = [d.select("query_id", item, (F.lit(w) / (F.lit(k) + F.col("rank"))).alias("_c")) for d, w in rankings]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("query_id", item).agg(F.round(F.sum("_c"), digits).alias("score"))


def ranked(scored: DataFrame, item: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(order))


def effective_key(number: Column | str, section: Column | str) -> Column:
    """The clause's number or, without one, its section's key."""
    number = F.col(number) if isinstance(number, str) else number
    section = F.col(section) if isinstance(section, str) else section
    return F.coalesce(F.when(number != "", number), section, F.lit(""))


def in_scope(clauses: DataFrame, scope: DataFrame, doc: str) -> DataFrame:
    """Clauses that descend, by number or by section, from one of the scope's
    sections (``doc``, ``section_key``).  An empty scope leaves nothing.

    The prefix test becomes an equality: a clause descends from a section exactly
    if that section's key is among the clause's ancestors.
    """
    keys = F.array_distinct(
        F.concat(
            X.ancestors(effective_key("number", "section_key")),
            X.ancestors(F.coalesce("section_key", F.lit(""))),
            F.array(F.coalesce("section_key", F.lit(""))),
        )
    )
    wanted = scope.select(F.col(doc), F.col("section_key").alias("_k")).distinct()
    hit = clauses.select("clause_id", doc, F.explode(keys).alias("_k")).join(wanted, [doc, "_k"], "left_semi")
    return clauses.join(hit.select("clause_id").distinct(), "clause_id", "left_semi")


def grep(clauses: DataFrame, pattern: str, text: str = "text", ignore_case: bool = True) -> DataFrame:
    """Clauses with the number of matches as ``score`` (Java's regular expressions).

    Classes such as ``\\w`` and ``\\b`` mean what Unicode says.
    """
    flags = "(?iuU)" if ignore_case else "(?U)"
    return clauses.withColumn("score", F.regexp_count(text, F.lit(flags + pattern)).cast("long")).where("score > 0")


def hits(found: DataFrame, clauses: DataFrame, titles: DataFrame, names: DataFrame, doc: str) -> DataFrame:
    """Ranked clauses with their provenance.

    ``titles``: ``doc``, ``section_key``, ``title`` (first of each key);
    ``names``: ``doc``, ``doc_name``.  Adds ``section_path``, ``section_titles``,
    ``breadcrumb`` (titles or keys joined by " › ") and ``locator``.
    """
    at = clauses.select("clause_id", doc, "number", "section_key", "text")
    path = X.ancestors(effective_key("number", "section_key"))
    base = found.join(at, "clause_id").withColumn("section_path", path)
    levels = base.select("query_id", "clause_id", doc, F.posexplode_outer("section_path").alias("_i", "_k"))
    named = (
        levels.join(titles.select(doc, F.col("section_key").alias("_k"), "title"), [doc, "_k"], "left")
        .groupBy("query_id", "clause_id")
        .agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("title", F.lit("")).alias("t"), "_k"))).alias("_l"))
    )
    filled = F.filter("_l", lambda x: x["_k"].isNotNull())
    crumb = F.array_join(F.transform(filled, lambda x: F.when(x["t"] != "", x["t"]).otherwise(x["_k"])), " › ")
    return (
        base.join(named, ["query_id", "clause_id"])
        .join(names, doc, "left")
        .withColumn("section_titles", F.transform(filled, lambda x: x["t"]))
        .withColumn("breadcrumb", crumb)
        .withColumn(
            "locator",
            F.coalesce(
                F.when(F.col("number") != "", F.col("number")),
                F.when(F.col("breadcrumb") != "", F.col("breadcrumb")),
                F.concat("doc_name", F.lit("#"), F.col("clause_id")),
            ),
        )
        .drop("_l")
    )
