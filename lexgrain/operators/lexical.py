"""BM25 over an inverted index kept as tables.

``postings`` (term, unit_id, tf, dl) and ``terms`` (term, df, idf) are aggregated once and can
be stored, ordered by term; a search touches only the rows of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as X
from lexgrain.functions.stem import with_stem
from lexgrain.runtime import materialise

#: Scores are rounded before ranking, so that ties don't hang on the order of sums.
DIGITS = 9


NORMALISERS = ("stem", "none")
#: Query terms that are looked up by value; more are joined.
LOOKED_UP = 1000


@dataclass(frozen=True)
class LexicalIndex:
    """Postings, document frequencies and the corpus figures behind BM25."""

    postings: DataFrame
    terms: DataFrame
    units: int
    mean_length: float
    normaliser: str = "none"

    def facts(self) -> dict:
        """What a manifest must hold beside the tables."""
        return {"units": self.units, "mean_length": self.mean_length, "normaliser": self.normaliser}

    def tables(self) -> dict[str, DataFrame]:
        """The tables as they are stored: postings in ranges of terms, so that readers skip files."""
        return {
            "postings": self.postings.repartitionByRange("term").sortWithinPartitions("term", "unit_id"),
            "terms": self.terms,
        }

    @classmethod
    def of(cls, tables: dict[str, DataFrame], facts: dict) -> LexicalIndex:
        return cls(tables["postings"], tables["terms"], facts["units"], facts["mean_length"], facts["normaliser"])


def resolve_normaliser(name: str) -> str:
    """Normaliser that is available here: ``auto`` is ``stem``; unknown and absent ones are refused."""
    if name == "auto":
        return NORMALISERS[0]
    if name in NORMALISERS:
        return name
    if name == "lemma":
        raise RuntimeError("the normaliser 'lemma' needs a dictionary that isn't here; use 'stem', 'none' or 'auto'")
    raise ValueError(f"normaliser must be one of {NORMALISERS}, 'lemma' or 'auto', got {name!r}")


def postings_of(units: DataFrame, unit: str, text: str, normaliser: str = "none") -> DataFrame:
    """``term``, ``unit_id``, ``tf``, ``dl`` of every unit with a token.

    Words are normalised once each, not wherever they occur.
    """
    words = F.coalesce(X.tokens(text), F.array().cast("array<string>"))
    flat = units.select(F.col(unit).alias("unit_id"), words.alias("_w")).select(
        "unit_id", F.size("_w").alias("dl"), F.explode("_w").alias("term")
    )
    found = flat.groupBy("term", "unit_id", "dl").agg(F.count("*").alias("tf"))
    if normaliser == "none":
        return found
    found = materialise(found)
    stems = with_stem(found.select("term").distinct(), "term", "_s")
    return (
        found.join(stems, "term")
        .groupBy(F.col("_s").alias("term"), "unit_id", "dl")
        .agg(F.sum("tf").alias("tf"))
    )


def build(units: DataFrame, unit: str, text: str, epsilon: float = 0.25, normaliser: str = "none") -> LexicalIndex:
    """Index of a table of units; units without tokens count as documents of length 0."""
    postings = materialise(postings_of(units, unit, text, normaliser))
    n = units.count()
    raw = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    terms = materialise(raw.withColumn("idf", F.ln(F.lit(n) - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)))
    figures = terms.agg(F.sum("cf"), F.avg("idf")).first()
    least = epsilon * (figures[1] or 0.0)
    floored = terms.select("term", "df", F.when(F.col("idf") < 0, F.lit(least)).otherwise(F.col("idf")).alias("idf"))
    return LexicalIndex(postings, floored, n, (figures[0] or 0) / max(n, 1), normaliser)


def query_terms(queries: DataFrame, query: str, text: str, normaliser: str = "none") -> DataFrame:
    """``query_id``, ``term``, ``qtf`` (how often the query has the term)."""
    words = queries.select(F.col(query).alias("query_id"), F.explode(X.tokens(text)).alias("term"))
    if normaliser != "none":
        words = with_stem(words, "term", "_s").select("query_id", F.col("_s").alias("term"))
    return words.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: LexicalIndex, terms: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``query_id``, ``unit_id``, ``score`` of all units that score above 0."""
    tf, dl = F.col("tf"), F.col("dl")
    norm = tf + k1 * (1 - b + b * dl / F.lit(index.mean_length or 1.0))
    gain = F.col("qtf") * F.col("idf") * tf * (k1 + 1) / norm
    # query terms are few and come first: their idf, then only their postings
    wanted = terms.join(index.terms.select("term", "idf"), "term")
    return (
        index.postings.join(wanted, "term")
        .groupBy("query_id", "unit_id")
        .agg(F.round(F.sum(gain), DIGITS).alias("score"))
        .where("score > 0")
    )


def asked(index: LexicalIndex, queries: DataFrame, query: str, text: str) -> DataFrame:
    """Scores of queries (see :func:`scores`) against an index, in the index's normal form.

    Up to ``LOOKED_UP`` rows of query terms go into the scans as values, so that stored
    postings are read by their ranges; more are written and joined.
    """
    terms = query_terms(queries, query, text, index.normaliser)
    known = terms.limit(LOOKED_UP + 1).collect()
    if len(known) > LOOKED_UP:
        return scores(index, materialise(terms))
    only = F.col("term").isin(sorted({r.term for r in known}))
    few = LexicalIndex(index.postings.where(only), index.terms.where(only), index.units, index.mean_length, index.normaliser)
    return scores(few, queries.sparkSession.createDataFrame(known, terms.schema))


#: Query terms (rows of query and term) that :func:`rank` keeps in every worker.
RANKED_TERMS = 2_000_000
#: Cells of the block of queries that a worker holds at a time.
_CELLS = 8_000_000


def rank(index: LexicalIndex, queries: DataFrame, query: str, text: str, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``k`` best units of each query of a stated set: ``query_id``, ``unit_id``, ``score``, ``rank``.

    The same scores as :func:`scores`, for many long queries: these are collected (at
    most ``RANKED_TERMS`` terms, refused beyond) and every task holds its units against all of them,
    in blocks, passing on its own best ``k`` only, so that no pair of a query and a unit is
    ever a row.
    """
    terms = query_terms(queries, query, text, index.normaliser).join(index.terms.select("term", "idf"), "term")
    rows = terms.select("query_id", "term", "qtf", "idf").limit(RANKED_TERMS + 1).collect()
    if len(rows) > RANKED_TERMS:
        raise ValueError(f"more than {RANKED_TERMS} query terms; pass the queries in parts")
    ids = sorted({r.query_id for r in rows})
    idf = {r.term: r.idf for r in rows}
    place, number = {q: n for n, q in enumerate(ids)}, {t: n for n, t in enumerate(sorted(idf))}
    told = (
        np.array([place[r.query_id] for r in rows], np.int32),
        np.array([number[r.term] for r in rows], np.int32),
        np.array([float(r.qtf) for r in rows]),
    )
    spark = queries.sparkSession
    shared = spark.sparkContext.broadcast((ids, told, len(number)))
    known = spark.createDataFrame([(t, n, idf[t]) for t, n in number.items()], "term string, no int, idf double")
    tf, dl = F.col("tf"), F.col("dl")
    gain = F.col("idf") * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(index.mean_length or 1.0)))
    units = index.postings.join(known, "term").groupBy("unit_id").agg(F.collect_list(F.struct("no", gain.alias("w"))).alias("ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, (query_no, term_no, qtf), n_terms = shared.value
        width = max(1, min(len(names), _CELLS // max(1, n_terms)))
        best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # query, score, unit
        least = np.zeros(len(names))
        for batch in batches:
            unit = batch.column(0).to_numpy()
            flat = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(flat).to_numpy())])
            inner = flat.flatten()
            cols, weights = inner.field(0).to_numpy(), inner.field(1).to_numpy()
            for low in range(0, len(names), width):
                mine = (query_no >= low) & (query_no < low + width)
                table = np.zeros((n_terms, min(width, len(names) - low)))
                table[term_no[mine], query_no[mine] - low] = qtf[mine]
                for at in range(0, len(unit), 256):
                    part = range(at, min(at + 256, len(unit)))
                    got = np.round([weights[ends[u] : ends[u + 1]] @ table[cols[ends[u] : ends[u + 1]]] for u in part], DIGITS)
                    u, q = np.nonzero((got > 0) & (got >= least[low : low + table.shape[1]]))
                    if len(u):
                        best = _best(tuple(np.concatenate(x) for x in zip(best, (q + low, got[u, q], unit[u + at]))), k, least)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(names, np.int64)[best[0]] if len(best[0]) else [], pa.int64()), pa.array(best[2], pa.int64()), pa.array(best[1], pa.float64())],
            names=["query_id", "unit_id", "score"],
        )

    return top(units.mapInArrow(run, "query_id long, unit_id long, score double"), k)


def _best(found: tuple, k: int, least: np.ndarray) -> tuple:
    """The ``k`` best rows of each query, ties to the lower unit; ``least`` takes the scores of the last ones."""
    query, score, unit = found
    order = np.lexsort((unit, -score, query))
    query, score, unit = query[order], score[order], unit[order]
    starts = np.flatnonzero(np.diff(query, prepend=-1))
    nth = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    last = nth == k - 1
    least[query[last]] = score[last]
    keep = nth < k
    return query[keep], score[keep], unit[keep]


def top(scored: DataFrame, k: int, item: str = "unit_id", by: str = "score") -> DataFrame:
    """The ``k`` best items of each query with ``rank`` from 1; ties go to the lower id."""
    best = Window.partitionBy("query_id").orderBy(F.desc(by), item)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
