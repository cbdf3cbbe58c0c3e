"""Scores of extractions and rankings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of verdicts; an unknown verdict weighs 0.
WEIGHTS = {"correct": 1.0, "not_significant_error": 0.7, "significant_error": 0.0}


def weight(status: Column | str) -> Column:
    status = F.col(status) if isinstance(status, str) else status
    value = F.lit(0.0)
    for name, w in WEIGHTS.items():
        value = F.when(status == name, F.lit(w)).otherwise(value)
    return value


def verdict_scores(verdicts: DataFrame, *group: str) -> DataFrame:
    """Mean weight and number of each verdict by group."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in WEIGHTS]
    return verdicts.groupBy(*group).agg(F.round(F.avg(weight("status")), 6).alias("score"), *counts)


_VERDICT = "field string, status string, missing array<string>, extras array<string>"


def judged(pairs: DataFrame, key: str, judge: Callable[[dict, dict], list[dict]]) -> DataFrame:
    """Verdicts on single fields: ``key``, ``reason``, ``verdicts`` (field, status, missing, extras).

    ``pairs``: ``key``, ``expected``, ``actual`` as JSON objects.  ``judge(expected,
    actual)`` runs on the executors.  If ``expected`` is no JSON, or the judge fails, there
    are no verdicts; if ``actual`` is none, every expected field is a significant error
    that misses its whole value (nothing where that is empty).
    """

    def parsed(text: str | None) -> dict | None:
        try:
            value = json.loads(text or "")
        except ValueError:
            return None
        return value if isinstance(value, dict) else None

    def verdicts(expected: str | None, actual: str | None) -> tuple[str, list[dict]]:
        want, got = parsed(expected), parsed(actual)
        if want is None:
            return "expected is no JSON", []
        if got is None:
            lost = ({"field": k, "status": "significant_error", "missing": [json.dumps(v, ensure_ascii=False)] if v else []} for k, v in want.items())
            return "actual is no JSON", list(lost)
        try:
            return "", judge(want, got)
        except Exception as e:  # noqa: BLE001 the client's failure is data here
            return f"the judge failed: {e}", []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("field", pa.string()), ("status", pa.string()), ("missing", pa.list_(pa.string())), ("extras", pa.list_(pa.string()))]))
        for batch in batches:
            told = [verdicts(e, a) for e, a in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            rows = [[{"missing": [], "extras": []} | v for v in found] for _, found in told]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r for r, _ in told], pa.string()), pa.array(rows, kind)], names=[key, "reason", "verdicts"]
            )

    columns = pairs.select(key, "expected", "actual")
    of = dict(pairs.dtypes)[key]
    return columns.mapInArrow(run, f"`{key}` {of}, reason string, verdicts array<struct<{_VERDICT.replace(' string', ':string').replace(' array', ':array')}>>")


def judged_scores(verdicts: DataFrame, key: str) -> DataFrame:
    """``key``, ``score`` (mean weight, 0 without verdicts) and the number of each verdict."""
    each = verdicts.select(key, F.explode_outer("verdicts").alias("v")).select(key, F.col("v.status").alias("status"))
    return verdict_scores(each, key)


def edited(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """Texts with edits applied in order: ``target``, ``content``.

    ``texts``: ``target``, ``content``; ``edits``: ``target``, ``ord``, ``operation``, ``old``,
    ``new``.  INSERT appends a line, MODIFY replaces the first occurrence of ``old``,
    DELETE takes it out; edits without the texts they need, of other operations or of
    unknown targets change nothing.
    """
    has = lambda c: F.coalesce(c != "", F.lit(False))
    listed = edits.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("ord", "operation", "old", "new"))).alias("_e"))

    def step(text: Column, e: Column) -> Column:
        return (
            F.when((e["operation"] == "INSERT") & has(e["new"]), F.concat(text, F.lit("\n"), e["new"]))
            .when((e["operation"] == "MODIFY") & has(e["old"]) & has(e["new"]), replaced_first(text, e["old"], e["new"]))
            .when((e["operation"] == "DELETE") & has(e["old"]), replaced_first(text, e["old"], F.lit("")))
            .otherwise(text)
        )

    joined = texts.select("target", "content").join(listed, "target", "left")
    done = F.aggregate("_e", F.coalesce("content", F.lit("")), step)
    return joined.select("target", F.when(F.col("_e").isNull(), F.col("content")).otherwise(done).alias("content"))


def with_version(history: DataFrame, texts: DataFrame) -> DataFrame:
    """History (``target``, ``version``, ``content``) with the present texts as the next version of each."""
    last = history.groupBy("target").agg(F.max("version").alias("_v"))
    new = texts.join(last, "target", "left").select("target", (F.coalesce("_v", F.lit(0)) + 1).cast("int").alias("version"), "content")
    return history.select("target", "version", "content").unionByName(new)


def rolled_back(texts: DataFrame, history: DataFrame, rejected: DataFrame) -> DataFrame:
    """Texts, of ``rejected`` targets the latest version of the history instead (if it has one)."""
    kept = history.groupBy("target").agg(F.max_by("content", "version").alias("_old"))
    marked = texts.join(rejected.select("target").distinct().withColumn("_no", F.lit(True)), "target", "left").join(kept, "target", "left")
    return marked.select("target", F.when(F.col("_no"), F.coalesce("_old", "content")).otherwise(F.col("content")).alias("content"))


def ranking_quality(hits: DataFrame, relevance: DataFrame, item: str, at: int = 5) -> DataFrame:
    """Mean reciprocal rank and number of relevant items within ``at``, over all judged queries."""
    judged = relevance.where("relevant").select("query_id", item).distinct()
    queries = relevance.select("query_id").distinct()
    first = (
        hits.join(judged, ["query_id", item])
        .groupBy("query_id")
        .agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= at).alias("n"))
    )
    return queries.join(first, "query_id", "left").agg(
        F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("relevant_at_k"),
    )


def trial(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Changes kept where the score did not fall: ``key``, ``accepted``, ``score``."""
    joined = before.select(key, F.col("score").alias("_b")).join(after.select(key, F.col("score").alias("_a")), key)
    return joined.select(key, (F.col("_a") >= F.col("_b")).alias("accepted"), F.greatest("_a", "_b").alias("score"))


def replaced_first(text: Column, old: Column, new: Column) -> Column:
    """Text with the first occurrence of ``old`` replaced; unchanged if there is none."""
    pos = F.call_function("locate", old, text)
    return F.when(pos > 0, F.concat(F.substring(text, F.lit(1), pos - 1), new, F.substring(text, pos + F.length(old), F.length(text)))).otherwise(text)


def training_report(results: DataFrame, key: str) -> DataFrame:
    """One markdown section for each sample (``before``, ``after``, ``accepted``): ``key``, ``section``."""
    delta = F.col("after") - F.col("before")
    verdict = F.when(F.col("accepted"), "accepted").when(F.col("accepted").isNull(), "no edits").otherwise("rolled back")
    line = F.format_string("## %s\n\n| before | after | delta | result |\n|---|---|---|---|\n| %.2f | %.2f | %+.2f | %s |\n", F.col(key), F.col("before"), F.col("after"), delta, verdict)
    return results.select(key, line.alias("section"))
