"""An index as Parquet tables with a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "lexgrain-index", 1
TABLES = ("documents", "sections", "clauses", "units", "vectors", "postings", "terms")
_MANIFEST = "manifest.json"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def is_index(spark: SparkSession, root: str) -> bool:
    """Whether a folder holds an index: a manifest of the right format."""
    try:
        return manifest(spark, root).get("format") == FORMAT
    except (FileNotFoundError, ValueError):
        return False


def manifest(spark: SparkSession, root: str) -> dict:
    fs, _, Path = _fs(spark, root)
    at = Path(f"{root}/{_MANIFEST}")
    if not fs.exists(at):
        raise FileNotFoundError(f"{root} is no index: it has no {_MANIFEST}")
    lines = spark.read.text(f"{root}/{_MANIFEST}", wholetext=True).first()
    return json.loads(lines[0])


def delete(spark: SparkSession, root: str) -> bool:
    """Delete an index; False if nothing is there, an error if it is something else."""
    fs, p, _ = _fs(spark, root)
    if not fs.exists(p):
        return False
    if not is_index(spark, root):
        raise ValueError(f"{root} is not an index; it stays")
    return bool(fs.delete(p, True))


def save(spark: SparkSession, root: str, tables: dict[str, DataFrame], facts: dict | None = None) -> None:
    """Write the tables, then the manifest.  An index there is replaced, anything else refused."""
    fs, p, Path = _fs(spark, root)
    if fs.exists(p) and not is_index(spark, root) and len(fs.listStatus(p)):
        raise ValueError(f"{root} isn't empty and is not an index")
    delete(spark, root) if fs.exists(p) and is_index(spark, root) else None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    counts = {name: spark.read.parquet(f"{root}/{name}").count() for name in tables}
    body = json.dumps({"format": FORMAT, "version": VERSION, "counts": counts} | (facts or {}), ensure_ascii=False)
    out = fs.create(Path(f"{root}/{_MANIFEST}"), True)
    out.write(bytearray(body.encode()))
    out.close()


def load(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of an index; clause and unit texts are sliced from the documents by their spans."""
    facts = manifest(spark, root)
    if facts.get("format") != FORMAT or facts.get("version") != VERSION:
        raise ValueError(f"{root} has format {facts.get('format')!r}, version {facts.get('version')!r}")
    found = {name: spark.read.parquet(f"{root}/{name}") for name in facts["counts"]}
    if {"documents", "clauses"} <= set(found):
        found["clauses"] = sliced(found["clauses"], found["documents"], "doc_id", "md_text")
        if "units" in found:
            found["units"] = sliced(found["units"], found["clauses"], "clause_id", "text")
    return found


def sliced(spans: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """Spans with their ``text`` cut from the text of the same key."""
    cut = F.substring(F.col("_t"), F.col("span_start").cast("int") + 1, (F.col("span_end") - F.col("span_start")).cast("int"))
    return spans.drop("text").join(texts.select(key, F.col(text).alias("_t")), key).withColumn("text", cut).drop("_t")


def write_jsonl(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines don't count and a missing path has no rows."""
    fs, p, _ = _fs(spark, path)
    if not fs.exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path)


def write_results(results: DataFrame, reports: DataFrame, key: str, root: str) -> None:
    """Results as JSON lines under ``structured``, reports (``key``, ``report``) as JSON lines
    under ``reports``; a run that is there is replaced.

    Rows lie in as many files as the tables have partitions, whatever the number of keys.
    """
    write_jsonl(results, f"{root}/structured")
    write_jsonl(reports.select(key, "report"), f"{root}/reports")


def read_results(spark: SparkSession, root: str, key: str, key_type: str, schema: str) -> DataFrame:
    """A run's results (``schema``) with ``body``: the report or, without one, the result as JSON in a fence.

    A run with neither is an error; reports without a result come with nulls.
    """
    fs, _, Path = _fs(spark, root)
    there = [fs.exists(Path(f"{root}/{part}")) for part in ("structured", "reports")]
    if not any(there):
        raise FileNotFoundError(f"{root} has no results and no reports")
    results = read_jsonl(spark, f"{root}/structured", schema)
    reports = read_jsonl(spark, f"{root}/reports", f"{key} {key_type}, report string")
    fenced = F.concat(F.lit("# Output\n\n```json\n"), F.col("_json"), F.lit("\n```\n"))
    told = results.withColumn("_json", F.to_json(F.struct(*results.columns)))
    return told.join(reports, key, "full").withColumn("body", F.coalesce("report", fenced)).drop("_json", "report")


def latest_run(files: DataFrame, result: str = "result.md") -> DataFrame:
    """Latest complete run: ``run_dir`` with the newest result file (path, modificationTime)."""
    done = files.where(F.regexp_extract("path", r"([^/]*)$", 1) == result)
    run = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return done.agg(F.max_by(run, "modificationTime").alias("run_dir")).where("run_dir is not null")


def cached(new: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows whose key the cache lacks, each key once."""
    return new.dropDuplicates([key]).join(cache.select(key), key, "left_anti")
