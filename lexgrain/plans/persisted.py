"""The lexical index of a data set, built once in the shared folder and read by every query."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators import lexical, vectors
from lexgrain.plans import tables as T
from lexgrain.runtime import file_system, materialise, shared_dir
from lexgrain.sources import store

#: Part of the folder's name: another one makes all indexes anew.
LAYOUT = 1


@dataclass(frozen=True)
class Searchable:
    """Units (unit_id, clause_id), their lexical index and their hashing vectors (unit_id, dim, value)."""

    units: DataFrame
    lexical: lexical.LexicalIndex
    hashed: DataFrame


def fingerprint(spark: SparkSession, root: str, names: tuple[str, ...]) -> str:
    """Mark of a data set's tables: paths, sizes and times of their files."""
    seen = []
    for name in names:
        fs, at = file_system(spark, f"{root}/{name}.parquet")
        found = fs.listFiles(at, True)
        while found.hasNext():
            f = found.next()
            seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:16]


def searchable(spark: SparkSession, root: str, normaliser: str = "none") -> Searchable:
    """The index of a data set's units, from the shared folder if it is there.

    An index is whole once its manifest is there, which is written last; one whose tables
    changed since has another name.
    """
    path = f"{shared_dir(spark)}/lexgrain-index-{LAYOUT}-{normaliser}-{fingerprint(spark, root, ('chunks', 'clauses'))}"
    if not store.is_index(spark, path):
        units = materialise(T.units(spark, root))
        built = lexical.build(units, "unit_id", "text", normaliser=normaliser)
        hashed = vectors.hashed(units, "unit_id", "text").repartitionByRange("dim").sortWithinPartitions("dim", "unit_id")
        tables = {"units": units.select("unit_id", "clause_id"), "vectors": hashed} | built.tables()
        store.save(spark, path, tables, {"lexical": built.facts()})
        fs, at = file_system(spark, path)
        fs.deleteOnExit(at)
    found = store.load(spark, path)
    return Searchable(found["units"], lexical.LexicalIndex.of(found, store.manifest(spark, path)["lexical"]), found["vectors"])


def hashed_scores(index: Searchable, queries: DataFrame) -> DataFrame:
    """Cosine of all units with each query (query_id, text), over shared dimensions only."""
    asked = vectors.hashed(queries, "query_id", "text").select("query_id", "dim", F.col("value").alias("q"))
    # at most 256 dimensions; those of the queries go into the scan as values
    dims = [r.dim for r in asked.select("dim").distinct().collect()]
    joined = index.hashed.where(F.col("dim").isin(dims)).join(asked, "dim")
    return joined.groupBy("query_id", "unit_id").agg(F.round(F.sum(F.col("value") * F.col("q")), 9).alias("score"))
