"""Queries over few planted rows: cases that the tables don't hold, with their results as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrain.operators import fusion
from lexgrain.plans.queries import query
from lexgrain.sources import files


def s_values(rows: list[tuple], columns: str) -> str:
    """Rows as SQL values."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


#: Files in order, and the ids that are due.
NAMED = [
    (1, "/a/a-2.md", "a-2"), (2, "/b/a.md", "a"), (3, "/c/a.md", "a-3"), (4, "/d/a-2-3.md", "a-2-3"), (5, "/e/a-2.md", "a-2-2"),
    (6, "/f/??.md", "doc"), (7, "/g/doc.txt", "doc-2"), (8, "/h/Устав (1).md", "Устав_1"), (9, "/i/устав.md", "устав"),
    (10, "/j/b.md", "b"), (11, "/k/b.md", "b-2"), (12, "/l/b-2.md", "b-2-2"), (13, "/m/b.md", "b-3"), (14, "/n/c", "c"), (15, "/o/.md", ".md"),
]


@query("planted_names", s_values([(n, i) for n, _, i in NAMED], "n, doc_id"))
def planted_names(spark: SparkSession, root: str) -> DataFrame:
    """Ids of files whose names and numbered names meet."""
    rows = spark.createDataFrame([x[:2] for x in NAMED], "n int, path string")
    return files.doc_ids(rows, "path", "n").select("n", "doc_id")


BYTES = [("a.md", b"\xff\xd0\xa1\xd0"), ("b.TXT", "строка\r\nдва".encode()), ("c.pdf", b"%PDF"), ("d.md", b""), ("e", b"x")]


@query(
    "planted_bytes",
    s_values([("a.md", "�С�", None), ("b.TXT", "строка\r\nдва", None), ("c.pdf", None, "unsupported file: .pdf"), ("d.md", "", None), ("e", None, "unsupported file: no suffix")], "path, md_text, error"),
)
def planted_bytes(spark: SparkSession, root: str) -> DataFrame:
    """Texts of files, malformed bytes replaced, other kinds of file refused."""
    return files.recognised(spark.createDataFrame([(p, bytearray(c)) for p, c in BYTES], "path string, content binary"))


PATTERNS = [(r"\w+", 4), (r"\bсовет", 2), (r"\d+", 1), (r"[^\W\d]+\s", 3), ("СОВЕТ", 2), (r"\s", 3)]


@query("planted_patterns", s_values(PATTERNS, "pattern, score"))
def planted_patterns(spark: SparkSession, root: str) -> DataFrame:
    """Matches of classes and in capitals in a Cyrillic text."""
    text = spark.createDataFrame([(1, "Совет директоров совета ٣")], "clause_id int, text string")
    parts = [fusion.grep(text, p).select(F.lit(p).alias("pattern"), F.col("score").cast("int").alias("score")) for p, _ in PATTERNS]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
