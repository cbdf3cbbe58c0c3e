"""Files as input: expansion, recognition, document ids, hashes."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrain.runtime import file_system, materialise

TEXT_SUFFIXES = (".md", ".txt", ".markdown")


def expand(inputs: str | Iterable[str]) -> list[str]:
    """Files of a path, a directory (sorted, without hidden ones, not below it) or several.

    Each file once, by its resolved path, in the order given; a missing path raises.
    """
    paths = [inputs] if isinstance(inputs, str) else list(inputs)
    out: dict[str, str] = {}
    for path in paths:
        if os.path.isdir(path):
            names = sorted(n for n in os.listdir(path) if not n.startswith("."))
            found = [os.path.join(path, n) for n in names if os.path.isfile(os.path.join(path, n))]
        elif os.path.exists(path):
            found = [path]
        else:
            raise FileNotFoundError(path)
        for file in found:
            out.setdefault(os.path.realpath(file), file)
    return list(out.values())


def binary(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``path``, ``modificationTime``, ``length``, ``content`` of files."""
    return spark.read.format("binaryFile").load(paths)


@F.arrow_udf(T.StringType())
def decoded(content: pa.Array) -> pa.Array:
    """Column of bytes as UTF-8 text; what is malformed becomes the replacement character."""
    return pa.array([None if c is None else c.decode("utf-8", "replace") for c in content.to_pylist()], pa.string())


def recognised(files: DataFrame) -> DataFrame:
    """``path``, ``md_text``, ``error``: texts as they are (line ends too), others refused.

    Malformed bytes become replacement characters.
    """
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    known = suffix.isin(*TEXT_SUFFIXES)
    text = decoded(F.when(known, F.col("content")))
    return files.select(
        "path",
        text.alias("md_text"),
        F.when(~known, F.concat(F.lit("unsupported file: "), F.when(suffix == "", "no suffix").otherwise(suffix))).alias("error"),
    )


def recognise_with(files: DataFrame, recogniser: Callable[[str, bytes], str]) -> DataFrame:
    """``path``, ``md_text``, ``error`` by a client's function, run on the executors.

    An exception becomes the row's error; other rows are not affected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, errors = [], []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    texts.append(recogniser(path, content))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 the client's failure is data here
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())],
                names=["path", "md_text", "error"],
            )

    return files.select("path", "content").mapInArrow(run, "path string, md_text string, error string")


def paged(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """Pages of a document as one text: their number, then each page under its marker.

    ``key``, ``md_text``; a page without text has its marker only.
    """
    parts = F.array_sort(F.collect_list(F.struct(F.col(page).cast("int").alias("n"), F.coalesce(text, F.lit("")).alias("t"))))
    gathered = pages.groupBy(key).agg(parts.alias("_p"))
    total = F.size("_p")
    shown = F.transform("_p", lambda p: F.concat(F.lit("--- Page "), p["n"], F.lit("/"), total, F.lit(" ---\n"), p["t"]))
    return gathered.select(key, F.concat(F.lit("Total pages: "), total, F.lit("\n\n"), F.array_join(shown, "\n\n")).alias("md_text"))


def recognised_once(files: DataFrame, recogniser: Callable[[str, bytes], str], cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (``path``, ``md_text``, ``error``) by way of a cache (``content_key``, ``md_text``), and the cache with what is new.

    Files of equal content are recognised once; failures are not kept.
    """
    keyed = files.withColumn("content_key", content_key())
    new = keyed.join(cache.select("content_key"), "content_key", "left_anti").dropDuplicates(["content_key"])
    made = recognise_with(new, recogniser).join(new.select("path", "content_key"), "path")
    made = materialise(made.select("content_key", "md_text", "error"))
    grown = cache.select("content_key", "md_text").unionByName(made.where("error is null").select("content_key", "md_text"))
    known = grown.withColumn("error", F.lit(None).cast("string")).unionByName(made.where("error is not null"))
    return keyed.select("path", "content_key").join(known, "content_key").select("path", "md_text", "error"), grown


def all_texts(files: DataFrame, recogniser: Callable[[str, bytes], str] | None = None) -> DataFrame:
    """Texts of all inputs in the order of their paths (``path``, ``md_text``).

    Files of other kinds than text go to the recogniser, where there is one; what
    can't be read is left out.
    """
    plain = recognised(files)
    known = plain.where("error is null").select("path", "md_text")
    if recogniser is None:
        return known
    others = files.join(plain.where("error is not null").select("path"), "path", "left_semi")
    made = recognise_with(others, recogniser).where("error is null").select("path", "md_text")
    return known.unionByName(made)


def stage(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copy a file, or the files of a folder (not hidden ones), into ``target/input`` for one run.

    ``target/input`` and ``target/scratch`` are emptied first; a missing source and one
    without files are errors.  Gives the copies' paths, sorted.
    """
    fs, at = file_system(spark, source)
    jvm = spark.sparkContext._jvm
    if not fs.exists(at):
        raise FileNotFoundError(source)
    found = [at] if fs.getFileStatus(at).isFile() else [s.getPath() for s in fs.listStatus(at) if s.isFile() and not s.getPath().getName().startswith(".")]
    if not found:
        raise FileNotFoundError(f"{source} has no files")
    for part in ("input", "scratch"):
        to, folder = file_system(spark, f"{target}/{part}")
        to.delete(folder, True)
        to.mkdirs(folder)
    to, folder = file_system(spark, f"{target}/input")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in found:
        jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path, to, jvm.org.apache.hadoop.fs.Path(folder, path.getName()), False, conf)
    return sorted(f"{target}/input/{p.getName()}" for p in found)


def mapped(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Texts from a table (path, md_text); a path without one gets an error."""
    joined = files.select("path").join(mapping.select("path", "md_text"), "path", "left")
    return joined.withColumn("error", F.when(F.col("md_text").isNull(), F.lit("no text for this path")))


def doc_ids(files: DataFrame, path: str, order: str | None = None) -> DataFrame:
    """``doc_id`` from the file's name: odd characters as ``_``, ``doc`` if nothing is left.

    In the order of ``order``, each file takes its name or, if that is taken, the first of
    ``name-2``, ``name-3`` ... that is free.  Names can only meet within a
    family, that is without their numbers at the end: a family of one name is numbered
    by a window, one of several is worked through in order in one task.
    """
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    base = F.regexp_replace(F.regexp_replace(stem, r"[^\p{L}\p{N}_.-]+", "_"), "^_+|_+$", "")
    base = F.when(base == "", F.lit("doc")).otherwise(base)
    place = F.struct(*dict.fromkeys([order or path, path]))
    named = files.withColumn("_b", base).withColumn("_f", F.regexp_replace(base, r"(?:-[0-9]+)+$", ""))
    mixed = named.groupBy("_f").agg((F.min("_b") != F.max("_b")).alias("_m"))
    told = named.join(mixed, "_f")
    nth = F.row_number().over(Window.partitionBy("_b").orderBy(place))
    alone = told.where("not _m").withColumn("_n", nth)
    alone = alone.withColumn("doc_id", F.when(F.col("_n") == 1, F.col("_b")).otherwise(F.concat("_b", F.lit("-"), "_n")))
    several = told.where("_m").withColumn("_n", F.row_number().over(Window.partitionBy("_f").orderBy(place)))
    columns = [c for c in files.columns if c != "doc_id"]
    schema = T.StructType([several.schema[c] for c in columns] + [T.StructField("doc_id", T.StringType())])

    def take(group: pa.Table) -> pa.Table:
        group = group.sort_by("_n")
        taken: set[str] = set()
        last: dict[str, int] = {}
        ids = []
        for name in group.column("_b").to_pylist():
            n = last.get(name, 0) + 1
            while (found := name if n == 1 else f"{name}-{n}") in taken:
                n += 1
            last[name] = n
            taken.add(found)
            ids.append(found)
        return group.select(columns).append_column("doc_id", pa.array(ids, pa.string()))

    worked = several.groupBy("_f").applyInArrow(take, schema)
    return alone.select(*columns, "doc_id").unionByName(worked)


def content_key(content: str = "content", length: int = 16) -> F.Column:
    """First characters of the SHA-256 of a file's content."""
    return F.left(F.sha2(content, 256), F.lit(length))


def allowed(paths: DataFrame, path: str, roots: tuple[str, ...] = ("/input/", "/scratch/")) -> DataFrame:
    """Rows whose path lies under an allowed root and doesn't climb out of it."""
    under = F.lit(False)
    for root in roots:
        under = under | F.startswith(F.col(path), F.lit(root))
    return paths.where(under & ~F.col(path).rlike(r"(^|/)\.\.(/|$)"))


def tables_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Cells of pipe tables in a text: ``key``, ``table_no``, ``row_no``, ``cells``.

    Consecutive lines that start with a bar are one table; lines of dashes divide
    and are no rows.
    """
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_i", "_l"))
    ordered = Window.partitionBy(key).orderBy("_i")
    row = F.col("_l").rlike(r"^\s*\|")
    marked = lines.withColumn("_row", row).withColumn("_new", (F.col("_row") & ~F.coalesce(F.lag("_row").over(ordered), F.lit(False))).cast("int"))
    numbered = marked.withColumn("table_no", F.sum("_new").over(ordered)).where(F.col("_row") & ~F.col("_l").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace(F.trim("_l"), r"^\||\|$", "")
    within = Window.partitionBy(key, "table_no").orderBy("_i")
    return numbered.select(
        key, "table_no", (F.row_number().over(within) - 1).alias("row_no"), F.transform(F.split(inner, r"\|"), lambda c: F.trim(c)).alias("cells")
    )


def slug(name: str) -> str:
    """Name for a file or folder: lower case letters, digits and hyphens."""
    return re.sub(r"[^\w]+", "-", name.lower()).strip("-") or "item"


def samples(files: DataFrame, active: str | None = None) -> DataFrame:
    """Samples from files under ``<name>/output`` and ``<name>/comments``: ``sample``,
    ``expected``, ``comments``.

    ``reference.json`` counts if it parses, else ``res.txt``; the active sample is
    left out.
    """
    text = decoded("content")
    name = F.regexp_extract("path", r"([^/]+)/(?:output|comments)/[^/]+$", 1)
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    rows = files.select(name.alias("sample"), file.alias("file"), text.alias("t")).where("sample <> ''")
    parsed = F.when((F.col("file") == "reference.json") & F.expr("try_parse_json(t)").isNotNull(), F.col("t"))
    found = rows.groupBy("sample").agg(
        F.max(parsed).alias("_json"),
        F.max(F.when(F.col("file") == "res.txt", F.col("t"))).alias("_plain"),
        F.coalesce(F.max(F.when(F.col("file") == "comments.md", F.col("t"))), F.lit("")).alias("comments"),
    )
    kept = found if active is None else found.where(F.col("sample") != active)
    return kept.select("sample", F.coalesce("_json", "_plain", F.lit("")).alias("expected"), "comments")


def hinted(docs: DataFrame, key: str, text: str, hint: str, most: int = 50) -> DataFrame:
    """Part of each text under the heading that has most words of a hint: ``key``, ``fragment``.

    Headings start with ``#`` or ``**`` or end with a colon; the first of equals
    counts.  A ``#`` heading's part ends at the next of its level, others and long
    ones after ``most`` lines.  Texts without a fitting heading give no row.
    """
    words = [w for w in hint.lower().split() if w]
    lines = docs.where(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, "\n", -1)).alias("_i", "_l"))
    score = sum((F.lower("_l").contains(w).cast("int") for w in words), F.lit(0))
    heading = F.col("_l").rlike(r"^(?:#|\*\*)") | F.col("_l").rlike(r":\s*$")
    best = (
        lines.withColumn("_s", score)
        .where(heading & (F.col("_s") > 0))
        .groupBy(key)
        .agg(F.max_by(F.struct(F.col("_i").alias("at"), F.regexp_extract("_l", "^(#*)", 1).alias("mark")), F.struct("_s", -F.col("_i"))).alias("_b"))
    )
    level = F.regexp_extract("_l", "^(#*)", 1)
    after = lines.join(best, key).where(F.col("_i") >= F.col("_b.at"))
    ends = after.where((F.col("_b.mark") != "") & (level == F.col("_b.mark")) & (F.col("_i") > F.col("_b.at"))).groupBy(key).agg(F.min("_i").alias("_e"))
    inside = after.join(ends, key, "left").where(
        (F.col("_i") < F.coalesce("_e", F.col("_b.at") + most)) & (F.col("_i") < F.col("_b.at") + most)
    )
    part = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_l"))), lambda x: x["_l"]), "\n")
    return inside.groupBy(key).agg(part.alias("fragment"))
