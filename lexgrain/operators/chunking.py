"""Chunks of charter text: along headings and clause numbers, by size, by a pattern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexgrain.functions import text as X

_UNIT = rf"^{X.WS}*(?:[-*]{X.WS}*)?{X.DIGIT}+(?:\.{X.DIGIT}+)*\.?{X.WS}+{X.NOT_WS}"
_HEAD = rf"^{X.WS}{{0,3}}#{{1,6}}{X.WS}+{X.NOT_WS}"
#: Line ends of every kind, as opposed to line feeds alone.
LINE_ENDS = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def size_pieces(text: Column, size: int | Column, overlap: int, floor: int = 200) -> Column:
    """Pieces of a fixed size that start every ``size - overlap`` characters.

    A tail that lies within the overlap is a piece too; an empty text is one
    empty piece.
    """
    size = F.greatest(F.lit(floor), F.lit(size) if isinstance(size, int) else size)
    step = F.greatest(F.lit(1), size - overlap)
    last = F.greatest(F.floor((F.length(text) - 1) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, size))


def pattern_pieces(text: Column, pattern: str) -> Column:
    """Parts between matches, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), X.strip), lambda p: p != "")


def windows_or_nothing(text: Column, size: int = 1500, overlap: int = 150) -> Column:
    """Pieces of a fixed size without a floor; none of an empty text."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(size_pieces(text, size, overlap, 1))


def merge_small(units: Column, most: int) -> Column:
    """Adjacent units joined by line feeds as long as they fit; an empty buffer takes any unit."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("buf"))

    def step(acc: Column, unit: Column) -> Column:
        fits = F.length(acc["buf"]) + F.length(unit) + 1 <= most
        return (
            F.when(acc["buf"] == "", F.struct(acc["out"].alias("out"), unit.alias("buf")))
            .when(fits, F.struct(acc["out"].alias("out"), F.concat(acc["buf"], F.lit("\n"), unit).alias("buf")))
            .otherwise(F.struct(F.array_append(acc["out"], acc["buf"]).alias("out"), unit.alias("buf")))
        )

    return F.aggregate(
        units, empty, step, lambda a: F.when(a["buf"] == "", a["out"]).otherwise(F.array_append(a["out"], a["buf"]))
    )


def hierarchical(docs: DataFrame, key: str, text: str, most: int = 1800, overlap: int = 150) -> DataFrame:
    """``key``, ``chunk_no``, ``chunk``: clauses of a section merged up to a size under its heading.

    Lines of page furniture go, runs of blanks shrink.  A unit starts at each line
    with a number; small ones merge, oversized ones are cut by size.  A text that
    gives no chunk is cut by size as it is; null texts give no rows.
    """
    there = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("_t"))
    # a last line end closes a line and opens none
    parts = F.split(F.regexp_replace("_t", rf"(?:{LINE_ENDS})\z", ""), LINE_ENDS, -1)
    raw = there.select(key, F.posexplode(parts).alias("_i", "_l")).where(~F.col("_l").rlike(X.NOISE_CHUNK))
    clean = F.regexp_replace(F.regexp_replace("_l", r"[ \t]{2,}", " "), rf"{X.WS}+$", "")
    ordered = Window.partitionBy(key).orderBy("_i")
    marked = (
        raw.select(key, "_i", clean.alias("_l"))
        .withColumn("_h", F.col("_l").rlike(_HEAD))
        .withColumn("_s", F.sum(F.col("_h").cast("int")).over(ordered))
    )
    in_section = Window.partitionBy(key, "_s").orderBy("_i")
    # the first line of a body opens its first unit whether or not it has a number
    opens = (F.col("_l").rlike(_UNIT) & (F.sum((~F.col("_h")).cast("int")).over(in_section.rowsBetween(Window.unboundedPreceding, -1)) > 0)).cast("int")
    units = (
        marked.withColumn("_u", F.sum(F.coalesce(opens, F.lit(0))).over(in_section))
        .groupBy(key, "_s", "_u")
        .agg(
            F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("_i", "_l")))).alias("_b"),
            F.max(F.when(F.col("_h"), X.strip(F.regexp_replace(X.strip("_l"), "^#+", "")))).alias("_head"),
        )
    )
    gathered = (
        units.select(key, "_s", "_u", "_head", F.array_join(F.transform("_b", lambda x: x["_l"]), "\n").alias("_unit"), F.size("_b").alias("_n"))
        .groupBy(key, "_s")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_n") > 0, F.struct("_u", "_unit")))).alias("_units"),
            F.coalesce(F.max("_head"), F.lit("")).alias("_head"),
        )
    )
    merged = F.filter(
        F.transform(merge_small(F.transform("_units", lambda x: x["_unit"]), most - 80), X.strip), lambda u: u != ""
    )
    prefix = F.when(F.col("_head") != "", F.concat(F.lit("["), "_head", F.lit("]\n"))).otherwise("")
    flat = gathered.select(key, "_s", prefix.alias("_p"), F.posexplode(merged).alias("_m", "_unit"))
    pieces = F.when(F.length("_p") + F.length("_unit") <= most, F.array("_unit")).otherwise(
        size_pieces(F.col("_unit"), F.lit(most) - F.length("_p"), overlap)
    )
    chunks = (
        flat.select(key, "_s", "_m", "_p", F.posexplode(pieces).alias("_k", "_piece"))
        .select(key, "_s", "_m", "_k", F.concat("_p", "_piece").alias("chunk"))
        .where(X.strip("chunk") != "")
    )
    without = there.join(chunks.select(key).distinct(), key, "left_anti").select(
        key, F.lit(0).alias("_s"), F.lit(0).alias("_m"), F.posexplode(size_pieces(F.col("_t"), most, overlap)).alias("_k", "chunk")
    )
    order = Window.partitionBy(key).orderBy("_s", "_m", "_k")
    return chunks.unionByName(without).select(key, (F.row_number().over(order) - 1).alias("chunk_no"), "chunk")


def fused(lexical: DataFrame, meaning: DataFrame | None, k: int, weight: float = 0.7, rrf_k: int = 60) -> DataFrame:
    """The ``k`` best chunks of each query and document by two rankings: ``query_id``, ``doc``,
    ``chunk_no``, ``score``, ``rank``.

    Both (``query_id``, ``doc``, ``chunk_no``, ``score``) are cut at ``max(3k, 15)`` before they
    are fused with ``weight`` and its rest.  Where the ranking by meaning is empty or absent,
    the lexical one stands, with its own scores.
    """
    depth = max(3 * k, 15)
    best = Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "chunk_no")
    columns = ("query_id", "doc", "chunk_no", "score")

    def cut(scored: DataFrame, n: int) -> DataFrame:
        return scored.select(*columns).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)

    words = cut(lexical, depth)
    if meaning is None:
        return words.where(F.col("rank") <= k)
    near = cut(meaning, depth)
    parts = [
        d.select("query_id", "doc", "chunk_no", (F.lit(w) / (F.lit(rrf_k) + F.col("rank"))).alias("_c"), o.alias("_own"))
        for d, w, o in ((words, weight, F.col("score")), (near, 1.0 - weight, F.lit(None).cast("double")))
    ]
    both = parts[0].unionByName(parts[1]).groupBy("query_id", "doc", "chunk_no").agg(
        F.round(F.sum("_c"), 9).alias("_f"), F.max("_own").alias("_own")
    )
    there = near.select("query_id", "doc").distinct().withColumn("_m", F.lit(True))
    scored = both.join(there, ["query_id", "doc"], "left").select(
        "query_id", "doc", "chunk_no", F.when(F.col("_m"), F.col("_f")).otherwise(F.col("_own")).alias("score")
    )
    return cut(scored, k)


def contexts(
    scored: DataFrame, chunks: DataFrame, k: int = 12, most: int | None = None, asked: DataFrame | None = None
) -> DataFrame:
    """Text of the ``k`` best chunks of each query and document, in document order.

    ``scored``: ``query_id``, ``doc``, ``chunk_no``, ``score``; ``chunks``: ``doc``,
    ``chunk_no``, ``chunk``.  A query for which a document has no scored chunk gets
    no row, unless the pair is ``asked`` (``query_id``, ``doc``): then it gets the
    document's first chunk.
    """
    best = Window.partitionBy("query_id", "doc").orderBy(F.desc("score"), "chunk_no")
    chosen = (
        scored.withColumn("_r", F.row_number().over(best))
        .where(F.col("_r") <= k)
        .groupBy("query_id", "doc")
        .agg(F.collect_list("chunk_no").alias("_n"))
    )
    if asked is not None:
        chosen = asked.select("query_id", "doc").distinct().join(chosen, ["query_id", "doc"], "left")
    # a document's chunks meet its queries once, as one row, so that no text is shuffled for each query
    texts = chunks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))).alias("_c"))
    taken = F.filter("_c", lambda c: F.array_contains("_n", c["chunk_no"]))
    text = F.when(F.col("_n").isNull(), F.col("_c")[0]["chunk"]).otherwise(
        F.array_join(F.transform(taken, lambda c: c["chunk"]), "\n\n")
    )
    out = chosen.join(texts, "doc").select("query_id", "doc", text.alias("context"))
    return out if most is None else out.withColumn("context", F.substring("context", 1, most))
