"""Queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexgrain.llm import canon, lookalikes, neardup, ocr_repair, packing, prefix_bpe, splitting, subjects
from lexgrain.runtime import materialise, table

CLAUSE_LIMIT, DOCUMENT_LIMIT, OVERLAP = 1500, 30_000, 150
CONTAINER = 2048


def _repaired(spark: SparkSession, root: str) -> DataFrame:
    charters = table(spark, root, "documents_in")
    scanned = charters.where("recognizer = 'ocr'").select("doc_id", "md_text")
    clean = charters.where("recognizer <> 'ocr'").select("md_text")
    return ocr_repair.repair_documents(scanned, "doc_id", "md_text", clean, "md_text")


def p1_repaired(spark: SparkSession, root: str) -> DataFrame:
    """Scanned charters as continuous paragraphs."""
    return _repaired(spark, root).select("doc_id", "repaired").dropDuplicates(["doc_id"])


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    """Lines of scanned charters that are page furniture, end in a broken word or are misread."""
    return (
        _repaired(spark, root)
        .select("doc_id", F.explode("found").alias("f"))
        .select("doc_id", "f.line_no", "f.kind")
        .distinct()
    )


def p2_consistent(spark: SparkSession, root: str) -> DataFrame:
    """Values of clauses that are not in their consistent form, and that form."""
    clauses = table(spark, root, "clauses")
    texts = lookalikes.consistent_texts(clauses.select("clause_id", "text"), "clause_id", "text")
    numbers = lookalikes.consistent_numbers(clauses.select("clause_id", "number"), "clause_id", "number")
    both = texts.withColumn("field_name", F.lit("text")).unionByName(
        numbers.withColumn("field_name", F.lit("number"))
    )
    return (
        both.where("value <> consistent")
        .dropDuplicates(["clause_id", "field_name"])
        .select("clause_id", "field_name", "value", "consistent")
    )


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Fields whose value differs from its consistent form."""
    return p2_consistent(spark, root).select("clause_id", "field_name")


#: Fields of free entries and the kind of body that each asks for.
BODY_FIELDS = {
    "supreme_governing_body": "supreme",
    "collegial_governing_bodies": "collegial",
    "sole_executive_bodies": "sole",
}


def _body_entries(spark: SparkSession, root: str) -> DataFrame:
    """Entries of the three fields by position; repeated deliveries count once."""
    runs = table(spark, root, "extractions")
    parts = []
    for name, kind in BODY_FIELDS.items():
        many = dict(runs.dtypes)[name].startswith("array")
        values = F.col(name) if many else F.array(name)
        parts.append(
            runs.select("extraction_id", F.posexplode(values).alias("pos", "entry")).select(
                "extraction_id",
                F.lit(name).alias("field_name"),
                F.lit(kind).alias("kind"),
                F.col("pos").cast("long").alias("pos"),
                "entry",
            )
        )
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.where(F.col("entry").rlike(r"[^\s\u00a0]")).dropDuplicates(
        ["extraction_id", "field_name", "pos"]
    )


#: What surrounds the name of a body in an extracted value without being part of it.
BODY_NOISE = (
    r"\([^)]*\)",
    r"(?:\b(?:ао|ооо|пао|зао|нко)\s*)[«\"][^»\"]*[»\"]?",
    r",\s*избираем\w*\s.*$",
    r"\s[—–-]+\s*орган управления",
    r"\bорган\s*:",
    r"функции исполняет",
    r"\bобщества\b",
    r"\b(?:ст|пп?|гл)\.\s*\d+(?:\.\d+)*\.?,?\s*[—–-]?",
    r"^\W*\d+(?:\.\d+)*[.)]?\s",
)


BODY_RULES = canon.Rules(noise=BODY_NOISE, synonyms={"гендир": "генеральный"})


def p3_mapped(spark: SparkSession, root: str) -> DataFrame:
    """Every entry with the listed body that it names and how close it is."""
    entries = _body_entries(spark, root)
    bodies = table(spark, root, "governing_bodies")
    mapped = canon.map_to_reference(
        entries, "entry", bodies, "body_id", "canonical_name", BODY_RULES, "kind", "body_kind"
    )
    return entries.join(mapped, ["entry", "kind"], "left").select(
        "extraction_id",
        "field_name",
        "pos",
        "entry",
        F.coalesce("body_id", F.lit(0)).cast("long").alias("body_id"),
        "similarity",
    )


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    """Entries that are not character for character a listed name, with their body."""
    names = table(spark, root, "governing_bodies").select(F.col("canonical_name").alias("entry"))
    return (
        p3_mapped(spark, root)
        .join(names.distinct(), "entry", "left_anti")
        .select("extraction_id", "field_name", "pos", "body_id")
    )


def p4_pieces(spark: SparkSession, root: str) -> DataFrame:
    """Pieces of all oversized clauses, chunks and charters."""
    texts = table(spark, root, "clauses").select("clause_id", "text")
    clauses = splitting.split_oversized(texts, "clause_id", "text", CLAUSE_LIMIT, OVERLAP)
    # any clause may be that of an oversized span, also one that is shorter than the span
    windows = (
        table(spark, root, "chunks")
        .where(F.col("span_end") - F.col("span_start") > CLAUSE_LIMIT)
        .select("unit_id", "clause_id", "span_start", "span_end")
        .dropDuplicates(["unit_id"])
        .join(texts, "clause_id", "left")
    )
    chunks = splitting.split_oversized(
        windows, "unit_id", "text", CLAUSE_LIMIT, OVERLAP, "span_start", "span_end"
    )
    documents = splitting.split_oversized(
        table(spark, root, "documents_in"), "doc_ord", "md_text", DOCUMENT_LIMIT, OVERLAP
    )
    every = [("clause", "clause_id", clauses), ("chunk", "unit_id", chunks), ("document", "doc_ord", documents)]
    parts = [
        d.select(
            F.lit(kind).alias("item_kind"),
            F.col(key).alias("item_key"),
            "piece_no",
            "span_start",
            "span_end",
            "piece",
        )
        for kind, key, d in every
    ]
    # repeated deliveries are the same row, so any one of their pieces stands
    return (
        parts[0]
        .unionByName(parts[1])
        .unionByName(parts[2])
        .dropDuplicates(["item_kind", "item_key", "piece_no"])
    )


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    """Items that had to be cut: those with a first piece."""
    return p4_pieces(spark, root).where("piece_no = 0").select("item_kind", "item_key").distinct()


def p4_cover(spark: SparkSession, root: str) -> DataFrame:
    """Items that were cut, by what their pieces cover and whether these keep to the rules."""
    item = Window.partitionBy("item_kind", "item_key").orderBy("piece_no")
    limit = F.when(F.col("item_kind") == "document", DOCUMENT_LIMIT).otherwise(CLAUSE_LIMIT)
    shared = F.lag("span_end").over(item) - F.col("span_start")
    pieces = p4_pieces(spark, root).select(
        "item_kind",
        "item_key",
        "span_start",
        "span_end",
        F.coalesce(
            (F.col("span_end") - F.col("span_start")).between(1, limit)
            & F.coalesce(shared, F.lit(0)).between(0, OVERLAP)
            & (F.coalesce(F.length("piece"), F.col("span_end") - F.col("span_start")) == F.col("span_end") - F.col("span_start")),
            F.lit(False),
        ).alias("kept"),
    )
    return pieces.groupBy("item_kind", "item_key").agg(
        (F.max("span_end") - F.min("span_start")).alias("covered"), F.bool_and("kept").alias("kept")
    )


def _near_duplicates(
    spark: SparkSession, root: str, how: neardup.NearDuplicates
) -> dict[str, neardup.Links]:
    kinds = {"clause": ("clauses", "clause_id", "text"), "document": ("documents_in", "doc_ord", "md_text")}
    return {
        kind: neardup.link(neardup.prepare(table(spark, root, name), key, text, how), how)
        for kind, (name, key, text) in kinds.items()
    }


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    """All pairs of records whose sets of three-word runs overlap by 0.65 or more."""
    how = neardup.NearDuplicates(words=3, threshold=0.65, least_words=20, weighted=False)
    parts = [
        neardup.pairs(found).select(F.lit(kind).alias("item_kind"), "key_a", "key_b")
        for kind, found in _near_duplicates(spark, root, how).items()
    ]
    return parts[0].unionByName(parts[1])


def p5_classes(spark: SparkSession, root: str) -> DataFrame:
    """Class of every clause and charter: bags of five-word runs, similarity 0.8 or more."""
    parts = [
        neardup.classes(found).select(F.lit(kind).alias("item_kind"), "key", "class_id", "n_links")
        for kind, found in _near_duplicates(spark, root, neardup.NearDuplicates()).items()
    ]
    return parts[0].unionByName(parts[1])


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    """Token ids of every document."""
    docs = table(spark, root, "documents")
    return docs.select("doc_id", prefix_bpe.token_ids(spark, "text").alias("ids"))


def _token_counts(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    return materialise(docs.select("doc_id", prefix_bpe.token_count(spark, "text").alias("n")))


def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """Container of every document or piece of one."""
    return packing.pack(_token_counts(spark, root), "doc_id", "n", CONTAINER)


def p7_account(spark: SparkSession, root: str) -> DataFrame:
    """What of the packing breaks a rule, beside the number of documents: all others must be 0."""
    placed = materialise(p7_containers(spark, root))
    filled = placed.where("container_id is not null")
    ends = F.col("container_offset") + F.col("n_tokens")
    next_ = F.lead("container_offset").over(Window.partitionBy("container_id").orderBy("container_offset"))
    parts = [
        ("documents", placed.select("doc_id").distinct()),
        ("over capacity", filled.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).where(F.col("n") > CONTAINER)),
        ("overlapping", filled.select(ends.alias("e"), next_.alias("x")).where("x < e")),
        ("divided but for size", placed.groupBy("doc_id").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n")).where(
            F.col("k") != F.greatest(F.lit(1), F.ceil(F.col("n") / CONTAINER)))),
        ("without container", placed.where("container_id is null and n_tokens > 0")),
    ]
    rows = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("item"), "n") for name, d in parts]
    return functools.reduce(DataFrame.unionByName, rows)


def p8_subjects(spark: SparkSession, root: str) -> DataFrame:
    """Subject areas of every document, with the model's logits."""
    docs = table(spark, root, "documents").select("doc_id", "text")
    areas = [r[0] for r in table(spark, root, "subject_areas").select("subject_id").orderBy("subject_id").collect()]
    trained = subjects.train(docs, table(spark, root, "subject_labels"), "doc_id", "text", "subject_id", areas)
    return subjects.score(docs, "doc_id", "text", trained, areas)


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    """Areas of the documents that have no hand label."""
    labelled = table(spark, root, "subject_labels").select("doc_id").distinct()
    return (
        p8_subjects(spark, root)
        .select("doc_id", F.explode("subject_ids").alias("subject_id"))
        .join(labelled, "doc_id", "left_anti")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_repaired": p1_repaired,
        "p2_found": p2_found,
        "p2_consistent": p2_consistent,
        "p3_found": p3_found,
        "p3_mapped": p3_mapped,
        "p4_found": p4_found,
        "p4_pieces": p4_pieces,
        "p4_cover": p4_cover,
        "p5_found": p5_found,
        "p5_classes": p5_classes,
        "p6_ids": p6_ids,
        "p7_containers": p7_containers,
        "p7_account": p7_account,
        "p8_found": p8_found,
        "p8_subjects": p8_subjects,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""
            SELECT DISTINCT 'clause' AS item_kind, clause_id AS item_key
            FROM clauses WHERE length(text) > {CLAUSE_LIMIT}
            UNION ALL
            SELECT DISTINCT 'chunk', unit_id FROM chunks WHERE span_end - span_start > {CLAUSE_LIMIT}
            UNION ALL
            SELECT DISTINCT 'document', doc_ord FROM documents_in WHERE length(md_text) > {DOCUMENT_LIMIT}
        """,
        "p4_cover": f"""
            SELECT DISTINCT 'clause' AS item_kind, clause_id AS item_key, length(text) AS covered, true AS kept
            FROM clauses WHERE length(text) > {CLAUSE_LIMIT}
            UNION ALL
            SELECT DISTINCT 'chunk', unit_id, span_end - span_start, true
            FROM chunks WHERE span_end - span_start > {CLAUSE_LIMIT}
            UNION ALL
            SELECT DISTINCT 'document', doc_ord, length(md_text), true
            FROM documents_in WHERE length(md_text) > {DOCUMENT_LIMIT}
        """,
        "p5_found": r"""
            WITH r AS (
              SELECT 'clause' AS item_kind, clause_id AS id, text AS t FROM clauses WHERE text IS NOT NULL
              UNION SELECT 'document', doc_ord, md_text FROM documents_in WHERE md_text IS NOT NULL),
            w AS (SELECT item_kind, id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS ws FROM r),
            s AS (SELECT DISTINCT item_kind, id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
                  FROM (SELECT item_kind, id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 20)),
            z AS (SELECT item_kind, id, count(*) AS n FROM s GROUP BY ALL),
            b AS (SELECT x.item_kind, x.id AS key_a, y.id AS key_b, count(*) AS common
                  FROM s x JOIN s y ON x.item_kind = y.item_kind AND x.g = y.g AND x.id < y.id GROUP BY ALL)
            SELECT b.item_kind, key_a, key_b FROM b JOIN z a ON a.item_kind = b.item_kind AND a.id = key_a
              JOIN z c ON c.item_kind = b.item_kind AND c.id = key_b
            WHERE common >= 0.65 * (a.n + c.n - common)
        """,
        "p5_classes": r"""
            WITH RECURSIVE r AS (
              SELECT 'clause' AS item_kind, clause_id AS id, text AS t FROM clauses
              UNION SELECT 'document', doc_ord, md_text FROM documents_in),
            w AS (SELECT item_kind, id, regexp_extract_all(lower(coalesce(t, '')), '[\p{L}\p{N}]+') AS ws FROM r),
            e AS (SELECT item_kind, id, i, array_to_string(list_slice(ws, i, i + least(5, len(ws)) - 1), ' ') AS g
                  FROM (SELECT item_kind, id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w WHERE len(ws) > 0)),
            s AS (SELECT item_kind, id, g || '#' || row_number() OVER (PARTITION BY item_kind, id, g ORDER BY i) AS x FROM e),
            bag AS (SELECT item_kind, id, count(*) AS n, md5(string_agg(x, '|' ORDER BY x)) AS print FROM s GROUP BY 1, 2),
            rep AS (SELECT item_kind, id, n, min(id) OVER (PARTITION BY item_kind, print) AS rep FROM bag),
            own AS (SELECT s.item_kind, s.id, s.x FROM s JOIN rep ON rep.item_kind = s.item_kind AND rep.id = s.id WHERE rep.id = rep.rep),
            o AS (SELECT a.item_kind, a.id AS a, b.id AS b, count(*) AS common FROM own a JOIN own b ON a.item_kind = b.item_kind AND a.x = b.x AND a.id < b.id GROUP BY ALL),
            l AS (SELECT o.item_kind, o.a, o.b FROM o JOIN rep x ON x.item_kind = o.item_kind AND x.id = o.a JOIN rep y ON y.item_kind = o.item_kind AND y.id = o.b
                  WHERE common >= 0.8 * (x.n + y.n - common)),
            d AS (SELECT item_kind, a, b FROM l UNION ALL SELECT item_kind, b, a FROM l),
            reach AS (SELECT DISTINCT item_kind, a AS node, a AS label FROM d UNION SELECT d.item_kind, d.b, reach.label FROM reach JOIN d ON d.item_kind = reach.item_kind AND d.a = reach.node),
            lab AS (SELECT item_kind, node, min(label) AS label FROM reach GROUP BY 1, 2),
            deg AS (SELECT item_kind, a, count(*) AS n FROM d GROUP BY 1, 2)
            SELECT w.item_kind, w.id AS key, coalesce(lab.label, rep.rep, w.id) AS class_id, coalesce(deg.n, 0) AS n_links
            FROM w LEFT JOIN rep ON rep.item_kind = w.item_kind AND rep.id = w.id
            LEFT JOIN lab ON lab.item_kind = w.item_kind AND lab.node = rep.rep LEFT JOIN deg ON deg.item_kind = w.item_kind AND deg.a = rep.rep
        """,
        "p7_account": """
            SELECT 'documents' AS item, count(*) AS n FROM documents
            UNION ALL SELECT 'over capacity', 0 UNION ALL SELECT 'overlapping', 0
            UNION ALL SELECT 'divided but for size', 0 UNION ALL SELECT 'without container', 0
        """,
    }
