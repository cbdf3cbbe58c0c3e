import re
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from lexgrain import registry
from lexgrain.functions import text as X
from lexgrain.operators import chunking, fusion, lexical, parse, toc, vectors

CHARTER = """# УСТАВ «Проба»
Утверждён 01.02.2025.

## СОДЕРЖАНИЕ

- Статья 3. ПРАВА
- Статья 4. СРОКИ

## Статья 3. ПРАВА

3.1. Участник вправе голосовать.
3.2) Участник вправе выйти.
7.1) это перечень, а не пункт
01.02. это дата
- 3.3 Без точки после числа.
| 3.4 Строка таблицы | 12 |
3 . 5. С пробелами внутри.
3,6. С запятой.

### 3.7. Отдельно
3.7.1.без пробела
3.7.О1. даты нет

## Статья 4. СРОКИ
| 4.1 Первое  4.1.1  Вложенное  4.2  Соседнее  9.9  Чужое |
"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc int, md string")


def test_sections(spark):
    got = parse.sections(parse.lines(docs(spark, CHARTER), "doc", "md"), "doc").orderBy("line_start").collect()
    assert [(r.section_key, r.parent_key) for r in got] == [("§1", ""), ("§2", ""), ("3", ""), ("3.7", "3"), ("4", "")]
    ends = {r.section_key: r.line_end for r in got}
    assert ends["3"] == ends["3.7"] and ends["4"] == len(CHARTER.split("\n"))


def test_segments_are_exact_spans(spark):
    got = parse.segments(docs(spark, CHARTER), "doc", "md").orderBy("span_start").collect()
    assert all(CHARTER[r.span_start : r.span_end] == r.text for r in got)
    numbers = [r.number for r in got]
    assert numbers == ["", "3", "3.1", "3.2", "3.3", "3.4", "3.5", "3.6", "3.7", "3.7.1", "3.7", "4", "4.1"]
    assert not any("СОДЕРЖАНИЕ" in r.text for r in got)
    assert "7.1) это перечень" in got[3].text and "01.02. это дата" in got[3].text


def test_misread_numbers_can_be_left_alone(spark):
    got = parse.segments(docs(spark, CHARTER), "doc", "md", misread=False).collect()
    assert "3.6" not in {r.number for r in got}


def test_inline_split(spark):
    got = parse.split_inline(parse.segments(docs(spark, CHARTER), "doc", "md"), "doc").orderBy("span_start").collect()
    assert all(CHARTER[r.span_start : r.span_end] == r.text for r in got)
    assert [r.number for r in got][-4:] == ["4", "4.1", "4.1.1", "4.2"]
    assert got[-1].text.endswith("Чужое |")


def test_clauses_of_many_documents_stay_where_they_are(spark):
    of = spark.range(40).selectExpr("cast(id % 20 as int) AS doc", "id").groupBy("doc").agg(F.count("*").alias("n"))
    md = F.concat(F.lit("## Вводная\n1.1. Первое |  a  1.2  Второе  9.9  Чужое  1.3  Третье\n## Прочее\nтекст\n# Статья 2. Срок "), "doc")
    got = parse.split_inline(parse.segments(of.select("doc", md.alias("md")), "doc", "md"), "doc")
    plan = got._jdf.queryExecution().executedPlan().toString()
    # no scopes by document in Python, no join of lines and headings, one exchange
    assert "InArrow" not in plan and "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    rows = got.orderBy("doc", "span_start").collect()
    assert [(r.number, r.section_key) for r in rows] == [("", "§1"), ("1.1", "§1"), ("1.2", "§1"), ("1.3", "§1"), ("", "§2"), ("2", "2")] * 20
    assert rows[2].text == "1.2  Второе  9.9  Чужое" and rows[2].span_end - rows[2].span_start == len(rows[2].text)


def test_inline_clauses_by_order(spark, tmp_path):
    rows = [(7, 2, 30), (7, 1, 9), (7, 2, 4), (10, 1, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = registry.queries()["inline_clauses"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert {(r.doc, r.number, r.text) for r in df.collect()} == {
        (7, "7", "## Статья 7. Список"), (7, "7.1", "7.1. Перечень |  Товар 9"), (7, "7.2", "7.2.  Товар 4"), (7, "7.3", "7.3.  Товар 30"),
        (10, "10", "## Статья 10. Список"), (10, "10.1", "10.1. Перечень |  Товар 5"),
    }


def test_white_space_one_by_one_is_the_class(spark):
    chars = spark.createDataFrame([(chr(i),) for i in range(0x10000) if not 0xD800 <= i < 0xE000], "c string")
    assert {r.c for r in chars.where(F.col("c").rlike(X.WS)).collect()} == set(X.WS_CHARS)
    odd = ["", " ", "\n\u2028", "a", "\u3000 а б\x85\r\n", "\u200bx\u200b", "x \n", "\n"]
    d = spark.createDataFrame([(t,) for t in odd], "t string")
    by_pattern = F.regexp_replace("t", rf"^{X.WS}+|{X.WS}+$", "")
    assert all(r.a == r.b for r in d.select(X.strip("t").alias("a"), by_pattern.alias("b")).collect())


@pytest.mark.parametrize("texts", [(), (None,), ("",), (" \n\n ",), ("просто текст\nбез заголовков",)])
def test_texts_without_structure(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "doc int, md string")
    of = parse.lines(d, "doc", "md")
    assert parse.sections(of, "doc").count() == 0
    got = parse.segments(d, "doc", "md").collect()
    assert [r.text for r in got] == [t.strip() for t in texts if t and t.strip()]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1О,2", "10.2"), ("7 . 2", "7.2"), ("l0.З", "10.3"), ("Зона", ""), ("II", ""), ("05.01", ""), ("10..2.", "10.2"), ("", ""), ("1.2а", "")],
)
def test_repair_number(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "r string").select(X.repair_number("r")).first()[0] == want


def test_window_spans_against_a_loop(spark):
    def spans(n, size, overlap):
        starts = [at for at in range(0, max(n, 1), max(1, size - overlap)) if at == 0 or at - max(1, size - overlap) + size < n]
        return [(at, min(at + size, n)) for at in starts]

    for size, overlap in ((5, 0), (5, 2), (7, 7), (1, 0)):
        rows = spark.range(0, 40).select("id", F.inline(parse.window_spans(F.col("id").cast("int"), size, overlap)))
        got = {}
        for r in rows.collect():
            got.setdefault(r.id, []).append((r.span_start, r.span_end))
        assert all(sorted(got[n]) == spans(n, size, overlap) for n in range(40))


NOISE = re.compile(r"\s*(---\s*page\s+\d+.*|total pages:.*|<!--.*-->)\s*", re.I)
HEAD = re.compile(r"\s{0,3}#{1,6}\s+\S")
NUMBERED = re.compile(r"\s*(?:[-*]\s*)?\d+(?:\.\d+)*\.?\s+\S")


def fixed(text, size, overlap):
    size = max(size, 200)
    return [text[at : at + size] for at in range(0, max(len(text), 1), max(size - overlap, 1))]


def chunks_by_hand(text, most, overlap):
    """Chunks by cutting the list of lines at headings, then at numbers, and taking
    the longest run of units that fits each time."""
    kept = [re.sub(r"[ \t]{2,}", " ", x).rstrip() for x in text.splitlines() if not NOISE.fullmatch(x)]
    heads = {i for i, x in enumerate(kept) if HEAD.match(x)}
    out = []
    for low, high in pairwise(sorted({0, len(kept)} | heads)):
        body = kept[low + (low in heads) : high]
        prefix = "[" + kept[low].strip().lstrip("#").strip() + "]\n" if low in heads else ""
        opens = [i for i, x in enumerate(body) if i == 0 or NUMBERED.match(x)]
        units = ["\n".join(body[p:q]) for p, q in pairwise([*opens, len(body)])]
        while units:
            if not units[0]:
                del units[0]
                continue
            count = max([1, *(k for k in range(2, len(units) + 1) if len("\n".join(units[:k])) <= most - 80)])
            unit = "\n".join(units[:count]).strip()
            del units[:count]
            fits = len(prefix) + len(unit) <= most
            pieces = [unit] if fits else fixed(unit, most - len(prefix), overlap)
            out += [prefix + piece for piece in pieces if unit]
    return [c for c in out if c.strip()] or fixed(text, most, overlap)


def test_hierarchical_chunks_against_a_loop(spark):
    texts = ["", "\n\n", CHARTER, "слово " * 300, CHARTER * 3, "# H\n" + "1. " + "текст " * 200 + "\n2. коротко\n\n", "a\r\nb\rc\x0bd"]
    for most in (200, 400):
        got = {}
        for r in chunking.hierarchical(docs(spark, *texts), "doc", "md", most, 50).orderBy("doc", "chunk_no").collect():
            got.setdefault(r.doc, []).append(r.chunk)
        for i, text in enumerate(texts):
            assert got[i] == chunks_by_hand(text, most, 50), (i, most)


def test_bm25_against_a_loop(spark):
    import math

    texts = ["совет директоров", "совет совет участников", "", "правление", "директоров правление совет общества"]
    units = spark.createDataFrame(list(enumerate(texts)), "unit_id int, text string")
    index = lexical.build(units, "unit_id", "text")
    asked = spark.createDataFrame([(1, "Правление директоров совет совет")], "query_id int, text string")
    got = {r.unit_id: r.score for r in lexical.scores(index, lexical.query_terms(asked, "query_id", "text")).collect()}
    tokens = [t.split() for t in texts]
    n, mean = len(texts), sum(map(len, tokens)) / len(texts)
    words = {w for t in tokens for w in t}
    raw = {w: math.log(n - (df := sum(w in t for t in tokens)) + 0.5) - math.log(df + 0.5) for w in words}
    floor = 0.25 * sum(raw.values()) / len(raw)
    for i, t in enumerate(tokens):
        score = sum(
            (raw[q] if raw[q] >= 0 else floor) * t.count(q) * 2.5 / (t.count(q) + 1.5 * (0.25 + 0.75 * len(t) / mean))
            for q in "правление директоров совет совет".split()
        )
        assert got.get(i, 0) == pytest.approx(max(score, 0), abs=1e-8)


def test_empty_scope_is_nothing(spark):
    clauses = spark.createDataFrame([(1, "d", "3.1", "3"), (2, "d", "", "§1")], "clause_id int, doc_id string, number string, section_key string")
    scope = spark.createDataFrame([], "doc_id string, section_key string")
    assert fusion.in_scope(clauses, scope, "doc_id").count() == 0
    scope = spark.createDataFrame([("d", "3")], "doc_id string, section_key string")
    assert [r.clause_id for r in fusion.in_scope(clauses, scope, "doc_id").collect()] == [1]


def test_vector_rank_ties_and_zero_vectors(spark):
    items = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 0.0]), (4, None)], "item int, vec array<double>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, vec array<double>")
    got = vectors.rank(asked, items, "item", 2).orderBy("rank").collect()
    assert [(r.item, r.score) for r in got] == [(1, 1.0), (3, 1.0)]


def test_reading_and_finding(spark):
    d = docs(spark, CHARTER)
    assert toc.read(d, "doc", "md", "3.7").first().section_text.startswith("### 3.7. Отдельно")
    assert toc.read(d, "doc", "md", "сроки").first().section_key == "4"
    assert toc.read(d, "doc", "md", "нет такого").count() == 0
