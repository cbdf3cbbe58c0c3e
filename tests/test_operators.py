import json
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexgrain import registry
from lexgrain.functions import text as X
from lexgrain.operators import agentic, chunking, conversation, evaluation, extraction
from lexgrain.plans import tables as T
from lexgrain.plans.index import Index
from lexgrain.sources import files, store
from lexgrain.streaming import ingest


@pytest.mark.parametrize(
    ("raw", "kind", "want"),
    [
        ('```json\n["а", "б"]\n```', "list", ["а", "б"]),
        ('Вот: ["а"] и ещё ["б"]', "list", ["а", "б"]),
        ("- 7.1 первое\n* второе,\n\n", "list", ["7.1 первое", "второе"]),
        ('["[\\"x\\", \\"y\\"]"]', "list", ["x", "y"]),
        ('{"пункт": "7.1", "значение": "текст", "прочее": 1}', "str", ["7.1. текст"]),
        ('{"a": 1, "b": "в"}', "str", ["1. в"]),
        ("«строка»", "str", ["«строка»"]),
        ('[broken {"a": "б"}', "list", ["б"]),
        (None, "list", []),
        ("  ", "str", []),
    ],
)
def test_replies(raw, kind, want):
    assert extraction.parse_reply(raw, kind) == want


def test_first_json_prefers_arrays():
    assert extraction.first_json('<think>[1]</think> so: {"a": [2]} end') == [2]
    assert extraction.first_json("nothing") is None


def test_coercion_and_prefixes(spark):
    rows = [(1, 0, " Совет "), (1, 1, "совет"), (1, 2, "n/a"), (1, 3, None), (1, 4, "7.1. Правление"), (1, 5, "7.1.")]
    df = spark.createDataFrame(rows, "id int, pos int, value string")
    assert [r.value for r in extraction.coerced(df, "id", pos="pos", value="value").orderBy("pos").collect()] == ["Совет", "7.1. Правление", "7.1."]
    got = df.orderBy("pos").select(extraction.without_prefix("value").alias("v"), extraction.leading_number("value").alias("n")).collect()
    assert [r.v for r in got][4:] == ["Правление", "7.1."] and got[4].n == "7.1"
    kept = df.where("pos = 0").select(extraction.without_prefix("value").alias("v")).first()
    assert kept.v == "Совет"


def test_extraction_asks_again_and_cleans(spark):
    rows = [(1, "органы", "list", "name", "текст"), (1, "высший", "str", "name", " "), (2, "пункты", "list", "clause", "x"), (3, "пусто", "list", "name", "x")]
    contexts = spark.createDataFrame(rows, "doc int, field string, kind string, style string, context string")
    asked = []

    def client(field, context):
        asked.append(field)
        if field == "органы":
            return "[]" if len(asked) == 1 else '["12.1. Совет", "совет", "n/a", "СОВЕТ"]'
        return '["12.1. Совет"]' if field == "пункты" else "[]"

    got = {(r.doc, r.field): r["values"] for r in extraction.extract(contexts.coalesce(1), client).collect()}
    assert got[1, "органы"] == ["Совет", "совет"] and got[1, "высший"] == [extraction.NOT_GIVEN]
    assert got[2, "пункты"] == ["12.1. Совет"] and got[3, "пусто"] == []


def test_absent_numbers(spark):
    docs = spark.createDataFrame([("d", "12.1. Текст; см. 13.4.1 и 2.5.")], "doc string, md string")
    items = spark.createDataFrame([("d", "12.1 а"), ("d", "12 б"), ("d", "13.4 в"), ("d", "2.5. г"), ("e", "12.1 д"), ("d", "без")], "doc string, value string")
    got = extraction.absent_numbers(items, "doc", "value", docs, "md")
    assert sorted(r.value for r in got.collect()) == ["12 б", "12.1 д", "13.4 в"]


def test_reply_pairing(spark):
    call = "array<struct<id:string,name:string>>"
    rows = [
        (1, 1, "assistant", [("a", "x"), ("", "y"), ("c", "z")], ""),
        (1, 2, "tool", None, "c"),
        (1, 3, "tool", None, ""),
        (1, 4, "tool", None, ""),
        (1, 5, "tool", None, "lost"),
    ]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, tool_calls {call}, tool_call_id string")
    got = {r.turn: r.name for r in conversation.replies(df).collect()}
    assert got == {2: "z", 3: "x", 4: "y", 5: "tool"}


OPEN, CLOSE = "]<]minimax[>[", "]<]/minimax[>["


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('<minimax:tool_call><invoke name="find"><parameter name="q">"а"</parameter><parameter name="k">3</parameter></invoke></minimax:tool_call>', [("find", {"q": "а", "k": "3"})]),
        ('<minimax:tool_call><invoke name="a"><parameter name="x">1<parameter name="y">2<invoke name="b"><parameter name="z">x', [("a", {"x": "1", "y": "2"}), ("b", {"z": "x"})]),
        (OPEN + '<invoke name="read"><path>/a.md</path><pages>1-3</pages></invoke>' + CLOSE, [("read", {"path": "/a.md", "pages": "1-3"})]),
        (OPEN + '<invoke name="ls"><path>/skills</path', [("ls", {"path": "/skills"})]),
        (OPEN + '<invoke name="s"><paths>["/d.md"]</paths><query>сделки</query></invoke>' + CLOSE, [("s", {"paths": '["/d.md"]', "query": "сделки"})]),
        ('<minimax:tool_call><invoke name="a"><parameter name="x">1</parameter></invoke></minimax:tool_call>\n' + OPEN + '<invoke name="b"><y>2</y></invoke>' + CLOSE, [("a", {"x": "1"}), ("b", {"y": "2"})]),
        ('prose about <invoke name="x"><y>1</y></invoke>', []),
        ("обычный ответ", []),
        (None, []),
    ],
)
def test_markup_calls(text, want):
    assert [(c["name"], c["args"]) for c in conversation.markup_calls(text)] == want


def test_text_beside_calls():
    text = "<mm:think>мысль</mm:think>" + OPEN + '<invoke name="ls"><path>/</path></invoke>' + CLOSE
    assert conversation.without_calls(text) == "мысль" and conversation.without_calls("<mm:think>a") == "<mm:think>a"


def test_binary_blocks_and_traces(spark):
    rows = [(1, [("text", "a"), ("file", "x")]), (2, [("image", "x")]), (3, [])]
    df = spark.createDataFrame(rows, "n int, b array<struct<type:string,text:string>>")
    got = {r.n: [x.text for x in r.k] for r in df.select("n", conversation.text_blocks("b").alias("k")).collect()}
    assert got == {1: ["a"], 2: [conversation.HINT], 3: []}
    call = "array<struct<id:string,name:string>>"
    said = [(1, 1, "assistant", [("a", "x"), ("b", "y")], "", ""), (1, 2, "tool", None, "a", "one\ntwo"), (1, 3, "tool", None, "zz", "lost")]
    messages = spark.createDataFrame(said, f"conv_id int, turn int, role string, tool_calls {call}, tool_call_id string, content string")
    assert conversation.trace(messages).first().trace == "[0] x → one two\n[1] y → \n[2] tool → lost"


def test_evidence_prefers_the_longer_report(spark):
    said = [(1, 1, "assistant", "x" * 30), (1, 2, "tool", "короткий"), (2, 1, "assistant", "y" * 300)]
    messages = spark.createDataFrame(said, "conv int, turn int, role string, content string")
    reports = spark.createDataFrame([(1, "f", "отчёт"), (2, "f", ""), (3, "f", "один")], "conv int, field string, report string")
    got = {r.conv: r.evidence for r in extraction.evidence(messages, reports, "conv", "turn").collect()}
    assert got == {1: "отчёт\n\n" + "x" * 30, 2: "y" * 300, 3: "один"}


def test_reports(spark):
    df = spark.createDataFrame([(1, "Совет", ["а", "б"], []), (2, None, None, ["в"])], "id int, s string, l array<string>, m array<string>")
    got = {r.id: r.report for r in extraction.rendered(df, "id", [("s", "С"), ("l", "Л"), ("m", "М")]).collect()}
    assert "### Л (`l`)\n- а\n- б\n" in got[1] and "- (не найдено)" in got[1] and "(не найдено)" in got[2]
    trials = spark.createDataFrame([("s", 0.5, 0.75, True), ("t", 0.5, 0.25, False)], "k string, before double, after double, accepted boolean")
    sections = {r.k: r.section for r in evaluation.training_report(trials, "k").collect()}
    assert "| 0.50 | 0.75 | +0.25 | accepted |" in sections["s"] and "rolled back" in sections["t"]


def test_usage_and_budget(spark):
    df = spark.createDataFrame([(1, 1, 0, 7), (1, 2, None, 7), (2, 1, 3, 9), (2, 2, 4, 9)], "c int, t int, n int, total int")
    assert {r.c: r.tokens for r in conversation.usage(df, "c", "n", "total").collect()} == {1: 7, 2: 7}
    got = conversation.budget(df.where("c = 2"), "c", "t", "n", 3).orderBy("t").collect()
    assert [(r.used_before, r.allowed) for r in got] == [(0, True), (3, False)]


def test_evaluation(spark):
    v = spark.createDataFrame([("f", "correct"), ("f", "not_significant_error"), ("f", "odd")], "field string, status string")
    assert evaluation.verdict_scores(v, "field").first().score == pytest.approx(1.7 / 3, abs=1e-6)
    df = spark.createDataFrame([("a.b.a", "a", "x$1"), ("abc", "z", "y")], "t string, o string, n string")
    got = df.select(evaluation.replaced_first(F.col("t"), F.col("o"), F.col("n")).alias("r")).collect()
    assert [r.r for r in got] == ["x$1.b.a", "abc"]


@pytest.mark.parametrize(("spec", "want"), [("1,3,5-8", [1, 3, 5, 6, 7, 8]), ("9-12", [9, 10]), ("x,2-", []), ("8-5", []), ("0,3,3", [3]), ("", [])])
def test_page_selection(spark, spec, want):
    assert spark.createDataFrame([(spec,)], "s string").select(X.page_selection("s", F.lit(10))).first()[0] == want


def scripted(replies):
    replies = list(replies)
    return lambda prompt: replies.pop(0)


def ranking(rows):
    return lambda query, k: rows[:k]


FOUND = ranking([(1, 0.5, "один"), (2, 0.4, "два")])
GREP = ranking([(3, 2.0, "три")])


def graded(*verdicts, aspects=()):
    return json.dumps([{"id": f"C{i}", "verdict": v, "aspects": list(aspects)} for i, v in enumerate(verdicts, 1)])


def test_search_in_rounds():
    plan = json.dumps({"queries": ["пункт 7.1"], "aspects": ["a"]})
    got = agentic.agentic_search("q", FOUND, GREP, scripted([plan, graded("partial", "Relevant", aspects=[1])]))
    assert [(r[0], r[2]) for r in got.rows] == [(1, "relevant"), (3, "partial")] and not got.degraded and got.calls == 2
    plain = agentic.agentic_search("q", FOUND, GREP, None)
    assert [r[0] for r in plain.rows] == [1, 2] and not plain.degraded and plain.calls == 0


@pytest.mark.parametrize(
    ("replies", "calls"),
    [
        (["это не JSON"], 1),
        (["[1]"], 1),
        ([], 1),
        ([json.dumps({"queries": ["q"]}), "не JSON"], 2),
        ([json.dumps({"queries": ["q"]}), "[]"], 2),
        ([json.dumps({"queries": ["q"]}), graded("perhaps", "good")], 2),
        ([json.dumps({"queries": ["q"]}), json.dumps({"id": "C1", "verdict": "relevant"})], 2),
    ],
)
def test_unusable_answers_degrade(replies, calls):
    got = agentic.agentic_search("q", FOUND, GREP, scripted(replies))
    assert got.degraded and got.calls == calls and [(r[0], r[2]) for r in got.rows] == [(1, ""), (2, "")]


def test_no_calls_left_degrades():
    got = agentic.agentic_search("q", FOUND, GREP, scripted([json.dumps({"queries": ["q"]})]), agentic.Limits(calls=1))
    assert got.degraded and got.calls == 1 and got.trace[-1]["error"] == "no calls left"


def test_verdicts_by_the_first_number_and_aspects_by_position():
    plan = json.dumps({"queries": ["q"], "aspects": ["a", "b"]})
    items = [{"id": "candidate 2 of 9", "verdict": "partial", "aspects": ["1", 2, "x", None]}, {"id": "C7", "verdict": "relevant"}, {"id": "C1", "verdict": "?"}]
    got = agentic.agentic_search("q", FOUND, GREP, scripted([plan, json.dumps(items)]))
    # both aspects are covered by a partial verdict, so one round is enough; C1 stays ungraded
    assert [(r[0], r[2]) for r in got.rows] == [(2, "partial")] and got.rounds == 1 and not got.degraded


def test_refining_finds_what_was_missed_and_grades_once():
    later = iter([[(1, 0.5, "один")], [(1, 0.9, "один"), (5, 0.3, "пять")]])
    plan = json.dumps({"queries": ["q"], "aspects": ["a"]})
    refine = json.dumps({"queries": ["r"]})
    got = agentic.agentic_search("q", lambda q, k: next(later), GREP, scripted([plan, graded("irrelevant"), refine, graded("relevant", aspects=[1])]))
    assert [r[0] for r in got.rows] == [5] and got.rounds == 2 and got.calls == 4
    ended = agentic.agentic_search("q", FOUND, GREP, scripted([plan, graded("relevant", "partial"), "не JSON"]))
    assert not ended.degraded and [r[2] for r in ended.rows] == ["relevant", "partial"]
    nothing = agentic.agentic_search("q", FOUND, GREP, scripted([plan, graded("irrelevant", "irrelevant"), "{}"]))
    assert [r[2] for r in nothing.rows] == ["", ""] and not nothing.degraded


def test_numbers_and_sections_of_a_query():
    asked = []
    grep = lambda p, k: asked.append(p) or []
    scoped = ranking([(4, 9.0, "четыре")])
    rows = agentic.candidates("статья 7 про 25% и 1,5 и 30", FOUND, grep, scoped)
    assert asked == ["7", "25%", "1,5"] and rows[-1][0] == 4
    assert agentic.candidates("что в 7.1?", FOUND, GREP, scoped)[-1][0] == 3


def test_content_blocks():
    assert agentic.content_text([{"type": "text", "text": "abc"}, {"text": "de"}, "f"]) == "abcdef" and agentic.content_text(None) == ""


def test_files(spark, tmp_path):
    (tmp_path / "b.md").write_bytes("строка\r\nдва".encode())
    (tmp_path / ".hidden.md").write_text("x")
    (tmp_path / "a b.pdf").write_bytes(b"%PDF")
    paths = files.expand([str(tmp_path), str(tmp_path / "b.md")])
    assert [p.rsplit("/", 1)[1] for p in paths] == ["a b.pdf", "b.md"]
    with pytest.raises(FileNotFoundError):
        files.expand(str(tmp_path / "none"))
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): r for r in files.recognised(files.binary(spark, paths)).collect()}
    assert got["b.md"].md_text == "строка\r\nдва" and got["a b.pdf"].error
    ids = spark.createDataFrame([(1, "/x/a.md"), (2, "/y/a.md"), (3, "/z/??.md"), (4, "/a-2.md")], "n int, path string")
    assert len({r.doc_id for r in files.doc_ids(ids, "path", "n").collect()}) == 4


def test_samples_and_hints(spark, tmp_path):
    for name, body in (("a", "{bad"), ("b", '{"x": 1}')):
        (tmp_path / name / "output").mkdir(parents=True)
        (tmp_path / name / "output" / "reference.json").write_text(body)
        (tmp_path / name / "output" / "res.txt").write_text("# Совет\nx\n# Прочее\ny")
    paths = [str(p) for p in tmp_path.rglob("*") if p.is_file()]
    got = {r["sample"]: r.expected for r in files.samples(files.binary(spark, paths), active="c").collect()}
    assert got == {"a": "# Совет\nx\n# Прочее\ny", "b": '{"x": 1}'}
    assert "a" not in {r["sample"] for r in files.samples(files.binary(spark, paths), active="a").collect()}
    docs = spark.createDataFrame([(1, "нет\n# Совет\nx\n## под\n# Прочее\ny"), (2, "ничего")], "k int, t string")
    assert [(r.k, r.fragment) for r in files.hinted(docs, "k", "t", "совет чего-то").collect()] == [(1, "# Совет\nx\n## под")]


def test_vector_index(spark):
    docs = spark.createDataFrame([("d", "d.md", "## Статья 1. Права\n1.1. Совет директоров.\n1.2. Правление.\n## Статья 2. Сроки\n2.1. Год.")], "doc_id string, source_path string, md_text string")
    index = Index.build(docs)
    embedder = lambda texts: [[float("Совет" in t), float("Правление" in t), float("Год" in t)] for t in texts]
    from lexgrain.operators import vectors

    index.tables["vectors"] = vectors.embed(index.tables["units"], "unit_id", "text", embedder)
    assert {r.section_key for r in index.section_vectors().collect()} == {"1", "2"}
    assert {r.section_key for r in index.section_vectors("title_lead", embedder).collect()} == {"1", "2"}
    asked = spark.createDataFrame([(1, "год")], "query_id long, text string")
    near = spark.createDataFrame([(1, [0.0, 0.0, 1.0])], "query_id long, vec array<double>")
    for method in ("vector", "hybrid"):
        top = index.search(asked, method, k=1, query_vectors=near).join(index.tables["clauses"], "clause_id").first()
        assert top.number == "2.1"
    tree = index.search(asked, "bm25", strategy="tree", query_vectors=near).join(index.tables["clauses"], "clause_id")
    assert {r.number for r in tree.collect()} <= {"1", "1.1", "1.2", "2", "2.1"}


def test_index(spark, tmp_path):
    docs = spark.createDataFrame([("d", "d.md", "# A\n## Статья 1. Б\n1.1. Совет директоров.\n1.2. Правление.\n")], "doc_id string, source_path string, md_text string")
    root = str(tmp_path / "index")
    Index.build(docs).save(spark, root)
    index = Index.load(spark, root)
    asked = spark.createDataFrame([(1, "правление")], "query_id int, text string")
    hit = index.search(asked).join(index.tables["clauses"], "clause_id").first()
    assert hit.number == "1.2"
    for wrong in ({"method": "x"}, {"strategy": "x"}):
        with pytest.raises(ValueError):
            index.search(asked, **wrong)
    with pytest.raises(RuntimeError):
        index.search(asked, method="vector", query_vectors=asked)
    assert index.search(asked, section="2").count() == 0
    (tmp_path / "other").mkdir()
    (tmp_path / "other" / "f").write_text("x")
    with pytest.raises(ValueError):
        store.save(spark, str(tmp_path / "other"), {})
    with pytest.raises(ValueError):
        store.delete(spark, str(tmp_path / "other"))
    assert store.delete(spark, root) and not store.delete(spark, root)


def test_results_and_latest_run(spark, tmp_path):
    results = spark.createDataFrame([(1, "Совет", None)], "id int, name string, empty string")
    reports = spark.createDataFrame([(1, "строка один\nстрока два")], "id int, report string")
    store.write_results(results, reports, "id", str(tmp_path / "r"))
    assert store.read_jsonl(spark, str(tmp_path / "r" / "structured"), "id int, name string, empty string").collect() == results.collect()
    more = spark.createDataFrame([(1, "Совет", None), (2, "Съезд", None)], results.schema)
    store.write_results(more, reports, "id", str(tmp_path / "r"))
    back = {r.id: r for r in store.read_results(spark, str(tmp_path / "r"), "id", "int", "id int, name string, empty string").collect()}
    assert back[1].body == "строка один\nстрока два" and back[2].name == "Съезд" and '{"id":2,"name":"Съезд"}' in back[2].body
    with pytest.raises(FileNotFoundError):
        store.read_results(spark, str(tmp_path / "nowhere"), "id", "int", "id int")
    assert store.read_jsonl(spark, str(tmp_path / "none"), "id int").count() == 0
    runs = spark.createDataFrame([("/a/1/result.md", 1), ("/a/2/result.md", 5), ("/a/3/other.md", 9)], "path string, modificationTime int")
    assert [r.run_dir for r in store.latest_run(runs).collect()] == ["/a/2"]
    assert store.latest_run(runs.where("false")).count() == 0


def test_stream_appends_clauses(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    docs = spark.createDataFrame([(1, "## 1. А\n1.1. Текст.")], "doc int, md string")
    for _ in range(2):
        docs.write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc int, md string").parquet(source)
        ingest.append_clauses(stream, "doc", "md", target, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(target).count() == 4


def test_contexts_against_a_loop(spark, data):
    chunks = {}
    for r in registry.queries()["hierarchical_chunks"](spark, data).collect():
        chunks.setdefault(r.doc_ord, {})[r.chunk_no] = r.chunk
    bodies = T.bodies(spark, data).collect()
    words = {(d, n): re.findall(r"\w+", c.lower()) for d, own in chunks.items() for n, c in own.items()}
    df = Counter(w for ws in words.values() for w in set(ws))
    idf = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in idf.items()}
    average = sum(map(len, words.values())) / len(words)
    want = {}
    for body in bodies:
        asked = re.findall(r"\w+", body.text.lower())
        for d, own in chunks.items():
            scored = []
            for n in own:
                tf, dl = Counter(words[d, n]), len(words[d, n])
                norm = 1.5 * (0.25 + 0.75 * dl / average)
                score = sum(idf[w] * tf[w] * 2.5 / (tf[w] + norm) for w in asked if w in tf)
                if round(score, 9) > 0:
                    scored.append((-round(score, 9), n))
            best = sorted(n for _, n in sorted(scored)[:12]) or [min(own)]
            want[body.query_id, d] = "\n\n".join(own[n] for n in best)
    got = registry.queries()["bm25_chunk_context"](spark, data).collect()
    assert len(got) == len(want) and {(r.query_id, r.doc): r.context for r in got} == want


def test_contexts_keep_the_best_chunk_and_fall_back(spark):
    chunks = spark.createDataFrame([(d, n, f"{d}.{n} " + "я" * 1790) for d in (1, 2) for n in range(14)], "doc int, chunk_no int, chunk string")
    scored = spark.createDataFrame([(7, 1, n, float(n)) for n in range(14)], "query_id int, doc int, chunk_no int, score double")
    asked = spark.createDataFrame([(7, 1), (7, 2)], "query_id int, doc int")
    got = {r.doc: r.context for r in chunking.contexts(scored, chunks, asked=asked).collect()}
    assert [c.split()[0] for c in got[1].split("\n\n")] == [f"1.{n}" for n in range(2, 14)]
    assert got[2].startswith("2.0 ") and "\n\n" not in got[2]
    assert [r.doc for r in chunking.contexts(scored, chunks, 6, 9000).collect()] == [1]


def test_tree_search_sections_finds_most_of_the_nearest(spark, data):
    nearest = {(r.query_id, r.vec_id) for r in registry.queries()["vector_topk"](spark, data).where("rank <= 5").collect()}
    found = {(r.query_id, r.vec_id) for r in registry.queries()["tree_search_sections"](spark, data).collect()}
    assert len(found & nearest) >= 0.7 * len(nearest)
