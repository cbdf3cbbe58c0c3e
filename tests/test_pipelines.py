"""Pipelines, judged fields, edits, guarded models and search over files."""

import json

import pytest
from pyspark.sql import functions as F

from lexgrain.operators import chunking, conversation, evaluation, extraction, vectors
from lexgrain.plans.pipelines import Field, FileSearch, extract_documents
from lexgrain.sources import files


def scored(spark, rows):
    return spark.createDataFrame(rows, "query_id long, doc string, chunk_no long, score double")


def test_fused_rankings_and_fallback(spark):
    words = scored(spark, [(1, "a", i, 20.0 - i) for i in range(20)] + [(1, "b", 3, 2.0), (1, "b", 1, 2.0)])
    near = scored(spark, [(1, "a", 19 - i, 1.0 - i / 100) for i in range(20)])
    got = chunking.fused(words, near, 5).orderBy("doc", "rank").collect()
    # only the 15 best of each ranking take part
    want = {}
    for i in range(15):
        want[i] = want.get(i, 0) + 0.7 / (61 + i)
        want[19 - i] = want.get(19 - i, 0) + 0.3 / (61 + i)
    best = sorted(want, key=lambda c: (-round(want[c], 9), c))[:5]
    assert [r.chunk_no for r in got if r.doc == "a"] == best
    # a document without vectors keeps its ranking by words, ties to the lower chunk
    assert [(r.chunk_no, r.score) for r in got if r.doc == "b"] == [(1, 2.0), (3, 2.0)]
    alone = chunking.fused(words, None, 5).where("doc = 'a'").orderBy("rank").collect()
    assert [r.chunk_no for r in alone] == [0, 1, 2, 3, 4]


DOCS = [("a", "# Устав\n## Статья 1. Органы\n1.1. Совет директоров.\n1.2. Правление.\n## Статья 2. Срок\n2.1. Год."), ("b", ""), ("c", None), ("d", "без слов")]
FIELDS = [Field("органы", "list", "name", "совет правление"), Field("срок", "str", "clause", "год срок")]


@pytest.mark.parametrize("meaning", ["none", "works", "fails"])
def test_extraction_of_documents(spark, meaning):
    def embed(texts):
        if meaning == "fails":
            raise OSError("no network")
        return [[1.0, float("од" in t)] for t in texts]

    client = lambda name, context: json.dumps([context[:200]]) if name == "органы" else context[-30:]
    docs = spark.createDataFrame(DOCS, "id string, t string").withColumn("doc", F.lit(0)).withColumn("field", F.lit("x"))
    got = {(r.doc, r.field): r["values"] for r in extract_documents(docs, "id", "t", FIELDS, client, k=2, embedder=None if meaning == "none" else embed).collect()}
    assert len(got) == 8
    assert got["b", "органы"] == got["c", "органы"] == [] and got["b", "срок"] == got["c", "срок"] == [extraction.NOT_GIVEN]
    assert got["d", "органы"] == ["без слов"] and "Совет директоров" in got["a", "органы"][0] and "Год" in got["a", "срок"][0]


def test_warnings(spark):
    docs = spark.createDataFrame([(1, "12.1. Совет. 7.2) Срок"), (2, "")], "id int, t string")
    rows = [
        (1, "пункты", "clause", "2.1. чужой"), (1, "пункты", "clause", "12.1 свой"), (1, "пункты", "clause", "без номера"), (1, "органы", "name", "7.2. Совет"),
        (1, "органы", "name", "Совет"), (2, "пункты", "clause", "9.9 без текста"), (2, "органы", "name", "1 Совет"), (3, "пункты", "clause", "1.1 без документа"), (1, "пункты", "clause", None),
    ]
    items = spark.createDataFrame(rows, "id int, field string, style string, value string")
    got = sorted((r.id, r.value, r.warning) for r in extraction.warnings(items, "id", docs, "t").collect())
    assert got == [(1, "2.1. чужой", "number_absent"), (1, "7.2. Совет", "number_in_name"), (2, "1 Совет", "number_in_name")]
    assert extraction.covers(["a", "b"], ["a"]) and not extraction.covers(["a"], ["a", "b"])


def test_judged_fields(spark):
    rows = [(1, '{"a": ["x"], "b": ""}', "нет"), (2, "нет", "{}"), (3, '{"a": 1}', '{"a": 1}'), (4, '{"boom": 1}', "{}"), (5, None, None), (6, "[1]", "{}")]

    def judge(want, got):
        if "boom" in want:
            raise OSError("down")
        return [{"field": "a", "status": "not_significant_error", "extras": ["y"]}]

    pairs = spark.createDataFrame(rows, "id int, expected string, actual string").withColumn("reason", F.lit(0))
    told = evaluation.judged(pairs, "id", judge)
    got = {r.id: r for r in told.collect()}
    assert [(v.field, v.status, v.missing) for v in got[1].verdicts] == [("a", "significant_error", ['["x"]']), ("b", "significant_error", [])]
    assert [got[i].reason.split(":")[0] for i in (1, 2, 3, 4, 5, 6)] == ["actual is no JSON", "expected is no JSON", "", "the judge failed", "expected is no JSON", "expected is no JSON"]
    assert got[3].verdicts[0].extras == ["y"] and got[3].verdicts[0].missing == []
    scores = {r.id: r.score for r in evaluation.judged_scores(told, "id").collect()}
    assert scores == {1: 0.0, 2: 0.0, 3: 0.7, 4: 0.0, 5: 0.0, 6: 0.0}


def test_edits_versions_and_rollback(spark):
    texts = spark.createDataFrame([("p", "один два один"), ("q", None), ("r", "как есть")], "target string, content string")
    rows = [
        ("p", 1, "MODIFY", "один", "1"), ("p", 2, "DELETE", "два ", None), ("p", 3, "INSERT", None, "три"), ("p", 4, "MODIFY", "нет", "x"), ("p", 5, "MODIFY", "три", ""),
        ("q", 1, "INSERT", None, "новое"), ("z", 1, "INSERT", None, "x"), ("p", 6, "RENAME", "1", "2"),
    ]
    edits = spark.createDataFrame(rows, "target string, ord int, operation string, old string, new string")
    done = evaluation.edited(texts, edits)
    assert {r.target: r.content for r in done.collect()} == {"p": "1 один\nтри", "q": "\nновое", "r": "как есть"}
    none = spark.createDataFrame([], "target string, version int, content string")
    history = evaluation.with_version(evaluation.with_version(none, texts), done)
    assert sorted((r.target, r.version) for r in history.collect()) == [(t, v) for t in "pqr" for v in (1, 2)]
    back = evaluation.rolled_back(done, evaluation.with_version(none, texts), texts.where("target <> 'q'"))
    assert {r.target: r.content for r in back.collect()} == {"p": "один два один", "q": "\nновое", "r": "как есть"}


def test_guarded_model():
    sent = []

    def model(messages):
        sent.append(messages)
        if len(sent) == 1:
            raise ValueError("Tool call id must not be empty")
        return {"role": "assistant", "content": '<minimax:tool_call><invoke name="ls"><path>/</path></invoke></minimax:tool_call>ok', "tokens": 60}

    guarded = conversation.GuardedModel(model, budget=100, conv="c")
    history = [
        {"role": "assistant", "content": "", "tool_calls": [{"id": "", "name": "a", "args": {}}, {"id": "x", "name": "b", "args": {}}]},
        {"role": "tool", "content": [{"type": "image", "text": "?"}], "tool_call_id": ""},
        {"role": "tool", "content": "два", "tool_call_id": None},
        {"role": "tool", "content": "лишний"},
    ]
    answer = guarded(history)
    assert len(sent) == 2 and history[0]["tool_calls"][0]["id"] == ""
    first = sent[0][0]["tool_calls"][0]["id"]
    assert first.startswith("call_") and [m.get("tool_call_id") for m in sent[0][1:]] == [first, "x", None]
    # before the second try ids are filled again, so the one too many takes the first
    assert [m.get("tool_call_id") for m in sent[1][1:]] == [first, "x", first]
    assert sent[1][1]["content"] == [{"type": "text", "text": conversation.HINT}]
    assert answer["content"] == "ok" and answer["tool_calls"][0]["name"] == "ls" and answer["tool_calls"][0]["id"].startswith("call_")
    guarded(history)
    with pytest.raises(conversation.BudgetExceeded):
        guarded(history)
    assert guarded.used == 120 and len(sent) == 3

    def broken(messages):
        raise ValueError("something else")

    with pytest.raises(ValueError, match="else"):
        conversation.GuardedModel(broken)([])


def test_search_over_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("## Статья 1. Права\n1.1. Совет директоров.\n1.2. Правление общества.")
    (tmp_path / "b.txt").write_text("2.1. Срок полномочий год.")
    (tmp_path / "c.pdf").write_bytes(b"%PDF")
    paths = [str(tmp_path / n) for n in ("a.md", "b.txt", "c.pdf")]
    found = FileSearch(spark, most=2)
    assert [(r.doc_id, r.number) for r in found.search(paths, "сроки полномочия").collect()][0] == ("b", "2.1")
    kept = found.index(paths)
    assert found.index(list(reversed(paths))) is kept
    (tmp_path / "b.txt").write_text("2.1. Ревизор.")
    assert found.index(paths) is not kept and found.search(paths, "полномочия").count() == 0
    with pytest.raises(RuntimeError):
        found.search(paths, "x", "hybrid")
    embed = lambda texts: [[1.0, float("Правлен" in t or "правлен" in t)] for t in texts]
    assert FileSearch(spark, embed).search(paths, "правление", "hybrid", 1).first().number == "1.2"


def test_pages_and_inputs(spark, tmp_path):
    rows = [(1, 2, "два"), (1, 1, "один"), (1, 10, None)]
    made = files.paged(spark.createDataFrame(rows, "d int, p int, t string"), "d", "p", "t").first()
    assert made.md_text == "Total pages: 3\n\n--- Page 1/3 ---\nодин\n\n--- Page 2/3 ---\nдва\n\n--- Page 10/3 ---\n"
    for name, body in (("a.md", b"\xffA"), ("b.pdf", b"B"), ("c.pdf", b"B"), ("d.pdf", b"bad"), (".h.md", b"x")):
        (tmp_path / name).write_bytes(body)
    staged = files.stage(spark, str(tmp_path), str(tmp_path / "run"))
    assert [p.rsplit("/", 1)[1] for p in staged] == ["a.md", "b.pdf", "c.pdf", "d.pdf"]
    assert len(files.stage(spark, str(tmp_path / "a.md"), str(tmp_path / "run"))) == 1
    for missing in ("none", "run/scratch"):
        with pytest.raises(FileNotFoundError):
            files.stage(spark, str(tmp_path / missing), str(tmp_path / "run"))

    def recognise(path, content):
        if content == b"bad":
            raise OSError("unreadable")
        return f"текст {content.decode()}"

    read = files.binary(spark, [str(tmp_path / n) for n in ("a.md", "b.pdf", "c.pdf", "d.pdf")])
    got = {r.path.rsplit("/", 1)[1]: r.md_text for r in files.all_texts(read, recognise).collect()}
    assert got == {"a.md": "�A", "b.pdf": "текст B", "c.pdf": "текст B"} and files.all_texts(read).count() == 1
    none = spark.createDataFrame([], "content_key string, md_text string")
    texts, cache = files.recognised_once(read.where("path like '%.pdf'"), recognise, none)
    assert sorted((r.md_text, r.error is None) for r in texts.collect() if r.md_text) == [("текст B", True)] * 2 and cache.count() == 1
    again, same = files.recognised_once(read.where("path like '%c.pdf'"), lambda p, c: 1 / 0, cache)
    assert [r.md_text for r in again.collect()] == ["текст B"] and same.count() == 1


def test_providers():
    known = {"local": lambda: "L", "remote": lambda: "R"}
    assert vectors.provider("local", known, {"remote": None}) == "L" and vectors.provider("remote", known, {"remote": "key"}) == "R"
    with pytest.raises(PermissionError):
        vectors.provider("remote", known, {"remote": ""})
    with pytest.raises(ValueError):
        vectors.provider("x", known, {})


def test_clean_replies_stay_in_the_jvm_and_read_the_same(spark):
    raws = ['["а", " б ", ""]', "[]", ' [ "а" ,"б"] ', '["a\\"b"]', '["[1]"]', '["а", null]', '["а", 1]', '["`x`"]', "", None, "- а", '["т\\u043e"]']
    df = spark.createDataFrame([(i, r, "list") for i, r in enumerate(raws)] + [(99, '["а"]', "str")], "i int, raw string, kind string")
    got = {r.i: r.v for r in df.select("i", extraction.reply_values("raw", "kind").alias("v")).collect()}
    assert got == {i: extraction.parse_reply(r, "list") for i, r in enumerate(raws)} | {99: extraction.parse_reply('["а"]', "str")}
