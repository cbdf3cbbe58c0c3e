"""Index persistence, normalisers, sections and the scope of intermediates."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lexgrain import runtime
from lexgrain.functions import text as X
from lexgrain.functions.stem import with_stem
from lexgrain.operators import agentic, lexical, parse, vectors
from lexgrain.plans.index import Index
from lexgrain.sources import store

#: Words and stems of the published sample vocabulary of the algorithm.
STEMS = """в в вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоне вагон вагонов вагон вагоном вагон
вагоны вагон важная важн важнее важн важнейшие важн важнейшими важн важничал важнича важно важн важного важн
важности важност важностию важност важность важност важностью важност важную важн важных важн вазах ваз вакса вакс
вакханка вакханк вал вал валандался валанда валентина валентин валериановых валерианов валерию валер валетами валет
пава пав павел павел павильонам павильон павла павл павлиний павлин павлиньи павлин павлович павлович падаль падал
падает пада падай пада пакет пакет палаты палат""".split()


def test_stems(spark):
    rows = list(zip(STEMS[::2], STEMS[1::2])) + [("ёлками", "елк"), ("abc", "abc"), ("", ""), ("вс", "вс"), ("25", "25")]
    got = with_stem(spark.createDataFrame(rows, "w string, s string"), "w", "got").collect()
    assert [(r.w, r.got) for r in got if r.got != r.s] == []
    forms = [("заинтересованностью", "заинтересованность"), ("сделки", "сделка"), ("крупной", "крупная"), ("протоколом", "протокол")]
    both = with_stem(with_stem(spark.createDataFrame(forms, "a string, b string"), "a", "x"), "b", "y")
    assert both.where("x = y").count() == len(forms)


def test_normalisers():
    assert [lexical.resolve_normaliser(n) for n in ("auto", "stem", "none")] == ["stem", "stem", "none"]
    with pytest.raises(ValueError):
        lexical.resolve_normaliser("porter")
    with pytest.raises(RuntimeError):
        lexical.resolve_normaliser("lemma")


TEXT = "## Статья 1. Права\n1.1. Совет директоров утверждает протоколы.\n1.2. Правление.\n## Статья 2. Сроки\n2.1. Год."


def counted():
    return lambda texts: [[float("Совет" in t), float("Правление" in t), float("Год" in t or "год" in t)] for t in texts]


embedder = counted()  # made in a function, so that it travels by value


@pytest.fixture
def built(spark):
    docs = spark.createDataFrame([("d", "d.md", TEXT)], "doc_id string, source_path string, md_text string")
    index = Index.build(docs)
    index.tables["vectors"] = vectors.embed(index.tables["units"], "unit_id", "text", embedder)
    return index


def test_saved_index_keeps_postings_vectors_and_normaliser(spark, tmp_path, built):
    built.save(spark, str(tmp_path / "i"))
    again = Index.load(spark, str(tmp_path / "i"))
    assert set(store.TABLES) == set(again.tables) and again.normaliser == "stem" == store.manifest(spark, str(tmp_path / "i"))["lexical"]["normaliser"]
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(again.terms.postings.select("term", "unit_id", "tf")) == rows(built.terms.postings.select("term", "unit_id", "tf"))
    assert rows(again.tables["vectors"]) == rows(built.tables["vectors"]) and again.dimension == 3
    # another form of the words is found by stems only
    asked = spark.createDataFrame([(1, "утвержденный протоколом совет")], "query_id long, text string")
    assert again.search(asked).join(again.tables["clauses"], "clause_id").orderBy("rank").first().number == "1.1"
    plain = Index.load(spark, str(tmp_path / "i"), normaliser="none")
    assert "протоколы" in {r.term for r in plain.terms.terms.collect()}


def test_vectors_must_fit(spark, built):
    asked = spark.createDataFrame([(1, "год")], "query_id long, text string")
    wrong = spark.createDataFrame([(1, [1.0])], "query_id long, vec array<double>")
    with pytest.raises(ValueError):
        built.search(asked, "vector", query_vectors=wrong)
    built.tables["vectors"] = built.tables["vectors"].limit(1)
    built.__dict__.pop("dimension", None)
    built.__dict__.pop("unit_vectors", None)
    with pytest.raises(ValueError):
        built.dimension


def test_sections_by_meaning_and_rounds_over_an_index(spark, built):
    near = spark.createDataFrame([(1, [0.0, 0.0, 1.0])], "query_id long, vec array<double>")
    found = built.find_section(near, 1).first()
    assert (found.section_key, found.title, found["rank"]) == ("2", "Статья 2. Сроки", 1)
    searches = built.asker(spark, embedder)
    assert [r[2] for r in searches["scoped"]("статья про год", 5)][0].startswith(("2.1.", "## Статья 2"))
    assert searches["grep"](r"\w+", 1)[0][1] >= 4
    plain = agentic.agentic_search("год", searches["search"], searches["grep"], None, scoped=searches["scoped"])
    assert "Год" in plain.rows[0][3]
    assert "scoped" not in built.asker(spark)


def sections_by_hand(keys, n):
    """(end, name, parent) of headings at lines 0, 2, 4 ... of a text of ``n`` lines."""
    below = lambda k, p: k == p or k.startswith(p + ".")
    out, nameless = [], 0
    for i, key in enumerate(keys):
        later = [j for j in range(i + 1, len(keys)) if key == "" or (keys[j] and not below(keys[j], key))]
        end = 2 * later[0] if later else n
        nameless += key == ""
        above = [k for k in keys if key and k and key.startswith(k + ".")]
        out.append((end, key or f"§{nameless}", max(above, key=len, default="")))
    return out


def test_sections_against_a_loop(spark):
    rng = random.Random(4)
    docs, want = [], {}
    for d in range(60):
        keys = [rng.choice(["", "1", "2", "1.1", "1.2", "1.1.1", "2.1", "10", "1.10"]) for _ in range(rng.randint(1, 12))]
        text = "".join(f"# {k + '. ' if k else ''}Имя\nтекст\n" for k in keys)
        docs.append((d, text))
        want[d] = sections_by_hand(keys, 2 * len(keys) + 1)
    df = spark.createDataFrame([*docs, (99, None), (98, ""), (97, "без")], "d long, t string")
    got = parse.sections(parse.lines(df, "d", "t"), "d").orderBy("d", "line_start").collect()
    assert {d: [(r.line_end, r.section_key, r.parent_key) for r in got if r.d == d] for d in want} == want
    assert {r.d for r in got} == set(want)


def test_intermediates_end_with_their_scope(spark):
    with runtime.intermediates(spark):
        df = runtime.materialise(spark.range(3))
        path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        with runtime.intermediates(spark):
            inner = runtime.scratch(spark)
            spark.range(1).write.parquet(inner)
        assert not os.path.exists(inner.removeprefix("file:")) and df.count() == 3 and os.path.isdir(path)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        master = "spark://host:7077"
        getConf = lambda self: self
        get = lambda self, key: None
        getCheckpointDir = lambda self: None

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())


def test_ranking_within_a_scope(spark):
    rows = spark.createDataFrame([(i, [float(i % 3), 1.0], i % 4) for i in range(40)] + [(40, None, 1)], "v long, vec array<double>, s int")
    asked = rows.where("v < 3").select(F.col("v").alias("query_id"), "vec")
    scope = {0: {1, 2}, 1: {3}}
    got = vectors.rank(asked, rows, "v", 30, section="s", scope=scope).collect()
    assert {r.query_id for r in got} == {0, 1} and {r.v % 4 for r in got if r.query_id == 0} == {1, 2}
    assert sum(r.query_id == 1 for r in got) == 10


@pytest.mark.parametrize("cells", [8_000_000, 7])
def test_many_queries_rank_as_scores_do(spark, monkeypatch, cells):
    monkeypatch.setattr(lexical, "_CELLS", cells)
    rng = random.Random(2)
    words = [f"слово{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(400)] + [(400, None), (401, "слово1"), (402, "слово1")]
    units = spark.createDataFrame(rows, "unit_id long, text string")
    index = lexical.build(units, "unit_id", "text")
    asked = spark.createDataFrame([(n, t) for n, t in rows[:30]] + [(99, "слово1 слово1 слово2"), (98, "нет такого"), (97, None)], "query_id long, text string")
    want = lexical.top(lexical.scores(index, lexical.query_terms(asked, "query_id", "text")), 4)
    got = lexical.rank(index, asked, "query_id", "text", 4)
    shown = lambda df: sorted((r.query_id, r["rank"], r.unit_id, r.score) for r in df.collect())
    assert shown(got) == shown(want)
    assert lexical.rank(index, asked.where("false"), "query_id", "text", 4).count() == 0
    monkeypatch.setattr(lexical, "RANKED_TERMS", 3)
    with pytest.raises(ValueError):
        lexical.rank(index, asked, "query_id", "text", 4)


def test_dense_hashing_vectors(spark):
    rows = [(1, "Совет директоров совет"), (2, ""), (3, None), (4, "25 а")]
    df = spark.createDataFrame(rows, "u long, t string")
    entries = {(r.u, r.dim): r.value for r in vectors.hashed(df, "u", "t").collect()}
    for r in df.select("u", vectors.hashed_dense(X.tokens("t")).alias("v")).collect():
        assert len(r.v) == 256
        assert {d: x for d, x in enumerate(r.v) if x} == pytest.approx({d: x for (u, d), x in entries.items() if u == r.u})


def test_import_needs_no_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).returncode == 0
