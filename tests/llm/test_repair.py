import functools
import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrain.llm import canon, lookalikes, ocr_repair
from lexgrain.llm.queries import BODY_RULES

WORDS = "совет директоров комиссия рассматривает вопрос общества проект процедур организация финансово хозяйственной деятельности стоимость страховщика инвестиционных не позднее и или одно двухсторонних сделок в а о с конкурсных подписания общее собрание акционеров".split()
COUNTS = {w: 50 for w in [*WORDS, "финансово-хозяйственной"]}
TOTAL = sum(COUNTS.values())
COSTS = ocr_repair.Costs()
RARITY = {w: COSTS.rarity * math.log(TOTAL / n) for w, n in COUNTS.items()}


def repair(text, hot):
    """Repair by look-ups in a dictionary instead of joins, with all words hot or none."""
    known = RARITY if hot else {}
    by_skeleton = {}
    for word in COUNTS:
        by_skeleton.setdefault(ocr_repair.skeleton(word), []).append(word)
    reader, readings = ocr_repair.Reader(known, TOTAL, COSTS), {}
    for key in ocr_repair.asks(text, known):
        stream, low, high = ocr_repair._parts_of(key)
        words = {w for s in ocr_repair.requests(key) for w in by_skeleton.get(s, [])}
        tokens, more = reader.read(key, [(w, COUNTS[w]) for w in words])
        if more:
            words |= {w for s in ocr_repair.requests_within(stream[low:high]) for w in by_skeleton.get(s, [])}
            tokens, _ = reader.read(key, [(w, COUNTS[w]) for w in words])
        if tokens:
            readings[key] = reader.packed(tokens)
    return ocr_repair.repair(text, readings, known)


def test_every_confusion_is_an_identity_under_the_skeleton():
    assert [r for r, t in ocr_repair.MISREAD if ocr_repair.skeleton(r) != ocr_repair.skeleton(t)] == []


@pytest.mark.parametrize(
    ("read", "words", "wrong"),
    [
        ("стоиrnость", ["стоимость"], 1),
        ("страх0вщика", ["страховщика"], 1),
        ("конкурсньiх", ["конкурсных"], 1),
        ("проu,едур", ["процедур"], 1),
        ("подписапия", ["подписания"], 1),
        ("с0вет директор0в", ["совет", "директоров"], 2),
        ("советдиректоров", [" директоров"], 0),
        ("директо ров", ["директоров"], 0),
        ("директо\x02р0в", ["директоров"], 1),
        ("иивестициопиых", ["инвестиционных"], 3),
    ],
)
def test_decoding(read, words, wrong):
    _, tokens = ocr_repair.decode(read, RARITY)
    assert [t.word for t in tokens] == words and sum(len(t.glyphs) for t in tokens) == wrong


def cheapest(stream, costs=COSTS):
    """Least cost of reading one chunk without hyphens, by trying every way to cut and misread it."""

    @functools.cache
    def readings(part):
        if not part:
            return {"": 0.0}
        out = {}
        for read, truth, cost in [(part[0], part[0], 0.0), *[(r, t, 1.0) for r, t in ocr_repair.MISREAD]]:
            if part.startswith(read):
                for rest, more in readings(part[len(read) :]).items():
                    word = truth + rest
                    if cost + more < out.get(word, 9.0):
                        out[word] = cost + more
        return out

    @functools.cache
    def best(part, first):
        least = max(costs.literal, costs.literal_letter * len(part)) if first else math.inf
        for end in range(1, len(part) + 1):
            whole = first and end == len(part)
            rest = 0.0 if end == len(part) else costs.split + best(part[end:], False)
            for word, cost in readings(part[:end]).items():
                if word in RARITY and (whole or len(word) > 2):
                    least = min(least, cost + RARITY[word] + rest)
        return least

    return best(stream, True)


@settings(max_examples=40, deadline=None)
@given(st.sampled_from([w for w in WORDS if 1 < len(w) < 7]), st.sampled_from(["", "совет", "проект", "и"]), st.data())
def test_the_search_finds_the_cheapest_path(word, other, data):
    stream = word + other
    for _ in range(data.draw(st.integers(0, 3))):
        at = data.draw(st.integers(0, len(stream) - 1))
        for read, truth in data.draw(st.permutations(ocr_repair.MISREAD)):
            if stream.startswith(truth, at) and not set(read) & set("(!|"):
                stream = stream[:at] + read + stream[at + len(truth) :]
                break
    assert ocr_repair.decode(stream, RARITY)[0] == pytest.approx(cheapest(stream))


def test_unknown_words_are_left():
    assert ocr_repair.decode("абракадабра", RARITY)[1] == []


SCAN = """Total pages: 2
--- Page 1/2 ---
# УСТАВ ООО «Проба»

1.1. Комиссия рассматривает вопрос стоиrnость процедур и орга-
низация финансово-
хозяйственной деятельности не позднее одно-
и двухсторонних сделок в обще-

      3
--- Page 2/2 ---
УСТАВ ООО «ПРОБА»
ства проект.

1,2. Проект «Прова-
ло» инвестициопных сделок:

12345
54321
77

Список.
Копия верна. Рег. № 5-7"""


@pytest.mark.parametrize("hot", [True, False])
def test_findings_of_a_scan(hot):
    text, found = repair(SCAN, hot)
    kinds = {k: [i for i, x in found if x == k] for k in ("furniture", "hyphen", "glyph")}
    assert kinds["furniture"] == [0, 1, 9, 10, 11, 22]
    assert kinds["hyphen"] == [4, 5, 7, 14]
    assert kinds["glyph"] == [4, 14, 15]
    assert "стоимость процедур и организация финансово-хозяйственной деятельности" in text
    assert "одно- и двухсторонних сделок в общества проект." in text
    assert text.startswith("# УСТАВ ООО «Проба»\n\n1.1. ") and "1.2. Проект «Провало» инвестиционных сделок:" in text


def test_heads_recur_or_repeat_the_title():
    body = "Совет рассматривает вопрос.\n"
    page = ocr_repair.Page(
        f"# УСТАВ АО «Проба»\n{body}Из архива\n3\nИз архива\n{body}АО «ПРОБА»\n{body}АО «Проба» — редакция 2010 года\n{body}АО «Проба» вправе\n{body}".split("\n")
    )
    ocr_repair.find_furniture(page, ocr_repair.STAMPS)
    assert sorted(page.furniture) == [2, 3, 4, 6, 8]


@pytest.mark.parametrize("hot", [True, False])
@pytest.mark.parametrize(
    ("read", "want", "found"),
    [
        ("Вопрос директо ров общества.", "Вопрос директоров общества.", []),
        ("общее собра ние акционеров", "общее собрание акционеров", []),
        ("Вопрос двух сторон них сделок.", "Вопрос двухсторонних сделок.", []),
        ("Проект инвести циопных сделок.", "Проект инвестиционных сделок.", [(0, "glyph")]),
        ("Совет и директо\nров общества", "Совет и директоров общества", []),
        ("Совет и дирек-\nтор0в общества", "Совет и директоров общества", [(0, "hyphen"), (1, "glyph")]),
        ("финан-\nсово-хозяйственной", "финансово-хозяйственной", [(0, "hyphen")]),
        ("финансово-хозяй-\nственной", "финансово-хозяйственной", [(0, "hyphen")]),
        ("финансово-\nхозяйствепной", "финансово-хозяйственной", [(0, "hyphen"), (1, "glyph")]),
        ("советдиректоров общества", "совет директоров общества", []),
        ("Проект иивестициопиых сделок", "Проект инвестиционных сделок", [(0, "glyph")]),
        ("СОВЕТ ДИРЕКТО РОВ", "СОВЕТ ДИРЕКТОРОВ", []),
        ("вопрос директо Ров", "вопрос директо Ров", []),
        ("вопрос директо, ров", "вопрос директо, ров", []),
        ("вопрос «Директо ров»", "вопрос «Директо ров»", []),
        ("общества «Пр0ект» пр0ект", "общества «Пр0ект» проект", [(0, "glyph")]),
        ("вопрос абракадабра общества", "вопрос абракадабра общества", []),
    ],
)
def test_joint_decoding(read, want, found, hot):
    assert repair(read, hot) == (want, found)


@pytest.mark.parametrize("hot", [0, 3, 50_000])
def test_repair_of_documents(spark, hot):
    clean = spark.createDataFrame([(" ".join(WORDS) + " финансово-хозяйственной",)] * 5, "md string")
    rows = [(1, SCAN), (2, None), (3, ""), (4, "\n\n"), (1, SCAN), (5, "с0вет " * 20_000), (None, "советдиректоров")]
    scans = spark.createDataFrame(rows, "k int, md string").withColumn("found", F.lit(0)).withColumn("t", F.lit("x"))
    got = {r.k: r for r in ocr_repair.repair_documents(scans, "k", "md", clean, "md", hot_words=hot).collect()}
    assert got[2].repaired is None and got[2].found == [] and got[3].repaired == "" and got[4].repaired == ""
    text, found = repair(SCAN, True)
    assert got[1].repaired == text and [(f.line_no, f.kind) for f in got[1].found] == found
    assert got[5].repaired.split() == ["совет"] * 20_000 and got[None].repaired == "совет директоров"
    if not hot:
        none = ocr_repair.repair_documents(scans, "k", "md", clean.where("false"), "md").collect()
        assert len(none) == len(rows)
        assert ocr_repair.repair_documents(scans.where("false"), "k", "md", clean, "md").count() == 0


def test_a_word_of_two_texts_is_no_vocabulary(spark):
    clean = spark.createDataFrame([("совет директоров",)] * 2 + [("совет директоров кворум",)] * 2, "md string")
    scans = spark.createDataFrame([(1, "с0вет кв0рум")], "k int, md string")
    assert ocr_repair.repair_documents(scans, "k", "md", clean, "md").first().repaired == "совет кв0рум"


@pytest.mark.parametrize(
    ("word", "first"),
    [("cовет", "совет"), ("Οбщества", "Общества"), ("WebDАV", "WebDAV"), ("ЕRР", "ERP"), ("Hаблюдатeльный", "Наблюдательный")],
)
def test_readings(word, first):
    assert lookalikes.readings(word)[0] == first


def test_a_substitution_needs_a_witness(spark):
    rows = [(1, "pухo и cовет"), (2, "совет"), (3, "Τуреан"), (4, "ΑΒΟ"), (5, "ΑΒΟвет"), (6, "Ѕовет совет")]
    df = spark.createDataFrame(rows, "k int, t string")
    got = {r.k: r.consistent for r in lookalikes.consistent_texts(df, "k", "t").where("value <> consistent").collect()}
    assert got == {1: "pухo и совет"}


def test_words_without_another_reading():
    assert [lookalikes.readings(w) for w in ("совет", "SWIFT", "α", "C", "Яndex")] == [[]] * 5


@pytest.mark.parametrize(
    ("value", "form"),
    [("８．2", "8.2"), ("𝟖.𝟔", "8.6"), ("7​.2", "7.2"), ("\xa08.1", "8.1"), ("4.З", "4.3"), ("l7.2", "17.2"), ("2․1", "2.1"), ("", ""), ("б/н", "б/н")],
)
def test_numbers(value, form):
    assert lookalikes.plain_number(value) == form


def test_consistent_texts(spark):
    nfd = unicodedata.normalize("NFD", "передаётся")
    rows = [
        (1, "1.1. Совет директоров передаётся № § ² ½ ° … «а» — 🔒 α 𐍈 IT"),
        (2, f"1.2. Вопрос {nfd}"),
        (3, "1.3. Cовет диpекторов"),
        (4, "l.4. Вопрос, часть　вторая"),
        (5, None),
        (6, ""),
        (7, "1.7. планово‑эко​номический"),
        (3, "1.3. Cовет диpекторов"),
    ]
    df = spark.createDataFrame(rows, "k int, t string").withColumn("value", F.lit("x"))
    got = {r.k: r.consistent for r in lookalikes.consistent_texts(df, "k", "t").where("value <> consistent").collect()}
    assert got == {
        2: "1.2. Вопрос передаётся",
        3: "1.3. Совет директоров",
        4: "1.4. Вопрос, часть вторая",
        7: "1.7. планово-экономический",
    }
    assert lookalikes.consistent_texts(df.where("false"), "k", "t").count() == 0


BODIES = [(1, "Общее собрание участников", "supreme"), (2, "Совет директоров", "collegial"), (3, "Генеральный директор", "sole"), (4, "Директор", "sole"), (5, "Председатель Совета директоров", "sole"), (6, "Правление", "collegial"), (7, "Съезд делегатов", "supreme")]
ENTRIES = {
    "Совет директоров": 2, "директоров Совет": 2, "Совета директоров": 2, "Сoвeт диpeктоpoв": 2, "Соет дирекотров": 2, "Sovet direktorov": 2,
    "С.Д.": 2, "Сов. дир-ров": 2, "Советдиректоров": 2, "п. 7.2. «совет директоров» (по уставу)": 2, "ОСУ": 1, "О. собр. уч-ков": 1,
    "Гендир": 3, "Ген. директор": 3, "директор ;": 4, "Председатель Совета дир.": 5, "Секретарь Совета директоров": None,
    "Заместитель Генерального директора": None, "Советник Правления": None, "Правления": 6, "нет данных": None, "—": None,
    "Комитет по аудиту Совета директоров": None, "Совет директоров АО «Мир»": 2,
}


def test_mapping(spark):
    reference = spark.createDataFrame([*BODIES, (9, None, "x")], "id int, name string, kind string")
    values = spark.createDataFrame([(v, "collegial") for v in [*ENTRIES, None, " ", "Совет директоров"]], "v string, kind string")
    found = canon.map_to_reference(values, "v", reference, "id", "name", BODY_RULES, "kind", "kind").collect()
    assert len(found) == len(ENTRIES)
    assert {r.v: r.id for r in found} == ENTRIES
    empty = canon.map_to_reference(values, "v", reference.where("false"), "id", "name")
    assert all(r.id is None for r in empty.collect())
    assert canon.map_to_reference(values.where("false"), "v", reference, "id", "name").count() == 0


def test_distance_counts_transpositions():
    assert canon.distance("совет", "своет") == 1 and canon.distance("", "аб") == 2


LETTERS = st.text("абв", min_size=1, max_size=9)


@settings(max_examples=300, deadline=None)
@given(LETTERS, st.lists(st.tuples(st.integers(0, 9), st.sampled_from(["", "а", "г"])), max_size=2))
def test_tokens_at_two_edits_share_a_key(token, edits):
    other = token
    for at, letter in edits:
        other = other[:at] + letter + other[at + 1 :]
    if min(len(token), len(other)) > 4:
        assert set(canon.keys_of(token)) & set(canon.keys_of(other))


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, min_size=2, max_size=4), st.data())
def test_abbreviations_share_a_key(words, data):
    short = "".join(w[: data.draw(st.integers(1, len(w)))] for w in words)
    assert canon.spells(short, tuple(words)) is not None
    assert set(canon.short_requests(short)) & set(canon.short_keys(tuple(words)))


def test_soft_tf_idf_by_its_definition():
    names = ["общее собрание", "совет директоров", "совет ревизоров", "собрание директоров"]
    book = canon.Reference([(k, "", n) for k, n in enumerate(names)], canon.Rules(entry_similarity=0.5))
    idf = {w: math.log1p(4 / sum(w in n.split() for n in names)) for n in names for w in n.split()}
    typed = {"советы": [("совет", 0.9)], "директоров": [("директоров", 1.0)], "и": []}
    size = math.sqrt(idf["совет"] ** 2 + idf["директоров"] ** 2 + math.log1p(4) ** 2)
    want = (0.9 * idf["совет"] ** 2 + idf["директоров"] ** 2) / size / math.hypot(idf["совет"], idf["директоров"])
    assert book.best(typed, "") == (1, round(want, 6))


def test_a_long_list_is_not_scanned(spark):
    """Values that name nothing meet only entries that share a key."""
    syllables = ["ба", "во", "ги", "ду", "же", "зу", "ки", "ло", "му", "не"]
    words = [a + b + c + d for a in syllables for b in syllables for c in syllables for d in syllables[:4]]
    listed = spark.createDataFrame([(k, f"{w} {words[-k]}") for k, w in enumerate(words, 1)], "id int, name string")
    values = spark.createDataFrame([(f"чужой {w} совет",) for w in words[:500]] + [(f"{words[7][:-1]} {words[-8]}",)], "v string")
    found = {r.v: r.id for r in canon.map_to_reference(values, "v", listed, "id", "name").collect()}
    assert len(found) == 501 and [v for v, k in found.items() if k] == [f"{words[7][:-1]} {words[-8]}"]
