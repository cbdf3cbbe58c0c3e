import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexgrain.llm import packing, prefix_bpe, splitting

VOCABULARY = prefix_bpe.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the tokenizer's file isn't here")


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as f:
        return prefix_bpe.PrefixEncoder.from_file_bytes(f.read())


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(text=st.text(max_size=60))
def test_encoding_against_merges_and_round_trip(encoder, text):
    tiktoken = pytest.importorskip("tiktoken")
    if not hasattr(encoder, "peer"):
        encoder.peer = tiktoken.Encoding("own", pat_str=prefix_bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})
    ids = encoder.encode(text)
    assert ids == encoder.peer.encode_ordinary(text)
    assert encoder.decode(ids) == text


@needs_vocabulary
def test_appends_and_edits(encoder):
    rng = random.Random(3)
    for _ in range(300):
        old = "".join(rng.choice("abсдe ю1𐍈") for _ in range(rng.randint(0, 40))).encode()
        table = encoder.prefixes(old)
        assert encoder.walk(table) == encoder.merged(old)
        more = old + "ещё".encode()
        assert encoder.prefixes(more, table) == encoder.prefixes(more)
        a = rng.randint(0, len(old))
        b = rng.randint(a, len(old))
        data, edited = encoder.edited(old, table, a, b, b"xy"[: rng.randint(0, 2)])
        assert edited == encoder.prefixes(data)


@needs_vocabulary
def test_edit_of_a_long_text_keeps_the_tail(encoder):
    old = ("слово и дело " * 200).encode()
    data, edited = encoder.edited(old, encoder.prefixes(old), 40, 44, b"zz")
    assert edited == encoder.prefixes(data)


@needs_vocabulary
def test_token_columns(spark):
    texts = [None, "", " ", "Совет директоров", "<|endoftext|>", "слово " * 30_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("ids", F.lit(1))
    got = df.select("doc_id", prefix_bpe.token_ids(spark, "text").alias("ids"), prefix_bpe.token_count(spark, "text").alias("n")).orderBy("doc_id").collect()
    assert got[0].ids == got[1].ids == [] and [len(r.ids) for r in got] == [r.n for r in got]
    assert max(got[4].ids) < 50256
    empty = df.where("false").select(prefix_bpe.token_ids(spark, "text").alias("ids"))
    assert empty.count() == 0


def strongest_by_hand(strengths, low, high):
    best = max(strengths[low:high], default=None)
    return -1 if best is None else max(i for i in range(low, high) if strengths[i] == best)


def test_range_maximum_against_a_loop():
    rng = random.Random(1)
    strengths = [rng.randint(1, 6) for _ in range(57)]
    table = splitting.RangeMaximum(np.array(strengths))
    for low in range(58):
        for high in range(low, 58):
            assert table.strongest(low, high) == strongest_by_hand(strengths, low, high)


@settings(max_examples=300, deadline=None)
@given(
    text=st.text(alphabet="аб. ,;\ńé🔒‍", max_size=400),
    limit=st.integers(8, 60),
    overlap=st.integers(0, 7),
)
def test_pieces_cover_within_the_limit(text, limit, overlap):
    spans = splitting.split_spans(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(0 <= b - a <= limit for a, b in spans)
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert a < c <= b < d and b - c <= overlap


def test_pieces_end_at_the_strongest_boundary():
    text = "Первое предложение тут. Второе, с запятой, здесь.\n\nНовый абзац идёт дальше и дальше без конца"
    spans = splitting.split_spans(text, 60, 0)
    assert text[: spans[0][1]].endswith("здесь.\n\n")
    text = "а" * 198 + ".\n\n" + "слово " * 400
    assert splitting.split_spans(text, 1500, 150)[0] == (0, 201)
    assert splitting.split_spans(text, 1500, 150, least=0.5)[0] == (0, 1497)
    assert splitting.split_spans("x" * 25, 10, 3) == [(0, 10), (7, 17), (14, 24), (21, 25)]


def test_split_oversized_cases(spark):
    rows = [(1, None, 0, 50), (2, "", 0, 0), (3, "слово " * 10, 0, 60), (4, "a" * 12, 0, 12), (4, "a" * 12, 0, 12), (None, "б " * 20, 0, 40), (5, "коротко", 0, 40)]
    df = spark.createDataFrame(rows, "k long, t string, a int, b int").withColumn("piece_no", F.lit(9)).withColumn("item", F.lit("x"))
    got = splitting.split_oversized(df, "k", "t", 30, 5).collect()
    assert {r.k for r in got} == {3, None} and all(r.span_end - r.span_start <= 30 for r in got)
    spans = splitting.split_oversized(df, "k", "t", 30, 5, "a", "b").collect()
    assert {r.k for r in spans} == {1, 3, 5, None}
    assert all(r.piece is None for r in spans if r.k == 1)
    assert splitting.split_oversized(df.where("false"), "k", "t", 30).count() == 0
    with pytest.raises(ValueError):
        splitting.split_spans("x" * 9, 5, 5)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 200), max_size=20))
def test_packing_places_every_item_once(histogram):
    patterns = packing.pack_histogram(histogram, 32)
    placed = {}
    for p in patterns:
        assert sum(length * times for length, times in p.content) <= 32 and p.count > 0
        for length, times in p.content:
            placed[length] = placed.get(length, 0) + times * p.count
    assert placed == histogram


def test_packing_leaves_little_room():
    rng = np.random.default_rng(2)
    lengths = np.minimum(rng.geometric(0.004, 20_000), 2048)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    patterns = packing.pack_histogram(histogram, 2048)
    assert lengths.sum() / (2048 * sum(p.count for p in patterns)) > 0.99


def test_pack(spark):
    sizes = [None, 0, 1, 10, 11, 25, 10, 10, 3, 7, 5] + [4] * 40
    df = spark.createDataFrame(list(enumerate(sizes)), "doc int, n int").withColumn("container_id", F.lit(0))
    got = packing.pack(df, "doc", "n", 10).collect()
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc, []).append((r.piece_no, r.token_start, r.n_tokens))
    assert sorted(by_doc[4]) == [(0, 0, 10), (1, 10, 1)] and sorted(by_doc[5])[-1] == (2, 20, 5)
    assert sum(r.n_tokens for r in got) == sum(s or 0 for s in sizes)
    filled = {}
    for r in got:
        if r.n_tokens == 0:
            assert r.container_id is None
            continue
        filled.setdefault(r.container_id, set()).update(range(r.container_offset, r.container_offset + r.n_tokens))
    assert sum(map(len, filled.values())) == sum(s or 0 for s in sizes) and max(map(max, filled.values())) < 10
    assert packing.pack(df.where("false"), "doc", "n", 10).count() == 0
