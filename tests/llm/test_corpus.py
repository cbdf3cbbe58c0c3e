import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexgrain.llm import neardup, subjects

HOW = neardup.NearDuplicates(words=3, threshold=0.65, least_words=5, weighted=False)


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(5)
    errors = []
    for most in (1, 3, 30):
        for _ in range(30):
            items = rng.integers(1, 2**63, 60, dtype=np.uint64)
            a, b = rng.integers(0, most + 1, 60), rng.integers(0, most + 1, 60)
            truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
            rec = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
            s = neardup.signatures(rec, np.r_[items[a > 0], items[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 512)
            # in units of the deviation that independent components have
            errors.append(((s[0] == s[1]).mean() - truth) / (truth * (1 - truth) / 512) ** 0.5)
    assert abs(np.mean(errors)) < 0.35 and 0.8 < np.std(errors) < 1.2


def texts_with_edits(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"слово{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [rng.choice(words) for _ in range(rng.randint(15, 60))]
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out


def pairs_by_hand(texts, words, threshold, least):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= least else set())
    return {
        (i, j)
        for i in range(len(sets))
        for j in range(i + 1, len(sets))
        if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold
    }


@pytest.mark.parametrize("block", [256, 3])
def test_pairs_against_brute_force(spark, block):
    texts = [*texts_with_edits(), None, "", "коротко", *[" ".join(f"общий{i}" for i in range(30))] * 8]
    texts += [" ".join(f"общий{i}" for i in range(30)) + f" хвост{k}" for k in range(9)]
    how = neardup.NearDuplicates(words=3, threshold=0.65, least_words=5, weighted=False, block=block)
    rows = list(enumerate(texts))
    df = spark.createDataFrame([*rows, rows[0], rows[-1]], "k long, t string").withColumn("key", F.lit("x"))
    links = neardup.link(neardup.prepare(df, "k", "t", how), how)
    got = sorted((r.key_a, r.key_b) for r in neardup.pairs(links).collect())
    assert len(got) == len(set(got)) and set(got) == pairs_by_hand(texts, 3, 0.65, 5)
    found = neardup.classes(links).collect()
    assert len(found) == len({r.key for r in found}) == sum(len((t or "").split()) >= 5 for t in texts)
    label = {r.key: r.class_id for r in found}
    assert all(label[a] == label[b] for a, b in got)
    assert all(v <= k for k, v in label.items())


def test_bags_count_repeats(spark):
    how = neardup.NearDuplicates(words=1, threshold=0.5, rows=1, bands=96)
    df = spark.createDataFrame([(1, "а а а а б"), (2, "а а б в"), (3, "г")], "k long, t string")
    links = neardup.link(neardup.prepare(df, "k", "t", how), how).links.collect()
    assert [(r.key_a, r.key_b, round(r.similarity, 6)) for r in links] == [(1, 2, 0.5)]


def test_no_records(spark):
    df = spark.createDataFrame([], "k long, t string")
    links = neardup.link(neardup.prepare(df, "k", "t", HOW), HOW)
    assert neardup.pairs(links).count() == 0 and neardup.classes(links).count() == 0


@pytest.mark.parametrize("deviations", [4.0, None])
def test_classes_of_short_and_empty_texts(spark, deviations):
    rows = [(1, "да нет"), (2, "Да, нет!"), (3, None), (4, ""), (5, None), (6, "нет да"), (7, "а б в г д е"), (8, "а б в г д е"), (5, None)]
    df = spark.createDataFrame(rows, "k long, t string")
    how = neardup.NearDuplicates(deviations=deviations)
    found = neardup.classes(neardup.link(neardup.prepare(df, "k", "t", how), how)).collect()
    assert sorted((r.key, r.class_id, r.n_links) for r in found) == [
        (1, 1, 0), (2, 1, 0), (3, 3, 0), (4, 4, 0), (5, 5, 0), (6, 6, 0), (7, 7, 0), (8, 7, 0),
    ]


TOPICS = {1: ("кассационная жалоба", "истец подал иск"), 2: ("облигационный выпуск", "ставка купона"), 3: ("урожай пшеницы", "коровы на пастбище")}
FRAME = ("Совет принял решение по вопросу номер {}.", "Отчёт за год {} утверждён.", "Члены правления голосовали {} раз.")


def labelled_corpus(n, seed):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        own = rng.sample(sorted(TOPICS), rng.choice([0, 1, 1, 2]))
        parts = [rng.choice(FRAME).format(rng.randint(1, 99)) for _ in range(4)]
        parts += [f"Основная тема раздела: {rng.choice(TOPICS[t])}." for t in own for _ in range(2)]
        if rng.random() < 0.4:
            other = rng.choice([t for t in TOPICS if t not in own])
            parts.append(f"Кстати, тема «{rng.choice(TOPICS[other])}» к повестке не относится.")
        rng.shuffle(parts)
        docs.append((i, " ".join(parts)))
        labels += [(i, t) for t in own] or [(i, None)]
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = labelled_corpus(400, 7)
    table = spark.createDataFrame([*docs, (9001, None), (9002, ""), (9003, "1 2 3")], "doc_id long, text string").withColumn("logits", F.lit(0))
    known = spark.createDataFrame([x for x in labels if x[0] < 300] + [(0, labels[0][1])], "doc_id long, subject_id long")
    how = subjects.Settings(partitions=2, steps=30)
    trained = subjects.train(table, known, "doc_id", "text", "subject_id", [1, 2, 3], how)
    got = {r.doc_id: r for r in subjects.score(table, "doc_id", "text", trained, [1, 2, 3]).collect()}
    assert got[9001].subject_ids == got[9002].subject_ids == got[9003].subject_ids == [] and got[9001].logits is None
    truth = {i: {t for d, t in labels if d == i and t} for i in range(300, 400)}
    said = {i: set(got[i].subject_ids) for i in truth}
    right = sum(len(said[i] & truth[i]) for i in truth)
    assert right / sum(map(len, said.values())) > 0.9 and right / sum(map(len, truth.values())) > 0.9


def test_without_labels_nothing_is_said(spark):
    docs, _ = labelled_corpus(5, 1)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, subject_id long")
    trained = subjects.train(table, none, "doc_id", "text", "subject_id", [1, 2, 3])
    assert all(r.subject_ids == [] for r in subjects.score(table, "doc_id", "text", trained, [1, 2, 3]).collect())


def test_gradient_against_differences():
    how = subjects.Settings(dim=4, buckets=8)
    model = subjects.Model(["суд", "иск"], 2, how)
    docs = [(subjects.sentences("Суд принял иск. Отчёт готов."), [0]), (subjects.sentences("Иск."), [])]
    shard = subjects.Shard.of(model, docs)
    state = [x.astype(np.float64) for x in model.state()]

    def loss(st):
        # the weights of the soft maximum are taken as given
        vectors, output, bias = st
        logits = shard.sentence_means(vectors) @ output + bias
        score = np.add.reduceat(weight * logits, shard.doc_starts)
        return np.logaddexp(0, score).sum() - (score * shard.truth).sum()

    logits = shard.sentence_means(state[0]) @ state[1] + state[2]
    weight = np.exp(2.0 * (logits - np.maximum.reduceat(logits, shard.doc_starts)[shard.doc_of]))
    weight /= np.add.reduceat(weight, shard.doc_starts)[shard.doc_of]
    grads = shard.gradient(state, 2.0)
    for array, grad in zip(state, grads):
        for at in list(np.ndindex(array.shape))[::7]:
            keep = array[at]
            array[at] = keep + 1e-5
            up = loss(state)
            array[at] = keep - 1e-5
            down = loss(state)
            array[at] = keep
            assert grad[at] == pytest.approx((up - down) / 2e-5, abs=1e-3)
