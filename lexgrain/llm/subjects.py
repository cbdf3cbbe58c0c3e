"""Subject areas of documents by averaged word and subword embeddings.

A sentence is the average of its words' vectors, a word the average of its own
and its subwords' vectors; each subject has an independent logistic output on
sentences.  A document's score for a subject is the soft maximum over its
sentences, which is also how training reaches the sentences behind a document's
labels.  Training is data-parallel: each partition of the labelled sample works
out the gradient of its documents, and the gradients are summed every step, in groups on
the executors and then on the driver, which takes the step.
"""

from __future__ import annotations

import io
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrain.runtime import materialise

#: A word of two letters or more, or what ends a sentence.
_TOKEN = re.compile(r"[^\W\d_]{2,}|[.!?…]+(?=\s|$)|[\n\r]+")


@dataclass(frozen=True)
class Settings:
    """Parameters of the model and its training."""

    dim: int = 16
    buckets: int = 1 << 14
    #: Labelled documents used for fitting: those with the smallest hash of the id.
    sample: int = 5000
    #: Words in at least so many documents of the sample get a vector of their own; others
    #: are read by their subwords alone.
    least_documents: int = 2
    #: Partitions of the sample; None: as many as the cluster has cores, of at least 100 documents.
    partitions: int | None = None
    steps: int = 24
    rate: float = 0.08
    #: Of the soft maximum over sentences, at the first and the last step.
    sharpness: tuple[float, float] = (1.0, 6.0)
    #: Logits tried as the decision threshold on a held-out tenth of the sample.
    thresholds: tuple[float, ...] = (-1.5, -1.25, -1.0, -0.75, -0.5, -0.25, 0.0)


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of the character 4- and 5-grams of a word with its ends marked."""
    marked = f"<{word}>"
    grams = {marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1)}
    return sorted(xxhash.xxh32_intdigest(g) % buckets for g in grams)


def sentences(text: str) -> list[list[str]]:
    """Lower-case words of each sentence or line that has any."""
    out: list[list[str]] = [[]]
    for token in _TOKEN.findall(text.lower()):
        if token[0].isalpha():
            out[-1].append(token)
        elif out[-1]:
            out.append([])
    return [s for s in out if s]


class Model:
    """Embeddings and outputs; a plain holder of arrays that travels by broadcast."""

    def __init__(self, words: list[str], classes: int, how: Settings, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.how, self.words = how, {w: i for i, w in enumerate(words)}
        rows = len(words) + how.buckets
        self.vectors = rng.normal(0, 0.3, (rows, how.dim)).astype(np.float32)
        self.output = rng.normal(0, 0.3, (how.dim, classes)).astype(np.float32)
        self.bias = np.full(classes, -2.0, np.float32)

    def features(self, word: str) -> list[int]:
        """Rows of ``vectors`` that a word averages."""
        own = self.words.get(word)
        base = len(self.words)
        rows = [base + b for b in subwords(word, self.how.buckets)]
        # a known word's own vector counts as much as its subwords together
        return ([own] * max(1, len(rows)) + rows) if own is not None else rows

    def state(self) -> list[np.ndarray]:
        return [self.vectors, self.output, self.bias]


class Shard:
    """Documents of one partition as arrays, ready for gradient steps."""

    NAMES = ("ids", "lengths", "docs", "feat", "sizes", "truth")

    def __init__(self, **arrays: np.ndarray):
        for name in self.NAMES:
            setattr(self, name, arrays[name])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.doc_starts = np.cumsum(self.docs) - self.docs
        self.doc_of = np.repeat(np.arange(len(self.docs)), self.docs)
        self.feat_starts = np.cumsum(self.sizes) - self.sizes
        self.by_word = _Grouped(self.ids, np.repeat(np.arange(len(self.lengths)), self.lengths))
        self.by_row = _Grouped(self.feat, np.repeat(np.arange(len(self.sizes)), self.sizes))

    @classmethod
    def of(cls, model: Model, docs: list[tuple[list[list[str]], list[int]]]) -> Shard:
        """``docs``: sentences and labels (class numbers) of each document."""
        index: dict[str, int] = {}
        ids: list[int] = []
        lengths, counts = [], []
        truth = np.zeros((len(docs), len(model.bias)), np.float32)
        for d, (parts, labels) in enumerate(docs):
            for s in parts:
                ids.extend(index.setdefault(w, len(index)) for w in s)
                lengths.append(len(s))
            counts.append(len(parts))
            truth[d, labels] = 1
        feats = [model.features(w) for w in index]
        return cls(
            ids=np.array(ids, np.int32),
            lengths=np.array(lengths, np.int32),
            docs=np.array(counts, np.int32),
            feat=np.array([x for f in feats for x in f], np.int32),
            sizes=np.array([len(f) for f in feats], np.int32),
            truth=truth,
        )

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in self.NAMES})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as arrays:
            return cls(**{name: arrays[name] for name in cls.NAMES})

    def sentence_means(self, vectors: np.ndarray) -> np.ndarray:
        words = np.add.reduceat(vectors[self.feat], self.feat_starts) / self.sizes[:, None].astype(np.float32)
        return np.add.reduceat(words[self.ids], self.starts) / self.lengths[:, None].astype(np.float32)

    def best(self, state: list[np.ndarray]) -> np.ndarray:
        """Largest logit of each document and class over its sentences."""
        vectors, output, bias = state
        return np.maximum.reduceat(self.sentence_means(vectors) @ output + bias, self.doc_starts)

    def gradient(self, state: list[np.ndarray], sharp: float) -> list[np.ndarray]:
        """Gradient of the summed log loss of this shard's documents."""
        vectors, output, bias = state
        means = self.sentence_means(vectors)
        logits = means @ output + bias
        top = np.maximum.reduceat(logits, self.doc_starts)
        weight = np.exp(sharp * (logits - top[self.doc_of]))
        weight /= np.add.reduceat(weight, self.doc_starts)[self.doc_of]
        score = np.add.reduceat(weight * logits, self.doc_starts)
        error = 1 / (1 + np.exp(-score)) - self.truth
        # soft maximum: weights are taken as given, as in expectation maximisation
        by_sentence = error[self.doc_of] * weight
        g_means = (by_sentence @ output.T) / self.lengths[:, None].astype(np.float32)
        g_words = self.by_word.sums(g_means, len(self.sizes)) / self.sizes[:, None].astype(np.float32)
        g_vectors = self.by_row.sums(g_words, len(vectors))
        return [g_vectors, means.T @ by_sentence, by_sentence.sum(axis=0)]


class _Grouped:
    """Sums of source rows by target, with the order worked out once."""

    def __init__(self, target: np.ndarray, source: np.ndarray):
        order = np.argsort(target, kind="stable")
        self.source = source[order]
        ranked = target[order]
        self.starts = np.flatnonzero(np.diff(ranked, prepend=-1))
        self.targets = ranked[self.starts]

    def sums(self, values: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, values.shape[1]), np.float32)
        if len(self.starts):
            out[self.targets] = np.add.reduceat(values[self.source], self.starts)
        return out


class Adam:
    """Step sizes by running moments of the gradient."""

    def __init__(self, state: list[np.ndarray], rate: float):
        self.rate, self.n = rate, 0
        self.m = [np.zeros_like(s) for s in state]
        self.v = [np.zeros_like(s) for s in state]

    def step(self, state: list[np.ndarray], grad: list[np.ndarray]) -> None:
        self.n += 1
        for s, g, m, v in zip(state, grad, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            s -= self.rate * (m / (1 - 0.9**self.n)) / (np.sqrt(v / (1 - 0.999**self.n)) + 1e-8)


_SHARDS: dict[str, Shard] = {}


def _shard(data: bytes) -> Shard:
    """Shard of this worker process; unpacked once, again wherever it runs next."""
    key = xxhash.xxh64_hexdigest(data)
    if key not in _SHARDS:
        if len(_SHARDS) >= 8:
            _SHARDS.clear()
        _SHARDS[key] = Shard.unpacked(data)
    return _SHARDS[key]


@F.arrow_udf(T.ArrayType(T.StringType()))
def _words(texts: pa.Array) -> pa.Array:
    return pa.array(
        [sorted({w for s in sentences(t or "") for w in s}) for t in texts.to_pylist()], pa.list_(pa.string())
    )


@dataclass(frozen=True)
class Trained:
    """Model, threshold and the held-out figures it was chosen by."""

    model: Model
    threshold: float
    precision: float
    recall: float


def train(
    documents: DataFrame,
    labels: DataFrame,
    key: str,
    text: str,
    subject: str,
    subjects: list[int],
    how: Settings = Settings(),
) -> Trained:
    """Fit the model on a bounded sample of labelled documents.

    Labels that are null or not in ``subjects`` say that the document has none
    of them; repeated labels count once.  Documents without a word are left out.
    Without any labelled document the model scores everything below its threshold.
    """
    spark = documents.sparkSession
    number = F.create_map(*[F.lit(x) for i, s in enumerate(subjects) for x in (int(s), i)])
    known = labels.groupBy(key).agg(F.collect_set(F.element_at(number, F.col(subject).cast("int"))).alias("_l"))
    # ids first, and of these only about as many as are wanted: no task sees more
    n = known.count()
    share = min(1.0, (1.5 * how.sample + 100) / max(n, 1))
    place = F.xxhash64(F.lit("sample"), key)
    wanted = (
        known.withColumn("_r", place)
        .where(F.col("_r") <= F.lit(min(2**63 - 1, int(share * 2**64) - 2**63)))
        .orderBy("_r", key)
        .limit(how.sample)
    )
    parts = how.partitions or max(1, min(spark.sparkContext.defaultParallelism, min(n, how.sample) // 100))
    # a tenth is held out, as partition -1, whatever the number of the others
    held_out = F.pmod(F.xxhash64(F.lit("held"), key), F.lit(10)) == 0
    wanted = wanted.withColumn("_p", F.when(held_out, -1).otherwise(F.pmod(F.xxhash64(F.lit("part"), key), F.lit(parts))).cast("int"))
    has_word = F.col("_t").rlike(r"\p{L}")
    # at most ``sample`` ids
    sampled = documents.select(key, F.col(text).alias("_t")).join(F.broadcast(wanted), key).where(has_word)
    sample = materialise(sampled.select("_t", "_l", "_p"))
    counted = sample.where("_p >= 0").select(F.explode(_words("_t")).alias("w")).groupBy("w").count()
    # as many as the sample has, which is bounded
    top = counted.where(F.col("count") >= how.least_documents).orderBy(F.desc("count"), "w").collect()
    model = Model([r.w for r in top], len(subjects), how)
    shared = spark.sparkContext.broadcast(model)

    def pack(group: pa.Table) -> pa.Table:
        docs = [
            (sentences(t), labels)
            for t, labels in zip(group.column("_t").to_pylist(), group.column("_l").to_pylist())
        ]
        data = Shard.of(shared.value, [d for d in docs if d[0]]).packed()
        return pa.table({"p": group.column("_p").slice(0, 1), "data": pa.array([data], pa.binary())})

    shards = materialise(sample.groupBy("_p").applyInArrow(pack, "p int, data binary").repartition(parts, "p"))
    state = model.state()
    moments = Adam(state, how.rate)
    n = max(1, sample.where("_p >= 0").count())
    training = shards.where("p >= 0")
    for step in range(how.steps):
        sharp = how.sharpness[0] + (how.sharpness[1] - how.sharpness[0]) * step / how.steps
        found = _each(spark, training, state, lambda shard, st, sharp=sharp: shard.gradient(st, sharp), math.isqrt(parts))
        if not found:
            break
        moments.step(state, [sum(g) / np.float32(n) for g in zip(*found)])
    held = _each(spark, shards.where("p < 0"), state, lambda shard, st: [shard.best(st), shard.truth])
    options = [(0.0, how.thresholds[0], 0.0, 0.0)]
    for scores, truth in held:
        for at in how.thresholds:
            said = scores > at
            right = float((said & (truth > 0)).sum())
            precision, recall = right / max(1.0, said.sum()), right / max(1.0, truth.sum())
            f1 = 2 * precision * recall / max(1e-9, precision + recall)
            options.append((round(f1, 6), at, precision, recall))
    _, at, precision, recall = max(options)
    if not top:
        model.bias[:] = -1e6
    return Trained(model, at, precision, recall)


def _bytes(arrays: list[np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return out.getvalue()


def _arrays(data: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(data)) as found:
        return [found[name] for name in found.files]


def _summed(group: pa.Table) -> pa.Table:
    """One row with the sums of a group's arrays, in the order of their partitions."""
    total = None
    for data in group.sort_by("p").column("out").to_pylist():
        arrays = _arrays(data)
        total = arrays if total is None else [a + b for a, b in zip(total, arrays)]
    return pa.table({"p": pa.array([group.column("p")[0].as_py()], pa.int32()), "out": pa.array([_bytes(total)], pa.binary())})


def _each(spark, shards: DataFrame, state: list[np.ndarray], work, sums: int = 0) -> list[list[np.ndarray]]:
    """``work(shard, state)`` of every shard, in the order of their numbers; with ``sums``, the
    sums of so many groups of shards, made on the executors."""
    current = spark.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_bytes(work(_shard(data), current.value)) for data in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["p", "out"])

    done = shards.mapInArrow(run, "p int, out binary")
    if sums > 1:
        done = done.groupBy(F.pmod("p", F.lit(sums))).applyInArrow(_summed, "p int, out binary")
    rows = sorted(done.collect(), key=lambda r: r.p)
    current.destroy()
    return [_arrays(row.out) for row in rows]


_MEMO_WORDS = 500_000


class Scorer:
    """Logits of documents; the vectors of words are projected to the outputs once."""

    def __init__(self, trained: Trained):
        model = trained.model
        self.model = model
        self.projected = model.vectors @ model.output
        self.bias = model.bias
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {"\n": -1}
        self.table = np.zeros((1024, len(self.bias)), np.float32)
        self.size = 0

    def _add(self, token: str) -> int:
        if not token[0].isalpha():
            return -1
        rows = self.model.features(token)
        if self.size == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        if rows:
            self.table[self.size] = self.projected[rows].mean(axis=0)
        self.index[token] = self.size
        self.size += 1
        return self.size - 1

    def best(self, text: str | None) -> np.ndarray | None:
        """Largest logit of each class over the sentences; None without a word."""
        if not text:
            return None
        if self.size >= _MEMO_WORDS:
            self._clear()
        get, add = self.index.get, self._add
        ids = np.array([i if (i := get(t)) is not None else add(t) for t in _TOKEN.findall(text.lower())], np.int64)
        word = ids >= 0
        if not word.any():
            return None
        sentence = np.cumsum(~word)[word]
        starts = np.flatnonzero(np.diff(sentence, prepend=-1))
        sums = np.add.reduceat(self.table[ids[word]], starts)
        counts = np.diff(np.append(starts, len(sentence))).astype(np.float32)
        return (sums / counts[:, None]).max(axis=0) + self.bias


_SCORERS: dict[int, Scorer] = {}


def score(documents: DataFrame, key: str, text: str, trained: Trained, subjects: list[int]) -> DataFrame:
    """``key``, ``subject_ids`` (ascending) and ``logits`` (one for each subject) of every document.

    Texts that are null, empty or without a word have no subjects and null logits.
    Other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(trained)
    at = trained.threshold
    mark = xxhash.xxh64_intdigest(trained.model.output.tobytes())

    @F.arrow_udf("struct<subject_ids:array<bigint>,logits:array<float>>")
    def run(texts: pa.Array) -> pa.Array:
        if mark not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[mark] = Scorer(shared.value)
        scorer = _SCORERS[mark]
        ids, logits = [], []
        for t in texts.to_pylist():
            best = scorer.best(t)
            ids.append([] if best is None else [subjects[k] for k in np.flatnonzero(best > at)])
            logits.append(None if best is None else best.tolist())
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.list_(pa.int64())), pa.array(logits, pa.list_(pa.float32()))],
            names=["subject_ids", "logits"],
        )

    scored = documents.select(F.col(key), run(text).alias("_s"))
    return scored.select(key, F.col("_s.subject_ids").alias("subject_ids"), F.col("_s.logits").alias("logits"))
