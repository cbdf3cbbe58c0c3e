"""Near-duplicate records by BagMinHash over word shingles.

A record is a bag of shingles (runs of consecutive words) with weights.  The
weight axis is discretised into unit strips; each strip of each shingle is a
Poisson process of points in time, spread over the components of the signature,
and a component keeps its earliest point.  Strips are grouped into dyadic blocks
that are split only when the first point of the block is early enough to matter,
so that a heavy shingle costs little more than a light one.  Two components are
equal with the probability of the weighted Jaccard similarity.

Signatures are banded; records that share a band become candidates, and the
overlap of their bags decides.  Exact copies are collapsed before banding and a
bucket of many different records is compared in blocks, so that no group has to
fit into one task.
"""

from __future__ import annotations

import hashlib
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

_WORD = re.compile(r"[^\W_]+")
_MEMO_WORDS = 200_000
_U = np.uint64


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters; with rows * bands components, recall at ``threshold`` is
    ``1 - (1 - threshold ** rows) ** bands``."""

    words: int = 5
    threshold: float = 0.8
    least_words: int = 0
    rows: int = 4
    bands: int = 24
    weighted: bool = True
    #: Buckets with more records than this are compared in blocks of this size.
    block: int = 256
    #: Pairs are verified if their signatures agree at least so many standard deviations
    #: below what is expected at the threshold; None verifies all pairs that share a band.
    deviations: float | None = 4.0

    @property
    def components(self) -> int:
        return self.rows * self.bands


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x + _U(0x9E3779B97F4A7C15)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def _exponential(x: np.ndarray) -> np.ndarray:
    return -np.log(((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53)


_memo: dict[str, int] = {}


def _word_hash(word: str) -> int:
    if len(_memo) >= _MEMO_WORDS:
        _memo.clear()
    value = _memo[word] = xxhash.xxh64_intdigest(word)
    return value


def shingles(text: str, words: int) -> tuple[np.ndarray, int]:
    """Hashes of all runs of consecutive words (with repeats), and the number of words.

    A text of fewer words has one run of all its words.
    """
    found = _WORD.findall(text.lower())
    n = len(found)
    if not n:
        return np.zeros(0, _U), 0
    words = min(words, n)
    get = _memo.get
    hashes = np.fromiter((get(w) or _word_hash(w) for w in found), dtype=_U, count=n)
    with np.errstate(over="ignore"):
        run = _mix(hashes[: n - words + 1])
        for k in range(1, words):
            run = _mix(run * _U(3) + hashes[k : n - words + 1 + k])
    return run, n


def signatures(record: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """BagMinHash signatures of ``n`` records: an ``n x m`` array of point identities.

    ``record`` (0 .. n-1, non-decreasing), ``element`` (64-bit hashes, distinct
    within a record) and ``weight`` (positive integers) describe the bags.
    Records without elements get zeros.
    """
    out = np.full(n * m, np.iinfo(np.uint64).max, dtype=_U)
    # root blocks of the weight axis: [0,1), [1,2), [2,4), [4,8) ...
    top = np.zeros(len(weight), np.int64)
    heavy = weight > 1
    top[heavy] = np.floor(np.log2(weight[heavy] - 1)).astype(np.int64) + 1
    reps = top + 1
    at = np.repeat(np.arange(len(weight)), reps)
    order = np.arange(len(at)) - np.repeat(np.cumsum(reps) - reps, reps)
    low = np.where(order == 0, 0, np.left_shift(1, np.maximum(order - 1, 0)))
    size = np.where(order == 0, 1, low)
    rec, w = record[at], weight[at]
    seed = element[at]
    more = order > 0
    seed[more] = _mix(seed[more] ^ _mix(low[more].astype(_U)))
    draw = np.zeros(len(at), _U)
    time = _exponential(_mix(seed)) / (m * size)
    total = np.bincount(record, weights=weight, minlength=n)
    limit = np.where(total > 0, (np.log(m) + 3.0) / np.maximum(total, 1), 0.0)
    done = total == 0
    while not done.all():
        live = np.flatnonzero((time <= limit[rec]) & ~done[rec])
        if not len(live):
            filled = ~(out.reshape(n, m) == np.iinfo(np.uint64).max).any(axis=1)
            done |= filled
            limit[~done] *= 2.0
            continue
        leaf = size[live] == 1
        points = live[leaf]
        # earliest point of each component; the low bits hold the point's identity
        own = _mix(seed[points] + draw[points] * _U(0xD1342543DE82EF95) + _U(7))
        bits = (time[points].view(_U) & ~_U(0xFFFFF)) | (own & _U(0xFFFFF))
        component = ((own >> _U(20)) % _U(m)).astype(np.int64)
        np.minimum.at(out, rec[points] * m + component, bits)
        draw[points] += _U(1)
        step = _mix(seed[points] + draw[points] * _U(0x9E3779B97F4A7C15))
        time[points] += _exponential(step) / m
        blocks = live[~leaf]
        if len(blocks):
            # the block's first point falls into one half; the other half's comes later
            half = size[blocks] >> 1
            coin = _mix(seed[blocks] + _U(11))
            left_first = (coin & _U(1)) == 0
            later = _exponential(_mix(coin)) / (m * half) + time[blocks]
            left_time = np.where(left_first, time[blocks], later)
            right_time = np.where(left_first, later, time[blocks])
            mid = low[blocks] + half
            left_seed = _mix(seed[blocks] ^ _U(0x5851F42D4C957F2D))
            right_seed = _mix(seed[blocks] ^ _U(0x14057B7EF767814F))
            size[blocks], time[blocks], seed[blocks] = half, left_time, left_seed
            keep = mid < w[blocks]
            src = blocks[keep]
            if len(src):
                rec = np.concatenate([rec, rec[src]])
                w = np.concatenate([w, w[src]])
                low = np.concatenate([low, mid[keep]])
                size = np.concatenate([size, half[keep]])
                seed = np.concatenate([seed, right_seed[keep]])
                time = np.concatenate([time, right_time[keep]])
                draw = np.concatenate([draw, np.zeros(len(src), _U)])
        table = out.reshape(n, m)
        worst = table.max(axis=1)
        filled = worst != np.iinfo(np.uint64).max
        reach = (worst | _U(0xFFFFF)).view(np.float64)
        limit = np.where(filled, np.minimum(limit, np.where(filled, reach, np.inf)), limit)
        # points beyond the limit of a filled record can't matter any more
        gone = filled[rec] & (time > limit[rec])
        if gone.sum() * 2 > len(rec):
            stay = ~gone
            rec, w, low, size, seed, time, draw = (x[stay] for x in (rec, w, low, size, seed, time, draw))
        if not len(rec):
            done |= filled
    out[np.repeat(total == 0, m)] = 0
    return out.reshape(n, m)


_PREPARED = T.StructType(
    [
        T.StructField("key", T.LongType()),
        T.StructField("print", T.BinaryType()),
        T.StructField("signature", T.BinaryType()),
        T.StructField("bag", T.BinaryType()),
    ]
)
_BATCH_WORDS = 60_000


def prepare(records: DataFrame, key: str, text: str, how: NearDuplicates) -> DataFrame:
    """``key``, ``print`` (of the whole bag), ``signature`` and ``bag`` of each record.

    A bag is sorted 32-bit shingle hashes; the k-th repeat of a shingle counts
    as another element, so that overlaps of sets are overlaps of bags; two shingles
    of a record with the same 32 bits count as one.  Texts of fewer than ``least_words``
    words give no row; of those left, texts without a word (null ones too) have no
    signature and are like none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bags, counts, words = [], [], [], 0
            alone: list[int] = []
            for k, t in _one_by_one(batch):
                hashes, n = shingles(t, how.words) if t else (np.zeros(0, _U), 0)
                if n < how.least_words:
                    continue
                if not n:
                    alone.append(k)
                    continue
                unique, count = np.unique(hashes, return_counts=True)
                keys.append(k)
                bags.append(unique)
                counts.append(count if how.weighted else np.ones(len(unique), np.int64))
                words += n
                if words > _BATCH_WORDS:
                    yield _rows(keys, bags, counts, how)
                    keys, bags, counts, words = [], [], [], 0
            if keys:
                yield _rows(keys, bags, counts, how)
            if alone:
                prints = [b"" if k is None else k.to_bytes(8, "big", signed=True) for k in alone]
                none = pa.nulls(len(alone), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(alone, pa.int64()), pa.array(prints, pa.binary()), none, none],
                    names=["key", "print", "signature", "bag"],
                )

    return records.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(
        run, _PREPARED
    )


def _one_by_one(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch, few of them as Python strings at a time."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(part.column(0).to_pylist(), part.column(1).to_pylist())


def _rows(keys: list, bags: list, counts: list, how: NearDuplicates) -> pa.RecordBatch:
    m = how.components
    record = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    signed = signatures(record, np.concatenate(bags), np.concatenate(counts).astype(np.int64), len(bags), m)
    short = (_mix(signed) >> _U(48)).astype(np.uint16)
    prints, stored = [], []
    for bag, count in zip(bags, counts):
        if how.weighted and (count > 1).any():
            nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            repeated = np.repeat(bag, count)
            more = nth > 0
            repeated[more] = _mix(repeated[more] ^ _mix(nth[more].astype(_U)))
            bag = np.sort(repeated)
        prints.append(hashlib.blake2b(bag.tobytes(), digest_size=12).digest())
        stored.append(np.unique((bag >> _U(32)).astype(np.uint32)).tobytes())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys, pa.int64()),
            pa.array(prints, pa.binary()),
            pa.array([row.tobytes() for row in short], pa.binary()),
            pa.array(stored, pa.binary()),
        ],
        names=["key", "print", "signature", "bag"],
    )


def _bands(rows: int):
    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(signature: pa.Array) -> pa.Array:
        flat = np.frombuffer(b"".join(signature.to_pylist()), dtype=np.uint16)
        if not len(flat):
            return pa.array([[] for _ in range(len(signature))], pa.list_(pa.int64()))
        table = flat.reshape(len(signature), -1)
        count = table.shape[1] // rows
        keys = np.broadcast_to(np.arange(count, dtype=_U), (len(table), count)).copy()
        for k in range(rows):
            keys = _mix(keys ^ _mix(table[:, k::rows].astype(_U) + _U(k << 20)))
        ends = np.arange(0, len(table) * count + 1, count, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.reshape(-1).view(np.int64)))

    return run


@F.arrow_udf(T.DoubleType())
def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    out = []
    for x, y in zip(a.to_pylist(), b.to_pylist()):
        u, v = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        both = len(np.intersect1d(u, v, assume_unique=True))
        out.append(both / (len(u) + len(v) - both))
    return pa.array(out, pa.float64())


def _alike(a: np.ndarray, b: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of signatures with at least ``least`` equal components."""
    left, right = [], []
    for i in range(len(a)):
        hit = np.flatnonzero((b == a[i]).sum(axis=1) >= least)
        left.append(np.full(len(hit), i))
        right.append(hit)
    return np.concatenate(left), np.concatenate(right)


def least_equal(how: NearDuplicates) -> int:
    """Equal components that a pair needs to be verified."""
    if how.deviations is None:
        return 0
    spread = (how.threshold * (1 - how.threshold) / how.components) ** 0.5
    return max(1, int(how.components * (how.threshold - how.deviations * spread)))


@F.arrow_udf(T.IntegerType())
def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equal components of two signatures."""
    if not len(a):
        return pa.array([], pa.int32())
    x = np.frombuffer(b"".join(a.to_pylist()), np.uint16).reshape(len(a), -1)
    y = np.frombuffer(b"".join(b.to_pylist()), np.uint16).reshape(len(b), -1)
    return pa.array((x == y).sum(axis=1).astype(np.int32))


def _block_pairs(how: NearDuplicates):
    least = least_equal(how)

    def run(group: pa.Table) -> pa.Table:
        keys = np.array(group.column("key").to_pylist(), dtype=np.int64)
        side = np.array(group.column("side").to_pylist(), dtype=np.int64)
        table = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint16).reshape(len(keys), -1)
        one, two = side == 0, side == 1
        if not two.any():  # a block with itself
            two = one
        i, j = _alike(table[one], table[two], least)
        x, y = keys[one][i], keys[two][j]
        keep = x != y
        return pa.table({"key_a": np.minimum(x, y)[keep], "key_b": np.maximum(x, y)[keep]})

    return run


@dataclass(frozen=True)
class Links:
    """``members``: key, representative of its exact copies.  ``links``: pairs of
    representatives (key_a < key_b) with their similarity."""

    members: DataFrame
    links: DataFrame


def link(prepared: DataFrame, how: NearDuplicates) -> Links:
    """Links of all records whose similarity reaches the threshold.

    ``prepared`` comes from :func:`prepare`; repeated keys must be equal rows and
    count once.
    """
    table = materialise(prepared)
    # one signature for each different bag, under the smallest key that has it
    first = table.groupBy("print").agg(F.min(F.struct("key", "signature")).alias("m"))
    different = materialise(first.select("print", F.col("m.key").alias("key"), F.col("m.signature").alias("signature")))
    members = (
        table.select("key", "print")
        .distinct()
        .join(different.select("print", F.col("key").alias("rep")), "print")
        .select("key", "rep")
    )
    signed = different.where("signature is not null")
    bands = signed.select("key", F.explode(_bands(how.rows)("signature")).alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    bucket = materialise(bands.join(shared, "band"))
    few = bucket.where(F.col("n") <= how.block)
    near = (
        few.alias("x")
        .join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.key") < F.col("y.key")))
        .select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))
    )
    # large buckets: every two blocks meet in a group of bounded size
    parts = F.ceil(F.col("n") / how.block).cast("int")
    many = (
        bucket.where(F.col("n") > how.block)
        .withColumn("parts", parts)
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
        .join(different.select("key", "signature"), "key")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "band",
            F.least("own", "other").alias("p"),
            F.greatest("own", "other").alias("q"),
            (F.col("own") > F.col("other")).cast("int").alias("side"),
            "key",
            "signature",
        )
    )
    blocked = many.groupBy("band", "p", "q").applyInArrow(_block_pairs(how), "key_a long, key_b long")
    # signatures rule out what only shares a band by chance
    signs = different.select("key", "signature")
    promising = (
        near.distinct()
        .join(signs.select(F.col("key").alias("key_a"), F.col("signature").alias("s")), "key_a")
        .join(signs.select(F.col("key").alias("key_b"), F.col("signature").alias("t")), "key_b")
        .where(_agreement("s", "t") >= least_equal(how))
        .select("key_a", "key_b")
    )
    candidates = materialise(promising.unionByName(blocked).distinct())
    # only bags of candidates travel
    wanted = materialise(candidates.select(F.explode(F.array("key_a", "key_b")).alias("key")).distinct())
    bags = materialise(table.select("key", "bag").join(wanted, "key", "left_semi"))
    links = (
        candidates.join(bags.select(F.col("key").alias("key_a"), F.col("bag").alias("bag_a")), "key_a")
        .join(bags.select(F.col("key").alias("key_b"), F.col("bag").alias("bag_b")), "key_b")
        .select("key_a", "key_b", _overlap("bag_a", "bag_b").alias("similarity"))
        .where(F.col("similarity") >= how.threshold)
        .dropDuplicates(["key_a", "key_b"])
    )
    return Links(members, materialise(links))


def pairs(found: Links) -> DataFrame:
    """All pairs of records: links and exact copies, each expanded to its members."""
    m = found.members
    left = m.select(F.col("rep").alias("key_a"), F.col("key").alias("x"))
    right = m.select(F.col("rep").alias("key_b"), F.col("key").alias("y"))
    linked = found.links.join(left, "key_a").join(right, "key_b").select("x", "y", "similarity")
    copied = (
        m.alias("s")
        .join(m.alias("t"), (F.col("s.rep") == F.col("t.rep")) & (F.col("s.key") < F.col("t.key")))
        .select(F.col("s.key").alias("x"), F.col("t.key").alias("y"), F.lit(1.0).alias("similarity"))
    )
    return linked.unionByName(copied).select(
        F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"), "similarity"
    )


def classes(found: Links) -> DataFrame:
    """One row for each record: ``key``, ``class_id`` (smallest key of its class),
    ``n_links`` (links of its representative to different bags).

    Labels run along links to the smallest key; each round also jumps from label
    to label, so the number of rounds is about the logarithm of the longest chain.
    """
    both = found.links.select("key_a", "key_b").unionByName(
        found.links.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b"))
    )
    labels = both.groupBy("key_a").agg(F.least(F.col("key_a"), F.min("key_b")).alias("label"))
    labels = materialise(labels.select(F.col("key_a").alias("node"), "label"))
    while True:
        lowest = (
            both.join(labels.select(F.col("node").alias("key_b"), "label"), "key_b")
            .groupBy("key_a")
            .agg(F.min("label").alias("near"))
        )
        step = (
            labels.join(lowest, F.col("node") == F.col("key_a"))
            .select("node", "label", F.least("label", "near").alias("new"))
            .join(labels.select(F.col("node").alias("new"), F.col("label").alias("jump")), "new")
            .select("node", F.col("label").alias("old"), F.least("new", "jump").alias("label"))
        )
        step = materialise(step)
        labels = step.select("node", "label")
        if step.where("old <> label").isEmpty():
            break
    degree = both.groupBy("key_a").agg(F.count("*").alias("n_links"))
    return (
        found.members.join(labels, F.col("rep") == F.col("node"), "left")
        .join(degree, F.col("rep") == F.col("key_a"), "left")
        .select(
            "key",
            F.coalesce("label", "rep").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
