"""Vectors as array columns: hashing embedder, cosine ranking, pooling, caching."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexgrain.functions import text as X


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column, floor: float = 1e-9, added: float = 0.0) -> Column:
    """Unit vector; the norm is at least ``floor``, or ``added`` is added to it."""
    length = F.greatest(norm(a), F.lit(floor)) + F.lit(added)
    return F.transform(a, lambda x: x.cast("double") / length)


def hashed(units: DataFrame, unit: str, text: str) -> DataFrame:
    """Non-zero entries of 256-dimensional hashing vectors: ``unit``, ``dim``, ``value``.

    A token adds 1 or -1 at the last byte of the first eight of its SHA-1; the
    sign is the lowest bit of the byte before it.  Vectors have length 1.  A text
    without tokens, or whose tokens cancel, has no entries.
    """
    words = units.select(F.col(unit), F.explode(X.tokens(text)).alias("_w"))
    digest = F.sha1(F.encode("_w", "UTF-8"))
    low = F.conv(F.substring(digest, 15, 2), 16, 10).cast("int")
    sign = F.when(F.conv(F.substring(digest, 14, 1), 16, 10).cast("int") % 2 == 1, 1).otherwise(-1)
    sums = (
        words.select(unit, low.alias("dim"), sign.alias("_s"))
        .groupBy(unit, "dim")
        .agg(F.sum("_s").alias("_v"))
        .where("_v <> 0")
    )
    whole = Window.partitionBy(unit)
    return sums.select(unit, "dim", (F.col("_v") / F.sqrt(F.sum(F.col("_v") * F.col("_v")).over(whole))).alias("value"))


_DIM = 256


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def hashed_dense(tokens: pa.Array) -> pa.Array:
    """Column of hashing vectors (see :func:`hashed`) of lists of tokens, as whole arrays; without
    length if the tokens cancel or there are none.  Each different token is hashed once a batch."""
    import hashlib

    import numpy as np

    words = tokens.flatten().dictionary_encode() if len(tokens) else None
    out = np.zeros((len(tokens), _DIM))
    if words is not None and len(words):
        digests = [hashlib.sha1(w.encode()).digest() for w in words.dictionary.to_pylist()]
        dims = np.array([d[7] for d in digests])
        signs = np.array([1.0 if d[6] & 1 else -1.0 for d in digests])
        codes = words.indices.to_numpy()
        sizes = [0 if n is None else n for n in pc.list_value_length(tokens).to_pylist()]
        np.add.at(out, (np.repeat(np.arange(len(tokens)), sizes), dims[codes]), signs[codes])
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)
    ends = pa.array(np.arange(0, out.size + 1, _DIM, dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))


def embed(
    units: DataFrame, unit: str, text: str, embedder: Callable[[list[str]], list[list[float]]], batch: int = 64
) -> DataFrame:
    """``unit``, ``vec`` by a client's batch function, run on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embedder([t or "" for t in part.column(1).to_pylist()])
                if len(vectors) != part.num_rows:
                    raise ValueError("the embedder returned another number of vectors")
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(vectors, pa.list_(pa.float32()))], names=[unit, "vec"]
                )

    kind = dict(units.dtypes)[unit]
    return units.select(unit, text).mapInArrow(run, f"`{unit}` {kind}, vec array<float>")


def rank(
    queries: DataFrame,
    items: DataFrame,
    item: str,
    k: int,
    digits: int = 6,
    section: str | None = None,
    scope: dict[int, set[int]] | None = None,
) -> DataFrame:
    """The ``k`` items nearest each query by cosine: ``query_id``, item, ``score``, ``rank``.

    ``queries`` (query_id, vec) is the stated query set: it is collected if it has
    at most 10,000 rows and refused beyond, and every task scans its share of the
    items against it, keeping its own best ``k``, so that a shuffle sees no more
    than ``k`` rows of each task and query.  With ``scope``, a query sees only the items
    whose ``section`` is in its set; a query that is missing there sees none.
    """
    import numpy as np

    limit = 10_000
    rows = queries.select("query_id", "vec").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} queries; pass them in blocks")
    ids = [r.query_id for r in rows]
    matrix = np.array([r.vec for r in rows], dtype=np.float64).reshape(len(rows), -1)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for batch in batches:
            names, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = [i for i, v in enumerate(vectors) if v]
            if not keep:
                continue
            table = np.array([vectors[i] for i in keep], dtype=np.float64)
            table /= np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
            got = np.round(matrix @ table.T, digits)
            if scope is not None:
                own = np.array([-1 if x is None else x for x in batch.column(2).to_pylist()])[keep]
                for q, name in enumerate(ids):
                    got[q, ~np.isin(own, sorted(scope.get(name, ())))] = -np.inf
            for q in range(len(ids)):
                near = np.argpartition(-got[q], min(k, len(keep) - 1))[: k + 1] if len(keep) > k else range(len(keep))
                edge = min((got[q][i] for i in near), default=0)
                rows = [(-got[q][i], names[keep[i]]) for i in np.flatnonzero((got[q] >= edge) & (got[q] > -np.inf))]
                best[q] = sorted(best[q] + rows)[:k]
        out = [(ids[q], name, -score) for q in range(len(ids)) for score, name in best[q]]
        columns = list(zip(*out)) if out else [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(columns[0]), pa.int64()), pa.array(list(columns[1]), pa.int64()), pa.array(list(columns[2]), pa.float64())],
            names=["query_id", item, "score"],
        )

    columns = [F.col(item).cast("long"), F.col("vec")] + ([F.col(section).cast("long")] if scope is not None else [])
    local = items.select(*columns).mapInArrow(run, f"query_id long, `{item}` long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), item)
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pool(rows: DataFrame, group: str, vec: str = "vec") -> DataFrame:
    """Mean of the vectors of each group, at length 1: ``group``, ``vec``.

    Averages are taken per position, so that a group of any size is aggregated in
    parts before the shuffle.
    """
    means = (
        rows.select(group, F.posexplode(vec).alias("_i", "_x"))
        .groupBy(group, "_i")
        .agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    )
    gathered = means.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_v"))
    return gathered.select(group, normalise(F.transform("_v", lambda x: x["_m"])).alias("vec"))


def cache_key(model: str, text: Column | str) -> Column:
    """Key of a cached embedding: SHA-1 of the model's name, a zero byte and the text."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha1(F.concat(F.encode(F.lit(model), "UTF-8"), F.unhex(F.lit("00")), F.encode(text, "UTF-8")))


def missing(units: DataFrame, text: str, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts that the cache (column ``key``) lacks: ``key``, ``text``."""
    wanted = units.where(F.col(text).isNotNull()).select(cache_key(model, text).alias("key"), F.col(text).alias("text"))
    return wanted.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def provider(name: str, known: dict[str, Callable[[], Callable]], credentials: dict[str, str | None]) -> Callable:
    """The embedder of a provider's name; one that needs credentials is refused without them.

    ``known`` makes embedders by name, ``credentials`` has an entry for each that sends text elsewhere.
    """
    if name not in known:
        raise ValueError(f"embedder must be one of {sorted(known)}, got {name!r}")
    if name in credentials and not credentials[name]:
        raise PermissionError(f"the embedder {name!r} sends text elsewhere and has no credentials; it isn't used")
    return known[name]()
