"""Packing of items of varying length into containers of fixed capacity.

Only the histogram of lengths (at most ``capacity`` rows, whatever the number of
items) reaches the driver.  There lengths are placed longest first, each into the
open packing pattern with the shortest contents (most room left), updating how
many containers follow each pattern.  Items then find their container by a join
on length and rank.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items of one length are ranked in buckets of about so many rows.
BUCKET_ROWS = 50_000
#: Placements are broadcast up to this number of rows (48 bytes each).
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Pattern:
    """``count`` containers that each hold the given ``(length, times)`` pairs."""

    count: int
    content: tuple[tuple[int, int], ...]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Shortest-pack-first over a histogram of lengths in ``1 .. capacity``."""
    open_packs: list[list[list]] = [[] for _ in range(capacity + 1)]  # by room left
    roomiest = 0  # no open pack has more room
    full: list[Pattern] = []

    def add(count: int, content: tuple, room: int) -> None:
        nonlocal roomiest
        if room:
            open_packs[room].append([count, content])
            roomiest = max(roomiest, room)
        else:
            full.append(Pattern(count, content))

    for length in sorted(histogram, reverse=True):
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1 .. {capacity}")
        left = histogram[length]
        while left:
            while roomiest and not open_packs[roomiest]:
                roomiest -= 1
            if roomiest < length:
                # new containers: as many of this length as go into one
                times = min(capacity // length, left)
                # shortest first: spread before stacking
                add(left, ((length, 1),), capacity - length) if times == 1 else add(
                    math.ceil(left / times) if left % times == 0 else left // times,
                    ((length, times),),
                    capacity - length * times,
                )
                left = 0 if times == 1 or left % times == 0 else left % times
                continue
            pack = open_packs[roomiest].pop()
            count, content = pack
            used = min(count, left)
            if used < count:
                open_packs[roomiest].append([count - used, content])
            room = roomiest
            if content and content[-1][0] == length:
                grown = (*content[:-1], (length, content[-1][1] + 1))
            else:
                grown = (*content, (length, 1))
            add(used, grown, room - length)
            left -= used
    for room in range(capacity, 0, -1):
        full.extend(Pattern(count, content) for count, content in open_packs[room])
    return full


def placement_rows(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """``(length, rank_from, rank_to, times, first_container, offset)`` of each use of a length."""
    rows, ranks, base = [], {}, 0
    for pattern in patterns:
        offset = 0
        for length, times in pattern.content:
            first = ranks.get(length, 0)
            ranks[length] = first + pattern.count * times
            rows.append((length, first, ranks[length], times, base, offset))
            offset += length * times
        base += pattern.count
    return rows


def pieces(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Items divided where they alone exceed the capacity: full pieces and a rest.

    Result: ``key``, ``piece_no``, ``token_start``, ``n_tokens``.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    return items.select(
        F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("piece_no")
    ).select(
        key,
        "piece_no",
        (F.col("piece_no") * F.lit(capacity)).cast("long").alias("token_start"),
        F.least(F.lit(capacity), F.col("_n") - F.col("piece_no") * F.lit(capacity))
        .cast("int")
        .alias("n_tokens"),
    )


def pack(items: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """Assign every item to containers.

    Result: ``key``, ``piece_no``, ``token_start``, ``n_tokens``, ``container_id``,
    ``container_offset``.  Null sizes count as 0; items of size 0 come out with a
    null container, since they take no room.  Equal sizes are ranked by key and
    piece; repeated keys are packed as separate items.  ``items`` is read twice:
    pass a materialised table.
    """
    spark = items.sparkSession
    cut = pieces(items, key, size, capacity)
    sized = cut.where("n_tokens > 0")
    histogram = {r[0]: r[1] for r in sized.groupBy("n_tokens").count().collect()}
    placements = placement_rows(pack_histogram(histogram, capacity))
    placed = spark.createDataFrame(
        placements,
        "length int, rank_from long, rank_to long, times long, first long, at long",
    )
    buckets = max(1, math.ceil(max(histogram.values(), default=0) / BUCKET_ROWS))
    # rank within a length in two levels, so that a frequent length isn't one task
    salted = sized.withColumn("_b", F.pmod(F.xxhash64(key, "piece_no"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("n_tokens").orderBy("_b")
    offsets = (
        salted.groupBy("n_tokens", "_b")
        .count()
        .select("n_tokens", "_b", (F.sum("count").over(before) - F.col("count")).alias("_skip"))
    )
    within = Window.partitionBy("n_tokens", "_b").orderBy(key, "piece_no")
    ranked = (
        salted.withColumn("_rn", F.row_number().over(within) - 1)
        .join(offsets, ["n_tokens", "_b"])
        .withColumn("_rank", F.col("_rn") + F.col("_skip"))
    )
    nth = F.col("_rank") - F.col("rank_from")
    # bounded by the capacity: a few patterns for each length, each of few lengths
    if len(placements) <= BROADCAST_ROWS:
        placed = F.broadcast(placed)
    joined = ranked.join(
        placed,
        (F.col("n_tokens") == F.col("length"))
        & (F.col("_rank") >= F.col("rank_from"))
        & (F.col("_rank") < F.col("rank_to")),
    ).select(
        key,
        "piece_no",
        "token_start",
        "n_tokens",
        (F.col("first") + F.floor(nth / F.col("times"))).cast("long").alias("container_id"),
        (F.col("at") + F.pmod(nth, F.col("times")) * F.col("n_tokens")).cast("int").alias("container_offset"),
    )
    empty = cut.where("n_tokens = 0").select(
        key,
        "piece_no",
        "token_start",
        "n_tokens",
        F.lit(None).cast("long").alias("container_id"),
        F.lit(None).cast("int").alias("container_offset"),
    )
    return joined.unionByName(empty)
