"""Documents as a stream: arriving files or rows are parsed and appended to an index's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexgrain.operators import parse


def append_clauses(stream: DataFrame, key: str, text: str, target: str, checkpoint: str, misread: bool = True) -> StreamingQuery:
    """Parse each micro-batch into clauses and append them to ``target`` (Parquet).

    A batch writes to its own folder, replacing what an interrupted attempt left,
    so a batch that runs again after a failure gives no row twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        found = parse.split_inline(parse.segments(batch, key, text, misread), key)
        found.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def deliveries(stream: DataFrame, at: str, window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Rows of each arrival window: ``window_start``, ``n``; rows later than ``late`` are left out."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "n")
