"""Structured Streaming on top of tables: micro-batch ingestion, windowed aggregates and keyed state.  Extras of this engine."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(spark: SparkSession, folder: str, schema: T.StructType | str, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A stream of the files that arrive in a landing folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(folder)


def into_table(stream: DataFrame, session, table: str, checkpoint: str, once: bool = True):
    """Append each micro-batch to a table as one part.  The version that adds it carries the stream's and the batch's number,
    and there is one version with such a mark: a batch that is replayed after a failure adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        session.insert(table, batch, mark=f"{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-{number:012d}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], aggregates: dict[str, str], slide: str | None = None) -> DataFrame:
    """Tumbling (or sliding) event-time windows with a watermark: rows later than `late` are left out, state is bounded."""
    own = stream.withWatermark(ts, late).groupBy(F.window(ts, width, slide or width), *keys).agg(*(F.expr(e).alias(n) for n, e in aggregates.items()))
    return own.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, *aggregates)


def sessions(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Sessions by key that end after a gap without rows."""
    own = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))
    return own.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")
