"""Ingestion and windows under Structured Streaming; the same functions take batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import mapped_rows, normalize_rows


def windowed(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of each window; with `late` a stream's windows close after that delay."""
    own = events.withWatermark("ts", late) if late else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(start, end, user_id, n, total): runs of a user's events, each of which comes before the one before has been over for
    `gap`; end is the last event's time and the gap. With `late` a stream's sessions close after that delay."""
    own = events.withWatermark("ts", late) if late else events
    return own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n", "total")


def ingest_stream(rows: DataFrame, field_map: dict[str, str], prefix: str, target: str, checkpoint: str, least_chars: int = 32, order_by: str | None = None) -> StreamingQuery:
    """Appends new documents to `target`, batch by batch: an identifier that is there already is left out. A batch that
    is run again after a failure adds nothing twice."""

    def add(batch: DataFrame, number: int) -> None:
        made = normalize_rows(batch, field_map, prefix, least_chars, order_by)
        spark = batch.sparkSession
        if _exists(spark, target):
            made = made.join(spark.read.parquet(target).select("id"), "id", "left_anti")
        made.write.mode("append").parquet(target)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_with_state(rows: DataFrame, field_map: dict[str, str], prefix: str, target: str, checkpoint: str, least_chars: int = 32, late: tuple[str, str] | None = None) -> StreamingQuery:
    """Appends new documents to `target`; which identifiers came before is the stream's state, so that a batch reads its own
    rows only, and of rows with one identifier one stays. The state and what was written are both in `checkpoint`: a stream
    that is started again with it goes on where it stopped, and a batch that failed is written once.

    late: (a column of times, a delay): identifiers are forgotten after that delay, and a copy that comes later is a document
    again; without it they are kept for good, by a digest each in the state store.
    """
    if late:
        rows = rows.withWatermark(*late)
        made = mapped_rows(rows, field_map, prefix, least_chars, late[0]).dropDuplicatesWithinWatermark(["id"]).withColumnRenamed("_order", late[0])
    else:
        made = mapped_rows(rows, field_map, prefix, least_chars).drop("_order").dropDuplicates(["id"])
    return made.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def _exists(spark, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
