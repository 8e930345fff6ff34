"""Documents that arrive: a stream through the native steps, and micro-batches through the whole job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import spans
from ..plans.translate import Job, translate
from ..sources import scratch
from ..sources.transport import Transport


def protected(stream: DataFrame, filters: list[str], text_col: str = "text") -> DataFrame:
    """A stream (or table) with prepared and spans."""
    return spans.protect(stream, text_col, spans.resolve(filters))


def asked_once(stream: DataFrame, time: str, key: list[str], within: str = "1 hour") -> DataFrame:
    """A stream without rows whose key has come before, by event time, within this time. The state holds keys of that time only; a row that comes later than that is dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(key)


def usage_windows(stream: DataFrame, time: str, by: list[str], amount: Column, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Rows and their amounts by window of event time and by. A window is final, and given out by a stream in append mode, when the latest time seen is late after its end; what comes after that counts no more. late: None where the stream has a watermark already."""
    held = stream.withWatermark(time, late) if late else stream
    made = held.groupBy(F.window(time, length).alias("_w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(amount.cast("bigint")).alias("total"))
    return made.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, "n", "total")


def start(stream: DataFrame, job: Job, transport: Transport, store: str, out: str, checkpoint: str, available_now: bool = True, in_flight: int = 1) -> StreamingQuery:
    """Translates each micro-batch. Good answers are in store by request and results by batch, so a batch that runs again asks only for what had no good answer yet, and writes over what it wrote."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        work = scratch.folder(spark, "batch")
        try:
            translate(df, job, transport, store, in_flight=in_flight, work=work).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            scratch.remove(spark, work)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
