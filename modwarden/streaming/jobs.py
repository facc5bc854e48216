"""Structured Streaming forms of the batch plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from modwarden import staging
from modwarden.sources import scans


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Scanned and blocked messages by day of event time; days close when the watermark has passed them."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("event_type") == "error").alias("blocked")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "scanned", "blocked")


def violation_counts(events: DataFrame) -> DataFrame:
    """Running violations of each user, for update mode."""
    return events.where("event_type = 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("violations"))


def drained(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and reads its result as a table."""
    spark = stream.sparkSession
    out, checkpoint = staging.folder(spark, "stream-out"), staging.folder(spark, "stream-state")

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def counted(events: DataFrame) -> DataFrame:
    """violation_counts() of a stream, run over what is there now."""
    return drained(violation_counts(events))


def moderate_and_learn(messages: DataFrame, judge: Callable[[DataFrame, DataFrame], DataFrame], learn: Callable[[DataFrame], DataFrame], table: str, out: str, checkpoint: str) -> StreamingQuery:
    """moderate() with a table of vectors that training messages add to.

    A batch's messages are judged by the table as it is when the batch begins, so what a batch learns is seen by the later
    ones; its rows are written under the batch's number, so a batch that runs again learns nothing twice."""

    def put(batch: DataFrame, n: int) -> None:
        plain, commands = scans.commands(batch)
        spark = batch.sparkSession
        judge(plain, spark.read.parquet(table)).write.mode("overwrite").parquet(f"{out}/batch={n}")
        learn(commands).write.mode("overwrite").parquet(f"{table}/learned=batch-{n}")

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moderate(messages: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a batch plan to every micro-batch and appends the verdicts; a batch that runs again is not written twice."""

    def put(batch: DataFrame, n: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return messages.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
