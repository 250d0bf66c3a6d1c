"""Structured Streaming: tables that grow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tail(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 64) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Rows for each value in windows of event time; what is later than
    ``late`` is left out, so the state stays bounded."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def traverse_into(stream: DataFrame, path: str, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Append what ``change`` makes of the rows to a folder, exactly once, and
    stop when what has arrived is done."""
    return change(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def collapse_into(stream: DataFrame, key: str, value: str, path: str, checkpoint: str) -> StreamingQuery:
    """Partial sums of each batch in a folder of their own; a batch that is
    run again overwrites its folder, so nothing counts twice."""

    def batch(df: DataFrame, n: int) -> None:
        df.groupBy(key).agg(F.sum(value).alias(value), F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tee_into(stream: DataFrame, sinks: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str) -> StreamingQuery:
    """One stream into several folders: each batch is held once and written by
    each sink, under the batch's number, so a batch that is run again
    overwrites what it wrote."""

    def batch(df: DataFrame, n: int) -> None:
        held = df.persist()
        try:
            for path, change in sinks.items():
                change(held).write.mode("overwrite").parquet(f"{path}/batch={n}")
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def saved_through(df: DataFrame, path: str) -> DataFrame:
    """Write rows on their way and go on from what was written."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def watched(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, Observation]:
    """Rows as they are, and an observation that gets the measures of them
    when an action has passed over them all."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in measures.items())), seen


def map_list(spark: SparkSession, values: list, change: Callable[[Column], Column], schema: str) -> DataFrame:
    """(value, result) of each of a list, in parallel."""
    rows = spark.createDataFrame([(v,) for v in values], f"value {schema}")
    return rows.repartition(max(1, min(len(values), spark.sparkContext.defaultParallelism))).select("value", change(F.col("value")).alias("result"))
