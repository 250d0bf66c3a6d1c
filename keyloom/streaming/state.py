"""Tables that a stream keeps up to date: the state of each key outlives the
batch, and after a restart goes on from the checkpoint.

Loading modes give what they give on a table at rest, because what counts is the
order columns and not when a row arrived. A batch hands on the rows of the keys
that it changed; they are stored under its number (a batch that is run again
overwrites them), and a key's row of the last batch is its present one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import ArrayType, StructField, StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _kept(changed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return changed.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running(stream: DataFrame, key: str, path: str, checkpoint: str, **folds: Column) -> StreamingQuery:
    """Collapse: aggregates by key over all batches so far, whose state is what
    the aggregates hold (a sum, a smallest order with its row) and not the
    rows."""
    return _kept(stream.groupBy(key).agg(*(c.alias(n) for n, c in folds.items())), path, checkpoint)


def first_wins(stream: DataFrame, key: str, fields: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """The first row of each key in the order, whenever it arrives."""
    return running(stream, key, path, checkpoint, first=F.min_by(F.struct(*fields), F.struct(*order)))


class _Merge(StatefulProcessor):
    """Appends a key's rows to its list and hands on the whole, in order."""

    def __init__(self, key: str, fields: list[str], order: list[str], row: StructType):
        self.key, self.fields, self.order, self.row = key, fields, order, row

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getListState("rows", self.row)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        for batch in rows:
            plain = batch[self.row.names].astype(object).where(batch[self.row.names].notna(), None)
            self.held.appendList([tuple(r) for r in plain.itertuples(index=False)])
        names = self.row.names
        at = [names.index(c) for c in self.order]
        every = sorted(self.held.get(), key=lambda r: [(r[i] is None, r[i]) for i in at])
        out = {self.key: [key[0]]} | {f: [[r[names.index(f)] for r in every]] for f in self.fields}
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def merge(stream: DataFrame, key: str, fields: list[str], order: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """A list for each field of a key's rows, in the order; rows that come late
    take their place. The state is a list for each key that batches append to.
    The session needs the state store ``ROCKS``."""
    row = StructType([StructField(c, stream.schema[c].dataType) for c in dict.fromkeys([*order, *fields])])
    out = StructType([stream.schema[key], *(StructField(f, ArrayType(stream.schema[f].dataType)) for f in fields)])
    changed = stream.groupBy(key).transformWithStateInPandas(_Merge(key, fields, order, row), outputStructType=out, outputMode="Update", timeMode="None")
    return _kept(changed, path, checkpoint)


def present(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Each key's row as the last batch that changed it left it."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in (key, "batch")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"`{f}`") for f in fields)), "batch").alias("_r"))
    return last.select(key, *(F.col("_r")[f].alias(f) for f in fields))


def traversed(stream: DataFrame, path: str, checkpoint: str, change) -> StreamingQuery:
    """Any function of a batch's frame, its rows stored under the batch's
    number: a null result or no row is skipped, many are kept."""

    def batch(df: DataFrame, n: int) -> None:
        made = change(df)
        if made is not None:
            made.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
