"""Indices that are written once and read in part.

A field index holds, for each value of each indexed field, the keys that have
it, in blocks: keys are dealt to blocks by hash, so that a value with a large
share of all keys has many short lists and not one long one, and so that lists
of different values meet block by block. Values are dealt to folders by hash; a
lookup reads the folders of the values asked for.

A range index holds intervals in parts that can be added to. The rows of a part
are dealt to files by level and bin, and a table of a row for each file says
which group and positions it spans; a lookup reads the files that can hold an
answer. A part counts once its table of files is whole.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.frame import KeyedFrame
from keyloom.operators.intervals import STEP, _levels, _longest, range_index
from keyloom.plans.tasks import read_manifest, write_manifest

#: Keys that a block has on average.
BLOCK = 1 << 15


def _hashed(column, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n))


def write_field_index(t: KeyedFrame, path: str, fields: list[str] | None = None, buckets: int = 64) -> None:
    """The index of the fields: folders by field and by the values' hash, and
    rows (value, block, keys), the keys sorted. A folder with a large share of
    the rows is written by several tasks. Null keys and values aren't in it."""
    names = [t.field(f) for f in fields] if fields else t.fields
    blocks = max(1, -(-t.df.select(F.approx_count_distinct(F.col(f"`{t.key}`"))).first()[0] // BLOCK))

    def marked(f: str):
        return F.transform(t.values(f), lambda x: F.struct(F.lit(f).alias("field"), x.cast("string").alias("value")))

    spread = [marked(f) for f in names]
    rows = t.df.where(F.col(f"`{t.key}`").isNotNull()).select(F.col(f"`{t.key}`").alias("key"), F.explode(F.concat(*spread)).alias("x")).select("x.*", "key")
    lists = rows.groupBy("field", "value", _hashed("key", blocks).alias("block")).agg(F.sort_array(F.collect_set("key")).alias("keys"))
    dealt = lists.withColumn("bucket", _hashed("value", buckets)).hint("rebalance", F.col("field"), F.col("bucket"))
    dealt.sortWithinPartitions("field", "bucket", "value", "block").write.mode("overwrite").partitionBy("field", "bucket").parquet(f"{path}/lists")
    write_manifest(t.df.sparkSession, path, {"key": t.key, "fields": names, "buckets": buckets, "blocks": blocks})


class FieldIndex:
    """A written field index."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.about = spark, path, read_manifest(spark, path)
        if self.about is None:
            raise FileNotFoundError(path)

    def lists(self, field: str, values: list) -> DataFrame:
        """(value, block, keys) of some values of a field; of the index only
        their folders are read, and of these the row groups that may hold
        them."""
        if field not in self.about["fields"]:
            raise KeyError(f"no index of {field!r} among {self.about['fields']}")
        said = [str(v) for v in values]
        # The folders' numbers, worked out by the function that dealt values to them.
        hashed = [r[0] for r in self.spark.range(1).select(F.explode(F.array(*(_hashed(F.lit(v), self.about["buckets"]) for v in said))) if said else F.lit(-1)).distinct().collect()]
        held = self.spark.read.parquet(f"{self.path}/lists")
        return held.where((F.col("field") == field) & F.col("bucket").isin(hashed) & F.col("value").isin(said)).select("value", "block", "keys")

    def select(self, wanted: dict[str, list], every: bool = True) -> DataFrame:
        """The keys with one of the values in every named field, or (not
        ``every``) in any of them. Lists are joined and intersected block by
        block."""
        parts = []
        for field, values in wanted.items():
            own = self.lists(field, values if isinstance(values, (list, tuple, set)) else [values])
            parts.append(own.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("keys"))).alias("keys")))
        if every:
            both = reduce(lambda a, b: a.join(b.withColumnRenamed("keys", "_o"), "block").select("block", F.array_intersect("keys", "_o").alias("keys")), parts)
        else:
            both = reduce(lambda a, b: a.join(b.withColumnRenamed("keys", "_o"), "block", "full").select("block", F.array_union(F.coalesce("keys", F.array()), F.coalesce("_o", F.array())).alias("keys")), parts)
        return both.select(F.explode("keys").alias(self.about["key"]))

    def counts(self, field: str) -> DataFrame:
        """How many keys each value of the field has, from the lists alone."""
        held = self.spark.read.parquet(f"{self.path}/lists").where(F.col("field") == field)
        return held.groupBy("value").agg(F.sum(F.size("keys")).cast("long").alias("n"))


class RangeIndex:
    """Intervals (b_start, b_end, whole numbers) with the columns of their group
    ``on``, in parts under a path."""

    def __init__(self, spark: SparkSession, path: str, on: list[str] = (), width: int = 1 << 14):
        self.spark, self.path, self.on, self.width = spark, path.rstrip("/"), list(on), width

    def _parts(self) -> list[dict]:
        held = read_manifest(self.spark, self.path)
        return held["parts"] if held else []

    def append(self, ranges: DataFrame, start: str = "b_start", end: str = "b_end", files: int = 32) -> None:
        """Further intervals, as a part of about so many files, each with a run
        of a group's bins."""
        rows = ranges.withColumnsRenamed({start: "b_start", end: "b_end"}).where("b_start is not null and b_end is not null")
        for name in self.on:
            rows = rows.where(F.col(name).isNotNull())
        longest = _longest(rows, "b_start", "b_end") or 0
        part = uuid.uuid4().hex
        order = [*self.on, "_level", "_bin", "b_start"]
        own = range_index(rows, self.width, longest=longest)
        own.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(f"{self.path}/{part}/rows")
        written = self.spark.read.schema(own.schema).parquet(f"{self.path}/{part}/rows")
        spans = written.groupBy(F.input_file_name().alias("file"), *self.on).agg(F.min("b_start").alias("low"), F.max("b_end").alias("high"))
        spans.write.parquet(f"{self.path}/{part}/files")
        write_manifest(self.spark, self.path, {"parts": [*self._parts(), {"name": part, "longest": longest, "schema": own.schema.json()}]})

    def files(self, low: int, high: int, **group) -> list[str]:
        """The files that may hold intervals over the positions: as many names
        reach the driver."""
        names: list[str] = []
        for part in self._parts():
            spans = self.spark.read.parquet(f"{self.path}/{part['name']}/files").where((F.col("low") <= high) & (F.col("high") >= low))
            for name, value in group.items():
                spans = spans.where(F.col(name) == value)
            names += [r.file for r in spans.select("file").distinct().collect()]
        jvm = self.spark._jvm
        return sorted(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(n)).toString() for n in names)

    def over(self, low: int, high: int | None = None, **group) -> DataFrame:
        """The intervals that share a position with a point or a closed range of
        positions, each once."""
        high = low if high is None else high
        parts, names = self._parts(), self.files(low, high, **group)
        if not parts:
            raise FileNotFoundError(self.path)
        schema = StructType.fromJson(json.loads(parts[0]["schema"]))
        rows = self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)
        rows = rows.where((F.col("b_start") <= high) & (F.col("b_end") >= low))
        for name, value in group.items():
            rows = rows.where(F.col(name) == value)
        # An interval stands in each bin that it touches; it counts in the first
        # of those within the range asked for.
        first = reduce(lambda x, l: x.when(F.col("_level") == l, self.width * STEP**l), range(1, _levels(max(p["longest"] for p in parts), self.width)), F.when(F.col("_level") == 0, self.width))
        return rows.where(F.col("_bin") == F.floor(F.greatest(F.col("b_start"), F.lit(low)) / first)).drop("_level", "_bin")

    def points(self, points: DataFrame, position: str = "pos") -> DataFrame:
        """Many points with the intervals that hold them: an equi-join with the
        stored bins."""
        parts = self._parts()
        levels = _levels(max(p["longest"] for p in parts), self.width)
        bins = F.array(*(F.struct(F.lit(l).alias("_level"), F.floor(F.col(position) / (self.width * STEP**l)).alias("_bin")) for l in range(levels)))
        held = self.spark.read.parquet(*(f"{self.path}/{p['name']}/rows" for p in parts))
        own = points.withColumn("_at", F.explode(bins)).select("*", "_at.*").drop("_at")
        return own.join(held, [*self.on, "_level", "_bin"]).where(F.col(position).between(F.col("b_start"), F.col("b_end"))).drop("_level", "_bin")
