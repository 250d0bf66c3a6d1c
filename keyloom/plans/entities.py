"""Entities: identifiers with a format, notes on them, and properties.

A list of entities is a frame of ids; notes are further columns, so every row
filter, set operation and order of Spark's keeps them. A property is a function
of the ids: of a Column (``single``), or of the frame of the distinct ids that
are asked for (``many``), whose results can be kept in a table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.frame import inner_name
from keyloom.plans.tasks import Store, with_cache


class Formats:
    """Field names and the entity type they hold; a name also stands for what
    it has in parentheses."""

    def __init__(self, known: dict[str, str]):
        self.known = known

    def find(self, name: str) -> str | None:
        return self.known.get(name) or self.known.get(inner_name(name))

    def mark(self, df: DataFrame) -> DataFrame:
        """The frame with each known column's type in its metadata."""
        kinds = {c: self.find(c) for c in df.columns}
        return df.select(*(F.col(f"`{c}`").alias(c, metadata={"entity": k}) if (k := kinds[c]) else F.col(f"`{c}`") for c in df.columns))

    @staticmethod
    def of(schema: StructType) -> dict[str, str]:
        return {f.name: f.metadata["entity"] for f in schema.fields if "entity" in f.metadata}


@dataclass
class Property:
    """``single``: of a Column of ids. ``many``: from a frame of distinct ids
    (column ``id``) to (id, value)."""

    name: str
    single: Callable[[Column], Column] | None = None
    many: Callable[[DataFrame], DataFrame] | None = None

    def of(self, df: DataFrame, key: str) -> DataFrame:
        """The frame with the property of its ids."""
        if self.single is not None:
            return df.withColumn(self.name, self.single(F.col(f"`{key}`")))
        found = self.many(df.select(F.col(f"`{key}`").alias("id")).where("id is not null").distinct()).toDF("_id", self.name)
        return df.join(found, F.col(f"`{key}`") == F.col("_id"), "left").drop("_id")

    def kept(self, df: DataFrame, key: str, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The same by a table of (id, value): only ids that it lacks are
        worked out. Also those, to be appended to it."""
        ids = df.select(F.col(f"`{key}`").alias("id")).where("id is not null")
        fetch = self.many or (lambda d: d.select("id", self.single(F.col("id")).alias("value")))
        every, new = with_cache(cache.toDF("id", "value"), ids, "id", lambda d: fetch(d).toDF("id", "value"))
        rows = df.join(every.toDF("_id", self.name), F.col(f"`{key}`") == F.col("_id"), "left").drop("_id")
        return rows, new

    def stored(self, df: DataFrame, key: str, store: Store) -> DataFrame:
        """The same by a store of (id, value), which keeps what is worked out:
        no id is asked for twice, over all frames and sessions."""
        fetch = self.many or (lambda d: d.select("id", self.single(F.col("id")).alias("value")))
        found = store.get(df.select(F.col(f"`{key}`").alias("id")), lambda d: fetch(d).toDF("id", "value"))
        return df.join(found.toDF("_id", self.name), F.col(f"`{key}`") == F.col("_id"), "left").drop("_id")


def annotate(df: DataFrame, key: str, **notes) -> DataFrame:
    """The ids with the same notes on each."""
    return df.select(F.col(f"`{key}`").alias("id"), F.struct(*(F.lit(v).alias(k) for k, v in notes.items())).alias("notes"))


def notes_table(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Annotated ids as a table: ``id#n`` counts an id's repeats, notes are
    text, lists ``Array:a|b``; all notes as JSON where no fields are named."""
    kinds = {f.name: f.dataType for f in df.schema["notes"].dataType.fields}
    text = lambda f: F.concat(F.lit("Array:"), F.array_join(F.transform(F.col("notes")[f], lambda x: x.cast("string")), "|")) if kinds[f].typeName() == "array" else F.col("notes")[f].cast("string")
    rows = df.groupBy("id", "notes").agg(F.count(F.lit(1)).alias("_n")).withColumn("_n", F.explode(F.sequence(F.lit(1).cast("long"), "_n")))
    key = F.concat(F.col("id").cast("string"), F.lit("#"), F.col("_n").cast("string")).alias("key")
    return rows.select(key, "id", *([text(f).alias(f) for f in fields] if fields else [F.to_json("notes").alias("notes")]))


def load_notes(table: DataFrame, fields: list[str]) -> DataFrame:
    """The inverse: ``Array:`` cells become lists beside the text of others."""
    lists = lambda f: F.when(F.col(f"`{f}`").startswith("Array:"), F.split(F.substr(F.col(f"`{f}`"), F.lit(7)), r"\|", -1))
    return table.select("id", F.struct(*(F.struct(F.when(~F.col(f"`{f}`").startswith("Array:"), F.col(f"`{f}`")).alias("text"), lists(f).alias("list")).alias(f) for f in fields)).alias("notes"))


def subset(df: DataFrame, other: DataFrame) -> DataFrame:
    """Annotated ids that the other list has too."""
    return df.join(other.select("id").distinct(), "id", "left_semi")


def without(df: DataFrame, other: DataFrame) -> DataFrame:
    return df.join(other.select("id").distinct(), "id", "left_anti")


def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b)


def compact(df: DataFrame) -> DataFrame:
    """Without null and empty ids."""
    return df.where(F.coalesce(F.col("id").cast("string"), F.lit("")) != "")


def unique(df: DataFrame) -> DataFrame:
    """One row for each id, with its smallest notes."""
    return df.groupBy("id").agg(F.min("notes").alias("notes"))


def flattened(df: DataFrame) -> DataFrame:
    """Lists of ids as their elements, each with the list's notes."""
    return df.select(F.explode("id").alias("id"), "notes")
