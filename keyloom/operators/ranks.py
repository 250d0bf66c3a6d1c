"""Order, samples, set operations, and what depends on a row's rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame
from keyloom.operators.aggregates import numbered


def first_value(t: KeyedFrame, name: str) -> Column:
    """A field's first value, or the scalar."""
    return F.get(t.values(name), F.lit(0))


def sort_by(t: KeyedFrame, *names: str, descending: bool = False, numeric: bool = False, absolute: bool = False) -> DataFrame:
    """Rows by the first values of fields (as numbers, or by their size), ties
    by key."""
    keys = []
    for n in names:
        c = first_value(t, n)
        c = c.try_cast("double") if numeric or absolute else c
        c = F.abs(c) if absolute else c
        keys.append(c.desc() if descending else c.asc())
    return t.df.orderBy(*keys, F.col(f"`{t.key}`"))


def sort_pairs(t: KeyedFrame, *exprs: Column) -> DataFrame:
    """Rows by any expressions of key and fields, ties by key."""
    return t.df.orderBy(*exprs, F.col(f"`{t.key}`"))


def sort_lines(lines: DataFrame, column: str = "value", mark: str = "#") -> DataFrame:
    """Lines in byte order, those of the header first."""
    return lines.orderBy(~F.col(column).startswith(mark), column)


def page(df: DataFrame, number: int, size: int, order: list) -> DataFrame:
    """The page of that number, from 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def head(df: DataFrame, n: int, order: list) -> DataFrame:
    return df.orderBy(*order).limit(n)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """``n`` rows without replacement: those of lowest seeded digest, so a
    run that is repeated takes the same."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}"))), key).limit(n)


def draw(df: DataFrame, n: int, order: list[str], seed: int = 0) -> DataFrame:
    """``n`` rows with replacement: random places in a total order."""
    total = df.count()
    own = numbered(df, order)
    places = df.sparkSession.range(n).select((F.floor(F.rand(seed) * total) + 1).cast("long").alias("_n"))
    return places.join(own, "_n").drop("_n")


def contig_place(name: Column, contigs: list[str]) -> Column:
    """The place of a contig in a list; null for one that isn't in it."""
    return F.nullif(F.array_position(F.array(*map(F.lit, contigs)), name), F.lit(0))


def chromosome_order(name: Column) -> Column:
    """A sort key for chromosomes: numbers by value, then names."""
    bare = F.regexp_replace(name, "^chr", "")
    number = F.nullif(F.regexp_extract(bare, r"(\d+)$", 1), F.lit("")).try_cast("long")
    return F.struct(number.isNull().alias("named"), F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNull(), bare).alias("name"))


def version_order(text: Column) -> Column:
    """A sort key in which runs of digits count by value: text and numbers by
    turns."""
    parts = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda x: F.struct(F.when(x.rlike(r"^\d"), "").otherwise(x).alias("text"), F.coalesce(x.try_cast("decimal(38,0)"), F.lit(-1)).alias("number")))


def position_keys(location: str, how: str | list[str] = "plain", sep: str = ":") -> list[Column]:
    """The columns ``_chr`` and ``_pos`` that ``by_position`` orders by."""
    parts = F.split(location, sep)
    name, at = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).try_cast("long")
    order = contig_place(name, how) if isinstance(how, list) else version_order(name) if how == "strict" else name
    return [order.alias("_chr"), at.alias("_pos")]


def by_position(df: DataFrame, location: str, how: str | list[str] = "plain", sep: str = ":") -> DataFrame:
    """Rows by the chromosome and numeric position of ``chr:pos...``: ``plain``
    (byte order of names), ``strict`` (numbers by value), or a list of
    contigs. Ties go by the whole text."""
    return df.orderBy(*position_keys(location, how, sep), location)


def mutation_lines(df: DataFrame, column: str, how: str = "plain", sep: str = ":") -> DataFrame:
    """Distinct mutations that have a separator, ``M:`` as ``MT:``, sorted."""
    kept = df.where(F.col(column).contains(sep)).select(F.regexp_replace(column, f"^M{sep}", f"MT{sep}").alias(column)).distinct()
    return by_position(kept, column, how, sep)


# Sets of rows ---------------------------------------------------------------


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def unique_lines(lines: DataFrame) -> DataFrame:
    return lines.distinct()


def interleaved(streams: list[DataFrame], orders: list[list[str]]) -> DataFrame:
    """Rows of several frames by turns: the first of each, the second of each,
    and so on; ``_place`` and ``_stream`` give the order."""
    own = [numbered(df, order, "_place").withColumn("_stream", F.lit(i)) for i, (df, order) in enumerate(zip(streams, orders))]
    return reduce(DataFrame.unionByName, own).orderBy("_place", "_stream")


# Lists in cells ---------------------------------------------------------------


def list_union(a: str, b: str) -> Column:
    return F.sort_array(F.array_union(a, b))


def list_intersection(a: str, b: str) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def list_without(a: str, b: str) -> Column:
    return F.array_except(a, b)


def list_compact(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull() & (x.cast("string") != ""))


def hit_places(values: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Where in the sorted values the wanted ones stand (from 0)."""
    own = numbered(values.select(column).distinct(), [column])
    return own.join(wanted.select(column).distinct(), column, "left_semi").select(column, (F.col("_n") - 1).alias("place"))


# What depends on rank -----------------------------------------------------------


def gradient(df: DataFrame, value: str, low: str, high: str, name: str = "colour") -> DataFrame:
    """A colour between two of ``#rrggbb`` by the value's share of the range;
    null for null."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    share = (F.col(value) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0))
    channels = [(int(low[i : i + 2], 16), int(high[i : i + 2], 16)) for i in (1, 3, 5)]
    two = [F.lpad(F.lower(F.hex(F.round(a + (b - a) * F.coalesce(share, F.lit(0.0))).cast("long"))), 2, "0") for a, b in channels]
    return df.join(F.broadcast(ends)).withColumn(name, F.when(F.col(value).isNotNull(), F.concat(F.lit("#"), *two))).drop("_lo", "_hi")


def rank_gradient(df: DataFrame, value: str, key: str, low: str, high: str, name: str = "colour") -> DataFrame:
    """As ``gradient``, by rank."""
    own = numbered(df.where(F.col(value).isNotNull()), [value, key], "_rank")
    return gradient(own, "_rank", low, high, name).drop("_rank")


def quantile_pairs(df: DataFrame, p: str, key: str) -> DataFrame:
    """For a quantile plot of p-values: each one's -log10 beside the one that
    a uniform distribution puts at its rank."""
    own = numbered(df.where(F.col(p).isNotNull()), [p, key])
    total = df.agg(F.count(p).alias("_t"))
    return own.join(F.broadcast(total)).select(*df.columns, (-F.log10(p)).alias("observed"), (-F.log10(F.col("_n") / (F.col("_t") + 1))).alias("expected"))
