"""Projection, re-keying and changes of shape."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame
from keyloom.operators.load import merge


def slice_fields(t: KeyedFrame, fields: list[str]) -> KeyedFrame:
    own = [t.field(f) for f in fields]
    return t.with_df(t.df.select(t.key, *own), fields=own)


def column(t: KeyedFrame, name: str) -> KeyedFrame:
    own = t.field(name)
    return t.with_df(t.df.select(t.key, own), fields=[own], shape="flat" if t.many else "single")


def column_values(t: KeyedFrame, name: str) -> DataFrame:
    return t.df.select(F.explode(t.values(name)).alias(t.field(name)))


def process(t: KeyedFrame, name: str, change: Callable[[Column], Column]) -> KeyedFrame:
    """Change one field in place; of lists, each element."""
    own = t.field(name)
    new = F.transform(own, change) if t.many and own != t.key else change(F.col(own))
    return t.with_df(t.df.withColumn(own, new))


def process_key(t: KeyedFrame, change: Callable[[Column], Column]) -> KeyedFrame:
    """Change the key; of rows that meet in one, the row of the largest old key
    stays."""
    cells = F.struct(*(F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(t.fields)), F.lit(1).alias("one"))
    rows = t.df.select(F.col(f"`{t.key}`").alias("_was"), change(F.col(f"`{t.key}`")).alias("_key"), cells.alias("_c"))
    last = rows.groupBy("_key").agg(F.max_by("_c", "_was").alias("_c"))
    return t.with_df(last.select(F.col("_key").alias(t.key), *(F.col("_c")[f"f{i}"].alias(f) for i, f in enumerate(t.fields))))


def detach(t: KeyedFrame, other: KeyedFrame) -> KeyedFrame:
    """Only the fields that ``other`` has too."""
    return slice_fields(t, [f for f in t.fields if f in other.fields])


def add_fields(t: KeyedFrame, new: dict[str, Column]) -> KeyedFrame:
    made = {k: F.array(v) if t.shape == "double" else v for k, v in new.items()}
    return t.with_df(t.df.withColumns(made), fields=[*t.fields, *new], shape="list" if t.shape == "single" else t.shape)


def rename_field(t: KeyedFrame, old: str, new: str) -> KeyedFrame:
    own = t.field(old)
    return t.with_df(t.df.withColumnRenamed(own, new), key=new if own == t.key else t.key, fields=[new if f == own else f for f in t.fields])


def rekey(t: KeyedFrame, key: str, fields: list[str] | None = None, zipped: bool = False) -> KeyedFrame:
    """A field becomes the key. Each of its values gets the row, or, zipped,
    the i-th elements of the other fields (the first where there is none). Rows
    that meet in a key are merged, in the order of the old key."""
    new = t.field(key)
    own = [t.field(f) for f in fields] if fields is not None else [t.key, *(f for f in t.fields if f != new)]
    as_lists = {f: (F.array(f) if f == t.key or not t.many else F.col(f)) for f in own}
    rows = t.df.select(F.col(t.key).alias("_was"), *(c.alias(f"_{f}") for f, c in as_lists.items()), F.posexplode(t.values(new)).alias("_i", new))
    pick = (lambda f: F.array(F.coalesce(F.get(f"_{f}", F.col("_i")), F.get(f"_{f}", F.lit(0))))) if zipped else (lambda f: F.col(f"_{f}"))
    if not zipped:
        rows = rows.groupBy("_was", new).agg(F.min("_i").alias("_i"), *(F.any_value(f"_{f}").alias(f"_{f}") for f in own)) if t.many else rows
    return merge(rows.select(new, "_was", "_i", *(pick(f).alias(f) for f in own)), new, own, ["_was", "_i"])


def to_list(t: KeyedFrame) -> KeyedFrame:
    """The first element of each list."""
    return t.with_df(t.df.select(t.key, *(F.get(f, F.lit(0)).alias(f) for f in t.fields)), shape="list") if t.many else t.with_df(t.df, shape="list")


def to_single(t: KeyedFrame) -> KeyedFrame:
    own = slice_fields(to_list(t), t.fields[:1])
    return own.with_df(own.df, shape="single")


def to_flat(t: KeyedFrame, name: str = "values") -> KeyedFrame:
    """All values of all fields, field by field."""
    return KeyedFrame(t.df.select(t.key, F.concat(*(t.values(f) for f in t.fields)).alias(name)), t.key, [name], "flat")


def to_double(t: KeyedFrame) -> KeyedFrame:
    if t.many:
        return t.with_df(t.df, shape="double")
    return t.with_df(t.df.select(t.key, *(F.array(f).alias(f) for f in t.fields)), shape="double")


def records(t: KeyedFrame, expand: bool = False) -> DataFrame:
    """A row for each zipped position (``_i``); with ``expand`` lists of one
    element are repeated to the full length."""
    sizes = F.greatest(*(F.size(f) for f in t.fields)) if len(t.fields) > 1 else F.size(t.fields[0])
    cells = [F.when(F.size(f) == 1, F.array_repeat(F.get(f, F.lit(0)), sizes)).otherwise(F.col(f)).alias(f) if expand else F.col(f) for f in t.fields]
    rows = t.df.select(t.key, *cells)
    return rows.select(t.key, F.posexplode(F.arrays_zip(*t.fields)).alias("_i", "_r")).select(t.key, "_i", *(F.col("_r")[f].alias(f) for f in t.fields))


def unzip_replicates(t: KeyedFrame) -> KeyedFrame:
    """Each zipped record under the key ``key(i)``."""
    rows = records(t).withColumn(t.key, F.concat(F.col(t.key).cast("string"), F.lit("("), F.col("_i"), F.lit(")")))
    return KeyedFrame(rows.drop("_i"), t.key, t.fields, "list")


def unzip(t: KeyedFrame, name: str, sep: str = ":", keep: bool = False) -> KeyedFrame:
    """Each zipped record under ``key<sep>value`` of the named field."""
    own = t.field(name)
    rows = records(t).withColumn(t.key, F.concat_ws(sep, F.col(t.key).cast("string"), F.col(own).cast("string")))
    fields = [f for f in t.fields if keep or f != own]
    return merge(rows, t.key, fields, ["_i"])


def zip_keys(t: KeyedFrame, name: str, sep: str = ":") -> KeyedFrame:
    """The inverse: what follows ``sep`` in the key becomes a field."""
    fields = [name, *t.fields]
    own = to_double(t)
    size = F.size(own.fields[0])
    rows = own.df.select(
        F.col(t.key).alias("_was"),
        F.substring_index(t.key, sep, 1).alias(t.key),
        F.array_repeat(F.substring_index(F.col(t.key), sep, -1), size).alias(name),
        *t.fields,
    )
    return merge(rows, t.key, fields, ["_was"])


def remove_duplicates(t: KeyedFrame) -> KeyedFrame:
    """Distinct zipped records of each key, in order of first occurrence."""
    once = F.array_distinct(F.arrays_zip(*t.fields))
    rows = t.df.select(t.key, once.alias("_r"))
    return t.with_df(rows.select(t.key, *(F.col("_r")[f].alias(f) for f in t.fields)))


def melt(t: KeyedFrame, variable: str = "variable", value: str = "value") -> DataFrame:
    return t.df.unpivot(t.key, t.fields, variable, value)


def pivot(df: DataFrame, key: str, variable: str, value: Column, names: list) -> KeyedFrame:
    """Long to wide, with the columns named beforehand (so no job looks for
    them)."""
    wide = df.groupBy(key).pivot(variable, names).agg(value)
    return KeyedFrame(wide, key, [str(n) for n in names], "list")


def transpose(t: KeyedFrame, keys: list, key: str = "field") -> KeyedFrame:
    """Fields become keys; ``keys`` are the rows that become fields."""
    return pivot(melt(t, key, "_v"), key, t.key, F.first("_v", ignorenulls=True), keys)


def read_matrix(t: KeyedFrame, field: str = "ID", value: str = "Value", others: list[str] = ()) -> KeyedFrame:
    """A wide table of scalars as a double one: for each key the names of its
    fields and their values; ``others`` are kept beside, as lists of one."""
    wide = [f for f in t.fields if f not in others]
    cells = [F.array(*(F.lit(f) for f in wide)).alias(field), F.array(*(F.col(f"`{f}`") for f in wide)).alias(value)]
    return KeyedFrame(t.df.select(t.key, *cells, *(F.array(f"`{o}`").alias(o) for o in others)), t.key, [field, value, *others], "double")


def matrix_melt(t: KeyedFrame, field: str = "ID", value: str = "Value", others: list[str] = ()) -> KeyedFrame:
    """The same as a row for each cell, keyed ``row~column``, with both parts
    as fields."""
    rows = t.df.unpivot([t.key, *others], [f for f in t.fields if f not in others], field, value)
    name = f"{t.key}~{field}"
    pair = F.concat_ws("~", F.col(f"`{t.key}`").cast("string"), field)
    return KeyedFrame(rows.select(pair.alias(name), value, *others, t.key, field), name, [value, *others, t.key, field], "list")


def melt_records(t: KeyedFrame, fields: list[str] | None = None) -> DataFrame:
    """A row ``key:i`` for each zipped record, with the key as a field; records
    that hold nothing are left out."""
    own = slice_fields(t, fields or t.fields)
    rows = records(own).where(F.coalesce(*(F.col(f"`{f}`").cast("string") for f in own.fields)).isNotNull())
    return rows.select(F.concat_ws(":", F.col(t.key).cast("string"), "_i").alias("ID"), t.key, *own.fields)


def flat_to_double(t: KeyedFrame, sep: str = "|") -> KeyedFrame:
    """All values of a flat table as one cell of text."""
    own = t.fields[0]
    return t.with_df(t.df.select(t.key, F.array_join(F.transform(own, lambda x: x.cast("string")), sep).alias(own)), shape="list")


def zip_fields(lists: list[Column]) -> Column:
    """The i-th elements of all lists as one list, as long as the first; a
    first list of one element is repeated to the longest."""
    first, rest = lists[0], lists[1:]
    longest = F.greatest(*(F.size(x) for x in lists)) if rest else F.size(first)
    first = F.when(F.size(first) == 1, F.array_repeat(F.get(first, F.lit(0)), longest)).otherwise(first)
    return F.transform(first, lambda x, i: F.array(x, *(F.get(r, i) for r in rest)))


def append_zipped(lists: Column, new: Column) -> Column:
    """Each of ``lists`` with the element of ``new`` at its place; of no lists,
    the elements as lists of one."""
    grown = F.transform(lists, lambda x, i: F.concat(x, F.array(F.get(new, i))))
    return F.when(F.size(lists) == 0, F.transform(new, lambda x: F.array(x))).otherwise(grown)


def merge_zip(t: KeyedFrame, other: KeyedFrame) -> KeyedFrame:
    """The table with another's rows appended to the lists of their key, field
    by field; keys of the other alone are added."""
    parts = []
    for i, x in enumerate((t, other)):
        own = to_double(x)
        parts.append(own.df.select(F.col(x.key).alias(t.key), F.lit(i).alias("_turn"), *(F.col(f"`{b}`").alias(a) for a, b in zip(t.fields, x.fields))))
    return merge(parts[0].unionByName(parts[1]), t.key, t.fields, ["_turn"])


def zip_new(t: KeyedFrame, rows: DataFrame) -> KeyedFrame:
    """``rows``: key and one value for each field, appended to its lists."""
    return merge_zip(t, KeyedFrame(rows, rows.columns[0], rows.columns[1:], "list"))


def logical_matrix(t: KeyedFrame) -> KeyedFrame:
    """Scalar cells as numbers: true is 1, false 0, other text null."""
    low = lambda f: F.lower(F.col(f"`{f}`").cast("string"))
    return t.with_df(t.df.select(t.key, *(F.when(low(f) == "true", 1.0).when(low(f) == "false", 0.0).otherwise(low(f).try_cast("double")).alias(f) for f in t.fields)))


def joined_cells(t: KeyedFrame, sep: str = ", ") -> KeyedFrame:
    """Lists as text; in text, pipes as the separator."""
    own = lambda f: F.array_join(F.transform(f, lambda x: x.cast("string")), sep) if t.many else F.replace(F.col(f"`{f}`").cast("string"), F.lit("|"), F.lit(sep))
    return t.with_df(t.df.select(t.key, *(own(f).alias(f) for f in t.fields)), shape="list")


def field_classes(t: KeyedFrame) -> DataFrame:
    """(field, class) by the text of a present value, that of the smallest
    key: logical, numeric, date or character; null without values."""
    first = {f: F.min(F.when(F.coalesce(F.get(t.values(f), F.lit(0)).cast("string"), F.lit("")) != "", F.struct(F.col(f"`{t.key}`"), F.get(t.values(f), F.lit(0)).cast("string").alias("v"))))["v"] for f in t.fields}
    v = F.col("value")
    kind = F.when(F.lower(v).isin("true", "false"), "logical").when(v.rlike(r"^\s*[-+]?[0-9]*\.?[0-9]+([eE][-+]?[0-9]+)?\s*$"), "numeric").when(v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), "date").when(v.isNotNull(), "character")
    wide = t.df.agg(*(c.alias(f) for f, c in first.items()))
    return wide.unpivot([], t.fields, "field", "value").select("field", kind.alias("class"))


def permute(df: DataFrame, order: list[int] | dict[int, int]) -> DataFrame:
    """Columns in the order of their positions, or with pairs swapped."""
    at = list(range(len(df.columns)))
    if isinstance(order, dict):
        for a, b in order.items():
            at[a], at[b] = at[b], at[a]
    else:
        at = order
    return df.select(*(F.col(f"`{df.columns[i]}`") for i in at))


def rekey_lines(t: KeyedFrame, key: str, fields: list[str], zipped: bool = False) -> DataFrame:
    """As ``rekey``, without merging the rows that meet."""
    new = t.field(key)
    rows = t.df.select(F.col(f"`{t.key}`").alias("_was"), *(F.col(f"`{f}`").alias(f"_{f}") for f in fields), F.posexplode(t.values(new)).alias("_i", new))
    pick = (lambda f: F.coalesce(F.get(f"_{f}", F.col("_i")), F.get(f"_{f}", F.lit(0)))) if zipped else (lambda f: F.col(f"_{f}"))
    return rows.select(new, *(pick(f).alias(f) for f in fields))


def one_hot(t: KeyedFrame, name: str, values: list) -> KeyedFrame:
    own = t.values(name)
    return KeyedFrame(t.df.select(t.key, *(F.array_contains(own, v).alias(str(v)) for v in values)), t.key, [str(v) for v in values], "list")
