"""What becomes of rows that share a key when a table is loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame


def first_wins(df: DataFrame, key: str, fields: list[str], order: list[str]) -> KeyedFrame:
    """The first row of each key: aggregated before the shuffle, no sort."""
    first = df.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_first"))
    return KeyedFrame(first.select(key, *(F.col("_first")[f].alias(f) for f in fields)), key, fields, "list")


def in_order(fields: list[str], order: list[str]) -> Column:
    """All rows of a group in order, as structs."""
    return F.transform(F.sort_array(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v")))), lambda x: x["v"])


def end_to_end(lists: Column) -> Column:
    """The lists of a list as one; missing ones add nothing, and where all are
    missing so is the result."""
    held = F.filter(lists, lambda x: x.isNotNull())
    return F.when((F.size(held) > 0) | (F.size(lists) == 0), F.flatten(held))


def merge(df: DataFrame, key: str, fields: list[str], order: list[str]) -> KeyedFrame:
    """A list for each field: the values of a key's rows in order (lists are
    concatenated)."""
    kinds = dict(df.dtypes)
    rows = df.groupBy(key).agg(in_order(fields, order).alias("_rows"))
    cells = [end_to_end(F.col("_rows")[f]) if kinds[f].startswith("array") else F.col("_rows")[f] for f in fields]
    return KeyedFrame(rows.select(key, *(c.alias(f) for c, f in zip(cells, fields))), key, fields, "double")


def merge_zipped(df: DataFrame, key: str, fields: list[str], order: list[str], first_only: bool = False) -> KeyedFrame:
    """``key`` and the fields hold lists; the i-th key takes the i-th element
    of each field (its first where the list is shorter), and then rows of a key
    are merged or, with ``first_only``, the first stays."""
    rows = df.select(*order, *fields, F.posexplode(key).alias("_i", key))
    taken = [F.coalesce(F.get(f, F.col("_i")), F.get(f, F.lit(0))).alias(f) for f in fields]
    flat = rows.select(key, "_i", *(F.col(o).alias(f"_o{n}") for n, o in enumerate(order)), *taken)
    turn = [*(f"_o{n}" for n in range(len(order))), "_i"]
    return (first_wins if first_only else merge)(flat, key, fields, turn)
