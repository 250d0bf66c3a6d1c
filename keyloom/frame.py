"""The keyed table: a DataFrame with one key column and named fields.

Shapes: ``single`` (one scalar field), ``list`` (a scalar for each field),
``flat`` (one list) and ``double`` (a list for each field; the i-th elements of
all fields form a zipped record). In a list, null is a missing value and the
empty string a present one; a missing list is null and ``[]`` has no values.

Frames are unordered, so whatever depends on order ("first", zipped positions,
concatenation) takes the order as columns.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHAPES = ("single", "list", "flat", "double")


def inner_name(name: str) -> str:
    """The part in parentheses, by which names match in joins."""
    found = re.search(r"\(([^()]+)\)\s*$", name)
    return found[1] if found else name


def same_field(a: str, b: str) -> bool:
    return a == b or inner_name(a) == inner_name(b)


@dataclass(frozen=True)
class KeyedFrame:
    df: DataFrame
    key: str
    fields: list[str]
    shape: str = "list"
    meta: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.shape not in SHAPES:
            raise ValueError(f"shape is one of {SHAPES}")

    @property
    def many(self) -> bool:
        return self.shape in ("double", "flat")

    def with_df(self, df: DataFrame, **changes) -> KeyedFrame:
        return replace(self, df=df, **changes)

    def field(self, name: str | int | None) -> str:
        """A column by name, position or, for None and "key", the key. A name
        also matches a field that adds something in parentheses."""
        if name in (None, "key", self.key):
            return self.key
        if isinstance(name, int) or (isinstance(name, str) and name.isdigit() and name not in self.fields):
            return self.fields[int(name)]
        if name in self.fields:
            return name
        for f in self.fields:
            if re.sub(r"\s*\([^()]*\)$", "", f) == name:
                return f
        raise KeyError(f"no field {name!r} among {[self.key, *self.fields]}")

    def values(self, name: str | int | None) -> Column:
        """A field's values as an array, whatever the shape; without nulls."""
        own = self.field(name)
        if own == self.key or not self.many:
            return F.when(F.col(f"`{own}`").isNotNull(), F.array(F.col(f"`{own}`"))).otherwise(F.array())
        return F.coalesce(F.filter(F.col(f"`{own}`"), lambda x: x.isNotNull()), F.array())


def keyed(df: DataFrame, key: str, fields: list[str] | None = None, shape: str = "list") -> KeyedFrame:
    own = fields if fields is not None else [c for c in df.columns if c != key]
    return KeyedFrame(df.select(key, *own), key, own, shape)
