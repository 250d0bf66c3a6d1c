"""Row selection: criteria, the condition language, filter stacks, indices."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame
from keyloom.plans.tasks import files_of, persist

_COMPARE: dict[str, Callable] = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}


def condition(value: Column, said) -> Column:
    """One value against a condition: true or false, ``/regexp/``, ``>=3``,
    ``!`` before any of these, a list of which one must hold, or equality."""
    if isinstance(said, (list, tuple, set, frozenset)):
        return reduce(lambda a, b: a | b, [condition(value, s) for s in said], F.lit(False))
    if isinstance(said, re.Pattern):
        return value.cast("string").rlike(said.pattern)
    if isinstance(said, str):
        if said.startswith("!"):
            return ~condition(value, said[1:])
        if said in ("true", "false"):
            yes = value.cast("string").isin("", "false")
            return yes if said == "false" else ~yes
        if len(said) > 1 and said[0] == said[-1] == "/":
            return value.cast("string").rlike(said[1:-1])
        if found := re.fullmatch(r"([<>]=?)\s*(-?[\d.]+(?:[eE][-+]?\d+)?)", said):
            return _COMPARE[found[1]](value.try_cast("double"), F.lit(float(found[2])))
    if isinstance(said, (int, float)) and not isinstance(said, bool):
        return value.try_cast("double") == F.lit(float(said))
    return value.cast("string") == str(said)


def _any(t: KeyedFrame, names: list, test: Callable[[Column], Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.exists(t.values(n), lambda x: F.coalesce(test(x), F.lit(False))) for n in names])


def criterion(t: KeyedFrame, what) -> Column:
    """A row's test. ``what``: a regexp or values for the key or any field; a
    Column; or a dict of fields, each with a set of values, a regexp, a
    comparison (of the first value), a count (at least so many values), a
    function of the field's array, or a value."""
    if isinstance(what, Column):
        return what
    if not isinstance(what, dict):
        return _any(t, [t.key, *t.fields], lambda x: condition(x, what))
    tests = []
    for name, said in what.items():
        values = t.values(name)
        if callable(said):
            tests.append(said(values))
        elif isinstance(said, int) and not isinstance(said, bool):
            tests.append(F.size(values) >= said)
        elif isinstance(said, str) and re.match(r"[<>]", said):
            tests.append(condition(F.get(values, F.lit(0)), said))
        else:
            tests.append(_any(t, [name], lambda x, said=said: condition(x, said)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def select(t: KeyedFrame, what, invert: bool = False) -> KeyedFrame:
    holds = F.coalesce(criterion(t, what), F.lit(False))
    return t.with_df(t.df.where(~holds if invert else holds))


def subset(t: KeyedFrame, keys: DataFrame, invert: bool = False) -> KeyedFrame:
    """Rows whose key is in the first column of ``keys``, or isn't."""
    own = keys.select(F.col(keys.columns[0]).alias(t.key))
    return t.with_df(t.df.join(own, t.key, "left_anti" if invert else "left_semi"))


class FilterStack:
    """Filters that all hold; the last is taken off first."""

    def __init__(self, table: KeyedFrame):
        self.table, self.filters = table, []

    def add(self, name: str, said) -> FilterStack:
        self.filters.append((name, said))
        return self

    def pop(self) -> FilterStack:
        self.filters.pop()
        return self

    def reset(self) -> FilterStack:
        self.filters.clear()
        return self

    def rows(self) -> KeyedFrame:
        return reduce(lambda t, f: t.with_df(t.df.where(_any(t, [f[0]], lambda x: condition(x, f[1])))), self.filters, self.table)

    def ids(self) -> DataFrame:
        return self.rows().df.select(self.table.key).orderBy(self.table.key)

    def stored_ids(self, root: str, check: list[str] = ()) -> DataFrame:
        """The same, kept under a folder for each table and stack of filters,
        and found anew when any file of the paths to ``check`` has changed (by
        default those that the table is read from)."""
        spark = self.table.df.sparkSession
        about = {"key": self.table.key, "files": files_of(self.table.df), "filters": [[n, repr(s)] for n, s in self.filters]}
        return persist(spark, root, "filter", about, lambda: self.ids(), check=list(check) or files_of(self.table.df))


def field_index(t: KeyedFrame, name: str) -> DataFrame:
    """Each value of a field with its sorted keys."""
    rows = t.df.select(t.key, F.explode(t.values(name)).alias("value"))
    return rows.groupBy("value").agg(F.sort_array(F.collect_set(t.key)).alias("keys"))


def index_select(t: KeyedFrame, wanted: dict[str, list]) -> DataFrame:
    """Keys with one of the values in every named field."""
    hits = [t.df.where(F.arrays_overlap(t.values(n), F.array(*map(F.lit, v)))).select(t.key) for n, v in wanted.items()]
    return reduce(lambda a, b: a.intersect(b), hits)


def grep(lines: DataFrame, patterns: list[str], column: str = "value", invert: bool = False, fixed: bool = False) -> DataFrame:
    tests = [F.col(column).contains(p) if fixed else F.col(column).rlike(p) for p in patterns]
    holds = reduce(lambda a, b: a | b, tests)
    return lines.where(~holds if invert else holds)


def select_by_name(t: KeyedFrame, name: str, names: DataFrame, said) -> KeyedFrame:
    """Rows with a value of the field whose name, by ``names`` (id, name),
    meets the condition: the ids are found first and joined."""
    own = t.field(name)
    ids = names.toDF("_id", "_name").where(condition(F.col("_name"), said)).select("_id").distinct()
    if not t.many or own == t.key:
        return t.with_df(t.df.join(ids, F.col(f"`{own}`") == F.col("_id"), "left_semi"))
    hit = t.df.select(F.col(f"`{t.key}`").alias("_hit"), F.explode(own).alias("_id")).join(ids, "_id", "left_semi").select("_hit")
    return t.with_df(t.df.join(hit, F.col(f"`{t.key}`") == F.col("_hit"), "left_semi"))


def choose(values: Column, mask: Column) -> Column:
    """The values at the true places of a mask."""
    return F.transform(F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: F.coalesce(x["m"], F.lit(False))), lambda x: x["v"])


def keep_values(t: KeyedFrame, name: str, said, invert: bool = False) -> KeyedFrame:
    """Of the field's lists only the values that meet the condition, or only
    the others; rows stay."""
    own = t.field(name)
    holds = lambda x: F.coalesce(condition(x, said), F.lit(False))
    return t.with_df(t.df.withColumn(own, F.filter(own, lambda x: ~holds(x) if invert else holds(x))))
