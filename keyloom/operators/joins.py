"""Attaching tables to each other, pasting, and translation of identifiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame, same_field
from keyloom.operators.aggregates import collapse, numbered
from keyloom.operators.load import end_to_end
from keyloom.operators.shape import rekey, to_double, to_list


def _new_fields(a: KeyedFrame, b: KeyedFrame, fields: list[str] | None) -> list[str]:
    if fields is not None:
        return [b.field(f) for f in fields]
    return [f for f in b.fields if not any(same_field(f, x) for x in [a.key, *a.fields])]


def attach(a: KeyedFrame, b: KeyedFrame, fields: list[str] | None = None, one2one: bool = False, complete: bool = False, fill=None, index: DataFrame | None = None) -> KeyedFrame:
    """``a`` with ``b``'s new fields: by the same key, by ``b``'s key being one
    of ``a``'s fields, or over an index of (key, other key)."""
    b = to_list(b) if one2one else b
    own = _new_fields(a, b, fields)
    if index is not None:
        return attach_index(a, b, index, own)
    if same_field(a.key, b.key):
        return attach_same_key(a, b, own, complete, fill)
    for f in a.fields:
        if same_field(f, b.key):
            return attach_source_key(a, b, f, own)
    raise ValueError(f"{b.key!r} is neither the key nor a field: name the index or the steps")


def attach_same_key(a: KeyedFrame, b: KeyedFrame, fields: list[str], complete: bool = False, fill=None) -> KeyedFrame:
    """A left join (with ``complete`` a full one, filled). Of a field that both
    have, lists are concatenated, and of scalars ``a``'s counts where it has
    one; unmatched list cells are empty lists."""
    common = [f for f in fields if f in a.fields]
    new = [f for f in fields if f not in a.fields]
    right = b.df.select(F.col(b.key).alias(a.key), *new, *(F.col(f"`{f}`").alias(f"_b_{f}") for f in common))
    rows = a.df.join(right, a.key, "full" if complete else "left")
    if a.many or b.many:
        rows = rows.withColumns({f: F.coalesce(f, F.array()) for f in [*(a.fields if a.many else []), *(new if b.many else [])]})
    both = lambda f: F.concat(f, F.coalesce(f"_b_{f}", F.array())) if a.many else F.coalesce(f, f"_b_{f}")
    rows = rows.select(a.key, *(both(f).alias(f) if f in common else f"`{f}`" for f in a.fields), *(f"`{f}`" for f in new))
    if complete and fill is not None:
        rows = rows.fillna(fill)
    return a.with_df(rows, fields=[*a.fields, *new])


def attach_source_key(a: KeyedFrame, b: KeyedFrame, source: str, fields: list[str]) -> KeyedFrame:
    """Look up each value of ``source`` in ``b``; of a list the results are
    concatenated in its order, without misses."""
    right = b.df.select(F.col(b.key).alias("_k"), F.struct(*fields).alias("_v"))
    if not a.many:
        rows = a.df.join(right, F.col(source) == F.col("_k"), "left")
        return a.with_df(rows.select(a.key, *a.fields, *(F.col("_v")[f].alias(f) for f in fields)), fields=[*a.fields, *fields])
    # The row's own cells travel with its first value only, and come back in
    # the same aggregation: no join on the key.
    values = a.df.select(a.key, F.struct(*a.fields).alias("_own"), F.posexplode_outer(source).alias("_i", "_k"))
    values = values.withColumn("_own", F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_own")))
    found = values.join(right, "_k", "left").groupBy(a.key).agg(F.first("_own", ignorenulls=True).alias("_own"), F.sort_array(F.collect_list(F.when(F.col("_v").isNotNull(), F.struct("_i", "_v")))).alias("_h"))
    cell = lambda f: end_to_end(F.col("_h")["_v"][f]) if b.many else F.col("_h")["_v"][f]
    return a.with_df(found.select(a.key, *(F.col("_own")[f].alias(f) for f in a.fields), *(F.coalesce(cell(f), F.array()).alias(f) for f in fields)), fields=[*a.fields, *fields])


def attach_index(a: KeyedFrame, b: KeyedFrame, index: DataFrame, fields: list[str]) -> KeyedFrame:
    """``index``: (key of a, key of b), any number of each. Keys of ``a`` with
    the same keys of ``b`` share one list of hits, which is gathered once; only
    keys are dealt out for each row."""
    own = index.toDF(a.key, "_k").where("_k is not null").distinct().groupBy(a.key).agg(F.sort_array(F.collect_list("_k")).alias("_s"))
    sets = own.groupBy("_s").agg(F.min(a.key).alias("_of"))
    hits = sets.select("_of", F.explode("_s").alias("_k")).join(b.df.select(F.col(b.key).alias("_k"), *fields), "_k")
    found = hits.groupBy("_of").agg(F.sort_array(F.collect_list(F.struct("_k", *fields))).alias("_h"))
    cell = lambda f: end_to_end(F.col("_h")[f]) if b.many else F.col("_h")[f]
    lists = sets.join(found, "_of").select("_s", *(F.coalesce(cell(f), F.array()).alias(f) for f in fields))
    rows = a.df.join(own, a.key, "left").join(lists, "_s", "left").withColumns({f: F.coalesce(f, F.array()) for f in fields})
    return a.with_df(rows.select(a.key, *a.fields, *fields), fields=[*a.fields, *fields])


def attach_steps(start: DataFrame, steps: list[tuple[KeyedFrame, str]]) -> DataFrame:
    """A chain of left joins: each step's table is looked up by its key with
    the values of the named column of what the chain has so far."""
    for t, link in steps:
        start = start.join(t.df.withColumnRenamed(t.key, link) if t.key != link else t.df, link, "left")
    return start


def compose_index(pairs: list[DataFrame]) -> DataFrame:
    """Indices of two columns each, from the first's ids to the last's, by way
    of those between."""
    out = pairs[0].toDF("from", "_to")
    for p in pairs[1:]:
        out = out.join(p.toDF("_to", "_next"), "_to").select("from", F.col("_next").alias("_to")).distinct()
    return out.withColumnRenamed("_to", "to")


def translation_index(tables: list[DataFrame], source: str, target: str) -> DataFrame:
    """(source, target) from the first table that has both columns, else from
    two that share a column."""
    known = lambda df, a, b: df.select(a, b).where(F.col(f"`{a}`").isNotNull() & F.col(f"`{b}`").isNotNull()).distinct()
    for t in tables:
        if {source, target} <= set(t.columns):
            return known(t, source, target)
    for t in tables:
        for other in tables:
            shared = [c for c in t.columns if c in other.columns]
            if t is not other and shared and source in t.columns and target in other.columns:
                return compose_index([known(t, source, shared[0]), known(other, shared[0], target)]).toDF(source, target)
    raise ValueError(f"no two tables lead from {source} to {target}; plans.identifiers.equivalence takes any number")


def paste(tables: list[KeyedFrame], all_match: bool = False, missing: str | None = None, prefixes: list[str] | None = None, same_fields: bool = False, sep: str = "|") -> KeyedFrame:
    """A full outer join of all tables on the key (or, with ``all_match``, an
    inner one). ``same_fields``: the tables have the same fields, and a key's
    cells are joined, table by table."""
    key = tables[0].key
    if same_fields:
        parts = [t.df.select(F.col(t.key).alias(key), F.lit(i).alias("_turn"), *tables[0].fields) for i, t in enumerate(tables)]
        return collapse(reduce(DataFrame.unionByName, parts), key, tables[0].fields, ["_turn"], sep)
    named = []
    for i, t in enumerate(tables):
        p = f"{prefixes[i]}:" if prefixes else ""
        named.append(t.df.select(F.col(t.key).alias(key), *(F.col(f).alias(p + f) for f in t.fields)))
    rows = reduce(lambda x, y: x.join(y, key, "inner" if all_match else "full"), named)
    fields = [c for c in rows.columns if c != key]
    if missing is not None:
        rows = rows.select(key, *(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit(missing)).alias(f) for f in fields))
    return KeyedFrame(rows, key, fields, tables[0].shape)


def merge_different_fields(a: DataFrame, b: DataFrame, key: str, order: list[str]) -> KeyedFrame:
    """A full outer join of two frames with different fields; cells of a key
    that is repeated on one side are joined, and missing ones are empty."""
    sides = [collapse(df, key, [c for c in df.columns if c not in (key, *order)], order) for df in (a, b)]
    return paste(sides, missing="")


def paste_positions(frames: list[DataFrame], orders: list[list[str]]) -> DataFrame:
    """Frames side by side: the n-th row of each, in its order; the first's
    columns stay, later keys (first columns) go."""
    own = [numbered(df, order) for df, order in zip(frames, orders)]
    rest = [df.drop(frames[i].columns[0]) for i, df in enumerate(own) if i]
    return reduce(lambda x, y: x.join(y, "_n", "full"), [own[0], *rest])


def union_keys(a: KeyedFrame, b: KeyedFrame) -> KeyedFrame:
    """Rows of both; of a shared key, ``b``'s."""
    return a.with_df(a.df.join(b.df.select(F.col(b.key).alias(a.key)), a.key, "left_anti").unionByName(b.df.withColumnRenamed(b.key, a.key)))


def translate(t: KeyedFrame, name: str, index: DataFrame, to: str, compact: bool = False) -> KeyedFrame:
    """Replace the identifiers of a field by those that ``index`` (from, to)
    gives; a miss is null, or the row (of a list, the value) goes with
    ``compact``. Where an identifier has several translations the smallest
    counts."""
    own = t.field(name)
    a, b = index.columns
    once = index.groupBy(F.col(f"`{a}`").alias("_from")).agg(F.min(F.col(f"`{b}`")).alias("_to"))
    if t.many and own != t.key:
        rest = [f for f in t.fields if f != own]
        values = t.df.select(t.key, F.struct(F.lit(1).alias("_one"), *rest).alias("_own"), F.posexplode_outer(own).alias("_i", "_from"))
        values = values.withColumn("_own", F.when(F.coalesce("_i", F.lit(0)) == 0, F.col("_own")))
        hit = F.col("_i").isNotNull() & (F.col("_to").isNotNull() if compact else F.lit(True))
        found = values.join(once, "_from", "left").groupBy(t.key).agg(F.first("_own", ignorenulls=True).alias("_own"), F.sort_array(F.collect_list(F.when(hit, F.struct("_i", "_to")))).alias("_h"))
        rows = found.select(t.key, *(F.col("_h")["_to"].alias(own) if f == own else F.col("_own")[f].alias(f) for f in t.fields))
    else:
        rows = t.df.join(once, F.col(f"`{own}`") == F.col("_from"), "inner" if compact else "left").drop("_from").withColumn(own, F.col("_to")).drop("_to")
    rows = rows.withColumnRenamed(own, to)
    return t.with_df(rows, key=to if own == t.key else t.key, fields=[to if f == own else f for f in t.fields])


def change_key(t: KeyedFrame, index: DataFrame, to: str) -> KeyedFrame:
    """The table keyed by what ``index`` (key, new key) gives for its keys:
    each of them, where there are several; rows without one go, and rows that
    meet are merged in the order of the old key."""
    pairs = index.toDF("_k", to).groupBy("_k").agg(F.sort_array(F.collect_set(to)).alias(to))
    wide = to_double(t)
    rows = wide.df.join(pairs, F.col(f"`{t.key}`") == F.col("_k")).select(t.key, *t.fields, to)
    return rekey(KeyedFrame(rows, t.key, [*t.fields, to], "double"), to, t.fields)
