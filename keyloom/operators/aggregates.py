"""Collapsing, value indices, counts and statistics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame
from keyloom.operators.density import modes  # noqa: F401
from keyloom.operators.load import in_order
from keyloom.storage import materialize


def collapse(df: DataFrame, key: str, fields: list[str], order: list[str], sep: str = "|") -> KeyedFrame:
    """A row for each key; the cells of each field joined in order."""
    rows = df.groupBy(key).agg(in_order(fields, order).alias("_r"))
    cells = [F.array_join(F.transform(F.col("_r")[f], lambda x: x.cast("string")), sep, "").alias(f) for f in fields]
    return KeyedFrame(rows.select(key, *cells), key, fields, "list")


def reduce_by(df: DataFrame, key: str, **folds: Column) -> KeyedFrame:
    """A row for each key with one aggregate for each name."""
    return KeyedFrame(df.groupBy(key).agg(*(c.alias(n) for n, c in folds.items())), key, list(folds), "list")


def _marked(values: Column, **marks: Column) -> Column:
    return F.transform(values, lambda x: F.struct(x.cast("string").alias("value"), *(c.alias(n) for n, c in marks.items())))


def value_index(t: KeyedFrame, fields: list[str] | None = None, ordered: bool = False) -> DataFrame:
    """Each value of the fields with the first key that has it: the smallest
    key or, ``ordered``, the smallest of the first field."""
    names = [t.field(f) for f in fields] if fields else t.fields
    parts = F.concat(*(_marked(t.values(f), turn=F.lit(i)) for i, f in enumerate(names)))
    rows = t.df.select(t.key, F.explode(parts).alias("x")).select(t.key, "x.value", "x.turn")
    return rows.groupBy("value").agg(F.min_by(t.key, F.struct("turn", t.key)).alias(t.key) if ordered else F.min(t.key).alias(t.key))


def field_matches(t: KeyedFrame, wanted: DataFrame) -> DataFrame:
    """For each field (the key too): how many distinct wanted values it has.
    ``wanted`` has one column, ``value``."""
    parts = [_marked(t.values(f), field=F.lit(f)) for f in [t.key, *t.fields]]
    rows = t.df.select(F.explode(F.concat(*parts)).alias("x")).select("x.field", "x.value").distinct()
    return rows.join(wanted.select("value").distinct(), "value").groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def guess_field(t: KeyedFrame, wanted: DataFrame) -> str | None:
    best = field_matches(t, wanted).orderBy(F.desc("n"), "field").limit(1).collect()
    return best[0].field if best else None


def counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, and its share."""
    own = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = own.agg(F.sum("n").alias("total"))  # one row
    return own.join(F.broadcast(total)).select(column, "n", (F.col("n") / F.col("total")).alias("share"))


def key_counts(t: KeyedFrame) -> DataFrame:
    """For each key how many values each field has."""
    return t.df.select(t.key, *(F.size(t.values(f)).cast("long").alias(f) for f in t.fields))


def consolidated(df: DataFrame, by: str | None, lists: str, order: list[str]) -> DataFrame:
    """The lists of all rows (of each group) one after the other, in the order;
    null lists add nothing."""
    rows = df.groupBy(*([by] if by else [])).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(lists).alias("_l")))).alias("_r"))
    own = F.flatten(F.transform(F.filter("_r", lambda x: x["_l"].isNotNull()), lambda x: x["_l"]))
    return rows.select(*([by] if by else []), own.alias(lists))


def row_counts(t: KeyedFrame) -> DataFrame:
    """One row: how many rows, keys, and values of each field there are."""
    sizes = [F.coalesce(F.sum(F.size(t.values(f))), F.lit(0)).alias(f) for f in t.fields]
    return t.df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(F.col(f"`{t.key}`")).alias("keys"), *sizes)


def statistics(df: DataFrame, by: str, value: str) -> DataFrame:
    """Sum, mean, exact median, variance and deviation (null below three
    rows). The median comes from ``medians``, which spreads a group over
    tasks; the rest is added up before the shuffle."""
    exact = F.sum(F.col(value).cast("decimal(20,4)")).cast("double")
    n = F.count(F.lit(1))
    own = df.groupBy(by).agg(n.alias("n"), exact.alias("total"), F.avg(value).alias("mean"), F.when(n >= 3, F.var_samp(value)).alias("variance"), F.when(n >= 3, F.stddev_samp(value)).alias("sd"), F.min(value).alias("low"), F.max(value).alias("high"))
    middle = medians(df, by, value).withColumnRenamed(by, "_by")
    return own.join(middle, own[by].eqNullSafe(middle["_by"]), "left").select(by, "n", "total", "mean", "median", "variance", "sd", "low", "high")


def medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, median): exact, of the values that aren't null. Equal values are
    counted before the shuffle, and the counts of a group are ordered over
    range partitions, so no task holds a whole group."""
    counted = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_c"))
    ordered = cumulated(counted, [by, value], by, "_c")
    n = ordered.groupBy(by).agg(F.sum("_c").alias("_n")).withColumnRenamed(by, "_by")
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)
    holds = lambda at: (F.col("_before") <= at) & (at < F.col("_before") + F.col("_c"))
    joined = ordered.join(n, ordered[by].eqNullSafe(n["_by"])).where(holds(low) | holds(high))
    return joined.groupBy(by).agg(F.avg(value).alias("median"))


def incidence(df: DataFrame, source: str, target: str, targets: list, value: str | None = None) -> DataFrame:
    """source x target: 1 where a pair occurs, else 0; or the largest
    ``value`` of the pair, else null."""
    cell = (lambda x: F.max(F.when(F.col(target) == x, F.col(value)))) if value else (lambda x: F.max(F.when(F.col(target) == x, 1).otherwise(0)))
    return df.groupBy(source).agg(*(cell(x).alias(str(x)) for x in targets))


def memberships(df: DataFrame, item: str, group: str, groups: list) -> DataFrame:
    """How many items are in each exact combination of groups (Venn regions)."""
    flags = df.groupBy(item).agg(*(F.max((F.col(group) == g).cast("int")).alias(g) for g in groups))
    return flags.where(reduce(lambda a, b: a | b, [F.col(g) == 1 for g in groups])).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))


def compare(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """Counts of common and of own values."""
    both = a.select(column).distinct().withColumn("a", F.lit(1)).join(b.select(column).distinct().withColumn("b", F.lit(1)), column, "full")
    n = lambda test: F.count(F.when(test, 1))
    return both.agg(n(F.expr("a = 1 and b = 1")).alias("common"), n(F.col("b").isNull()).alias("only_first"), n(F.col("a").isNull()).alias("only_second"))


def _log_factorials(n: np.ndarray) -> np.ndarray:
    """log n!, by Stirling's series; exact sums for small n."""
    n = np.asarray(n, np.float64)
    small = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, 64)))))
    x = np.maximum(n, 32) + 1
    series = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return np.where(n < 64, small[np.minimum(n, 63).astype(int)], series)


def hypergeometric_tails(k: np.ndarray, drawn: np.ndarray, good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The chance of k or more good ones among those drawn, for many cases at
    once. Terms fall from the mode on, so those beyond where they vanish aren't
    added up; the cases go by how many terms they need."""
    choose = lambda n, r: _log_factorials(n) - _log_factorials(r) - _log_factorials(n - r)
    low, high = np.maximum(0, drawn - total + good), np.minimum(good, drawn)
    out = np.where(k <= low, 1.0, 0.0)
    middle = drawn * (good / total)
    spread = 40 * np.sqrt(1 + middle * (1 - good / total)) + 64
    terms = np.minimum(high, (np.maximum(k, middle) + spread).astype(np.int64)) - k + 1
    left = np.flatnonzero((k > low) & (k <= high))
    left = left[np.argsort(terms[left], kind="stable")]
    while len(left):
        # As many cases as a block of a million terms has room for.
        n = max(1, min(len(left), int(np.searchsorted(terms[left] * np.arange(1, len(left) + 1), 1 << 20, "right"))))
        own, left = left[:n], left[n:]
        at = k[own, None] + np.arange(terms[own].max())[None, :]
        inside = at < (k + terms)[own, None]
        safe = np.where(inside, at, k[own, None])
        g, d, t = good[own, None], drawn[own, None], total[own, None]
        chance = np.exp(choose(g, safe) + choose(t - g, d - safe) - choose(t, d))
        out[own] = np.minimum(1.0, np.where(inside, chance, 0.0).sum(1))
    return out


def hypergeometric_tail(k: int, drawn: int, good: int, total: int) -> float:
    """The same of one case."""
    return float(hypergeometric_tails(*(np.array([x], np.int64) for x in (k, drawn, good, total)))[0])


def enrichment(pairs: DataFrame, item: str, term: str, chosen: DataFrame) -> DataFrame:
    """Terms over-represented among the chosen items: k, good, drawn, total,
    p_value. ``pairs`` (item, term); ``chosen`` has the item column."""
    own = pairs.select(item, term).distinct().join(chosen.select(item).distinct().withColumn("_c", F.lit(1)), item, "left")
    sizes = own.groupBy(item).agg(F.max("_c").alias("_c")).agg(F.count(F.lit(1)).alias("total"), F.count("_c").alias("drawn"))
    by_term = own.groupBy(term).agg(F.count(F.lit(1)).alias("good"), F.count("_c").alias("k"))

    @F.pandas_udf("double")
    def tail(k: pd.Series, drawn: pd.Series, good: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series(hypergeometric_tails(*(x.to_numpy(np.int64) for x in (k, drawn, good, total))))

    return by_term.join(F.broadcast(sizes)).withColumn("p_value", tail("k", "drawn", "good", "total"))


def regressions(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Least squares in each group: slope, intercept and n."""
    return df.groupBy(by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n"))


def in_ranges(df: DataFrame, order: list) -> DataFrame:
    """Rows sorted over range partitions and written so, with ``_m``: the
    partition's number times 2^33 plus the row's place in it. Written, because
    a plan that ranges a table twice may cut it differently each time."""
    return materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()), "ranges")


def numbered(df: DataFrame, order: list, name: str = "_n") -> DataFrame:
    """Rows numbered from 1 in a total order, without one task that sees all:
    each range partition starts after the sizes of those before it (one row
    for each partition)."""
    ranged = in_ranges(df, order)
    part = F.shiftright("_m", 33)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c")).select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    place = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_b") + 1
    return ranged.join(F.broadcast(sizes), part == F.col("_p")).withColumn(name, place.cast("long")).drop("_p", "_m", "_b")


def cumulated(df: DataFrame, order: list[str], by: str, value: str) -> DataFrame:
    """Rows with ``_before``: the sum of ``value`` over the rows of their group
    that come before them. ``order`` starts with ``by``; a group may span range
    partitions, of which each hands on one row for each group."""
    ranged = in_ranges(df, order).withColumn("_p", F.shiftright("_m", 33))
    inside = F.sum(value).over(Window.partitionBy("_p", by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    before = Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(by, "_p").agg(F.sum(value).alias("_s")).select(F.col(by).alias("_by"), F.col("_p").alias("_q"), F.sum("_s").over(before).alias("_b"))
    joined = ranged.withColumn("_i", inside).join(sums, (F.col("_p") == F.col("_q")) & F.col(by).eqNullSafe(F.col("_by")))
    return joined.withColumn("_before", F.coalesce("_i", F.lit(0)) + F.coalesce("_b", F.lit(0))).drop("_m", "_p", "_q", "_i", "_b", "_by")


def rank_fraction(df: DataFrame, value: str, key: str) -> DataFrame:
    """Position among the non-missing values over their number."""
    known = numbered(df.where(F.col(value).isNotNull()), [value, key])
    total = df.agg(F.count(value).alias("_total"))
    ranked = known.join(F.broadcast(total)).withColumn("rank", F.col("_n") / F.col("_total")).drop("_n", "_total")
    return ranked.unionByName(df.where(F.col(value).isNull()).withColumn("rank", F.lit(None).cast("double")))


def scaled(df: DataFrame, value: str) -> DataFrame:
    """z-score and 0-1 scale, from one row of moments."""
    m = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    v = F.col(value)
    return df.join(F.broadcast(m)).withColumn("z", (v - F.col("_m")) / F.col("_s")).withColumn("unit", (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).drop("_m", "_s", "_lo", "_hi")


def chunks(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """``robin``: position mod n; ``block``: blocks of n in order."""
    own = numbered(df, order).withColumn("_n", F.col("_n") - 1)
    return own.withColumn("robin", F.col("_n") % n).withColumn("block", F.floor(F.col("_n") / n)).drop("_n")


def predicted(df: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Rows with the prediction of their group's line, its residual deviation
    ``se``, and ``filled``: y, or the prediction where y is null. Groups that
    have no line (fewer than two distinct x) predict null."""
    fits = df.groupBy(by).agg(F.regr_slope(y, x).alias("_slope"), F.regr_intercept(y, x).alias("_icept"), F.regr_count(y, x).alias("_n"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy")).withColumnRenamed(by, "_by")
    rows = df.join(fits, df[by].eqNullSafe(fits["_by"]), "left")
    line = F.col("_icept") + F.col("_slope") * F.col(x)
    left = F.greatest(F.col("_syy") - F.col("_slope") * F.col("_sxy"), F.lit(0.0))
    se = F.when(F.col("_n") > 2, F.sqrt(left / (F.col("_n") - 2)))
    return rows.withColumns({"prediction": line, "se": se, "filled": F.coalesce(F.col(y), line)}).select(*df.columns, "prediction", "se", "filled")


def covariance(df: DataFrame, columns: list[str]) -> np.ndarray:
    """The covariance matrix of numeric columns (rows with a null go), in one
    pass; only the matrix reaches the driver."""
    whole = df.select(*(F.col(c).cast("double") for c in columns)).dropna()
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = whole.agg(*(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"]
    return out


def nearest_psd(matrix: np.ndarray) -> np.ndarray:
    """The symmetric matrix without its negative eigenvalues."""
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    return (vectors * np.maximum(values, 0)) @ vectors.T


def components(df: DataFrame, columns: list[str], n: int = 2) -> DataFrame:
    """Rows with ``pc1`` ... ``pcn``: principal components of the columns, of
    which missing values are filled with the mean. A component's sign is the
    one that makes its largest weight positive."""
    means = df.agg(*(F.avg(c).alias(c) for c in columns)).first()
    whole = df.fillna({c: means[c] for c in columns if means[c] is not None}, subset=columns)
    values, vectors = np.linalg.eigh(covariance(whole, columns))
    own = {}
    for i, at in enumerate(np.argsort(-values)[:n]):
        w = vectors[:, at] * np.sign(vectors[np.abs(vectors[:, at]).argmax(), at])
        own[f"pc{i + 1}"] = reduce(lambda a, b: a + b, [(F.col(c) - means[c]) * float(x) for c, x in zip(columns, w)])
    return whole.withColumns(own)
