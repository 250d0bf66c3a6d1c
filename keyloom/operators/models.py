"""Linear and logistic models of several predictors, by group.

A linear fit needs a group's moments only: means and covariances, which Spark's
aggregates merge without cancellation. A logistic fit is a few weighted passes of
the same kind. What a task solves is a matrix of one group, as wide as there are
predictors; no rows of a group are gathered.

Rows with a null or non-finite predictor or response take no part in a fit.
Predictors that depend on others linearly are no error: of the equal fits the
one with the smallest coefficients (scaled by their predictor's deviation)
counts. A group without a complete row has no fit, and predictions from it are
null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.storage import materialize


def t_quantile(p: float, freedom: int) -> float:
    """Student's t for whole degrees of freedom: by bisection of the chance's
    finite sum up to 300 of them, beyond by its expansion about the normal."""
    if freedom < 1:
        return float("nan")
    z = _normal_quantile(p)
    if freedom > 300:
        v = float(freedom)
        g = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
        return z + sum(x / v ** (i + 1) for i, x in enumerate(g))

    def inside(t: float) -> float:
        """The chance to lie between -t and t."""
        angle, cos2 = np.arctan(t / freedom**0.5), freedom / (freedom + t * t)
        even = freedom % 2 == 0
        steps = np.arange(1, (freedom - 2) // 2 + 1) if even else np.arange(1, (freedom - 3) // 2 + 1)
        ratio = (2 * steps - 1) / (2 * steps) if even else 2 * steps / (2 * steps + 1)
        series = 1 + np.cumprod(ratio * cos2).sum() if freedom > 1 else 0.0
        if even:
            return float(np.sin(angle) * series)
        return float(2 / np.pi * (angle + np.sin(angle) * np.cos(angle) * series))

    low, high, want = 0.0, 1.0, abs(2 * p - 1)
    while inside(high) < want and high < 1e12:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if inside(middle) < want else (low, middle)
    return float(np.sign(p - 0.5) * low)


def _normal_quantile(p: float) -> float:
    """By bisection of the error function."""
    from math import erf

    low, high = -40.0, 40.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if 0.5 * (1 + erf(middle / 2**0.5)) < p else (low, middle)
    return low


def _complete(df: DataFrame, columns: list[str]) -> Column:
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf")) for c in columns]
    return reduce(lambda a, b: a & b, ok)


def _grouped(df: DataFrame, by: str | None) -> DataFrame:
    """df with its group as _by; all rows are one group without ``by``."""
    return df.withColumn("_by", F.col(f"`{by}`") if by else F.lit(0))


_FIT = "n long, intercept double, coefficients array<double>, means array<double>, inverse array<double>, sigma double, freedom long"


def _pseudo_inverse(matrix: np.ndarray) -> tuple[np.ndarray, int]:
    """Of a positive semidefinite matrix, scaled to a diagonal of ones; and its
    rank."""
    scale = np.sqrt(np.maximum(np.diag(matrix), 0))
    one = np.where(scale > 0, scale, 1.0)
    values, vectors = np.linalg.eigh(matrix / np.outer(one, one))
    real = values > 1e-10 * max(1.0, values.max(initial=0.0))
    inverse = (vectors[:, real] / values[real]) @ vectors[:, real].T
    return inverse / np.outer(one, one), int(real.sum())


def linear(df: DataFrame, by: str | None, y: str, xs: list[str]) -> DataFrame:
    """(_by, n, intercept, coefficients, means, inverse, sigma, freedom): the
    least squares of each group. ``inverse``: of the predictors' centred cross
    products, row by row; ``sigma``: the residual deviation, null without
    degrees of freedom."""
    rows = _grouped(df, by).where(_complete(df, [y, *xs])).select("_by", F.col(y).cast("double").alias("_y"), *(F.col(x).cast("double").alias(f"_x{i}") for i, x in enumerate(xs)))
    names = [f"_x{i}" for i in range(len(xs))]
    cross = [F.covar_pop(a, b) for i, a in enumerate(names) for b in names[i:]]
    moments = rows.groupBy("_by").agg(F.count("_y").alias("n"), F.avg("_y").alias("my"), F.var_pop("_y").alias("vy"), F.array(*(F.avg(c) for c in names)).cast("array<double>").alias("mx"), F.array(*(F.covar_pop(c, "_y") for c in names)).cast("array<double>").alias("cy"), F.array(*cross).cast("array<double>").alias("cx"))
    schema = StructType([moments.schema["_by"], *StructType.fromDDL(_FIT).fields])
    upper = np.triu_indices(len(xs))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, n, my, vy, mx, cy, cx in batch.itertuples(index=False):
                matrix = np.zeros((len(xs), len(xs)))
                matrix[upper] = cx
                matrix = matrix + matrix.T - np.diag(np.diag(matrix))
                inverse, rank = _pseudo_inverse(matrix)
                b = inverse @ np.asarray(cy, float) if len(xs) else np.zeros(0)
                freedom = int(n) - rank - 1
                rest = max(0.0, vy - float(b @ np.asarray(cy, float))) * n
                out.append((group, n, my - float(b @ np.asarray(mx, float)), b.tolist(), list(mx), (inverse / n).ravel().tolist(), (rest / freedom) ** 0.5 if freedom > 0 else None, freedom))
            yield pd.DataFrame(out, columns=schema.names)

    return moments.mapInPandas(solve, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _whole(held: DataFrame, by: str | None) -> DataFrame:
    """One row for all rows goes to these; they aren't dealt out by one key."""
    return F.broadcast(held) if by is None else held


def predict(df: DataFrame, fits: DataFrame, by: str | None, xs: list[str], interval: str | None = None, level: float = 0.9) -> DataFrame:
    """Rows with ``fit``, and with an interval ("confidence" of the mean, or
    "prediction" of a further value) ``lower`` and ``upper`` at the level."""
    if interval not in (None, "confidence", "prediction"):
        raise ValueError("interval is None, confidence or prediction")
    quantile = F.pandas_udf(lambda f: f.map({v: t_quantile(0.5 + level / 2, int(v)) for v in f.unique()}).astype(float), "double")
    held = fits.withColumnRenamed("_by", "_own")
    if interval:
        held = held.withColumn("_t", quantile("freedom"))
    x = F.array(*(F.col(c).cast("double") for c in xs)).cast("array<double>")
    rows = _grouped(df, by).join(_whole(held, by), F.col("_by").eqNullSafe(F.col("_own")), "left")
    fit = F.col("intercept") + _dot(F.col("coefficients"), x)
    out = {"fit": fit}
    if interval:
        away = F.zip_with(x, "means", lambda a, b: a - b)
        k = len(xs)
        form = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + F.get(away, i) * _dot(F.slice("inverse", i * k + 1, F.lit(k)), away)) if k else F.lit(0.0)
        se = F.col("sigma") * F.sqrt((1.0 if interval == "prediction" else 0.0) + 1 / F.col("n") + form)
        out |= {"lower": fit - F.col("_t") * se, "upper": fit + F.col("_t") * se}
    return rows.withColumns(out).select(*(F.col(f"`{c}`") for c in df.columns if c not in out), *out)


def logistic(df: DataFrame, by: str | None, y: str, xs: list[str], passes: int = 25, tolerance: float = 1e-8) -> DataFrame:
    """(_by, n, intercept, coefficients, converged): the chance that y (0 or 1)
    is 1, by iterated weighted least squares; each pass over the rows sums the
    weighted cross products of the groups that still move. Where a predictor
    separates the classes there is no finite fit: such a group ends unconverged
    after so many passes."""
    names = ["_x0", *(f"_x{i + 1}" for i in range(len(xs)))]
    rows = _grouped(df, by).where(_complete(df, [y, *xs])).select("_by", F.col(y).cast("double").alias("_y"), F.lit(1.0).alias("_x0"), *(F.col(x).cast("double").alias(f"_x{i + 1}") for i, x in enumerate(xs)))
    k = len(names)
    upper = np.triu_indices(k)
    # Predictors are scaled by their spread, which changes no chance.
    sizes = rows.groupBy("_by").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.when(F.stddev_pop(c) > 0, F.stddev_pop(c)).otherwise(1.0) for c in names)).alias("scale"))
    state = materialize(sizes.withColumns({"b": F.array_repeat(F.lit(0.0), k), "moved": F.lit(float("inf"))}), "logistic")
    schema = state.schema

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for group, n, scale, b, moved, flat, score in batch.itertuples(index=False):
                if flat is None:
                    out.append((group, n, scale, b, moved))
                    continue
                matrix = np.zeros((k, k))
                matrix[upper] = flat
                matrix = matrix + matrix.T - np.diag(np.diag(matrix))
                step = _pseudo_inverse(matrix)[0] @ np.asarray(score, float)
                out.append((group, n, scale, (np.asarray(b, float) + step).tolist(), float(np.abs(step).max())))
            yield pd.DataFrame(out, columns=schema.names)

    for _ in range(passes):
        moving = state.where(F.col("moved") > tolerance).select(F.col("_by").alias("_own"), "b", "scale")
        if moving.isEmpty():
            break
        x = F.zip_with(F.array(*names), "scale", lambda a, s: a / s)
        held = rows.join(moving, F.col("_by").eqNullSafe(F.col("_own"))).select("_by", "_y", x.alias("x"), "b").withColumn("p", 1 / (1 + F.exp(-F.greatest(F.lit(-35.0), F.least(F.lit(35.0), _dot(F.col("x"), F.col("b")))))))
        weight = F.col("p") * (1 - F.col("p"))
        cross = [F.sum(weight * F.col("x")[i] * F.col("x")[j]) for i in range(k) for j in range(i, k)]
        sums = held.groupBy(F.col("_by").alias("_own")).agg(F.array(*cross).alias("flat"), F.array(*(F.sum((F.col("_y") - F.col("p")) * F.col("x")[i]) for i in range(k))).alias("score"))
        joined = state.join(sums, F.col("_by").eqNullSafe(F.col("_own")), "left").select(*schema.names, "flat", "score")
        state = materialize(joined.mapInPandas(solve, schema), "logistic", instead_of=state)
    b = F.zip_with("b", "scale", lambda v, s: v / s)
    return state.select("_by", "n", F.get(b, F.lit(0)).alias("intercept"), F.slice(b, 2, k).alias("coefficients"), (F.col("moved") <= tolerance).alias("converged"))


def chances(df: DataFrame, fits: DataFrame, by: str | None, xs: list[str]) -> DataFrame:
    """Rows with ``chance``, by a logistic fit."""
    out = predict(df, fits, by, xs)
    return out.withColumn("chance", 1 / (1 + F.exp(-F.col("fit")))).drop("fit")


def imputed(df: DataFrame, by: str | None, columns: list[str], rounds: int = 5) -> DataFrame:
    """Missing values of the columns filled by chained regressions: from the
    group's means, each column in turn is predicted by the others from the rows
    that have it, ``rounds`` times. Filled columns are named ``<name>_filled``.
    A column that is missing in a whole group stays so there, and then doesn't
    predict others: it counts as 0."""
    own = _grouped(df.withColumn("_row", F.struct("*")), by).select("_row", "_by", *(F.col(c).cast("double").alias(f"_c{i}") for i, c in enumerate(columns)))
    names = [f"_c{i}" for i in range(len(columns))]
    means = own.groupBy(F.col("_by").alias("_own")).agg(*(F.avg(c).alias(f"_m{c}") for c in names))
    rows = own.join(_whole(means, by), F.col("_by").eqNullSafe(F.col("_own"))).select("_row", "_by", *names, *(F.coalesce(c, f"_m{c}", F.lit(0.0)).alias(f"_f{c}") for c in names), *(F.col(f"_m{c}").isNull().alias(f"_no{c}") for c in names))
    state = materialize(rows, "imputed")
    for _ in range(rounds):
        turned = state
        for c in names:
            xs = [f"_f{o}" for o in names if o != c]
            # Written, so that the next column's fits don't make it again.
            fits = materialize(linear(turned, "_by", c, xs), "fits")
            turned = predict(turned, _whole(fits, by), "_by", xs).withColumn(f"_f{c}", F.coalesce(c, "fit", f"_f{c}")).drop("fit")
        state = materialize(turned.select(*state.columns), "imputed", instead_of=state)
    return state.select("_row.*", *(F.when(~F.col(f"_no_c{i}"), F.col(f"_f_c{i}")).alias(f"{c}_filled") for i, c in enumerate(columns)))
