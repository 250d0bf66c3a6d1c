"""Peaks of a density, by a sparse grid of counts.

Range and kernel width of each group come from one pass of aggregates that merge
(moments, and a quantile sketch). Values are then counted in cells of an eighth
of the kernel's width; only cells that have values are rows. Each cell adds its
share to the cells within five widths, a peak is a cell above its neighbours,
and round each peak the density is worked out anew on a grid eight times finer.
A cell's values count as if all were at their mean, which changes the density by
a thousandth at most where it is more than a thousandth of its peak.

No task holds a group: cells are the unit throughout, and the range may be any.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells to a kernel's width, widths to where a kernel ends, and finer steps to a cell.
CELLS, REACH, STEPS = 8, 5, 8
#: Relative accuracy of the quantiles, as the sketch's parameter.
ACCURACY = 10_000


def spread(df: DataFrame, by: str, value: str) -> DataFrame:
    """(_g, _n, _bw, _low, _high): each group's number of values, kernel width
    (Silverman's rule: 0.9 times the smaller of the deviation and the
    interquartile range over 1.34, over the fifth root of n) and range. Null and
    non-finite values take no part. Where both are 0, so that the rule gives
    none, it takes the deviation, else the first value's size, else 1."""
    x = _values(df, by, value)
    own = x.groupBy("_g").agg(F.count("_x").alias("_n"), F.stddev_samp("_x").alias("_sd"), F.percentile_approx("_x", [0.25, 0.75], ACCURACY).alias("_q"), F.min("_x").alias("_low"), F.max("_x").alias("_high"))
    sd, iqr = F.coalesce("_sd", F.lit(0.0)), (F.col("_q")[1] - F.col("_q")[0]) / 1.34
    least = F.least(sd, iqr)
    scale = F.when(least > 0, least).when(sd > 0, sd).when(F.col("_low") != 0, F.abs("_low")).otherwise(1.0)
    return own.select("_g", "_n", (0.9 * scale * F.pow(F.col("_n"), F.lit(-0.2))).alias("_bw"), "_low", "_high")


def _values(df: DataFrame, by: str, value: str) -> DataFrame:
    x = df.select(F.col(f"`{by}`").alias("_g"), F.col(f"`{value}`").cast("double").alias("_x"))
    return x.where(F.col("_x").isNotNull() & ~F.isnan("_x") & (F.abs("_x") != float("inf")))


def cells(df: DataFrame, by: str, value: str) -> DataFrame:
    """(_g, _bw, _n, _cell, _c, _m): the counts and means of cells."""
    own, wide = _values(df, by, value), spread(df, by, value).withColumnRenamed("_g", "_o")
    held = own.join(wide, F.col("_g").eqNullSafe(F.col("_o")))
    cell = F.floor(F.col("_x") * CELLS / F.col("_bw")).cast("long")
    return held.groupBy("_g", "_bw", "_n", cell.alias("_cell")).agg(F.count("_x").alias("_c"), F.avg("_x").alias("_m"))


def modes(df: DataFrame, by: str, value: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(by, mode, density): the peaks of each group's Gaussian kernel density.
    ``low`` and ``high`` say between which values peaks are wanted; the density
    is that of all values in any case. A level stretch counts at its start."""
    counted = cells(df, by, value)
    reach = CELLS * REACH
    kernel = lambda at: F.col("_c") * F.exp(-0.5 * F.pow((at - F.col("_m")) / F.col("_bw"), F.lit(2)))
    near = counted.withColumn("_cell", F.explode(F.sequence(F.col("_cell") - reach, F.col("_cell") + reach)))
    middle = (F.col("_cell") + 0.5) * F.col("_bw") / CELLS
    # Of a whole kernel, to ten digits, so that sums taken in another order tie.
    dense = near.groupBy("_g", "_bw", "_n", "_cell").agg(F.round(F.sum(kernel(middle)) / F.first("_n"), 10).alias("_d"))
    turned = dense.select("_g", "_bw", "_n", F.explode(F.array(*(F.struct((F.col("_cell") + s).alias("_cell"), F.lit(s).alias("s"), F.col("_d").alias("d")) for s in (-1, 0, 1)))).alias("x")).select("_g", "_bw", "_n", "x.*")
    side = lambda s: F.coalesce(F.max(F.when(F.col("s") == s, F.col("d"))), F.lit(0.0))
    top = turned.groupBy("_g", "_bw", "_n", "_cell").agg(side(0).alias("_d"), side(1).alias("_l"), side(-1).alias("_r")).where("_d > _l and _d >= _r")
    # Round each peak: the counts near it, against positions within a cell of it.
    wide = top.select("_g", "_bw", "_n", F.col("_cell").alias("_peak"), F.explode(F.sequence(F.col("_cell") - reach - 1, F.col("_cell") + reach + 1)).alias("_cell"))
    held = counted.select(F.col("_g").alias("_o"), F.col("_cell").alias("_k"), "_c", "_m")
    pairs = wide.join(held, F.col("_g").eqNullSafe(F.col("_o")) & (F.col("_cell") == F.col("_k")))
    fine = pairs.withColumn("_j", F.explode(F.sequence(F.lit(-STEPS), F.lit(STEPS))))
    at = (F.col("_peak") + 0.5 + F.col("_j") / STEPS) * F.col("_bw") / CELLS
    sums = fine.groupBy("_g", "_bw", "_n", "_peak", "_j").agg(F.round(F.sum(kernel(at)) / F.first("_n"), 10).alias("_d"))
    best = sums.groupBy("_g", "_bw", "_n", "_peak").agg(F.max(F.struct("_d", (-F.col("_j")).alias("_j"))).alias("x"))
    mode = (F.col("_peak") + 0.5 - F.col("x._j") / STEPS) * F.col("_bw") / CELLS
    out = best.select(F.col("_g").alias(by), mode.alias("mode"), (F.col("x._d") / (F.col("_bw") * (2 * F.pi()) ** 0.5)).alias("density"))
    if low is not None:
        out = out.where(F.col("mode") >= low)
    return out if high is None else out.where(F.col("mode") <= high)


def oracle(table: str, by: str, value: str) -> str:
    """The same in SQL."""
    reach = CELLS * REACH
    kernel = "c * exp(-0.5 * pow(({} - m) / bw, 2))"
    return f"""
WITH x AS MATERIALIZED (SELECT {by} AS g, {value}::DOUBLE AS x FROM {table} WHERE {value} IS NOT NULL),
s AS (SELECT g, count(*) AS n, coalesce(stddev_samp(x), 0) AS sd, (list(x ORDER BY x)[ceil(0.75 * count(*))::INT] - list(x ORDER BY x)[ceil(0.25 * count(*))::INT]) / 1.34 AS iqr, min(x) AS low FROM x GROUP BY g),
w AS MATERIALIZED (SELECT g, n, 0.9 * CASE WHEN least(sd, iqr) > 0 THEN least(sd, iqr) WHEN sd > 0 THEN sd WHEN low <> 0 THEN abs(low) ELSE 1 END * pow(n, -0.2) AS bw FROM s),
c AS MATERIALIZED (SELECT x.g, bw, n, floor(x * {CELLS} / bw)::BIGINT AS cell, count(*) AS c, avg(x) AS m FROM x JOIN w ON x.g IS NOT DISTINCT FROM w.g GROUP BY ALL),
e AS (SELECT g, bw, n, c, m, unnest(range(cell - {reach}, cell + {reach + 1})) AS cell FROM c),
d AS MATERIALIZED (SELECT g, bw, n, cell, round(sum({kernel.format(f"(cell + 0.5) * bw / {CELLS}")}) / n, 10) AS d FROM e GROUP BY g, bw, n, cell),
p AS (SELECT d.g, d.bw, d.n, d.cell AS peak FROM d LEFT JOIN d l ON l.g IS NOT DISTINCT FROM d.g AND l.cell = d.cell - 1 LEFT JOIN d r ON r.g IS NOT DISTINCT FROM d.g AND r.cell = d.cell + 1 WHERE d.d > coalesce(l.d, 0) AND d.d >= coalesce(r.d, 0)),
f AS (SELECT p.g, p.bw, p.n, peak, j, round(sum({kernel.format(f"((peak + 0.5 + j / {STEPS}) * p.bw / {CELLS})").replace("bw, 2", "p.bw, 2")}) / p.n, 10) AS d FROM p JOIN c ON p.g IS NOT DISTINCT FROM c.g AND c.cell BETWEEN peak - {reach + 1} AND peak + {reach + 1}, range(-{STEPS}, {STEPS + 1}) t(j) GROUP BY p.g, p.bw, p.n, peak, j)
SELECT g AS {by}, (peak + 0.5 + arg_max(j, d - j * 1e-14) / {STEPS}) * bw / {CELLS} AS mode, max(d) / (bw * sqrt(2 * pi())) AS density FROM f GROUP BY g, bw, peak"""
