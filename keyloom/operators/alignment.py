"""Sequences aligned against a table of sequences.

Each pair of a query and a target that share a run of ``k`` letters is found by
a join on those runs, its shared runs are gathered into diagonals, and the pair
is scored in a band round its best ones only. No list of all pairs is made: what
is compared grows with the runs that are shared.

What is found: every pair with an alignment that has a run of k equal letters
and stays within ``band`` places of one of the ``diagonals`` diagonals with most
shared runs. An alignment of n letters with e differences has a run of at least
n // (e + 1), so with k = 8, whatever has 54 letters and 5 differences (90 %
identity) is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.storage import materialize


def _runs(df: DataFrame, key: str, sequence: str, k: int, prefix: str) -> DataFrame:
    """(run, <prefix>, <prefix>_at): each run of k letters with its place."""
    own = df.select(F.col(f"`{key}`").alias(prefix), F.col(f"`{sequence}`").alias("_s")).where((F.length("_s") >= k) & F.col(prefix).isNotNull())
    placed = own.select(prefix, "_s", F.explode(F.sequence(F.lit(1), F.length("_s") - k + 1)).alias("_p"))
    return placed.select(F.substr("_s", F.col("_p"), F.lit(k)).alias("run"), prefix, (F.col("_p") - 1).alias(f"{prefix}_at"))


def candidates(queries: DataFrame, targets: DataFrame, query: str, target: str, sequence: str, k: int, band: int, diagonals: int, pairs: DataFrame | None = None) -> DataFrame:
    """(q, t, diagonals): pairs with the diagonals (a query's place minus the
    target's, in steps of the band) that have most shared runs. Runs are first
    counted where they repeat within a sequence's stretch of band places, so a
    run that fills a sequence meets another one's once for each pair of
    stretches. ``pairs`` (q, t): only these."""
    stretch = lambda df, p: df.groupBy("run", p, F.floor(F.col(f"{p}_at") / band).alias(f"{p}_s")).agg(F.count(F.lit(1)).alias(f"{p}_n"), F.avg(f"{p}_at").alias(f"{p}_m"))
    a, b = stretch(_runs(queries, query, sequence, k, "q"), "q"), stretch(_runs(targets, target, sequence, k, "t"), "t")
    both = a.join(b, "run") if pairs is None else pairs.join(a, "q").join(b, ["t", "run"])
    met = both.groupBy("q", "t", F.floor((F.col("q_m") - F.col("t_m")) / band).cast("long").alias("d")).agg(F.sum(F.least("q_n", "t_n")).alias("n"))
    ranked = met.withColumn("_r", F.row_number().over(Window.partitionBy("q", "t").orderBy(F.desc("n"), "d"))).where(F.col("_r") <= diagonals)
    return ranked.groupBy("q", "t").agg(F.sort_array(F.collect_list("d")).alias("diagonals"))


def banded(a: np.ndarray, b: np.ndarray, low: int, high: int, match: int, mismatch: int, gap: int) -> tuple[int, int, int, int, int, int]:
    """Of the best local alignment on the diagonals from low to high: score,
    starts and ends (from 0, excluded) in both, and equal letters. A row of the
    band is one array operation; the way back follows the scores."""
    width = high - low + 1
    table = np.zeros((len(a) + 1, width + 2), np.int32)  # cell (i, d): letters i of a and i - (low + d - 1) of b
    places = np.arange(width)
    slope = gap * places[::-1]
    for i in range(1, len(a) + 1):
        j = i - (low + places)
        inside = (j >= 1) & (j <= len(b))
        if not inside.any():
            continue
        equal = np.zeros(width, bool)
        equal[inside] = b[j[inside] - 1] == a[i - 1]
        best = np.maximum(table[i - 1, 1:-1] + np.where(equal, match, -mismatch), table[i - 1, :-2] - gap)
        row = np.where(inside, np.maximum(best, 0), 0)
        # A gap in a runs from a higher diagonal to a lower one.
        run = np.maximum.accumulate((row + slope)[::-1])[::-1] - slope
        table[i, 1:-1] = np.where(inside, np.maximum(row, run), 0)
    i, d = np.unravel_index(table.argmax(), table.shape)
    score, same = int(table[i, d]), 0
    q_end, t_end = int(i), int(i - (low + d - 1))
    while table[i, d] > 0:
        j = i - (low + d - 1)
        hit = a[i - 1] == b[j - 1]
        if table[i, d] == table[i - 1, d] + (match if hit else -mismatch):
            same += int(hit)
            i -= 1
        elif table[i, d] == table[i - 1, d - 1] - gap:
            i, d = i - 1, d - 1
        else:
            d += 1
    return score, int(i), q_end, int(i - (low + d - 1)), t_end, same


def best_scores(a: list[np.ndarray], b: list[np.ndarray], low: np.ndarray, width: int, match: int, mismatch: int, gap: int) -> np.ndarray:
    """The best score of each of many pairs in its own band, all bands as wide:
    the same table as ``banded``'s, of which a row of all pairs is held at a
    time."""
    long, wide = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    rows = np.arange(len(a))[:, None]
    first, second = np.zeros((len(a), max(1, long.max())), np.uint32), np.zeros((len(a), max(1, wide.max())), np.uint32)
    for i, (x, y) in enumerate(zip(a, b)):
        first[i, : len(x)], second[i, : len(y)] = x, y
    table, best = np.zeros((len(a), width + 2), np.int32), np.zeros(len(a), np.int32)
    places = np.arange(width)
    slope = (gap * places[::-1]).astype(np.int32)
    for i in range(1, long.max() + 1):
        j = i - (low[:, None] + places)
        inside = (j >= 1) & (j <= wide[:, None]) & (i <= long[:, None])
        equal = second[rows, np.clip(j - 1, 0, second.shape[1] - 1)] == first[:, i - 1, None]
        row = np.where(inside, np.maximum(np.maximum(table[:, 1:-1] + np.where(equal, match, -mismatch), table[:, :-2] - gap), 0), 0).astype(np.int32)
        run = np.maximum.accumulate((row + slope)[:, ::-1], axis=1)[:, ::-1] - slope
        table[:, 1:-1] = np.where(inside, np.maximum(row, run), 0)
        best = np.maximum(best, table.max(1))
    return best


#: Cells of all bands that are scored at a time.
CELLS = 1 << 18


def hits(queries: DataFrame, targets: DataFrame, query: str, target: str, sequence: str = "sequence", k: int = 8, band: int = 8, diagonals: int = 3, least: int = 20, match: int = 2, mismatch: int = 2, gap: int = 3) -> DataFrame:
    """(query, target, score, q_start, q_end, t_start, t_end, percent) of pairs
    that score ``least`` or more: the best local alignment of those in a band
    round each candidate diagonal; ``percent``: equal letters over the query's
    length. Ids are unique; rows whose id or sequence is null take no part, nor
    do sequences shorter than k."""
    pairs = candidates(queries, targets, query, target, sequence, k, band, diagonals)
    return _scored(pairs, queries, targets, query, target, sequence, band, least, match, mismatch, gap)


def _scored(pairs: DataFrame, queries: DataFrame, targets: DataFrame, query: str, target: str, sequence: str, band: int, least: int, match: int, mismatch: int, gap: int) -> DataFrame:
    q = queries.select(F.col(f"`{query}`").alias("q"), F.col(f"`{sequence}`").alias("q_text"))
    t = targets.select(F.col(f"`{target}`").alias("t"), F.col(f"`{sequence}`").alias("t_text"))
    whole = pairs.join(q, "q").join(t, "t").select("q", "t", "diagonals", "q_text", "t_text")
    schema = StructType([whole.schema["q"], whole.schema["t"], *StructType.fromDDL("score int, q_start int, q_end int, t_start int, t_end int, percent double").fields])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        letters = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
        width = 3 * band + 1
        for batch in batches:
            texts = [(letters(x), letters(y)) for x, y in zip(batch["q_text"], batch["t_text"])]
            owner = np.repeat(np.arange(len(batch)), [len(d) for d in batch["diagonals"]])
            low = np.concatenate([np.asarray(d, np.int64) for d in batch["diagonals"]]) * band - band if len(owner) else np.zeros(0, np.int64)
            # Pairs of about one length together, as many as fit.
            order = sorted(range(len(owner)), key=lambda i: max(len(x) for x in texts[owner[i]]))
            scores, at = np.zeros(len(owner), np.int32), 0
            while at < len(order):
                n = 1
                while at + n < len(order) and (n + 1) * max(width, len(texts[owner[order[at + n]]][0]), len(texts[owner[order[at + n]]][1])) <= CELLS:
                    n += 1
                own = order[at : at + n]
                scores[own] = best_scores([texts[owner[i]][0] for i in own], [texts[owner[i]][1] for i in own], low[own], width, match, mismatch, gap)
                at += n
            top = np.zeros(len(batch), np.int32)
            np.maximum.at(top, owner, scores)
            # The way of an alignment is only followed where it is a hit.
            found: dict[int, tuple] = {}
            for i in np.flatnonzero((scores >= max(1, least)) & (scores == top[owner])).tolist():
                one = banded(*texts[owner[i]], int(low[i]), int(low[i]) + width - 1, match, mismatch, gap)
                key = lambda r: (r[0], [-v for v in r[1:5]])
                found[owner[i]] = max(found.get(owner[i], one), one, key=key)
            ids = list(zip(batch["q"], batch["t"]))
            yield pd.DataFrame([(*ids[k], *r[:5], 100.0 * r[5] / len(texts[k][0])) for k, r in sorted(found.items())], columns=schema.names)

    return whole.mapInPandas(score, schema).withColumnsRenamed({"q": query, "t": target})


def best_hits(found: DataFrame, query: str, target: str) -> DataFrame:
    """The highest-scoring hit of each query, of equal ones that of the smallest
    target."""
    order = Window.partitionBy(query).orderBy(F.desc("score"), target)
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def _sure(length: Column, score: Column, match: int, mismatch: int, gap: int) -> Column:
    """The run of equal letters that any alignment with at least that score has,
    for a query of that length: e differences leave e + 1 runs, each costs the
    less of a gap and a mismatch, and a mismatch takes a letter besides."""
    cost = min(mismatch, gap)
    most = F.floor((match * length - score) / min(match + mismatch, gap))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(most, F.lit(0)).cast("int")), lambda e: F.ceil(F.ceil((score + cost * e) / match) / (e + 1)))
    return F.array_min(runs)


def best(queries: DataFrame, targets: DataFrame, query: str, target: str, sequence: str = "sequence", k: int = 8, band: int = 8, diagonals: int = 3, least: int = 20, match: int = 2, mismatch: int = 2, gap: int = 3) -> DataFrame:
    """``best_hits`` of ``hits``, without the hits that are not the best. Pairs
    are first joined on runs of twice k letters, then of k and a half. A query is
    done when every alignment as good as its best so far has such a run, so no
    better or equal one is left out; only the others meet targets by runs of k.
    The diagonals of a pair are those of its runs of k letters each time."""
    own = queries.select(F.col(f"`{query}`").alias("q"), F.col(f"`{sequence}`").alias(sequence)).where(F.col("q").isNotNull() & (F.length(sequence) >= k))
    left, found = materialize(own, "queries"), []
    # A file with one row group is one task's; its runs are many rows.
    targets = targets.select(target, sequence).repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), target)
    for seed in sorted({2 * k, 3 * k // 2, k}, reverse=True):
        if left.isEmpty():
            break
        pairs = None
        if seed > k:
            run = lambda df, key, p: _runs(df, key, sequence, seed, p).select("run", p).distinct()  # noqa: B023, E731
            pairs = materialize(run(left, "q", "q").join(run(targets, target, "t"), "run").select("q", "t").distinct(), "pairs")
        near = targets if pairs is None else targets.join(pairs.select(F.col("t").alias(target)).distinct(), target, "left_semi")
        placed = candidates(left, near, "q", target, sequence, k, band, diagonals, pairs)
        scored = _scored(placed, left, near, "q", target, sequence, band, least, match, mismatch, gap)
        top = materialize(best_hits(scored, "q", target), "best")
        if seed == k:
            found.append(top)
            break
        known = left.join(top.select("q", "score"), "q").where(_sure(F.length(sequence), F.col("score"), match, mismatch, gap) >= seed).select("q")
        found.append(top.join(known, "q", "left_semi"))
        left = materialize(left.join(known, "q", "left_anti"), "queries")
    return reduce(DataFrame.unionByName, found).withColumnRenamed("q", query) if found else hits(queries, targets, query, target, sequence, k, band, diagonals, least, match, mismatch, gap)
