"""Centroid clustering by Yinyang grouping.

The centroids are clustered into groups once. A vector carries, from round to
round, an upper bound of its distance to its own centroid and one lower bound
for each group; they follow from how far centroids have moved. A vector is
compared with centroids only where its bounds don't settle its cluster: first
all groups together, then group by group, then centroid by centroid of the
groups left. Bounds decide only with a margin and distances are exact integers,
so the clusters are those of comparing every vector with every centroid.

Vectors and bounds are a written table, which each round reads and writes, so a
lost executor costs one task. The driver holds the centroids and their exact
sums, and gets from a round only what the vectors that changed their cluster
add to and take from them. A round after which no centroid has moved is the
last: those that follow would change nothing.

- Vectors that are null, of another length, or hold null or non-finite
  components take no part.
- A component beyond 2^27 after scaling counts as 2^27, so that squared
  distances stay within 64 bits.
- A repeated row is a vector of its own. Rows whose id is null are clustered
  too, and are seeds only where others don't suffice.
- With fewer vectors than clusters, there are as many clusters as vectors.
- An empty table gives no rows. The columns to keep travel in one struct, so
  their names may be any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from keyloom.llm.common import materialize

#: The largest component.
LARGEST = 1 << 27
#: Bounds decide where they differ by more than that share of them.
MARGIN = 1e-9
#: Centroids to a group, about.
TO_A_GROUP = 4


def quantized(vectors: DataFrame, embedding: str, dims: int, scale: int, keep: list[str]) -> DataFrame:
    """(row, v): the columns to keep, and the components as integers."""
    x = F.transform(embedding, lambda c: c.cast("double"))
    whole = F.col(embedding).isNotNull() & (F.size(embedding) == dims) & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    ints = F.transform(x, lambda c: F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), F.floor(c * scale))).cast("int"))
    return vectors.where(whole).select(F.struct(*keep).alias("row"), ints.alias("v"))


def seeds(rows: DataFrame, vec_id: str, k: int, salt: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in their order."""
    first = rows.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("row")[vec_id].cast("string")), 256).alias("h"), "v")
    found = [r.v for r in first.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]
    return np.array(found, np.int64)


def grouped(centres: np.ndarray, n: int) -> list[np.ndarray]:
    """The numbers of the centroids in each of up to n groups, by a few rounds
    of plain clustering of the centroids themselves."""
    middle = centres[:n].astype(float)
    for _ in range(5):
        own = ((centres[:, None, :] - middle[None, :, :]) ** 2.0).sum(2).argmin(1)
        middle = np.array([centres[own == g].mean(0) if (own == g).any() else middle[g] for g in range(len(middle))])
    return [found for g in range(len(middle)) if len(found := np.flatnonzero(own == g))]


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of vectors to one centroid, or to one each."""
    away = x.astype(np.int64) - centre
    return np.einsum("ij,ij->i", away, away)


def assigned(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centres: np.ndarray, moved: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """A round for a batch of vectors: their clusters and bounds now, and how
    many distances were taken. ``moved``: how far each centroid has."""
    own, taken = own.copy(), 0
    before = lower
    upper = upper + moved[own]
    lower = lower - np.array([moved[g].max() for g in groups])
    apart = lambda low, up: low > up * (1 + MARGIN) + MARGIN
    at = np.flatnonzero(~apart(lower.min(1), upper))
    taken += len(at)
    exact = squared(x[at], centres[own[at]])
    upper[at] = np.sqrt(exact)
    left = ~apart(lower[at].min(1), upper[at])
    at, best, exact = at[left], own[at[left]], exact[left]
    was, was_far = best.copy(), upper[at].copy()
    new_lower, scans = lower[at].copy(), []
    for g, members in enumerate(groups):
        rows = np.flatnonzero(~apart(lower[at, g], np.sqrt(exact)))
        far = np.empty((len(rows), len(members)))
        for j, c in enumerate(members):
            # Of a centroid that hasn't come near enough, its bound is kept.
            bound = before[at[rows], g] - moved[c]
            near = np.flatnonzero(~apart(bound, np.sqrt(exact[rows])) | (was[rows] == c))
            far[:, j] = bound
            d = squared(x[at[rows[near]]], centres[c])
            taken += len(near)
            far[near, j] = np.sqrt(d)
            here = rows[near]
            better = (d < exact[here]) | ((d == exact[here]) & (c < best[here]))
            exact[here[better]], best[here[better]] = d[better], c
        scans.append((rows, far))
    for g, (members, (rows, far)) in enumerate(zip(groups, scans)):
        # The old cluster's centroid counts again in a group that wasn't scanned.
        back = np.isin(was, members) & (was != best)
        new_lower[back, g] = np.minimum(new_lower[back, g], was_far[back])
        new_lower[rows, g] = np.where(members[None, :] == best[rows, None], np.inf, far).min(1)
    own[at], upper[at], lower[at] = best, np.sqrt(exact), new_lower
    return own, upper, lower, taken


def _round(state: DataFrame, centres: np.ndarray, moved: np.ndarray, groups: list[np.ndarray]) -> DataFrame:
    dims, schema = centres.shape[1], state.schema

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("v").flatten().to_numpy().reshape(-1, dims)
            was = b.column("cluster").to_numpy().astype(np.int64)
            lower = b.column("lower").flatten().to_numpy().reshape(-1, len(groups))
            own, upper, lower, _ = assigned(x, np.maximum(was, 0), b.column("upper").to_numpy(), lower, centres, moved, groups)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(groups), pa.int32()), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), pa.array(own, pa.int32()), pa.array(was, pa.int32()), pa.array(upper), lists], names=schema.names)

    return state.mapInArrow(step, schema)


def _changes(state: DataFrame) -> list:
    """What vectors that changed their cluster add to and take from each
    component of the clusters' sums, and from their sizes: a row for each
    cluster and component."""
    ways = F.explode(F.array(F.struct(F.col("cluster").alias("c"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("c"), F.lit(-1).alias("sign"))))
    rows = state.where("cluster <> was").select("v", ways.alias("x")).where("x.c >= 0").select("x.c", "x.sign", F.posexplode("v").alias("i", "value"))
    return rows.groupBy("c", "i").agg(F.sum("sign").alias("n"), F.sum(F.col("value").cast("long") * F.col("sign")).alias("s")).collect()


def clustered(vectors: DataFrame, vec_id: str, embedding: str, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: int = 3, keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """(row, v, cluster) of every vector that takes part, and the centroids:
    ``rounds`` times each vector goes to the nearest centroid (of equal ones to
    the first) and centroids that have vectors become the floor of their mean;
    then vectors go to the nearest once more. ``keep``: the columns in row,
    with the id among them."""
    state = materialize(quantized(vectors, embedding, dims, scale, list(dict.fromkeys([vec_id, *(keep or [])]))), "vectors")
    centres = seeds(state, vec_id, k, salt)
    if not len(centres):
        return state.withColumn("cluster", F.lit(0)), centres
    groups = grouped(centres, -(-len(centres) // TO_A_GROUP))
    sums, sizes, moved = [[0] * dims for _ in centres], [0] * len(centres), np.zeros(len(centres))
    state = state.select("row", "v", F.lit(-1).alias("cluster"), F.lit(-1).alias("was"), F.lit(float("inf")).alias("upper"), F.array(*(F.lit(0.0) for _ in groups)).alias("lower"))
    for turn in range(rounds + 1):
        state = materialize(_round(state, centres, moved, groups), "clusters", instead_of=state)
        if turn == rounds:
            break
        for change in _changes(state):
            sums[change.c][change.i] += change.s
            sizes[change.c] += change.n if change.i == 0 else 0
        new = np.array([[s // n for s in own] if n else list(old) for own, n, old in zip(sums, sizes, centres.tolist())], np.int64)
        moved = np.sqrt(((new - centres).astype(float) ** 2).sum(1)) * (1 + MARGIN)
        if (new == centres).all():
            break
        centres = new
    return state.select("row", "v", "cluster"), centres


def summary(found: DataFrame, centres: np.ndarray) -> DataFrame:
    """The columns of row, and cluster, distance (squared), cluster_inertia,
    inertia, and centroid_sha256, of the final centroid's components."""
    kept = [F.col("row")[f].alias(f) for f in found.schema["row"].dataType.names if f not in ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")]
    if not len(centres):
        return found.where("false").select(*kept, "cluster", *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    own = found.sparkSession.createDataFrame([(i, c, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centres.tolist())], "cluster int, centre array<long>, centroid_sha256 string")
    away = F.aggregate(F.zip_with("v", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0).cast("long"), lambda s, d: s + d)
    # One row for each of the k clusters on the broadcast sides.
    rows = found.join(F.broadcast(own), "cluster").select("row", "cluster", away.alias("distance"), "centroid_sha256")
    sizes = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()
    total = sum(r.cluster_inertia for r in sizes)
    inertia = found.sparkSession.createDataFrame([(r.cluster, r.cluster_inertia, total) for r in sizes], "cluster int, cluster_inertia long, inertia long")
    return rows.join(F.broadcast(inertia), "cluster").select(*kept, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The same in SQL: each round a common table of centroids."""
    square = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    near = f"SELECT v.vec_id, v.v, arg_min(c.n, ({square}, c.n)) AS n, min({square}) AS d FROM v, {{0}} c GROUP BY v.at, v.vec_id, v.v"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, row_number() OVER () AS at, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS v FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS n, v AS c FROM (SELECT v, sha256('3:' || vec_id) AS h FROM v ORDER BY h LIMIT {k}))",
    ]
    for r in range(1, rounds + 1):
        parts.append(f"a{r} AS ({near.format(f'c{r - 1}')})")
        parts.append(f"m{r} AS (SELECT n, list(m ORDER BY i) AS c FROM (SELECT n, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY n, i) GROUP BY n)")
        parts.append(f"c{r} AS MATERIALIZED (SELECT o.n, coalesce(m.c, o.c)::BIGINT[] AS c FROM c{r - 1} o LEFT JOIN m{r} m ON m.n = o.n)")
    parts.append(f"f AS MATERIALIZED ({near.format(f'c{rounds}')})")
    return f"WITH {', '.join(parts)} SELECT vec_id, f.n::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY f.n))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM f JOIN c{rounds} c ON c.n = f.n"
