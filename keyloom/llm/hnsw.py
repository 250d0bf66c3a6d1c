"""Approximate nearest neighbours: a navigable small-world graph per shard.

Equal vectors are one node with the smallest ids of its copies (no answer needs
more than k + 1 of them). Nodes are dealt to shards of about ``SHARD`` nodes by
a hash; each shard's hierarchical graph is built in one task and stored as one
row of flat arrays. A query walks the graph of every shard; all nodes found
there are scored exactly, in double precision on the original vectors, and the
shards' nearest are merged. So scaled copies of a vector, which tie, are all
scored as long as a shard holds no more than ``SEARCH`` of them.

A query's work grows with the number of shards. Where queries are a fixed share
of the rows, as in the query of this package, all work grows with the square of
the rows over ``SHARD``, so the shard should be as large as a task's memory
lets it be (about 1.2 kB a node of 128 components).

Results by case: vectors that are null, empty, zero or hold null or non-finite
components take no part, as queries or candidates; a query is compared with
vectors of its own number of components only, so it may have fewer than k
answers; of equally near vectors the smaller id comes first; repeated rows of
one id count once; an empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import materialize

#: Nodes of a shard, about; links of a node above the lowest layer (twice as
#: many there); nodes kept while building and while searching.
SHARD, LINKS, BUILD, SEARCH = 8192, 20, 96, 256
#: Queries of a block, and blocks that are searched together in one task.
QUERY_BLOCK, SPAN = 512, 16
MOST_PARTITIONS = 20_000
INSERT, EXPAND = 256, 4


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    scale = np.abs(rows).max(1, keepdims=True)
    rows = rows / scale
    return (rows / np.linalg.norm(rows, axis=1, keepdims=True)).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each pair of rows, in double precision. Every sum runs over one row
    in memory order, so equal vectors give equal scores."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    dots = (a * b).sum(-1)
    return dots / (np.sqrt((a * a).sum(-1)) * np.sqrt((b * b).sum(-1)))


class Graph:
    """Layers of neighbour lists; layer 0 holds every node. ``links[l]`` is an
    array of (nodes of the layer) x (places), -1 where there is none, and
    ``nodes[l]`` are the layer's nodes, in order of insertion."""

    def __init__(self, vectors: np.ndarray):
        self.x = vectors
        self.nodes: list[np.ndarray] = []
        self.links: list[np.ndarray] = []

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 1) -> Graph:
        own, n = cls(vectors), len(vectors)
        r = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - r.random(n)) / np.log(LINKS)).astype(int), 8)
        order = np.argsort(-level, kind="stable")  # upper layers first: an entry is there from the start
        own.x, level = vectors[order], level[order]
        for l in range(int(level.max()) + 1 if n else 0):
            many = int((level >= l).sum())
            own.nodes.append(np.arange(many))
            own.links.append(np.full((many, LINKS * (1 if l else 2)), -1, np.int32))
        for l in range(len(own.links) - 1, -1, -1):
            own._fill(l)
        own.order = order
        return own

    def _fill(self, l: int) -> None:
        """Insert the layer's nodes, in blocks that grow with what is there."""
        many, at = len(self.links[l]), 0
        above = len(self.links[l + 1]) if l + 1 < len(self.links) else 0
        while at < many:
            size = min(max(32, min(INSERT, at // 4)) if at else max(32, above), many - at)
            new = np.arange(at, at + size)
            near = self.x[new] @ self.x[new].T
            np.fill_diagonal(near, -np.inf)
            k = min(BUILD, size - 1)
            own = np.argsort(-near, axis=1)[:, :k].astype(np.int32) + at if k else np.zeros((size, 0), np.int32)
            if at:
                found, _ = self._walk(self.x[new], l, self._enter(self.x[new], l), BUILD, at)
                own = np.concatenate((found, own), axis=1)
            self.links[l][new, :LINKS] = self._choose(new, own, LINKS)
            self._back(l, new)
            at += size

    def _choose(self, of: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
        """Of each node's candidates up to ``most``, nearest first, leaving out
        those nearer to one already taken than to the node; then the nearest
        of the others, so that lists are full."""
        ok = (among >= 0) & (among != of[:, None])
        safe = np.where(ok, among, 0)
        near = np.where(ok, np.einsum("nd,ncd->nc", self.x[of], self.x[safe]), -np.inf)
        top = min(among.shape[1], 3 * most)
        cut = np.argsort(-near, axis=1, kind="stable")[:, :top]
        safe, near = np.take_along_axis(safe, cut, 1), np.take_along_axis(near, cut, 1)
        near[:, 1:][safe[:, 1:] == safe[:, :-1]] = -np.inf
        y = self.x[safe]
        between = y @ y.transpose(0, 2, 1)
        taken = np.zeros(near.shape, bool)
        closest = np.full(near.shape, -np.inf, np.float32)
        count = np.zeros(len(of), int)
        for c in range(near.shape[1]):
            take = (near[:, c] > closest[:, c]) & (near[:, c] > -np.inf) & (count < most)
            taken[:, c] = take
            count += take
            closest = np.where(take[:, None], np.maximum(closest, between[:, c]), closest)
        rank = np.where(taken, near + 4, near)
        out = np.full((len(of), most), -1, np.int32)
        best = np.argsort(-rank, axis=1, kind="stable")[:, :most]
        got = np.where(np.take_along_axis(near, best, 1) > -np.inf, np.take_along_axis(safe, best, 1), -1)
        out[:, : got.shape[1]] = got
        return out

    def _back(self, l: int, new: np.ndarray) -> None:
        """Link the new nodes' neighbours back to them."""
        links = self.links[l]
        width = links.shape[1]
        to = links[new, :LINKS]
        src, dst = np.repeat(new, LINKS)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        own, first, many = np.unique(dst, return_index=True, return_counts=True)
        more = np.full((len(own), int(many.max()) if len(own) else 0), -1, np.int32)
        more[np.repeat(np.arange(len(own)), many), np.arange(len(dst)) - np.repeat(first, many)] = src
        both = np.concatenate((links[own], more), axis=1)
        both = -np.sort(-both, axis=1)
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        full = (both >= 0).sum(1) > width
        both = -np.sort(-both, axis=1)
        links[own[~full]] = both[~full][:, :width] if both.shape[1] >= width else np.pad(both[~full], ((0, 0), (0, width - both.shape[1])), constant_values=-1)
        for at in range(0, int(full.sum()), 1024):
            rows = np.flatnonzero(full)[at : at + 1024]
            links[own[rows]] = self._choose(own[rows], both[rows], width)

    def _enter(self, q: np.ndarray, l: int) -> np.ndarray:
        """The node of the layer above to start from, by greedy descent."""
        here = np.zeros(len(q), np.int64)
        for above in range(len(self.links) - 1, l, -1):
            near = np.einsum("nd,nd->n", q, self.x[here])
            moved = np.ones(len(q), bool)
            while moved.any():
                to = self.links[above][here]
                s = np.where(to >= 0, np.einsum("nd,ncd->nc", q, self.x[np.maximum(to, 0)]), -np.inf)
                best = s.argmax(1)
                value = s[np.arange(len(q)), best]
                moved = value > near
                here = np.where(moved, to[np.arange(len(q)), best], here)
                near = np.where(moved, value, near)
        return here

    def _walk(self, q: np.ndarray, l: int, enter: np.ndarray, keep: int, there: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search from the entries, for all queries in step: the
        ``keep`` nearest nodes found, nearest first, and their nearness."""
        n, rows, links = len(q), np.arange(len(q))[:, None], self.links[l]
        seen = np.zeros((n, there + 1), bool)  # the last column stands for no node
        seen[:, -1] = True
        ids = np.full((n, keep), -1, np.int32)
        near = np.full((n, keep), -np.inf, np.float32)
        done = np.ones((n, keep), bool)
        ids[:, 0], near[:, 0], done[:, 0] = enter, np.einsum("nd,nd->n", q, self.x[enter]), False
        seen[rows[:, 0], enter] = True
        while True:
            open_ = np.where(done, -np.inf, near)
            pick = np.argpartition(-open_, EXPAND - 1, axis=1)[:, :EXPAND] if keep > EXPAND else np.argsort(-open_, axis=1)[:, :EXPAND]
            live = np.take_along_axis(open_, pick, 1) > -np.inf
            if not live.any():
                break
            np.put_along_axis(done, pick, True, 1)
            to = np.where(live[:, :, None], links[np.maximum(np.take_along_axis(ids, pick, 1), 0)], -1).reshape(n, -1)
            to = np.sort(np.where((to < 0) | (to >= there), there, to), axis=1)
            to[:, 1:][to[:, 1:] == to[:, :-1]] = there
            to = np.where(seen[rows, to], there, to)
            seen[rows, to] = True
            fresh = to < there
            r, c = np.nonzero(fresh)
            s = np.full(to.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[r], self.x[to[r, c]])
            all_near = np.concatenate((near, s), axis=1)
            best = np.argpartition(-all_near, keep - 1, axis=1)[:, :keep]
            ids = np.take_along_axis(np.concatenate((ids, to), axis=1), best, 1)
            near = np.take_along_axis(all_near, best, 1)
            done = np.take_along_axis(np.concatenate((done, ~fresh), axis=1), best, 1)
        order = np.argsort(-near, axis=1, kind="stable")
        ids, near = np.take_along_axis(ids, order, 1), np.take_along_axis(near, order, 1)
        return np.where(near > -np.inf, ids, -1), near

    def search(self, q: np.ndarray, keep: int = SEARCH) -> np.ndarray:
        """Nodes near each query (its unit vector), nearest first, -1 beyond."""
        return self._walk(q, 0, self._enter(q, 0), min(keep, len(self.x)), len(self.x))[0]

    def flat(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array([x.shape[0] for x in self.links], np.int32), "links": np.concatenate([x.ravel() for x in self.links])}

    @classmethod
    def from_flat(cls, vectors: np.ndarray, sizes: np.ndarray, links: np.ndarray) -> Graph:
        own, at = cls(vectors), 0
        for l, n in enumerate(sizes.tolist()):
            width = LINKS * (1 if l else 2)
            own.nodes.append(np.arange(n))
            own.links.append(links[at : at + n * width].reshape(n, width))
            at += n * width
        return own


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def component(rows: DataFrame, vector: str) -> str:
    """The type that components are kept in: float where they are, else
    double."""
    return "float" if rows.schema[vector].dataType.simpleString() == "array<float>" else "double"


def build_index(rows: DataFrame, key: str, vector: str, k: int, shard: int = SHARD) -> DataFrame:
    """A row for each shard: shard, dims, sizes and links (the graph's flat
    arrays), vectors (flat, in node order), ids (of each node, up to k + 1)."""
    kind = component(rows, vector)
    own = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{kind}>").alias("v")).where(usable(F.col("v")))
    turn = Window.partitionBy("v").orderBy("id")
    copies = own.distinct().withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k + 1)
    nodes = materialize(copies.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")
    by_dims = nodes.groupBy(F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("shards"))
    many = by_dims.agg(F.sum("shards")).first()[0] or 1
    dealt = nodes.withColumn("dims", F.size("v")).join(by_dims, "dims").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        v = _matrix(table["v"])
        first = table["ids"].combine_chunks()
        lowest = np.array([x[0] for x in first.to_pylist()])
        order = np.argsort(lowest)  # the graph doesn't depend on the order of arrival
        g = Graph.build(unit(v[order]), seed=1)
        order = order[g.order]
        flat = g.flat()
        return pa.table({
            "shard": pa.array([table["shard"][0].as_py()], pa.int32()),
            "dims": pa.array([v.shape[1]], pa.int32()),
            "sizes": pa.array([flat["sizes"]], pa.list_(pa.int32())),
            "links": pa.array([flat["links"]], pa.list_(pa.int32())),
            "vectors": pa.array([v[order].ravel()], pa.list_(pa.float32() if kind == "float" else pa.float64())),
            "ids": pa.array([first.take(pa.array(order)).to_pylist()], pa.list_(pa.list_(pa.int64()))),
        })

    fields = f"shard int, dims int, sizes array<int>, links array<int>, vectors array<{kind}>, ids array<array<long>>"
    # A partition for each shard: left to itself, Spark joins them again.
    apart = dealt.select("dims", "shard", "v", "ids").repartition(min(many, MOST_PARTITIONS), "dims", "shard")
    return materialize(apart.groupBy("dims", "shard").applyInArrow(run, fields), "graphs")


def _searcher(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            dims = left["dims"][0].as_py()
            x = left["vectors"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids = left["ids"][0].as_py()
            graph = Graph.from_flat(unit(x), *(left[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("sizes", "links")))
            q, names = _matrix(right["v"]), right["id"].to_numpy()
            for at in range(0, len(q), QUERY_BLOCK):
                some, who = q[at : at + QUERY_BLOCK], names[at : at + QUERY_BLOCK]
                found = graph.search(unit(some))
                scores = np.concatenate([cosines(np.repeat(some[b : b + 64, None], found.shape[1], axis=1), x[np.maximum(found[b : b + 64], 0)]) for b in range(0, len(some), 64)])
                scores[found < 0] = -np.inf
                # The k + 1 best nodes, one of which may be the query's own, and all that tie with them.
                near = scores >= -np.partition(-scores, min(k, scores.shape[1] - 1), axis=1)[:, min(k, scores.shape[1] - 1)][:, None]
                for i, own in enumerate(who.tolist()):
                    best = sorted((-scores[i, j], v) for j in np.flatnonzero(near[i] & (found[i] >= 0)).tolist() for v in ids[found[i, j]] if v != own)[:k]
                    out["query_id"] += [own] * len(best)
                    out["vec_id"] += [v for _, v in best]
                    out["score"] += [-s for s, _ in best]
        return pa.table({"query_id": pa.array(out["query_id"], pa.int64()), "vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 5, shard: int = SHARD) -> DataFrame:
    """query_id, rank, vec_id, score: of each query its k nearest rows other
    than itself."""
    index = build_index(rows, key, vector, k, shard)
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast(f"array<{component(rows, vector)}>").alias("v")).where(usable(F.col("v"))).distinct()
    spans = asked.groupBy(F.size("v").alias("dims")).agg(F.ceil(F.count(F.lit(1)) / (QUERY_BLOCK * SPAN)).cast("int").alias("spans"))
    # Every block of queries meets every shard.
    shards = index.groupBy("dims").agg(F.collect_set("shard").alias("shards"))
    asked = asked.withColumn("dims", F.size("v")).join(spans.join(shards, "dims"), "dims")
    asked = asked.withColumn("span", F.pmod(F.xxhash64("id"), F.col("spans")).cast("int")).select("dims", F.explode("shards").alias("shard"), "span", "id", "v")
    held = index.join(spans, "dims").select(*index.columns, F.explode(F.sequence(F.lit(0), F.col("spans") - 1)).alias("span"))
    found = held.groupBy("dims", "shard", "span").cogroup(asked.groupBy("dims", "shard", "span")).applyInArrow(_searcher(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
