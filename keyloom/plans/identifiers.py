"""Identifier equivalence over any number of tables.

A table's columns are formats, and a row says that its ids are of one thing. Ids
that rows link, directly or over other tables, are one class: the connected
components of all tables together. A class's canonical id is its smallest, in
the order of the formats. Translation between any two formats is then one join.

Components are found by alternating large and small stars: each round is a
minimum by node and an edge list again, written out, and no class is gathered,
so an id that a third of the rows share costs no more than others.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.storage import materialize


def _nodes(tables: list[DataFrame], formats: list[str]) -> list[DataFrame]:
    """Each table's ids as (rank of the format, id), a list for a row."""
    out = []
    for t in tables:
        own = [F.struct(F.lit(formats.index(c)).alias("rank"), F.col(f"`{c}`").cast("string").alias("id")) for c in t.columns if c in formats]
        every = F.array_sort(F.filter(F.array(*own), lambda x: x["id"].isNotNull() & (x["id"] != "")))
        out.append(t.select(every.alias("x")).where(F.size("x") > 0))
    return out


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """A star round over (u, v): a node's larger neighbours (or, small, itself
    and its smaller ones) hang on the smallest of it and its neighbours."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) from edges (u, v): the smallest node of each one's
    component; of nodes that are a root themselves no row."""
    held = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "stars")
    while not _flat(held):
        held = materialize(_stars(_stars(held, True), False), "stars", instead_of=held)
    return held.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _flat(edges: DataFrame) -> bool:
    """Whether each u has one v, and no v is a u: the components' stars."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


@dataclass(frozen=True)
class Equivalence:
    """``members`` (node, root) of all ids, roots included; a node is a struct
    (rank of its format, id)."""

    members: DataFrame
    formats: list[str]

    def canonical(self) -> DataFrame:
        """(format, id, canonical_format, canonical)."""
        name = lambda c: F.get(F.array(*map(F.lit, self.formats)), F.col(c)["rank"])
        return self.members.select(name("node").alias("format"), F.col("node")["id"].alias("id"), name("root").alias("canonical_format"), F.col("root")["id"].alias("canonical"))

    def index(self, source: str, target: str) -> DataFrame:
        """(source, target) of every id that has one: of a class with several
        ids of the target's format, the smallest."""
        of = lambda f: self.members.where(F.col("node")["rank"] == self.formats.index(f)).select(F.col("node")["id"].alias("id"), "root")
        best = of(target).groupBy("root").agg(F.min("id").alias("_to"))
        return of(source).join(best, "root").select(F.col("id").alias(source), F.col("_to").alias(target))

    def conflicts(self) -> DataFrame:
        """(canonical, format, n, first, last): classes that have several ids of
        one format, with how many and the outermost two."""
        own = self.canonical().groupBy("canonical_format", "canonical", "format").agg(F.count_distinct("id").alias("n"), F.min("id").alias("first"), F.max("id").alias("last"))
        return own.where("n > 1").select("canonical", "format", "n", "first", "last")

    def grown(self, tables: list[DataFrame]) -> Equivalence:
        """With further tables: what is known is contracted to its roots, so
        only the new rows' links are worked on, and members follow the roots
        that have changed."""
        rows = materialize(_row_links(tables, self.formats), "links")
        known = self.members.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        at_root = lambda df, c: df.join(known.toDF("_n", f"_{c}"), F.col(c) == F.col("_n"), "left").withColumn(c, F.coalesce(f"_{c}", c)).drop("_n", f"_{c}")
        moved = components(at_root(at_root(rows, "u"), "v"))
        ends = rows.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        new = at_root(ends.withColumn("root", F.col("node")), "root")
        every = self.members.unionByName(new.select("node", "root")).distinct().join(moved.select(F.col("node").alias("_m"), F.col("root").alias("_to")), F.col("root") == F.col("_m"), "left")
        return replace(self, members=materialize(every.select("node", F.coalesce("_to", "root").alias("root")).distinct(), "members"))


def _row_links(tables: list[DataFrame], formats: list[str]) -> DataFrame:
    """(u, v): each row's ids, linked to its smallest one, itself included."""
    parts = [t.select(F.explode("x").alias("u"), F.col("x")[0].alias("v")) for t in _nodes(tables, formats)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def equivalence(tables: list[DataFrame], formats: list[str] | None = None) -> Equivalence:
    """The classes of all tables' ids. ``formats``: the columns that are ids,
    the preferred first; by default all, as they first appear. Null and empty
    ids link nothing."""
    formats = formats or list(dict.fromkeys(c for t in tables for c in t.columns))
    links = materialize(_row_links(tables, formats), "links")
    found = components(links)
    ends = links.select(F.col("u").alias("node")).distinct()
    members = ends.join(found.select(F.col("node").alias("_n"), "root"), F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"))
    return Equivalence(materialize(members, "members"), list(formats))
